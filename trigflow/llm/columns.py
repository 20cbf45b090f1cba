"""Helper columns that cannot clash with a caller's, and a bounded test of membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places of the bit table: 512 rows of 4 KB, whatever the input.
PLACES, BUCKET = 1 << 24, 1 << 15


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until ``df`` has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def perhaps_in(rows: DataFrame, key: Column, wanted: DataFrame, name: str) -> DataFrame:
    """``rows`` with a boolean ``name``: false means that the long ``key`` is not in ``wanted`` (one column).

    A bit table of fixed size is broadcast. It spares rows a shuffle where few keys are wanted; where
    it fills up, more rows are true, and the exact join that follows finds the same rows.
    """
    bucket, place, bits = unused(rows, "bucket", "place", "bits")
    code = F.pmod(F.col(wanted.columns[0]), F.lit(PLACES))
    table = wanted.select(F.floor(code / BUCKET).cast("int").alias(bucket), (code % BUCKET).alias("at")).groupBy(bucket).agg(
        F.bitmap_construct_agg("at").alias(bits))
    code = F.pmod(key, F.lit(PLACES))
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(F.col(place) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return (rows.withColumns({bucket: F.floor(code / BUCKET).cast("int"), place: (code % BUCKET).cast("int")})
            .join(F.broadcast(table), bucket, "left")
            .withColumn(name, F.coalesce(F.getbit(byte, (F.col(place) % 8).cast("int")) == 1, F.lit(False)))
            .drop(bucket, place, bits))
