"""Running counts and order statistics that never put a whole key in one task.

A plain ``Window.partitionBy(key).orderBy(t)`` sends every row of a key to one
task. Here a key is cut into *cells* of its ordering value. Rows are ordered only
inside a cell; what lies before the cell comes from a table of cell totals. Equal
values are collapsed to one row with a multiplicity first, so a cell of
``2**bits`` ticks never holds more than ``2**bits`` distinct rows per key.

Key columns must not be called cell, salt, base, local, rank, n, w, x, k or tag.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A (key, cell) with more than this share of all rows is split by a salt. At most
# 1 / HEAVY_SHARE cells can exceed it, which bounds the broadcast table.
HEAVY_SHARE = 1.0 / 256
QUANTILES, SLICES = 32, 128  # cells of an order statistic: parts of a key, slices of a part
HEAVY_MIN_ROWS = 200_000
PART_ROWS = 500_000  # rows of a part where sorts and hash tables of nearly distinct keys follow

UNB, CUR = Window.unboundedPreceding, Window.currentRow


def cell_bits(span_ticks: int) -> int:
    """Cell width for windows of this span: 2**20 ticks (about 1 s) … 2**26 (67 s)."""
    return max(20, min(26, int(span_ticks).bit_length() - 5))


def collapse(df: DataFrame, by: Sequence[str], n: str = "n") -> DataFrame:
    """Identical rows become one row with a multiplicity."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(n))


def dealt(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """Dealt out by keys in parts of about PART_ROWS rows (of ``rows`` in all, else counted).

    Parts by bytes grow with the input until they hold some millions of narrow rows, and a join with a grouping by
    nearly distinct keys then keeps four copies of them in the task. Here the number of parts grows instead.
    """
    wanted = -(-(rows or df.count()) // PART_ROWS)
    return df.repartition(wanted, *keys) if wanted > df.sparkSession.sparkContext.defaultParallelism else df


def heavy_cells(counts: DataFrame, by: Sequence[str], share: float = HEAVY_SHARE,
                min_rows: int = HEAVY_MIN_ROWS, n: str = "n") -> DataFrame:
    """Rows of ``counts`` above ``share`` of the total, with a salt count.

    No more than 1/share rows can pass, so the result is safe to broadcast.
    """
    limit = counts.agg(F.greatest(F.lit(float(min_rows)), F.sum(n) * F.lit(share))).scalar()
    return (
        counts.where(F.col(n) > limit)
        .select(*by, F.ceil(F.col(n) / limit).cast("int").alias("salts"))
    )


def _bases(totals: DataFrame, keys: Sequence[str], with_next: bool = False) -> DataFrame:
    """Marks before each cell of a key (and the first mark after it)."""
    up = Window.partitionBy(*keys).orderBy("cell").rowsBetween(UNB, -1)
    out = totals.withColumn("base", F.coalesce(F.sum("n").over(up), F.lit(0)).cast("bigint"))
    if with_next:
        down = Window.partitionBy(*keys).orderBy(F.col("cell").desc()).rowsBetween(UNB, -1)
        out = out.withColumn("next_cell_x", F.min("first_x").over(down))
    return out.drop("n", "first_x")


def _marked(marks: DataFrame, probes: DataFrame, keys: list[str], bits: int,
            with_next: bool) -> tuple[DataFrame, DataFrame]:
    """(probe rows with their in-cell count, cell bases)."""
    marks = marks.withColumn("cell", F.shiftright("x", bits))
    probes = probes.withColumn("cell", F.shiftright("x", bits))
    by = [*keys, "cell"]
    payload = [c for c in probes.columns if c not in (*by, "x")]

    probe_cells = collapse(probes, by)
    heavy = F.broadcast(heavy_cells(probe_cells, by))
    salts = F.coalesce(F.col("salts"), F.lit(1))
    m = (
        marks.join(heavy, by, "left")
        .select(*by, "x", "n", F.lit(0).alias("is_probe"),
                F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    )
    p = (
        probes.join(heavy, by, "left")
        .select(*by, "x", F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("is_probe"),
                F.pmod(F.xxhash64("x", *payload), salts).cast("int").alias("salt"), *payload)
    )
    rows = m.unionByName(p, allowMissingColumns=True)
    part = [*by, "salt"]
    before = Window.partitionBy(*part).orderBy("x", "is_probe").rowsBetween(UNB, CUR)
    rows = rows.withColumn("local", F.sum("n").over(before))
    if with_next:
        after = Window.partitionBy(*part).orderBy(F.col("x").desc(), F.col("is_probe").desc())
        mark_x = F.when(F.col("is_probe") == 0, F.col("x"))
        rows = rows.withColumn("next_local", F.min(mark_x).over(after.rowsBetween(UNB, CUR)))

    totals = (
        marks.groupBy(*by).agg(F.sum("n").alias("n"), F.min("x").alias("first_x"))
        .unionByName(probe_cells.select(*by, F.lit(0).cast("bigint").alias("n")), allowMissingColumns=True)
        .groupBy(*by).agg(F.sum("n").alias("n"), F.min("first_x").alias("first_x"))
    )
    if not with_next:
        totals = totals.drop("first_x")
    return rows.where("is_probe = 1").drop("is_probe", "n", "salt"), _bases(totals, keys, with_next)


def marks_up_to(marks: DataFrame, probes: DataFrame, keys: Sequence[str], bits: int = 20,
                with_next: bool = False) -> DataFrame:
    """For each probe, the number of marks of its key at or before ``x``.

    ``marks(keys, x, n)`` must be collapsed; ``probes(keys, x, …)`` may carry any
    payload, which is returned with ``rank`` and, if asked, ``next_x``: the first
    mark strictly after ``x``.
    """
    keys = list(keys)
    rows, bases = _marked(marks, probes, keys, bits, with_next)
    out = rows.join(bases, [*keys, "cell"]).withColumn("rank", F.col("local") + F.col("base"))
    drop = ["cell", "local", "base"]
    if with_next:
        out = out.withColumn("next_x", F.coalesce("next_local", "next_cell_x"))
        drop += ["next_local", "next_cell_x"]
    return out.drop(*drop)


def summed_marks_up_to(marks: DataFrame, probes: DataFrame, keys: Sequence[str],
                       by: Sequence[str], bits: int = 20) -> DataFrame:
    """Sum of ``w * (marks up to x)`` per (keys, by), without a row per probe leaving the cell."""
    keys, by = list(keys), list(by)
    rows, bases = _marked(marks, probes, keys, bits, False)
    per_cell = rows.groupBy(*keys, "cell", *by).agg(
        F.sum(F.col("w") * F.col("local")).alias("wl"), F.sum("w").alias("w")
    )
    wide = "decimal(19,0)"
    value = F.col("wl").cast("decimal(38,0)") + F.col("w").cast(wide) * F.col("base").cast(wide)
    return per_cell.join(bases, [*keys, "cell"]).groupBy(*keys, *by).agg(
        F.sum(value.cast("decimal(38,0)")).alias("s")
    )


def row_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], cell: Column,
             name: str = "rank") -> DataFrame:
    """1-based row number per key in the given order.

    ``cell`` must not decrease along ``order``; rows are sorted within a cell only.
    """
    keys = list(keys)
    by = [*keys, "cell"]
    rows = df.withColumn("cell", cell)
    local = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    bases = _bases(collapse(rows, by), keys)
    return (
        rows.withColumn("local", local).join(bases, by)
        .withColumn(name, (F.col("local") + F.col("base")).cast("bigint"))
        .drop("cell", "local", "base")
    )


def kth_smallest(df: DataFrame, keys: Sequence[str], v: str, wanted: DataFrame,
                 cell: Column | None = None) -> DataFrame:
    """Exact order statistics.

    ``wanted(keys, tag, k)`` asks for the k-th smallest (1-based) ``v`` per key; the
    result is ``(keys, tag, value)``. Counts per cell are combined map-side and only the
    one cell that holds the k-th value is shuffled and sorted. Without a ``cell`` the values
    of each key are cut at approximate quantiles and each part again into equal slices, so an
    outlier does not gather the rest in one cell; cells bear on the work only, not on the result.
    """
    keys = list(keys)
    values = df.where(F.col(v).isNotNull()).select(*keys, v)
    if cell is None:
        probs = [i / QUANTILES for i in range(QUANTILES + 1)]
        ends = values.groupBy(*keys).agg(F.percentile_approx(v, probs, 1000).alias("cuts"))
        part = F.size(F.filter("cuts", lambda c: c <= F.col(v)))
        lo, hi = (F.get("cuts", F.col("part") + i) for i in (-1, 0))
        share = F.least(F.greatest((F.col(v) - lo) / F.nullif(hi - lo, F.lit(0)), F.lit(0.0)), F.lit(0.999))
        values = values.join(ends, keys).withColumn("part", part).withColumn(
            "cell", F.col("part") * SLICES + F.coalesce(F.floor(share * SLICES), F.lit(0))).drop("cuts", "part")
    else:
        values = values.withColumn("cell", cell)
    totals = collapse(values, [*keys, "cell"])
    up = Window.partitionBy(*keys).orderBy("cell").rowsBetween(UNB, CUR)
    spans = totals.withColumn("upto", F.sum("n").over(up)).select(
        *keys, "cell", (F.col("upto") - F.col("n")).alias("base"), "upto"
    )
    hit = spans.join(wanted, keys).where("k > base and k <= upto").select(*keys, "cell", "tag", "k", "base")
    w = Window.partitionBy(*keys, "cell").orderBy(v).rowsBetween(UNB, CUR)
    inside = collapse(
        values.join(hit.select(*keys, "cell").distinct(), [*keys, "cell"], "left_semi"), [*keys, "cell", v]
    ).withColumn("local", F.sum("n").over(w))
    return (
        inside.join(hit, [*keys, "cell"])
        .where("base + local >= k and base + local - n < k")
        .select(*keys, "tag", F.col(v).alias("value"))
    )


def exact_percentiles(df: DataFrame, keys: Sequence[str], v: str, probs: dict[str, float],
                      cell: Column | None = None) -> DataFrame:
    """Linear-interpolation percentiles per key, one column per name in ``probs``."""
    keys = list(keys)
    sizes = df.where(F.col(v).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    pos = sizes.select(
        *keys,
        F.explode(F.array(*[
            F.struct(F.lit(name).alias("name"), (F.lit(p) * (F.col("n") - 1)).alias("pos"))
            for name, p in probs.items()
        ])).alias("q"),
    ).select(*keys, "q.name", F.floor("q.pos").alias("lo"), (F.col("q.pos") - F.floor("q.pos")).alias("frac"))
    wanted = pos.select(
        *keys,
        F.explode(F.array(
            F.struct(F.concat(F.col("name"), F.lit("|lo")).alias("tag"), (F.col("lo") + 1).alias("k")),
            F.struct(F.concat(F.col("name"), F.lit("|hi")).alias("tag"),
                     (F.col("lo") + 1 + F.ceil("frac")).alias("k")),
        )).alias("s"),
    ).select(*keys, "s.tag", "s.k")
    got = kth_smallest(df, keys, v, wanted, cell)
    name = F.substring_index("tag", "|", 1)
    ends = got.groupBy(*keys, name.alias("name")).agg(
        F.max(F.when(F.col("tag").endswith("|lo"), F.col("value"))).cast("double").alias("a"),
        F.max(F.when(F.col("tag").endswith("|hi"), F.col("value"))).cast("double").alias("b"),
    )
    value = F.col("a") + (F.col("b") - F.col("a")) * F.col("frac")
    return (
        ends.join(pos, [*keys, "name"]).withColumn("value", value)
        .groupBy(*keys)
        .agg(*[F.max(F.when(F.col("name") == nm, F.col("value"))).alias(nm) for nm in probs])
    )


def ntile_of(rank: Column, n: Column, k: Column) -> Column:
    """1-based tile of a 1-based rank among n rows, sizes as SQL NTILE gives them."""
    small = F.floor(n / k)
    big_rows = (small + 1) * (n % k)
    return F.when(rank <= big_rows, F.floor((rank - 1) / (small + 1)) + 1).otherwise(
        n % k + F.floor((rank - 1 - big_rows) / F.greatest(small, F.lit(1))) + 1
    ).cast("int")


def running_sums(df: DataFrame, keys: Sequence[str], x: str, sums: dict[str, str], bits: int = 20) -> DataFrame:
    """Adds inclusive running sums ``{new: column}`` along BIGINT ``x``, one row per (key, x) expected."""
    keys = list(keys)
    by = [*keys, "cell"]
    rows = df.withColumn("cell", F.shiftright(x, bits))
    local = Window.partitionBy(*by).orderBy(x).rowsBetween(UNB, CUR)
    up = Window.partitionBy(*keys).orderBy("cell").rowsBetween(UNB, -1)
    totals = rows.groupBy(*by).agg(*[F.sum(c).alias(f"t_{new}") for new, c in sums.items()])
    bases = totals.select(*by, *[F.coalesce(F.sum(f"t_{new}").over(up), F.lit(0)).alias(f"b_{new}") for new in sums])
    out = rows.withColumns({f"l_{new}": F.sum(c).over(local) for new, c in sums.items()}).join(bases, by)
    return out.withColumns({new: F.col(f"l_{new}") + F.col(f"b_{new}") for new in sums}).drop(
        "cell", *[f"l_{n}" for n in sums], *[f"b_{n}" for n in sums])
