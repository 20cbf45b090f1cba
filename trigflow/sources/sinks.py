"""Result writers: response cache and guarded reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigflow.functions.ticks import BinGrid
from trigflow.operators.align import smooth_bins
from trigflow.session import cut_lineage


def write_response_cache(peth: DataFrame, root: str, event: str, grid: BinGrid, sigma: float | None = None,
                         mode: str = "overwrite") -> None:
    """PETH rows with their window and bin size, partitioned by session and event.

    With a ``sigma`` a smoothed curve is stored next to the mean one. Only the partitions
    written are replaced.
    """
    out = peth
    if sigma is not None:
        out = out.join(smooth_bins(peth, sigma, grid.n_bins).withColumnRenamed("smoothed", "rate_smoothed"),
                       ["session_id", "unit_id", "bin"])
    (
        out.withColumns({"event_name": F.lit(event), "window_lo_s": F.lit(grid.lo / 1e6),
                         "window_hi_s": F.lit(grid.hi / 1e6), "bin_size_s": F.lit(grid.bin_seconds)})
        .repartition("session_id").sortWithinPartitions("session_id", "unit_id", "bin")  # a session's rows are one file
        .write.mode(mode).option("partitionOverwriteMode", "dynamic")
        .partitionBy("session_id", "event_name").parquet(root)
    )


def read_response_cache(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root)


def _key(event: str, grid: BinGrid, sigma: float | None) -> dict:
    """What a cached curve depends on beside its session: event, bin bounds in ticks, smoothing."""
    bounds = F.sha2(F.lit(",".join(map(str, grid.bounds))), 256)
    return {"event_name": F.lit(event), "bounds": bounds, "sigma": F.lit(-1.0 if sigma is None else float(sigma))}


def _readable(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, empty where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" not in (err.getCondition() or ""):
            raise
        return spark.createDataFrame([], schema)


def cached_responses(spark: SparkSession, root: str, sessions: DataFrame, compute: Callable[[DataFrame], DataFrame], event: str,
                     grid: BinGrid, sigma: float | None = None) -> DataFrame:
    """PETH rows of ``sessions(session_id)``: those in the cache are read, the rest is computed and added to it.

    ``compute(sessions)`` gives the PETH of some sessions; it is called only if the ledger lacks one of
    them for this event, these bins and this smoothing, and for the lacking ones only. Rows are written
    before their ledger entries, under a batch of their own, and read only through the ledger, so a run that
    dies between leaves nothing that counts. Of two runs that add the same session one is read. Files are
    those of a batch, not one for each session; sessions without rows have an entry and are not computed again.
    """
    kind = dict(sessions.dtypes)["session_id"]
    key = _key(event, grid, sigma)
    entry = f"session_id {kind}, event_name string, bounds string, sigma double, batch string"
    asked = sessions.select("session_id").distinct().withColumns(key)
    ledger = _readable(spark, f"{root}/ledger", entry)
    on = ["session_id", *key]
    lacking = cut_lineage(asked.join(ledger, on, "left_anti"))
    if not lacking.isEmpty():
        batch = uuid.uuid4().hex
        rows = compute(lacking.select("session_id"))
        if sigma is not None:
            rows = rows.join(smooth_bins(rows, sigma, grid.n_bins).withColumnRenamed("smoothed", "rate_smoothed"),
                             ["session_id", "unit_id", "bin"])
        else:
            rows = rows.withColumn("rate_smoothed", F.lit(None).cast("double"))
        rows.withColumns({**key, "batch": F.lit(batch)}).write.mode("append").parquet(f"{root}/rows")
        lacking.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{root}/ledger")
        ledger = _readable(spark, f"{root}/ledger", entry)
    known = ledger.join(asked, on, "left_semi").groupBy(*on).agg(F.min("batch").alias("batch"))
    return spark.read.parquet(f"{root}/rows").join(known, [*on, "batch"], "left_semi").drop("batch", "bounds")


def write_report(df: DataFrame, path: str, fmt: str = "csv", overwrite: bool = False) -> None:
    """CSV or JSON report; an existing one is left alone unless ``overwrite``."""
    writer = df.write.mode("overwrite" if overwrite else "ignore")
    writer.option("header", "true").csv(path) if fmt == "csv" else writer.json(path)


def ordered_units(table: DataFrame) -> DataFrame:
    """A unit table in the order in which it is handed out: by session, then unit id, then block where there is one."""
    return table.orderBy(*[c for c in ("session_id", "unit_id", "block_id") if c in table.columns])
