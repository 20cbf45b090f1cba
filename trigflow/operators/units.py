"""Quality statistics of units, trials and sessions; histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trigflow.operators.running import collapse

PARTS = 64  # parts of equal count into which a unit's times are cut


def session_durations(points: DataFrame) -> DataFrame:
    """Seconds from the first to the last point of a session; 1 when there is no extent, at least 1 ms."""
    span = (F.max("t_us") - F.min("t_us")) / 1e6
    return points.groupBy("session_id").agg(
        F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"),
        F.when(F.coalesce(span, F.lit(0.0)) <= 0, 1.0).otherwise(F.greatest(span, F.lit(1e-3))).alias("duration_s"),
    )


def in_cells(points: DataFrame, per_cell: int) -> DataFrame:
    """(session, unit, t_us, n, cell): distinct times of each unit in cells of some ``per_cell`` that follow the time."""
    by = ["session_id", "unit_id"]
    probs = [i / PARTS for i in range(1, PARTS)]
    cut = points.groupBy(*by).agg(F.min("t_us").alias("_lo"), F.max("t_us").alias("_hi"), F.count("t_us").alias("_n"),
                                  F.percentile_approx("t_us", probs, 1000).alias("_cuts"))
    none = F.array().cast("array<bigint>")
    cut = cut.withColumn("_cuts", F.when(F.col("_n") > per_cell, F.array_distinct("_cuts")).otherwise(none))
    part = F.size(F.filter("_cuts", lambda c: c <= F.col("t_us")))
    low = F.coalesce(F.get("_cuts", F.col("_part") - 1), F.col("_lo"))
    high = F.coalesce(F.get("_cuts", F.col("_part")), F.col("_hi") + 1)
    slices = F.greatest(F.ceil(F.col("_n") / PARTS / per_cell), F.lit(1))
    place = F.floor((F.col("t_us") - low) / (high - low) * slices)
    return collapse(points, [*by, "t_us"]).join(cut, by).withColumn("_part", part).withColumn(
        "cell", F.col("_part") * slices + place).drop("_lo", "_hi", "_n", "_cuts", "_part")


def inter_point_intervals(points: DataFrame, per_cell: int = 4096) -> DataFrame:
    """Intervals between successive points of a unit as (session, unit, isi_us, n).

    Copies of one time give zero intervals. A unit of more than ``per_cell`` points is cut at
    approximate quantiles of its own times, and long parts into equal slices, so that cells hold some
    ``per_cell`` points each wherever the points crowd. Times are ordered inside cells, and the
    interval across cells comes from the cells' first and last times, so no unit is sorted in one task.
    """
    by = ["session_id", "unit_id"]
    times = in_cells(points, per_cell)
    prev = F.lag("t_us").over(Window.partitionBy(*by, "cell").orderBy("t_us"))
    inside = times.withColumn("prev", prev).select(*by, F.explode(F.array(
        F.struct((F.col("t_us") - F.col("prev")).alias("isi_us"), F.lit(1).cast("bigint").alias("n")),
        F.struct(F.lit(0).cast("bigint").alias("isi_us"), (F.col("n") - 1).alias("n")),
    )).alias("s")).select(*by, "s.*")
    ends = times.groupBy(*by, "cell").agg(F.min("t_us").alias("a"), F.max("t_us").alias("z"))
    gap = F.col("a") - F.lag("z").over(Window.partitionBy(*by).orderBy("cell"))
    across = ends.select(*by, gap.alias("isi_us"), F.lit(1).cast("bigint").alias("n"))
    return (
        inside.unionByName(across).where("isi_us is not null and n > 0")
        .groupBy(*by, "isi_us").agg(F.sum("n").alias("n"))
    )


def unit_quality(points: DataFrame, units: DataFrame | None = None, refractory_us: int = 2_000) -> DataFrame:
    """Counts, mean rate over the session and intervals strictly below the refractory time."""
    by = ["session_id", "unit_id"]
    counts = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n_spikes"))
    short = inter_point_intervals(points).where(F.col("isi_us") < refractory_us).groupBy(*by).agg(
        F.sum("n").alias("short"))
    base = counts if units is None else units.select(*by).join(counts, by, "left")
    n = F.coalesce("n_spikes", F.lit(0))
    viol = F.coalesce("short", F.lit(0))
    return (
        base.join(short, by, "left").join(session_durations(points), "session_id", "left")
        .select(*by, n.alias("n_spikes"),
                (n / F.coalesce("duration_s", F.lit(1.0))).alias("mean_rate_hz"),
                viol.cast("bigint").alias("isi_violations_count"),
                F.when(n < 2, 0.0).otherwise(viol / F.greatest(n - 1, F.lit(1))).alias("isi_violations_frac"))
    )


def trial_quality(trials: DataFrame) -> DataFrame:
    """Per session: trials, trials per outcome (NULL included), missing change and reaction times."""
    per = trials.groupBy("session_id", "outcome").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("change_time").isNull()).alias("no_change"),
        F.count_if(F.coalesce(F.size("reactiontimes"), F.lit(0)) <= 0).alias("no_rt"),
    )
    return per.groupBy("session_id").agg(
        F.sum("n").alias("n_trials"),
        F.array_sort(F.collect_list(F.struct("outcome", "n"))).alias("outcome_counts"),
        F.sum("no_change").alias("missing_change_time"),
        F.sum("no_rt").alias("trials_missing_reactiontimes"),
    )


def session_summary(sessions: DataFrame, trials: DataFrame, units: DataFrame, points: DataFrame,
                    channels: DataFrame) -> DataFrame:
    """One row per session: sizes, good units (NULL when none), duration and channel names."""
    good = F.size(F.coalesce("good_unit_ids", F.array()))
    n_trials = trials.groupBy("session_id").agg(F.count(F.lit(1)).alias("nt"))
    n_units = units.groupBy("session_id").agg(F.count_distinct("unit_id").alias("nu"))
    names = channels.groupBy("session_id").agg(F.array_sort(F.collect_set("channel")).alias("names"))
    dur = session_durations(points).select("session_id", "duration_s")
    out = sessions
    for part in (n_trials, n_units, names, dur):
        out = out.join(part, "session_id", "left")
    return out.select(
        "session_id", "subject", "session_name",
        F.coalesce("nt", F.lit(0)).alias("n_trials"), F.coalesce("nu", F.lit(0)).alias("n_units"),
        F.when(good > 0, good).alias("n_good_units"),
        F.coalesce("duration_s", F.lit(1.0)).alias("session_duration_s"),
        F.coalesce("names", F.array().cast("array<string>")).alias("event_channels"),
    )


def histogram(df: DataFrame, value: Column, bins: int = 50, by: tuple[str, ...] = ()) -> DataFrame:
    """Equal bins from the smallest to the largest value, last bin closed, every bin present.

    NULL and NaN are dropped; a single value is given a width of one around it.
    """
    v = df.select(*by, F.nanvl(value.cast("double"), F.lit(None).cast("double")).alias("v")).where("v is not null")
    same = F.col("mn") == F.col("mx")
    if by:
        ends = v.groupBy(*by).agg(F.min("v").alias("mn"), F.max("v").alias("mx"))
    else:
        ends = v.agg(F.min("v").alias("mn"), F.max("v").alias("mx")).where("mn is not null")
    ends = ends.select(
        *by, F.when(same, F.col("mn") - 0.5).otherwise(F.col("mn")).alias("lo"),
        F.when(same, F.col("mx") + 0.5).otherwise(F.col("mx")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    slot = F.least(F.floor((F.col("v") - F.col("lo")) / width).cast("int"), F.lit(bins - 1))
    if by:
        rows = v.join(ends, list(by))
    else:
        rows = v.withColumns({c: ends.select(c).scalar() for c in ("lo", "hi")})
    counts = rows.groupBy(*by, slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return frame.join(counts, [*by, "bin"], "left").select(
        *by, "bin", (F.col("lo") + F.col("bin") * width).alias("left_edge"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("right_edge"),
        F.coalesce("n", F.lit(0)).alias("n"))
