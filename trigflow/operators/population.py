"""Population vectors: condition averages, projections, group statistics, t-tests.

``pop(session_id, trial_idx, bin, unit_id, rate)`` is sparse: an absent row is zero, so
every mean divides by the number of trials, taken from the trial table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trigflow.functions.tdist import t_p_value
from trigflow.functions.ticks import BinGrid
from trigflow.operators.running import dealt
from trigflow.session import cut_lineage

INF = float("inf")
BROADCAST_ROWS = 200_000


def by_trial(rows: DataFrame, trials: DataFrame, each: int = 4) -> DataFrame:
    """Rows dealt out for a join with the trials, in parts whose number grows with the trials (of ``each`` rows)."""
    return dealt(rows, "session_id", "trial_idx", rows=max(1, each * trials.count()))


def condition_average(pop: DataFrame, trials: DataFrame, units: DataFrame, n_bins: int = 1,
                      cond: str = "cond") -> DataFrame:
    """Mean rate per (session, condition, unit) over trials, and over bins when there are several."""
    pop = by_trial(pop, trials)
    n = trials.where(F.col(cond).isNotNull()).groupBy("session_id", cond).agg(F.count(F.lit(1)).alias("n"))
    sums = (
        pop.join(trials.select("session_id", "trial_idx", cond), ["session_id", "trial_idx"])
        .groupBy("session_id", cond, "unit_id").agg(F.sum("rate").alias("s"))
    )
    return (
        n.join(units.select("session_id", "unit_id"), "session_id")
        .join(sums, ["session_id", cond, "unit_id"], "left")
        .select("session_id", cond, "unit_id",
                (F.coalesce("s", F.lit(0.0)) / (F.col("n") * n_bins)).alias("avg_rate"))
    )


def unit_vector(weights: DataFrame, by: Sequence[str] = ("session_id",), w: str = "weight") -> DataFrame:
    """Weights divided by their norm; a zero vector stays as it is."""
    norm = weights.groupBy(*by).agg(F.sqrt(F.sum(F.col(w) * F.col(w))).alias("norm"))
    return weights.join(norm, list(by)).withColumn(
        w, F.when(F.col("norm") > 0, F.col(w) / F.col("norm")).otherwise(F.col(w))).drop("norm")


def mean_direction(averages: DataFrame, a: str, b: str, cond: str = "cond") -> DataFrame:
    """Unit vector from condition ``a`` to condition ``b`` as (session, unit, weight)."""
    diff = averages.where(F.col(cond).isin(a, b)).groupBy("session_id", "unit_id").agg(
        (F.max(F.when(F.col(cond) == b, F.col("avg_rate")))
         - F.max(F.when(F.col(cond) == a, F.col("avg_rate")))).alias("weight"))
    return unit_vector(diff.where("weight is not null"))


def broadcast_if_few(table: DataFrame) -> DataFrame:
    """The table as computed once, broadcast up to BROADCAST_ROWS rows; a join on its few keys would gather a unit in a task."""
    table = cut_lineage(table)
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def project(pop: DataFrame, weights: DataFrame, by: Sequence[str] = ("trial_idx", "bin")) -> DataFrame:
    """Dot product over units per trial (and bin); only trials with a point have a row."""
    on = [c for c in ("session_id", "bin", "unit_id", "fold") if c in weights.columns and c in pop.columns]
    return pop.join(broadcast_if_few(weights), on).groupBy("session_id", *by).agg(
        F.sum(F.col("rate") * F.col("weight")).alias("proj"))


def group_stats(values: DataFrame, value: str = "value", group: str = "grp",
                by: Sequence[str] = ("session_id",)) -> DataFrame:
    """n members (missing values included), mean without them, population SD over root n."""
    v = F.nanvl(F.col(value), F.lit(None).cast("double"))
    return values.where(F.col(group).isNotNull()).groupBy(*by, group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"),
        (F.stddev_pop(v) / F.sqrt(F.count(F.lit(1)))).alias("sem"))


def group_curve(proj: DataFrame, trials: DataFrame, n_bins: int, group: str = "grp") -> DataFrame:
    """Mean and SEM of the projection per session, group and bin; trials without a row count as zero."""
    n = trials.where(F.col(group).isNotNull()).groupBy("session_id", group).agg(F.count(F.lit(1)).alias("n"))
    sums = by_trial(proj, trials).join(trials.select("session_id", "trial_idx", group), ["session_id", "trial_idx"]).groupBy(
        "session_id", group, "bin").agg(
        F.sum("proj").alias("s"), F.sum(F.col("proj") * F.col("proj")).alias("s2"))
    mean = F.coalesce("s", F.lit(0.0)) / F.col("n")
    var = F.greatest(F.coalesce("s2", F.lit(0.0)) / F.col("n") - mean * mean, F.lit(0.0))
    return (
        n.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
        .join(sums, ["session_id", group, "bin"], "left")
        .select("session_id", group, "bin", "n", mean.alias("mean"), (F.sqrt(var) / F.sqrt("n")).alias("sem"))
    )


def selected_bins(grid: BinGrid) -> list[int]:
    """Bins centred at or before the event; all bins when there is none."""
    early = [k for k, c in enumerate(grid.centers) if c <= 0]
    return early or list(range(grid.n_bins))


def trial_scalar(proj: DataFrame, trials: DataFrame, bins: Sequence[int]) -> DataFrame:
    """Mean projection of each trial over a set of bins."""
    s = proj.where(F.col("bin").isin(*bins)).groupBy("session_id", "trial_idx").agg(F.sum("proj").alias("s"))
    return by_trial(trials, trials, 1).join(s, ["session_id", "trial_idx"], "left").withColumn(
        "value", F.coalesce("s", F.lit(0.0)) / F.lit(float(len(bins)))).drop("s")


def baseline_response(pop: DataFrame, trials: DataFrame, units: DataFrame, baseline: Sequence[int],
                      response: Sequence[int]) -> DataFrame:
    """Per unit: trials, mean baseline and response, and the sums of their paired difference."""
    nb, nr = float(len(baseline)), float(len(response))
    in_b, in_r = F.col("bin").isin(*baseline), F.col("bin").isin(*response)
    per = pop.where(in_b | in_r).groupBy("session_id", "unit_id", "trial_idx").agg(
        (F.sum(F.when(in_b, F.col("rate")).otherwise(0.0)) / nb).alias("b"),
        (F.sum(F.when(in_r, F.col("rate")).otherwise(0.0)) / nr).alias("r"))
    d = F.col("r") - F.col("b")
    sums = per.groupBy("session_id", "unit_id").agg(
        F.sum("b").alias("sb"), F.sum("r").alias("sr"), F.sum(d).alias("sd"), F.sum(d * d).alias("sd2"))
    n = trials.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0.0)
    return (
        units.select("session_id", "unit_id").join(n, "session_id").join(sums, ["session_id", "unit_id"], "left")
        .select("session_id", "unit_id", "n", (F.coalesce("sb", zero) / F.col("n")).alias("mean_baseline"),
                (F.coalesce("sr", zero) / F.col("n")).alias("mean_response"),
                F.coalesce("sd", zero).alias("sum_d"), F.coalesce("sd2", zero).alias("sum_d2"))
    )


def _ratio(num: Column, den: Column) -> Column:
    """num/den where a zero denominator gives a signed infinity, and 0/0 gives NULL."""
    return F.when(den != 0, F.try_divide(num, den)).when(num > 0, INF).when(num < 0, -INF)


def paired_t(pop: DataFrame, trials: DataFrame, units: DataFrame, baseline: Sequence[int],
             response: Sequence[int], alpha: float = 0.01) -> DataFrame:
    """Paired t-test of response against baseline per unit; responsive when p < alpha."""
    m = baseline_response(pop, trials, units, baseline, response)
    n = F.col("n")
    var = F.greatest(F.try_divide(F.col("sum_d2") - F.col("sum_d") * F.col("sum_d") / n, n - 1), F.lit(0.0))
    t = m.withColumn("t_stat", _ratio(F.col("sum_d") / n, F.sqrt(var / n))).withColumn(
        "df", (n - 1).cast("double"))
    p = t_p_value("t_stat", "df")
    return t.withColumn("p_value", p).select(
        "session_id", "unit_id", "n", "mean_baseline", "mean_response", "t_stat", "df", "p_value",
        F.coalesce(F.col("p_value") < alpha, F.lit(False)).alias("is_responsive"))


def welch_t(values: DataFrame, value: str = "value", group: str = "grp",
            by: Sequence[str] = ("session_id",)) -> DataFrame:
    """Welch t-test of every ordered pair of groups; NULL on the diagonal or below two values."""
    v = F.nanvl(F.col(value), F.lit(None).cast("double"))
    g = values.where(F.col(group).isNotNull()).groupBy(*by, group).agg(
        F.count(v).alias("n"), F.avg(v).alias("m"), F.var_samp(v).alias("v"))
    by = list(by)
    a = g.select(*by, *[F.col(c).alias(f"{c}_a") for c in (group, "n", "m", "v")])
    b = g.select(*by, *[F.col(c).alias(f"{c}_b") for c in (group, "n", "m", "v")])
    qa, qb = F.col("v_a") / F.col("n_a"), F.col("v_b") / F.col("n_b")
    ok = (F.col(f"{group}_a") != F.col(f"{group}_b")) & (F.col("n_a") >= 2) & (F.col("n_b") >= 2)
    t = F.when(ok, _ratio(F.col("m_a") - F.col("m_b"), F.sqrt(qa + qb)))
    df = F.when(ok, F.coalesce(
        F.try_divide((qa + qb) * (qa + qb), qa * qa / (F.col("n_a") - 1) + qb * qb / (F.col("n_b") - 1)),
        F.lit(1.0)))
    # A session has a handful of groups, so this is a few rows per session.
    return a.join(b, by).select(
        *by, F.col(f"{group}_a").alias("group_a"), F.col(f"{group}_b").alias("group_b"),
        t.alias("t_stat"), df.alias("df")).withColumn("p_value", t_p_value("t_stat", "df"))


def dense_unit_index(units: DataFrame) -> DataFrame:
    """(session, unit, u): position of a unit among the session's units in id order.

    One row per unit of a probe, not per event.
    """
    w = Window.partitionBy("session_id").orderBy("unit_id")
    return units.select("session_id", "unit_id").distinct().withColumn("u", F.row_number().over(w) - 1)
