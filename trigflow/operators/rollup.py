"""Roll-up over sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trigflow.functions.scalars import session_date


def _pick(group: str, col: str) -> Column:
    return F.max(F.when(F.col("grp") == group, F.col(col)))


def _outcome_means(trials: DataFrame, prefix: str, outcomes: tuple[str, ...]) -> DataFrame:
    v = F.nanvl(F.col("value"), F.lit(None).cast("double"))
    return trials.groupBy("session_id").agg(
        F.lit(True).alias(f"{prefix}_listed"),
        *[F.avg(F.when(F.col("outcome") == o, v)).alias(f"{prefix}_{o.lower()}_trials") for o in outcomes])


def session_rollup(sessions: DataFrame, change_stats: DataFrame, baseline_stats: DataFrame,
                   change_trials: DataFrame | None = None, baseline_trials: DataFrame | None = None) -> DataFrame:
    """One row per session that has both statistics tables, ordered by date then name.

    Means come from the per-trial scalars where the session has them, else from the group
    statistics; sessions without a date come last.
    """
    ch = change_stats.groupBy("session_id").agg(
        F.coalesce(_pick("Hit", "n"), F.lit(0)).alias("n_hit"),
        F.coalesce(_pick("Miss", "n"), F.lit(0)).alias("n_miss"),
        _pick("Hit", "mean").alias("ch_hit"), _pick("Miss", "mean").alias("ch_miss"))
    ba = baseline_stats.groupBy("session_id").agg(
        _pick("Hit", "mean").alias("ba_hit"), _pick("FA>3s", "mean").alias("mean_baseline_FA_gt3"))
    out = sessions.join(ch, "session_id").join(ba, "session_id")

    def prefer(trials: DataFrame | None, prefix: str, outcomes: tuple[str, ...]) -> list[Column]:
        nonlocal out
        if trials is None:
            return [F.col(f"{prefix}_{o.lower()}") for o in outcomes]
        out = out.join(_outcome_means(trials, prefix, outcomes), "session_id", "left")
        return [F.when(F.col(f"{prefix}_listed"), F.col(f"{prefix}_{o.lower()}_trials"))
                .otherwise(F.col(f"{prefix}_{o.lower()}")) for o in outcomes]

    hit, miss = prefer(change_trials, "ch", ("Hit", "Miss"))
    base_hit, = prefer(baseline_trials, "ba", ("Hit",))
    return out.select(
        "session_id", "session_name", session_date(F.col("session_name")).alias("session_date"),
        "n_hit", "n_miss", hit.alias("mean_change_hit"), miss.alias("mean_change_miss"),
        base_hit.alias("mean_baseline_hit"), "mean_baseline_FA_gt3", (hit - miss).alias("change_diff"),
    ).orderBy(F.col("session_date").asc_nulls_last(), "session_name")
