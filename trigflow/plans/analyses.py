"""The three whole analyses: event responses, choice directions, response tagging.

Each takes the normalised tables of any number of sessions and returns lazy DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigflow.functions.ticks import BinGrid, bin_grid
from trigflow.operators import align, directions, population, tagging, trials
from trigflow.session import cut_lineage
from trigflow.sources.sinks import cached_responses

Tables = dict[str, DataFrame]


def event_response(tables: Tables, event: str, grid: BinGrid | None = None,
                   use_good_only: bool = True) -> DataFrame:
    """PETH of every (good) unit around a channel event or an outcome."""
    grid = grid or bin_grid((-0.5, 1.0), 0.01)
    units = align.good_units(tables["units"], tables["sessions"], use_good_only=use_good_only)
    triggers = trials.event_triggers(tables["trials"], tables["channel_events"], event)
    points = tables["spikes"].join(units.select("session_id", "unit_id"), ["session_id", "unit_id"], "left_semi")
    return align.peth(points, triggers, units, grid)


def cached_event_response(spark: SparkSession, tables: Tables, event: str, root: str, grid: BinGrid | None = None,
                          use_good_only: bool = True, sigma: float | None = None) -> DataFrame:
    """:func:`event_response` through the cache at ``root``: sessions it knows for these settings are not computed.

    Caches of good and of all units need roots of their own.
    """
    grid = grid or bin_grid((-0.5, 1.0), 0.01)

    def compute(sessions: DataFrame) -> DataFrame:
        some = {name: t.join(sessions, "session_id", "left_semi") if "session_id" in t.columns else t for name, t in tables.items()}
        return event_response(some, event, grid, use_good_only)

    return cached_responses(spark, root, tables["sessions"], compute, event, grid, sigma)


def choice_analysis(tables: Tables, grid: BinGrid | None = None, n_permutations: int = 20, reg: float = 1.0,
                    use_good_only: bool = True, contrast: tuple[str, ...] | None = None,
                    strict_baseline: bool = False) -> dict[str, DataFrame]:
    """Directions around the change and in the baseline, with scalars, group statistics and tests.

    Class 1 is Hit and class 0 every other trial; ``contrast`` restricts class 0 to the
    named outcomes. Results: effects, change_scalars, change_stats, change_tests,
    baseline_scalars, baseline_stats, baseline_tests.
    """
    grid = grid or bin_grid((-0.5, 1.0), 0.02)
    bin_us = grid.bounds[1] - grid.bounds[0]
    units = align.good_units(tables["units"], tables["sessions"], use_good_only=use_good_only)
    points = tables["spikes"].join(units.select("session_id", "unit_id"), ["session_id", "unit_id"], "left_semi")
    events = tables["channel_events"]

    change = trials.event_triggers(tables["trials"], events, "Change_ON")
    used = trials.within_common_length(tables["trials"], events, "Change_ON")
    labelled = used.select("session_id", "trial_idx", "outcome", (
        F.coalesce(F.col("outcome") == "Hit", F.lit(False))).cast("int").alias("y"))
    pop = cut_lineage(
        align.trials_matrix(points, change, grid)
        .select("session_id", F.col("trigger_id").alias("trial_idx"), "bin", "unit_id", F.col("rate_hz").alias("rate"))
        .join(used.select("session_id", "trial_idx"), ["session_id", "trial_idx"], "left_semi"))
    fit = labelled
    if contrast is not None:
        fit = labelled.where((F.col("y") == 1) | F.col("outcome").isin(*contrast))
    folds = cut_lineage(directions.stratified_folds(fit.select("session_id", "trial_idx", "y"), 5))
    solved = cut_lineage(directions.solve_time_resolved(pop, folds, grid.n_bins, "shrinkage", reg, n_permutations))
    proj = directions.held_out_projections(pop, folds, solved)
    scalars = population.trial_scalar(proj, labelled.drop("y"), population.selected_bins(grid)).withColumn(
        "grp", F.when(F.col("outcome").isin("Hit", "Miss"), F.col("outcome")))
    scalars = cut_lineage(scalars)

    windows = cut_lineage(trials.baseline_windows(tables["trials"], events, bin_us, strict=strict_baseline))
    vectors = cut_lineage(trials.baseline_unit_means(points, windows, units, bin_us))
    usable = windows.where("n_end_bins > 0")
    base_labels = usable.where(trials.is_false_alarm() | (F.col("outcome") == "Hit")).select(
        "session_id", "trial_idx", (F.col("outcome") == "Hit").cast("int").alias("y"))
    cd = directions.fit_direction(vectors, base_labels, "shrinkage", reg)
    fa_latency = F.try_element_at("reactiontimes", F.lit("FA"))
    base = usable.select("session_id", "trial_idx", "outcome", trials.outcome_group(fa_latency).alias("grp")).join(
        population.project(vectors, cd, ["trial_idx"]).withColumnRenamed("proj", "value"),
        ["session_id", "trial_idx"], "left")
    base = cut_lineage(base)
    return {
        "effects": directions.effects(solved), "change_scalars": scalars,
        "change_stats": population.group_stats(scalars), "change_tests": population.welch_t(scalars),
        "baseline_scalars": base, "baseline_stats": population.group_stats(base),
        "baseline_tests": population.welch_t(base),
    }


def response_tagging(spikes: DataFrame, laser: DataFrame, shapes: DataFrame | None = None, n_iters: int = 300,
                     split_blocks: bool = False, gap_threshold_s: float = 2.0, **params) -> dict[str, DataFrame]:
    """Pulses and the unit table from raw spikes (session, unit, t) and laser rise, fall, duration.

    With ``split_blocks`` every block of pulses has a unit table of its own, told apart by
    ``block_id``.
    """
    rates = cut_lineage(tagging.sample_rates(laser))  # one row per session
    pulses = tagging.pulse_table(laser, rates=rates)
    points = tagging.spikes_in_ticks(spikes, rates, cut_lineage(tagging.spike_time_units(spikes)))
    units = points.select("session_id", "unit_id").distinct()
    onsets = pulses.select("session_id", F.col("event_idx").alias("trigger_id"), "t_us")
    out = {"pulses": pulses, "units": tagging.units_table(points, onsets, units, shapes, n_iters, **params)}
    if split_blocks:
        blocks = cut_lineage(tagging.pulse_blocks(pulses, gap_threshold_s))
        out["pulses"] = blocks
        per = [
            tagging.units_table(
                points, blocks.where(F.col("block_id") == b).select(
                    "session_id", F.col("event_idx").alias("trigger_id"), "t_us"), units, shapes, n_iters, **params,
            ).withColumn("block_id", F.lit(b)).join(
                blocks.where(F.col("block_id") == b).select("session_id").distinct(), "session_id", "left_semi")
            for b in (0, 1)
        ]
        out["block_units"] = per[0].unionByName(per[1])
    return out
