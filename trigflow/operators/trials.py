"""Trial tables: event times from outcomes, baseline ends, outcome groups.

``trials(session_id, trial_idx, outcome, reactiontimes, change_time, …)`` and
``channels(session_id, channel, event_idx, rise_us)`` are tied by position only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trigflow.functions.ticks import seconds_to_ticks
from trigflow.operators.running import dealt
from trigflow.session import cut_lineage

CHANNEL_EVENTS = ("Baseline_ON", "Change_ON")


def with_rises(trials: DataFrame, channels: DataFrame) -> DataFrame:
    """Adds ``baseline_us`` and ``change_us``: the rise at the trial's own position, else NULL.

    Both channels are folded into one row per position first, so trials are shuffled once.
    """
    rises = channels.where(F.col("channel").isin(*CHANNEL_EVENTS)).groupBy(
        "session_id", F.col("event_idx").alias("trial_idx")
    ).agg(
        F.max(F.when(F.col("channel") == "Baseline_ON", F.col("rise_us"))).alias("baseline_us"),
        F.max(F.when(F.col("channel") == "Change_ON", F.col("rise_us"))).alias("change_us"),
    )
    return trials.join(rises, ["session_id", "trial_idx"], "left")


def latency_us(key: str) -> Column:
    value = F.try_element_at("reactiontimes", F.lit(key))
    return seconds_to_ticks(F.nanvl(value, F.lit(None).cast("double")))


def event_time(shift_fa_hit_ms: float = 200.0) -> Column:
    """Absolute reaction time of a trial, in ticks; needs the baseline rise for every outcome."""
    shift = round(shift_fa_hit_ms * 1000)
    outcome = F.col("outcome")
    time = (
        F.when(outcome == "Hit", F.col("change_us") + latency_us("RT") - shift)
        .when(outcome == "Miss", F.col("change_us") + latency_us("Miss"))
        .when(outcome == "FA", F.col("baseline_us") + latency_us("FA") - shift)
        .when(outcome == "abort", F.col("baseline_us") + latency_us("abort"))
    )
    return F.when(F.col("baseline_us").isNotNull(), time)


def event_triggers(trials: DataFrame, channels: DataFrame, event: str,
                   shift_fa_hit_ms: float = 200.0) -> DataFrame:
    """Triggers of one event name as (session_id, trigger_id, t_us).

    A channel name gives all its rises, NULL ones included; any other name is an
    outcome and gives the trials of that outcome whose event time is known.
    """
    if event in CHANNEL_EVENTS:
        return channels.where(F.col("channel") == event).select(
            "session_id", F.col("event_idx").alias("trigger_id"), F.col("rise_us").alias("t_us"))
    return (
        with_rises(trials.where(F.col("outcome") == event), channels)
        .select("session_id", F.col("trial_idx").alias("trigger_id"), event_time(shift_fa_hit_ms).alias("t_us"))
        .where(F.col("t_us").isNotNull())
    )


def within_common_length(trials: DataFrame, channels: DataFrame, channel: str) -> DataFrame:
    """Trials up to the shorter of the trial list and the channel."""
    n_events = channels.where(F.col("channel") == channel).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_events"))
    return (
        trials.join(n_events, "session_id", "left")
        .where(F.col("trial_idx") < F.coalesce("n_events", F.lit(0)))
        .drop("n_events")
    )


def is_false_alarm() -> Column:
    return F.col("outcome").isin("FA", "FalseAlarm")


def outcome_group(fa_latency: Column, split_s: float = 3.0) -> Column:
    """Disjoint group label; NULL for an outcome of no group or a false alarm without latency."""
    latency = F.nanvl(fa_latency, F.lit(None).cast("double"))
    return (
        F.when(F.col("outcome") == "Hit", "Hit")
        .when(is_false_alarm() & (latency > split_s), "FA>3s")
        .when(is_false_alarm() & (latency <= split_s), "FA<=3s")
        .when(F.lower("outcome").contains("abort"), "Abort")
        .when(F.col("outcome") == "Miss", "Miss")
    )


def baseline_end(shift_fa_hit_ms: float = 200.0) -> Column:
    """End of a trial's baseline in ticks: the change, or one second before the reaction.

    ``FalseAlarm`` is not ``FA`` here and falls to the change time.
    """
    early = F.col("outcome").isin("FA", "abort")
    return F.when(early, event_time(shift_fa_hit_ms) - 1_000_000).otherwise(F.col("change_us"))


def baseline_windows(trials: DataFrame, channels: DataFrame, bin_us: int, skip_us: int = 1_000_000,
                     strict: bool = False) -> DataFrame:
    """Per trial: ``usable_us`` (baseline length after the first second), ``n_end_bins``, ``valid``.

    ``n_end_bins`` is ``floor(usable / bin)`` held between 1 and the bins of the longest
    baseline of the session. A non-positive length still gives one bin, unless ``strict``.
    """
    rises = dealt(channels.where(F.col("channel").isin(*CHANNEL_EVENTS)), "session_id", "event_idx")
    t = with_rises(within_common_length(trials, channels, "Baseline_ON"), rises)
    usable = baseline_end() - F.col("baseline_us") - skip_us
    t = t.withColumn("usable_us", usable)
    longest = t.groupBy("session_id").agg(F.max("usable_us").alias("longest_us"))
    n_bins = F.ceil(F.col("longest_us") / bin_us)
    bins = F.least(F.greatest(F.floor(F.col("usable_us") / bin_us), F.lit(1)), F.greatest(n_bins, F.lit(1)))
    keep = F.col("usable_us").isNotNull()
    if strict:
        keep = keep & (F.col("usable_us") > bin_us)
    return (
        t.join(longest, "session_id", "left")
        .withColumn("n_end_bins", F.when(keep, bins).otherwise(0).cast("int"))
        .withColumn("valid", F.coalesce(F.col("usable_us") > bin_us, F.lit(False)))
        .drop("longest_us")
    )


def baseline_unit_means(points: DataFrame, windows: DataFrame, units: DataFrame, bin_us: int,
                        skip_us: int = 1_000_000) -> DataFrame:
    """Mean rate per (session, trial, unit) over the trial's own first ``n_end_bins`` bins.

    The mean over the bins of counts/bin is the count in the whole span over its length,
    so one count per trial and unit suffices. Rows exist for every unit of a usable trial; they
    leave an array of counts per trial, which no join of trials and units has to fill up.
    """
    from trigflow.operators.align import span_counts
    from trigflow.operators.population import BROADCAST_ROWS, dense_unit_index

    spans = windows.where("n_end_bins > 0").select(
        "session_id", F.col("trial_idx").alias("trigger_id"), F.col("n_end_bins"),
        (F.col("baseline_us") + skip_us).alias("lo_us"),
        (F.col("baseline_us") + skip_us + F.col("n_end_bins") * bin_us - 1).alias("hi_us"))
    index = cut_lineage(dense_unit_index(units))
    ids = F.array_sort(F.collect_list(F.struct("u", "unit_id")))
    listed = index.groupBy("session_id").agg(ids.alias("ids")).select("session_id", F.col("ids.unit_id").alias("ids"))
    listed = F.broadcast(listed) if index.count() <= BROADCAST_ROWS else listed
    seconds = F.col("n_end_bins") * F.lit(bin_us / 1e6)
    return (
        span_counts(points, spans, index).join(listed, "session_id")
        .select("session_id", F.col("trigger_id").alias("trial_idx"), "n_end_bins", "counts", F.posexplode("ids").alias("u", "unit_id"))
        .select("session_id", "trial_idx", "unit_id", "n_end_bins",
                (F.coalesce(F.get("counts", F.col("u")), F.lit(0)) / seconds).alias("rate"))
    )
