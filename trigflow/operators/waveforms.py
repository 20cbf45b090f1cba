"""Templates and waveforms in long form: (session, …, channel, sample, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigflow.operators.running import exact_percentiles

UNIT = ["session_id", "unit_id"]


def unit_templates(spike_templates: DataFrame) -> DataFrame:
    """Spikes per (session, unit, template); a template a unit uses appears once."""
    return spike_templates.groupBy(*UNIT, "template_id").agg(F.count(F.lit(1)).alias("n_spikes"))


def mean_templates(spike_templates: DataFrame, templates: DataFrame) -> DataFrame:
    """Unweighted mean of the distinct templates of a unit; ids without a template drop out."""
    return (
        unit_templates(spike_templates).drop("n_spikes")
        .join(templates, ["session_id", "template_id"])
        .groupBy(*UNIT, "channel", "sample").agg(F.avg("value").alias("value"))
    )


def template_summary(sessions: DataFrame, units: DataFrame, spikes: DataFrame | None = None,
                     spike_templates: DataFrame | None = None, templates: DataFrame | None = None) -> DataFrame:
    """Per unit: spikes, amplitude (largest absolute value), whether sorter output was found.

    What is present decides, session by session:
    templates with spike templates: spikes and mean waveform per unit; units with no
    cluster assignment (``spikes`` has none for the session) get 0 spikes and no waveform;
    templates alone: assigned to the units by position, extra ones to unit -1;
    spikes alone: counts; nothing: ``present`` is false.
    """
    s = sessions.select("session_id")
    unit_type = dict(units.dtypes)["unit_id"]

    def flag(df: DataFrame | None, name: str) -> DataFrame:
        if df is None:
            return s.select("session_id", F.lit(False).alias(name))
        return s.join(df.select("session_id", F.lit(True).alias(name)).distinct(), "session_id", "left").select(
            "session_id", F.coalesce(name, F.lit(False)).alias(name))

    have = flag(templates, "has_t").join(flag(spike_templates, "has_st"), "session_id").join(
        flag(spikes, "has_sp"), "session_id")
    both = F.col("has_t") & F.col("has_st")
    only_t = F.col("has_t") & ~F.col("has_st")
    amp = f"struct<session_id:{dict(sessions.dtypes)['session_id']},unit_id:{unit_type},mean_amp:double>"
    empty = sessions.sparkSession.createDataFrame([], amp)
    counts = (spikes.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n"))
              if spikes is not None else empty.select(*UNIT, F.lit(0).cast("bigint").alias("n")))
    amps = empty
    if templates is not None and spike_templates is not None and spikes is not None:
        amps = mean_templates(spike_templates, templates).groupBy(*UNIT).agg(
            F.max(F.abs("value")).alias("mean_amp"))
    clustered = counts.select(*UNIT)
    listed = units.select(*UNIT).join(flag(spikes, "has_sp").where("not has_sp"), "session_id").select(*UNIT)
    ids = clustered.union(listed).distinct()
    general = (
        ids.join(have.where(~only_t), "session_id").join(counts, UNIT, "left").join(amps, UNIT, "left")
        .select(*UNIT, F.coalesce("n", F.lit(0)).alias("n_spikes"),
                F.when(both, F.col("mean_amp")).alias("mean_amp"),
                (both | F.col("has_sp")).alias("present"))
    )
    if templates is None:
        return general
    by_position = positional_templates(units, templates.join(have.where(only_t).select("session_id"),
                                                             "session_id", "left_semi"), unit_type)
    return general.unionByName(by_position)


def positional_templates(units: DataFrame, templates: DataFrame, unit_type: str) -> DataFrame:
    """Template i goes to the i-th unit of the session; templates past the last to unit -1."""
    from trigflow.operators.population import dense_unit_index

    amp = templates.groupBy("session_id", "template_id").agg(F.max(F.abs("value")).alias("mean_amp"))
    index = dense_unit_index(units).withColumnRenamed("u", "template_id")
    return amp.join(index, ["session_id", "template_id"], "left").select(
        "session_id", F.coalesce(F.col("unit_id"), F.lit(-1).cast(unit_type)).alias("unit_id"),
        F.lit(0).cast("bigint").alias("n_spikes"), "mean_amp", F.lit(True).alias("present"))


def best_channel(waveforms: DataFrame, by: list[str] = UNIT) -> DataFrame:
    """Channel with the largest range, the first of equals."""
    r = waveforms.groupBy(*by, "channel").agg((F.max("value") - F.min("value")).alias("range"))
    return r.groupBy(*by).agg(F.max_by("channel", F.struct("range", -F.col("channel"))).alias("channel"))


def waveform_shape(waveforms: DataFrame, sample_rate: float = 30_000.0, by: list[str] = UNIT) -> DataFrame:
    """Peak and valley on the best channel, width at half the peak and peak-valley distance in us.

    The half crossings are the nearest samples at or below half the peak on each side, or
    the ends of the waveform; a peak of zero or less has width 0.
    """
    w = waveforms.join(best_channel(waveforms, by), [*by, "channel"])
    peak = w.groupBy(*by).agg(
        F.max_by(F.struct("sample", "value"), F.struct("value", -F.col("sample"))).alias("p"),
        F.min_by("sample", F.struct("value", "sample")).alias("valley_idx"),
        F.max("sample").alias("last"))
    t = w.join(peak, by)
    at, low = F.col("p.sample"), F.col("value") <= F.col("p.value") / 2
    ends = t.groupBy(*by).agg(
        F.first("p.sample").alias("peak_idx"), F.first("p.value").alias("peak_value"),
        F.first("valley_idx").alias("valley_idx"),
        F.coalesce(F.max(F.when((F.col("sample") < at) & low, F.col("sample"))), F.lit(0)).alias("left"),
        F.coalesce(F.min(F.when((F.col("sample") > at) & low, F.col("sample"))), F.first("last")).alias("right"))
    us = 1e6 / sample_rate
    width = F.when(F.col("peak_value") <= 0, F.lit(0)).otherwise(F.col("right") - F.col("left"))
    return ends.select(
        *by, (width * us).alias("peak_width_us"),
        (F.abs(F.col("valley_idx") - F.col("peak_idx")) * us).alias("peak_valley_us"), "peak_idx", "valley_idx")


PERCENTILES = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def exemplars(table: DataFrame, value: str, keys: list[str] = ["session_id"]) -> DataFrame:
    """For each of five percentiles of a measure, the unit nearest to it (lowest id on ties)."""
    known = table.where(F.col(value).isNotNull() & ~F.isnan(value))
    pct = exact_percentiles(known, keys, value, PERCENTILES)
    targets = pct.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(p).alias("pct"), F.col(p).alias("target")) for p in PERCENTILES])).alias("s")).select(
        *keys, "s.*")
    return known.join(targets, keys).groupBy(*keys, "pct", "target").agg(
        F.min_by("unit_id", F.struct(F.abs(F.col(value) - F.col("target")), F.col("unit_id"))).alias("unit_id"))
