"""Response tagging: pulses, per-pulse responses, unit metrics, permutation test, unit table."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trigflow.functions.scalars import response_class, poisson_upper_tail, waveform_class
from trigflow.functions.ticks import seconds_to_ticks
from trigflow.operators.align import trigger_counts, window_counts
from trigflow.operators.running import exact_percentiles
from trigflow.operators.units import session_durations
from trigflow.session import cut_lineage

UNIT = ["session_id", "unit_id"]
EVOKED_US = (0, 10_000)  # closed
BASELINE_US = (-100_000, 0)  # half-open
DEFAULT_RATE = 30_000.0
CELL_POINTS, MOST_CELLS = 200_000, 1024  # points of a session's time cell, and cells of a session
DRAWN_PULSES = 1_000  # pulses whose draws are packed together


def sample_rates(laser: DataFrame, prefer: float | None = None) -> DataFrame:
    """Per session: ``sample_rate`` and whether rises are sample numbers (``in_samples``).

    Rises with a median above 1 next to durations below a second give the rate as
    median(fall - rise) / median(duration); above 10 they are read as samples.
    """
    long = laser.select(
        "session_id",
        F.explode(F.array(
            F.struct(F.lit("rise").alias("what"), F.col("rise").alias("v")),
            F.struct(F.lit("dur").alias("what"), F.col("duration").alias("v")),
            F.struct(F.lit("len").alias("what"), (F.col("fall") - F.col("rise")).alias("v")),
        )).alias("s"),
    ).select("session_id", "s.*")
    med = exact_percentiles(long, ["session_id", "what"], "v", {"med": 0.5}).groupBy("session_id").agg(*[
        F.max(F.when(F.col("what") == w, F.col("med"))).alias(w) for w in ("rise", "dur", "len")])
    short = F.col("dur") < 1.0
    rate = F.when((F.col("rise") > 1.0) & short & (F.col("dur") > 0), F.col("len") / F.col("dur")).otherwise(
        DEFAULT_RATE)
    return med.select(
        "session_id", (F.lit(float(prefer)) if prefer else rate).alias("sample_rate"),
        ((F.col("rise") > 10) & short).alias("in_samples"))


def pulse_table(laser: DataFrame, prefer: float | None = None, unit: str = "auto",
                rates: DataFrame | None = None) -> DataFrame:
    """Onsets and offsets in samples and in seconds from raw rise, fall and duration.

    ``unit`` may be forced to ``samples`` or ``seconds``; ``rates`` are the sample rates
    where they are already known.
    """
    t = laser.join(sample_rates(laser, prefer) if rates is None else rates, "session_id")
    in_samples = {"auto": F.col("in_samples"), "samples": F.lit(True), "seconds": F.lit(False)}[unit]
    sr = F.col("sample_rate")

    def both(name: str) -> tuple[Column, Column]:
        c = F.col(name)
        return F.when(in_samples, c).otherwise(c * sr), F.when(in_samples, c / sr).otherwise(c)

    on_n, on_s = both("rise")
    off_n, off_s = both("fall")
    return t.select(
        "session_id", "event_idx", on_n.alias("onset_samples"), off_n.alias("offset_samples"),
        on_s.alias("onset_s"), off_s.alias("offset_s"), F.col("duration").alias("duration_s"),
        seconds_to_ticks(on_s).alias("t_us"), "sample_rate")


def pulse_blocks(pulses: DataFrame, gap_threshold_s: float = 2.0) -> DataFrame:
    """Adds ``block_id``: 1002 pulses are 501 + 501; otherwise one split at the first
    largest gap when it exceeds the threshold.

    The previous pulse is found by its position, an equi-join rather than a sort.
    """
    prev = pulses.select("session_id", (F.col("event_idx") + 1).alias("event_idx"),
                         F.col("onset_s").alias("prev_s"))
    gaps = pulses.join(prev, ["session_id", "event_idx"], "left").withColumn(
        "gap", F.col("onset_s") - F.col("prev_s"))
    per = gaps.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.when(F.col("gap").isNotNull(), F.struct("gap", (-F.col("event_idx")).alias("neg")))).alias("g"))
    start = F.when(F.col("n") == 1002, F.lit(501)).when(F.col("g.gap") > gap_threshold_s, -F.col("g.neg"))
    return pulses.join(per, "session_id").withColumn(
        "block_id", F.coalesce((F.col("event_idx") >= start).cast("int"), F.lit(0))).drop("n", "g")


def spike_time_units(spikes: DataFrame) -> DataFrame:
    """Per session: whether times are sample numbers, that is whether their median exceeds 1000.

    That follows from counts on either side, and from the two values next to 1000 when
    they split evenly, so nothing is sorted.
    """
    low = F.col("t") <= 1000
    per = spikes.groupBy("session_id").agg(
        F.count_if(low).alias("n_low"), F.count_if(~low).alias("n_high"),
        F.max(F.when(low, F.col("t"))).alias("below"), F.min(F.when(~low, F.col("t"))).alias("above"))
    over = F.when(F.col("n_high") != F.col("n_low"), F.col("n_high") > F.col("n_low")).otherwise(
        (F.col("below") + F.col("above")) / 2 > 1000)
    return per.select("session_id", over.alias("in_samples"))


def spikes_in_ticks(spikes: DataFrame, rates: DataFrame, time_units: DataFrame | None = None) -> DataFrame:
    """Spike times as ticks, from samples or seconds session by session."""
    per = spike_time_units(spikes) if time_units is None else time_units
    t = F.when(F.col("in_samples"), F.col("t") / F.col("sample_rate")).otherwise(F.col("t"))
    return (
        spikes.join(per, "session_id").join(rates.select("session_id", "sample_rate"), "session_id", "left")
        .select("session_id", "unit_id", seconds_to_ticks(t).alias("t_us"))
    )


def pulse_responses(points: DataFrame, pulses: DataFrame, evoked: tuple[int, int] = EVOKED_US,
                    baseline: tuple[int, int] = BASELINE_US, method: str = "pairs") -> DataFrame:
    """Sparse (session, unit, trigger): evoked and baseline counts, first evoked time."""
    ids = ["trigger_id"]
    ev = window_counts(points, pulses, evoked[0], evoked[1], ids, method=method).select(
        *UNIT, *ids, F.col("n").alias("n_evoked"), "first_us", F.lit(0).cast("bigint").alias("n_baseline"))
    base = window_counts(points, pulses, baseline[0], baseline[1] - 1, ids, method=method).select(
        *UNIT, *ids, F.lit(0).cast("bigint").alias("n_evoked"), F.lit(None).cast("bigint").alias("first_us"),
        F.col("n").alias("n_baseline"))
    return ev.unionByName(base)


def unit_metrics(points: DataFrame, pulses: DataFrame, units: DataFrame, evoked: tuple[int, int] = EVOKED_US,
                 baseline: tuple[int, int] = BASELINE_US, method: str = "pairs") -> DataFrame:
    """Reliability, latency, evoked and baseline statistics per unit; silent pulses count as zero.

    A (unit, pulse) gives at most one evoked and one baseline row, so sums over rows are
    sums over pulses.
    """
    return _metrics(pulse_responses(points, pulses, evoked, baseline, method), pulses, units, baseline)


def _metrics(responses: DataFrame, pulses: DataFrame, units: DataFrame, baseline: tuple[int, int]) -> DataFrame:
    r = responses.groupBy(*UNIT).agg(
        F.count_if(F.col("n_evoked") > 0).alias("hits"), F.avg("first_us").alias("lat"),
        F.sum("n_evoked").alias("ev"), F.sum(F.col("n_evoked") * F.col("n_evoked")).alias("ev2"),
        F.sum("n_baseline").alias("bl"))
    n = F.coalesce("n_trials", F.lit(0)).alias("n_pulses")

    def per_pulse(c: str) -> Column:
        return F.coalesce(F.try_divide(F.coalesce(c, F.lit(0)), F.col("n_pulses")), F.lit(0.0))

    seconds = (baseline[1] - baseline[0]) / 1e6
    t = (
        units.select(*UNIT).join(trigger_counts(pulses), "session_id", "left")
        .join(r, UNIT, "left").withColumn("n_pulses", n)
    )
    var = per_pulse("ev2") - per_pulse("ev") * per_pulse("ev")
    return t.select(
        *UNIT, "n_pulses", (F.col("lat") / 1000.0).alias("mean_latency_ms"),
        per_pulse("hits").alias("reliability"), per_pulse("ev").alias("evoked_count_mean"),
        F.sqrt(F.greatest(var, F.lit(0.0))).alias("evoked_count_std"),
        per_pulse("bl").alias("baseline_count_mean"),
        (per_pulse("bl") / seconds).alias("baseline_rate_hz"),
        F.coalesce("ev", F.lit(0)).alias("total_evoked"))


def latency_percentiles(points: DataFrame, pulses: DataFrame, evoked: tuple[int, int] = EVOKED_US,
                        method: str = "pairs") -> DataFrame:
    """10th and 50th percentile of first-point latencies in ms, linear interpolation."""
    return _percentiles(window_counts(points, pulses, evoked[0], evoked[1], ["trigger_id"], method=method), evoked)


def _percentiles(first: DataFrame, evoked: tuple[int, int]) -> DataFrame:
    bits = max(0, int(evoked[1] - evoked[0]).bit_length() - 12)
    p = exact_percentiles(first, UNIT, "first_us", {"p10": 0.1, "p50": 0.5}, F.shiftright("first_us", bits))
    return p.select(*UNIT, (F.col("p10") / 1000.0).alias("latency_p10_ms"),
                    (F.col("p50") / 1000.0).alias("latency_p50_ms"))


def hash60(*cols: Column) -> Column:
    """60 hash bits as a non-negative BIGINT, the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 15), 16, 10).cast("bigint")


def draws_of(session: str | None, n_iters: int, pulse: str | None) -> np.ndarray:
    """:func:`hash60` of (session, draw, pulse) for each draw."""
    head = "" if session is None else f"{session}:"
    tail = "" if pulse is None else f":{pulse}"
    digests = b"".join([hashlib.md5(f"{head}{i}{tail}".encode()).digest() for i in range(n_iters)])
    return (np.frombuffer(digests, ">u8")[::2] >> np.uint64(4)).astype(np.int64)


def null_onsets(points: DataFrame, pulses: DataFrame, n_iters: int = 300,
                evoked: tuple[int, int] = EVOKED_US) -> DataFrame:
    """Random onsets (session, iter, trigger_id, t_us), as many per draw as there are pulses.

    They lie at least 0.1 s, or one window, inside the recording and are shared by all
    units of a session. A recording too short for that has none.
    """
    margin = max(100_000, evoked[1] - evoked[0])
    span = F.col("last_us") - F.col("first_us") - 2 * margin
    usable = session_durations(points).where(span > 0).select(
        "session_id", (F.col("first_us") + margin).alias("start"), span.alias("span"))
    return (
        pulses.select("session_id", "trigger_id").join(usable, "session_id")
        .withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(n_iters - 1))))
        .select("session_id", "iter", "trigger_id",
                (F.col("start") + hash60(F.col("session_id"), F.col("iter"), F.col("trigger_id"))
                 % F.col("span")).alias("t_us"))
    )


def permutation_p(points: DataFrame, pulses: DataFrame, units: DataFrame, n_iters: int = 300,
                  evoked: tuple[int, int] = EVOKED_US, method: str = "pairs") -> DataFrame:
    """Share of draws whose evoked count reaches the observed one (no +1).

    A unit with no evoked point has p = 1, so draws without points never need a row.
    """
    observed = window_counts(points, pulses, *evoked, ["trigger_id"], method=method).groupBy(*UNIT).agg(
        F.sum("n").alias("observed"))
    return _reached(observed, points, pulses, units, n_iters, evoked)


def _cells(points: DataFrame) -> DataFrame:
    """(session_id, bounds): times that cut a session's points into cells of about CELL_POINTS; none for a small one."""
    probs = [i / MOST_CELLS for i in range(1, MOST_CELLS)]
    step = F.greatest(F.lit(1), F.floor(MOST_CELLS / F.ceil(F.col("n") / CELL_POINTS)))
    cuts = points.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("t_us", probs, 10_000).alias("cuts"))
    return cuts.select("session_id", F.when(F.col("n") > CELL_POINTS, F.array_distinct(
        F.filter("cuts", lambda x, i: (i + 1) % step == 0))).otherwise(F.array().cast("array<bigint>")).alias("bounds"))


def drawn_counts(points: DataFrame, pulses: DataFrame, n_iters: int = 300, evoked: tuple[int, int] = EVOKED_US) -> DataFrame:
    """(session_id, unit_id, counts): evoked points of each draw of :func:`null_onsets`, as an array over the draws.

    Sessions are cut into time cells. The onsets of all draws are packed by cell, the times of a unit
    in a cell are one sorted array, and all draws are counted where both meet: two searches a draw, no
    row per draw and pulse. A window that crosses cells is counted in each, and the counts add up.
    Units without points have no row, nor have units of a session too short for a draw.
    """
    margin = max(100_000, evoked[1] - evoked[0])
    span = F.col("last_us") - F.col("first_us") - 2 * margin
    bounds = cut_lineage(_cells(points))
    usable = session_durations(points).where(span > 0).select(
        "session_id", (F.col("first_us") + margin).alias("start"), span.alias("span")).join(bounds, "session_id")
    kinds = dict(points.dtypes)
    cell = F.size(F.filter("bounds", lambda x: x <= F.col("t_us")))
    times = (points.join(bounds, "session_id").groupBy(*UNIT, cell.alias("cell"))
             .agg(F.sort_array(F.collect_list("t_us")).alias("times")))

    def draws(batches):
        for frame in batches:
            for at in range(0, len(frame), DRAWN_PULSES):
                met: dict[tuple, list] = {}
                for r in frame.iloc[at:at + DRAWN_PULSES].itertuples(index=False):
                    onset = r.start + draws_of(r.said, n_iters, r.pulse) % r.span
                    ends = [np.searchsorted(r.bounds, onset + end, side="right") for end in evoked]
                    for c in range(int(ends[0].min()), int(ends[1].max()) + 1):
                        here = np.flatnonzero((ends[0] <= c) & (c <= ends[1]))
                        if len(here):
                            met.setdefault((r.session_id, c), []).append((here, onset[here]))
                yield pd.DataFrame({
                    "session_id": [k[0] for k in met], "cell": [k[1] for k in met],
                    "iters": [np.concatenate([x[0] for x in v]) for v in met.values()],
                    "onsets": [np.concatenate([x[1] for x in v]) for v in met.values()]})

    # Few bytes but much work: the number is given, so that adaptive execution does not merge the parts.
    spark = points.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = (pulses.join(usable, "session_id").repartition(parts)
              .select("session_id", F.col("session_id").cast("string").alias("said"), F.col("trigger_id").cast("string").alias("pulse"),
                      "start", "span", "bounds")
              .mapInPandas(draws, f"session_id {kinds['session_id']}, cell int, iters array<int>, onsets array<bigint>"))

    def counted(batches):
        met, iters, onsets = None, [], []
        for batch in batches:
            keys = list(zip(batch.column("session_id").to_pylist(), batch.column("cell").to_pylist()))
            columns = [batch.column(c) for c in ("times", "iters", "onsets")]
            owner, out = [], []
            for i, key in enumerate(keys):
                if key != met:
                    met, iters, onsets = key, [], []
                if not columns[0][i].is_valid:  # draws come before the units of their cell
                    iters.append(columns[1][i].values.to_numpy())
                    onsets.append(columns[2][i].values.to_numpy())
                elif iters:
                    if len(iters) > 1:
                        iters, onsets = [np.concatenate(iters)], [np.concatenate(onsets)]
                    t = columns[0][i].values.to_numpy()
                    n = np.searchsorted(t, onsets[0] + evoked[1], side="right") - np.searchsorted(t, onsets[0] + evoked[0])
                    owner.append(i)
                    out.append(np.bincount(iters[0], n, n_iters).astype(np.int64))
            take = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("session_id").take(take), batch.column("unit_id").take(take), pa.array(out, pa.list_(pa.int64()))],
                names=[*UNIT, "counts"])

    rows = times.unionByName(packed, allowMissingColumns=True)
    each = rows.repartition(parts, "session_id", "cell").sortWithinPartitions("session_id", "cell", F.col("times").isNotNull()).mapInArrow(
        counted, f"session_id {kinds['session_id']}, unit_id {kinds['unit_id']}, counts array<bigint>")
    none = F.array_repeat(F.lit(0).cast("bigint"), n_iters)
    added = F.aggregate(F.collect_list("counts"), none, lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    return each.groupBy(*UNIT).agg(added.alias("counts"))  # as many arrays as a session has cells


def _reached(observed: DataFrame, points: DataFrame, pulses: DataFrame, units: DataFrame, n_iters: int,
             evoked: tuple[int, int]) -> DataFrame:
    drawn = drawn_counts(points.select(*UNIT, "t_us"), pulses, n_iters, evoked)
    reached = F.size(F.filter("counts", lambda c: c >= F.col("observed")))
    margin = max(100_000, evoked[1] - evoked[0])
    long_enough = session_durations(points).select(
        "session_id", (F.col("last_us") - F.col("first_us") > 2 * margin).alias("long_enough"))
    p = F.when(F.col("observed").isNull() | ~F.coalesce("long_enough", F.lit(False)), 1.0).otherwise(
        F.coalesce(F.when(F.col("counts").isNotNull(), reached), F.lit(0)) / F.lit(float(n_iters)))
    return (
        units.select(*UNIT).join(observed, UNIT, "left").join(drawn, UNIT, "left")
        .join(long_enough, "session_id", "left")
        .select(*UNIT, F.coalesce("observed", F.lit(0)).alias("observed"), p.alias("p_permutation"))
    )


def units_table(points: DataFrame, pulses: DataFrame, units: DataFrame, shapes: DataFrame | None = None,
                n_iters: int = 300, max_latency_ms: float = 6.0, min_reliability: float = 0.5,
                evoked: tuple[int, int] = EVOKED_US, baseline: tuple[int, int] = BASELINE_US,
                method: str = "pairs") -> DataFrame:
    """Everything known about a unit's response, one row per unit.

    ``shapes(session_id, unit_id, peak_width_us, peak_valley_us)`` is optional; its columns
    are NULL for units without a waveform.
    """
    window_s = (evoked[1] - evoked[0]) / 1e6
    # One result feeds metrics, percentiles and the observed counts.
    responses = cut_lineage(pulse_responses(points, pulses, evoked, baseline, method))
    m = _metrics(responses, pulses, units, baseline)
    observed = responses.where("n_evoked > 0").groupBy(*UNIT).agg(F.sum("n_evoked").alias("observed"))
    lam = F.col("baseline_rate_hz") * F.col("n_pulses") * window_s
    p_poisson = F.when(F.col("n_pulses") == 0, 1.0).otherwise(poisson_upper_tail(F.col("total_evoked"), lam))
    t = (
        m.withColumn("p_poisson", p_poisson)
        .join(_percentiles(responses.where("first_us is not null"), evoked), UNIT, "left")
        .join(_reached(observed, points, pulses, units, n_iters, evoked).drop("observed"), UNIT, "left")
        .withColumn("classification",
                    response_class(F.col("mean_latency_ms"), F.col("reliability"), max_latency_ms, min_reliability))
    )
    rate = points.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n_spikes")).join(
        session_durations(points), "session_id").select(
        *UNIT, (F.col("n_spikes") / F.greatest("duration_s", F.lit(1.0))).alias("mean_fr_hz"))
    if shapes is None:
        none = F.lit(None)
        return t.withColumns({"wf_peak_width_us": none.cast("double"), "wf_peak_valley_us": none.cast("double"),
                              "wf_mean_fr_hz": none.cast("double"), "wf_class": none.cast("string")})
    has = F.col("peak_width_us").isNotNull()
    return (
        t.join(shapes.select(*UNIT, "peak_width_us", "peak_valley_us"), UNIT, "left").join(rate, UNIT, "left")
        .withColumn("wf_mean_fr_hz", F.when(has, F.coalesce("mean_fr_hz", F.lit(0.0))))
        .withColumn("wf_class", F.when(has, waveform_class(
            F.col("peak_width_us"), F.col("peak_valley_us"), F.col("wf_mean_fr_hz"))))
        .withColumnsRenamed({"peak_width_us": "wf_peak_width_us", "peak_valley_us": "wf_peak_valley_us"})
        .drop("mean_fr_hz")
    )


def top_units(table: DataFrame, n: int = 10, by: str = "reliability") -> DataFrame:
    """The n units of each session with the highest value, lower unit first on ties."""
    w = Window.partitionBy("session_id").orderBy(F.col(by).desc(), "unit_id")
    return table.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def tagged_or_top(table: DataFrame, n: int = 10) -> DataFrame:
    """Units classified as responding together with the top n."""
    tagged = table.where("classification = 'opto'").select(*UNIT)
    return tagged.union(top_units(table, n).select(*UNIT)).distinct()
