"""Alignment of point events to trigger events: range join, PETH, PSTH, trials matrix.

Tables use ``session_id``, ``unit_id``, ``t_us`` (points) and ``session_id``,
``trigger_id``, ``t_us`` (triggers).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trigflow.functions.ticks import TICKS_PER_SECOND, BinGrid
from trigflow.operators.population import broadcast_if_few
from trigflow.operators.running import PART_ROWS, cell_bits, collapse, heavy_cells, marks_up_to
from trigflow.session import cut_lineage

SLAB_BITS = 6  # a slab of time is 64 windows long
SLAB_POINTS, SLAB_TRIGGERS = 500_000, 2_000_000  # of a slab in one group; fuller ones are split
SLICE_COUNTS = 1 << 22  # counts held at once by a task
CHUNKS = 64  # rows of packed points in a group
SPAN_ROWS, SPAN_COUNTS = 1 << 17, 1 << 20  # rows of whole groups counted at once, and counts made at once


def range_join(points: DataFrame, triggers: DataFrame, lo: int, hi: int) -> DataFrame:
    """Every (point, trigger) of a session with ``lo <= t - t0 <= hi``, both ends closed.

    An equi-join on a power-of-two time bucket at least as long as the window, so a
    trigger reaches two buckets at most. Being a plain inner equi-join it is left to
    Spark to broadcast a small side and, at run time, to split a bucket that holds too
    many rows (adaptive skew join). Adds ``rel_us``; trigger columns other than the
    session and ``trigger_id`` are prefixed ``trig_``.
    """
    bits = _window_bits(lo, hi)
    pts = points.withColumn("bucket", F.shiftright("t_us", bits))
    trg = triggers.where(F.col("t_us").isNotNull()).select(
        *[F.col(c) if c in ("session_id", "trigger_id") else F.col(c).alias(f"trig_{c}") for c in triggers.columns],
        F.explode(
            F.sequence(F.shiftright(F.col("t_us") + lo, bits), F.shiftright(F.col("t_us") + hi, bits))
        ).alias("bucket"),
    )
    rel = F.col("t_us") - F.col("trig_t_us")
    return (
        pts.join(trg, ["session_id", "bucket"])
        .where((rel >= lo) & (rel <= hi))
        .withColumn("rel_us", rel)
        .drop("bucket")
    )


def _window_bits(lo: int, hi: int) -> int:
    return max(1, int(hi - lo).bit_length())


def split_by_density(points: DataFrame, triggers: DataFrame, lo: int, hi: int, dense: int) -> tuple[DataFrame, DataFrame]:
    """Points whose time bucket is met by at most ``dense`` triggers' windows, and those met by more; others drop out.

    The choice is made by counts per bucket inside the plan, on the keys of :func:`range_join`.
    """
    bits = _window_bits(lo, hi)
    buckets = F.sequence(F.shiftright(F.col("t_us") + lo, bits), F.shiftright(F.col("t_us") + hi, bits))
    met = triggers.where(F.col("t_us").isNotNull()).select("session_id", F.explode(buckets).alias("bucket")).groupBy(
        "session_id", "bucket").agg(F.count(F.lit(1)).alias("met"))
    marked = points.withColumn("bucket", F.shiftright("t_us", bits)).join(met, ["session_id", "bucket"])
    return tuple(marked.where(c).drop("bucket", "met") for c in (F.col("met") <= dense, F.col("met") > dense))


def pair_counts(points: DataFrame, triggers: DataFrame, grid: BinGrid,
                method: str = "pairs", dense: int | None = None) -> DataFrame:
    """(session, unit, bin, n_pairs) of points around triggers, where there are pairs.

    ``pairs`` joins and counts: work grows with the matches. ``ranks`` forms no pair:
    with N(x) the number of triggers up to x, a point p has ``N(p - b_k) - N(p - b_(k+1))``
    triggers in bin k, so work grows with points * bins + triggers whatever the density (:func:`unit_counts`).
    Both give the same rows; pairs are cheaper up to some dozen triggers in a window. ``auto``
    chooses for each time bucket: points in a bucket that more than ``dense`` windows meet (four times
    the bins by default) are counted by ranks, the others by pairs, and the counts are added up.
    """
    if method == "auto":
        own = points.select("session_id", "unit_id", "t_us")
        few, many = split_by_density(own, triggers, grid.lo, grid.hi, 4 * (grid.n_bins + 1) if dense is None else dense)
        both = pair_counts(few, triggers, grid, "pairs").unionByName(pair_counts(many, triggers, grid, "ranks"))
        return both.groupBy("session_id", "unit_id", "bin").agg(F.sum("n_pairs").alias("n_pairs"))
    if method == "pairs":
        pairs = range_join(points.select("session_id", "unit_id", "t_us"),
                           triggers.select("session_id", "t_us"), grid.lo, grid.hi)
        return pairs.groupBy("session_id", "unit_id", grid.index_of(F.col("rel_us")).alias("bin")).agg(
            F.count(F.lit(1)).alias("n_pairs"))
    return unit_counts(points, triggers, grid).select(
        "session_id", "unit_id", F.posexplode("counts").alias("bin", "n_pairs")).where("n_pairs > 0")


def fixed_parts(df: DataFrame) -> int:
    """A number of parts for few bytes with much work, which adaptive execution would merge."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def key_runs(batch: pa.RecordBatch, n_keys: int) -> Iterator[tuple[tuple, int, int]]:
    """(key, start, stop) of each run of rows that agree in the first columns."""
    edge = np.zeros(max(len(batch) - 1, 0), bool)
    for c in batch.columns[:n_keys]:
        edge |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    starts = [0, *(np.flatnonzero(edge) + 1).tolist()] if len(batch) else []
    for s, e in zip(starts, [*starts[1:], len(batch)]):
        yield tuple(c[s].as_py() for c in batch.columns[:n_keys]), s, e


def _counted_by_unit(bounds: np.ndarray) -> Callable:
    """Counts per unit and bin of groups (session, slab, share, part); rows of triggers come before those of points."""
    most = max(1024, SLICE_COUNTS // (len(bounds) - 1))

    def count(times, weights, units, at):
        t, n = np.concatenate(times), np.concatenate(weights)
        order = np.argsort(t)
        t, upto = t[order], np.r_[0, np.cumsum(n[order])]
        coded = pa.chunked_array(units).combine_chunks().dictionary_encode(null_encoding="encode")
        points = np.concatenate(at)
        order = np.argsort(points)
        points, code = points[order], coded.indices.to_numpy()[order]
        out = np.zeros((len(coded.dictionary), len(bounds) - 1), np.int64)
        before = upto[np.searchsorted(t, points - bounds[0], side="right")]
        for k, bound in enumerate(bounds[1:].tolist()):
            after = upto[np.searchsorted(t, points - bound, side="right")]
            out[:, k] = np.bincount(code, before - after, len(out))
            before = after
        met = np.flatnonzero(out.any(axis=1))
        return coded.dictionary.take(pa.array(met)), out[met]

    def work(batches):
        met, kind, times, weights, units, at, held, done, ready = None, None, [], [], [], [], 0, [], 0

        def close():
            nonlocal units, at, held, ready
            if times and units:
                unit, counts = count(times, weights, units, at)
                done.append(pa.RecordBatch.from_arrays(
                    [pa.array([met[0]] * len(unit), kind), unit,
                     pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1) * counts.shape[1], pa.int32()), pa.array(counts.ravel()))],
                    names=["session_id", "unit_id", "counts"]))
                ready += counts.size
            units, at, held = [], [], 0

        for batch in batches:
            kind = batch.column(0).type
            packed = batch.column(5).is_valid().to_numpy(zero_copy_only=False)
            for key, s, e in key_runs(batch, 4):
                if key != met:
                    close()
                    met, times, weights = key, [], []
                m = s + int(packed[s:e].sum())
                if m > s:
                    times.append(batch.column(4).slice(s, m - s).flatten().to_numpy())
                    weights.append(batch.column(5).slice(s, m - s).flatten().to_numpy())
                for x in range(m, e) if times else ():
                    units.append(batch.column(6).slice(x, 1).flatten())
                    at.append(batch.column(4).slice(x, 1).flatten().to_numpy())
                    held += len(at[-1])
                    if held >= most:
                        close()
                if ready >= SLICE_COUNTS:
                    yield from done
                    done, ready = [], 0
        close()
        yield from pa.Table.from_batches(done).combine_chunks().to_batches() if done else ()

    return work


def unit_counts(points: DataFrame, triggers: DataFrame, grid: BinGrid) -> DataFrame:
    """(session, unit, counts): pairs in each bin of every unit that has one, as an array over the bins.

    No pair is formed: with N(x) the number of triggers up to x, a point p has ``N(p - b_k) - N(p - b_(k+1))``
    triggers in bin k. Points meet the sorted times of the triggers in slabs of 64 windows, and rows of counts leave
    a slab once a unit. A slab with many points is dealt out by unit (times too where it has fewer units than
    parts), one with many trigger times by these; the counts add up. Both kinds of full slabs are at most some
    hundreds, because each holds that share of all rows, so they are broadcast.
    """
    bits = _window_bits(grid.lo, grid.hi) + SLAB_BITS
    at = ["session_id", "slab"]
    pts = points.where("session_id is not null and t_us is not null").select(
        "session_id", "unit_id", "t_us", F.shiftright("t_us", bits).alias("slab"))
    trg = collapse(triggers.where("session_id is not null and t_us is not null").select("session_id", "t_us"), ["session_id", "t_us"]).withColumn(
        "slab", F.explode(F.sequence(F.shiftright(F.col("t_us") + grid.lo, bits), F.shiftright(F.col("t_us") + grid.hi, bits))))
    full = F.broadcast(heavy_cells(collapse(pts, at), at, min_rows=SLAB_POINTS).withColumnRenamed("salts", "parts"))
    units = pts.join(full, at, "left_semi").groupBy(*at).agg(F.approx_count_distinct("unit_id").alias("units"))
    full = F.broadcast(full.join(units, at).select(*at, "parts", F.ceil(F.col("parts") / F.greatest("units", F.lit(1))).alias("cuts")))
    crowded = F.broadcast(heavy_cells(collapse(trg, at), at, min_rows=SLAB_TRIGGERS).withColumnRenamed("salts", "shares"))
    parts, shares, cuts = (F.coalesce(c, F.lit(1)) for c in ("parts", "shares", "cuts"))
    packed = (
        trg.join(crowded, at, "left")
        .groupBy(*at, F.pmod(F.xxhash64("t_us"), shares).cast("int").alias("share"), F.shiftright("t_us", bits - 8).alias("fine"))
        .agg(F.collect_list(F.struct("t_us", "n")).alias("met"))
        .join(full, at, "left")
        .select("session_id", "slab", "share", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"),
                F.col("met.t_us").alias("times"), F.col("met.n").alias("weights"))
    )
    salt = F.pmod(F.xxhash64("t_us"), cuts)
    dealt = (
        pts.join(full, at, "left").join(crowded, at, "left")
        .select("session_id", "slab", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"),
                F.pmod(F.xxhash64("unit_id", salt), parts).cast("int").alias("part"),
                F.pmod(F.hash("unit_id", salt), F.lit(CHUNKS)).alias("chunk"), "unit_id", "t_us")
        .groupBy(*at, "share", "part", "chunk").agg(F.collect_list(F.struct("unit_id", "t_us")).alias("met"))
        .select(*at, "share", "part", F.col("met.t_us").alias("times"), F.col("met.unit_id").alias("units"))
    )
    group = ["session_id", "slab", "share", "part"]
    rows = packed.unionByName(dealt, allowMissingColumns=True).repartition(fixed_parts(points), *group)
    kinds = dict(points.dtypes)
    each = rows.sortWithinPartitions(*group, F.col("weights").isNull()).mapInArrow(
        _counted_by_unit(np.array(grid.bounds, np.int64)),
        f"session_id {kinds['session_id']}, unit_id {kinds['unit_id']}, counts array<bigint>")
    held = F.collect_list("counts")  # as many arrays as a session has slabs, times the parts of a unit in a full one
    added = F.aggregate(F.slice(held, 2, F.size(held)), F.get(held, F.lit(0)), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    return each.groupBy("session_id", "unit_id").agg(added.alias("counts"))


def count_pairs(points: DataFrame, triggers: DataFrame, lo: int, hi: int) -> DataFrame:
    """(session, n_pairs): how many rows :func:`range_join` has, from running counts, so that no pair is formed."""
    some = points.select("session_id", F.pmod(F.xxhash64("t_us"), F.lit(256)).alias("unit_id"), "t_us")
    counts = unit_counts(some, triggers, BinGrid((lo, hi + 1), (0.0,), (hi + 1 - lo) / TICKS_PER_SECOND, True))
    return counts.groupBy("session_id").agg(F.sum(F.get("counts", F.lit(0))).alias("n_pairs"))


def trigger_counts(triggers: DataFrame) -> DataFrame:
    """Triggers per session; a NULL time still counts as a trial."""
    return triggers.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_trials"))


def unit_bin_grid(units: DataFrame, n_bins: int) -> DataFrame:
    """Every bin of every unit."""
    return units.select(
        "session_id", "unit_id", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin")
    )


def peth(points: DataFrame, triggers: DataFrame, units: DataFrame, grid: BinGrid,
         method: str = "pairs") -> DataFrame:
    """Mean rate per unit and bin over all triggers of the session, zero-filled.

    Points of units not listed are counted but leave with the left join to the grid;
    restrict ``points`` first where many would be counted in vain.
    """
    n = F.coalesce(F.col("n_trials"), F.lit(0))
    rate = F.when(n == 0, F.lit(0.0)).otherwise(
        F.coalesce(F.col("n_pairs"), F.lit(0)) / (n * F.lit(grid.bin_seconds))
    )
    if method == "ranks":  # bins stay in an array up to here, so no row per bin is shuffled
        none = F.array_repeat(F.lit(0).cast("bigint"), grid.n_bins)
        filled = (
            units.select("session_id", "unit_id").join(unit_counts(points, triggers, grid), ["session_id", "unit_id"], "left")
            .join(trigger_counts(triggers), "session_id", "left")
            .select("session_id", "unit_id", "n_trials", F.posexplode(F.coalesce("counts", none)).alias("bin", "n_pairs"))
        )
    else:
        filled = (
            unit_bin_grid(units, grid.n_bins)
            .join(pair_counts(points, triggers, grid, method), ["session_id", "unit_id", "bin"], "left")
            .join(trigger_counts(triggers), "session_id", "left")
        )
    return filled.select("session_id", "unit_id", "bin", grid.center_of(F.col("bin")).alias("bin_center"),
                         rate.alias("rate_hz"), n.alias("n_trials"))


def psth(points: DataFrame, triggers: DataFrame, units: DataFrame, grid: BinGrid,
         method: str = "pairs") -> DataFrame:
    """Fine-binned rate per unit; as :func:`peth` with at least one trial assumed."""
    out = peth(points, triggers, units, grid, method)
    return out.withColumn("n_trials", F.greatest(F.col("n_trials"), F.lit(1)))


def trials_matrix(points: DataFrame, triggers: DataFrame, grid: BinGrid) -> DataFrame:
    """Sparse (session, trigger, unit, bin, n, rate_hz); absent cells are zero."""
    pairs = range_join(points.select("session_id", "unit_id", "t_us"),
                       triggers.select("session_id", "trigger_id", "t_us"), grid.lo, grid.hi)
    return (
        pairs.groupBy("session_id", "trigger_id", "unit_id", grid.index_of(F.col("rel_us")).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n_points"))
        .withColumn("rate_hz", F.col("n_points") / F.lit(grid.bin_seconds))
    )


def good_units(units: DataFrame, sessions: DataFrame, explicit: DataFrame | None = None,
               use_good_only: bool = True) -> DataFrame:
    """Explicit list, else the session's good list when it has one, else all units."""
    if explicit is not None:
        return units.join(explicit.select("session_id", "unit_id"), ["session_id", "unit_id"], "left_semi")
    if not use_good_only:
        return units
    good = sessions.select("session_id", "good_unit_ids")
    has_list = F.size(F.coalesce(F.col("good_unit_ids"), F.array())) > 0
    keep = ~has_list | F.array_contains("good_unit_ids", F.col("unit_id"))
    return units.join(good, "session_id", "left").where(keep).select(*units.columns)


def smooth_bins(curves: DataFrame, sigma: float, n_bins: int, value: str = "rate_hz",
                truncate: float = 4.0) -> DataFrame:
    """Gaussian smoothing along the bins of each (session, unit); edges reflect at half a bin.

    The kernel radius is ``int(truncate * sigma + 0.5)`` bins. Each bin is spread to the
    bins it feeds, so the work is bins * kernel length.
    """
    import math

    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (o / sigma) ** 2) for o in range(-radius, radius + 1)]
    total = sum(raw)
    # out[i] = sum_o w[o] * in[reflect(i + o)]: invert to "source bin feeds target bin".
    feeds: dict[int, dict[int, float]] = {s: {} for s in range(n_bins)}
    for i in range(n_bins):
        for o, wt in zip(range(-radius, radius + 1), raw):
            j = (i + o) % (2 * n_bins)
            src = j if j < n_bins else 2 * n_bins - 1 - j
            feeds[src][i] = feeds[src].get(i, 0.0) + wt / total
    spark = curves.sparkSession
    kernel = spark.createDataFrame(
        [(s, t, w) for s, ts in feeds.items() for t, w in ts.items()], "bin int, target int, weight double"
    )
    # n_bins * (2 * radius + 1) rows, fixed by the grid and not by the data.
    return (
        curves.join(F.broadcast(kernel), "bin")
        .groupBy("session_id", "unit_id", F.col("target").alias("bin"))
        .agg(F.sum(F.col(value) * F.col("weight")).alias("smoothed"))
    )


def variable_range_join(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Points inside per-row spans ``lo_us <= t <= hi_us`` of the same session.

    A span is cut into buckets of the largest of a few widths that fits its length, seventeen
    at most, and a point is put into one bucket of each width that spans of its session use.
    """
    length = F.length(F.conv((F.col("hi_us") - F.col("lo_us")).cast("string"), 10, 16))  # in steps of sixteen
    cut = spans.where("lo_us <= hi_us").withColumn("level", F.greatest(4 * length - 4, F.lit(20)).cast("int"))
    widths = cut.select("session_id", "level").distinct()
    pts = points.select("session_id", "unit_id", "t_us").join(widths, "session_id").withColumn(
        "bucket", F.expr("shiftright(t_us, level)"))
    cut = cut.withColumn("bucket", F.explode(F.expr("sequence(shiftright(lo_us, level), shiftright(hi_us, level))")))
    return (
        pts.join(cut, ["session_id", "level", "bucket"])
        .where((F.col("t_us") >= F.col("lo_us")) & (F.col("t_us") <= F.col("hi_us")))
        .drop("bucket", "level")
    )


def _counted_in_spans(n_keys: int, kept: list[str]) -> Callable:
    """The spans of groups (session, level, slab, share, part) with the counts of the group's points by ``u``."""
    def count(table: pa.Table):
        edge = np.zeros(len(table), bool)
        for c in table.columns[:n_keys]:
            c = c.combine_chunks()
            edge[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        group = np.cumsum(edge)
        is_span = table["u"].is_null().to_numpy()
        spans, points = table.filter(pa.array(is_span)), table.filter(pa.array(~is_span))
        at, of, u = points["lo_us"].to_numpy(), group[~is_span], points["u"].to_numpy()
        width = np.zeros(group[-1] + 1, np.int64)
        np.maximum.at(width, of, u + 1)
        first = np.cumsum(width) - width  # number of the first unit of a group
        times, rank = np.unique(at, return_inverse=True)
        steps = len(times) + 1
        key = np.sort((first[of] + u) * steps + rank)
        lo = np.searchsorted(times, spans["lo_us"].to_numpy(), side="left")
        hi = np.maximum(lo, np.searchsorted(times, spans["hi_us"].to_numpy(), side="right"))
        of = group[is_span]
        ends = np.cumsum(width[of])
        s = 0
        while s < len(of):
            done = ends[s - 1] if s else 0
            e = max(s + 1, int(np.searchsorted(ends, done + SPAN_COUNTS, side="right")))
            starts = np.r_[0, ends[s:e] - done]
            row = np.repeat(np.arange(s, e), width[of[s:e]])
            unit = (first[of[row]] + np.arange(starts[-1]) - starts[row - s]) * steps
            n = np.searchsorted(key, unit + hi[row]) - np.searchsorted(key, unit + lo[row])
            counts = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(n, pa.int64()))
            out = spans.slice(s, e - s).select(kept).append_column("counts", counts)
            yield from out.combine_chunks().to_batches()
            s = e

    def work(batches):
        held, size, least = [], 0, SPAN_ROWS
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size < least:
                continue
            table = pa.Table.from_batches(held)
            last = table.slice(len(table) - 1).columns[:n_keys]
            same = np.ones(len(table), bool)
            for c, x in zip(table.columns[:n_keys], last):
                same &= pc.equal(c, x[0]).to_numpy()
            cut = int(np.argmax(same))  # the last group may go on in the next batch
            if cut:
                yield from count(table.slice(0, cut))
            held, size = table.slice(cut).to_batches(), len(table) - cut
            least = max(SPAN_ROWS, 2 * size)
        if size:
            yield from count(pa.Table.from_batches(held))

    return work


def span_counts(points: DataFrame, spans: DataFrame, index: DataFrame) -> DataFrame:
    """Each span ``lo_us <= t <= hi_us`` with ``counts``: points of the session in it, by ``u`` of ``index(session_id, unit_id, u)``.

    No pair is formed, so work grows with points * log + spans * units whatever the density; the same counts as
    from :func:`variable_range_join`. Zeros after a slab's last unit are left out of the array. Slabs are four times
    as long as the longest span of their level: a span goes to the slab of its start, a point to its own slab and,
    if spans reach it from there, to the one before. Slabs with very many points or spans are dealt out, and the
    counts of their parts added up. ``spans`` are distinct rows with a ``trigger_id``; those without a session or an end drop out.
    """
    length = F.length(F.conv(F.greatest(F.col("hi_us") - F.col("lo_us"), F.lit(0)).cast("string"), 10, 16))
    cut = spans.where("session_id is not null and lo_us is not null and hi_us is not null").withColumn(
        "level", F.greatest(4 * length - 4, F.lit(20)).cast("int")).withColumn("slab", F.expr("shiftright(lo_us, level + 6)"))
    levels = cut.select("session_id", "level").distinct().groupBy("session_id").agg(F.collect_list("level").alias("levels"))
    slab = F.expr("shiftright(t_us, level + 6)")
    reached = F.expr("t_us - shiftleft(shiftright(t_us, level + 6), level + 6) < shiftleft(1L, level + 4)")
    pts = (
        points.where("t_us is not null").select("session_id", "unit_id", "t_us")
        .join(broadcast_if_few(index.join(levels, "session_id")), ["session_id", "unit_id"])
        .select("session_id", F.col("u").cast("bigint").alias("u"), "t_us", F.explode("levels").alias("level"))
        .withColumn("slab", F.explode(F.when(reached, F.array(slab, slab - 1)).otherwise(F.array(slab))))
    )
    at = ["session_id", "level", "slab"]
    full = cut_lineage(heavy_cells(collapse(pts, at), at, min_rows=SLAB_POINTS).withColumnRenamed("salts", "parts"))
    crowded = cut_lineage(heavy_cells(collapse(cut, at), at, min_rows=SLAB_TRIGGERS).withColumnRenamed("salts", "shares"))
    parts, shares = (F.coalesce(c, F.lit(1)) for c in ("parts", "shares"))

    def known(rows):  # at most some hundreds, as in unit_counts
        return rows.join(F.broadcast(full), at, "left").join(F.broadcast(crowded), at, "left")

    group = [*at, "share", "part"]
    rows = known(cut).select(
        *at, F.pmod(F.xxhash64("trigger_id", "lo_us"), shares).cast("int").alias("share"),
        F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), *[c for c in spans.columns if c not in at]
    ).unionByName(known(pts).select(
        *at, F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"),
        F.pmod(F.xxhash64("t_us"), parts).cast("int").alias("part"), F.col("t_us").alias("lo_us"), "u"), allowMissingColumns=True)
    wanted = max(fixed_parts(points), -(-(points.count() + spans.count()) // PART_ROWS))
    kinds = ", ".join(f"`{name}` {kind}" for name, kind in spans.dtypes)
    each = rows.repartition(wanted, *group).sortWithinPartitions(*group).mapInArrow(
        _counted_in_spans(len(group), spans.columns), f"{kinds}, counts array<bigint>")
    if full.isEmpty():
        return each
    held, none = F.collect_list("counts"), F.lit(0).cast("bigint")
    added = F.aggregate(held, F.array().cast("array<bigint>"), lambda a, x: F.zip_with(
        a, x, lambda p, q: F.coalesce(p, none) + F.coalesce(q, none)))
    return each.groupBy(*spans.columns).agg(added.alias("counts"))


def window_counts(points: DataFrame, triggers: DataFrame, lo: int, hi: int, ids: list[str],
                  units: DataFrame | None = None, method: str = "pairs") -> DataFrame:
    """Points of each unit in the window of each trigger: (session, unit, ids, n, first_us).

    ``first_us`` is the earliest relative time. Windows without points are left out.
    ``pairs`` counts joined pairs. ``ranks`` probes each unit's running point count at
    both window ends, one pair of probes per (unit, trigger) however many points lie
    between: for points that crowd inside single windows. Both give the same rows.
    """
    by = ["session_id", "unit_id"]
    if method == "pairs":
        pairs = range_join(points.select(*by, "t_us"), triggers.select("session_id", *ids, "t_us")
                           .withColumnsRenamed({c: f"id_{c}" for c in ids}), lo, hi)
        return pairs.groupBy(*by, *[F.col(f"trig_id_{c}").alias(c) for c in ids]).agg(
            F.count(F.lit(1)).alias("n"), F.min("rel_us").alias("first_us"))
    units = points.select(*by).distinct() if units is None else units.select(*by)
    marks = collapse(points.select(*by, F.col("t_us").alias("x")), [*by, "x"])
    probes = triggers.where(F.col("t_us").isNotNull()).join(units, "session_id").select(
        *by, *ids, "t_us",
        F.explode(F.array(
            F.struct(F.lit(0).alias("end"), (F.col("t_us") + lo - 1).alias("x")),
            F.struct(F.lit(1).alias("end"), (F.col("t_us") + hi).alias("x")),
        )).alias("e"),
    ).select(*by, *ids, "t_us", "e.*")
    ranked = marks_up_to(marks, probes, by, cell_bits(hi - lo), with_next=True)
    at = F.when(F.col("end") == 1, F.col("rank")).otherwise(-F.col("rank"))
    return (
        ranked.groupBy(*by, *ids, "t_us")
        .agg(F.sum(at).alias("n"), F.max(F.when(F.col("end") == 0, F.col("next_x"))).alias("next_x"))
        .where("n > 0")
        .select(*by, *ids, "n", (F.col("next_x") - F.col("t_us")).alias("first_us"))
    )
