"""Matching units between sessions of one subject."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trigflow.session import cut_lineage

BLOCK_VALUES = 4_000_000  # units x vector length held at once for one side of a block pair
TILE_VALUES = 2_000_000  # correlations held at once, however many units the blocks have
GRID = 32  # parts of all intervals at whose ends two distributions are compared for a bound
PAIR = ["subject", "session_a", "session_b", "unit_a", "unit_b"]


def _standard(vec: str):
    """Vector minus its mean over its norm, so that a dot product is a correlation."""
    total = F.aggregate(vec, F.lit(0.0), lambda a, v: a + v)
    centred = F.transform(vec, lambda v: v.cast("double") - total / F.size(vec))
    norm = F.sqrt(F.aggregate(centred, F.lit(0.0), lambda a, v: a + v * v))
    return F.transform(centred, lambda v: v / F.nullif(norm, F.lit(0.0)))


def _block_pairs(units: DataFrame, *extra: str) -> tuple[DataFrame, DataFrame]:
    """Units of a subject, with ``extra`` columns, in blocks of bounded size, copied so that every two blocks meet once."""
    sized = units.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("len"))
    blocks = F.greatest(F.ceil(F.col("n") * F.col("len") / BLOCK_VALUES), F.lit(1)).cast("int")
    placed = units.join(sized, "subject").select(
        "subject", "session_id", "unit_id", *extra, _standard("vec").alias("vec"), blocks.alias("blocks"),
        F.pmod(F.xxhash64("session_id", "unit_id"), blocks).cast("int").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = placed.withColumn("other", other).select(
        "subject", F.col("block").alias("ba"), F.col("other").alias("bb"), "session_id", "unit_id", "vec", *extra)
    b = placed.withColumn("other", other).select(
        "subject", F.col("other").alias("ba"), F.col("block").alias("bb"), "session_id", "unit_id", "vec", *extra)
    return a, b.toDF(*b.columns)


def _tiles(left: pd.DataFrame, right: pd.DataFrame):
    """(rows of left, correlations, finite) of one bounded tile after another; both are sorted by session."""
    a = np.stack(left["vec"].to_numpy()).astype(float)
    b = np.stack(right["vec"].to_numpy()).astype(float)
    step = max(1, TILE_VALUES // len(b))
    for at in range(0, len(a), step):
        corr = a[at:at + step] @ b.T
        yield slice(at, at + step), corr, np.isfinite(corr)


def _runs(sessions: np.ndarray) -> list[tuple]:
    """(session, from, to) of each run of a sorted column."""
    names, starts = np.unique(sessions, return_index=True)
    return list(zip(names, starts.tolist(), np.r_[starts[1:], len(sessions)].tolist()))


def top_matches(units: DataFrame, k: int = 5) -> DataFrame:
    """The k best correlated unit pairs of every two sessions of a subject.

    ``units(subject, session_id, unit_id, vec)``. Blocks of units are multiplied as
    matrices and only k candidates per session pair leave a block pair, so the pairs
    themselves are never rows; the final k is exact. Ties go to the lower ids.
    """
    types = dict(units.dtypes)
    s, u, subj = types["session_id"], types["unit_id"], types["subject"]
    a, b = _block_pairs(units)

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cols = [*PAIR, "waveform_corr"]
        if left.empty or right.empty:
            return pd.DataFrame({c: [] for c in cols})
        left = left.sort_values(["session_id", "unit_id"])
        right = right.sort_values(["session_id", "unit_id"])
        ua, ub, subject = left["unit_id"].to_numpy(), right["unit_id"].to_numpy(), left["subject"].iloc[0]
        later, found = _runs(right["session_id"].to_numpy()), []
        for rows, corr, finite in _tiles(left, right):
            corr = np.where(finite, corr, -np.inf)
            for x, r0, r1 in _runs(left["session_id"].to_numpy()[rows]):
                for y, c0, c1 in (run for run in later if run[0] > x):
                    part = corr[r0:r1, c0:c1].ravel()
                    # A little more than k would do, but rounding may hide ties: keep all near the k-th.
                    cut = -np.inf if part.size <= k else np.partition(part, part.size - k)[part.size - k] - 1e-9
                    at = np.flatnonzero((part >= cut) & (part > -np.inf))
                    i, j = rows.start + r0 + at // (c1 - c0), c0 + at % (c1 - c0)
                    found += [(subject, x, y, p, q, v) for p, q, v in zip(ua[i], ub[j], part[at])]
        return pd.DataFrame(found, columns=cols)

    cand = a.groupBy("subject", "ba", "bb").cogroup(b.groupBy("subject", "ba", "bb")).applyInPandas(
        best, f"subject {subj}, session_a {s}, session_b {s}, unit_a {u}, unit_b {u}, waveform_corr double")
    w = Window.partitionBy("subject", "session_a", "session_b").orderBy(
        F.round("waveform_corr", 9).desc(), "unit_a", "unit_b")
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def match_diagnostics(units: DataFrame) -> DataFrame:
    """Per subject: smallest and largest score, sessions, cross-session pairs; no pair becomes a row."""
    a, b = _block_pairs(units)
    subj = dict(units.dtypes)["subject"]

    def extent(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({c: [] for c in ("subject", "lo", "hi", "pairs")})
        left, right = left.sort_values("session_id"), right.sort_values("session_id")
        sa, sb = left["session_id"].to_numpy(), right["session_id"].to_numpy()
        lo, hi, pairs = np.inf, -np.inf, 0
        for rows, corr, finite in _tiles(left, right):
            ok = finite & (sa[rows, None] < sb[None, :])
            pairs += int(ok.sum())
            lo, hi = min(lo, corr.min(where=ok, initial=np.inf)), max(hi, corr.max(where=ok, initial=-np.inf))
        return pd.DataFrame({"subject": [left["subject"].iloc[0]], "lo": [lo if pairs else None],
                             "hi": [hi if pairs else None], "pairs": [pairs]})

    ext = a.groupBy("subject", "ba", "bb").cogroup(b.groupBy("subject", "ba", "bb")).applyInPandas(
        extent, f"subject {subj}, lo double, hi double, pairs bigint")
    per = ext.groupBy("subject").agg(F.min("lo").alias("prob_min"), F.max("hi").alias("prob_max"),
                                     F.sum("pairs").alias("n_pairs"))
    return units.groupBy("subject").agg(F.count_distinct("session_id").alias("n_sessions")).join(per, "subject")


def match_table(scored: DataFrame, prob: str = "prob") -> DataFrame:
    """Given scored pairs, earlier session first, most probable first (ids break ties)."""
    swap = F.col("session_a") > F.col("session_b")
    named = {c: F.when(swap, F.col(o)).otherwise(F.col(c)) for c, o in (
        ("session_a", "session_b"), ("session_b", "session_a"), ("unit_a", "unit_b"), ("unit_b", "unit_a"))}
    return scored.where("session_a <> session_b").withColumns(named).orderBy(
        F.col(prob).desc(), "session_a", "session_b", "unit_a", "unit_b")


def _unit_arrays(waveforms: DataFrame, intervals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per unit: (grid, values) of its waveform in (channel, sample) order; (isi, upto) with running counts."""
    unit = ["session_id", "unit_id"]
    wave = waveforms.groupBy(*unit).agg(F.sort_array(F.collect_list(F.struct("channel", "sample", "value"))).alias("w")).select(
        *unit, F.col("w.channel").cast("array<bigint>").alias("channel"), F.col("w.sample").cast("array<bigint>").alias("sample"),
        F.col("w.value").cast("array<double>").alias("value"))
    isi = intervals.groupBy(*unit).agg(F.sort_array(F.collect_list(F.struct("isi_us", "n"))).alias("i")).select(
        *unit, F.col("i.isi_us").cast("array<bigint>").alias("isi"), F.col("i.n").cast("array<double>").alias("n"))
    return wave, isi


def _correlation(a: tuple, b: tuple) -> float | None:
    """Pearson correlation over the channels and samples both units have; None without a spread or a common sample."""
    if any(x is None for x in (*a, *b)):
        return None
    grid_a, grid_b = (np.stack([x[0], x[1]], axis=1) for x in (a, b))
    va, vb = np.asarray(a[2], float), np.asarray(b[2], float)
    if grid_a.shape != grid_b.shape or (grid_a != grid_b).any():
        place = {tuple(g): i for i, g in enumerate(grid_b.tolist())}
        both = [(i, place[tuple(g)]) for i, g in enumerate(grid_a.tolist()) if tuple(g) in place]
        va, vb = va[[i for i, _ in both]], vb[[j for _, j in both]]
    known = ~(np.isnan(va) | np.isnan(vb))
    va, vb = va[known], vb[known]
    if not len(va) or not np.ptp(va) or not np.ptp(vb):
        return None
    va, vb = va - va.mean(), vb - vb.mean()
    return float((va * vb).sum() / np.sqrt((va * va).sum() * (vb * vb).sum()))


def _distance(a: tuple, b: tuple) -> float:
    """Largest gap of two cumulative shares; a unit without intervals has none of its share."""
    shares, marks = [], np.unique(np.concatenate([x[0] for x in (a, b) if x[0] is not None] or [np.zeros(0)]))
    if not len(marks):
        return 1.0
    for at, n in (a, b):
        if at is None:
            shares.append(np.zeros(len(marks)))
        else:
            upto = np.r_[0.0, np.cumsum(n)]
            shares.append(upto[np.searchsorted(at, marks, side="right")] / upto[-1])
    return float(np.abs(shares[0] - shares[1]).max())


def pair_similarity(pairs: DataFrame, waveforms: DataFrame, intervals: DataFrame, rates: DataFrame) -> DataFrame:
    """waveform_corr, isi_ks, firing_rate_ratio and their mean agreement for proposed pairs.

    ``waveforms(session_id, unit_id, channel, sample, value)``, ``intervals(session_id, unit_id, isi_us, n)``
    as counts per distinct value, ``rates(session_id, unit_id, mean_rate_hz)``. A unit is one row of arrays,
    and a pair meets the arrays of both; no row per pair and sample or interval is made. isi_ks is the
    two-sample Kolmogorov-Smirnov distance, 1 where neither unit has intervals. The ratio is
    smaller over larger; the composite score is the mean of the correlation, one minus the distance, and the ratio.
    """
    wave, isi = _unit_arrays(waveforms, intervals)
    arrays = ["channel", "sample", "value", "isi", "n"]
    units = wave.join(isi, ["session_id", "unit_id"], "full").join(
        rates.select("session_id", "unit_id", F.col("mean_rate_hz").cast("double").alias("rate")), ["session_id", "unit_id"], "left")

    def side(tag: str) -> DataFrame:
        return units.select(F.col("session_id").alias(f"session_{tag}"), F.col("unit_id").alias(f"unit_{tag}"),
                            *[F.col(c).alias(f"{c}_{tag}") for c in (*arrays, "rate")])

    def measured(batches):
        for frame in batches:
            get = lambda tag, names: list(zip(*(frame[f"{c}_{tag}"] for c in names))) if len(frame) else []
            corr = [_correlation(x, y) for x, y in zip(get("a", arrays[:3]), get("b", arrays[:3]))]
            far = [_distance(x, y) for x, y in zip(get("a", arrays[3:]), get("b", arrays[3:]))]
            yield frame[[*PAIR, "rate_a", "rate_b"]].assign(waveform_corr=np.array(corr, float), isi_ks=np.array(far, float))

    types = dict(pairs.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in PAIR) + ", rate_a double, rate_b double, waveform_corr double, isi_ks double"
    out = (pairs.select(*PAIR).join(side("a"), ["session_a", "unit_a"], "left").join(side("b"), ["session_b", "unit_b"], "left")
           .mapInPandas(measured, schema))
    ratio = F.try_divide(F.least("rate_a", "rate_b"), F.greatest("rate_a", "rate_b"))
    corr = F.when(~F.isnan("waveform_corr"), F.col("waveform_corr"))
    return out.select(*PAIR, corr.alias("waveform_corr"), "isi_ks", ratio.alias("firing_rate_ratio")).withColumn(
        "composite_score", (F.coalesce("waveform_corr", F.lit(0.0)) + 1 - F.col("isi_ks")
                            + F.coalesce("firing_rate_ratio", F.lit(0.0))) / 3)


def _with_grids(units: DataFrame, intervals: DataFrame, rates: DataFrame) -> DataFrame:
    """Units with their rate and the share of their intervals up to each of GRID marks, quantiles of all intervals."""
    probs = [i / GRID for i in range(1, GRID)]
    # a fixed number of marks, whatever the intervals
    marks = intervals.agg(F.percentile_approx("isi_us", probs, 10_000).alias("m")).first()["m"] or [0]
    marks = sorted(set(marks))
    sums = [F.sum(F.when(F.col("isi_us") <= m, F.col("n")).otherwise(0)) / F.sum("n") for m in marks]
    grid = intervals.groupBy("session_id", "unit_id").agg(F.array(*sums).cast("array<double>").alias("grid"))
    rate = rates.select("session_id", "unit_id", F.col("mean_rate_hz").cast("double").alias("rate"))
    none = F.array(*[F.lit(0.0)] * len(marks))
    return (units.join(rate, ["session_id", "unit_id"], "left").join(grid, ["session_id", "unit_id"], "left")
            .withColumn("grid", F.coalesce("grid", none)))


def _reach(a: pd.DataFrame, b: pd.DataFrame, rows: slice, corr: np.ndarray, finite: np.ndarray) -> np.ndarray:
    """Upper bounds of the composite scores of a tile.

    The gap of two distributions on the grid is at most their distance. An undefined correlation
    counts as zero, as in the score, and a ratio that is not sure as one.
    """
    ra, rb = a["rate"].to_numpy(float)[rows, None], b["rate"].to_numpy(float)
    most = np.maximum(ra, rb)
    out = np.divide(np.minimum(ra, rb), most, out=np.ones(most.shape), where=most > 0)
    out += np.where(finite, corr, 0.0) + 1
    ga, gb = np.stack(a["grid"].to_numpy()[rows]), np.stack(b["grid"].to_numpy())
    gap = np.zeros(corr.shape)
    for k in range(ga.shape[1]):
        np.maximum(gap, np.abs(ga[:, k, None] - gb[:, k]), out=gap)
    return (out - gap) / 3


def _bounded_pairs(a: DataFrame, b: DataFrame, types: dict[str, str], most: int | None) -> DataFrame:
    """Pairs of every two sessions, with the bound of their score: the ``most`` best of a tile, or all that reach the floor.

    Rows of ``a`` with a floor are no units: (session_id, later, floor), once for each block pair, ``later`` as text.
    """
    s, u, subj = types["session_id"], types["unit_id"], types["subject"]
    cols = [*PAIR, "bound"]

    def near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        floors = left[left["floor"].notna()]
        left = left[left["floor"].isna()].sort_values(["session_id", "unit_id"])
        if left.empty or right.empty:
            return pd.DataFrame({c: [] for c in cols})
        right = right.sort_values(["session_id", "unit_id"])
        floor_of = dict(zip(zip(floors["session_id"], floors["later"]), floors["floor"]))
        ua, ub, subject = left["unit_id"].to_numpy(), right["unit_id"].to_numpy(), left["subject"].iloc[0]
        later, found = _runs(right["session_id"].to_numpy()), []
        for rows, corr, finite in _tiles(left, right):
            bound = _reach(left, right, rows, corr, finite)
            for x, r0, r1 in _runs(left["session_id"].to_numpy()[rows]):
                for y, c0, c1 in (run for run in later if run[0] > x):
                    part = bound[r0:r1, c0:c1]
                    if most is None:
                        cut = floor_of.get((x, str(y)), -np.inf) - 1e-6
                    else:
                        cut = -np.inf if part.size <= most else np.partition(part.ravel(), part.size - most)[part.size - most]
                    i, j = np.nonzero(part >= cut)
                    found.append(pd.DataFrame({"subject": subject, "session_a": x, "session_b": y, "unit_a": ua[rows.start + r0 + i],
                                               "unit_b": ub[c0 + j], "bound": part[i, j]}))
        return pd.concat(found) if found else pd.DataFrame({c: [] for c in cols})

    return a.groupBy("subject", "ba", "bb").cogroup(b.groupBy("subject", "ba", "bb")).applyInPandas(
        near, f"subject {subj}, session_a {s}, session_b {s}, unit_a {u}, unit_b {u}, bound double")


def scored_pairs(units: DataFrame, waveforms: DataFrame, intervals: DataFrame, rates: DataFrame, k: int,
                 first: int) -> DataFrame:
    """Scores of pairs among which the k best of every two sessions are, by a threshold algorithm.

    Every pair has an upper bound of its score from its correlation, its rate ratio and a coarse
    grid of both interval distributions; bounds live in matrix tiles only. The ``first`` pairs with the highest
    bound of every two sessions are scored in full; their k-th score is a floor, and only pairs whose
    bound reaches it are scored besides. All others are proven to rank lower and never become rows.
    """
    by, types = ["subject", "session_a", "session_b"], dict(units.dtypes)
    a, b = (cut_lineage(x) for x in _block_pairs(_with_grids(units, intervals, rates), "rate", "grid"))
    w = Window.partitionBy(*by)
    top = cut_lineage(_bounded_pairs(a.withColumns({"later": F.lit(None).cast("string"), "floor": F.lit(None).cast("double")}),
                                     b, types, first)
                      .withColumn("place", F.row_number().over(w.orderBy(F.desc("bound"), "unit_a", "unit_b")))
                      .where(F.col("place") <= first))
    scored = cut_lineage(pair_similarity(top.select(*PAIR), waveforms, intervals, rates))
    place = F.row_number().over(w.orderBy(F.desc("composite_score"), "unit_a", "unit_b"))
    floors = scored.withColumn("place", place).where(F.col("place") == k).select(
        "subject", F.col("session_a").alias("session_id"), F.col("unit_a").alias("unit_id"),
        F.col("session_b").cast("string").alias("later"), F.col("composite_score").alias("floor"))
    tiles = a.select("subject", "ba", "bb").distinct()
    rest = _bounded_pairs(a.unionByName(tiles.join(floors, "subject"), allowMissingColumns=True), b, types, None)
    rest = cut_lineage(rest.join(top.select(*PAIR), PAIR, "left_anti").select(*PAIR))
    return scored.unionAll(pair_similarity(rest, waveforms, intervals, rates))


def top_composite(units: DataFrame, waveforms: DataFrame, intervals: DataFrame, rates: DataFrame, k: int = 5,
                  first: int = 20) -> DataFrame:
    """The k pairs of every two sessions of a subject with the highest composite score, of all pairs; ids break ties.

    See :func:`scored_pairs`; ``first``, at least k, changes the work and not the result.
    """
    w = Window.partitionBy("subject", "session_a", "session_b").orderBy(F.round("composite_score", 9).desc(), "unit_a", "unit_b")
    scored = scored_pairs(units, waveforms, intervals, rates, k, max(k, first))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
