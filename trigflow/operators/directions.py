"""Discriminant directions: shrinkage and ridge, time-resolved cross-validation, label permutation.

Nothing here needs trials side by side. Covariance, class means and permuted class means
are sums over trials, so bounded chunks of trials are reduced to moments (units x units
and labels x units), the moments are added by Spark, and one small solve per
(session, bin) works on sums alone. The covariance does not depend on the labels, so one
factorisation per fold serves all permutations.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigflow.operators.align import fixed_parts
from trigflow.operators.population import broadcast_if_few, dense_unit_index, project
from trigflow.operators.running import dealt, kth_smallest, ntile_of, row_rank
from trigflow.operators.tagging import hash60
from trigflow.session import cut_lineage

CHUNK_CELLS = 2_000_000  # trials x units held at once by a task, an eighth of it where units are few
GRAM, PLAIN = -2, -1  # moment kinds below the label sets 0, 1, 2, …
PART_TRIALS = 100_000  # trials whose rows make up a part, where chunks are dealt out
WORD = 62  # label sets packed into one BIGINT


def stratified_folds(labels: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """Adds ``fold``: per class a random order cut into k near-equal parts.

    k is held between 2 and the smallest class. The order is a hash of the trial, and its
    rank comes from cells of the hash, so a class is never sorted in one task.
    """
    by = ["session_id", "y"]
    sizes = labels.groupBy(*by).agg(F.count(F.lit(1)).alias("n_class"))
    smallest = sizes.groupBy("session_id").agg(F.min("n_class").alias("min_class"))
    key = hash60(F.col("session_id"), F.col("trial_idx"), F.lit(seed))
    ranked = row_rank(labels.withColumn("key", key), by, ["key", "trial_idx"], F.shiftright("key", 44))
    k_eff = F.greatest(F.lit(2), F.least(F.lit(k), F.col("min_class")))
    return (
        ranked.join(sizes, by).join(smallest, "session_id")
        .withColumn("fold", ntile_of(F.col("rank"), F.col("n_class"), k_eff) - 1)
        .select(*labels.columns, "fold")
    )


def with_label_sets(labels: DataFrame, n_permutations: int, seed: int = 0) -> DataFrame:
    """Adds ``ys``: the true label followed by permuted ones, class sizes kept.

    In permutation p a trial is in class 1 when its hash is among the n1 smallest; the
    threshold is an exact order statistic, so no permutation is ever sorted as a whole.
    Permuted sets of a session without class 1 are all zero.
    """
    if n_permutations == 0:
        return labels.withColumn("ys", F.array("y"))

    def draw(p):
        return hash60(F.col("session_id"), F.col("trial_idx"), p, F.lit(seed))

    perms = F.sequence(F.lit(1), F.lit(n_permutations))
    n1 = labels.groupBy("session_id").agg(F.sum("y").alias("k")).where("k > 0")
    wanted = n1.withColumn("perm", F.explode(perms)).select("session_id", "perm", F.lit("t").alias("tag"), "k")
    rows = labels.select("session_id", "trial_idx", F.explode(perms).alias("perm")).withColumn(
        "h", draw(F.col("perm")))
    cut = kth_smallest(rows, ["session_id", "perm"], "h", wanted, F.shiftright("h", 49))
    cuts = cut.groupBy("session_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("perm", "value"))), lambda s: s["value"]).alias("cuts"))
    permuted = F.transform(perms, lambda p: F.coalesce(draw(p) <= F.get("cuts", p - 1), F.lit(False)).cast("int"))
    return labels.join(cuts, "session_id", "left").withColumn("ys", F.concat(F.array("y"), permuted)).drop("cuts")


def _packed(ys: str, n_sets: int) -> list:
    """Label sets of a trial as bits of BIGINT columns, to travel with its rows."""
    def word(lo: int):
        part = F.slice(ys, lo + 1, min(WORD, n_sets - lo))
        return F.aggregate(F.reverse(part), F.lit(0).cast("bigint"), lambda acc, y: acc * 2 + y)

    return [word(lo).alias(f"bits{lo // WORD}") for lo in range(0, n_sets, WORD)]


def _chunk_moments(n_sets: int):
    def moments(pdf: pd.DataFrame) -> pd.DataFrame:
        """Moments, fold by fold, of one bounded chunk of trials of one (session, bin)."""
        trial, first, row = np.unique(pdf["trial_idx"].to_numpy(), return_index=True, return_inverse=True)
        units, col = np.unique(pdf["u"].to_numpy(), return_inverse=True)
        x = np.zeros((len(trial), len(units)))
        np.add.at(x, (row, col), pdf["rate"].to_numpy())
        words = pdf[[c for c in pdf.columns if c.startswith("bits")]].to_numpy(np.int64)[first]
        y = np.concatenate([
            (words[:, i // WORD, None] >> np.arange(min(WORD, n_sets - i))) & 1 for i in range(0, n_sets, WORD)
        ], axis=1).astype(float)
        fold, nu = pdf["fold"].to_numpy()[first], int(pdf["nu"].iloc[0])
        rows = []
        for f in np.unique(fold):
            xf, yf = x[fold == f], y[fold == f]
            wide = np.zeros((len(units) + 1 + n_sets, nu))
            wide[:, units] = np.concatenate([xf.T @ xf, xf.sum(axis=0)[None], yf.T @ xf])
            kinds = [*[(GRAM, u) for u in units], (PLAIN, 0), *[(s, 0) for s in range(n_sets)]]
            rows += [(f, kind, at, v) for (kind, at), v in zip(kinds, wide)]
        out = pd.DataFrame(rows, columns=["fold", "kind", "at", "values"])
        head = pdf.iloc[0]
        return out.assign(session_id=head["session_id"], bin=head["bin"])[
            ["session_id", "bin", "fold", "kind", "at", "values"]]

    return moments


def _moments(pop: DataFrame, labels: DataFrame, index: DataFrame, n_sets: int, n_bins: int) -> DataFrame:
    """(session, bin, fold, kind, at, values), summed over all trials.

    ``values`` runs over the session's units: a row of the Gram matrix for each unit ``at``, the
    sums over all trials, and those over class 1 of each label set. Vectors are added by Spark,
    map-side first, so a chunk sends folds × units × units doubles at most. Trial counts per fold
    and label set come from the trial table, since a trial may have no row in the population;
    they are stored at -1, for every bin.
    """
    session = dict(pop.dtypes)["session_id"]
    # A chunk sends units x units sums, so it may be the smaller the fewer units there are; small ones fill tasks evenly.
    cells = F.least(F.lit(CHUNK_CELLS), F.greatest(F.lit(CHUNK_CELLS / 8), 8 * F.col("nu") * F.col("nu")))
    size = labels.groupBy("session_id").agg(F.count(F.lit(1)).alias("nt")).join(
        index.groupBy("session_id").agg(F.count(F.lit(1)).alias("nu")), "session_id").select(
        "session_id", "nu", F.ceil(F.col("nt") * F.col("nu") / cells).cast("int").alias("chunks"))
    words = _packed("ys", n_sets)
    tagged = labels.select("session_id", "trial_idx", "fold", *words)
    n_trials = labels.count()
    dealt_cells = dealt(pop, "session_id", "trial_idx", rows=max(1, 4 * n_trials))
    rows = (
        dealt_cells.join(tagged, ["session_id", "trial_idx"]).join(broadcast_if_few(index), ["session_id", "unit_id"])
        .join(broadcast_if_few(size), "session_id")
        .select("session_id", "bin", F.pmod(F.xxhash64("trial_idx"), F.col("chunks")).cast("int").alias("chunk"),
                "nu", "fold", "trial_idx", "u", F.col("rate").cast("double").alias("rate"),
                *[f"bits{i}" for i in range(len(words))])
    )
    chunk = ["session_id", "bin", "chunk"]
    parts = rows.repartition(max(fixed_parts(pop), -(-n_trials // PART_TRIALS)), *chunk).groupBy(*chunk).applyInPandas(
        _chunk_moments(n_sets),
        f"session_id {session}, bin int, fold int, kind int, at int, values array<double>")
    sums = parts.groupBy("session_id", "bin", "fold", "kind", "at").agg(
        vector_to_array(Summarizer.sum(array_to_vector("values"))).alias("values"))
    one = F.array(F.lit(1))
    counts = labels.select(
        "session_id", "fold", F.posexplode(F.concat(one, "ys")).alias("pos", "y")
    ).groupBy("session_id", "fold", (F.col("pos") - 1).alias("kind")).agg(F.sum("y").cast("double").alias("v"))
    counts = counts.select(
        "session_id", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"), "fold", "kind",
        F.lit(-1).alias("at"), F.array("v").alias("values"))
    return sums.unionByName(counts)


def _arrays(pdf: pd.DataFrame):
    """Moments of one (session, bin) as dense arrays over folds, label sets and units."""
    fold, kind, at, values = (pdf[c].to_numpy() for c in ("fold", "kind", "at", "values"))
    nf, ns = int(fold.max()) + 1, int(kind.max()) + 1
    nu = max((len(v) for v, k in zip(values, kind) if k == GRAM), default=0)
    gram, plain, sums = np.zeros((nf, nu, nu)), np.zeros((nf, nu)), np.zeros((nf, ns, nu))
    n, n1 = np.zeros(nf), np.zeros((nf, ns))
    for f, k, u, v in zip(fold, kind, at, values):
        if u < 0:
            if k == PLAIN:
                n[f] = v[0]
            else:
                n1[f, k] = v[0]
        elif k == GRAM:
            gram[f, u] = v
        elif k == PLAIN:
            plain[f] = v
        else:
            sums[f, k] = v
    units = np.flatnonzero(gram.sum(axis=0).diagonal() > 0)  # units with a point in this bin
    return units, gram[:, units][:, :, units], plain[:, units], sums[:, :, units], n, n1


def directions_from_moments(gram, plain, sums, n, n1, method: str, reg: float) -> np.ndarray:
    """Unit vectors (label sets x units) from the moments of n trials; zero where a class is empty.

    shrinkage: (total covariance + reg I)^-1 (mean1 - mean0); ridge: (Xc'Xc + reg I)^-1 Xc'yc.
    """
    scatter = gram - np.outer(plain, plain) / n
    both = (n1 > 0) & (n1 < n)
    safe1, safe0 = np.where(both, n1, 1.0), np.where(both, n - n1, 1.0)
    if method == "shrinkage":
        left = scatter / (n - 1)
        right = sums / safe1[:, None] - (plain - sums) / safe0[:, None]
    else:
        left = scatter
        right = sums - plain * (n1 / n)[:, None]
    left = left + reg * np.eye(len(plain))
    try:
        w = np.linalg.solve(left, right.T).T
    except np.linalg.LinAlgError:
        w = (np.linalg.pinv(left) @ right.T).T
    norm = np.linalg.norm(w, axis=1)
    w = w / np.where(norm > 0, norm, 1.0)[:, None]
    return np.where(both[:, None], w, 0.0)


def fit_direction(vectors: DataFrame, labels: DataFrame, method: str = "shrinkage", reg: float = 1.0,
                  n_bins: int = 1) -> DataFrame:
    """Direction separating label 1 from 0 in (session, trial, unit, rate) vectors, per session.

    ``vectors`` may carry a ``bin`` below ``n_bins``; one direction is then fitted per bin.
    """
    pop = vectors if "bin" in vectors.columns else vectors.withColumn("bin", F.lit(0))
    index = dense_unit_index(vectors)
    prepared = labels.withColumn("fold", F.lit(0)).withColumn("ys", F.array("y"))
    session = dict(vectors.dtypes)["session_id"]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        units, gram, plain, sums, n, n1 = _arrays(pdf)
        if len(units) == 0 or n[0] < 2 or n1[0, 0] in (0, n[0]):
            return pd.DataFrame({"session_id": [], "bin": [], "u": [], "weight": []})
        w = directions_from_moments(gram[0], plain[0], sums[0], n[0], n1[0], method, reg)[0]
        return pd.DataFrame({"session_id": pdf["session_id"].iloc[0], "bin": pdf["bin"].iloc[0],
                             "u": units, "weight": w})

    out = _moments(pop, prepared, index, 1, n_bins).groupBy("session_id", "bin").applyInPandas(
        solve, f"session_id {session}, bin int, u int, weight double"
    ).join(index, ["session_id", "u"]).drop("u")
    return out if "bin" in vectors.columns else out.drop("bin")


def solve_time_resolved(pop: DataFrame, folds: DataFrame, n_bins: int, method: str = "shrinkage",
                        reg: float = 1.0, n_permutations: int = 0, seed: int = 0) -> DataFrame:
    """Cross-validated directions per (session, bin), with effects and permutation p-values.

    ``folds`` are labels with a fold; they and their label sets are checkpointed, being
    read more than once. Rows with ``fold >= 0`` hold the fold's unit vector,
    ``fold = -1`` the mean over folds (not renormalised), and ``fold = -2`` (one per bin)
    mean0, mean1, effect and p = (#|permuted| >= |effect| + 1) / (permutations + 1). With one
    class only there is no effect: the mean of the other class, effect and p are NULL.
    """
    index = dense_unit_index(pop)
    session = dict(pop.dtypes)["session_id"]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        units, gram, plain, sums, n, n1 = _arrays(pdf)
        sets = n1.shape[1]
        s1, s0 = np.zeros(sets), np.zeros(sets)
        total, used, rows = np.zeros(len(units)), 0, []
        for k in range(len(n)):
            rest = np.arange(len(n)) != k
            n_train = n[rest].sum()
            if n[k] == 0 or n_train < 2:
                continue
            w = directions_from_moments(gram[rest].sum(0), plain[rest].sum(0), sums[rest].sum(0),
                                        n_train, n1[rest].sum(0), method, reg)
            s1 += (w * sums[k]).sum(1)
            s0 += (w * (plain[k] - sums[k])).sum(1)
            if 0 < n1[rest, 0].sum() < n_train:
                total += w[0]
                used += 1
                rows.append((k, units, w[0]))
        rows.append((-1, units, total / max(used, 1)))
        k1, k0 = n1.sum(0), n.sum() - n1.sum(0)
        m1, m0 = (np.where(c > 0, s / np.maximum(c, 1.0), np.nan) for s, c in ((s1, k1), (s0, k0)))
        effect = m1 - m0
        both = k1[0] > 0 and k0[0] > 0
        reached = int((np.abs(effect[1:]) >= abs(effect[0])).sum())
        said = [None if np.isnan(v[0]) else float(v[0]) for v in (m0, m1, effect)]
        frame = pd.concat([pd.DataFrame({"fold": f, "u": u, "weight": w}) for f, u, w in rows])
        stats = pd.DataFrame({"fold": [-2], "mean0": [said[0]], "mean1": [said[1]], "effect": [said[2]],
                              "p_value": [(reached + 1) / sets if sets > 1 and both else None]})
        out = pd.concat([frame, stats])
        return out.assign(session_id=pdf["session_id"].iloc[0], bin=pdf["bin"].iloc[0])[
            ["session_id", "bin", "fold", "u", "weight", "mean0", "mean1", "effect", "p_value"]
        ].astype({"u": "Int32", "mean0": "float64", "mean1": "float64", "effect": "float64", "p_value": "float64"})

    if n_permutations:
        folds = cut_lineage(folds)
    sets_of = cut_lineage(with_label_sets(folds, n_permutations, seed))
    solved = _moments(pop, sets_of, index, n_permutations + 1, n_bins).groupBy(
        "session_id", "bin").applyInPandas(
        solve, f"session_id {session}, bin int, fold int, u int, weight double, mean0 double, "
               "mean1 double, effect double, p_value double")
    return solved.join(index, ["session_id", "u"], "left").drop("u")


def fold_directions(solved: DataFrame) -> DataFrame:
    return solved.where("fold >= 0").select("session_id", "bin", "fold", "unit_id", "weight")


def mean_directions(solved: DataFrame) -> DataFrame:
    return solved.where("fold = -1").select("session_id", "bin", "unit_id", "weight")


def effects(solved: DataFrame) -> DataFrame:
    return solved.where("fold = -2").select("session_id", "bin", "mean0", "mean1", "effect", "p_value")


def held_out_projections(pop: DataFrame, folds: DataFrame, solved: DataFrame) -> DataFrame:
    """Each trial and bin projected on the direction fitted without the trial's fold."""
    tagged = pop.join(folds.select("session_id", "trial_idx", "fold"), ["session_id", "trial_idx"])
    return project(tagged, fold_directions(solved))
