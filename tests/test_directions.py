import numpy as np
import pytest
from pyspark.sql import functions as F

from trigflow.operators import directions as d
from trigflow.operators import population


def long(spark, pop, session="s"):
    rows = [(session, int(t), int(b), int(u), float(v)) for (t, b, u), v in np.ndenumerate(pop) if v != 0]
    return spark.createDataFrame(rows, "session_id string, trial_idx int, bin int, unit_id int, rate double")


def labels(spark, y, session="s"):
    return spark.createDataFrame([(session, i, int(v)) for i, v in enumerate(y)],
                                 "session_id string, trial_idx int, y int")


def oracle(x, y, method, reg):
    xc = x - x.mean(0)
    if method == "shrinkage":
        a, r = xc.T @ xc / (len(x) - 1), x[y == 1].mean(0) - x[y == 0].mean(0)
    else:
        a, r = xc.T @ xc, xc.T @ (y - y.mean())
    w = np.linalg.solve(a + reg * np.eye(x.shape[1]), r)
    return w / np.linalg.norm(w)


def make(seed=0, trials=60, bins=3, units=6):
    rng = np.random.default_rng(seed)
    pop = rng.poisson(1.0, (trials, bins, units)).astype(float)
    y = (np.arange(trials) % 3 == 0).astype(int)
    pop[y == 1, 1, :3] += 2
    return pop, y


@pytest.mark.parametrize("method", ["shrinkage", "ridge"])
def test_fit_matches_dense_algebra_whatever_the_chunks(spark, method, monkeypatch):
    pop, y = make()
    for cells in (4_000_000, 40):
        monkeypatch.setattr(d, "CHUNK_CELLS", cells)
        got = d.fit_direction(long(spark, pop), labels(spark, y), method, 0.7, 3).collect()
        w = np.zeros((3, 6))
        for r in got:
            w[r.bin, r.unit_id] = r.weight
        for b in range(3):
            assert w[b] == pytest.approx(oracle(pop[:, b], y, method, 0.7), abs=1e-9)


def test_single_unit(spark):
    pop, y = make(units=1)
    got = d.fit_direction(long(spark, pop), labels(spark, y), n_bins=3).collect()
    assert {abs(r.weight) for r in got} == {1.0}


def test_folds_are_stratified_and_limited_by_the_smallest_class(spark):
    y = [1] * 3 + [0] * 17
    f = d.stratified_folds(labels(spark, y), 5)
    sizes = {(r.y, r.fold): r.n for r in f.groupBy("y", "fold").agg(F.count("*").alias("n")).collect()}
    assert {k[1] for k in sizes} == {0, 1, 2}
    assert sorted(sizes[1, k] for k in range(3)) == [1, 1, 1] and sorted(sizes[0, k] for k in range(3)) == [5, 6, 6]


def test_label_sets_keep_class_sizes_and_differ(spark):
    y = [1] * 7 + [0] * 23
    got = np.array([r.ys for r in d.with_label_sets(labels(spark, y), 70).orderBy("trial_idx").collect()])
    assert got.shape == (30, 71) and list(got[:, 0]) == y and set(got.sum(0)) == {7}
    assert len({tuple(c) for c in got.T}) > 60


@pytest.mark.parametrize("method", ["shrinkage", "ridge"])
def test_time_resolved_effects_and_p_values_match_refitting(spark, method, monkeypatch):
    monkeypatch.setattr(d, "CHUNK_CELLS", 60)
    pop, y = make(4)
    n_perm, reg = 70, 1.0
    folds = d.stratified_folds(labels(spark, y), 5).persist()
    solved = d.solve_time_resolved(long(spark, pop), folds, 3, method, reg, n_perm).persist()
    sets = np.array([r.ys for r in d.with_label_sets(folds, n_perm).orderBy("trial_idx").collect()]).T
    fold = np.array([r.fold for r in folds.orderBy("trial_idx").collect()])

    def run(yy, b):
        proj, ws = np.zeros(len(yy)), []
        for k in np.unique(fold):
            w = oracle(pop[fold != k, b], yy[fold != k], method, reg)
            ws.append(w)
            proj[fold == k] = pop[fold == k, b] @ w
        return proj, proj[yy == 1].mean() - proj[yy == 0].mean(), np.mean(ws, axis=0)

    eff = {r.bin: r for r in d.effects(solved).collect()}
    mean_w = {(r.bin, r.unit_id): r.weight for r in d.mean_directions(solved).collect()}
    held = {(r.trial_idx, r.bin): r.proj for r in d.held_out_projections(long(spark, pop), folds, solved).collect()}
    for b in range(3):
        proj, effect, w = run(sets[0], b)
        perm = np.array([run(s, b)[1] for s in sets[1:]])
        assert eff[b].effect == pytest.approx(effect, abs=1e-9)
        assert eff[b].p_value == pytest.approx((np.sum(np.abs(perm) >= abs(effect)) + 1) / (n_perm + 1))
        assert [mean_w[b, u] for u in range(6)] == pytest.approx(list(w), abs=1e-9)
        assert all(held.get((t, b), 0.0) == pytest.approx(proj[t], abs=1e-9) for t in range(len(y)))
    assert eff[1].p_value < 0.05


def test_effect_is_found_where_it_was_put(spark):
    rng = np.random.default_rng(42)
    pop = rng.normal(size=(100, 20, 50))
    y = (np.arange(100) >= 50).astype(int)
    pop[np.ix_(y == 1, range(8, 13), range(15))] += 3.0
    folds = d.stratified_folds(labels(spark, y), 5)
    got = {r.bin: r.effect for r in d.effects(d.solve_time_resolved(long(spark, pop), folds, 20)).collect()}
    best = sorted(got, key=got.get)[-5:]
    assert sorted(best) == [8, 9, 10, 11, 12] and min(got[b] for b in best) - max(got[b] for b in got if b not in best) > 0.15


def test_mean_difference_direction_and_projection(spark):
    rng = np.random.default_rng(0)
    pop = rng.normal(size=(20, 1, 5))
    pop[10:] += [1, 0, 0, 0, 0]
    cond = spark.createDataFrame([("s", i, "A" if i < 10 else "B") for i in range(20)],
                                 "session_id string, trial_idx int, cond string")
    df = long(spark, pop)
    u = df.select("session_id", "unit_id").distinct()
    w = population.mean_direction(population.condition_average(df, cond, u), "A", "B")
    want = pop[10:, 0].mean(0) - pop[:10, 0].mean(0)
    want /= np.linalg.norm(want)
    assert [r.weight for r in w.orderBy("unit_id").collect()] == pytest.approx(list(want))
    proj = {r.trial_idx: r.proj for r in population.project(df, w, ["trial_idx"]).collect()}
    assert [proj[i] for i in range(20)] == pytest.approx(list(pop[:, 0] @ want))


def test_a_session_of_one_class_stays_whatever_the_permutations(spark):
    pop, y = make(4)
    one = long(spark, pop).unionByName(long(spark, pop).withColumn("session_id", F.lit("only")))
    tags = labels(spark, y).unionByName(labels(spark, [0] * len(y)).withColumn("session_id", F.lit("only")))
    folds = d.stratified_folds(tags, 5)
    for n in (0, 5):
        got = d.effects(d.solve_time_resolved(one, folds, 3, n_permutations=n)).collect()
        assert {(r.session_id, r.bin) for r in got} == {(s, b) for s in ("s", "only") for b in range(3)}
        alone = [r for r in got if r.session_id == "only"]
        assert all(r.effect is None and r.mean1 is None and r.p_value is None and r.mean0 == 0.0 for r in alone)
        assert all((r.p_value is None) == (n == 0) for r in got if r.session_id == "s")


def test_population_is_dealt_out_in_more_parts_as_it_grows(spark, monkeypatch):
    from trigflow.operators import running
    from trigflow.plans import tables

    def sorted_rows():
        return sorted(map(tuple, tables.population(spark, "/root/testdata/sf0.001").collect()))

    few = sorted_rows()
    monkeypatch.setattr(running, "PART_ROWS", 500)
    pop = tables.population(spark, "/root/testdata/sf0.001")
    assert "REPARTITION_BY_NUM" in pop._jdf.queryExecution().executedPlan().toString()
    assert few == sorted_rows()
