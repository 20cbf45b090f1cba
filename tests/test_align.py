import numpy as np
import pytest
from pyspark.sql import functions as F

from trigflow.functions.ticks import bin_grid
from trigflow.operators import align
from trigflow.operators.units import inter_point_intervals, unit_quality

US = 1_000_000
PT, TR = "session_id string, unit_id int, t_us bigint", "session_id string, trigger_id int, t_us bigint"


def points(spark, rows):
    return spark.createDataFrame([(s, u, round(t * US)) for s, u, t in rows], PT)


def triggers(spark, rows):
    return spark.createDataFrame([(s, i, None if t is None else round(t * US)) for s, i, t in rows], TR)


def reference_counts(pts, trg, grid):
    out = {}
    for s, u, t in pts:
        for s2, _, t0 in trg:
            if s == s2 and t0 is not None:
                d = round(t * US) - round(t0 * US)
                if grid.lo <= d <= grid.hi:
                    k = int(np.searchsorted(grid.bounds, d, side="right")) - 1
                    out[s, u, k] = out.get((s, u, k), 0) + 1
    return out


def test_bin_counts_match_the_usual_windows():
    assert bin_grid((-0.5, 1.0), 0.01).n_bins == 150
    assert bin_grid((-0.5, 1.0), 0.02).n_bins == 75
    assert bin_grid((-0.1, 0.05), 0.001).n_bins == 150
    assert bin_grid((1.0, 3.37), 0.02).n_bins == 119
    assert sum(c <= 0 for c in bin_grid((-0.5, 1.0), 0.02).centers) == 25


def test_float_edges_drop_a_point_on_the_far_end():
    at_end = US
    assert bin_grid((-0.5, 1.0), 0.05).hi == at_end
    assert bin_grid((-0.5, 1.0), 0.05, edges="float").hi < at_end
    assert bin_grid((-0.5, 1.0), 0.01, edges="float").hi == at_end


def test_closed_window(spark):
    p = points(spark, [("a", 1, t) for t in (9.5, 10.0, 11.0, 11.01)])
    got = align.range_join(p, triggers(spark, [("a", 0, 10.0)]), -US // 2, US)
    assert sorted(r.rel_us for r in got.collect()) == [-US // 2, 0, US]


@pytest.mark.parametrize("method", ["pairs", "ranks"])
def test_silent_null_and_overlapping_triggers(spark, method):
    p = points(spark, [("a", 1, 0.1), ("b", 1, 1.5), ("c", 1, 0.15), ("d", 1, 5.0)])
    t = triggers(spark, [("a", 0, 0.0), ("a", 1, 100.0), ("b", 0, 1.0), ("b", 1, None), ("c", 0, 0.0), ("c", 1, 0.1)])
    u = spark.createDataFrame([(s, 1) for s in "abcd"] + [("a", 2)], "session_id string, unit_id int")
    rows = align.peth(p, t, u, bin_grid((-0.5, 1.0), 0.5), method).collect()
    rate = {}
    for r in rows:
        rate.setdefault((r.session_id, r.unit_id), [0.0] * 3)[r.bin] = r.rate_hz
    n = {r.session_id: r.n_trials for r in rows}
    assert n == {"a": 2, "b": 2, "c": 2, "d": 0}
    assert rate["a", 1] == [0.0, 1.0, 0.0] and rate["a", 2] == [0.0] * 3
    assert rate["b", 1] == [0.0, 0.0, 1.0] and rate["c", 1] == [0.0, 2.0, 0.0] and rate["d", 1] == [0.0] * 3


@pytest.mark.parametrize("edges", ["ticks", "float"])
def test_both_counting_methods_agree_with_brute_force(spark, edges):
    rng = np.random.default_rng(3)
    # A third of the points and triggers sit in one short burst; times repeat.
    def times(n):
        t = rng.uniform(0, 200, n)
        t[: n // 3] = 77 + rng.integers(0, 40, n // 3) / 100
        return np.round(t, 2)

    pts = [(str(s), int(u), float(t)) for s, u, t in zip(rng.integers(0, 2, 400), rng.integers(0, 3, 400), times(400))]
    trg = [(str(s), i, float(t)) for i, (s, t) in enumerate(zip(rng.integers(0, 2, 60), times(60)))]
    grid = bin_grid((-0.5, 1.0), 0.05, edges)
    want = reference_counts(pts, trg, grid)
    few, many = align.split_by_density(points(spark, pts), triggers(spark, trg), grid.lo, grid.hi, 3)
    assert few.count() and many.count()
    for method in ("pairs", "ranks", "auto"):
        got = align.pair_counts(points(spark, pts), triggers(spark, trg), grid, method, 3)
        assert {(r.session_id, r.unit_id, r.bin): r.n_pairs for r in got.collect()} == want


def test_window_counts_methods_agree(spark):
    rng = np.random.default_rng(5)
    pts = [("s", int(u), float(t)) for u, t in zip(rng.integers(0, 3, 300), np.round(rng.uniform(0, 60, 300), 2))]
    trg = [("s", i, float(t)) for i, t in enumerate(np.round(rng.uniform(0, 60, 40), 2))]
    got = [
        sorted(map(tuple, align.window_counts(points(spark, pts), triggers(spark, trg), -US // 10, US // 2,
                                              ["trigger_id"], method=m).collect()))
        for m in ("pairs", "ranks")
    ]
    want = []
    for u in range(3):
        for _, i, t0 in trg:
            d = [round(t * US) - round(t0 * US) for _, v, t in pts if v == u]
            d = [x for x in d if -US // 10 <= x <= US // 2]
            if d:
                want.append(("s", u, i, len(d), min(d)))
    assert got[0] == got[1] == sorted(want)


def test_shift_and_repartition_leave_counts_alone(spark):
    rng = np.random.default_rng(1)
    pts = [("s", int(u), float(t)) for u, t in zip(rng.integers(0, 4, 200), np.round(rng.uniform(0, 30, 200), 3))]
    trg = [("s", i, float(t)) for i, t in enumerate(np.round(rng.uniform(0, 30, 20), 3))]
    grid = bin_grid((-1.0, 1.0), 0.1)

    def run(shift, parts):
        p = points(spark, [(s, u, t + shift) for s, u, t in pts]).repartition(parts)
        t = triggers(spark, [(s, i, x + shift) for s, i, x in trg]).repartition(parts)
        return sorted(map(tuple, align.pair_counts(p, t, grid).collect()))

    assert run(0, 1) == run(1000, 7)


def test_trials_matrix_sums_to_the_pairs(spark):
    rng = np.random.default_rng(2)
    pts = [("s", int(u), float(t)) for u, t in zip(rng.integers(0, 4, 200), np.round(rng.uniform(0, 30, 200), 3))]
    trg = [("s", i, float(t)) for i, t in enumerate(np.round(rng.uniform(0, 30, 20), 3))]
    grid = bin_grid((-1.0, 1.0), 0.1)
    m = align.trials_matrix(points(spark, pts), triggers(spark, trg), grid)
    n = align.range_join(points(spark, pts), triggers(spark, trg), grid.lo, grid.hi).count()
    assert m.agg(F.sum("n_points")).first()[0] == n
    assert m.agg(F.sum("rate_hz")).first()[0] == pytest.approx(n / 0.1)


def test_smoothing_matches_a_direct_convolution(spark):
    n, sigma = 9, 1.3
    values = np.random.default_rng(0).normal(size=n)
    df = spark.createDataFrame([("s", 1, k, float(v)) for k, v in enumerate(values)],
                               "session_id string, unit_id int, bin int, rate_hz double")
    got = [r.smoothed for r in align.smooth_bins(df, sigma, n).orderBy("bin").collect()]
    radius = int(4 * sigma + 0.5)
    kern = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    kern /= kern.sum()
    padded = np.pad(values, radius, mode="symmetric")
    assert got == pytest.approx([kern @ padded[i:i + 2 * radius + 1] for i in range(n)])


def test_intervals_and_quality(spark):
    # Repeated times and gaps across the one-second cells.
    t = [0, 0.001, 0.003, 1.0, 1.0, 1.0, 7.5]
    p = points(spark, [("s", 1, x) for x in t] + [("s", 2, 3.0)])
    got = {r.isi_us: r.n for r in inter_point_intervals(p).collect()}
    assert got == {1000: 1, 2000: 1, 997_000: 1, 0: 2, 6_500_000: 1}
    q = {r.unit_id: r for r in unit_quality(p).collect()}
    assert q[1].isi_violations_count == 3 and q[1].isi_violations_frac == pytest.approx(0.5)
    assert q[1].mean_rate_hz == pytest.approx(7 / 7.5)
    assert (q[2].isi_violations_count, q[2].isi_violations_frac) == (0, 0.0)
    single = unit_quality(points(spark, [("s", 1, 3.0)])).first()
    assert single.mean_rate_hz == 1.0


def test_good_unit_choice(spark):
    u = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "session_id string, unit_id int")
    s = spark.createDataFrame([("a", [2]), ("b", [])], "session_id string, good_unit_ids array<int>")
    as_set = lambda df: {tuple(r) for r in df.collect()}
    assert as_set(align.good_units(u, s)) == {("a", 2), ("b", 1)}
    assert as_set(align.good_units(u, s, use_good_only=False)) == {("a", 1), ("a", 2), ("b", 1)}
    assert as_set(align.good_units(u, s, explicit=u.where("unit_id = 1"))) == {("a", 1), ("b", 1)}


def test_full_slabs_are_dealt_out_and_counts_add_up(spark, monkeypatch):
    # One crowded slab of few units, one of many, triggers that repeat, and rows that cannot match.
    monkeypatch.setattr(align, "SLAB_POINTS", 40)
    monkeypatch.setattr(align, "SLAB_TRIGGERS", 25)
    rng = np.random.default_rng(11)
    pts = [("a", int(u), float(t)) for u, t in zip(rng.integers(0, 2, 300), np.round(rng.uniform(0, 70, 300), 2))]
    pts += [("b", int(u), float(t)) for u, t in zip(rng.integers(0, 99, 200), np.round(rng.uniform(-50, 200, 200), 2))]
    trg = [(s, i, float(t)) for i, (s, t) in enumerate(zip(rng.choice(["a", "b", "c"], 200), np.round(rng.uniform(0, 70, 200), 1)))]
    grid = bin_grid((-0.5, 1.0), 0.05)
    want = reference_counts(pts, trg, grid)
    odd = spark.createDataFrame([(None, 1, 5 * US), ("a", 1, None)], PT)
    got = align.pair_counts(points(spark, pts).unionByName(odd), triggers(spark, [*trg, ("a", 999, None), (None, 1, 5.0)]), grid, "ranks")
    assert {(r.session_id, r.unit_id, r.bin): r.n_pairs for r in got.collect()} == want
    n = {r.session_id: r.n_pairs for r in align.count_pairs(points(spark, pts), triggers(spark, trg), grid.lo, grid.hi).collect()}
    assert n == {s: sum(v for k, v in want.items() if k[0] == s) for s in "ab"}


@pytest.mark.parametrize("name", ["q_peth_global", "q_smooth", "q_range_pairs", "q_psth"])
def test_dense_queries_form_no_pairs(spark, name):
    from trigflow.plans.proof import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "trig_t_us" not in plan and "bucket" not in plan
