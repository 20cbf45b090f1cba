import numpy as np
import pytest

from trigflow.operators import matching, rollup, units, waveforms
from pyspark.sql import functions as F

WF = "session_id string, unit_id int, channel int, sample int, value double"


def wave(spark, rows):
    return spark.createDataFrame([("s", u, c, i, float(v)) for u, c, vs in rows for i, v in enumerate(vs)], WF)


def test_waveform_shape(spark):
    w = wave(spark, [(1, 0, [0, 1, 4, 1, 0, -3, 0]), (1, 1, [0, 0, 1, 0, 0, 0, 0]), (2, 0, [-1, -2, -1, -3]),
                     (3, 0, [1, 2]), (3, 1, [3, 4]), (4, 0, [5, 5, 5, 1])])
    got = {r.unit_id: r for r in waveforms.waveform_shape(w).collect()}
    assert (got[1].peak_idx, got[1].valley_idx) == (2, 5)
    assert got[1].peak_width_us == pytest.approx(2 / 0.03) and got[1].peak_valley_us == pytest.approx(100.0)
    assert got[2].peak_width_us == 0.0 and got[2].peak_idx == 0
    assert (got[3].peak_idx, got[3].valley_idx) == (1, 0)  # equal ranges: the first channel
    assert got[3].peak_width_us == pytest.approx(1 / 0.03)  # half of 2 is reached at sample 0, none to the right
    assert (got[4].peak_idx, got[4].peak_width_us) == (0, pytest.approx(3 / 0.03))


def test_mean_templates_ignore_how_often_a_template_is_used(spark):
    st = spark.createDataFrame([("s", 1, 0)] * 5 + [("s", 1, 1), ("s", 2, 1), ("s", 3, 9)],
                               "session_id string, unit_id int, template_id int")
    tm = spark.createDataFrame([("s", t, 0, i, float(v)) for t, vs in ((0, [1, -5]), (1, [3, 1])) for i, v in enumerate(vs)],
                               "session_id string, template_id int, channel int, sample int, value double")
    got = {(r.unit_id, r.sample): r.value for r in waveforms.mean_templates(st, tm).collect()}
    assert got == {(1, 0): 2.0, (1, 1): -2.0, (2, 0): 3.0, (2, 1): 1.0}
    s = spark.createDataFrame([("s",)], "session_id string")
    u = spark.createDataFrame([("s", 1), ("s", 2), ("s", 3)], "session_id string, unit_id int")

    def summary(**kw):
        return {r.unit_id: (r.n_spikes, r.mean_amp, r.present) for r in waveforms.template_summary(s, u, **kw).collect()}

    assert summary(spikes=st, spike_templates=st, templates=tm) == {1: (6, 2.0, True), 2: (1, 3.0, True), 3: (1, None, True)}
    assert summary(spike_templates=st, templates=tm) == {i: (0, None, True) for i in (1, 2, 3)}
    assert summary(spikes=st) == {1: (6, None, True), 2: (1, None, True), 3: (1, None, True)}
    assert summary() == {i: (0, None, False) for i in (1, 2, 3)}
    few = spark.createDataFrame([("s", 7)], "session_id string, unit_id int")
    got = {r.unit_id: r.mean_amp for r in waveforms.template_summary(s, few, templates=tm).collect()}
    assert got == {7: 5.0, -1: 3.0}


def test_exemplars(spark):
    t = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate([5, 1, 9, 3, 7])] + [("s", 9, float("nan"))],
                              "session_id string, unit_id int, pw double")
    got = {r.pct: r.unit_id for r in waveforms.exemplars(t, "pw").collect()}
    assert got == {"p5": 1, "p25": 3, "p50": 0, "p75": 4, "p95": 2}


def test_top_matches_equal_all_pairs_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK_VALUES", 84)
    rng = np.random.default_rng(0)
    rows = [("m", s, u, [float(x) for x in rng.normal(size=12)]) for s in range(3) for u in range(20)]
    df = spark.createDataFrame(rows, "subject string, session_id int, unit_id int, vec array<double>")
    got = matching.top_matches(df, 4).collect()
    want = []
    for a in range(3):
        for b in range(a + 1, 3):
            pairs = [(-round(float(np.corrcoef(x[3], y[3])[0, 1]), 9), x[2], y[2]) for x in rows for y in rows
                     if x[1] == a and y[1] == b]
            want += [(a, b, ua, ub, i + 1) for i, (_, ua, ub) in enumerate(sorted(pairs)[:4])]
    assert sorted((r.session_a, r.session_b, r.unit_a, r.unit_b, r["rank"]) for r in got) == sorted(want)
    diag = matching.match_diagnostics(df).first()
    assert (diag.n_sessions, diag.n_pairs) == (3, 1200)
    assert diag.prob_max == pytest.approx(max(r.waveform_corr for r in got))


def test_similarity_of_pairs(spark):
    p = spark.createDataFrame([("m", "a", "b", 1, 2)], "subject string, session_a string, session_b string, unit_a int, unit_b int")
    w = spark.createDataFrame([("a", 1, 0, i, float(v)) for i, v in enumerate([1, 2, 3])]
                              + [("b", 2, 0, i, float(v)) for i, v in enumerate([2, 4, 7])], WF)
    isi = spark.createDataFrame([("a", 1, 10, 2), ("a", 1, 5_000_000, 2), ("b", 2, 10, 1), ("b", 2, 20, 3)],
                                "session_id string, unit_id int, isi_us bigint, n bigint")
    rates = spark.createDataFrame([("a", 1, 2.0), ("b", 2, 8.0)], "session_id string, unit_id int, mean_rate_hz double")
    r = matching.pair_similarity(p, w, isi, rates).first()
    assert r.waveform_corr == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 7])[0, 1])
    assert r.isi_ks == pytest.approx(0.5) and r.firing_rate_ratio == 0.25


def test_rollup_prefers_trials_and_sorts_undated_last(spark):
    stats = spark.createDataFrame(
        [(s, g, 4, m) for s in ("x", "y", "z") for g, m in (("Hit", 1.0), ("Miss", 0.5), ("FA>3s", 0.2))],
        "session_id string, grp string, n int, mean double")
    sessions = spark.createDataFrame([("x", "none"), ("y", "AB_260325"), ("z", "25042024"), ("w", "01012020")],
                                     "session_id string, session_name string")
    tr = spark.createDataFrame([("y", "Hit", 3.0), ("y", "Hit", 5.0), ("y", "FA", 9.0)],
                               "session_id string, outcome string, value double")
    got = rollup.session_rollup(sessions, stats, stats, tr, None).collect()
    assert [r.session_id for r in got] == ["z", "y", "x"]
    y = got[1]
    assert y.mean_change_hit == 4.0 and y.mean_change_miss is None and y.change_diff is None
    assert (got[0].mean_change_hit, got[0].change_diff, got[0].n_hit) == (1.0, 0.5, 4)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 0.5, 1, 2, 10, float("nan"))], "v double")
    got = [r.n for r in units.histogram(df, F.col("v"), 10).orderBy("bin").collect()]
    assert got == [2, 1, 1, 0, 0, 0, 0, 0, 0, 1]
    one = units.histogram(spark.createDataFrame([(3.0,), (3.0,)], "v double"), F.col("v"), 4).orderBy("bin").collect()
    assert (one[0].left_edge, one[-1].right_edge) == (2.5, 3.5) and [r.n for r in one] == [0, 0, 2, 0]


def test_tiles_are_bounded_and_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([("m", int(s), int(u), [float(x) for x in rng.normal(size=4)]) for s in range(3) for u in range(15)],
                               "subject string, session_id int, unit_id int, vec array<double>")
    want = sorted(map(tuple, matching.top_matches(df, 3).collect()))
    seen = []
    monkeypatch.setattr(matching, "TILE_VALUES", 90)
    for rows, corr, _ in matching._tiles(df.toPandas(), df.toPandas()):
        seen.append(corr.size)
    assert max(seen) <= 90
    got = sorted(map(tuple, matching.top_matches(df, 3).collect()))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert matching.match_diagnostics(df).first().n_pairs == 675
