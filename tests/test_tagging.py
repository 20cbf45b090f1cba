import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trigflow.functions.scalars import poisson_upper_tail, response_class, waveform_class
from trigflow.operators import tagging

US = 1_000_000
PT, TR = "session_id string, unit_id int, t_us bigint", "session_id string, trigger_id int, t_us bigint"


def laser(spark, rises, falls, durs, session="s"):
    return spark.createDataFrame([(session, i, float(r), float(f), float(d)) for i, (r, f, d) in
                                  enumerate(zip(rises, falls, durs))],
                                 "session_id string, event_idx int, rise double, fall double, duration double")


def test_pulses_in_samples_and_in_seconds(spark):
    samples = laser(spark, [30_000, 60_000, 90_000], [30_300, 60_300, 90_300], [0.01] * 3)
    p = tagging.pulse_table(samples).orderBy("event_idx").collect()
    assert [r.onset_s for r in p] == pytest.approx([1.0, 2.0, 3.0]) and p[0].sample_rate == pytest.approx(30_000)
    assert p[0].offset_samples == 30_300 and p[1].t_us == 2 * US
    early = laser(spark, [0.5, 0.7], [0.51, 0.71], [0.01] * 2)
    p = tagging.pulse_table(early).orderBy("event_idx").collect()
    assert [r.onset_s for r in p] == [0.5, 0.7] and p[0].onset_samples == 15_000
    # Seconds past 10 look like samples; the rate then comes out near one and heals it.
    late = laser(spark, [20.0, 25.0], [20.01, 25.01], [0.01] * 2)
    assert tagging.pulse_table(late).orderBy("event_idx").first().onset_s == pytest.approx(20.0)
    assert tagging.pulse_table(late, 30_000, "seconds").orderBy("event_idx").first().onset_s == 20.0


def test_blocks(spark):
    def blocks(onsets):
        df = spark.createDataFrame([("s", i, float(t)) for i, t in enumerate(onsets)],
                                   "session_id string, event_idx int, onset_s double")
        return [r.block_id for r in tagging.pulse_blocks(df).orderBy("event_idx").collect()]

    assert blocks(np.arange(1002) * 0.1) == [0] * 501 + [1] * 501
    assert blocks([0, 1, 4, 5]) == [0, 0, 1, 1]
    assert blocks([0, 1, 4, 5, 8]) == [0, 0, 1, 1, 1]  # the first of equal gaps
    assert blocks([0, 1, 2.5]) == [0, 0, 0] and blocks([3]) == [0]


def test_spike_times_in_samples(spark):
    rows = [("a", 1, 30_000.0), ("a", 1, 60_000.0), ("a", 2, 5.0), ("b", 1, 3.0), ("b", 1, 5000.0), ("c", 1, 100.0),
            ("c", 1, 1800.0)]
    df = spark.createDataFrame(rows, "session_id string, unit_id int, t double")
    rates = df.select("session_id").distinct().withColumn("sample_rate", F.lit(30_000.0))
    got = sorted((r.session_id, r.t_us) for r in tagging.spikes_in_ticks(df, rates).collect())
    # a: median 30000; b: median 2501.5 by its two middle values; c: median 950.
    assert got == sorted([("a", US), ("a", 2 * US), ("a", 167), ("b", 100), ("b", 166_667), ("c", 100 * US), ("c", 1800 * US)])


@pytest.mark.parametrize("method", ["pairs", "ranks"])
def test_unit_table_against_loops(spark, method):
    rng = np.random.default_rng(0)
    onsets = np.round(np.sort(rng.uniform(1, 59, 40)), 3)
    spikes = {1: np.concatenate([onsets[:30] + 0.004, rng.uniform(0, 60, 200)]), 2: rng.uniform(0, 60, 100),
              3: np.array([0.0, 60.0])}
    spikes = {u: np.round(t * US).astype(int) for u, t in spikes.items()}
    on = np.round(onsets * US).astype(int)
    p = spark.createDataFrame([("s", u, int(t)) for u, ts in spikes.items() for t in ts], PT)
    t = spark.createDataFrame([("s", i, int(x)) for i, x in enumerate(on)], TR)
    shapes = spark.createDataFrame([("s", 1, 200.0, 600.0)],
                                   "session_id string, unit_id int, peak_width_us double, peak_valley_us double")
    got = {r.unit_id: r for r in tagging.units_table(
        p, t, p.select("session_id", "unit_id").distinct(), shapes, 30, method=method).collect()}
    null = {(r.iter, r.trigger_id): r.t_us for r in tagging.null_onsets(p, t, 30).collect()}
    assert min(null.values()) >= 100_000 and max(null.values()) <= 60 * US - 100_000
    for u, ts in spikes.items():
        ev = [np.sum((ts >= x) & (ts <= x + 10_000)) for x in on]
        bl = [np.sum((ts >= x - 100_000) & (ts < x)) for x in on]
        lat = [min(ts[(ts >= x) & (ts <= x + 10_000)] - x) / 1000 for x, n in zip(on, ev) if n]
        r = got[u]
        assert (r.n_pulses, r.total_evoked) == (40, sum(ev))
        assert r.reliability == pytest.approx(np.mean(np.array(ev) > 0))
        assert r.evoked_count_std == pytest.approx(np.std(ev), abs=1e-9)
        assert r.baseline_rate_hz == pytest.approx(np.mean(bl) / 0.1)
        drawn = [sum(np.sum((ts >= null[i, k]) & (ts <= null[i, k] + 10_000)) for k in range(40)) for i in range(30)]
        assert r.p_permutation == pytest.approx(np.mean(np.array(drawn) >= sum(ev)))
        if lat:
            assert r.mean_latency_ms == pytest.approx(np.mean(lat))
            assert (r.latency_p10_ms, r.latency_p50_ms) == pytest.approx(tuple(np.percentile(lat, [10, 50])))
        else:
            assert r.mean_latency_ms is None and r.latency_p50_ms is None
    assert got[1].classification == "opto" and got[3].classification == "none"
    assert got[1].wf_class == "SPN" and got[2].wf_class is None


def test_short_recordings_and_top_units(spark):
    p = spark.createDataFrame([("s", 1, 0), ("s", 1, 150_000)], PT)
    t = spark.createDataFrame([("s", 0, 0)], TR)
    u = p.select("session_id", "unit_id").distinct()
    assert tagging.permutation_p(p, t, u, 5, method="pairs").first().p_permutation == 1.0
    m = spark.createDataFrame([("s", i, r, "opto" if i == 9 else "none") for i, r in
                               ((3, 0.5), (1, 0.5), (2, 0.9), (9, 0.1))],
                              "session_id string, unit_id int, reliability double, classification string")
    assert [r.unit_id for r in tagging.top_units(m, 2).orderBy("rank").collect()] == [2, 1]
    assert {r.unit_id for r in tagging.tagged_or_top(m, 2).collect()} == {1, 2, 9}


def test_poisson_tail(spark):
    def exact(k, lam):
        if k == 0:
            return 1.0
        if lam == 0:
            return 0.0
        term = lambda i: math.exp(i * math.log(lam) - lam - math.lgamma(i + 1))
        return math.fsum(term(i) for i in range(k, k + 3000)) if k > lam else 1 - math.fsum(term(i) for i in range(k))

    cases = [(0, 2.0), (3, 0.0), (1, 1e-4), (5, 2.5), (40, 3.0), (10, 30.0), (500, 480.0), (450, 480.0), (2000, 1500.0)]
    df = spark.createDataFrame(cases, "k int, lam double")
    got = {(r.k, r.lam): r.p for r in df.withColumn("p", poisson_upper_tail(F.col("k"), F.col("lam"))).collect()}
    for k, lam in cases:
        assert got[k, lam] == pytest.approx(exact(k, lam), rel=1e-8, abs=1e-300)


def test_class_rules(spark):
    df = spark.createDataFrame([(160.0, 600.0, 5.0), (100.0, 300.0, 2.0), (160.0, 300.0, 5.0), (100.0, 300.0, 0.05)],
                               "w double, v double, f double")
    assert [r[0] for r in df.select(waveform_class(df.w, df.v, df.f)).collect()] == ["SPN", "FSI", "Other", "Other"]
    df = spark.createDataFrame([(6.0, 0.5), (6.1, 0.9), (2.0, 0.4), (None, 0.9)], "l double, r double")
    assert [r[0] for r in df.select(response_class(df.l, df.r)).collect()] == ["opto", "none", "none", "none"]


def test_draws_are_the_hash_of_session_draw_and_pulse(spark):
    from pyspark.sql import functions as F
    from trigflow.operators.tagging import draws_of, hash60

    for session, pulse in (("a", "7"), ("é", "12"), ("3", None)):
        rows = spark.range(5).select(hash60(F.lit(session), F.col("id"), F.lit(pulse)).alias("h"), "id").orderBy("id").collect()
        assert [r.h for r in rows] == draws_of(session, 5, pulse).tolist()
