import numpy as np

from trigflow.operators import population, trials

US = 1_000_000
TRIALS = "session_id string, trial_idx int, outcome string, reactiontimes map<string,double>, change_time double"
CH = "session_id string, channel string, event_idx int, rise_us bigint"


def tables(spark):
    rows = [
        ("s", 0, "Hit", {"RT": 0.5}, 1.0), ("s", 1, "Miss", {"Miss": 2.15}, None), ("s", 2, "FA", {"FA": 3.0}, 2.0),
        ("s", 3, "abort", {"abort": 1.0}, 1.0), ("s", 4, "Hit", {"RT": float("nan")}, 1.0), ("s", 5, "Ref", {}, None),
        ("s", 6, "FA", {}, None), ("s", 7, "Hit", {"RT": 0.5}, 1.0),
    ]
    base = [("s", "Baseline_ON", i, 5 * US) for i in range(7)]
    change = [("s", "Change_ON", i, 10 * US) for i in range(2)] + [("s", "Change_ON", 4, 10 * US), ("s", "Change_ON", 7, 10 * US)]
    return spark.createDataFrame(rows, TRIALS), spark.createDataFrame(base + change, CH)


def test_event_times(spark):
    t, ch = tables(spark)
    got = {r.trial_idx: r.e for r in trials.with_rises(t, ch).select("trial_idx", trials.event_time().alias("e")).collect()}
    assert got == {0: 10_300_000, 1: 12_150_000, 2: 7_800_000, 3: 6_000_000, 4: None, 5: None, 6: None, 7: None}


def test_event_triggers_keep_null_rises_of_a_channel(spark):
    t, ch = tables(spark)
    ch = ch.union(spark.createDataFrame([("s", "Change_ON", 9, None)], CH))
    assert trials.event_triggers(t, ch, "Change_ON").count() == 5
    assert [r.t_us for r in trials.event_triggers(t, ch, "Hit").collect()] == [10_300_000]


def test_outcome_groups(spark):
    df = spark.createDataFrame([("Hit", None), ("FA", 3.5), ("FalseAlarm", 3.0), ("FA", None), ("FA", float("nan")),
                                ("early_Abort", None), ("Miss", 1.0), ("Ref", 1.0)], "outcome string, lat double")
    got = [r[0] for r in df.select(trials.outcome_group(df.lat)).collect()]
    assert got == ["Hit", "FA>3s", "FA<=3s", None, None, "Abort", "Miss", None]


def test_baseline_windows_clamp_and_strict(spark):
    t, ch = tables(spark)
    w = {r.trial_idx: r for r in trials.baseline_windows(t, ch, 20_000).collect()}
    # Hit: change at +5 s, one second dropped; FA: 7.8 - 1 - 5 - 1 = 0.8 s; abort: -1 s, held at one bin.
    assert (w[0].usable_us, w[0].n_end_bins, w[0].valid) == (4 * US, 200, True)
    assert (w[2].usable_us, w[2].n_end_bins) == (800_000, 40)
    assert (w[3].usable_us, w[3].n_end_bins, w[3].valid) == (-US, 1, False)
    assert w[5].n_end_bins == 0 and 7 not in w
    strict = {r.trial_idx: r.n_end_bins for r in trials.baseline_windows(t, ch, 20_000, strict=True).collect()}
    assert strict[3] == 0 and strict[0] == 200


def test_baseline_means(spark):
    t, ch = tables(spark)
    p = spark.createDataFrame([("s", 1, 6_000_000), ("s", 1, 6_799_999), ("s", 1, 6_800_000), ("s", 1, 5_999_999)],
                              "session_id string, unit_id int, t_us bigint")
    u = spark.createDataFrame([("s", 1), ("s", 2)], "session_id string, unit_id int")
    w = trials.baseline_windows(t, ch, 20_000).where("trial_idx = 2")
    got = {r.unit_id: r.rate for r in trials.baseline_unit_means(p, w, u, 20_000).collect()}
    assert got == {1: 2 / 0.8, 2: 0.0}


def test_t_tests(spark):
    import pytest

    values = spark.createDataFrame(
        [("s", g, float(v)) for g, vs in {"A": [1, 2, 3, 4, 7], "B": [2, 5, 9, 11], "C": [4, 4], "D": [5, 5], "E": [1]}.items()
         for v in vs], "session_id string, grp string, value double")
    got = {(r.group_a, r.group_b): r for r in population.welch_t(values).collect()}
    # Means 3.4 and 6.75, variances 5.3 and 16.25: t = -3.35 / sqrt(1.06 + 4.0625).
    assert got["A", "B"].t_stat == pytest.approx(-1.480147, abs=1e-5)
    assert got["A", "B"].df == pytest.approx(5.1225 ** 2 / (1.06 ** 2 / 4 + 4.0625 ** 2 / 3))
    assert got["A", "A"].t_stat is None and got["A", "E"].p_value is None
    assert got["C", "D"].t_stat == float("-inf") and got["C", "D"].p_value == 0.0
    assert got["A", "B"].p_value == got["B", "A"].p_value


def test_paired_t_zero_variance_and_plain(spark):
    import pytest

    pop = spark.createDataFrame([("s", i, 1, u, r) for u, rs in {1: [1.0, 2.0, 4.0, 3.0], 2: [2.0] * 4}.items()
                                 for i, r in enumerate(rs)],
                                "session_id string, trial_idx int, bin int, unit_id int, rate double")
    t = spark.createDataFrame([("s", i) for i in range(4)], "session_id string, trial_idx int")
    u = spark.createDataFrame([("s", i) for i in (1, 2, 3)], "session_id string, unit_id int")
    got = {r.unit_id: r for r in population.paired_t(pop, t, u, [0], [1]).collect()}
    assert got[1].t_stat == pytest.approx(2.5 / (1.2909944487 / 2))
    assert got[1].p_value == pytest.approx(0.0305, abs=2e-4) and not got[1].is_responsive
    assert got[2].t_stat == float("inf") and got[2].p_value == 0.0 and got[2].is_responsive
    assert got[3].t_stat is None and got[3].p_value is None and not got[3].is_responsive


def test_t_probability_against_known_quantiles():
    import pytest

    from trigflow.functions.tdist import t_two_sided

    for t, df, p in [(12.706205, 1, 0.05), (2.228139, 10, 0.05), (2.750, 30, 0.01), (1.959964, 1e7, 0.05)]:
        assert t_two_sided(t, df) == pytest.approx(p, rel=2e-3)
    assert t_two_sided(0.0, 5) == pytest.approx(1.0) and np.isnan(t_two_sided(None, 3)[0])


def test_span_counts_form_no_pair(spark, monkeypatch):
    """Counts like those of the pairs, for crowded, long, empty and parted slabs; spans without points stay."""
    from pyspark.sql import functions as F

    from trigflow.operators import align

    rnd = np.random.default_rng(5)
    points = [("ab"[i % 2], int(u), int(t)) for i, (u, t) in enumerate(zip(rnd.integers(1, 5, 1200), rnd.integers(-US, 300 * US, 1200)))]
    points += [("a", 9, 5 * US), ("a", 2, None), (None, 1, 5 * US)]
    spans = [("ab"[k % 2], k, 1, lo, lo + int(n)) for k, (lo, n) in enumerate(zip(
        rnd.integers(-US, 300 * US, 300).tolist(), rnd.choice([0, 9_999, 16 * US, 40 * US, 290 * US], 300)))]
    spans += [("a", 900, 1, 10**15, 10**15 + 5), ("c", 901, 1, 0, 9)]
    p = spark.createDataFrame(points, "session_id string, unit_id int, t_us bigint")
    s = spark.createDataFrame(spans, "session_id string, trigger_id int, n_end_bins int, lo_us bigint, hi_us bigint")
    index = population.dense_unit_index(p.where("unit_id < 9 and session_id is not null"))
    units = {(r.session_id, r.u): r.unit_id for r in index.collect()}
    want = {(r.session_id, r.trigger_id, r.unit_id): r.n for r in align.variable_range_join(p.where("unit_id < 9"), s)
            .groupBy("session_id", "trigger_id", "unit_id").agg(F.count("*").alias("n")).collect()}
    monkeypatch.setattr(align, "SPAN_ROWS", 100)
    monkeypatch.setattr(align, "SPAN_COUNTS", 30)
    for limit in (500_000, 40):
        monkeypatch.setattr(align, "SLAB_POINTS", limit)
        monkeypatch.setattr(align, "SLAB_TRIGGERS", limit)
        out = align.span_counts(p, s, index)
        rows = out.collect()
        assert sorted(r.trigger_id for r in rows) == sorted(x[1] for x in spans)
        assert {(r.session_id, r.trigger_id, units[r.session_id, u]): n
                for r in rows for u, n in enumerate(r.counts) if n} == want


def test_joins_with_trials_are_dealt_out_by_rows(spark, monkeypatch):
    """The parts of a join with the trials grow with the trials, and change no result."""
    import pytest

    from trigflow.operators import running

    monkeypatch.setattr(running, "PART_ROWS", 10)
    t = spark.createDataFrame([("s", i, "AB"[i % 2], "AB"[i % 2]) for i in range(120)],
                              "session_id string, trial_idx int, cond string, grp string")
    pop = spark.createDataFrame([("s", i, i % 3, u, float(i + u)) for i in range(100) for u in (1, 2)],
                                "session_id string, trial_idx int, bin int, unit_id int, rate double")
    proj = pop.groupBy("session_id", "trial_idx", "bin").sum("rate").withColumnRenamed("sum(rate)", "proj")
    averages = population.condition_average(pop, t, pop.select("session_id", "unit_id").distinct(), 3)
    curve, scalar = population.group_curve(proj, t, 3), population.trial_scalar(proj, t, [0, 1])
    for df, parts in ((averages, 48), (curve, 48), (scalar, 12)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression [session_id" in plan and f", {parts}" in plan
    got = {(r.cond, r.unit_id): r.avg_rate for r in averages.collect()}
    assert got["A", 1] == pytest.approx(sum(i + 1 for i in range(0, 100, 2)) / 180)
    assert sum(r.value for r in scalar.collect()) == pytest.approx(sum(2 * i + 3 for i in range(100) if i % 3 < 2) / 2)
    assert {(r.grp, r.bin): r.n for r in curve.collect()} == {(g, b): 60 for g in "AB" for b in range(3)}
