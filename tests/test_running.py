import numpy as np
import pytest
from pyspark.sql import functions as F

from trigflow.operators import running


@pytest.fixture(scope="module", autouse=True)
def compiled(spark):
    """This module runs compiled plans, as users do."""
    names = {"spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "FALLBACK"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_exact_percentiles_follow_linear_interpolation(spark):
    rng = np.random.default_rng(0)
    data = {"a": rng.integers(0, 10_000, 501), "b": rng.integers(0, 7, 40), "c": np.array([5])}
    df = spark.createDataFrame([(k, int(v)) for k, vs in data.items() for v in vs], "g string, v bigint")
    probs = {"p10": 0.1, "p50": 0.5, "p95": 0.95}
    for cell in (None, F.shiftright("v", 6)):
        got = {r.g: r for r in running.exact_percentiles(df, ["g"], "v", probs, cell).collect()}
        for k, vs in data.items():
            for name, p in probs.items():
                assert got[k][name] == pytest.approx(np.percentile(vs, 100 * p))


def test_row_rank_and_ntile_match_the_sql_functions(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(str(i % 3), i, int(v)) for i, v in enumerate(rng.integers(0, 1 << 30, 200))],
                               "k string, id int, v bigint")
    got = running.row_rank(df, ["k"], ["v", "id"], F.shiftright("v", 26))
    n = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = got.join(n, "k").withColumn("tile", running.ntile_of(F.col("rank"), F.col("n"), F.lit(7)))
    got.createOrReplaceTempView("ranked")
    bad = spark.sql("""SELECT * FROM (SELECT rank, tile, row_number() OVER (PARTITION BY k ORDER BY v, id) AS r,
        ntile(7) OVER (PARTITION BY k ORDER BY v, id) AS t FROM ranked) WHERE rank <> r OR tile <> t""")
    assert bad.count() == 0


def test_running_sums_cross_cells(spark):
    xs = [1, 5, 1 << 21, (1 << 21) + 3, 1 << 25]
    df = spark.createDataFrame([("k", x, i + 1) for i, x in enumerate(xs)], "k string, x bigint, v bigint")
    got = running.running_sums(df, ["k"], "x", {"s": "v"}).orderBy("x")
    assert [r.s for r in got.collect()] == [1, 3, 6, 10, 15]


def test_heavy_cells_are_few_and_salted_probes_stay_exact(spark, monkeypatch):
    monkeypatch.setattr(running, "HEAVY_MIN_ROWS", 10)
    counts = spark.createDataFrame([(i, 1) for i in range(1000)] + [(5000, 900)], "cell bigint, n bigint")
    heavy = running.heavy_cells(counts, ["cell"], min_rows=10).collect()
    assert [r.cell for r in heavy] == [5000] and heavy[0].salts == 90

    marks = spark.createDataFrame([("k", x, 1) for x in range(0, 3000, 7)], "k string, x bigint, n bigint")
    probes = spark.createDataFrame([("k", x, x) for x in range(-5, 3000)], "k string, x bigint, id bigint")
    real = running.heavy_cells
    monkeypatch.setattr(running, "heavy_cells", lambda c, by: real(c, by, min_rows=10))
    got = running.marks_up_to(marks, probes, ["k"], 5, with_next=True).collect()
    assert len(got) == 3005
    for r in got:
        assert r["rank"] == sum(1 for m in range(0, 3000, 7) if m <= r.id)
        later = [m for m in range(0, 3000, 7) if m > r.id]
        assert r.next_x == (later[0] if later else None)


def test_an_outlier_does_not_gather_the_rest_in_one_cell(spark):
    rng = np.random.default_rng(2)
    values = [float(v) for v in rng.uniform(0, 1, 5000)] + [1e9]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0)] * 7, "k string, v double")
    wanted = spark.createDataFrame([("a", "mid", 2500), ("a", "last", 5001), ("b", "one", 3)], "k string, tag string, k2 int").withColumnRenamed("k2", "k_")
    wanted = wanted.select(F.col("k").alias("key"), "tag", F.col("k_").alias("k"))
    got = {r.tag: r.value for r in running.kth_smallest(df.withColumnRenamed("k", "key"), ["key"], "v", wanted).collect()}
    assert got == {"mid": sorted(values)[2499], "last": 1e9, "one": 1.0}


def test_intervals_of_slow_and_fast_units(spark):
    from trigflow.operators.units import inter_point_intervals

    rng = np.random.default_rng(3)
    fast = np.unique(rng.integers(0, 10**9, 3000))
    slow = np.unique(rng.integers(0, 10**13, 40))
    df = spark.createDataFrame([("s", u, int(t)) for u, ts in ((1, fast), (2, slow)) for t in ts] + [("s", 3, 5), ("s", 3, 5)],
                               "session_id string, unit_id int, t_us bigint")
    want = {}
    for u, ts in ((1, fast), (2, slow), (3, np.array([5, 5]))):
        for d in np.diff(ts).tolist():
            want[u, d] = want.get((u, d), 0) + 1
    for per_cell in (4096, 50):
        got = {(r.unit_id, r.isi_us): r.n for r in inter_point_intervals(df, per_cell).collect()}
        assert got == want


def test_an_outlier_gathers_no_unit_in_one_cell(spark):
    from trigflow.operators import units

    rng = np.random.default_rng(4)
    times = np.unique(np.r_[rng.integers(0, 10**6, 6000), 10**15])  # all but one point in a billionth of the time
    df = spark.createDataFrame([("s", 1, int(t)) for t in times], "session_id string, unit_id int, t_us bigint")
    want = {}
    for d in np.diff(times).tolist():
        want[d] = want.get(d, 0) + 1
    assert {r.isi_us: r.n for r in units.inter_point_intervals(df, 100).collect()} == want
    cells = units.in_cells(df, 100).groupBy("cell").agg(F.count("*").alias("n"), F.min("t_us").alias("a"), F.max("t_us").alias("z"))
    rows = cells.orderBy("cell").collect()
    assert max(r.n for r in rows) <= 300 and all(x.z < y.a for x, y in zip(rows, rows[1:]))
