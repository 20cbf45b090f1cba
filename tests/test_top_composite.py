"""The best pairs by composite score are those of all pairs, not only of the best correlated ones."""

import numpy as np
from pyspark.sql import functions as F

from trigflow.operators import matching


def test_best_composites_of_all_pairs(spark):
    rng = np.random.default_rng(5)
    vecs = {(s, u): rng.normal(size=6).tolist() for s in (1, 2, 3) for u in range(8)}
    vecs[3, 0] = [1.0] * 6  # no correlation is defined
    for u in range(8):
        vecs[4, u] = [2.0] * 6  # nor for any pair of this session
    units = spark.createDataFrame([("m", s, u, v) for (s, u), v in vecs.items()], "subject string, session_id int, unit_id int, vec array<double>")
    waves = units.select("session_id", "unit_id", F.lit(0).alias("channel"), F.posexplode("vec").alias("sample", "value"))
    counts = {key: rng.integers(1, 5, 4) for key in vecs}
    intervals = spark.createDataFrame([(s, u, d, int(n)) for (s, u), c in counts.items() for d, n in enumerate(c)],
                                      "session_id int, unit_id int, isi_us long, n long")
    rate = {key: float(rng.integers(1, 30)) for key in vecs}
    rates = spark.createDataFrame([(s, u, r) for (s, u), r in rate.items()], "session_id int, unit_id int, mean_rate_hz double")
    want = {}
    for (s, u), v in vecs.items():
        for (t, x), z in vecs.items():
            if s < t:
                c = 0.0 if np.ptp(v) == 0 or np.ptp(z) == 0 else np.corrcoef(v, z)[0, 1]
                p, q = (np.cumsum(counts[key]) / counts[key].sum() for key in ((s, u), (t, x)))
                a, b = sorted((rate[s, u], rate[t, x]))
                want.setdefault((s, t), []).append((-round((c + 1 - abs(p - q).max() + a / b) / 3, 9), u, x))
    got = {}
    for r in matching.top_composite(units, waves, intervals, rates, 3, 4).orderBy("rank").collect():
        got.setdefault((r.session_a, r.session_b), []).append((-round(r.composite_score, 9), r.unit_a, r.unit_b))
    assert set(got) == set(want)
    for key, rows in want.items():
        assert [x[1:] for x in got[key]] == [x[1:] for x in sorted(rows)[:3]]
        assert np.allclose([x[0] for x in got[key]], [x[0] for x in sorted(rows)[:3]])
