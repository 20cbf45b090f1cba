"""SQL that gives the same results on the same tables."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

EV = "SELECT *, epoch_us(ts) AS t_us FROM events"


def _peth_sql(pts: str, trg: str, lo: int, hi: int, width: int, n: int) -> str:
    sec = width // 1_000_000
    return f"""
WITH ev AS ({EV}),
p AS ({pts}), t AS ({trg}),
nt AS (SELECT session_id, count(*) AS n FROM t GROUP BY session_id),
c AS (
  SELECT p.session_id, p.unit_id,
         least((p.t_us - t.t_us - ({lo})) // {width}, {n - 1}) AS bin, count(*) AS n
  FROM p JOIN t ON p.session_id = t.session_id
   AND p.t_us BETWEEN t.t_us + ({lo}) AND t.t_us + ({hi})
  GROUP BY ALL),
g AS (SELECT DISTINCT session_id, unit_id, b.bin FROM p, (SELECT unnest(range({n})) AS bin) b)
SELECT g.session_id, g.unit_id, CAST(g.bin AS INTEGER) AS bin,
       round(({lo} + (g.bin + 0.5) * {width}) / 1e6, 6) AS bin_center,
       CASE WHEN nt.n IS NULL THEN 0.0
            ELSE round(coalesce(c.n, 0) / (nt.n * {sec}.0::DOUBLE), 9) END AS rate_hz,
       CAST(coalesce(nt.n, 0) AS BIGINT) AS n_trials
FROM g LEFT JOIN c USING (session_id, unit_id, bin) LEFT JOIN nt USING (session_id)
"""


GLOBAL_PTS = "SELECT 'all' AS session_id, user_id AS unit_id, t_us FROM ev WHERE event_type <> 'purchase'"
GLOBAL_TRG = "SELECT 'all' AS session_id, event_id AS trigger_id, t_us FROM ev WHERE event_type = 'purchase'"
USER_PTS = "SELECT user_id AS session_id, event_type AS unit_id, t_us FROM ev WHERE event_type <> 'purchase'"
USER_TRG = "SELECT user_id AS session_id, event_id AS trigger_id, t_us FROM ev WHERE event_type = 'purchase'"

H = 3_600_000_000
ORACLE["q_peth_global"] = _peth_sql(GLOBAL_PTS, GLOBAL_TRG, -H, H, 600_000_000, 12)
ORACLE["q_peth_by_unit"] = _peth_sql(USER_PTS, USER_TRG, -24 * H, 48 * H, 4 * H, 18)

ORACLE["q_range_join"] = f"""
WITH ev AS ({EV}), p AS ({USER_PTS}), t AS ({USER_TRG})
SELECT p.session_id, p.unit_id, t.trigger_id, p.t_us - t.t_us AS rel_us
FROM p JOIN t ON p.session_id = t.session_id AND p.t_us - t.t_us BETWEEN {-6 * H} AND {6 * H}
"""

ORACLE["q_range_pairs"] = f"""
WITH ev AS ({EV}), p AS ({GLOBAL_PTS}), t AS ({GLOBAL_TRG})
SELECT 'all' AS session_id, count(*) AS n_pairs FROM p JOIN t ON p.t_us - t.t_us BETWEEN {-H} AND {H}
"""
ORACLE["q_pair_counts_by_rank"] = f"""
WITH ev AS ({EV}), p AS ({GLOBAL_PTS}), t AS ({GLOBAL_TRG})
SELECT 'all' AS session_id, CAST(least((p.t_us - t.t_us + {H}) // 600000000, 11) AS INTEGER) AS bin, count(*) AS n_pairs
FROM p JOIN t ON p.t_us - t.t_us BETWEEN {-H} AND {H} GROUP BY ALL
"""

ORACLE["q_pair_counts_mixed"] = ORACLE["q_pair_counts_by_rank"]

ORACLE["q_trials_matrix"] = f"""
WITH ev AS ({EV}), p AS ({USER_PTS}), t AS ({USER_TRG})
SELECT p.session_id, t.trigger_id, p.unit_id,
       CAST(least((p.t_us - t.t_us + {24 * H}) // {4 * H}, 17) AS INTEGER) AS bin,
       count(*) AS n_points, round(count(*) / 14400.0::DOUBLE, 9) AS rate_hz
FROM p JOIN t ON p.session_id = t.session_id AND p.t_us - t.t_us BETWEEN {-24 * H} AND {48 * H}
GROUP BY ALL
"""

# --- alignment -----------------------------------------------------------------

ORACLE["q_psth"] = f"""
WITH ev AS ({EV}),
p AS (SELECT event_type AS session_id, user_id AS unit_id, t_us FROM ev),
t AS (SELECT event_id AS trigger_id, t_us FROM ev WHERE event_type = 'purchase'),
nt AS (SELECT count(*) AS n FROM t),
c AS (SELECT p.session_id, p.unit_id, least((p.t_us - t.t_us + 7200000000) // 60000000, 179) AS bin, count(*) AS n
  FROM p JOIN t ON p.t_us - t.t_us BETWEEN -7200000000 AND 3600000000 GROUP BY ALL),
g AS (SELECT DISTINCT session_id, unit_id, b.bin FROM p, (SELECT unnest(range(180)) AS bin) b)
SELECT g.session_id, g.unit_id, CAST(g.bin AS INTEGER) AS bin,
       CASE WHEN nt.n = 0 THEN 0.0 ELSE round(coalesce(c.n, 0) / (nt.n * 60.0::DOUBLE), 9) END AS rate_hz,
       greatest(nt.n, 1) AS n_trials
FROM g LEFT JOIN c USING (session_id, unit_id, bin), nt
"""


def _kernel(sigma: float) -> str:
    import math

    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (o / sigma) ** 2) for o in range(-r, r + 1)]
    return ", ".join(f"({o}, {v / sum(w)!r}::DOUBLE)" for o, v in zip(range(-r, r + 1), w))


ORACLE["q_smooth"] = f"""
WITH c AS (
  SELECT * FROM ({_peth_sql(GLOBAL_PTS, GLOBAL_TRG, -H, H, 600_000_000, 12).replace(", 9)", ", 18)")})),
k(o, w) AS (VALUES {_kernel(1.5)}),
s AS (SELECT tgt.bin AS bin, k.w,
             CASE WHEN (tgt.bin + k.o + 24) % 24 < 12 THEN (tgt.bin + k.o + 24) % 24
                  ELSE 23 - (tgt.bin + k.o + 24) % 24 END AS src
      FROM (SELECT unnest(range(12)) AS bin) tgt, k)
SELECT c.session_id, c.unit_id, CAST(s.bin AS INTEGER) AS bin, round(sum(c.rate_hz * s.w), 9) AS smoothed
FROM c JOIN s ON c.bin = s.src GROUP BY ALL
"""

TRIALS = """
SELECT o_custkey AS session_id,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INTEGER) AS trial_idx,
  o_orderkey AS order_key, outcome, o_orderkey % 11 <> 0 AS has_rt, (cents % 500) * 10000 AS rt_us,
  CASE WHEN o_orderkey % 13 <> 0 THEN (cents % 700) / 100.0 END AS change_time,
  start_us AS base_us, CASE WHEN o_orderkey % 5 <> 0 THEN start_us + 1000000 + (cents % 400) * 10000 END AS change_us,
  cents
FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
        epoch_us(o_orderdate) + CAST(round(o_totalprice * 100) AS BIGINT) AS start_us,
        CASE WHEN o_orderpriority = '5-LOW' THEN 'abort' WHEN o_orderstatus = 'F' THEN 'Hit'
             WHEN o_orderstatus = 'O' THEN 'Miss' ELSE 'FA' END AS outcome FROM orders)
"""
TIMED = f"""
SELECT *, CASE WHEN NOT has_rt THEN NULL
  WHEN outcome = 'Hit' THEN change_us + rt_us - 200000 WHEN outcome = 'Miss' THEN change_us + rt_us
  WHEN outcome = 'FA' THEN base_us + rt_us - 200000 WHEN outcome = 'abort' THEN base_us + rt_us END AS event_us
FROM ({TRIALS})
"""
TRIAL_POINTS = """
SELECT o_custkey AS session_id, l_linenumber AS unit_id,
  epoch_us(o_orderdate) + CAST(round(o_totalprice * 100) AS BIGINT)
  + CAST(round(l_extendedprice * 100) AS BIGINT) % 6000000 AS t_us
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""
CUSTOMERS = """
SELECT c_custkey AS session_id, c_mktsegment AS subject, c_name AS session_name,
  CASE WHEN c_custkey % 4 = 0 THEN []::INTEGER[] ELSE [c_custkey % 7 + 1, c_custkey % 3 + 1] END AS good
FROM customer
"""

ORACLE["q_good_units"] = f"""
SELECT DISTINCT p.session_id, p.unit_id FROM ({TRIAL_POINTS}) p LEFT JOIN ({CUSTOMERS}) c USING (session_id)
WHERE coalesce(len(c.good), 0) = 0 OR list_contains(c.good, p.unit_id)
"""

ORACLE["q_good_chain"] = f"""
WITH u AS (SELECT DISTINCT session_id, unit_id FROM ({TRIAL_POINTS})),
cand AS (
  SELECT session_id, unnest(good) AS unit_id, 1 AS src FROM ({CUSTOMERS})
  UNION SELECT session_id, unit_id, 2 FROM u WHERE session_id % 8 = 0 AND unit_id < 4
  UNION SELECT session_id, unit_id, 3 FROM u
    WHERE CASE (session_id + unit_id) % 5 WHEN 0 THEN true
               WHEN 1 THEN (session_id + unit_id) % 2 = 0 ELSE false END),
f AS (SELECT session_id, min(src) AS src FROM cand GROUP BY 1)
SELECT u.session_id, u.unit_id FROM u LEFT JOIN f USING (session_id)
WHERE f.src IS NULL OR EXISTS (SELECT 1 FROM cand WHERE cand.session_id = u.session_id
  AND cand.unit_id = u.unit_id AND cand.src = f.src)
"""

# --- trials --------------------------------------------------------------------

ORACLE["q_event_times"] = f"SELECT session_id, trial_idx, outcome, event_us FROM ({TIMED})"

ORACLE["q_event_triggers"] = f"""
WITH t AS ({TIMED})
SELECT session_id, trial_idx AS trigger_id, change_us AS t_us, 'Change_ON' AS event FROM t WHERE change_us IS NOT NULL
UNION ALL SELECT session_id, trial_idx, event_us, outcome FROM t
WHERE outcome IN ('Hit', 'abort') AND event_us IS NOT NULL
"""

ORACLE["q_outcome_groups"] = f"""
SELECT session_id, CASE WHEN outcome = 'FA' THEN CASE WHEN rt_us > 3000000 THEN 'FA>3s' ELSE 'FA<=3s' END
  WHEN outcome = 'abort' THEN 'Abort' ELSE outcome END AS grp, count(*) AS n
FROM ({TRIALS}) WHERE outcome <> 'FA' OR has_rt GROUP BY ALL
"""

ORACLE["q_common_length"] = f"""
WITH t AS ({TRIALS}), n AS (SELECT session_id, count(change_us) AS n FROM t GROUP BY 1)
SELECT session_id, trial_idx, outcome FROM t JOIN n USING (session_id) WHERE trial_idx < n.n
"""

WINDOWS = f"""
SELECT session_id, trial_idx, unit_usable AS usable_us, base_us,
  CASE WHEN unit_usable IS NULL THEN 0 ELSE CAST(least(greatest(CAST(floor(unit_usable / 20000.0::DOUBLE) AS BIGINT), 1),
    greatest(CAST(ceil(max(unit_usable) OVER (PARTITION BY session_id) / 20000.0::DOUBLE) AS BIGINT), 1)) AS INTEGER)
  END AS n_end_bins,
  coalesce(unit_usable > 20000, false) AS valid
FROM (SELECT *, (CASE WHEN outcome IN ('FA', 'abort') THEN event_us - 1000000 ELSE change_us END)
             - base_us - 1000000 AS unit_usable FROM ({TIMED}))
"""
ORACLE["q_baseline_windows"] = f"SELECT session_id, trial_idx, usable_us, n_end_bins, valid FROM ({WINDOWS})"

ORACLE["q_baseline_ragged"] = f"""
WITH w AS (SELECT * FROM ({WINDOWS}) WHERE n_end_bins > 0), p AS ({TRIAL_POINTS}),
u AS (SELECT DISTINCT session_id, unit_id FROM p),
c AS (SELECT w.session_id, w.trial_idx, p.unit_id, count(*) AS n FROM w JOIN p ON p.session_id = w.session_id
  AND p.t_us >= w.base_us + 1000000 AND p.t_us < w.base_us + 1000000 + w.n_end_bins * 20000 GROUP BY ALL)
SELECT w.session_id, w.trial_idx, u.unit_id, round(coalesce(c.n, 0) / (w.n_end_bins * 0.02::DOUBLE), 6) AS rate
FROM w JOIN u USING (session_id) LEFT JOIN c USING (session_id, trial_idx, unit_id)
"""

ORACLE["q_trial_qc"] = f"""
SELECT session_id, CAST(sum(n) AS BIGINT) AS n_trials, string_agg(outcome || ':' || n, ',' ORDER BY outcome) AS outcome_counts,
  CAST(sum(nc) AS BIGINT) AS missing_change_time, CAST(sum(nr) AS BIGINT) AS trials_missing_reactiontimes
FROM (SELECT session_id, outcome, count(*) AS n, count(*) FILTER (change_time IS NULL) AS nc,
        count(*) FILTER (NOT has_rt) AS nr FROM ({TRIALS}) GROUP BY ALL) GROUP BY 1
"""

# --- units and sessions ----------------------------------------------------------

ORACLE["q_unit_qc"] = f"""
WITH ev AS (SELECT event_type AS session_id, user_id AS unit_id, t_us FROM ({EV})),
d AS (SELECT session_id, (max(t_us) - min(t_us)) / 1e6 AS dur FROM ev GROUP BY 1),
i AS (SELECT *, t_us - lag(t_us) OVER (PARTITION BY session_id, unit_id ORDER BY t_us) AS isi FROM ev)
SELECT session_id, unit_id, count(*) AS n_spikes, round(count(*) / any_value(dur), 12) AS mean_rate_hz,
  count(*) FILTER (isi < 3600000000) AS isi_violations_count,
  CASE WHEN count(*) < 2 THEN 0.0 ELSE round(count(*) FILTER (isi < 3600000000) / (count(*) - 1)::DOUBLE, 6) END
    AS isi_violations_frac
FROM i JOIN d USING (session_id) GROUP BY 1, 2
"""

ORACLE["q_isi"] = f"""
WITH ev AS ({EV}), i AS (
SELECT session_id, unit_id, t_us - lag(t_us) OVER (PARTITION BY session_id, unit_id ORDER BY t_us) AS isi_us
FROM ({USER_PTS}))
SELECT session_id, unit_id, isi_us, count(*) AS n FROM i WHERE isi_us IS NOT NULL GROUP BY ALL
"""

ORACLE["q_session_summary"] = f"""
WITH t AS ({TRIALS}), p AS ({TRIAL_POINTS}),
nt AS (SELECT session_id, count(*) AS n, count(change_us) AS nc FROM t GROUP BY 1),
np AS (SELECT session_id, count(DISTINCT unit_id) AS nu, (max(t_us) - min(t_us)) / 1e6 AS dur FROM p GROUP BY 1)
SELECT c.session_id, c.subject, c.session_name, coalesce(nt.n, 0) AS n_trials, coalesce(np.nu, 0) AS n_units,
  CASE WHEN len(good) > 0 THEN CAST(len(good) AS INTEGER) END AS n_good_units,
  CASE WHEN coalesce(dur, 0) <= 0 THEN 1.0 ELSE round(greatest(dur, 1e-3), 6) END AS session_duration_s,
  CASE WHEN nt.n IS NULL THEN '' WHEN nt.nc = 0 THEN 'Baseline_ON' ELSE 'Baseline_ON,Change_ON' END AS event_channels
FROM ({CUSTOMERS}) c LEFT JOIN nt USING (session_id) LEFT JOIN np USING (session_id)
"""


def _hist_sql(n: int, by: str | None) -> str:
    part = f"GROUP BY {by}" if by else ""
    key, alias = (f"{by}, ", f"{by} AS session_id, ") if by else ("", "")
    on = f"e.{by} = x.{by}" if by else "true"
    pick = f"g.{by} AS session_id, " if by else ""
    return f"""
WITH m AS (SELECT {key}min(value) AS mn, max(value) AS mx FROM events {part}),
e AS (SELECT {key}CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo, CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi FROM m),
c AS (SELECT {('x.' + by + ', ') if by else ''}least(CAST(floor((x.value - e.lo) / ((e.hi - e.lo) / {n})) AS INTEGER), {n - 1}) AS bin,
        count(*) AS n FROM events x JOIN e ON {on} GROUP BY ALL),
g AS (SELECT e.*, CAST(b.bin AS INTEGER) AS bin FROM e, (SELECT unnest(range({n})) AS bin) b)
SELECT {pick}g.bin, round(g.lo + g.bin * ((g.hi - g.lo) / {n}), 6) AS left_edge,
  round(g.lo + (g.bin + 1) * ((g.hi - g.lo) / {n}), 6) AS right_edge, coalesce(c.n, 0) AS n
FROM g LEFT JOIN c ON g.bin = c.bin {f'AND g.{by} = c.{by}' if by else ''}
"""


ORACLE["q_hist_value"] = _hist_sql(50, None)
ORACLE["q_hist_by_session"] = _hist_sql(25, "event_type")

ORACLE["q_id_normalise"] = """
WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN ['', 'NaN', 'x'] ELSE
  [p_size::VARCHAR, ' ' || p_size || '.7 ', '', 'oops', (p_partkey % 5)::VARCHAR, 'nan', (-(p_partkey % 3))::VARCHAR] END AS raw
  FROM part),
v AS (SELECT p_partkey, [TRY_CAST(trim(x) AS DOUBLE) for x in raw if coalesce(NOT isnan(TRY_CAST(trim(x) AS DOUBLE)), false)] AS d FROM r)
SELECT p_partkey, CASE WHEN len(d) > 0 THEN array_to_string(list_sort(list_distinct(
  [CAST(trunc(x) AS INTEGER) for x in d])), ',') END AS ids FROM v
"""

NAMES = """
SELECT c_custkey AS session_id, CASE c_custkey % 4
  WHEN 0 THEN 'S_' || c_nationkey || '_' || d || m || y || '_g0' WHEN 1 THEN 'S_' || c_nationkey || '_' || d || m || y[3:4]
  WHEN 2 THEN c_mktsegment END AS name
FROM (SELECT *, lpad((c_custkey % 33 + 1)::VARCHAR, 2, '0') AS d, lpad((c_custkey % 13 + 1)::VARCHAR, 2, '0') AS m,
        (2019 + c_custkey % 7)::VARCHAR AS y FROM customer)
"""
ORACLE["q_session_identity"] = f"""
SELECT session_id, CASE WHEN name IS NULL THEN 'unknown' WHEN len(p) >= 3 THEN p[1] || '_' || p[2] ELSE name END AS subject,
  CASE WHEN len(p) >= 3 THEN p[3] ELSE 'unknown' END AS label
FROM (SELECT *, string_split(name, '_') AS p FROM ({NAMES}))
"""
ORACLE["q_session_date"] = f"""
SELECT session_id, CAST(CASE length(tok) WHEN 8 THEN try_strptime(tok, '%d%m%Y')
  WHEN 6 THEN try_strptime(tok[1:4] || '20' || tok[5:6], '%d%m%Y') END::DATE AS VARCHAR) AS session_date
FROM (SELECT *, regexp_extract(name, '(\\d{{8}}|\\d{{6}})', 1) AS tok FROM ({NAMES}))
"""
ORACLE["q_alias_fields"] = """
SELECT c_custkey, CASE WHEN isnan(v) THEN NULL ELSE v END AS value, label FROM (
  SELECT c_custkey, TRY_CAST(coalesce(a, b, c) AS DOUBLE) AS v, coalesce(a, b, 'Unknown') AS label FROM (
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN c_acctbal::VARCHAR END AS a,
      CASE WHEN c_custkey % 2 = 0 THEN c_nationkey::VARCHAR END AS b,
      CASE WHEN c_custkey % 5 <> 0 THEN 'nan' ELSE 'bad' END AS c FROM customer))
"""

# --- response tagging ---------------------------------------------------------------

RESP = f"""
WITH ev AS ({EV}), p AS ({USER_PTS}), t AS ({USER_TRG}),
u AS (SELECT DISTINCT session_id, unit_id FROM p),
nt AS (SELECT session_id, count(*) AS n_pulses FROM t GROUP BY 1),
ext AS (SELECT session_id, min(t_us) AS a, max(t_us) AS z FROM p GROUP BY 1),
r AS (SELECT u.session_id, u.unit_id, t.trigger_id,
  count(*) FILTER (p.t_us BETWEEN t.t_us AND t.t_us + {6 * H}) AS ev,
  count(*) FILTER (p.t_us >= t.t_us - {12 * H} AND p.t_us < t.t_us) AS bl,
  min(p.t_us - t.t_us) FILTER (p.t_us BETWEEN t.t_us AND t.t_us + {6 * H}) AS first_us
  FROM u JOIN t USING (session_id) LEFT JOIN p ON p.session_id = u.session_id AND p.unit_id = u.unit_id
  AND p.t_us BETWEEN t.t_us - {12 * H} AND t.t_us + {6 * H} GROUP BY ALL),
m AS (SELECT u.session_id, u.unit_id, coalesce(nt.n_pulses, 0) AS n_pulses, avg(first_us) / 1000.0 AS lat,
  coalesce(avg((ev > 0)::INTEGER), 0.0) AS rel, coalesce(avg(ev), 0.0) AS em, coalesce(stddev_pop(ev), 0.0) AS es,
  coalesce(avg(bl), 0.0) AS bm, coalesce(sum(ev), 0)::BIGINT AS tot,
  quantile_cont(first_us, 0.1) / 1000.0 AS p10, quantile_cont(first_us, 0.5) / 1000.0 AS p50
  FROM u LEFT JOIN nt USING (session_id) LEFT JOIN r USING (session_id, unit_id) GROUP BY ALL),
lam AS (SELECT *, bm / 43200.0::DOUBLE * n_pulses * 21600.0::DOUBLE AS lam FROM m),
po AS (SELECT *, CASE WHEN n_pulses = 0 OR tot = 0 THEN 1.0 WHEN lam <= 0 THEN 0.0 WHEN tot > lam THEN
  list_sum([exp(k * ln(lam) - lam - lgamma(k + 1)) for k in range(tot, tot + 400)])
  ELSE 1.0 - list_sum([exp(k * ln(lam) - lam - lgamma(k + 1)) for k in range(0, tot)]) END AS pp FROM lam),
ons AS (SELECT t.session_id, i.iter, t.trigger_id, ext.a + 21600000000 +
    (('0x' || md5(t.session_id || ':' || i.iter || ':' || t.trigger_id)[1:15])::BIGINT % (ext.z - ext.a - 43200000000)) AS t_us
  FROM t JOIN ext USING (session_id), (SELECT unnest(range(300)) AS iter) i WHERE ext.z - ext.a > 43200000000),
dr AS (SELECT p.session_id, p.unit_id, o.iter, count(*) AS n FROM ons o JOIN p ON p.session_id = o.session_id
  AND p.t_us BETWEEN o.t_us AND o.t_us + {6 * H} GROUP BY ALL),
pe AS (SELECT m.session_id, m.unit_id, m.tot AS observed,
  CASE WHEN m.tot = 0 OR any_value(ext.z - ext.a) <= 43200000000 THEN 1.0
       ELSE round(count(*) FILTER (dr.n >= m.tot) / 300.0::DOUBLE, 6) END AS p_permutation
  FROM m LEFT JOIN dr USING (session_id, unit_id) LEFT JOIN ext USING (session_id) GROUP BY m.session_id, m.unit_id, m.tot)
"""
METRICS = """session_id, unit_id, n_pulses, round(lat, 6) AS mean_latency_ms, round(rel, 6) AS reliability,
  round(em, 6) AS evoked_count_mean, round(es, 6) AS evoked_count_std, round(bm, 6) AS baseline_count_mean,
  round(bm / 43200.0::DOUBLE, 12) AS baseline_rate_hz, tot AS total_evoked"""
CLASS = "CASE WHEN lat IS NOT NULL AND lat <= 10800000.0 AND rel >= 0.3 THEN 'opto' ELSE 'none' END"
ORACLE["q_tag_metrics"] = f"{RESP} SELECT {METRICS} FROM m"
ORACLE["q_latency_pct"] = f"""{RESP} SELECT session_id, unit_id, round(p10, 6) AS latency_p10_ms,
  round(p50, 6) AS latency_p50_ms FROM m WHERE p10 IS NOT NULL"""
ORACLE["q_poisson_tail"] = f"{RESP} SELECT session_id, unit_id, round(least(1.0, greatest(0.0, pp)), 6) AS p_poisson FROM po"
ORACLE["q_perm_evoked"] = f"{RESP} SELECT session_id, unit_id, observed, p_permutation FROM pe"
ORACLE["q_units_table"] = f"""{RESP} SELECT {METRICS}, round(least(1.0, greatest(0.0, pp)), 6) AS p_poisson,
  round(p10, 6) AS latency_p10_ms, round(p50, 6) AS latency_p50_ms, p_permutation, {CLASS} AS classification,
  CASE WHEN k % 3 > 0 THEN k * 90.0::DOUBLE END AS wf_peak_width_us, CASE WHEN k % 3 > 0 THEN k * 120.0::DOUBLE END AS wf_peak_valley_us,
  CASE WHEN k % 3 > 0 THEN round(fr, 12) END AS wf_mean_fr_hz,
  CASE WHEN k % 3 > 0 THEN CASE WHEN k * 90 > 150 AND k * 120 > 500 AND fr <= 10 THEN 'SPN'
    WHEN k * 90 <= 150 AND k * 120 <= 500 AND fr >= 0.1 THEN 'FSI' ELSE 'Other' END END AS wf_class
  FROM (SELECT *, (session_id * 7 + length(unit_id)) % 9 AS k FROM po) po JOIN pe USING (session_id, unit_id)
  JOIN (SELECT p.session_id, p.unit_id, count(*) / greatest(1.0, CASE WHEN any_value(z - a) <= 0 THEN 1.0 ELSE any_value(z - a) / 1e6 END) AS fr
    FROM p JOIN ext USING (session_id) GROUP BY 1, 2) USING (session_id, unit_id)"""
ORACLE["q_topn_units"] = f"""{RESP} SELECT session_id, unit_id, rank, round(rel, 6) AS reliability FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY rel DESC, unit_id) AS INTEGER) AS rank FROM m)
  WHERE rank <= 2"""
ORACLE["q_tag_or_top"] = f"""{RESP} SELECT session_id, unit_id FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY rel DESC, unit_id) AS rank FROM m)
  WHERE rank <= 1 OR {CLASS} = 'opto'"""

LASER = f"""
SELECT session_id, trial_idx AS event_idx, (base_us - 788918400000000) * 3 / 100000.0::DOUBLE + 0.01234567::DOUBLE AS rise, cents % 3 AS extra
FROM ({TRIALS})
"""
PULSES = f"""
SELECT l.*, l.rise + 300 + extra AS fall, sr FROM ({LASER}) l JOIN (
  SELECT session_id, CASE WHEN median(rise) > 1 THEN median((rise + 300 + extra) - rise) / 0.01::DOUBLE ELSE 30000.0 END AS sr,
    median(rise) > 10 AS in_samples FROM ({LASER}) GROUP BY 1) USING (session_id)
"""
ORACLE["q_pulses"] = f"""
SELECT session_id, event_idx, round(rise, 1) AS onset_samples, round(fall, 1) AS offset_samples,
  round(rise / sr, 6) AS onset_s, round(fall / sr, 6) AS offset_s, 0.01::DOUBLE AS duration_s, round(sr, 6) AS sample_rate
FROM ({PULSES})
"""
ORACLE["q_blocks"] = f"""
WITH p AS (SELECT session_id, event_idx, rise / sr AS s FROM ({PULSES})),
g AS (SELECT *, s - lag(s) OVER (PARTITION BY session_id ORDER BY event_idx) AS gap FROM p),
b AS (SELECT session_id, event_idx AS start FROM (SELECT *, row_number() OVER (
  PARTITION BY session_id ORDER BY gap DESC, event_idx) AS r FROM g WHERE gap IS NOT NULL) WHERE r = 1 AND gap > 2e4)
SELECT p.session_id, p.event_idx, CAST(coalesce((p.event_idx >= b.start)::INTEGER, 0) AS INTEGER) AS block_id
FROM p LEFT JOIN b USING (session_id)
"""
ORACLE["q_spike_units"] = """
WITH s AS (SELECT l_suppkey AS session_id, l_linenumber AS unit_id,
  CASE WHEN l_suppkey % 2 = 0 THEN l_extendedprice ELSE l_quantity END AS t FROM lineitem),
m AS (SELECT session_id, median(t) > 1000 AS smp FROM s GROUP BY 1)
SELECT session_id, unit_id, count(*) AS n,
  CAST(sum(CAST(round(CASE WHEN smp THEN t / 30000.0::DOUBLE ELSE t END * 1e6) AS BIGINT)) AS BIGINT) AS sum_us
FROM s JOIN m USING (session_id) GROUP BY 1, 2
"""

# --- population ---------------------------------------------------------------------

POP = """
pop AS (SELECT o_orderpriority AS session_id, l_orderkey AS trial_idx, month(l_shipdate) - 1 AS bin,
  l_linenumber AS unit_id, sum(l_quantity) AS rate FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
tr AS (SELECT o_orderpriority AS session_id, o_orderkey AS trial_idx,
  CASE o_orderstatus WHEN 'F' THEN 'Hit' WHEN 'O' THEN 'Miss' ELSE 'FA' END AS outcome,
  (o_orderkey % 9) / 1.5::DOUBLE AS fa FROM orders),
tg AS (SELECT *, CASE WHEN outcome = 'FA' THEN CASE WHEN fa > 3 THEN 'FA>3s' ELSE 'FA<=3s' END ELSE outcome END AS grp FROM tr),
un AS (SELECT DISTINCT session_id, unit_id FROM pop),
nc AS (SELECT session_id, outcome AS cond, count(*) AS n FROM tr GROUP BY 1, 2),
av AS (SELECT nc.session_id, nc.cond, un.unit_id, coalesce(s.s, 0) / (nc.n * 12) AS avg_rate FROM nc JOIN un USING (session_id)
  LEFT JOIN (SELECT pop.session_id, outcome AS cond, unit_id, sum(rate) AS s FROM pop JOIN tr USING (session_id, trial_idx) GROUP BY ALL) s
  USING (session_id, cond, unit_id)),
df AS (SELECT h.session_id, h.unit_id, h.avg_rate - m.avg_rate AS d FROM av h JOIN av m USING (session_id, unit_id)
  WHERE h.cond = 'Hit' AND m.cond = 'Miss'),
cd AS (SELECT df.session_id, unit_id, CASE WHEN nrm > 0 THEN d / nrm ELSE d END AS weight FROM df JOIN
  (SELECT session_id, sqrt(sum(d * d)) AS nrm FROM df GROUP BY 1) USING (session_id)),
pj AS (SELECT pop.session_id, trial_idx, bin, sum(rate * weight) AS proj FROM pop JOIN cd USING (session_id, unit_id) GROUP BY ALL),
sc AS (SELECT tg.*, coalesce(s.s, 0.0) / 4.0::DOUBLE AS value FROM tg LEFT JOIN
  (SELECT session_id, trial_idx, sum(proj) AS s FROM pj WHERE bin <= 3 GROUP BY 1, 2) s USING (session_id, trial_idx))
"""
ORACLE["q_condition_avg"] = f"WITH {POP} SELECT session_id, cond, unit_id, round(avg_rate, 6) AS avg_rate FROM av"
ORACLE["q_cd_meandiff"] = f"WITH {POP} SELECT session_id, unit_id, round(weight, 6) + 0.0 AS weight FROM cd"
ORACLE["q_project"] = f"WITH {POP} SELECT session_id, trial_idx, CAST(bin AS INTEGER) AS bin, round(proj, 6) + 0.0 AS proj FROM pj"
ORACLE["q_trial_scalar"] = f"WITH {POP} SELECT session_id, trial_idx, outcome, round(value, 6) + 0.0 AS value FROM sc"
ORACLE["q_group_stats"] = f"""WITH {POP} SELECT session_id, grp, count(*) AS n, round(avg(value), 6) + 0.0 AS mean,
  round(stddev_pop(value) / sqrt(count(*)), 6) AS sem FROM sc GROUP BY ALL"""
ORACLE["q_group_curve"] = f"""WITH {POP},
b AS (SELECT unnest(range(12)) AS bin),
x AS (SELECT tg.session_id, tg.grp, b.bin, coalesce(pj.proj, 0.0) AS v FROM tg, b LEFT JOIN pj
  ON pj.session_id = tg.session_id AND pj.trial_idx = tg.trial_idx AND pj.bin = b.bin)
SELECT session_id, grp, CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(v), 6) + 0.0 AS mean,
  round(stddev_pop(v) / sqrt(count(*)), 6) AS sem FROM x GROUP BY ALL"""
#: Two-sided p of Student's t by Simpson's rule over the angle whose tangent is t / sqrt(df).
T_P = """(SELECT CASE WHEN t IS NULL OR df IS NULL THEN NULL ELSE greatest(0.0, 1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi())
  * atan(abs(t) / sqrt(df)) / 6000 * list_sum([(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
    * cos(atan(abs(t) / sqrt(df)) * i / 2000.0::DOUBLE) ** (df - 1) for i in range(2001)])) END)"""
ORACLE["q_welch"] = f"""WITH {POP},
g AS (SELECT session_id, grp, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM sc GROUP BY ALL),
o AS (SELECT a.session_id, a.grp AS group_a, b.grp AS group_b,
  CASE WHEN a.grp <> b.grp THEN (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) END AS t,
  CASE WHEN a.grp <> b.grp THEN (a.v / a.n + b.v / b.n) ** 2 /
    ((a.v / a.n) ** 2 / (a.n - 1) + (b.v / b.n) ** 2 / (b.n - 1)) END AS df
FROM g a JOIN g b USING (session_id))
SELECT session_id, group_a, group_b, round(t, 6) AS t_stat, round(df, 6) AS df, round({T_P}, 6) AS p_value FROM o"""
ORACLE["q_paired_t"] = f"""WITH {POP},
x AS (SELECT un.session_id, un.unit_id, tr.trial_idx, coalesce(b, 0.0) AS b, coalesce(r, 0.0) AS r FROM un JOIN tr USING (session_id)
  LEFT JOIN (SELECT session_id, unit_id, trial_idx, sum(CASE WHEN bin <= 2 THEN rate ELSE 0 END) / 3.0::DOUBLE AS b,
    sum(CASE WHEN bin BETWEEN 3 AND 6 THEN rate ELSE 0 END) / 4.0::DOUBLE AS r FROM pop GROUP BY ALL) USING (session_id, unit_id, trial_idx))
, o AS (SELECT session_id, unit_id, count(*) AS n, avg(b) AS mb, avg(r) AS mr,
  avg(r - b) / (stddev_samp(r - b) / sqrt(count(*))) AS t, (count(*) - 1)::DOUBLE AS df FROM x GROUP BY 1, 2)
SELECT session_id, unit_id, n, round(mb, 6) AS mean_baseline, round(mr, 6) AS mean_response, round(t, 6) AS t_stat, df,
  round({T_P}, 6) AS p_value, {T_P} < 0.01 AS is_responsive FROM o"""
ORACLE["q_kfold"] = f"""WITH {POP},
y AS (SELECT session_id, trial_idx, (outcome = 'Hit')::INTEGER AS y FROM tr),
k AS (SELECT *, ('0x' || md5(session_id || ':' || trial_idx || ':0')[1:15])::BIGINT AS key FROM y)
SELECT session_id, trial_idx, y, CAST(ntile(5) OVER (PARTITION BY session_id, y ORDER BY key, trial_idx) - 1 AS INTEGER) AS fold FROM k"""

#: Folds of the trials and the true label, as q_kfold has them.
FOLDS = """fo AS (SELECT *, ntile(5) OVER (PARTITION BY session_id, y ORDER BY key, trial_idx) - 1 AS fold FROM (
  SELECT session_id, trial_idx, (outcome = 'Hit')::INTEGER AS y, ('0x' || md5(session_id || ':' || trial_idx || ':0')[1:15])::BIGINT AS key FROM tr))"""


def _solved(train: str, method: str) -> str:
    """Common table expressions up to ``wt(session_id, fold, perm, bin, unit_id, w)``: unit directions fitted on ``train``.

    ``train`` has (session_id, fold, perm, trial_idx, y). The systems are solved by elimination, column by column.
    """
    left = "(g - pu * pv / n) / (n - 1)" if method == "shrinkage" else "g - pu * pv / n"
    right = "s1 / n1 - (pl - s1) / (n - n1)" if method == "shrinkage" else "s1 - pl * n1 / n"
    return f"""
tn AS ({train}),
sz AS (SELECT session_id, fold, perm, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS n1 FROM tn GROUP BY ALL),
rt AS (SELECT session_id, trial_idx, bin, unit_id, rate::DOUBLE AS rate FROM pop),
gf AS (SELECT tn.session_id, tn.fold, a.bin, a.unit_id AS u, b.unit_id AS v, sum(a.rate * b.rate) AS g
  FROM (SELECT DISTINCT session_id, fold, trial_idx FROM tn) tn JOIN rt a USING (session_id, trial_idx)
  JOIN rt b ON b.session_id = a.session_id AND b.trial_idx = a.trial_idx AND b.bin = a.bin GROUP BY ALL),
sm AS (SELECT tn.session_id, fold, perm, bin, unit_id, sum(rate) AS pl, sum(rate * y) AS s1
  FROM tn JOIN rt USING (session_id, trial_idx) GROUP BY ALL),
lf AS (SELECT x.session_id, x.fold, x.perm, x.bin, x.unit_id AS u, list(l + (x.unit_id = z.unit_id)::INTEGER ORDER BY z.unit_id) AS row
  FROM (SELECT a.session_id, a.fold, a.perm, a.bin, a.unit_id, b.unit_id AS v, a.pl AS pu, b.pl AS pv, n, coalesce(g, 0.0) AS g,
          {left.replace("g -", "coalesce(g, 0.0) -")} AS l
        FROM (SELECT *, pl AS pu FROM sm) a JOIN (SELECT *, pl AS pv FROM sm) b USING (session_id, fold, perm, bin) JOIN sz USING (session_id, fold, perm)
        LEFT JOIN gf ON gf.session_id = a.session_id AND gf.fold = a.fold AND gf.bin = a.bin AND gf.u = a.unit_id AND gf.v = b.unit_id) x,
    (SELECT DISTINCT unit_id FROM rt) z WHERE z.unit_id = x.v GROUP BY ALL),
ms AS (SELECT session_id, fold, perm, bin, list(list_append(row, {right}) ORDER BY u) AS m, list(u ORDER BY u) AS us
  FROM lf JOIN (SELECT * RENAME (unit_id AS u) FROM sm) USING (session_id, fold, perm, bin, u)
  JOIN sz USING (session_id, fold, perm) WHERE n1 > 0 AND n1 < n GROUP BY ALL),
el AS (SELECT session_id, fold, perm, bin, us, 1 AS k, m FROM ms UNION ALL
  SELECT session_id, fold, perm, bin, us, k + 1, list_transform(m, lambda r, i: list_transform(r, lambda x, j:
    CASE WHEN i = k THEN x / m[k][k] ELSE x - r[k] * m[k][j] / m[k][k] END)) FROM el WHERE k <= len(us)),
so AS (SELECT session_id, fold, perm, bin, unnest(us) AS unit_id, unnest(list_transform(m, lambda r: r[len(r)])) AS w FROM el WHERE k = len(us) + 1),
wt AS (SELECT session_id, fold, perm, bin, unit_id, w / CASE WHEN nrm > 0 THEN nrm ELSE 1 END AS w
  FROM so JOIN (SELECT session_id, fold, perm, bin, sqrt(sum(w * w)) AS nrm FROM so GROUP BY ALL) USING (session_id, fold, perm, bin))"""


for _method in ("shrinkage", "ridge"):
    ORACLE[f"q_cd_{_method}"] = f"""WITH RECURSIVE {POP}, {FOLDS},
{_solved("SELECT session_id, -1 AS fold, 0 AS perm, trial_idx, y FROM fo", _method)}
SELECT session_id, CAST(bin AS INTEGER) AS bin, unit_id, round(w, 6) + 0.0 AS weight FROM wt"""

OTHERS = """SELECT fo.session_id, k.fold, {perm} AS perm, trial_idx, {y} AS y FROM {labels} fo JOIN (SELECT DISTINCT session_id, fold FROM fo) k
  ON k.session_id = fo.session_id AND k.fold <> fo.fold"""
ORACLE["q_cd_time_resolved"] = f"""WITH RECURSIVE {POP}, {FOLDS},
{_solved(OTHERS.format(perm="0", y="y", labels="fo"), "shrinkage")}
SELECT session_id, trial_idx, CAST(bin AS INTEGER) AS bin, round(sum(rate * w), 6) + 0.0 AS proj
FROM rt JOIN fo USING (session_id, trial_idx) JOIN wt USING (session_id, fold, bin, unit_id) GROUP BY ALL"""
ORACLE["q_cd_perm"] = f"""WITH RECURSIVE {POP}, {FOLDS},
dr AS (SELECT session_id, trial_idx, fold, p.perm, sum(y) OVER (PARTITION BY session_id, p.perm) AS k,
  row_number() OVER (PARTITION BY session_id, p.perm ORDER BY ('0x' || md5(session_id || ':' || trial_idx || ':' || p.perm || ':0')[1:15])::BIGINT) AS rn
  FROM fo, (SELECT unnest(range(1, 21)) AS perm) p),
ls AS (SELECT session_id, trial_idx, fold, 0 AS perm, y FROM fo UNION ALL SELECT session_id, trial_idx, fold, perm, (rn <= k)::INTEGER FROM dr),
{_solved(OTHERS.format(perm="perm", y="y", labels="ls"), "shrinkage")},
pe AS (SELECT ls.session_id, ls.perm, bin, sum(rate * w * y) AS s1, sum(rate * w * (1 - y)) AS s0
  FROM ls JOIN rt USING (session_id, trial_idx) JOIN wt USING (session_id, fold, perm, bin, unit_id) GROUP BY ALL),
ef AS (SELECT session_id, perm, bin, s0 / n0 AS mean0, s1 / n1 AS mean1, s1 / n1 - s0 / n0 AS effect FROM pe JOIN
  (SELECT session_id, sum(y) AS n1, sum(1 - y) AS n0 FROM fo GROUP BY 1) USING (session_id))
SELECT e.session_id, CAST(e.bin AS INTEGER) AS bin, round(e.mean0, 6) + 0.0 AS mean0, round(e.mean1, 6) + 0.0 AS mean1,
  round(e.effect, 6) + 0.0 AS effect, round((count(*) FILTER (abs(o.effect) >= abs(e.effect)) + 1) / 21.0::DOUBLE, 6) AS p_value
FROM ef e JOIN ef o ON o.session_id = e.session_id AND o.bin = e.bin AND o.perm > 0 WHERE e.perm = 0
GROUP BY e.session_id, e.bin, e.mean0, e.mean1, e.effect"""

ORACLE["q_baseline_cd"] = f"""WITH RECURSIVE a AS (SELECT order_key AS trial_idx, outcome, base_us,
  (CASE WHEN outcome IN ('FA', 'abort') THEN event_us - 1000000 ELSE change_us END) - base_us - 1000000 AS usable
  FROM ({TIMED}) WHERE order_key < (SELECT count(*) FROM orders)),
w AS (SELECT *, least(greatest(CAST(floor(usable / 20000.0::DOUBLE) AS BIGINT), 1), greatest(CAST(ceil(
  (SELECT max(usable) FROM a) / 20000.0::DOUBLE) AS BIGINT), 1)) AS n_end_bins FROM a WHERE usable IS NOT NULL),
p AS ({TRIAL_POINTS}),
c AS (SELECT w.trial_idx, p.unit_id, count(*) AS n FROM w JOIN p
  ON p.t_us >= w.base_us + 1000000 AND p.t_us < w.base_us + 1000000 + w.n_end_bins * 20000 GROUP BY ALL),
pop AS (SELECT 'all' AS session_id, w.trial_idx, 0 AS bin, u.unit_id, coalesce(c.n, 0) / (w.n_end_bins * 0.02::DOUBLE) AS rate
  FROM w, (SELECT DISTINCT unit_id FROM p) u LEFT JOIN c ON c.trial_idx = w.trial_idx AND c.unit_id = u.unit_id),
{_solved("SELECT 'all' AS session_id, -1 AS fold, 0 AS perm, trial_idx, (outcome = 'Hit')::INTEGER AS y FROM w WHERE outcome IN ('Hit', 'FA')", "shrinkage")}
SELECT session_id, trial_idx, round(sum(rate * w), 6) + 0.0 AS proj FROM rt JOIN wt USING (session_id, bin, unit_id) GROUP BY ALL"""

# --- waveforms ------------------------------------------------------------------------

WAVE = """
w AS (SELECT vec_id, CAST(vec_id % 2 AS INTEGER) AS session_id, label, i - 1 AS pos, embedding[i]::DOUBLE AS v
  FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
lw AS (SELECT *, CAST(pos // 8 AS INTEGER) AS channel, CAST(pos % 8 AS INTEGER) AS sample FROM w),
mt AS (SELECT session_id, label AS unit_id, channel, sample, avg(v) AS value FROM lw GROUP BY ALL)
"""
ORACLE["q_mean_template"] = f"WITH {WAVE} SELECT session_id, unit_id, channel, sample, round(value, 6) + 0.0 AS value FROM mt"
ORACLE["q_template_summary"] = f"""WITH {WAVE} SELECT session_id, unit_id, n_spikes, round(amp, 6) AS mean_amp, true AS present FROM
  (SELECT session_id, unit_id, max(abs(value)) AS amp FROM mt GROUP BY ALL) JOIN
  (SELECT CAST(vec_id % 2 AS INTEGER) AS session_id, label AS unit_id, count(*) AS n_spikes FROM embeddings GROUP BY ALL)
  USING (session_id, unit_id)"""
SHAPE = f"""{WAVE},
bc AS (SELECT vec_id, channel FROM (SELECT vec_id, channel, row_number() OVER (PARTITION BY vec_id ORDER BY max(v) - min(v) DESC, channel) AS r
  FROM lw GROUP BY vec_id, channel) WHERE r = 1),
x AS (SELECT lw.* FROM lw JOIN bc USING (vec_id, channel)),
pk AS (SELECT vec_id, session_id, max(v) AS pv, max(sample) AS last,
  arg_min(sample, (-v, sample)) AS peak_idx, arg_min(sample, (v, sample)) AS valley_idx FROM x GROUP BY 1, 2),
sh AS (SELECT pk.session_id, pk.vec_id AS unit_id, peak_idx, valley_idx,
  CASE WHEN any_value(pv) <= 0 THEN 0 ELSE coalesce(min(sample) FILTER (sample > peak_idx AND v <= pv / 2), any_value(last))
    - coalesce(max(sample) FILTER (sample < peak_idx AND v <= pv / 2), 0) END * (1e6 / 30000.0::DOUBLE) AS pw,
  abs(valley_idx - peak_idx) * (1e6 / 30000.0::DOUBLE) AS vd
  FROM pk JOIN x USING (vec_id) GROUP BY ALL)
"""
ORACLE["q_waveform_shape"] = f"""WITH {SHAPE} SELECT session_id, unit_id, round(pw, 6) AS peak_width_us,
  round(vd, 6) AS peak_valley_us, peak_idx, valley_idx FROM sh"""
ORACLE["q_wf_class"] = f"""WITH {SHAPE} SELECT session_id, unit_id,
  CASE WHEN pw * 1.5 > 150 AND vd * 4 > 500 AND fr <= 10 THEN 'SPN'
       WHEN pw * 1.5 <= 150 AND vd * 4 <= 500 AND fr >= 0.1 THEN 'FSI' ELSE 'Other' END AS wf_class
  FROM (SELECT *, (unit_id % 23) / 2.0::DOUBLE AS fr FROM sh)"""
ORACLE["q_exemplars"] = """
WITH a AS (SELECT CAST(vec_id % 2 AS INTEGER) AS session_id, vec_id AS unit_id,
  list_sum([abs(x::DOUBLE) for x in embedding]) AS amp FROM embeddings),
p AS (SELECT session_id, q.pct, quantile_cont(amp, 0.05) AS q5, quantile_cont(amp, 0.25) AS q25, quantile_cont(amp, 0.5) AS q50,
  quantile_cont(amp, 0.75) AS q75, quantile_cont(amp, 0.95) AS q95
  FROM a, (SELECT unnest(['p5', 'p25', 'p50', 'p75', 'p95']) AS pct) q GROUP BY ALL),
t AS (SELECT session_id, pct, CASE pct WHEN 'p5' THEN q5 WHEN 'p25' THEN q25 WHEN 'p50' THEN q50 WHEN 'p75' THEN q75 ELSE q95 END AS target FROM p)
SELECT session_id, pct, round(target, 6) AS target, unit_id FROM (
  SELECT t.*, a.unit_id, row_number() OVER (PARTITION BY t.session_id, t.pct ORDER BY abs(a.amp - t.target), a.unit_id) AS r
  FROM t JOIN a USING (session_id)) WHERE r = 1
"""

# --- matching ---------------------------------------------------------------------------

CORR = f"""{WAVE},
st AS (SELECT vec_id, avg(v) AS mu, sqrt(sum(v * v) - count(*) * avg(v) * avg(v)) AS nrm FROM w GROUP BY 1),
z AS (SELECT w.vec_id, w.session_id, w.label, w.pos, (w.v - st.mu) / st.nrm AS v FROM w JOIN st USING (vec_id)),
pr AS (SELECT a.label AS subject, a.session_id AS session_a, b.session_id AS session_b, a.vec_id AS unit_a, b.vec_id AS unit_b,
  sum(a.v * b.v) AS c FROM z a JOIN z b ON a.label = b.label AND a.pos = b.pos AND a.session_id < b.session_id GROUP BY ALL),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY subject, session_a, session_b ORDER BY round(c, 9) DESC, unit_a, unit_b) AS INTEGER) AS rank
  FROM pr QUALIFY rank <= 5)
"""
ORACLE["q_top_matches"] = f"""WITH {CORR} SELECT subject, session_a, session_b, unit_a, unit_b, round(c, 6) + 0.0 AS waveform_corr, rank FROM top"""
ORACLE["q_match_diagnostics"] = f"""WITH {CORR} SELECT subject, 2 AS n_sessions, round(min(c), 6) AS prob_min, round(max(c), 6) AS prob_max,
  count(*) AS n_pairs FROM pr GROUP BY 1"""
ORACLE["q_pair_similarity"] = f"""
WITH ev AS (SELECT event_type AS s, user_id AS u, t_us, value FROM ({EV})),
su AS (SELECT DISTINCT s, u FROM ev),
pr AS (SELECT u, a.s AS sa, b.s AS sb FROM su a JOIN su b USING (u) WHERE a.s < b.s),
wv AS (SELECT s, u, t_us >> 37 AS h, sum(value) AS v FROM ev GROUP BY ALL),
co AS (SELECT u, sa, sb, CASE WHEN NOT isnan(c) THEN c END AS c FROM (SELECT x.u, x.s AS sa, y.s AS sb, corr(x.v, y.v) AS c
  FROM wv x JOIN wv y ON x.u = y.u AND x.h = y.h AND x.s < y.s GROUP BY ALL)),
isi AS (SELECT s, u, d FROM (SELECT s, u, t_us - lag(t_us) OVER (PARTITION BY s, u ORDER BY t_us) AS d FROM ev) WHERE d IS NOT NULL),
pt AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY s, u) AS p FROM isi),
st AS (SELECT u, sa, sb, d, p AS p FROM pr JOIN pt USING (u) WHERE pt.s = sa UNION ALL
  SELECT u, sa, sb, d, -p AS p FROM pr JOIN pt USING (u) WHERE pt.s = sb),
cs AS (SELECT u, sa, sb, d, sum(p) OVER (PARTITION BY u, sa, sb ORDER BY d) AS g FROM st),
ks AS (SELECT u, sa, sb, max(abs(g)) AS k FROM cs GROUP BY ALL),
dur AS (SELECT s, (max(t_us) - min(t_us)) / 1e6 AS d FROM ev GROUP BY 1),
rt AS (SELECT ev.s, ev.u, count(*) / any_value(dur.d) AS r FROM ev JOIN dur USING (s) GROUP BY 1, 2)
SELECT pr.u AS subject, sa AS session_a, sb AS session_b, pr.u AS unit_a, pr.u AS unit_b,
  round(co.c, 6) + 0.0 AS waveform_corr, round(coalesce(ks.k, 1.0), 6) AS isi_ks,
  round(least(ra.r, rb.r) / greatest(ra.r, rb.r), 6) AS firing_rate_ratio,
  round((coalesce(co.c, 0.0) + 1 - coalesce(ks.k, 1.0) + least(ra.r, rb.r) / greatest(ra.r, rb.r)) / 3, 6) + 0.0 AS composite_score
FROM pr LEFT JOIN co USING (u, sa, sb) LEFT JOIN ks USING (u, sa, sb)
  JOIN rt ra ON ra.u = pr.u AND ra.s = sa JOIN rt rb ON rb.u = pr.u AND rb.s = sb
"""
ORACLE["q_match_table"] = f"""SELECT subject, session_a, session_b, unit_a, unit_b, composite_score AS prob
FROM ({ORACLE["q_pair_similarity"]})"""
ORACLE["q_session_rollup"] = f"""WITH {POP},
gs AS (SELECT session_id, grp, count(*) AS n, avg(value) AS m FROM sc GROUP BY ALL),
ot AS (SELECT session_id, avg(value) FILTER (outcome = 'Hit') AS h, avg(value) FILTER (outcome = 'Miss') AS m FROM sc GROUP BY 1),
x AS (SELECT session_id, coalesce(max(n) FILTER (grp = 'Hit'), 0) AS n_hit, coalesce(max(n) FILTER (grp = 'Miss'), 0) AS n_miss,
  max(m) FILTER (grp = 'Hit') AS gh, max(m) FILTER (grp = 'Miss') AS gm, max(m) FILTER (grp = 'FA>3s') AS gf FROM gs GROUP BY 1),
y AS (SELECT x.*, CASE WHEN ot.session_id IS NOT NULL THEN ot.h ELSE gh END AS h, CASE WHEN ot.session_id IS NOT NULL THEN ot.m ELSE gm END AS mm
  FROM x LEFT JOIN ot USING (session_id))
SELECT session_id, 'S_1_0' || session_id[1] || '03202' || session_id[1] AS session_name,
  '202' || session_id[1] || '-03-0' || session_id[1] AS session_date, n_hit, n_miss, round(h, 6) + 0.0 AS mean_change_hit,
  round(mm, 6) + 0.0 AS mean_change_miss, round(h, 6) + 0.0 AS mean_baseline_hit, round(gf, 6) + 0.0 AS "mean_baseline_FA_gt3",
  round(h - mm, 6) + 0.0 AS change_diff FROM y
"""

# --- manifests and probes -----------------------------------------------------------------

FILES = """
SELECT '/data/' || regexp_extract(url, '^https?://([^/]+)/', 1) || '/' || regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1)
  || CASE WHEN page_id % 3 = 0 THEN '/Session_' ELSE '/run_' END || (page_id // 9) AS base,
  ['spike_times.npy', 'Rez.mat', 'cluster_info.tsv', 'raw.bin', 'myChanMap_1.mat', 'phy_out/params.py', 'notes.txt',
   'sorting1/x/log.txt', 'channel_positions.npy', 'RawWaveforms/Unit0.npy', 'spike_clusters.npy'][(page_id * 7 + length(url)) % 11 + 1] AS tail
FROM pages
"""
STATUS = f"""
WITH f AS (SELECT base || '/' || tail AS path, base, tail FROM ({FILES})),
g AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, lower(regexp_extract(path, '([^/]*)$', 1)) AS low FROM f),
o AS (SELECT folder, bool_or(low = 'rez.mat') AS has_rez,
  bool_or(low IN ('spike_times.npy', 'spike_clusters.npy')) AS has_spike_npy, bool_or(low = 'cluster_info.tsv') AS has_phy_clusters,
  bool_or(regexp_matches(low, 'chanmap.*\\.mat$')) AS has_chanmap, bool_or(low LIKE '%.bin') AS has_bin FROM g GROUP BY 1),
d AS (SELECT base AS folder, true AS pd FROM f WHERE tail LIKE 'phy_out/%' OR tail LIKE 'sorting1/%' GROUP BY 1),
t AS (SELECT o.*, coalesce(pd, false) AS has_phy_dir FROM o LEFT JOIN d USING (folder)
  WHERE len(string_split(folder, '/')) - 2 <= 4 AND (has_rez OR has_spike_npy OR has_phy_clusters OR has_bin
  OR lower(regexp_extract(folder, '([^/]*)$', 1)) LIKE '%session%'))
SELECT folder AS path, CASE WHEN has_rez OR (has_spike_npy AND has_phy_clusters) THEN 'Complete'
    WHEN (has_spike_npy AND has_bin) OR (has_phy_dir AND has_chanmap) THEN 'Likely Complete' ELSE 'Incomplete' END AS status,
  has_rez, has_spike_npy, has_phy_clusters, has_phy_dir, has_chanmap, has_bin,
  concat_ws('+', CASE WHEN has_rez THEN 'rez' END, CASE WHEN has_spike_npy THEN 'spikes' END, CASE WHEN has_phy_clusters THEN 'clusters' END,
    CASE WHEN has_bin THEN 'raw' END, CASE WHEN has_phy_dir THEN 'curation' END, CASE WHEN has_chanmap THEN 'map' END) AS notes
FROM t
"""
ORACLE["q_manifest_status"] = STATUS
ORACLE["q_status_counts"] = f"SELECT status, count(*) AS n_folders FROM ({STATUS}) GROUP BY 1"
ORACLE["q_required_missing"] = f"""
WITH f AS ({FILES}),
c AS (SELECT DISTINCT '/data/' || regexp_extract(url, '^https?://([^/]+)/', 1) || '/' || regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1)
  || '/run_' || (page_id // 7) AS path FROM pages),
x AS (SELECT c.path, count(f.base) > 0 AS e, coalesce(bool_or(tail LIKE 'RawWaveforms/%'), false) AS rw,
  coalesce(bool_or(tail = 'channel_positions.npy'), false) AS cp, coalesce(bool_or(tail = 'spike_times.npy'), false) AS st,
  coalesce(bool_or(tail = 'spike_clusters.npy'), false) AS sc FROM c LEFT JOIN f ON f.base = c.path GROUP BY 1)
SELECT path, 'exists' AS artifact FROM x WHERE NOT e UNION ALL SELECT path, 'has_raw_waveforms' FROM x WHERE NOT rw
UNION ALL SELECT path, 'has_channel_pos' FROM x WHERE NOT cp UNION ALL SELECT path, 'has_spike_times' FROM x WHERE NOT st
UNION ALL SELECT path, 'has_spike_clusters' FROM x WHERE NOT sc
"""
ORACLE["q_meta_map"] = """
SELECT p_partkey AS path, m AS n_channels_meta, coalesce(m, 384) AS n_channels, round(('30000.' || (p_partkey % 100))::DOUBLE, 6) AS fs,
  p_size::VARCHAR AS dup, 'a=b ' || p_partkey AS file_name,
  CAST(8 + (p_partkey % 3 < 2)::INTEGER + (p_partkey % 2 = 0)::INTEGER AS INTEGER) AS n_keys
FROM (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN p_size + 300 ELSE CAST(p_partkey % 9 + 380 AS INTEGER) END AS m FROM part)
"""
IMRO = """
SELECT p_partkey AS path, CAST(pos AS INTEGER) AS pos, e[1]::INTEGER AS ch, e[2]::INTEGER AS shank, e[3]::INTEGER AS bank,
  e[4]::INTEGER AS ref, e[5]::INTEGER AS elec
FROM (SELECT p_partkey, unnest(range(4)) AS pos, unnest([
    [0, p_partkey % 2 + 1, 0, 0, p_size * 11], [1, p_partkey % 3 + 1, 0, 0, p_partkey % 1280], [2, 1, 0, 0, p_size],
    [CASE WHEN p_partkey % 6 = 1 THEN 1 ELSE 3 END, 2, 0, 0, 5]]) AS e FROM part WHERE p_partkey % 4 <> 0
  UNION ALL SELECT p_partkey, unnest(range(2)), unnest([[0, 1, 0, 0, p_size], [1, 1, 0, 0, p_partkey % 1280]])
  FROM part WHERE p_partkey % 4 = 0)
"""
ORACLE["q_imro"] = IMRO
ORACLE["q_electrode_xy"] = f"""
WITH i AS ({IMRO}), lo AS (SELECT path, min(shank) AS low FROM i GROUP BY 1),
s AS (SELECT i.path, i.ch AS chan, arg_max(shank - low + 1, pos) AS shank, arg_max(elec, pos) AS elec FROM i JOIN lo USING (path) GROUP BY 1, 2),
g AS (SELECT p_partkey AS path, CAST(unnest(range(4)) AS INTEGER) AS chan FROM part)
SELECT g.path, g.chan, coalesce(s.shank, 1) AS shank,
  coalesce([43.0, 27.0, 59.0, 11.0][elec % 4 + 1]::DOUBLE + (s.shank - 1) * 250.0::DOUBLE, 0.0) AS x,
  coalesce((elec // 4) * 20.0::DOUBLE, 0.0) AS y FROM g LEFT JOIN s USING (path, chan)
"""
GEOM = """
SELECT p_partkey AS path, CAST(pos AS INTEGER) AS chan, 4 AS n_shank, 250.0::DOUBLE AS shank_pitch, 70.0::DOUBLE AS shank_width,
  e[1]::INTEGER AS shank, e[2]::DOUBLE AS x, e[3]::DOUBLE AS y, e[4]::INTEGER <> 0 AS connected
FROM (SELECT p_partkey, unnest(range(3)) AS pos, unnest([
  [0.0, 27.0, p_size * 15.0, 1.0], [1.0, p_partkey % 60 + 0.5, 30.0, 0.0], [3.0, 59.0, p_partkey % 700 + 0.0, 1.0]]) AS e
  FROM part WHERE p_partkey % 2 = 0)
"""
SHANK = """
SELECT path, CAST(pos AS INTEGER) AS chan, ns AS n_shank, sp AS shank_pitch, sw AS shank_width, e[1]::INTEGER AS shank,
  e[2] * hp + CASE WHEN e[3] % 2 = 0 THEN eo ELSE oo END AS x, e[3] * vp AS y, e[4] <> 0 AS connected
FROM (SELECT p_partkey AS path, p_partkey % 3 AS pn, unnest(range(3)) AS pos, unnest([
  [0, 0, p_partkey % 480, 1], [0, 1, p_size, 1], [0, p_partkey % 2, p_partkey % 77, 0]]) AS e FROM part)
JOIN (VALUES (0, 4, 250.0::DOUBLE, 70.0::DOUBLE, 27.0::DOUBLE, 27.0::DOUBLE, 32.0::DOUBLE, 15.0::DOUBLE),
  (1, 1, 0.0, 70.0, 6.75, 6.75, 4.5, 4.5), (2, 1, 0.0, 70.0, 27.0, 11.0, 32.0, 20.0)) g(pn, ns, sp, sw, eo, oo, hp, vp) USING (pn)
"""
ORACLE["q_geom_map"] = GEOM
ORACLE["q_shank_map"] = SHANK
ORACLE["q_site_coords"] = f"""
WITH a AS (SELECT * FROM ({GEOM}) UNION ALL BY NAME SELECT * FROM ({SHANK}) WHERE path % 2 = 1)
SELECT a.path, a.chan, shank * shank_pitch + x AS site_x, y, shank, connected AND a.chan <> p.p_size % 5 AS connected
FROM a JOIN part p ON p.p_partkey = a.path
"""
ORACLE["q_probe_validate"] = f"""
WITH i AS ({IMRO}), c AS (SELECT path, max(n) AS most, min(ch) AS low, max(ch) AS high FROM
  (SELECT path, ch, count(*) AS n FROM i GROUP BY ALL) GROUP BY 1),
r AS (SELECT p_partkey AS path, p_partkey % 3 + 2 AS n, length(p_name) * 4 * (p_size + 1) AS len,
  CASE WHEN p_partkey % 5 = 0 THEN p_size + 300 ELSE p_partkey % 9 + 380 END AS meta FROM part),
x AS (SELECT *, len // (2 * n) AS n_samples FROM r JOIN c USING (path))
SELECT path, 'duplicate_channel' AS problem, n_samples FROM x WHERE most > 1
UNION ALL SELECT path, 'channel_out_of_range', n_samples FROM x WHERE low < 0 OR high >= n
UNION ALL SELECT path, 'size_not_divisible', n_samples FROM x WHERE len % (2 * n) <> 0
UNION ALL SELECT path, 'channel_count_mismatch', n_samples FROM x WHERE meta <> n
"""
CENTERS = """
ch AS (SELECT p_brand AS session_id, p_partkey AS chan, ((p_partkey % 4) * 250 + (p_size % 3) * 16)::DOUBLE AS x FROM part),
xs AS (SELECT DISTINCT session_id, x FROM ch),
gp AS (SELECT *, x - lag(x) OVER (PARTITION BY session_id ORDER BY x) AS gap FROM xs),
lm AS (SELECT session_id, greatest(median(gap) * 3, quantile_cont(gap, 0.9)) AS lim FROM gp GROUP BY 1 HAVING count(*) > 1),
sg AS (SELECT gp.*, sum((coalesce(gap, 0) > lim)::INTEGER) OVER (PARTITION BY session_id ORDER BY x) AS shank FROM gp JOIN lm USING (session_id)),
ce AS (SELECT session_id, CAST(shank AS INTEGER) AS shank, avg(x) AS center, CAST(count(*) OVER (PARTITION BY session_id) AS INTEGER) AS n_shanks
  FROM sg GROUP BY session_id, shank)
"""
ORACLE["q_shanks"] = f"""WITH {CENTERS},
sp AS (SELECT session_id, median(g) AS shank_dist FROM (SELECT session_id, center - lag(center) OVER (PARTITION BY session_id ORDER BY center) AS g FROM ce) GROUP BY 1)
SELECT session_id, shank, round(center, 6) AS center, n_shanks, round(shank_dist, 6) AS shank_dist FROM ce JOIN sp USING (session_id)"""
ORACLE["q_shank_assign"] = f"""WITH {CENTERS} SELECT session_id, chan, x, shank FROM (
  SELECT ch.*, ce.shank, row_number() OVER (PARTITION BY ch.session_id, ch.chan ORDER BY abs(ch.x - ce.center), ce.shank) AS r
  FROM ch JOIN ce USING (session_id)) WHERE r = 1"""

# --- ingest -------------------------------------------------------------------------------

KEY = "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber)"
ORACLE["q_ingest_trials"] = f"""
SELECT {KEY} AS session_id, CAST(i AS INTEGER) AS trial_idx, l_returnflag AS outcome, l_quantity / 10 AS rt,
  CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE l_quantity + 1 END AS change_size, l_linenumber::DOUBLE AS orientation,
  CASE WHEN l_linenumber > 3 THEN l_quantity END AS iti, l_quantity * 2 AS change_time, l_quantity AS baseline0
FROM lineitem, (SELECT unnest([0, 1]) AS i)
"""
ORACLE["q_ingest_spikes"] = f"""
SELECT session_id, unit_id, count(*) AS n, CAST(sum(CAST(round(t * 1e6) AS BIGINT)) AS BIGINT) AS sum_us FROM (
  SELECT {KEY} AS session_id, unnest([l_quantity, l_quantity + 1.5, l_quantity + 2.25]) AS t,
    unnest([l_linenumber, -1, l_linenumber + 1]) AS unit_id FROM lineitem) GROUP BY 1, 2
"""
ORACLE["q_ingest_channels"] = f"""
SELECT {KEY} AS session_id, 'Laser' AS channel, CAST(i AS INTEGER) AS event_idx, l_quantity + i * 0.5::DOUBLE AS rise_t,
  CASE WHEN i = 0 THEN round(l_quantity + 0.1::DOUBLE, 6) END AS fall_t, 0.1::DOUBLE AS duration
FROM lineitem, (SELECT unnest([0, 1]) AS i)
"""
ORACLE["q_ingest_sessions"] = """
SELECT 'A_' || l_linestatus AS subject, l_linenumber::VARCHAR AS session_name, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS sum_good
FROM lineitem GROUP BY ALL
"""
ORACLE["q_unit_labels"] = """
SELECT CAST(doc_id AS INTEGER) AS unit_id, 'label' AS rule FROM labels WHERE doc_id % 5 IN (0, 2, 4)
UNION ALL SELECT CAST(doc_id AS INTEGER), 'type' FROM labels WHERE doc_id % 5 IN (0, 2, 3, 4)
"""

# --- branches beside the main ones ------------------------------------------------------

ORACLE["q_trial_scalar_all_bins"] = f"""WITH {POP} SELECT tg.session_id, tg.trial_idx, outcome,
  round(coalesce(s.s, 0.0) / 12.0::DOUBLE, 6) + 0.0 AS value FROM tg LEFT JOIN
  (SELECT session_id, trial_idx, sum(proj) AS s FROM pj GROUP BY 1, 2) s USING (session_id, trial_idx)"""
ORACLE["q_good_units_listed"] = f"""WITH u AS (SELECT DISTINCT session_id, unit_id FROM ({TRIAL_POINTS}))
SELECT *, 'list' AS rule FROM u WHERE (session_id + unit_id) % 3 = 0 UNION ALL SELECT *, 'off' AS rule FROM u"""
ORACLE["q_peth_float_edges"] = f"""WITH ev AS ({EV}), x AS (SELECT user_id AS session_id, event_type AS unit_id, event_id, (t_us >> 30) * 100000 AS t_us FROM ev),
p AS (SELECT * FROM x WHERE unit_id <> 'purchase'), t AS (SELECT * FROM x WHERE unit_id = 'purchase'),
nt AS (SELECT session_id, count(*) AS n FROM t GROUP BY 1),
e AS (SELECT k, -0.3::DOUBLE + k * ((-0.3::DOUBLE + 0.1::DOUBLE) - (-0.3::DOUBLE)) AS a FROM (SELECT unnest(range(16)) AS k)),
b AS (SELECT k AS bin, a, lead(a) OVER (ORDER BY k) AS z, k = 14 AS last FROM e QUALIFY z IS NOT NULL),
d AS (SELECT p.session_id, p.unit_id, (p.t_us - t.t_us) / 1e6 AS d FROM p JOIN t USING (session_id) WHERE p.t_us - t.t_us BETWEEN -1000000 AND 2000000),
c AS (SELECT session_id, unit_id, bin, count(*) AS n FROM d JOIN b ON d >= a AND (d < z OR (last AND d <= z AND d <= 1.2)) GROUP BY ALL),
g AS (SELECT DISTINCT session_id, unit_id, b.bin, (a + z) / 2 AS m FROM p, b)
SELECT g.session_id, g.unit_id, CAST(g.bin AS INTEGER) AS bin, round(m, 6) + 0.0 AS bin_center,
  CASE WHEN nt.n IS NULL THEN 0.0 ELSE round(coalesce(c.n, 0) / (nt.n * 0.1::DOUBLE), 9) END AS rate_hz, CAST(coalesce(nt.n, 0) AS BIGINT) AS n_trials
FROM g LEFT JOIN c USING (session_id, unit_id, bin) LEFT JOIN nt USING (session_id)"""
ORACLE["q_template_summary_partial"] = """WITH v AS (SELECT CAST(vec_id % 2 AS INTEGER) AS session_id, label AS unit_id, vec_id // 2 AS template_id,
    list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS amp FROM embeddings),
u AS (SELECT DISTINCT session_id, unit_id FROM v), c AS (SELECT session_id, unit_id, count(*) AS n FROM v GROUP BY ALL),
ix AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY unit_id) - 1 AS template_id FROM u)
SELECT session_id, unit_id, 0 AS n_spikes, NULL::DOUBLE AS mean_amp, true AS present, 'unclustered' AS branch FROM u
UNION ALL SELECT v.session_id, coalesce(ix.unit_id, -1), 0, round(amp, 6), true, 'templates' FROM v LEFT JOIN ix USING (session_id, template_id)
UNION ALL SELECT session_id, unit_id, n, NULL, true, 'spikes' FROM c
UNION ALL SELECT session_id, unit_id, 0, NULL, false, 'nothing' FROM u"""
ORACLE["q_top_composite"] = f"""WITH {CORR},
cn AS (SELECT * FROM pr),
iv AS (SELECT vec_id, CAST(round(abs(v) * 20) AS BIGINT) AS d, count(*)::DOUBLE / 32 AS q FROM (SELECT vec_id, v, count(*) OVER (PARTITION BY vec_id) AS m FROM w) GROUP BY ALL),
tt AS (SELECT vec_id, sum(q) AS t FROM iv GROUP BY 1), sh AS (SELECT iv.vec_id, d, q / t AS p FROM iv JOIN tt USING (vec_id)),
st2 AS (SELECT subject, session_a, session_b, unit_a, unit_b, d, p FROM cn JOIN sh ON vec_id = unit_a UNION ALL
  SELECT subject, session_a, session_b, unit_a, unit_b, d, -p FROM cn JOIN sh ON vec_id = unit_b),
ks AS (SELECT subject, session_a, session_b, unit_a, unit_b, max(abs(g)) AS k FROM (SELECT *, sum(p) OVER (
  PARTITION BY subject, session_a, session_b, unit_a, unit_b ORDER BY d) AS g FROM st2) GROUP BY ALL),
ra AS (SELECT vec_id, sum(abs(v)) AS r FROM w GROUP BY 1),
sc AS (SELECT cn.*, k, least(a.r, b.r) / greatest(a.r, b.r) AS ratio, (c + 1 - k + least(a.r, b.r) / greatest(a.r, b.r)) / 3 AS comp
  FROM cn JOIN ks USING (subject, session_a, session_b, unit_a, unit_b)
  JOIN ra a ON a.vec_id = unit_a JOIN ra b ON b.vec_id = unit_b)
SELECT subject, session_a, session_b, unit_a, unit_b, round(c, 6) + 0.0 AS waveform_corr, round(k, 6) AS isi_ks, round(ratio, 6) AS firing_rate_ratio,
  round(comp, 6) + 0.0 AS composite_score,
  CAST(row_number() OVER (PARTITION BY subject, session_a, session_b ORDER BY round(comp, 9) DESC, unit_a, unit_b) AS INTEGER) AS rank
FROM sc QUALIFY rank <= 5"""
_EVEN = CENTERS.replace("((p_partkey % 4) * 250 + (p_size % 3) * 16)::DOUBLE", """CASE WHEN right(p_brand, 1)::INTEGER % 2 = 0
  THEN (p_partkey % 7 * 20)::DOUBLE ELSE ((p_partkey % 4) * 250 + (p_size % 3) * 16)::DOUBLE END""")
ORACLE["q_shanks_expected"] = f"""WITH {_EVEN},
qs AS (SELECT session_id, quantile_cont(x, [0, 1 / 3.0::DOUBLE, 2 / 3.0::DOUBLE, 1]) AS q FROM xs
  WHERE session_id IN (SELECT session_id FROM ce WHERE n_shanks = 1) GROUP BY 1),
pt AS (SELECT session_id, s AS shank, q[s + 1] AS a, q[s + 2] AS b FROM qs, (SELECT unnest(range(3)) AS s))
SELECT session_id, shank, round(center, 6) AS center, n_shanks FROM ce WHERE n_shanks > 1
UNION ALL SELECT session_id, CAST(shank AS INTEGER), round(coalesce(avg(x) FILTER (x >= a AND x <= b), any_value((a + b) / 2)), 6), 3
FROM pt JOIN xs USING (session_id) GROUP BY session_id, shank"""
