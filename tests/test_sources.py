import json

import numpy as np
import pytest

from pyspark.sql import functions as F

from trigflow.functions.ticks import bin_grid
from trigflow.operators import manifest, probe
from trigflow.plans import analyses
from trigflow.sources import manifest as files
from trigflow.sources import sessions as src
from trigflow.sources import sinks, sorter


def record(name, n_trials=24, seed=0):
    """A session whose unit 1 fires after the change on Hit trials."""
    rng = np.random.default_rng(seed)
    outcomes = ["Hit", "Miss", "FA", "abort"]
    trials, base, change, st, clu = [], [], [], [], []
    for i in range(n_trials):
        o = outcomes[i % 4]
        t0 = 10.0 * i + 5
        base.append(t0)
        change.append(t0 + 4)
        key = "RT" if o == "Hit" else o
        trials.append({"trialoutcome": o, "reactiontimes": {key: 3.6 if o == "FA" else 2.5}, "Stim2TF": 1.5, "stimT": 4.0})
        for u, n in ((1, 40 if o == "Hit" else 3), (2, 6)):
            st += list(t0 + 4 + rng.uniform(-0.5, 1.0, n)) + list(t0 + rng.uniform(0, 4, n))
            clu += [u] * (2 * n)
    st.append(1.0)
    clu.append(7)
    return {"behav_data": {"trials_data_exp": trials},
            "NPX_probes": {"st": st, "clu": clu, "cluster_id_KS_good": ["2", " 1.0 ", "x", ""]},
            "NI_events": {"session_name": name, "channels": {
                "Baseline_ON": {"rise_t": base}, "Change_ON": {"rise_t": change},
                "Laser": {"rise_t": [1.0, 2.0], "fall_t": [1.01, 2.01], "duration": [0.01, 0.01]}, "Off": None}}}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("rec")
    for name in ("AB_012_260325", "AB_012_270325"):
        (d / f"{name}.json").write_text(json.dumps(record(name, seed=len(name))))
    src.save_tables(src.normalised_tables(src.read_records(spark, str(d / "*.json"))), str(d / "tables"))
    return src.load_tables(spark, str(d / "tables"))


def test_ingest(tables):
    s = {r.session_id: r for r in tables["sessions"].collect()}
    assert s["AB_012_260325"].subject == "AB_012" and s["AB_012_260325"].session_name == "260325"
    assert s["AB_012_260325"].good_unit_ids == [1, 2]
    t = tables["trials"].where("session_id = 'AB_012_260325' and trial_idx = 2").first()
    assert (t.outcome, t.change_size, t.change_time, t.reactiontimes) == ("FA", 1.5, 4.0, {"FA": 3.6})
    ev = tables["channel_events"].where("channel = 'Laser'").orderBy("session_id", "event_idx").first()
    assert (ev.rise_t, ev.fall_t, ev.duration, ev.rise_us) == (1.0, 1.01, 0.01, 1_000_000)
    assert {r.unit_id for r in tables["units"].collect()} == {1, 2, 7}


def test_save_and_reload(spark, tables, tmp_path):
    src.save_tables(tables, str(tmp_path))
    back = src.load_tables(spark, str(tmp_path))
    for name, df in tables.items():
        assert back[name].count() == df.count()
        assert set(back[name].columns) == set(df.columns)
    assert back["sessions"].where("session_id = 'AB_012_260325'").count() == 1


def test_event_response_and_cache(spark, tables, tmp_path):
    grid = bin_grid((-0.5, 1.0), 0.5)
    out = analyses.event_response(tables, "Change_ON", grid)
    assert {r.unit_id for r in out.select("unit_id").distinct().collect()} == {1, 2}
    total = out.where("unit_id = 2").groupBy("session_id").sum("rate_hz").first()[1]
    assert total == pytest.approx(6 / 0.5, rel=0.35)
    sinks.write_response_cache(out, str(tmp_path / "c"), "Change_ON", grid, sigma=1.0)
    back = sinks.read_response_cache(spark, str(tmp_path / "c"))
    assert back.count() == 2 * 2 * 3 and {"rate_smoothed", "bin_size_s"} <= set(back.columns)
    assert analyses.event_response(tables, "Hit", grid).first().n_trials == 6


def test_cache_is_consulted(spark, tables, tmp_path, monkeypatch):
    grid, root = bin_grid((-0.5, 1.0), 0.5), str(tmp_path / "cache")
    plain = analyses.event_response(tables, "Change_ON", grid)
    columns = ["session_id", "unit_id", "bin", "rate_hz", "n_trials"]
    want = sorted(map(tuple, plain.select(*columns).collect()))
    one = {**tables, "sessions": tables["sessions"].where("session_id = 'AB_012_260325'")}
    calls, whole = [], analyses.event_response
    monkeypatch.setattr(analyses, "event_response", lambda t, *a: calls.append({r[0] for r in t["sessions"].select("session_id").collect()}) or whole(t, *a))
    analyses.cached_event_response(spark, one, "Change_ON", root, grid)
    got = analyses.cached_event_response(spark, tables, "Change_ON", root, grid)
    assert sorted(map(tuple, got.select(*columns).collect())) == want
    every = {r[0] for r in tables["sessions"].select("session_id").collect()}
    assert calls == [{"AB_012_260325"}, every - {"AB_012_260325"}]  # only what is new
    unread = {name: t if name == "sessions" else None for name, t in tables.items()}
    again = analyses.cached_event_response(spark, unread, "Change_ON", root, grid)  # no spikes to read
    assert sorted(map(tuple, again.select(*columns).collect())) == want and len(calls) == 2
    files = len(spark.read.parquet(f"{root}/rows").inputFiles())
    other = analyses.cached_event_response(spark, tables, "Change_ON", root, bin_grid((-0.5, 1.0), 0.25), sigma=1.0)
    assert other.where("rate_smoothed is null").count() == 0 and other.select("bin").distinct().count() == 6 and len(calls) == 3
    back = analyses.cached_event_response(spark, unread, "Change_ON", root, grid)
    assert sorted(map(tuple, back.select(*columns).collect())) == want
    assert len(spark.read.parquet(f"{root}/rows").inputFiles()) > files
    # Rows of a run that died before its entries are not read.
    spark.read.parquet(f"{root}/rows").withColumn("batch", F.lit("lost")).write.mode("append").parquet(f"{root}/rows")
    assert analyses.cached_event_response(spark, unread, "Change_ON", root, grid).count() == len(want)


def test_choice_analysis(tables):
    got = analyses.choice_analysis(tables, bin_grid((-0.5, 1.0), 0.25), n_permutations=19)
    eff = got["effects"].collect()
    assert len(eff) == 12 and all(r.p_value == pytest.approx(0.05) for r in eff)
    stats = {(r.session_id, r.grp): r for r in got["change_stats"].collect()}
    assert stats["AB_012_260325", "Hit"].n == 6
    assert stats["AB_012_260325", "Hit"].mean > stats["AB_012_260325", "Miss"].mean
    base = {r.grp for r in got["baseline_stats"].collect()}
    assert base == {"Hit", "Miss", "FA>3s", "Abort"}
    assert got["baseline_tests"].where("group_a = 'Hit' and group_b = 'FA>3s'").first().p_value < 0.01


def test_response_tagging_blocks(spark):
    on = [1.0, 2.0, 3.0, 10.0, 11.0]
    laser = spark.createDataFrame([("s", i, t, t + 0.01, 0.01) for i, t in enumerate(on)],
                                  "session_id string, event_idx int, rise double, fall double, duration double")
    spikes = spark.createDataFrame([("s", 1, t + 0.002) for t in on[:3]] + [("s", 1, 0.0), ("s", 1, 14.0)],
                                   "session_id string, unit_id int, t double")
    got = analyses.response_tagging(spikes, laser, n_iters=5, split_blocks=True, method="pairs")
    assert got["units"].first().reliability == pytest.approx(0.6)
    rel = {r.block_id: r.reliability for r in got["block_units"].collect()}
    assert rel == {0: 1.0, 1: 0.0}
    shapes = spark.createDataFrame([("s", 1, 100.0, 300.0)], "session_id string, unit_id int, peak_width_us double, peak_valley_us double")
    got = analyses.response_tagging(spikes, laser, shapes, n_iters=5, split_blocks=True, method="pairs")
    assert {(r.block_id, r.wf_peak_width_us) for r in got["block_units"].collect()} == {(0, 100.0), (1, 100.0)}


def test_report_guard(spark, tmp_path):
    path = str(tmp_path / "r")
    sinks.write_report(spark.range(3), path)
    sinks.write_report(spark.range(5), path)
    assert spark.read.option("header", "true").csv(path).count() == 3
    sinks.write_report(spark.range(5), path, "json", overwrite=True)
    assert spark.read.json(path).count() == 5


def test_sorter_arrays(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sorter, "SLICE_ROWS", 4)
    for f, extra in (("a", "spike_clusters.npy"), ("b", "spike_clusters_ks.npy")):
        d = tmp_path / f
        d.mkdir()
        np.save(d / "spike_times.npy", np.array([10, 20, 30, 40, 50]))
        np.save(d / extra, np.array([[1], [1], [2], [2], [3]]))
        np.save(d / "spike_templates.npy", np.array([0, 1, 1, 0, 0]))
        np.save(d / "templates.npy", np.arange(12.0).reshape(2, 3, 2))
    np.save(tmp_path / "a" / "spike_cluster.npy", np.zeros(5))
    tabs = sorter.sorter_tables(sorter.read_sorter_arrays(spark, [str(tmp_path / "a"), str(tmp_path / "b")]))
    got = sorted((r.session_id[-1], r.t, r.unit_id, r.template_id) for r in tabs["spikes"].collect())
    assert got[:2] == [("a", 10.0, 1, 0), ("a", 20.0, 1, 1)] and len(got) == 10
    w = {(r.template_id, r.channel, r.sample): r.value for r in tabs["templates"].where(
        "session_id like '%/a'").collect()}
    assert len(w) == 12 and w[1, 2, 1] == 11.0 and w[0, 1, 0] == 2.0


def test_manifest_from_disk(spark, tmp_path):
    for p in ("one/rez.mat", "two/spike_times.npy", "two/cluster_info.tsv", "three/spike_times.npy", "three/raw.BIN",
              "session_9/notes.txt", "session_9/myChanMap.mat", "session_9/Phy_x/deep/params.py", "plain/readme.md",
              "a/b/c/d/e/rez.mat", "four/templates.npy", "four/RawWaveforms/U1.npy"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    listed = files.list_files(spark, str(tmp_path))
    got = {r.path[len(str(tmp_path)) + 1:]: (r.status, r.notes) for r in
           manifest.folder_status(listed, str(tmp_path), 4).collect()}
    assert {k: v[0] for k, v in got.items()} == {
        "one": "Complete", "two": "Complete", "three": "Likely Complete", "session_9": "Likely Complete",
        "four": "Incomplete"}
    assert got["four"][1] == "spikes" and got["three"][1] == "spikes+raw"
    conf = spark.createDataFrame([(str(tmp_path / "four"),), (str(tmp_path / "gone"),)], "path string")
    checked = {r.path[-4:]: r for r in manifest.required_artifacts(conf, listed).collect()}
    assert checked["four"].exists and checked["four"].has_raw_waveforms and not checked["four"].has_spike_times
    assert not checked["gone"].exists


def test_probe_texts(spark, tmp_path):
    (tmp_path / "m.meta").write_text("nSavedChans=bad\nnChans=4\n~snsShankMap=(1,2,480)(0:1:3:1)(0:0:2:0)\n"
                                     "snsApLfSy=1,0,1\nimSampRate=30000.5\nnote=a=b\n")
    meta = probe.read_meta(files.read_texts(spark, str(tmp_path / "*.meta")))
    m = meta.first()
    assert (m.n_channels, m.fs, m.meta["note"]) == (4, 30000.5, "a=b")
    s = probe.site_coordinates(meta).collect()
    assert [(r.chan, r.x, r.y, r.connected) for r in s] == [(0, 43.0, 60.0, True)]
    im = spark.createDataFrame([("p", "(24,2)(0 1 0 0 288)(1 2 0 0 3)")], "path string, text string")
    xy = {r.chan: (r.shank, r.x, r.y) for r in probe.electrode_xy(
        probe.read_imro(im), spark.createDataFrame([("p", 3)], "path string, n_channels int")).collect()}
    assert xy == {0: (1, 43.0, 1440.0), 1: (2, 11.0 + 250, 0.0), 2: (1, 0.0, 0.0)}


def test_shanks(spark):
    rows = [("p", i, x) for i, x in enumerate([0, 32, 250, 282, 500, 532, 750, 782.0])]
    ch = spark.createDataFrame([(s, i, float(x)) for s, i, x in rows] + [("q", 0, 0.0), ("q", 1, 10.0), ("r", 0, 5.0)],
                               "session_id string, chan int, x double")
    c = probe.shank_centers(ch)
    got = sorted((r.shank, r.center) for r in c.where("session_id = 'p'").collect())
    assert got[0][1] == pytest.approx(391.0)  # gaps of 32 and 218: none exceeds three medians
    forced = probe.shank_centers(ch, expected_shanks=4).where("session_id = 'p'")
    assert [r.center for r in forced.orderBy("shank").collect()] == pytest.approx([16, 266, 516, 766])
    assign = {r.chan: r.shank for r in probe.assign_shanks(ch.where("session_id = 'p'"), forced).collect()}
    assert assign == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 2, 6: 3, 7: 3}
    assert probe.shank_spacing(forced).first().shank_dist == 250.0
    assert c.where("session_id = 'r'").count() == 0


def test_units_are_handed_out_by_id(spark):
    rows = [("b", 2, 0), ("a", 10, 1), ("a", 2, 0), ("a", 10, 0)]
    got = sinks.ordered_units(spark.createDataFrame(rows, "session_id string, unit_id int, block_id int")).collect()
    assert [tuple(r) for r in got] == sorted(rows)


def test_sorter_files_are_read_in_ranges(spark, tmp_path):
    folder = tmp_path / "s"
    folder.mkdir()
    times, deep = np.arange(1000, dtype=np.int64), np.arange(24.0).reshape(2, 3, 4)
    np.save(folder / "spike_times.npy", times)
    np.save(folder / "templates.npy", np.asfortranarray(deep))
    (folder / "spike_time.npy").write_bytes(b"replaced, and no array at all")  # must not be opened
    (folder / "spike_clusters.npy").write_bytes(b"broken")
    got = sorter.read_sorter_arrays(spark, str(folder), ["spike_times", "templates"], range_bytes=800)
    assert got.rdd.getNumPartitions() == 11  # ten ranges of a hundred longs, one of doubles
    rows = got.collect()
    assert sorted((r.idx, r.value) for r in rows if r.array == "spike_times") == [(i, float(i)) for i in range(1000)]
    assert {(r.idx, r.channel, r.sample): r.value for r in rows if r.array == "templates"} == {
        (i, j, k): deep[i, j, k] for i in range(2) for j in range(3) for k in range(4)}
    assert sorter.read_sorter_arrays(spark, str(folder), ["spike_templates"]).count() == 0
