"""Probe metadata: key=value text, electrode tables, site coordinates, shank geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Aliases in order of preference.
CHANNEL_COUNT_KEYS = ("nSavedChans", "nChannels", "nChans", "num_channels", "n_channels")
SAMPLE_RATE_KEYS = ("sampleRate", "sr", "imSampRate", "niSampRate", "sample_rate", "sampling_rate")
DEFAULT_CHANNELS = 384

# Geometry by part number, in micrometres:
# shanks, shank width, shank pitch, even-row x offset, odd-row x offset, column pitch, row pitch,
# rows per shank, electrodes per shank.
GEOMETRY = [
    (("3A", "PRB_1_4_0480_1", "PRB_1_4_0480_1_C", "NP1010", "NP1011", "NP1012", "NP1013"),
     (1, 70, 0, 27, 11, 32, 20, 480, 960)),
    (("NP1015", "NP1016", "NP1017"), (1, 70, 0, 27, 27, 32, 20, 480, 960)),
    (("NP1020", "NP1021"), (1, 125, 0, 27, 11, 87, 20, 1368, 2496)),
    (("NP1030", "NP1031"), (1, 125, 0, 27, 11, 87, 20, 2208, 4416)),
    (("NP1022",), (1, 125, 0, 11, 11, 103, 20, 1368, 2496)),
    (("NP1032",), (1, 125, 0, 11, 11, 103, 20, 2208, 4416)),
    (("NP1100",), (1, 70, 0, 14, 14, 6, 6, 48, 384)),
    (("NP1110",), (1, 70, 0, 14, 14, 6, 6, 768, 6144)),
    (("PRB2_1_4_0480_1", "PRB2_1_2_0640_0", "NP2000", "NP2003", "NP2004"), (1, 70, 0, 27, 27, 32, 15, 640, 1280)),
    (("PRB2_4_2_0640_0", "PRB2_4_4_0480_1", "NP2010", "NP2013", "NP2014"), (4, 70, 250, 27, 27, 32, 15, 640, 1280)),
    (("NP1120",), (1, 70, 0, 6.75, 6.75, 4.5, 4.5, 192, 384)),
    (("NP1121",), (1, 70, 0, 6.25, 6.25, 3, 3, 384, 384)),
    (("NP1122",), (1, 70, 0, 6.75, 6.75, 4.5, 4.5, 24, 384)),
    (("NP1123",), (1, 70, 0, 10.25, 10.25, 3, 3, 32, 384)),
    (("NP1300",), (1, 70, 0, 11, 11, 48, 20, 480, 960)),
    (("NP1200",), (1, 70, 0, 27, 11, 32, 20, 64, 128)),
    (("NXT3000",), (1, 70, 0, 53, 53, 0, 15, 128, 128)),
]
# Column x offsets and pitches of the four-shank electrode layout.
COLUMN_X = (43.0, 27.0, 59.0, 11.0)
ROW_PITCH, SHANK_PITCH, COLUMNS = 20.0, 250.0, 4


def meta_map(text: Column, strip_tilde: bool = True) -> Column:
    """``key=value`` lines as a map; the last of repeated keys wins."""
    lines = F.filter(F.split(text, r"\r?\n"), lambda s: s.contains("="))
    key_of = (lambda s: F.regexp_replace(F.trim(F.substring_index(s, "=", 1)), "^~", "")) if strip_tilde else (
        lambda s: F.trim(F.substring_index(s, "=", 1)))
    entries = F.transform(lines, lambda s: F.struct(
        key_of(s).alias("k"), F.trim(s.substr(F.instr(s, F.lit("=")) + 1, F.length(s))).alias("v")))
    return F.aggregate(
        F.reverse(entries), F.create_map().cast("map<string,string>"),
        lambda m, e: F.when(F.map_contains_key(m, e["k"]), m).otherwise(
            F.map_concat(m, F.create_map(e["k"], e["v"]))))


def _first(meta: Column, keys: tuple[str, ...], kind: str) -> Column:
    return F.coalesce(*[F.try_element_at(meta, F.lit(k)).try_cast(kind) for k in keys])


def read_meta(files: DataFrame, strip_tilde: bool = True) -> DataFrame:
    """``files(path, text)`` to (path, meta, n_channels, fs); channel count defaults to 384."""
    m = files.select("path", meta_map(F.col("text"), strip_tilde).alias("meta"))
    return m.withColumns({
        "n_channels_meta": _first(F.col("meta"), CHANNEL_COUNT_KEYS, "int"),
        "fs": _first(F.col("meta"), SAMPLE_RATE_KEYS, "double"),
    }).withColumn("n_channels", F.coalesce("n_channels_meta", F.lit(DEFAULT_CHANNELS)))


def read_imro(files: DataFrame) -> DataFrame:
    """Electrode rows (path, pos, ch, shank, bank, ref, elec) in text order.

    Five numbers in brackets make an entry; a text with none is read as runs of five.
    """
    bracketed = F.transform(F.regexp_extract_all("text", F.lit(r"\(([^()]*)\)"), F.lit(1)),
                            lambda g: F.split(F.regexp_replace(g, r"^\s+|\s+$", ""), r"\s+"))
    groups = F.filter(bracketed, lambda e: (F.size(e) == 5) & F.forall(e, lambda x: x.rlike("^[0-9]+$")))
    nums = F.regexp_extract_all("text", F.lit(r"(\d+)"), F.lit(1))
    runs = F.when(F.size(nums) >= 5, F.transform(
        F.sequence(F.lit(0), F.floor(F.size(nums) / 5).cast("int") - 1), lambda i: F.slice(nums, i * 5 + 1, 5)))
    entries = F.when(F.size(groups) > 0, groups).otherwise(runs)
    t = files.select("path", F.posexplode(entries).alias("pos", "e"))
    return t.select("path", "pos", *[
        F.get("e", F.lit(i)).cast("int").alias(n) for i, n in enumerate(("ch", "shank", "bank", "ref", "elec"))])


def electrode_xy(imro: DataFrame, sizes: DataFrame) -> DataFrame:
    """Coordinates of channels 0 … N-1 of each path; ``sizes(path, n_channels)``.

    Row and column follow from the electrode number, shanks are renumbered from 1. A
    channel not listed sits at (0, 0) on shank 1; of repeated entries the last counts.
    """
    lowest = imro.groupBy("path").agg(F.min("shank").alias("low"))
    site = imro.join(lowest, "path").groupBy("path", F.col("ch").alias("chan")).agg(
        F.max_by(F.struct((F.col("shank") - F.col("low") + 1).alias("shank"), "elec"), "pos").alias("e"))
    col_x = F.get(F.array(*[F.lit(v) for v in COLUMN_X]), F.col("e.elec") % COLUMNS)
    zero = F.lit(0.0)
    return (
        sizes.where("n_channels > 0")
        .select("path", F.explode(F.sequence(F.lit(0), F.col("n_channels") - 1)).alias("chan"))
        .join(site, ["path", "chan"], "left")
        .select("path", "chan", F.coalesce("e.shank", F.lit(1)).alias("shank"),
                F.coalesce(col_x + (F.col("e.shank") - 1) * SHANK_PITCH, zero).alias("x"),
                F.coalesce(F.floor(F.col("e.elec") / COLUMNS) * ROW_PITCH, zero).alias("y"),
                F.lit(True).alias("connected"))
    )


def _map_entries(value: Column) -> Column:
    """``(a:b:c:d)`` entries after the header, as arrays of four strings."""
    return F.transform(
        F.regexp_extract_all(value, F.lit(r"\(([^():]+:[^():]+:[^():]+:[^():]+)\)"), F.lit(1)),
        lambda s: F.split(s, ":"))


def geometry_map_sites(metas: DataFrame) -> DataFrame:
    """Sites from the geometry map of ``metas(path, meta)``: its header and (shank:x:y:used) entries."""
    value = F.try_element_at("meta", F.lit("snsGeomMap"))
    head = F.split(F.regexp_extract(value, r"^\(([^)]*)\)", 1), ",")
    t = metas.where(value.isNotNull()).select(
        "path", F.get(head, F.lit(1)).cast("int").alias("n_shank"),
        F.get(head, F.lit(2)).cast("double").alias("shank_pitch"),
        F.get(head, F.lit(3)).cast("double").alias("shank_width"),
        F.posexplode(_map_entries(value)).alias("chan", "e"))
    return t.select(
        "path", "chan", "n_shank", "shank_pitch", "shank_width", F.get("e", F.lit(0)).cast("int").alias("shank"),
        F.get("e", F.lit(1)).cast("double").alias("x"), F.get("e", F.lit(2)).cast("double").alias("y"),
        (F.get("e", F.lit(3)).cast("int") != 0).alias("connected"))


def geometry_table(spark) -> DataFrame:
    """One row per part number, some forty in all."""
    rows = [(pn, int(g[0]), *[float(v) for v in g[1:7]], int(g[7]), int(g[8])) for pns, g in GEOMETRY for pn in pns]
    return spark.createDataFrame(
        rows, "part_no string, n_shank int, shank_width double, shank_pitch double, even_off double, "
              "odd_off double, h_pitch double, v_pitch double, rows_per_shank int, elec_per_shank int")


def shank_map_sites(metas: DataFrame) -> DataFrame:
    """Sites from the shank map: (shank:col:row:used) of the saved AP channels and the part's geometry.

    A file without a part number is a 3A; unknown part numbers give no sites.
    """
    value = F.try_element_at("meta", F.lit("snsShankMap"))
    part = F.coalesce(F.try_element_at("meta", F.lit("imDatPrb_pn")), F.lit("3A"))
    n_ap = F.get(F.split(F.try_element_at("meta", F.lit("snsApLfSy")), ","), F.lit(0)).cast("int")
    t = metas.where(value.isNotNull()).select(
        "path", part.alias("part_no"), n_ap.alias("n_ap"), F.posexplode(_map_entries(value)).alias("chan", "e")
    ).where("n_ap is null or chan < n_ap")
    row = F.get("e", F.lit(2)).cast("int")
    off = F.when(row % 2 == 0, F.col("even_off")).otherwise(F.col("odd_off"))
    return t.join(F.broadcast(geometry_table(metas.sparkSession)), "part_no").select(
        "path", "chan", "n_shank", "shank_pitch", "shank_width", F.get("e", F.lit(0)).cast("int").alias("shank"),
        (F.get("e", F.lit(1)).cast("int") * F.col("h_pitch") + off).alias("x"), (row * F.col("v_pitch")).alias("y"),
        (F.get("e", F.lit(3)).cast("int") != 0).alias("connected"))


def site_coordinates(metas: DataFrame, bad: DataFrame | None = None) -> DataFrame:
    """Position of each site along the probe; the geometry map is preferred to the shank map.

    ``bad(path, chan)`` channels are marked unconnected.
    """
    has_geom = F.try_element_at("meta", F.lit("snsGeomMap")).isNotNull()
    sites = geometry_map_sites(metas).unionByName(shank_map_sites(metas.where(~has_geom)))
    out = sites.withColumn("site_x", F.col("shank") * F.col("shank_pitch") + F.col("x"))
    if bad is None:
        return out
    return out.join(bad.select("path", "chan", F.lit(True).alias("bad")).distinct(), ["path", "chan"], "left").withColumn(
        "connected", F.col("connected") & F.col("bad").isNull()).drop("bad")


def validate_probe(imro: DataFrame, recordings: DataFrame, item_size: int = 2) -> DataFrame:
    """Problems per path: repeated channels, channels out of range, odd file size, count mismatch.

    ``recordings(path, n_channels, n_channels_meta, length)``.
    """
    per = imro.groupBy("path", "ch").agg(F.count(F.lit(1)).alias("n")).groupBy("path").agg(
        F.max("n").alias("most"), F.min("ch").alias("low"), F.max("ch").alias("high"))
    t = recordings.join(per, "path", "left")
    frame = F.lit(item_size) * F.col("n_channels")
    checks = {
        "duplicate_channel": F.col("most") > 1,
        "channel_out_of_range": (F.col("low") < 0) | (F.col("high") >= F.col("n_channels")),
        "size_not_divisible": F.col("length") % frame != 0,
        "channel_count_mismatch": F.col("n_channels_meta") != F.col("n_channels"),
    }
    n_samples = F.floor(F.col("length") / frame)
    return t.select("path", n_samples.alias("n_samples"), F.explode(F.array(*[
        F.struct(F.lit(n).alias("problem"), F.coalesce(c, F.lit(False)).alias("found")) for n, c in checks.items()
    ])).alias("s")).where("s.found").select("path", "s.problem", "n_samples")


def shank_centers(channels: DataFrame, expected_shanks: int | None = None, gap_factor: float = 3.0) -> DataFrame:
    """(session, shank, center, n_shanks): groups of x positions separated by large gaps.

    A gap is large beyond the greater of gap_factor times the median gap and the 90th
    percentile. With no large gap the positions are cut at quantiles into the expected
    number. Works on the distinct positions of a probe, a few hundred per session at most.
    """
    by = "session_id"
    xs = channels.select(by, F.round("x", 6).alias("x")).distinct()
    order = Window.partitionBy(by).orderBy("x")
    gaps = xs.withColumn("gap", F.col("x") - F.lag("x").over(order))
    limit = gaps.groupBy(by).agg(
        F.greatest(F.median("gap") * gap_factor, F.percentile("gap", 0.9)).alias("limit"),
        F.count(F.lit(1)).alias("n_x")).where("n_x > 1")
    seg = gaps.join(limit, by).withColumn(
        "shank", F.sum(F.when(F.col("gap") > F.col("limit"), 1).otherwise(0)).over(order.rowsBetween(
            Window.unboundedPreceding, Window.currentRow)).cast("int"))
    centers = seg.groupBy(by, "shank").agg(F.avg("x").alias("center"))
    n = centers.groupBy(by).agg(F.count(F.lit(1)).cast("int").alias("n_shanks"))
    found = centers.join(n, by)
    if not expected_shanks or expected_shanks <= 1:
        return found.select(by, "shank", "center", "n_shanks")
    k = expected_shanks
    single = n.where("n_shanks = 1").select(by)
    cuts = xs.join(single, by).groupBy(by).agg(
        F.percentile("x", F.array(*[F.lit(i / k) for i in range(k + 1)])).alias("q"))
    parts = cuts.select(by, "q", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("shank")).select(
        by, "shank", F.get("q", F.col("shank")).alias("a"), F.get("q", F.col("shank") + 1).alias("b"))
    split = parts.join(xs, by).groupBy(by, "shank").agg(
        F.coalesce(F.avg(F.when((F.col("x") >= F.col("a")) & (F.col("x") <= F.col("b")), F.col("x"))),
                   F.first((F.col("a") + F.col("b")) / 2)).alias("center"),
    ).withColumn("n_shanks", F.lit(k))
    return found.where("n_shanks > 1").select(by, "shank", "center", "n_shanks").unionByName(split)


def assign_shanks(channels: DataFrame, centers: DataFrame) -> DataFrame:
    """Nearest centre per channel, the first of equals; ``centers`` hold a few rows per session."""
    best = F.min_by("shank", F.struct(F.abs(F.col("x") - F.col("center")), F.col("shank")))
    return channels.join(centers.select("session_id", "shank", "center"), "session_id").groupBy(
        "session_id", "chan", "x").agg(best.alias("shank"))


def shank_spacing(centers: DataFrame) -> DataFrame:
    """Shanks and the median distance of adjacent centres (NULL for one shank)."""
    gap = F.col("center") - F.lag("center").over(Window.partitionBy("session_id").orderBy("center"))
    return centers.withColumn("gap", gap).groupBy("session_id").agg(
        F.max("n_shanks").alias("n_shanks"), F.median("gap").alias("shank_dist"))
