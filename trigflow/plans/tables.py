"""The shared test tables seen as recordings: points, triggers, trials, population, …"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigflow.functions.ticks import timestamp_to_ticks
from trigflow.operators.running import dealt, row_rank


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # The tables' timestamps carry no zone; ticks are counted from the epoch in UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("t_us", timestamp_to_ticks(F.col("ts")))


def global_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session; a unit is a user; points are everything but purchases."""
    return _events(spark, sf_dir).where("event_type <> 'purchase'").select(
        F.lit("all").alias("session_id"), F.col("user_id").alias("unit_id"), "t_us")


def global_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).where("event_type = 'purchase'").select(
        F.lit("all").alias("session_id"), F.col("event_id").alias("trigger_id"), "t_us")


def user_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session is a user; a unit is an event type."""
    return _events(spark, sf_dir).where("event_type <> 'purchase'").select(
        F.col("user_id").alias("session_id"), F.col("event_type").alias("unit_id"), "t_us")


def user_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).where("event_type = 'purchase'").select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("trigger_id"), "t_us")


def all_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event: session = event type, unit = user."""
    return _events(spark, sf_dir).select(
        F.col("event_type").alias("session_id"), F.col("user_id").alias("unit_id"), "t_us", "value")


def all_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every purchase as a trigger of every event type's session."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    return _events(spark, sf_dir).where("event_type = 'purchase'").select(
        F.explode(F.array(*[F.lit(k) for k in kinds])).alias("session_id"),
        F.col("event_id").alias("trigger_id"), "t_us")


def units_of(points: DataFrame) -> DataFrame:
    return points.select("session_id", "unit_id").distinct()


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as trials: session = customer, position = date order.

    Outcome from the status (F Hit, O Miss, P FA; 5-LOW is an abort); the latency, the
    change time and missing values come from the price and the key.
    """
    orders = read(spark, sf_dir, "orders")
    ranked = row_rank(
        orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.unix_date(F.col("o_orderdate").cast("date"))
    )
    outcome = (
        F.when(F.col("o_orderpriority") == "5-LOW", "abort")
        .when(F.col("o_orderstatus") == "F", "Hit")
        .when(F.col("o_orderstatus") == "O", "Miss")
        .otherwise("FA")
    )
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    key = F.when(outcome == "Hit", "RT").otherwise(outcome)
    latency = (cents % 500) / 100.0
    rts = F.when(F.col("o_orderkey") % 11 == 0, F.create_map().cast("map<string,double>")).otherwise(
        F.create_map(key, latency)
    )
    return ranked.select(
        F.col("o_custkey").alias("session_id"),
        (F.col("rank") - 1).cast("int").alias("trial_idx"),
        F.col("o_orderkey").alias("order_key"),
        outcome.alias("outcome"),
        rts.alias("reactiontimes"),
        F.when(F.col("o_orderkey") % 13 != 0, (cents % 700) / 100.0).alias("change_time"),
        (timestamp_to_ticks(F.col("o_orderdate")) + cents).alias("start_us"),
        cents.alias("cents"),
        F.col("o_orderpriority").alias("priority"),
    )


def trial_channels(trials_df: DataFrame) -> DataFrame:
    """Channel rises by position; Change_ON has no entry past the trials of even keys."""
    base = trials_df.select("session_id", F.lit("Baseline_ON").alias("channel"),
                            F.col("trial_idx").alias("event_idx"), F.col("start_us").alias("rise_us"))
    change = trials_df.where(F.col("order_key") % 5 != 0).select(
        "session_id", F.lit("Change_ON").alias("channel"), F.col("trial_idx").alias("event_idx"),
        (F.col("start_us") + 1_000_000 + (F.col("cents") % 400) * 10_000).alias("rise_us"))
    return base.unionByName(change)


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse trials x bins x units: session = priority, trial = order, bin = ship month,
    unit = line number, rate = quantity."""
    lines = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("trial_idx"), F.month("l_shipdate").alias("m"),
        F.col("l_linenumber").alias("unit_id"), "l_quantity")
    orders = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("trial_idx"), F.col("o_orderpriority").alias("session_id"))
    return (
        dealt(lines, "trial_idx").join(orders, "trial_idx")
        .groupBy("session_id", "trial_idx", (F.col("m") - 1).alias("bin"), "unit_id")
        .agg(F.sum("l_quantity").alias("rate"))
    )


N_POP_BINS = 12


def population_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All trials of the population with their outcome."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("session_id"), F.col("o_orderkey").alias("trial_idx"),
        F.when(F.col("o_orderstatus") == "F", "Hit").when(F.col("o_orderstatus") == "O", "Miss")
        .otherwise("FA").alias("outcome"),
        ((F.col("o_orderkey") % 9) / 1.5).alias("fa_latency"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as waveforms: 8 channels x 8 samples, two sessions."""
    return read(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") % 2).cast("int").alias("session_id"), F.col("vec_id").alias("template_id"),
        F.col("label").alias("unit_id"), "embedding")


def long_waveforms(vec: DataFrame, key: str) -> DataFrame:
    return vec.select("session_id", key, F.posexplode("embedding").alias("pos", "v")).select(
        "session_id", key, F.floor(F.col("pos") / 8).cast("int").alias("channel"),
        (F.col("pos") % 8).cast("int").alias("sample"), F.col("v").cast("double").alias("value"))


def trial_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as points some seconds after their order starts; session = customer, unit = line number."""
    lines = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("unit_id"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("c"))
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("session_id"),
        (timestamp_to_ticks(F.col("o_orderdate")) + F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("s"))
    return lines.join(orders, "o_orderkey").select(
        "session_id", "unit_id", (F.col("s") + F.col("c") % 6_000_000).alias("t_us"))


def customer_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sessions with an id list that is empty for some."""
    good = F.when(F.col("c_custkey") % 4 == 0, F.array().cast("array<int>")).otherwise(
        F.array((F.col("c_custkey") % 7 + 1).cast("int"), (F.col("c_custkey") % 3 + 1).cast("int")))
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("session_id"), F.col("c_mktsegment").alias("subject"),
        F.col("c_name").alias("session_name"), good.alias("good_unit_ids"))


def session_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of several forms: three parts with a date, a plain name, none."""
    k = F.col("c_custkey")
    day = F.lpad((k % 33 + 1).cast("string"), 2, "0")
    month = F.lpad((k % 13 + 1).cast("string"), 2, "0")
    year = (2019 + k % 7).cast("string")
    long = F.concat(F.lit("S_"), F.col("c_nationkey").cast("string"), F.lit("_"), day, month, year, F.lit("_g0"))
    short = F.concat(F.lit("S_"), F.col("c_nationkey").cast("string"), F.lit("_"), day, month, F.substring(year, 3, 2))
    name = F.when(k % 4 == 0, long).when(k % 4 == 1, short).when(k % 4 == 2, F.col("c_mktsegment"))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), name.alias("name"))


def lasers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as laser pulses in 30 kHz sample numbers."""
    t = trials(spark, sf_dir)
    rise = (F.col("start_us") - 788_918_400_000_000) * 3 / 100_000 + 0.01234567
    return t.select(
        "session_id", F.col("trial_idx").alias("event_idx"), rise.alias("rise"),
        (rise + 300 + F.col("cents") % 3).alias("fall"), F.lit(0.01).alias("duration"))


def raw_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as spike times: sample numbers for even suppliers, seconds for odd ones."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("session_id"), F.col("l_linenumber").alias("unit_id"),
        F.when(F.col("l_suppkey") % 2 == 0, F.col("l_extendedprice")).otherwise(F.col("l_quantity")).alias("t"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: host / language / session folder, with names sorters use."""
    k = F.col("page_id")
    host = F.regexp_extract("url", r"^https?://([^/]+)/", 1)
    lang = F.regexp_extract("url", r"^https?://[^/]+/([^/?#]+)", 1)
    folder = F.concat(F.lit("/data/"), host, F.lit("/"), lang, F.when(k % 3 == 0, "/Session_").otherwise("/run_"),
                      F.floor(k / 9).cast("string"))
    names = ["spike_times.npy", "Rez.mat", "cluster_info.tsv", "raw.bin", "myChanMap_1.mat", "phy_out/params.py",
             "notes.txt", "sorting1/x/log.txt", "channel_positions.npy", "RawWaveforms/Unit0.npy",
             "spike_clusters.npy"]
    name = F.get(F.array(*[F.lit(n) for n in names]), ((k * 7 + F.length("url")) % len(names)).cast("int"))
    return read(spark, sf_dir, "pages").select(
        F.concat(folder, F.lit("/"), name).alias("path"), F.length("html").cast("bigint").alias("length"))


def part_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as metadata and electrode-table texts."""
    k, s = F.col("p_partkey"), F.col("p_size")

    def text(*parts):
        return F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])

    geom = text("(NP2010,4,250,70)(0:27:", s * 15, ":1)(1:", k % 60, ".5:30:0)(3:59:", k % 700, ":1)")
    shank = text("(1,2,480)(0:0:", k % 480, ":1)(0:1:", s, ":1)(0:", k % 2, ":", k % 77, ":0)(0:1:9:1)")
    part_no = F.when(k % 3 == 0, text("imDatPrb_pn=NP2010\n")).when(k % 3 == 1, text("imDatPrb_pn=NP1120\n")).otherwise("")
    meta = F.concat(
        text("fileName=a=b ", k, "\nnSavedChans=", F.when(k % 5 == 0, "x").otherwise(text(k % 9 + 380)),
             "\nnChans=", s + 300, "\nimSampRate=30000.", k % 100, "\nnSavedChans2=1\nsnsApLfSy=3,0,1\n"),
        part_no,
        F.when(k % 2 == 0, F.concat(F.lit("~snsGeomMap="), geom, F.lit("\n"))).otherwise(""),
        F.concat(F.lit("~snsShankMap="), shank, F.lit("\n")), text("dup=1\ndup=", s, "\nno value here\n"))
    imro = F.when(k % 4 != 0, text(
        "(24,8)(0 ", k % 2 + 1, " 0 0 ", s * 11, ")(1 ", k % 3 + 1, " 0 0 ", k % 1280, ")( 2 1 0 0 ", s, ")(",
        F.when(k % 6 == 1, "1").otherwise("3"), " 2 0 0 5)")).otherwise(
        text("0 1 0 0 ", s, "; 1 1 0 0 ", k % 1280, "; 2 9"))
    return read(spark, sf_dir, "part").select(
        k.alias("path"), meta.alias("meta_text"), imro.alias("imro_text"),
        (F.length("p_name") * 4 * (s + 1)).cast("bigint").alias("length"), s.alias("size"))


def part_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as channels of one probe per brand: four columns of positions, some jitter."""
    k, s = F.col("p_partkey"), F.col("p_size")
    return read(spark, sf_dir, "part").select(
        F.col("p_brand").alias("session_id"), k.alias("chan"),
        ((k % 4) * 250 + (s % 3) * 16).cast("double").alias("x"))
