"""Nested session records to long tables, with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigflow.functions.scalars import normalise_ids, session_label, session_subject
from trigflow.functions.ticks import seconds_to_ticks

# Current field names next to the older ones they replace; the first that is set counts.
RECORD_SCHEMA = """
session_id STRING,
behav_data STRUCT<trials_data_exp: ARRAY<STRUCT<
    trialoutcome: STRING, reactiontimes: MAP<STRING, DOUBLE>,
    change_size: DOUBLE, Stim2TF: DOUBLE, orientation: DOUBLE, Stim2Ori: DOUBLE,
    ITI: DOUBLE, stimD: DOUBLE, change_time: DOUBLE, stimT: DOUBLE,
    baseline_values: ARRAY<DOUBLE>, St1TrialVector: ARRAY<DOUBLE>>>>,
NPX_probes STRUCT<st: ARRAY<DOUBLE>, clu: ARRAY<INT>, cluster_id_KS_good: ARRAY<STRING>>,
NI_events STRUCT<session_name: STRING,
    channels: MAP<STRING, STRUCT<rise_t: ARRAY<DOUBLE>, fall_t: ARRAY<DOUBLE>, duration: ARRAY<DOUBLE>>>>
"""


def read_records(spark: SparkSession, paths: str | Sequence[str], fmt: str = "json") -> DataFrame:
    """Session records from any number of paths or globs: all sessions in one job.

    A record without a ``session_id`` is known by the file it came from.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    df = spark.read.schema(RECORD_SCHEMA).format(fmt).load(paths)
    stem = F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1)
    return df.withColumn("session_id", F.coalesce("session_id", stem))


def sessions_of(records: DataFrame) -> DataFrame:
    name = F.col("NI_events.session_name")
    return records.select(
        "session_id", session_subject(name).alias("subject"), session_label(name).alias("session_name"),
        normalise_ids(F.col("NPX_probes.cluster_id_KS_good")).alias("good_unit_ids"))


def trials_of(records: DataFrame) -> DataFrame:
    """One row per trial; its position in the record is its index."""
    t = records.select("session_id", F.posexplode("behav_data.trials_data_exp").alias("trial_idx", "t"))

    def either(new: str, old: str):
        return F.coalesce(f"t.{new}", f"t.{old}")

    return t.select(
        "session_id", "trial_idx", F.col("t.trialoutcome").alias("outcome"),
        F.coalesce("t.reactiontimes", F.create_map().cast("map<string,double>")).alias("reactiontimes"),
        either("change_size", "Stim2TF").alias("change_size"), either("orientation", "Stim2Ori").alias("orientation"),
        either("ITI", "stimD").alias("iti"), either("change_time", "stimT").alias("change_time"),
        either("baseline_values", "St1TrialVector").alias("baseline_values"))


def spikes_of(records: DataFrame) -> DataFrame:
    """One row per spike from the parallel time and unit arrays; a missing unit is -1."""
    clu = F.coalesce("NPX_probes.clu", F.array().cast("array<int>")).alias("clu")
    z = records.select("session_id", F.col("NPX_probes.st").alias("st"), clu).select(
        "session_id", F.explode(F.slice(F.arrays_zip("st", "clu"), 1, F.size("st"))).alias("z"))
    return z.select("session_id", F.coalesce("z.clu", F.lit(-1)).alias("unit_id"), F.col("z.st").alias("t"),
                    seconds_to_ticks(F.col("z.st")).alias("t_us"))


def units_of(spikes: DataFrame) -> DataFrame:
    return spikes.select("session_id", "unit_id").distinct().withColumn("quality", F.lit(None).cast("string"))


def channel_events_of(records: DataFrame) -> DataFrame:
    """One row per event with rise, fall and duration; a channel without rises has no rows."""
    ch = records.select("session_id", F.explode("NI_events.channels").alias("channel", "c")).where("c is not null")
    none = F.array().cast("array<double>")
    parts = [F.coalesce(f"c.{name}", none).alias(name) for name in ("rise_t", "fall_t", "duration")]
    ev = ch.select("session_id", "channel", *parts).select(
        "session_id", "channel", F.size("rise_t").alias("n_rise"),
        F.posexplode(F.arrays_zip("rise_t", "fall_t", "duration")).alias("event_idx", "e"))
    return ev.where("event_idx < n_rise").select(
        "session_id", "channel", "event_idx", F.col("e.rise_t").alias("rise_t"), F.col("e.fall_t").alias("fall_t"),
        F.col("e.duration").alias("duration"), seconds_to_ticks(F.col("e.rise_t")).alias("rise_us"))


def normalised_tables(records: DataFrame) -> dict[str, DataFrame]:
    spikes = spikes_of(records)
    return {"sessions": sessions_of(records), "trials": trials_of(records), "spikes": spikes,
            "units": units_of(spikes), "channel_events": channel_events_of(records)}


def save_tables(tables: dict[str, DataFrame], root: str, mode: str = "overwrite") -> None:
    """Parquet per table, dealt into ranges of sessions and sorted by session in each file.

    There is no folder per session: a filter on sessions reaches the row groups' statistics, and
    the number of files follows the size of the table. Spikes are ranged by time too, so a large
    session is written by many tasks.
    """
    order = {"spikes": ["session_id", "t_us", "unit_id"], "trials": ["session_id", "trial_idx"], "units": ["session_id", "unit_id"],
             "channel_events": ["session_id", "channel", "event_idx"]}
    for name, df in tables.items():
        by = order.get(name, ["session_id"])
        df.repartitionByRange(*by).sortWithinPartitions(*by).write.mode(mode).parquet(f"{root}/{name}")


def load_tables(spark: SparkSession, root: str, names: Sequence[str] = (
        "sessions", "trials", "spikes", "units", "channel_events")) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{root}/{n}").withColumn("session_id", F.col("session_id").cast("string")) for n in names}


def good_unit_labels(labels: DataFrame) -> DataFrame:
    """Units labelled good, from ``(unit_id, label)`` rows of a two-column label file."""
    good = ("GOOD", "NON-SOMA GOOD", "GOOD_UNIT", "GOODUNIT")  # fixed values
    return labels.where(F.upper(F.trim("label")).isin(*good)).select(F.col("unit_id").cast("int").alias("unit_id"))


def good_units_by_type(table: DataFrame) -> DataFrame:
    """Units whose type mentions GOOD in any case; column names are resolved from aliases."""
    def present(*names: str):
        for n in names:
            if n in table.columns:
                return F.col(n)
        raise ValueError(f"none of {names} in {table.columns}")

    kind = present("unit_type", "unitLabel", "unit_label", "type")
    return table.where(kind.rlike("(?i)good")).select(
        present("cluster_id", "unit_id", "id", "unit").cast("int").alias("unit_id"))


def read_unit_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("unit_id STRING, label STRING").option("sep", "\t").csv(path)


def preferred_good_units(table: DataFrame, sessions: DataFrame, units: DataFrame) -> DataFrame:
    """Rows of a unit table that are good by the first source its session has.

    The session's list, else units of quality 'good', else the table's own quality column
    (first alias that is filled); a session with none keeps all its rows.
    """
    from trigflow.functions.scalars import first_text

    by = ["session_id", "unit_id"]
    aliases = [c for c in ("quality", "cluster_quality", "quality_label", "unit_quality") if c in table.columns]
    own = F.lower(first_text(*[F.col(c) for c in aliases])) == "good" if aliases else F.lit(False)
    listed = sessions.select("session_id", F.explode("good_unit_ids").alias("unit_id"), F.lit(1).alias("src"))
    quality = units.where(F.lower("quality") == "good").select(*by, F.lit(2).alias("src"))
    labelled = table.where(own).select(*by, F.lit(3).alias("src"))
    unit_type = dict(table.dtypes)["unit_id"]
    every = listed.withColumn("unit_id", F.col("unit_id").cast(unit_type)).union(quality).union(labelled).distinct()
    first = every.groupBy("session_id").agg(F.min("src").alias("src"))
    good = every.join(first, ["session_id", "src"]).select(*by, F.lit(True).alias("is_good"))
    return (
        table.join(good, by, "left").join(first, "session_id", "left")
        .where(F.col("is_good") | F.col("src").isNull()).select(*table.columns)
    )
