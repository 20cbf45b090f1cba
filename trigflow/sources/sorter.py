"""Sorter output folders: .npy arrays to long tables."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# File names by array, in order of preference.
NAMES = {
    "templates": ("templates.npy", "templates.waveforms.npy"),
    "spike_templates": ("spike_templates.npy", "spike_template.npy"),
    "spike_clusters": ("spike_clusters.npy", "spike_cluster.npy", "spike_clusters_ks.npy"),
    "spike_times": ("spike_times.npy", "spike_time.npy"),
}
SLICE_ROWS = 200_000
RANGE_BYTES = 32 << 20


def _named(files: DataFrame) -> DataFrame:
    """Adds folder, array and the rank of the file name among the array's names; other files drop out."""
    rank = F.create_map(*[F.lit(v) for names in NAMES.values() for i, n in enumerate(names) for v in (n, i)])
    kind = F.create_map(*[F.lit(v) for k, names in NAMES.items() for n in names for v in (n, k)])
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.withColumns({
        "folder": F.regexp_extract("path", r"^(.*)/[^/]*$", 1),
        "array": F.try_element_at(kind, name), "rank": F.try_element_at(rank, name)}).where("array is not null")


def chosen_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(folder, array, rank, path, length) of the first existing name of each array per folder; contents unread."""
    listed = spark.read.format("binaryFile").load(paths).select("path", "length")
    first = F.min(F.struct("rank", "path", "length")).alias("first")
    return _named(listed).groupBy("folder", "array").agg(first).select("folder", "array", "first.*")


@dataclass
class Range(InputPartition):
    """Elements [start, start + count) of one file's array."""

    folder: str
    array: str
    path: str
    body: int
    dtype: str
    shape: tuple
    fortran: bool
    start: int
    count: int


def _opened(path: str):
    """A seekable file of any store that Arrow knows."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    store, name = pyarrow.fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def _header(path: str) -> tuple[int, np.dtype, tuple, bool]:
    """Where the body begins, its type, shape and order: the first few bytes of a file."""
    with _opened(path) as file:
        version = np.lib.format.read_magic(file)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, fortran, dtype = read(file)
        if dtype.hasobject:
            raise ValueError(f"{path} holds objects, not numbers")
        return file.tell(), dtype, shape, fortran


class NpyReader(DataSourceReader):
    """Byte ranges of ``.npy`` bodies as partitions, so a file of any size is read by as many tasks as it needs."""

    def __init__(self, options: dict):
        self.files = json.loads(options["files"])
        self.size = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self):
        out = []
        for folder, array, path in self.files:
            body, dtype, shape, fortran = _header(path)
            total, step = int(np.prod(shape, dtype=np.int64)), max(1, self.size // dtype.itemsize)
            out += [Range(folder, array, path, body, dtype.str, shape, fortran, at, min(step, total - at))
                    for at in range(0, total, step)]
        return out or [Range("", "", "", 0, "<i4", (0,), False, 0, 0)]

    def read(self, part: Range):
        if not part.count:
            return
        dtype = np.dtype(part.dtype)
        deep = part.array == "templates" and len(part.shape) == 3
        with _opened(part.path) as file:
            for at in range(part.start, part.start + part.count, SLICE_ROWS):
                n = min(SLICE_ROWS, part.start + part.count - at)
                file.seek(part.body + at * dtype.itemsize)
                value = np.frombuffer(file.read(n * dtype.itemsize), dtype).astype(float)
                place = np.unravel_index(np.arange(at, at + n), part.shape, order="F" if part.fortran else "C")
                if deep:
                    idx, channel, sample = place
                else:
                    idx = np.ravel_multi_index(place, part.shape)
                    channel = sample = np.full(n, -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.folder] * n), pa.array([part.array] * n), pa.array(idx, pa.int64()),
                     pa.array(channel, pa.int32()), pa.array(sample, pa.int32()), pa.array(value)],
                    names=["folder", "array", "idx", "channel", "sample", "value"])


class NpyArrays(DataSource):
    """Format ``npy_arrays``: option ``files`` is a JSON list of [folder, array, path], ``rangeBytes`` the most a task reads."""

    @classmethod
    def name(cls) -> str:
        return "npy_arrays"

    def schema(self) -> str:
        return "folder string, array string, idx bigint, channel int, sample int, value double"

    def reader(self, schema) -> DataSourceReader:
        return NpyReader(self.options)


def read_sorter_arrays(spark: SparkSession, paths: str | list[str], arrays: list[str] | None = None,
                       range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(folder, array, idx, channel, sample, value) of the arrays below ``paths``, or of those named.

    Files that a preferred name replaces, and arrays not asked for, are never opened. Of the others
    the header is read once, and their bodies are dealt to tasks in ranges of ``range_bytes``, so no task
    holds more and no file is too large. ``arrays`` is the way to choose them: filters are not pushed into a
    Python source, as Spark 4.1 hands the last one to all scans of a self-join. Memory of the driver
    grows with the number of files, as with Spark's own listings.
    """
    chosen = chosen_files(spark, paths)
    if arrays is not None:
        chosen = chosen.where(F.col("array").isin(arrays))
    files = [[r["folder"], r["array"], r["path"]] for r in chosen.select("folder", "array", "path").collect()]
    spark.dataSource.register(NpyArrays)
    return spark.read.format("npy_arrays").options(files=json.dumps(sorted(files)), rangeBytes=str(range_bytes)).load()


def sorter_tables(arrays: DataFrame) -> dict[str, DataFrame]:
    """Templates in long form, and spikes with time, unit and template tied by position."""
    def one(name: str, col: str, kind: str) -> DataFrame:
        return arrays.where(F.col("array") == name).select(
            F.col("folder").alias("session_id"), "idx", F.col("value").cast(kind).alias(col))

    spikes = one("spike_times", "t", "double").join(
        one("spike_clusters", "unit_id", "int"), ["session_id", "idx"], "full").join(
        one("spike_templates", "template_id", "int"), ["session_id", "idx"], "full")
    templates = arrays.where("array = 'templates'").select(
        F.col("folder").alias("session_id"), F.col("idx").cast("int").alias("template_id"), "channel", "sample",
        "value")
    return {"spikes": spikes, "templates": templates}
