"""SimHash fingerprints and near copies by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigflow.llm.arrow import sliced, texts
from trigflow.llm.columns import unused
from trigflow.llm.graph import components
from trigflow.session import cut_lineage

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: Groups up to this size are compared pair by pair; larger ones by growing components.
SMALL_GROUP = 48
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a text, 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        grams = [line]
    else:
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.r_[0, stops[:-1]].tolist()
        ends = (stops - 1).tolist()
        grams = [line[s:e] for s, e in zip(starts, ends[shingle - 1:])]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(grams), BLOCK):
        part = grams[at:at + BLOCK]
        h = np.fromiter((digest(g, SEED) for g in part), "<u8", len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(grams), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, text_hash) of each row; the fingerprint as a signed long."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t) for t in texts(batch.column(1))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps), batch.column(2)],
                                          names=["doc_id", "fp", "text_hash"])

    return docs.select(id_col, text_col, F.xxhash64(text_col).alias("_hash")).mapInArrow(
        sliced(work, 1), "doc_id long, fp long, text_hash long")


def balls(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fp): for both halves all values within one bit of the fingerprint's half.

    Four differing bits leave a half with two at most, so both fingerprints have a key in
    common: the value half-way between their halves.
    """
    u = fps.view(np.uint64)
    flips = np.r_[np.uint64(0), np.uint64(1) << np.arange(32, dtype=np.uint64)]
    halves = [u >> np.uint64(32), u & np.uint64(0xFFFFFFFF)]
    keys = [((h[:, None] ^ flips) << np.uint64(1)) | np.uint64(i) for i, h in enumerate(halves)]
    return np.concatenate([k.ravel() for k in keys]).view(np.int64), np.tile(np.repeat(fps, 33), 2)


def near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= bits


def spanning(fps: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join the distinct ``fps`` of one large group as all its close pairs would.

    Components grow from a member: all of the remaining within reach of it join and are expanded
    in turn, so each fingerprint is reached by one link and no list of pairs is made.
    """
    rest = fps
    while len(rest) > 1:
        queue, rest = [rest[:1]], rest[1:]
        while queue and len(rest):
            front = queue.pop()
            for i in range(len(front)):
                hit = near(rest, front[i:i + 1], bits)
                if hit.any():
                    found = rest[hit]
                    yield np.full(len(found), front[i]), found
                    queue.append(found)
                    rest = rest[~hit]


def links_of_groups(keys: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within equal ``keys`` (sorted): all close pairs of small groups, spanning links of large ones."""
    starts = np.r_[0, np.flatnonzero(np.diff(keys)) + 1]
    sizes = np.diff(np.r_[starts, len(keys)])
    left, right = [], []
    keep = np.repeat((sizes > 1) & (sizes <= SMALL_GROUP), sizes)
    k, f = keys[keep], fps[keep]
    for lag in range(1, SMALL_GROUP):
        if lag >= len(k):
            break
        same = k[lag:] == k[:-lag]
        if not same.any():
            break
        a, b = f[:-lag][same], f[lag:][same]
        ok = near(a, b, bits) & (a != b)
        left.append(a[ok])
        right.append(b[ok])
    for i in np.flatnonzero(sizes > SMALL_GROUP):
        for a, b in spanning(np.unique(fps[starts[i]:starts[i] + sizes[i]]), bits):
            left.append(a)
            right.append(b)
    none = np.zeros(0, np.int64)
    return np.concatenate(left or [none]), np.concatenate(right or [none])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the given links: by repeated hooking to smaller roots."""
    nodes, index = np.unique(np.r_[a, b], return_inverse=True)
    x, y = index[:len(a)], index[len(a):]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        open_ = rx != ry
        if not open_.any():
            break
        np.minimum.at(root, np.maximum(rx, ry)[open_], np.minimum(rx, ry)[open_])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def fingerprint_links(fps: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``) that join all pairs within ``bits`` bits, at most 4.

    Each fingerprint is put under every value within one bit of each half; members of a key are
    compared in full. Not every close pair is returned: what is returned joins the same
    fingerprints, and never two that no chain of close pairs joins.
    """
    if not 0 <= bits <= 4:
        raise ValueError("two halves with balls of one bit find up to four differing bits")

    def expand(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 14):
                fp = batch.column(0).slice(at, 1 << 14).to_numpy()
                key, out = balls(fp)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(out)], names=["key", "fp"])

    def verify(batches):
        key = fp = np.zeros(0, np.int64)

        def close(keys, values):
            a, b = forest(*links_of_groups(keys, values, bits))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            key = np.r_[key, batch.column(0).to_numpy()]
            fp = np.r_[fp, batch.column(1).to_numpy()]
            if len(key) > 1 << 18 and key[0] != key[-1]:
                cut = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
                yield close(key[:cut], fp[:cut])
                key, fp = key[cut:], fp[cut:]
        if len(key):
            yield close(key, fp)

    pairs = fps.select("fp").mapInArrow(expand, "key long, fp long")
    return (pairs.repartition("key").sortWithinPartitions("key").mapInArrow(verify, "a long, b long"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id, text_hash, root) of each row.

    Texts whose fingerprints differ in at most ``bits`` bits are linked; component_id is the
    smallest id reachable. NULL and wordless texts have fingerprint zero and are linked like any
    other. Rows that repeat an id are linked by their own texts. A NULL id names no component
    unless no other id is in it; ``root``, a fingerprint, tells such components apart.
    """
    rows = cut_lineage(fingerprints(docs, id_col, text_col))
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    # Nodes are fingerprints: equal ones are one node, so copies make no links at all.
    roots = components(fingerprint_links(least, bits))
    named = least.join(roots, least["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    table = named.join(ids, "root").select("fp", "component_id", "root")
    return rows.join(table, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "text_hash", "root")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = MAX_BITS) -> DataFrame:
    """One row of each component of :func:`near_copies`, all columns as they are: that with the smallest id.

    A NULL id comes last; of rows with the same id one with the smallest hash of the text stays.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    key_id, key_hash, own = unused(docs, "key_id", "key_hash", "own")
    kept = near_copies(docs, id_col, text_col, bits).groupBy("root").agg(first).select(
        F.col("first.doc_id").alias(key_id), F.col("first.text_hash").alias(key_hash))
    one = docs.withColumn(own, F.xxhash64(text_col)).join(
        kept, F.col(id_col).eqNullSafe(F.col(key_id)) & (F.col(own) == F.col(key_hash)), "left_semi")
    return one.dropDuplicates([id_col, own]).select(*docs.columns)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all ``documents`` within four bits."""
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
