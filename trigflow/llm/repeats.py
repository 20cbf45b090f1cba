"""Removal of long byte strings that occur elsewhere, by suffix arrays over the few texts that can share one.

Every window of ``size`` bytes has a key: the least hash of its short grams. Equal windows have
equal keys, so only runs of windows whose key occurs again are gathered, by key, and only there
are suffix arrays built. A window of a frequent key is gathered under a finer key, to which
nearly all of its bytes contribute, so no key brings an unbounded number of different texts
to one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigflow.llm.arrow import slices, texts
from trigflow.llm.gsaca import suffix_arrays

SIZE = 200
GRAM = 32
#: Windows of a run; longer runs are cut, which loses nothing as windows are compared one by one.
RUN = 512
#: Keys with more runs than this are refined before texts are gathered.
FREQUENT = 1024
#: Keys with more different texts than this are refined where they were gathered, so each suffix array is short.
MANY = 32
#: Window starts that share a finer key.
STRIDE = 8
#: Bytes of different texts whose suffix arrays are built side by side.
BATCH = 2 << 20
#: Bytes hashed at once.
BUFFER = 1 << 19


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each ``gram`` bytes, a power of two, by doubling."""
    h, step, factor = data.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while step < gram:
        h = h[:-step] * np.uint64(factor) + h[step:]
        step, factor = 2 * step, factor * factor & 0xFFFFFFFFFFFFFFFF
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def sliding(x: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """``pick`` over each ``width`` consecutive values."""
    step = 1
    while 2 * step <= width:
        x, step = pick(x[:-step], x[step:]), 2 * step
    return x if step == width else pick(x[:len(x) - (width - step)], x[width - step:])


def window_runs(batch: list[bytes], size: int = SIZE, gram: int = GRAM):
    """(text number, start, windows, key, folds) of the runs of equal keys in each text.

    ``folds`` marks runs of texts in which a key's gram occurs twice, so a run may hold equal windows.
    """
    sizes = np.array([len(t) for t in batch], np.int64)
    width = size - gram + 1
    counts = np.maximum(0, sizes - size + 1)
    if not counts.any():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, bool))
    h = gram_hashes(np.frombuffer(b"".join(batch), np.uint8), gram)
    key = sliding(h, width)
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(batch)), counts)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    values = key[first[owner] + start]
    edge = np.r_[True, (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])]
    # A run is cut after RUN windows.
    opens = np.flatnonzero(edge)
    n = np.diff(np.r_[opens, len(values)])
    parts = -(-n // RUN)
    inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(opens, parts) + inner * RUN
    n = np.minimum(RUN, np.repeat(opens + n, parts) - begin)
    # Grams that are the least of some window of theirs: one for each run unless a key's gram recurs.
    span = np.zeros(len(h) + width, np.uint64)
    span[first[owner] + start + width] = values
    most = sliding(span[1:], width, np.maximum)[:len(h)]
    least = np.flatnonzero((most == h) & (most > 0))
    of = np.searchsorted(first, least, side="right") - 1
    extra = np.bincount(of, minlength=len(batch)) > np.bincount(owner[opens], minlength=len(batch))
    return owner[begin], start[begin], n, values[begin], extra[owner[begin]] | (n > width)


def pieces_of(data: list[bytes], size: int = SIZE):
    """(rows, offsets, parts): all windows of the texts in groups of parts of about BUFFER bytes.

    Parts of a long text overlap, so each window is in one; runs of windows may be cut anywhere.
    """
    group, held = [], 0
    for i, text in enumerate(data):
        for at in range(0, max(1, len(text) - size + 1), BUFFER):
            part = text[at:at + BUFFER + size - 1]
            group.append((i, at, part))
            held += len(part)
            if held >= BUFFER:
                rows, offsets, parts = zip(*group)
                yield np.array(rows), np.array(offsets), list(parts)
                group, held = [], 0
    if group:
        rows, offsets, parts = zip(*group)
        yield np.array(rows), np.array(offsets), list(parts)


def finer_runs(text: bytes, key: int, size: int = SIZE, gram: int = GRAM):
    """(start, windows, key) of parts of a run's text, keyed by all but a few bytes of their windows.

    The key's gram lies at a place in each window; windows whose places fall in one stride share
    all bytes but STRIDE - 1, and equal windows have it at the same place.
    """
    h = gram_hashes(np.frombuffer(text, np.uint8), gram)
    at = np.flatnonzero(h == np.uint64(key))
    start = np.arange(len(text) - size + 1)
    anchor = at[np.searchsorted(at, start)]
    stride = (anchor - start) // STRIDE
    edge = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (stride[1:] != stride[:-1])])
    out = []
    for s, e in zip(edge.tolist(), np.r_[edge[1:], len(start)].tolist()):
        core = int(anchor[s]) - int(stride[s]) * STRIDE - STRIDE + 1  # the start furthest left in this stride
        shared = text[core + STRIDE - 1:core + size]
        out.append((s, e - s, xxhash.xxh64_intdigest(shared, (key + int(stride[s])) & 0xFFFFFFFFFFFFFFFF)))
    return out


def repeated_windows(groups: list[list[bytes]], size: int = SIZE) -> list[list[np.ndarray]]:
    """For each text of each group, which of its windows also start elsewhere in the texts of the group."""
    strings = [b"\x00".join(g) for g in groups]
    # Bytes are raised by one, so that the closing zero is the least.
    data = np.frombuffer(b"".join(s + b"\x00" for s in strings), np.uint8).astype(np.int64) + 1
    lengths = np.array([len(s) + 1 for s in strings], np.int64)
    base = np.cumsum(lengths) - lengths
    ends = base + lengths - 1
    sizes = np.array([len(t) for g in groups for t in g], np.int64)
    closes = np.cumsum(sizes + 1) - 1  # place of the byte after each text
    data[closes] = 0
    order = suffix_arrays(data, base, lengths)
    room = closes[np.searchsorted(closes, np.arange(len(data)))] - np.arange(len(data))
    a, b = order[:-1], order[1:]
    near = (room[a] >= size) & (room[b] >= size) & (np.searchsorted(ends, a) == np.searchsorted(ends, b))
    a, b = a[near], b[near]
    # Neighbours in a suffix array share a window if any two suffixes around them do.
    equal = np.ones(len(a), bool)
    for at in range(0, size, 8):
        live = np.flatnonzero(equal)
        for k in range(at, min(at + 8, size)):
            equal[live] &= data[a[live] + k] == data[b[live] + k]
    marks = np.zeros(len(data), bool)
    marks[a[equal]] = True
    marks[b[equal]] = True
    out, i = [], 0
    for g in groups:
        row = []
        for t in g:
            row.append(marks[closes[i] - len(t):closes[i] - size + 1])
            i += 1
        out.append(row)
    return out


def to_spans(mark: np.ndarray, start: int, size: int = SIZE) -> list[int]:
    """Runs of marked windows as covered bytes: start, stop, start, stop, …"""
    edge = np.flatnonzero(np.diff(np.r_[False, mark, False].astype(np.int8)))
    return [x for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()) for x in (start + s, start + e + size - 1)]


class Gatherer:
    """Collects the texts of one key after another, and judges their windows batch by batch."""

    def __init__(self, size: int):
        self.size, self.out = size, []
        self.groups, self.owners, self.bytes = [], [], 0
        self.key = self.mark = self.text = None
        self.single, self.distinct, self.folds = [], [], False

    def add(self, key, mark, doc, ver, start, windows, text, folds, refined):
        if key != self.key:
            self.close_key()
            self.key, self.refined = key, refined
        if mark != self.mark:
            self.close_text()
            self.mark, self.text, self.first, self.folds_here = mark, text, (doc, ver, start, windows), folds
            return
        if self.first:
            self.whole(*self.first)
            self.first = None
        self.whole(doc, ver, start, windows)

    def whole(self, doc, ver, start, windows):
        """A text that another place holds as it is: each window of it occurs there."""
        self.out.append((doc, ver, [start, start + windows + self.size - 1]))

    def close_text(self):
        if self.mark is not None:
            self.distinct.append(self.text)
            self.single.append(self.first)
            self.folds |= bool(self.first and self.folds_here)
        self.mark = self.first = None

    def close_key(self):
        self.close_text()
        if any(self.single) and (len(self.distinct) > 1 or self.folds):
            if len(self.distinct) <= MANY:
                self.put(self.distinct, self.single)
            elif self.refined:
                self.split_windows(self.distinct, self.single)
            else:
                self.refine()
        self.single, self.distinct, self.folds = [], [], False
        if self.bytes > BATCH:
            self.judge()

    def put(self, distinct, single):
        self.groups.append(distinct)
        self.owners.append(single)
        self.bytes += sum(map(len, distinct))

    def refine(self):
        """The texts of the key in parts, under finer keys; parts that are equal are marked as they are."""
        parts: dict = {}
        for text, owner in zip(self.distinct, self.single):
            for s, n, key in finer_runs(text, self.key + (1 << 63), self.size):
                place = owner and (owner[0], owner[1], owner[2] + s, n)
                parts.setdefault(key, {}).setdefault(text[s:s + n + self.size - 1], []).append(place)
        for pieces in parts.values():
            single = []
            for places in pieces.values():
                single.append(places[0] if len(places) == 1 else None)
                if len(places) > 1:
                    for place in filter(None, places):
                        self.whole(*place)
            if any(single) and (len(pieces) > 1 or self.folds):
                (self.put if len(pieces) <= MANY else self.split_windows)(list(pieces), single)

    def split_windows(self, distinct, single):
        """The last refinement, where many texts differ in their few outer bytes only: keys are whole windows."""
        parts: dict = {}
        for text, owner in zip(distinct, single):
            for k in range(len(text) - self.size + 1):
                parts.setdefault(text[k:k + self.size], []).append((owner, k))
        for places in parts.values():
            if len(places) > 1 or places[0][0] is None:
                for owner, k in places:
                    if owner:
                        self.whole(owner[0], owner[1], owner[2] + k, 1)

    def judge(self):
        if self.groups:
            for owners, marks in zip(self.owners, repeated_windows(self.groups, self.size)):
                for owner, mark in zip(owners, marks):
                    if owner and mark.any():
                        doc, ver, start, _ = owner
                        self.out.append((doc, ver, to_spans(mark, start, self.size)))
        self.groups, self.owners, self.bytes = [], [], 0

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.out)) or [()] * 3
        self.out = []
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc", "ver", "spans"])


def repeated_spans(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc, ver, spans) of texts with bytes in strings of ``size`` bytes that also start elsewhere.

    ``docs`` has columns doc_id, doc and ver (together naming a text), and text. Spans are lists of start,
    stop, start, stop, … and may touch or overlap.
    """
    def runs(batches):
        for batch in batches:
            for row, offset, parts in pieces_of(texts(batch.column(2)), size):
                owner, start, n, key, folds = window_runs(parts, size)
                rows, start = pa.array(row[owner], pa.int64()), start + offset[owner]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(start.astype(np.int32)),
                     pa.array(n.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(folds)],
                    names=["doc", "ver", "start", "windows", "key", "folds"])

    found = docs.select("doc", "ver", "text").mapInArrow(runs, "doc long, ver long, start int, windows int, key long, folds boolean")
    often = (found.groupBy("key").agg(F.count("*").alias("n"), F.max("folds").alias("any_folds")).where("n > 1 or any_folds")
             .select("key", (F.col("n") > FREQUENT).alias("frequent")))
    each = (found.join(often, "key").groupBy("doc", "ver")
            .agg(F.collect_set(F.struct("start", "windows", "key", "folds", "frequent")).alias("runs")))  # fewer than bytes

    def gather(batches):
        # A task sends the bytes of a text of a key once, and a copy to show that there is one. More copies
        # are sure to be repeated as they are, so they are dealt out evenly instead of going to the key's task.
        seen: dict = {}

        def rows_of(batch):
            lists = batch.column(4)
            start_, windows, keys, folds_, frequent_ = (lists.flatten().field(k).to_pylist() for k in range(5))
            sizes = pa.compute.list_value_length(lists).to_pylist()
            at = 0
            for doc, ver, text, size_ in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts(batch.column(3)), sizes):
                for i in range(at, at + size_):
                    start, n, key, folds = start_[i], windows[i], keys[i] & 0xFFFFFFFFFFFFFFFF, folds_[i]
                    part = text[start:start + n + size - 1]
                    for s, n, k in finer_runs(part, key, size) if frequent_[i] else ((0, n, key),):
                        piece = part[s:s + n + size - 1]
                        mark = xxhash.xxh3_64_intdigest(piece)
                        times = seen.get((k, mark), 0)
                        seen[k, mark] = times + 1
                        sure = times > 1
                        where = xxhash.xxh3_64_intdigest(b"%d %d %d" % (doc, ver, start + s)) if sure else k
                        yield (where - (1 << 63), mark - (1 << 63), doc, ver, start + s, n, folds, times > 0,
                               None if times else piece, frequent_[i], sure)
                at += size_
                if len(seen) > 200_000:
                    seen.clear()

        kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.bool_()] * 2 + [pa.binary()] + [pa.bool_()] * 2
        names = ["key", "mark", "doc", "ver", "start", "windows", "folds", "known", "text", "refined", "sure"]
        for batch in batches:
            for piece in slices(batch, 3):
                columns = list(zip(*rows_of(piece))) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    # The same columns as in the join that follows, so that one exchange of the texts serves both.
    gathered = docs.join(each, ["doc", "ver"]).select("doc_id", "doc", "ver", "text", "runs").mapInArrow(
        gather, "key long, mark long, doc long, ver long, start int, windows int, folds boolean, known boolean, text binary, refined boolean, sure boolean")

    def judge(batches):
        g = Gatherer(size)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key, mark, doc, ver, start, windows, folds, _, text, refined, sure = row
                if sure:
                    g.whole(doc, ver, start, windows)
                else:
                    g.add(key, mark, doc, ver, start, windows, text, folds, refined)
            yield g.take()
        g.close_key()
        g.judge()
        yield g.take()

    order = ["key", "mark", "known"]  # of equal texts one that came with its bytes is first
    return (gathered.repartition("key").sortWithinPartitions(*order)
            .mapInArrow(judge, "doc long, ver long, spans array<bigint>"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row.

    Removes each byte of a text that lies in a string of ``size`` bytes which starts anywhere else,
    in the same text or another. NULL and empty texts have no bytes and keep none. Rows that repeat
    an id are texts of their own, and each other's copies where the text is the same. Texts
    shorter than ``size`` bytes lose nothing.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("doc"),
                       F.xxhash64(F.col(id_col).isNull(), text).alias("ver"), text.alias("text"))
    spans = (repeated_spans(rows, size).groupBy("doc", "ver").agg(F.flatten(F.collect_list("spans")).alias("spans")))

    def cut(batches):
        def one(data: bytes, edges: list[int] | None) -> tuple[int, int, int, str]:
            gone = np.zeros(len(data) + 1, np.int32)
            if edges:
                np.add.at(gone, edges[::2], 1)
                np.add.at(gone, edges[1::2], -1)
            gone = np.cumsum(gone[:-1]) > 0
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if edges else data
            runs = int(np.count_nonzero(np.diff(np.r_[False, gone].astype(np.int8)) > 0))
            return len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest()

        for batch in batches:
            for piece in slices(batch, 1):
                result = [one(t, s) for t, s in zip(texts(piece.column(1)), piece.column(2).to_pylist())]
                columns = list(zip(*result)) or [()] * 4
                kinds = [pa.int64()] * 3 + [pa.string()]
                yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                                                 names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.join(spans, ["doc", "ver"], "left").select("doc_id", "text", "spans").mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all ``documents`` that lie in 200-byte strings which also start elsewhere."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Every window of every text, as hexadecimal digits, compared by MD5.
ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, {2 * SIZE})) AS g
      FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - {SIZE - 1})) AS i FROM t WHERE length(h) >= {2 * SIZE})),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM w) WHERE n > 1),
f AS (SELECT doc_id, i, (i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -{2 * SIZE}) + {SIZE})::INTEGER AS new FROM r),
s AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f),
x AS (SELECT doc_id, k, min(i) AS a, max(i) + {SIZE} AS z FROM s GROUP BY ALL),
y AS (SELECT *, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS p FROM x),
c AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS stop,
        string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS kept FROM y JOIN t USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept || substr(h, 2 * stop + 1), h))) AS kept_sha256
FROM t LEFT JOIN c USING (doc_id)
"""
