"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of the passages around them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trigflow.llm.arrow import sliced, slices, texts
from trigflow.llm.columns import perhaps_in, unused
from trigflow.session import cut_lineage

SEED_WORDS = 3
#: A seed is rare if chance alone would bring it at most this often into a text of RARE_WORDS words.
RARE_EXPECTED = 0.001
RARE_WORDS = 1_000
#: Least share of an item's best score, and least score, for a text to count as a leak.
MIN_SHARE = 0.45
MIN_SCORE = 16
#: A score that makes a leak whatever the item's length: 30 words in a row, or more with edits.
SURE_SCORE = 60
#: The rarest seeds of an item are kept whatever the corpus; n-grams of more items than TEMPLATE are no seeds beside them.
SURE, TEMPLATE = 3, 32
MATCH, MISMATCH, GAP = 2, -1, -1
#: Alignments computed side by side hold about this many cells a step.
CELLS = 1 << 18
#: Size of the bit table of seed hashes that tasks hold: fixed, whatever the size of the benchmark.
TABLE_BITS = 22
#: Words around a seed that are aligned, beside those that the item itself asks for.
MARGIN = 8
NOT_WORD = bytes(b if b > 127 or 48 <= b < 58 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


class Words(dict):
    """Hashes of words, remembered by the task."""

    LIMIT = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def hashes(self, text: bytes) -> np.ndarray:
        if not text.isascii():
            text = text.decode().lower().encode()
        words = text.translate(NOT_WORD).split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class BitTable:
    """Which hashes of a set a value may be: of a fixed size, so tasks can hold it whatever the size of the set.

    A larger set lets more other values through; what passes is always joined with the set itself.
    """

    LOW = (1 << TABLE_BITS) - 1

    def __init__(self, table: DataFrame, column: str):
        words = table.select(F.col(column).bitwiseAND(self.LOW).alias("h")).groupBy(F.shiftright("h", 6).alias("place")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
        bits = np.zeros((self.LOW + 1) // 64, np.int64)
        for r in words.collect():  # at most 2^TABLE_BITS / 64 rows
            bits[r["place"]] = r["bits"]
        self.shared = table.sparkSession.sparkContext.broadcast(bits)

    def reader(self):
        """A function for one task: the places of the values that may be in the set."""
        filled, low = self.shared.value.view(np.uint64), np.uint64(self.LOW)

        def places(values: np.ndarray) -> np.ndarray:
            h = values & low
            return np.flatnonzero(filled[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63)) & np.uint64(1))

        return places


def grams(h: np.ndarray, n: int = SEED_WORDS) -> np.ndarray:
    """A hash of each window of ``n`` words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = (out ^ h[i:len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def word_counts(docs: DataFrame, wanted: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts for the words, as hashes, of ``wanted``; a NULL word has the number of all words."""
    table = BitTable(wanted, "word")

    def run(batches):
        words, places = Words(), table.reader()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [words.hashes(t) for t in texts(batch.column(0))]
            every = np.concatenate(found or [np.zeros(0, np.uint64)])
            some, n = np.unique(every[places(every)], return_counts=True)
            return pa.RecordBatch.from_arrays(
                [pa.array([*some.view(np.int64).tolist(), None], pa.int64()), pa.array([*n.tolist(), len(every)], pa.int64())],
                names=["word", "n"])

        yield from sliced(work, 0)(batches)

    return docs.select(text_col).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def align(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each row pair and the place in ``b`` after its last aligned word.

    ``a`` and ``b`` are padded tables of word numbers, -1 and -2 beyond the lengths. Smith-Waterman
    with linear gaps, one row of ``a`` at a time for all pairs; a gap along ``b`` is a running maximum.
    """
    n, width = b.shape
    row = np.zeros((n, width + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    ramp = np.arange(width + 1, dtype=np.int32) * -GAP
    for i in range(a.shape[1]):
        diagonal = row[:, :-1] + np.where(a[:, i:i + 1] == b, MATCH, MISMATCH).astype(np.int32)
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(np.maximum(diagonal, row[:, 1:] + GAP), 0)
        row = np.maximum.accumulate(new + ramp, axis=1) - ramp
        top = row.max(axis=1)
        better = top > best
        if better.any():
            end[better] = row[better].argmax(axis=1)
            best = np.maximum(best, top)
    return best, end


def _padded(rows: list[np.ndarray], fill: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(r) for r in rows])
    out = np.full((len(rows), max(1, sizes.max(initial=0))), fill, np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r.view(np.int64)
    return out, sizes


def align_all(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Score and end of each (item, passage), pairs of similar size together."""
    out: list = [None] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][1]), len(pairs[i][0])))
    at = 0
    while at < len(order):
        step = max(1, CELLS // (2 * len(pairs[order[at]][1]) + 64))
        some = order[at:at + step]
        a, la = _padded([pairs[i][0] for i in some], -1)
        b, lb = _padded([pairs[i][1] for i in some], -2)
        best, end = align(a, la, b, lb)
        for i, s, e in zip(some, best.tolist(), end.tolist()):
            out[i] = (s, e)
        at += step
    return out


def seeds(docs: DataFrame, items: DataFrame, text_col: str = "text", n: int = SEED_WORDS,
          expected: float = RARE_EXPECTED) -> DataFrame:
    """(gram, item, at, size) of the seeds of ``items(item, words)``: rare n-grams, and the SURE rarest of each item.

    Rare means that words of these frequencies, drawn at random, would bring the n-gram to a text
    of RARE_WORDS words at most ``expected`` times. How often a leak repeats an n-gram does not
    matter, so the seeds of a passage that stands in a third of all texts stay. An n-gram of more than
    TEMPLATE items says little about which item is met: it counts only where it is among the rarest
    of an item that has nothing better.
    """
    def words(batches):
        for batch in batches:
            rows = [(i, np.frombuffer(h, np.uint64)) for i, h in zip(*(c.to_pylist() for c in batch.columns))]
            flat = [(i, at, int(g), int(w), len(h)) for i, h in rows for at, g in enumerate(grams(h, n).view(np.int64))
                    for w in h[at:at + n].view(np.int64)]
            columns = list(zip(*flat)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "at", "gram", "word", "size"])

    each = cut_lineage(items.select("item", "words").mapInArrow(words, "item long, at long, gram long, word long, size long"))
    counts = cut_lineage(word_counts(docs, each, text_col))
    total = counts.where("word is null").agg(F.sum("n")).first()[0] or 0
    share = each.join(counts, "word", "left").withColumn("log", F.log((F.coalesce("n", F.lit(0)) + 1) / F.lit(total + 1)))
    each = share.groupBy("item", "at", "gram", "size").agg(F.sum("log").alias("log"))
    held = each.groupBy("gram").agg(F.count_distinct("item").alias("items"))
    common = F.col("items") > TEMPLATE
    order = W.partitionBy("item").orderBy(common, "log", "at")  # no longer than the item
    ranked = each.join(held, "gram").withColumn("place", F.row_number().over(order))
    return ranked.where((F.col("place") <= SURE) | (~common & (F.exp("log") * RARE_WORDS <= expected))).select(
        "gram", "item", "at", "size")


def leaks_of_rows(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id_col: str, item_text_col: str,
                  min_share: float, min_score: int) -> DataFrame:
    """(doc_id, text_hash, item_id, score, share, last_word) of each distinct row and item: as :func:`find_leaks`."""
    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = Words()
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([known.hashes(t).tobytes() for t in texts(batch.column(1))], pa.binary())],
            names=["item", "words"])

    # An item is its text, whatever its ids; a document its id and text.
    items = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("text")).where("text <> ''")
    named = items.select(F.xxhash64("text").alias("item"), "item_id").distinct()
    items = cut_lineage(items.select(F.xxhash64("text").alias("item"), "text").dropDuplicates(["item"]).mapInArrow(
        sliced(split, 1), "item long, words binary"))
    docs = docs.select(F.col(id_col).cast("long"), F.col(text_col), F.xxhash64(text_col)).toDF("doc_id", "text", "text_hash")
    docs = docs.withColumn("row", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull(), "text_hash"))
    table = cut_lineage(seeds(docs, items))
    bits = BitTable(table, "gram")

    def hits(batches):
        known, places = Words(), bits.reader()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out_row, out_gram, out_at = [], [], []
            for i, text in enumerate(texts(batch.column(1))):
                g = grams(known.hashes(text))
                hit = places(g)
                out_row += [i] * len(hit)
                out_gram.append(g[hit].view(np.int64))
                out_at.append(hit)
            empty = [np.zeros(0, np.int64)]
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(out_row, pa.int64())), pa.array(np.concatenate(out_gram or empty)),
                 pa.array(np.concatenate(out_at or empty))], names=["row", "gram", "place"])

        yield from sliced(work, 1)(batches)

    found = docs.select("row", "text").mapInArrow(hits, "row long, gram long, place long")
    starts = (found.join(table, "gram").groupBy("row", "item", "size")
              .agg(F.collect_set(F.col("place") - F.col("at")).alias("starts")))  # no more than the text has words
    # Numbers only: the items' texts meet the passages that are cut for them.
    each = cut_lineage(starts.groupBy("row").agg(F.collect_list(F.struct("item", "size", "starts")).alias("met")))

    def cut(batches):
        known = Words()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            owner, item, begin, passage = [], [], [], []
            for i, (text, met) in enumerate(zip(texts(batch.column(2)), batch.column(3).to_pylist())):
                h = known.hashes(text)
                for x in met:
                    reach, more = [], MARGIN + x["size"] // 4
                    for s in sorted(x["starts"]):  # passages that overlap are one
                        a, b = max(0, s - more), min(len(h), s + x["size"] + more)
                        if reach and a <= reach[-1][1]:
                            reach[-1][1] = max(b, reach[-1][1])
                        else:
                            reach.append([a, b])
                    for a, b in reach:
                        owner.append(i)
                        item.append(x["item"])
                        begin.append(a)
                        passage.append(h[a:b].tobytes())
            take = pa.array(owner, pa.int64())
            return pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(item, pa.int64()), pa.array(begin, pa.int64()),
                 pa.array(passage, pa.binary())], names=["doc_id", "text_hash", "item", "begin", "passage"])

        yield from sliced(work, 2)(batches)

    some = perhaps_in(docs, F.col("row"), each.select("row"), "hit").where("hit").join(each, "row")
    # Written before they are scored, so that a task never needs two Python workers at a time.
    passages = cut_lineage(some.select("doc_id", "text_hash", "text", "met").mapInArrow(
        cut, "doc_id long, text_hash long, item long, begin long, passage binary"))

    def score(batches):
        for whole in batches:
            for batch in slices(whole, 4):
                pairs = [(np.frombuffer(w, np.uint64), np.frombuffer(p, np.uint64))
                         for w, p in zip(batch.column(5).to_pylist(), batch.column(4).to_pylist())]
                found = np.array(align_all(pairs), np.int64).reshape(-1, 2)
                full = MATCH * np.array([len(w) for w, _ in pairs], np.int64)
                share = found[:, 0] / np.maximum(full, 1)
                good = (found[:, 0] >= np.minimum(min_score, full)) & ((share >= min_share) | (found[:, 0] >= SURE_SCORE))
                last = batch.column(3).to_numpy() + found[:, 1] - 1
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array(found[:, 0]), pa.array(share), pa.array(last)],
                    names=["doc_id", "text_hash", "item", "score", "share", "last_word"]).filter(pa.array(good))

    best = F.max(F.struct("score", "share", "last_word")).alias("best")
    scored = (passages.join(items, "item").select("doc_id", "text_hash", "item", "begin", "passage", "words")
              .mapInArrow(score, "doc_id long, text_hash long, item long, score long, share double, last_word long")
              .groupBy("doc_id", "text_hash", "item").agg(best))
    return scored.join(named, "item").select("doc_id", "text_hash", "item_id", "best.*")


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_id_col: str = "item_id", item_text_col: str = "text", min_share: float = MIN_SHARE,
               min_score: int = MIN_SCORE) -> DataFrame:
    """(doc_id, item_id, score, share, last_word): texts that hold copies, also edited ones, of items.

    A text is a candidate for an item if both hold a seed; the passages around all shared seeds are
    aligned with the item, and the best one is returned if its score is at least ``min_score`` (or an
    item's full score, where that is less) and either ``min_share`` of the item's full score or
    SURE_SCORE, so an excerpt of some 30 words of a long item is found too. Words are runs of letters
    and digits of ASCII and characters beyond it, lower-cased.

    NULL and empty texts and items, and items of fewer words than a seed, leak nothing. A NULL id is an
    id like any other. Of texts under one id each is searched, and each of the items under one id;
    the best of them is returned, so (doc_id, item_id) never repeats. Empty tables give no rows, long
    texts are read whole, other columns play no part.
    """
    found = leaks_of_rows(docs, items, id_col, text_col, item_id_col, item_text_col, min_share, min_score)
    best = F.max(F.struct("score", "share", "last_word")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
               item_text_col: str = "text", min_share: float = MIN_SHARE, min_score: int = MIN_SCORE) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text holds no leak as :func:`find_leaks` finds it.

    Of rows that repeat an id those without a leak stay. Columns may have any name.
    """
    leaks = cut_lineage(leaks_of_rows(docs, items, id_col, text_col, item_id_col, item_text_col, min_share, min_score)
                        .select("doc_id", "text_hash").distinct())
    text_hash, hit, key_id, key_hash = unused(docs, "text_hash", "hit", "key_id", "key_hash")
    own = perhaps_in(docs.withColumn(text_hash, F.xxhash64(text_col)), F.col(text_hash), leaks.select("text_hash"), hit)
    named = leaks.select(F.col("doc_id").alias(key_id), F.col("text_hash").alias(key_hash))
    met = own.where(F.col(hit)).join(
        named, F.col(id_col).eqNullSafe(F.col(key_id)) & (F.col(text_hash) == F.col(key_hash)), "left_anti")
    return own.where(~F.col(hit)).select(*docs.columns).unionAll(met.select(*docs.columns))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` that hold copies of ``benchmark`` items."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
