"""Best-two-fit packing of token sequences, planned on the histogram of lengths."""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trigflow.llm.arrow import sliced, texts
from trigflow.session import cut_lineage

CAPACITY = 2048
CLOSING_ID = 0
#: White-space separated strings whose ids a task remembers.
REMEMBERED = 1_000_000
SPECIAL, MARKS = b"<|", b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Pieces of one length are numbered in this many parts.
SALTS = 64


class Encoder(dict):
    """Token ids of strings as little-endian 32-bit bytes, remembered; and of whole texts, string by string.

    Strings between ASCII white space are encoded on their own: the vocabulary drops white space
    and none of its steps looks across it.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode

    def __missing__(self, word: bytes) -> bytes:
        # Letters and the symbols after them are always apart, so both ends are looked up.
        head = word.rstrip(MARKS)
        if head and len(head) < len(word) and SPECIAL not in word and head.decode()[-1].isalpha():
            ids = self[head] + self[word[len(head):]]
        else:
            ids = array("I", self.encode(word.decode(), add_special_tokens=False).ids).tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = ids
        return ids

    def ids(self, text: bytes) -> bytes:
        # A-Z are lower-cased, as the vocabulary does later, unless a special token or a combining mark might notice.
        if not (SPECIAL in text or b"\xcc" in text or b"\xcd" in text):
            text = text.lower()
        return b"".join(map(self.__getitem__, text.split()))


#: One encoder for each vocabulary and worker process: tasks that follow find its strings remembered.
_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY, closing_id: int = CLOSING_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of each text and ``closing_id``, cut where longer than ``capacity``.

    NULL and empty texts are one piece with the closing id alone.
    """
    closing, width = np.array([closing_id], "<u4").tobytes(), 4 * capacity
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        encoder = encoder_of(tokenizer_path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            owners, rows = [], []
            for i, text in enumerate(texts(batch.column(1))):
                ids = encoder.ids(text) + closing
                for n, at in enumerate(range(0, len(ids), width)):
                    part = ids[at:at + width]
                    owners.append(i)
                    rows.append((n, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) or [()] * 4
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()).take(pa.array(owners, pa.int64())),
                 *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

        yield from sliced(work, 1)(batches)

    return docs.select(id_col, text_col).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Stock:
    """Counts of pieces by length, with the lengths in stock in order."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {k: v for k, v in counts.items() if v > 0}
        self.lengths = sorted(self.counts)

    def largest(self, limit: int) -> int | None:
        i = bisect_right(self.lengths, limit)
        return self.lengths[i - 1] if i else None

    def take(self, length: int, n: int = 1) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            self.lengths.remove(length)

    def give(self, length: int, n: int = 1) -> None:
        if length not in self.counts:
            insort(self.lengths, length)
        self.counts[length] = self.counts.get(length, 0) + n


def best_pair(stock: Stock, room: int, above: int) -> tuple[int, int] | None:
    """The two lengths in stock with the largest sum within ``room``, if it is more than ``above``."""
    lengths, best, pair = stock.lengths, above, None
    low, high = 0, bisect_right(lengths, room) - 1
    while low <= high:
        a, b = lengths[low], lengths[high]
        if a + b > room:
            high -= 1
        elif low == high and stock.counts[a] < 2:
            break
        else:
            if a + b > best:
                best, pair = a + b, (a, b)
                if best == room:
                    break
            low += 1
    return pair


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (lengths, how many alike) that hold ``counts`` pieces of each length.

    A bin takes the longest piece left, then greedily the longest that fits. Then its smallest
    piece is put back if two pieces left fill the widened gap more tightly. A bin is made
    as often as the stock allows, so the work depends on the number of lengths, not of pieces.
    """
    stock, out = Stock(counts), []
    while stock.lengths:
        content, room = [], capacity
        while (length := stock.largest(room)) is not None:
            content.append(length)
            stock.take(length)
            room -= length
        if room and len(content) > 1:
            smallest = content[-1]
            pair = best_pair(stock, room + smallest, smallest)
            if pair:
                stock.give(smallest)
                for x in pair:
                    stock.take(x)
                content = [*content[:-1], *sorted(pair, reverse=True)]
        each = {x: content.count(x) for x in content}
        more = min(stock.counts.get(x, 0) // n for x, n in each.items())
        for x, n in each.items():
            if more:
                stock.take(x, n * more)
        out.append((tuple(content), 1 + more))
    return out


def slots(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first, count, sequence, offset): the pieces numbered first … first+count-1 of a length go, in
    turn, to the sequences from ``sequence`` on, at ``offset``."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for content, n in plan:
        offset = 0
        for length in content:
            first = used.get(length, 0)
            out.append((length, first, n, sequence, offset))
            used[length] = first + n
            offset += length
        sequence += n
    return out


def place(table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``table`` (with an integer column ``length`` from 1 to ``capacity``) with sequence_id and offset.

    Pieces of one length are alike, so the plan needs only how many there are: at most
    ``capacity`` numbers, whatever the size of the table. Each piece then takes the slot that has
    its number among pieces of its length; the numbers are counted in salted parts.
    """
    spark = table.sparkSession
    salted = table.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    parts = {(r["length"], r["_salt"]): r["n"]
             for r in salted.groupBy("length", "_salt").agg(F.count("*").alias("n")).collect()}  # capacity × SALTS at most
    counts: dict[int, int] = {}
    firsts = []
    for (length, salt), n in sorted(parts.items()):
        firsts.append((length, salt, counts.get(length, 0)))
        counts[length] = counts.get(length, 0) + n
    found = slots(best_two_fit(counts, capacity))
    if not firsts:
        return table.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).limit(0)
    numbers = spark.createDataFrame(firsts, "length long, _salt int, _before long")
    starts: dict[int, list] = {}
    for length, first, _, sequence, offset in found:
        starts.setdefault(length, []).append((first, sequence, offset))
    places = spark.createDataFrame(
        [(k, [x[0] for x in v], [x[1] for x in v], [x[2] for x in v]) for k, v in starts.items()],
        "length long, _first array<long>, _sequence array<long>, _offset array<long>")
    order = W.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("_rank", F.row_number().over(order).cast("long") - 1)
    return (ranked.join(F.broadcast(numbers), ["length", "_salt"]).join(F.broadcast(places), "length")
            .withColumn("_number", F.col("_before") + F.col("_rank"))
            .withColumn("_slot", _last_at_most("_first", "_number"))
            .withColumn("sequence_id", F.get("_sequence", F.col("_slot")) + F.col("_number") - F.get("_first", F.col("_slot")))
            .withColumn("offset", F.get("_offset", F.col("_slot")))
            .select(*table.columns, "sequence_id", "offset"))


def _last_at_most(array: str, value: str):
    """Index of the last entry of an ascending array that is at most ``value``."""
    return F.size(F.filter(F.col(array), lambda x: x <= F.col(value))) - 1


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all texts with their places; see :func:`pieces` and :func:`place`.

    Rows that repeat an id, and those with a NULL id, are packed one by one. No rows for an empty table.
    """
    return place(cut_lineage(pieces(docs, tokenizer_path, id_col, text_col, capacity)), capacity)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` as token pieces packed into sequences of 2048."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
