"""Alignment of two tokenizations: each distinct text once, pair counts weighted by how often the text occurs."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigflow.llm.arrow import slices, texts
from trigflow.session import scratch_path

#: Strings after which a worker begins to forget, the longest it remembers, and how many are aligned at once.
REMEMBERED, LONGEST, AT_ONCE = 150_000, 64, 50_000
#: Bytes of text whose links are stored as one row.
SLICE_BYTES = 8 << 20
ID_BITS = 32
#: No token of either vocabulary begins before a space and ends after it, where the character before is one of
#: these (none is white space by any definition): strings between such places are encoded on their own.
CUT = re.compile("(?<=[!-~¡-ɏ])(?= )")
UNSURE = re.compile("[^!-~¡-ɏ] |^ | $")
#: Strings whose letters and digits are told apart in the same way by any version of Unicode.
PLAIN = re.compile("[!-~¡-ɏ]+")
MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Aligner:
    """What is known of each string between cuts: its groups, links and token numbers; None where bytes differ."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        size = 1 + max(self.a.get_vocab().values())
        entries = [self.a.id_to_token(i) or "" for i in range(size)]
        self.bytes_a = [bytes(letters.get(c, 0) for c in e) for e in entries]
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[1:-1], 16)]) if self.b.is_byte(i)
                        else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.tables = [(np.array([len(x) for x in t]), t) for t in (self.bytes_a, self.bytes_b)]
        # Ids as text with what follows them: within a group, at its end, and for B at the end of a string.
        ends = [(t, end) for t, some in ((self.bytes_a, ",|"), (self.bytes_b, ",;\n")) for end in some]
        self.said = [f"{i}{end}" for t, end in ends for i in range(len(t))]
        self.fast = self.ranked(path_a)
        self.known, self.before = {}, {}  # strings met of late, and those before them

    def ranked(self, path: str):
        """An encoder of ASCII and Latin strings that gives the same ids sooner, if the vocabulary's ids rank its merges."""
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if sorted(model["vocab"].get(m, -1) for m in merged) != [model["vocab"].get(m) for m in merged]:
            return self.slow
        import public_tokenizers
        import tiktoken

        letters = byte_letters()
        known = {*letters, *merged}
        ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t in known}
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def slow(self, text: str) -> list[int]:
        return self.a.encode(text, add_special_tokens=False).ids

    def both(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Token ids of `` `` + each string by both vocabularies."""
        return [(self.fast if PLAIN.fullmatch(p) else self.slow)(" " + p) for p in parts], self.b.encode(parts, num_threads=1)

    def same(self, part: str, a: list[int], b: list[int]) -> bool:
        whole = (" " + part).encode()
        return b"".join(map(self.bytes_a.__getitem__, a)) == whole == b"".join(map(self.bytes_b.__getitem__, b))

    def all_same(self, parts: list[str], n_a: np.ndarray, ids_a: np.ndarray, n_b: np.ndarray, ids_b: np.ndarray) -> bool:
        """Whether no string has tokens whose bytes differ from its own."""
        whole = [(" " + p).encode() for p in parts]
        sizes = np.fromiter(map(len, whole), np.int64, len(whole))
        for n, ids, size, table in ((n_a, ids_a, *self.tables[0]), (n_b, ids_b, *self.tables[1])):
            upto = np.r_[0, np.cumsum(size[ids])]
            stops = np.cumsum(n)
            if (upto[stops] - upto[stops - n] != sizes).any() or b"".join(map(table.__getitem__, ids.tolist())) != b"".join(whole):
                return False
        return True

    def aligned(self, parts: list[str]) -> list[tuple[bytes, bytes, int] | None]:
        """Of each string: groups as text, links as packed id pairs, and both token numbers."""
        if not parts:
            return []
        a, b = self.both(parts)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        ids_a, ids_b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b))
        if not self.all_same(parts, n_a, ids_a, n_b, ids_b):
            good = [self.same(*x) for x in zip(parts, a, b)]
            found = iter(self.aligned([p for p, ok in zip(parts, good) if ok]))
            return [next(found) if ok else None for ok in good]
        # All strings one after the other: no token is empty, so one of each side ends at an offset.
        ends_a, ends_b = np.cumsum(self.tables[0][0][ids_a]), np.cumsum(self.tables[1][0][ids_b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        at_a, at_b = np.searchsorted(ends_a, common), np.searchsorted(ends_b, common)
        links = (ids_a[at_a] << ID_BITS) | ids_b[at_b]
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        last_b = np.zeros(len(ids_b), np.int64)
        last_b[at_b] = 1
        last_b[np.cumsum(n_b) - 1] = 2
        last_a = np.zeros(len(ids_a), np.int64)
        last_a[at_a] = 1
        # Within a group the ids of A come first: each id moves on by those of the other side before it.
        code = np.empty(len(ids_a) + len(ids_b), np.int64)
        code[np.arange(len(ids_a)) + np.r_[0, at_b + 1][group_a]] = last_a * len(self.bytes_a) + ids_a
        code[np.arange(len(ids_b)) + at_a[group_b] + 1] = 2 * len(self.bytes_a) + last_b * len(self.bytes_b) + ids_b
        said = "".join(map(self.said.__getitem__, code.tolist())).encode().split(b"\n")
        stops = np.searchsorted(common, ends_a[np.cumsum(n_a) - 1], side="right")
        packed, both = links.astype("<i8").tobytes(), ((n_a << ID_BITS) | n_b).tolist()
        starts = np.r_[0, stops[:-1]]
        return [(g, packed[8 * i:8 * j], n) for g, i, j, n in zip(said, starts.tolist(), stops.tolist(), both)]

    def learn(self, parts: list[str]) -> None:
        """From now on all of ``parts`` are known; those not met for long are forgotten."""
        if len(self.known) > REMEMBERED:
            self.known, self.before = {}, self.known
        missing = [p for p in parts if p not in self.known]
        again = [p for p in missing if p in self.before]
        self.known.update(zip(again, map(self.before.__getitem__, again)))
        missing = [p for p in missing if p not in self.known]
        for at in range(0, len(missing), AT_ONCE):
            some = missing[at:at + AT_ONCE]
            self.known.update(zip(some, self.aligned(some)))

    def texts(self, some: list[str]) -> list[tuple[bytes, bytes, int] | None]:
        """As :meth:`aligned` of whole texts, put together from the strings between cuts."""
        cut = [parts_of(t) for t in some]
        self.learn(list(set(chain.from_iterable(cut))))
        out = []
        for parts in cut:
            found = list(map(self.known.__getitem__, parts))
            out.append(None if None in found else (
                b";".join([f[0] for f in found]), b"".join([f[1] for f in found]), sum([f[2] for f in found])))
        for long in [p for p in self.known if len(p) > LONGEST]:
            del self.known[long]
        return out


def parts_of(text: str) -> list[str]:
    """The strings between cuts, each without the space it begins with; `` `` + text is what is cut."""
    if not UNSURE.search(text):
        return text.split(" ")
    parts = [p[1:] for p in CUT.split(" " + text)]
    if len(parts) > 1 and not parts[-1].strip(" "):  # spaces at the end stay with what is before them
        last = parts.pop()
        parts[-1] += " " + last
    return parts


#: One aligner for each pair of vocabularies and worker process.
_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner_of(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values, "<i4").tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), "<i4")


def _linked(batch: pa.RecordBatch, aligner: Aligner) -> pa.RecordBatch | None:
    """One row for a slice of distinct texts: measures of each, their links by number of the slice's pair, and pair counts."""
    keys, sums, links, times = [], [], [], []
    aligned = aligner.texts([t.decode(errors="replace") for t in texts(batch.column(0))])
    for found, key, n in zip(aligned, batch.column(1).to_pylist(), batch.column(2).to_pylist()):
        if found is None:
            continue
        groups, pairs, both = found
        keys.append(key)
        times.append(n)
        links.append(np.frombuffer(pairs, "<i8"))
        sums.append((both >> ID_BITS, both & ((1 << ID_BITS) - 1), groups.count(b";") + 1, len(links[-1]),
                     hashlib.sha256(groups).hexdigest()))
    if not keys:
        return None
    lengths = np.array([len(x) for x in links])
    pairs, number = np.unique(np.concatenate(links), return_inverse=True)
    owner = np.repeat(np.arange(len(keys)), lengths)
    # a text's equal links become one entry with its number of them
    entry, count = np.unique(owner * len(pairs) + number, return_counts=True)
    owner, number = np.divmod(entry, max(1, len(pairs)))
    # sums of whole numbers, exact up to 2^53 for one slice
    weight = np.bincount(number, count * np.array(times, float)[owner], len(pairs)).astype(np.int64)
    gaps = np.diff(number, prepend=0)
    n_a, n_b, n_groups, n_links, digest = zip(*sums)
    return pa.RecordBatch.from_arrays(
        [pa.array([uuid.uuid4().hex]), pa.array([keys], pa.list_(pa.binary())),
         *(pa.array([x], pa.list_(pa.int64())) for x in (n_a, n_b, n_groups, n_links)), pa.array([digest], pa.list_(pa.string())),
         pa.array([np.bincount(owner, minlength=len(keys))], pa.list_(pa.int64())),
         pa.array([_packed(gaps)], pa.binary()), pa.array([_packed(count)], pa.binary()),
         pa.array([pairs], pa.list_(pa.int64())), pa.array([weight], pa.list_(pa.int64()))],
        names=["slice", "keys", "n_a", "n_b", "n_groups", "n_links", "digest", "entries", "numbers", "counts", "pairs", "weights"])


_LINKED = ("slice string, keys array<binary>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
           "digest array<string>, entries array<long>, numbers binary, counts binary, pairs array<long>, weights array<long>")


def link_slices(docs: DataFrame, path_a: str, path_b: str, text_col: str) -> DataFrame:
    """Slices of distinct texts with their links, written to the shared folder; texts whose bytes do not match are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(path_a, path_b)
        for batch in batches:
            for part in slices(batch, 0, SLICE_BYTES):
                row = _linked(part, aligner)
                if row is not None:
                    yield row

    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "links")
    distinct = docs.select(F.col(text_col).alias("text")).where("text <> ''").groupBy("text").agg(F.count("*").alias("n"))
    keyed = distinct.select("text", F.unhex(F.sha2("text", 256)).alias("key"), "n")
    keyed.mapInArrow(run, _LINKED).write.parquet(path)
    return spark.read.parquet(path)


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, a, b, count, best): how many links of the corpus hold each id pair, and whether no pair of its B id has more."""
    counts = linked.select(F.explode(F.arrays_zip("pairs", "weights")).alias("p")).groupBy(
        F.col("p.pairs").alias("pair")).agg(F.sum("p.weights").alias("count"))
    counts = counts.withColumn("b", F.col("pair").bitwiseAND((1 << ID_BITS) - 1))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("pair", F.shiftright("pair", ID_BITS).alias("a"), "b", "count",
                                         (F.col("count") == F.col("most")).alias("best"))


def text_measures(linked: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each distinct text.

    A slice asks for the counts of its own pairs only: one row per pair and slice is shuffled,
    however many links hold it.
    """
    asked = linked.select("slice", F.explode("pairs").alias("pair"))
    answers = asked.join(counts.select("pair", "count", "best"), "pair").groupBy("slice").agg(
        F.sort_array(F.collect_list(F.struct("pair", "count", "best"))).alias("answers")).select(
        "slice", "answers.count", "answers.best")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                entries = np.array(row["entries"], np.int64)
                owner = np.repeat(np.arange(len(entries)), entries)
                number = np.cumsum(_unpacked(row["numbers"], len(owner)), dtype=np.int64)
                held = _unpacked(row["counts"], len(owner)).astype(np.int64)
                count, best = np.array(row["count"], np.int64), np.array(row["best"], bool)
                total, top = np.zeros(len(entries), np.int64), np.zeros(len(entries), np.int64)
                np.add.at(total, owner, count[number] * held)
                np.add.at(top, owner, best[number] * held)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["keys"], pa.binary()), *(pa.array(row[c], pa.int64()) for c in MEASURES[:4]),
                     pa.array(top), pa.array(total), pa.array(row["digest"])], names=["key", *MEASURES, "groups_sha256"])

    own = linked.select("slice", "keys", *MEASURES[:4], "digest", "entries", "numbers", "counts")
    return own.join(answers, "slice").mapInArrow(
        run, "key binary, " + ", ".join(f"{c} long" for c in MEASURES) + ", groups_sha256 string")


def align_tokens(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row.

    A space and the text are encoded by the byte-level vocabulary file ``path_a``; the text by the
    sentence-piece model ``path_b``, which adds the space. Offsets where tokens of both end cut them
    into groups; tokens that end together are linked. A pair's count is its number of links in all
    rows, so a text that occurs n times counts n times though it is encoded once. NULL and empty
    texts, and those that either vocabulary does not give back byte by byte, have zeros and ''.
    Repeated rows and NULL ids stay, an empty table gives no rows, other columns play no part. Texts
    of any length are encoded whole.
    """
    linked = link_slices(docs, path_a, path_b, text_col)
    measured = text_measures(linked, pair_counts(linked))
    own = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(F.col(text_col), 256)).alias("key"))
    return own.join(measured, "key", "left").select(
        "doc_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in MEASURES],
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def op13_crosstoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tokenizations of all ``documents``, aligned."""
    import public_tokenizers

    return align_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"),
                        public_tokenizers.path("piece_bpe_32k.model"))
