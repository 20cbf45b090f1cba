"""Quality rules with suffix-array repetition over the words of each text."""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigflow.llm.arrow import sliced, texts

#: Repeats of this many words count as repeated substance.
MIN_REPEAT = 10
#: Most words, as a fraction, that repeats may cover.
MAX_COVERED = 0.45
#: Longest repeat that a text may hold, in words.
MAX_LONGEST = 200
MIN_WORDS = 50
MAX_REPEATED_WINDOWS = 50
SPACES = b" \t\n\x0b\x0c\r"
NOT_WORD_CHARS = SPACES + bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "n_covered_words long, longest_repeat long, base_failed boolean, kept boolean")


def suffix_arrays(words: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix arrays of several texts at once, by prefix doubling.

    ``words`` are the word numbers of all texts one after another, ``owner`` the ascending text
    number of each. Suffixes end with their text. Returns the suffix order, text by text, and
    for every doubling step the rank of each suffix by its first 2^step words.
    """
    n = len(words)
    width = int(words.max(initial=0)) + 1
    _, rank = np.unique(owner.astype(np.int64) * width + words, return_inverse=True)
    levels = [rank.astype(np.int32)]
    last = np.r_[np.flatnonzero(np.diff(owner)), n - 1] if n else np.zeros(0, int)
    end = last[np.searchsorted(last, np.arange(n))] + 1 if n else last
    # Only suffixes that still share a rank are sorted further; a rank is the place where its group begins.
    order = np.argsort(rank, kind="stable")
    starts = np.r_[True, np.diff(rank[order]) > 0] if n else np.zeros(0, bool)
    place = np.maximum.accumulate(np.where(starts, np.arange(n), 0)) if n else order
    rank = np.empty(n, np.int64)
    rank[order] = place
    levels[0] = rank.astype(np.int32)
    step = 1
    while n:
        alone = np.r_[starts[1:], True] & starts
        where = np.flatnonzero(~alone)
        if not len(where):
            break
        at = order[where]
        then = at + step
        inside = then < end[at]
        second = np.where(inside, rank[np.minimum(then, n - 1)] + 1, 0)
        by = np.argsort(rank[at] * (n + 1) + second, kind="stable")
        at, second = at[by], second[by]
        group = rank[at]
        new = np.r_[True, (np.diff(group) > 0) | (np.diff(second) > 0) | (np.diff(second) < 0)]
        order[where] = at
        starts[where] = new
        place = np.maximum.accumulate(np.where(new, where, 0))
        rank = rank.copy()
        rank[at] = place
        levels.append(rank.astype(np.int32))
        step *= 2
    return order, levels


def neighbour_prefixes(order: np.ndarray, levels: list[np.ndarray], owner: np.ndarray) -> np.ndarray:
    """Longest common prefix of each suffix in ``order`` with the one before it, 0 at the first of a text."""
    n = len(order)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    pairs = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    a, b, got = order[pairs - 1].copy(), order[pairs].copy(), np.zeros(len(pairs), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        ok = (a < n) & (b < n)
        x, y = np.minimum(a, n - 1), np.minimum(b, n - 1)
        same = ok & (levels[k][x] == levels[k][y])
        # A rank may be shared by suffixes that end early only if they are one and the same.
        step = np.where(same, 1 << k, 0)
        a, b, got = a + step, b + step, got + step
    lcp[pairs] = got
    return lcp


def longest_repeats(words: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each position the longest string from there that its text holds twice: its deepest common-prefix interval.

    Every maximal repeat is such a string at each of its places, and each of these lies within
    a maximal repeat, so the union of spans is the same for both.
    """
    order, levels = suffix_arrays(words, owner)
    lcp = neighbour_prefixes(order, levels, owner)
    out = np.zeros(len(words), np.int64)
    out[order] = np.maximum(lcp, np.r_[lcp[1:], 0]) if len(words) else lcp
    return out


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` positions the spans cover."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + lengths, -1)
    return np.cumsum(delta[:-1]) > 0


def measure(batch: list[bytes], min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """Counts of each text; see :func:`quality_rules`."""
    number: defaultdict = defaultdict(count().__next__)
    split = [t.split() for t in batch]
    sizes = np.fromiter(map(len, split), np.int64, len(batch))
    ids = np.fromiter((number[w] for ws in split for w in ws), np.int64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(batch)), sizes)
    repeats = longest_repeats(ids, owner)
    n, total = len(ids), lambda mask: np.bincount(owner[mask], minlength=len(batch)).astype(np.int64)
    short = np.flatnonzero(repeats >= 3)
    long = np.flatnonzero(repeats >= min_repeat)
    longest = np.zeros(len(batch), np.int64)
    np.maximum.at(longest, owner, repeats)
    lines = []
    for text in batch:
        seen, dup = set(), 0
        for line in text.split(b"\n"):
            if line.strip():
                dup += line in seen
                seen.add(line)
        lines.append(dup)
    return {
        "n_words": sizes,
        "word_chars": np.array([len(t.translate(None, NOT_WORD_CHARS)) for t in batch], np.int64),
        "n_symbols": np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in batch], np.int64),
        "n_dup_lines": np.array(lines, np.int64),
        "n_repeat_words": total(covered(short, np.full(len(short), 3), n)),
        "n_covered_words": total(covered(long, repeats[long], n)),
        "longest_repeat": longest,
    }


def judge(batch: list[bytes], min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED,
          max_longest: int = MAX_LONGEST) -> dict[str, np.ndarray]:
    """Counts and verdicts of each text."""
    m = measure(batch, min_repeat)
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED_WINDOWS * m["n_words"])
    kept = ~failed & (m["n_covered_words"] <= max_covered * m["n_words"]) & (m["longest_repeat"] <= max_longest)
    return m | {"base_failed": failed, "kept": kept}


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = MIN_REPEAT,
                  max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """Counts and verdict of each text, one row per input row.

    ``base_failed``: under 50 words, or over half of the words in repeated windows of three.
    ``kept``: not failed, repeats of ``min_repeat`` words or more cover at most ``max_covered``
    of the words, and none is longer than ``max_longest``. NULL and empty texts have no words
    and fail. Repeated rows are judged one by one; an empty table gives an empty result.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = judge(texts(batch.column(1)), min_repeat, max_covered, max_longest)
        arrays = [batch.column(0).cast(pa.int64()), *(pa.array(v) for v in m.values())]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(id_col, text_col).mapInArrow(sliced(work, 1), SCHEMA)


def keep_good(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text :func:`quality_rules` keeps. Nothing is shuffled."""
    schema, place = docs.schema, docs.columns.index(text_col)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(judge(texts(batch.column(place)), **limits)["kept"]))

    return docs.mapInArrow(sliced(work, place), schema)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality rules on all ``documents``."""
    rows = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.withColumn("long_repeat", F.col("longest_repeat") > MAX_LONGEST).drop("longest_repeat")


def _sql_windows(size: int) -> str:
    return f"""SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (
  SELECT doc_id, i, w[i : i + {size - 1}] AS g FROM (
    SELECT doc_id, w, unnest(range(1, len(w) - {size - 2})) AS i FROM t WHERE len(w) >= {size}))"""


ORACLE_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
r AS (SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words
      FROM ({_sql_windows(3)}), (SELECT unnest(range(3)) AS d) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT i + d) AS n_covered_words
      FROM ({_sql_windows(MIN_REPEAT)}), (SELECT unnest(range({MIN_REPEAT})) AS d) WHERE c > 1 GROUP BY doc_id),
z AS (SELECT DISTINCT doc_id, true AS long_repeat FROM ({_sql_windows(MAX_LONGEST + 1)}) WHERE c > 1),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(text) - length(translate(text, '{SYMBOLS.decode()}', '')) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
        coalesce(n_covered_words, 0) AS n_covered_words, coalesce(long_repeat, false) AS long_repeat
      FROM t LEFT JOIN r USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN z USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_WINDOWS} * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND n_covered_words <= {MAX_COVERED} * n_words AND NOT long_repeat AS kept FROM b
"""
