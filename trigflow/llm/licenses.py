"""License scans: Aho-Corasick for notice phrases and tags, a shunting-yard parser for licence expressions."""

from __future__ import annotations

import re
import sys

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from trigflow.llm.arrow import sliced, texts

#: Phrase and label.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Phrases and labels of our own.
MORE_PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "all rights reserved": "reserved",
}
TAGS = ["spdx-license-identifier:", "license-expression:"]
FAMILIES = ("agpl", "lgpl", "gpl", "apache", "mit", "bsd", "mpl", "epl", "isc", "cc-by", "cc0", "unlicense", "zlib")
BINDS = {"or": 1, "and": 2, "with": 3}
#: Bytes that end a word: ASCII but letters and digits; letters are lower-cased.
TO_WORDS = bytes(b if b > 127 or 48 <= b < 58 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
TO_LOWER = bytes(b + 32 if 65 <= b < 91 else b for b in range(256))
SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double")


def to_postfix(expression: str) -> list[str]:
    """Shunting-yard: operands and operators of a licence expression in postfix order; ValueError if malformed."""
    out, waiting, operand_next = [], [], True
    for token in re.findall(r"[()]|[^\s()]+", expression):
        if token == "(":
            if not operand_next:
                raise ValueError(expression)
            waiting.append(token)
        elif token == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if operand_next or not waiting:
                raise ValueError(expression)
            waiting.pop()
        elif token in BINDS:
            if operand_next:
                raise ValueError(expression)
            while waiting and waiting[-1] != "(" and BINDS[waiting[-1]] >= BINDS[token]:
                out.append(waiting.pop())
            waiting.append(token)
            operand_next = True
        else:
            if not operand_next:
                raise ValueError(expression)
            out.append(token)
            operand_next = False
    if operand_next or "(" in waiting:
        raise ValueError(expression)
    return out + waiting[::-1]


def evaluate(expression: str) -> tuple[set[str], float]:
    """Labels named by a licence expression and how sure it is: AND takes the least, OR the most of its sides.

    An identifier of a known family counts 1, another 0.5; an exception (WITH) halves what is
    not known of it and names no label of its own. A malformed expression is worth (∅, 0.25).
    """
    try:
        postfix = to_postfix(expression)
    except ValueError:
        return set(), 0.25
    stack: list[tuple[set[str], float]] = []
    for token in postfix:
        if token in BINDS:
            (right, b), (left, a) = stack.pop(), stack.pop()
            if token == "with":
                stack.append((left, a if any("exception" in x for x in right) else a / 2))
            else:
                stack.append((left | right, min(a, b) if token == "and" else max(a, b)))
        else:
            stack.append(({token.rstrip("+")}, 1.0 if token.startswith(FAMILIES) else 0.5))
    return stack[0]


#: What may stand around an expression on its line.
AROUND = " \t\r*/#->\"'"
TOKEN, IDENTIFIER = re.compile(r"[()]|[^\s()]+"), re.compile(r"[a-z0-9][a-z0-9.+-]*")


def automaton(patterns) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for pattern in patterns:
        out.add_word(pattern, pattern)
    out.make_automaton()
    return out


class Scanner:
    """The automata of one task."""

    def __init__(self):
        self.phrases = {f" {p} ": (label, True) for p, label in BASE_PHRASES.items()}
        self.phrases |= {f" {p} ": (label, False) for p, label in MORE_PHRASES.items()}
        self.words = automaton(self.phrases)
        self.tags = automaton(TAGS)

    def scan(self, text: bytes) -> tuple:
        words = text.translate(TO_WORDS).split()
        line = " " + b" ".join(words).decode() + " "
        places, base, labels, n_more = [], set(), set(), 0
        at = blanks = 0
        for end, pattern in self.words.iter(line):
            blanks += line.count(" ", at, end + 1)  # ends only rise, so each blank is counted once
            at = end + 1
            label, is_base = self.phrases[pattern]
            labels.add(label)
            if is_base:
                base.add(label)
                places.append(blanks - pattern.count(" "))
            else:
                n_more += 1
        score = 1.0 - 0.5 ** min(len(places) + n_more, 50)
        if b"license" in words:
            lower = text.translate(TO_LOWER).decode()
            line_end = -1
            for end, _ in self.tags.iter(lower):
                if end >= line_end:
                    line_end = lower.find("\n", end)
                    line_end = line_end if line_end >= 0 else len(lower)
                    last = len(lower[end + 1:line_end].rstrip(AROUND)) + end + 1
                named, sure = evaluate(expression_at_start(lower, end + 1, max(last, end + 1)))
                labels |= named
                score = max(score, sure)
        return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
                ",".join(sorted(labels)), score)


def expression_at_start(text: str, start: int = 0, stop: int = sys.maxsize) -> str:
    """The longest run of tokens from ``start`` that can belong to a licence expression, so prose after a tag is left out."""
    stop = min(stop, len(text))
    while start < stop and text[start] in AROUND:
        start += 1
    out, operand_next, depth = [], True, 0
    for match in TOKEN.finditer(text, start, stop):  # read only as far as the expression goes
        token = match.group()
        if token == "(" and operand_next:
            depth += 1
        elif token == ")" and not operand_next and depth:
            depth -= 1
        elif token in BINDS and not operand_next:
            operand_next = True
        elif operand_next and token not in BINDS and IDENTIFIER.fullmatch(token):
            operand_next = False
        else:
            break
        out.append(token)
    return " ".join(out)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: words, places of base phrases, base labels, all labels and a score from 0 to 1.

    NULL and empty texts have no words, no places (first and last word NULL), empty labels and
    score 0. Repeated rows are scanned one by one, texts of any length whole; an empty table gives no rows. Labels from tags are the identifiers of the
    expression, lower-cased, without a closing ``+``.
    """
    def run(batches):
        scanner = Scanner()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [scanner.scan(t) for t in texts(batch.column(1))]
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            arrays = [batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds))]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        yield from sliced(work, 1)(batches)

    return docs.select(id_col, text_col).mapInArrow(run, SCHEMA)


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices and expressions in all ``documents``."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
