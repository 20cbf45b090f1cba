"""Quality rules, license scans and toxicity."""

import random
import re
import zlib
from collections import Counter

import pytest

from trigflow.llm import licenses, quality, toxicity

WORD = r"[^\x20\x09-\x0D]+"


def brute_quality(text, min_repeat=quality.MIN_REPEAT):
    text = text or ""
    words = re.findall(WORD, text)

    def covered(n):
        seen = Counter(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
        return len({i + d for i in range(len(words) - n + 1) if seen[tuple(words[i:i + n])] > 1 for d in range(n)})

    longest = max((n for n in range(1, len(words)) if covered(n)), default=0) if len(words) < 400 else None
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            covered(3), covered(min_repeat), longest)


def test_quality_like_brute_force(make_docs):
    rnd = random.Random(1)
    say = lambda n, k: " ".join(rnd.choice(["aé", "b#", "c", "d<", "ee", "f\u00a0g", "h\u2003i"][:k]) for _ in range(n))
    rows = [(i, say(rnd.randint(0, 80), rnd.randint(1, 7))) for i in range(30)]
    passage = " ".join(f"w{i}" for i in range(25))
    rows += [(40, None), (41, ""), (42, " \n\t\r\x0b\x0c "), (43, passage + " x " + passage), (44, "l one\n\nl one\n \nl one"),
             (None, "a b c"), (45, "a"), (45, "a")]
    got = {}
    for r in quality.quality_rules(make_docs(rows)).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:8])
    for i, t in rows:
        assert brute_quality(t) in got[i], (i, t)
    assert sum(map(len, got.values())) == len(rows)


def test_quality_verdicts(make_docs):
    clean = " ".join(f"w{i}" for i in range(600))
    long = " ".join(f"v{i}" for i in range(210))
    rows = [(1, clean), (2, clean[:100]), (3, "a b c d " * 30), (4, clean + " " + long + " x " + long), (5, None)]
    kept = {r.doc_id: (r.base_failed, r.kept) for r in quality.quality_rules(make_docs(rows)).collect()}
    assert kept == {1: (False, True), 2: (True, False), 3: (True, False), 4: (False, False), 5: (True, False)}
    assert [r.doc_id for r in quality.keep_good(make_docs(rows)).collect()] == [1]
    assert quality.keep_good(make_docs(rows)).columns == make_docs(rows).columns
    assert quality.quality_rules(make_docs([])).count() == 0


def test_long_text(make_docs):
    text = " ".join(f"w{i % 30000}" for i in range(60000))
    r = quality.quality_rules(make_docs([(1, text)])).first()
    assert (r.n_words, r.longest_repeat, r.n_covered_words, r.kept) == (60000, 30000, 60000, False)


def test_license_phrases(make_docs):
    rows = [(1, "Under the MIT License and CC-BY; cc by CC BY"), (2, None), (3, ""), (4, "mit licenses, summit license"),
            (5, "# SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause\nGNU General\nPublic (License)"),
            (6, "éApache License"), (6, "Apache License"), (None, "Apache License")]
    got = {(r.doc_id, r.n_words): r for r in licenses.scan_licenses(make_docs(rows)).collect()}
    r = got[1, 11]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (4, 2, 9, "cc-by,mit")
    assert got[2, 0].n_base == 0 and got[2, 0].first_word is None and got[3, 0].labels == "" and got[3, 0].score == 0
    assert got[4, 4].n_base == 0
    r = got[5, 16]
    assert (r.first_word, r.base_labels, r.labels, r.score) == (12, "gpl", "apache-2.0,bsd-3-clause,gpl,mit", 1.0)
    assert len(licenses.scan_licenses(make_docs(rows)).where("doc_id = 6").collect()) == 2
    assert licenses.scan_licenses(make_docs([])).count() == 0


@pytest.mark.parametrize("text,postfix", [
    ("mit or apache-2.0 and bsd", ["mit", "apache-2.0", "bsd", "and", "or"]),
    ("( mit or x ) and bsd", ["mit", "x", "or", "bsd", "and"]),
    ("gpl-2.0 with classpath-exception-2.0 or mit", ["gpl-2.0", "classpath-exception-2.0", "with", "mit", "or"]),
])
def test_shunting_yard(text, postfix):
    assert licenses.to_postfix(text) == postfix


def test_expressions():
    assert licenses.evaluate("mit or foo") == ({"mit", "foo"}, 1.0)
    assert licenses.evaluate("mit and foo") == ({"mit", "foo"}, 0.5)
    assert licenses.evaluate("gpl-2.0+ with gcc-exception-3.1") == ({"gpl-2.0"}, 1.0)
    for bad in ("", "mit or", "( mit", "mit )", "and mit", "mit mit", "with"):
        assert licenses.evaluate(bad) == (set(), 0.25)
    assert licenses.expression_at_start("mit or apache-2.0 for all files") == "mit or apache-2.0"


def test_toxicity_learns_and_never_sees_held_out(spark, make_docs):
    rnd = random.Random(3)
    clean = ["the", "of", "tion", "ing", "ound", "mess", "air", "lamp"]
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [rnd.choice(clean) for _ in range(40)] + ["scumbag", "idiot"] * bad
        rnd.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (None, "idiot")]
    docs = make_docs(rows)
    table = spark.createDataFrame([*labels, (5000, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, table)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows)
    truth = dict(labels)
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= toxicity.THRESHOLD)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    flipped = table.withColumn("toxic", (1 - table.toxic)).where(toxicity.held_out(table.doc_id))
    assert toxicity.train(docs, table.where(~toxicity.held_out(table.doc_id)).unionByName(flipped)) == model
    one_class = toxicity.train(docs, table.where("toxic = 0"))
    assert all(r.predicted == 0 for r in toxicity.score(docs, one_class).collect())
    assert toxicity.score(make_docs([]), model).count() == 0
