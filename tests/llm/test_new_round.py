"""Whitening, k-d sharding, cross-tokenizer alignment, and edge cases of rules, licences, toxicity and secrets."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

import corpus_pipeline
from trigflow.llm import crosstoken, kdshards, licenses, secrets, similar, toxicity, urlfilter, whitening

VECTORS = "vec_id long, embedding array<float>, n long, x binary, width int"


class Matrix:
    def __init__(self, v):
        self.v, self.passes = v, 0

    def __call__(self, q):
        self.passes += 1
        return self.v @ q


@pytest.mark.parametrize("values", [
    np.r_[np.linspace(1.1, 1, 63), 0], 0.9 ** np.arange(64.0), np.r_[5, 4, 3, np.zeros(61)], np.ones(64),
    np.r_[1e9, np.linspace(1.1, 1, 63)], np.arange(5.0)[::-1] + 1, 1 / (1 + np.arange(300.0)), np.zeros(30)])
def test_eigenpairs_of_hard_spectra(values):
    d = len(values)
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((d, d)))[0]
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    got, vectors, _ = whitening.eigenpairs(Matrix(v), d, min(8, d), float(np.trace(v)))
    want = np.linalg.eigvalsh(v)[::-1][:8]
    assert np.abs(got - want).max() <= 1e-13 * max(want[0], 1e-300)
    assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max() < 1e-13
    assert np.abs(v @ vectors - vectors * got).max() <= 1e-12 * max(want[0], 1e-300)


def test_whitening_like_dense_algebra(spark):
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((300, 40)) * np.r_[3, 2.5, 2, 1.7, 1.5, 1.3, 1.2, 1.1, np.full(32, 0.5)]).astype(np.float32)
    x[:, 39] = 0.25  # no variance
    x[100:200] = x[100]  # a hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(900, None), (901, []), (902, [1.0] * 39 + [None]), (903, [float("nan")] * 40), (904, [float("inf")] * 40), (905, [1.0] * 7)]
    table = spark.createDataFrame([(i, v, 5, b"", 1) for i, v in [*rows, *bad, (None, rows[0][1]), (7, rows[7][1])]], VECTORS)
    got = whitening.whiten(table).collect()
    fitted = np.vstack([x, x[:1], x[7:8]])
    whole = np.floor(1024 * fitted.astype(np.float64)).astype(np.int64) + 100_000
    n, centred = len(whole), whole - whole.mean(axis=0)
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    assert Counter(r.vec_id for r in got) == Counter({**{i: 8 for i in range(300)}, None: 8, 7: 16})
    deviation = ((n * whole - whole.sum(axis=0)) ** 2).sum(axis=1)
    projected = centred @ vectors / np.sqrt(values)
    for r in got:
        i = 0 if r.vec_id is None else r.vec_id
        assert (r.n, r.deviation) == (n, deviation[i])
        assert abs(abs(r.whitened) - abs(projected[i, r.component - 1])) < 1e-9
        assert abs(r.explained / (values[r.component - 1] / np.trace(cov)) - 1) < 1e-9 and r.identity_error < 1e-9
    assert whitening.whiten(table.where("vec_id > 899")).count() == 0  # one vector of seven: no variance
    assert whitening.whiten(table.limit(0)).count() == 0
    huge = whitening.Centred(1 << 40, [0, 0])
    assert huge.deviation(np.array([[3, 0], [1 << 30, 0]])) == [None, None]
    assert huge.deviation(np.array([[0, 0]])) == [0]


DOCS = "doc_id long, text string, lang string, source string, n_chars long, rid long, tie long, node long, size string"


def test_kd_shards(spark):
    rnd = random.Random(5)
    rows = [(i, "w" * rnd.randint(0, 60), rnd.choice(["en", "de", None]), rnd.choice(["a", "a", "b", "cc"]), rnd.randint(0, 99))
            for i in range(300)]
    rows += [(7, "same text", "en", "a", 9)] * 60 + [(None, None, None, None, None), (400, "", "en", "b", 0)]
    docs = spark.createDataFrame([(*r, 1, 2, 3, "z") for r in rows], DOCS).repartition(3)
    got = kdshards.kd_shards(docs, kdshards.document_dims(), 16).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (r[0], len(r[1] or "") + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r)
    assert sorted(shards) == list(range(16))
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in shards.values())
    sums = [sum(r.size for r in s) for s in shards.values()]
    assert max(sums) - min(sums) <= 2 * max(r.size for r in got)
    # A leaf is a box: sources of the two halves of the first cut overlap in one value at most.
    source = {r[0]: r[3] or "" for r in rows}
    left = {source[r.doc_id] for r in got if r.shard < 8}
    right = {source[r.doc_id] for r in got if r.shard >= 8}
    assert max(left) <= min(right)
    odd = kdshards.kd_shards(docs, kdshards.document_dims(), target_bytes=2000).groupBy("shard").sum("size").collect()
    total = sum(r[1] for r in odd)
    assert len(odd) == -(-total // 2000) and all(abs(r[1] - total / len(odd)) <= 122 for r in odd)
    few = kdshards.kd_shards(docs.where("doc_id is null or doc_id = 400"), kdshards.document_dims(), 16).collect()
    assert len(few) == 2 and len({r.shard for r in few}) == 2
    assert kdshards.kd_shards(docs.limit(0), kdshards.document_dims(), 16).count() == 0


def plain_alignment(rows):
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = crosstoken.byte_letters()
    piece = lambda i: (bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i)
                       else b.id_to_piece(i).replace("▁", " ").encode())
    out, count = [], Counter()
    for _, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        parts = [[bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a], [piece(i) for i in ids_b]]
        if not text or any(b"".join(p) != (" " + text).encode() for p in parts):
            out.append(None)
            continue
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
        common = sorted(set(ends[0]) & set(ends[1]))
        links = [(ids_a[ends[0].index(e)], ids_b[ends[1].index(e)]) for e in common]
        groups, start = [], 0
        for e in common:
            groups.append("|".join(",".join(str(i) for i, x in zip(ids, end) if start < x <= e)
                                   for ids, end in zip((ids_a, ids_b), ends)))
            start = e
        count.update(links)
        out.append((len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [(0,) * 6 + ("",) if x is None else
            (*x[:3], len(x[3]), sum(count[k] == best[k[1]] for k in x[3]), sum(count[k] for k in x[3]), x[4]) for x in out]


def test_alignment_of_tokens(make_docs, monkeypatch):
    rnd = random.Random(5)
    bits = [" ", "  ", "\t", "\n", " ", "　", "a", "the ", "é", "ß", "中", "▁", "😀", "!", "9", ". ", "'s ", "\x1c", "\x85",
            "​", "<s>", "<|endoftext|>", "́", "word ", " of ", "x" * 70 + " "]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 25)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " "), (203, "one two"), (203, "one two"), (None, "one two"), (204, "x▁y")]
    rows.append((205, "lorem ipsum " * 4000))
    monkeypatch.setattr(crosstoken, "SLICE_BYTES", 500)  # pairs of many slices meet
    got = crosstoken.align_tokens(make_docs(rows), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    want = plain_alignment(rows)
    assert Counter(tuple(r) for r in got.collect()) == Counter((i, *w) for (i, _), w in zip(rows, want))
    assert sum(w[0] == 0 for w in want) > 3
    none = crosstoken.align_tokens(make_docs([]), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    assert none.count() == 0


def test_a_rule_without_path_fits_every_path(spark):
    rules = spark.createDataFrame([("block", "evil.com", ""), ("allow", "evil.com", "/ok")], "verdict string, host string, path string")
    urls = ["http://evil.com/x", "http://evil.com", "http://evil.com?q", "http://a.evil.com#f", "http://evil.com/ok/1", "http://notevil.com", None]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urlfilter.judge(pages, rules).collect()}
    assert got == {0: "block", 1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow"}


def test_toxicity_without_labels(spark, make_docs):
    docs = make_docs([(1, "some text"), (2, None)])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert {(r.score, r.predicted) for r in got} == {(0.5, 0)}
    long = toxicity.score(make_docs([(1, "word " * 200_000)]), toxicity.train(docs, labels)).first()
    assert long.score == 0.5


def plain_license(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = sorted((i, label) for p, label in licenses.BASE_PHRASES.items() for i in range(len(words))
                    if words[i:i + len(p.split())] == p.split())
    return (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None,
            ",".join(sorted({x for _, x in places})))


def test_licenses_like_brute_force(make_docs):
    rnd = random.Random(7)
    bits = ["cc", "by", "CC-BY", "mit", "License", "gnu general", "public", "license", "apache", "x", ".", "\n", "é"]
    rows = [(i, " ".join(rnd.choice(bits) for _ in range(rnd.randrange(40)))) for i in range(80)] + [(90, None), (91, ""), (92, "cc by " * 50_000)]
    got = {r.doc_id: tuple(r)[1:6] for r in licenses.scan_licenses(make_docs(rows)).collect()}
    assert got == {i: plain_license(t) for i, t in rows}
    assert licenses.scan_licenses(make_docs([])).count() == 0
    tags = licenses.Scanner().scan(b"SPDX-License-Identifier: MIT license " * 20_000)
    assert tags[:2] == (100_000, 20_000) and tags[5] == "mit"


def test_many_secrets_and_clashing_columns(spark):
    text = "token=abcdefgh12 é" * 3000 + "end"
    docs = spark.createDataFrame([(1, text, 1, "b", "s", "o"), (2, None, 2, "b", "s", "o"), (2, None, 2, "b", "s", "o")],
                                 "doc_id long, text string, n_chars long, blob string, spans string, own string")
    got = secrets.redact_all(docs).collect()
    assert got[0].text in ("[SECRET] é" * 3000 + "end", None)
    assert sorted((r.doc_id, len(r.text or ""), r.blob, r.spans, r.own) for r in got) == [
        (1, 3000 * 10 + 3, "b", "s", "o"), (2, 0, "b", "s", "o"), (2, 0, "b", "s", "o")]
    assert secrets.redact_all(docs.limit(0)).count() == 0
    kept = similar.drop_similar(spark.createDataFrame(
        [(1, "a b c", 5, 6, 7), (2, "a b c", 5, 6, 8), (3, "d", 1, 1, 1)], "doc_id long, text string, text_hash long, hit long, key_id long"))
    assert sorted(tuple(r) for r in kept.collect()) == [(1, "a b c", 5, 6, 7), (3, "d", 1, 1, 1)]


def test_pipeline_over_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
