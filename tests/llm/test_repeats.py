import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from trigflow.llm import repeats
from trigflow.llm.gsaca import suffix_arrays


def brute(rows, size):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(x[k:k + size] for _, x in data for k in range(len(x) - size + 1))
    out = []
    for i, x in data:
        gone = [False] * len(x)
        for k in range(len(x) - size + 1):
            if seen[x[k:k + size]] > 1:
                gone[k:k + size] = [True] * size
        kept = bytes(b for b, g in zip(x, gone) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(x), len(x) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_arrays_of_many_strings():
    rnd = random.Random(5)
    strings = []
    for _ in range(120):
        s = bytes(rnd.randint(1, rnd.choice([1, 2, 3, 255])) for _ in range(rnd.randint(0, 30)))
        strings.append(s + b"\0" + s[:rnd.randint(0, 9)] + s + b"\0")
    size = np.array([len(s) for s in strings])
    base = np.cumsum(size) - size
    got = suffix_arrays(np.frombuffer(b"".join(strings), np.uint8).astype(np.int64), base, size)
    for s, b in zip(strings, base.tolist()):
        assert [x - b for x in got[b:b + len(s)].tolist()] == sorted(range(len(s)), key=lambda k: s[k:])


def text_of(rnd, n):
    return " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7))) for _ in range(n))


@pytest.mark.parametrize("frequent,many", [(1024, 32), (1, 32), (1024, 1), (1, 1)])
def test_like_brute_force(make_docs, monkeypatch, frequent, many):
    monkeypatch.setattr(repeats, "FREQUENT", frequent)  # 1: every key is refined, before or after gathering
    monkeypatch.setattr(repeats, "MANY", many)
    rnd = random.Random(7)
    common, other = text_of(rnd, 90), text_of(rnd, 60)
    rows = [(i, text_of(rnd, rnd.randint(5, 90))) for i in range(12)]
    rows += [(20 + i, text_of(rnd, 9) + common + text_of(rnd, 9)) for i in range(9)]
    rows += [(60 + i, text_of(rnd, 4) + common + rnd.choice("xy") + text_of(rnd, 9)) for i in range(9)]
    rows += [(40, other + " " + other), (41, "ab" * 700), (42, "a" * 199), (43, "a" * 200), (44, "a" * 201), (45, common),
             (46, common), (47, None), (48, ""), (None, common[:250]), (49, other), (49, other), (50, "\x00" * 500)]
    got = [tuple(r) for r in repeats.remove_repeats(make_docs(rows)).collect()]
    assert Counter(got) == Counter(brute(rows, repeats.SIZE))


def test_long_texts_are_read_in_parts(make_docs, monkeypatch):
    monkeypatch.setattr(repeats, "BUFFER", 700)
    rnd = random.Random(11)
    common = text_of(rnd, 120)
    rows = [(1, text_of(rnd, 700) + common + text_of(rnd, 400)), (2, common), (3, "xyz" * 1500), (4, text_of(rnd, 900))]
    got = [tuple(r) for r in repeats.remove_repeats(make_docs(rows)).collect()]
    assert Counter(got) == Counter(brute(rows, repeats.SIZE))


def test_empty_table(make_docs):
    assert repeats.remove_repeats(make_docs([])).count() == 0
