"""SimHash, links, components and decontamination."""

import random
import re

import numpy as np
import xxhash

from trigflow.llm import decontaminate, graph, simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, bits=4):
    label = list(range(len(ids)))
    for _ in ids:
        for i in range(len(ids)):
            for j in range(len(ids)):
                if bin(fps[i] ^ fps[j]).count("1") <= bits:
                    label[j] = label[i] = min(label[i], label[j])
    return {k: min(ids[j] for j in range(len(ids)) if label[j] == label[i]) for i, k in enumerate(ids)}


def test_near_copies_like_brute_force(make_docs):
    rnd = random.Random(2)
    words = [f"W{i}é" for i in range(300)]
    base = [rnd.choice(words) for _ in range(160)]
    rows = [(90 - i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 30)))) for i in range(12)]
    for i in range(25):
        edited = list(base)
        edited[rnd.randrange(160)] = "new"
        rows.append((100 + i, "\u00a0 ".join(edited) if i % 9 == 0 else "  ".join(edited).upper() if i % 7 == 0 else " ".join(edited)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "a b"), (204, "A b")]
    got = {r.doc_id: r for r in simhash.near_copies(make_docs(rows)).collect()}
    fps = [plain_fingerprint(t) for _, t in rows]
    assert [int(got[i].fingerprint, 16) for i, _ in rows] == fps
    assert {i: r.component_id for i, r in got.items()} == plain_components([i for i, _ in rows], fps)
    kept = simhash.drop_near_copies(make_docs([*rows, rows[0], (None, "a b"), (None, "only here and nowhere else")]))
    left = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in left if x is not None) == sorted(set(r.component_id for r in got.values()))
    assert left.count(None) == 1 and kept.columns == make_docs([]).columns
    assert simhash.near_copies(make_docs([])).count() == 0


def test_large_groups_are_joined_as_all_pairs_would(spark):
    rnd = np.random.default_rng(4)
    centre = rnd.integers(0, 1 << 62, 3, dtype=np.int64)
    fps = []
    for c in centre:
        for _ in range(150):
            bits = rnd.choice(64, rnd.integers(0, 5), replace=False)
            fps.append(int(np.int64(c) ^ np.bitwise_xor.reduce(np.left_shift(np.int64(1), bits.astype(np.int64)), initial=np.int64(0))))
    fps = sorted(set(fps))
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = simhash.fingerprint_links(table)
    roots = {r.node: r.root for r in graph.components(links).collect()}
    a = np.array(fps, np.int64)
    label = np.arange(len(a))
    near = np.bitwise_count(a.view(np.uint64)[:, None] ^ a.view(np.uint64)) <= 4
    for _ in range(len(a)):
        new = np.where(near, label, len(a)).min(axis=1)
        if (new == label).all():
            break
        label = new
    assert {f: roots.get(f, f) for f in fps} == {f: fps[k] for f, k in zip(fps, label.tolist())}


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(40)] + [(7, 7), (3, 2), (100, 90)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 100: 90}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_score(a, b):
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max(best, *new)
    return best


def test_alignment_like_plain_smith_waterman():
    rnd = random.Random(6)
    pairs = []
    for _ in range(60):
        a = [rnd.randrange(4) for _ in range(rnd.randint(0, 20))]
        b = [rnd.randrange(4) for _ in range(rnd.randint(0, 30))]
        pairs.append((a, b))
    got = decontaminate.align_all([(np.array(a, np.uint64), np.array(b, np.uint64)) for a, b in pairs])
    assert [s for s, _ in got] == [plain_score(a, b) for a, b in pairs]


def test_leaks(spark, make_docs):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(30))) for k in range(5)] + [(7, None), (8, ""), (None, "x y z"), (9, "one two")]
    fill = lambda n: " ".join(word() for _ in range(n))
    edited = items[1][1].split()
    edited[5:6], edited[14:14], edited[22] = [], ["extra"], "other"
    rows = [(i, fill(60)) for i in range(20)]
    rows += [(50, fill(40) + " " + items[0][1] + " " + fill(9)), (51, fill(9) + " " + " ".join(edited)), (52, items[2][1].upper() + "!"),
             (53, fill(5) + " " + items[3][1].replace(" ", ", ") + ". " + items[4][1]), (54, items[3][1][:40]), (55, None), (56, ""),
             (52, "again"), (None, items[0][1])]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(make_docs(rows), table).collect()}
    assert set(got) == {(50, 0), (51, 1), (52, 2), (53, 3), (53, 4), (None, 0)}
    assert got[50, 0].share == 1.0 and 0.8 < got[51, 1].share < 1
    assert got[50, 0].last_word == 69
    left = [(r.doc_id, r.text) for r in decontaminate.drop_leaks(make_docs(rows), table).collect()]
    assert {i for i, _ in left} == {*range(20), 52, 54, 55, 56} and (52, "again") in left and len(left) == 24
    assert decontaminate.find_leaks(make_docs([]), table).count() == 0
    assert decontaminate.find_leaks(make_docs(rows), table.limit(0)).count() == 0


def plain_leaks(rows, items):
    """Pairs by aligning every text with every item that has three words."""
    words = lambda t: re.findall(r"[a-z0-9\x80-\uffff]+", (t or "").lower())
    out = set()
    for doc, text in rows:
        for item_id, item in items:
            a, b = words(item), words(text)
            if len(a) < 3:
                continue
            s, full = plain_score(a, b), 2 * len(a)
            if s >= min(16, full) and (s >= 0.45 * full or s >= 60):
                out.add((doc, item_id))
    return out


def test_leaks_like_brute_force(spark, make_docs):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    fill = lambda n: " ".join(word() for _ in range(n))
    # Two texts under one id, a NULL id, one text under two ids, a short item and a long one.
    items = [(1, fill(20)), (1, fill(20)), (None, fill(20)), (3, "short item here"), (4, fill(200))]
    items.append((5, items[0][1]))
    alone = [(i, t) for i, (_, t) in enumerate(items[:3])]  # a corpus of nothing but copies
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(make_docs(alone), table).collect()}
    assert got == plain_leaks(alone, items) == {(0, 1), (0, 5), (1, 1), (2, None)}
    excerpt = " ".join(items[4][1].split()[90:140])
    rows = [(10 + i, fill(30)) for i in range(10)] + [(30, fill(5) + " " + excerpt + " " + fill(5)), (31, fill(9) + " Short item, here!"),
            (None, fill(3) + " " + items[1][1]), (32, fill(4) + " " + items[2][1]), (32, fill(4)), (32, None)]
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(make_docs(rows), table).collect()}
    assert got == plain_leaks(rows, items) == {(30, 4), (31, 3), (None, 1), (32, None)}


def test_items_of_one_template(spark, make_docs):
    rnd = random.Random(10)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    head = " ".join(word() for _ in range(12))
    items = [(k, head + " " + " ".join(word() for _ in range(12))) for k in range(40)]
    rows = [(k, " ".join(word() for _ in range(20)) + " " + items[k][1]) for k in range(5)] + [(9, head)]
    table = spark.createDataFrame(items, "item_id long, text string")
    seeds = decontaminate.seeds(make_docs(rows), spark.createDataFrame(
        [(k, decontaminate.Words().hashes(t.encode()).tobytes()) for k, t in items], "item long, words binary")).collect()
    assert not [s for s in seeds if s["at"] < 10]  # the head leads to no item
    best = {r.doc_id: r.item_id for r in decontaminate.find_leaks(make_docs(rows), table).collect() if r.share == 1}
    assert best == {k: k for k in range(5)}
    text = " ".join(word() for _ in range(60_000)) + " " + items[7][1]
    assert [r.item_id for r in decontaminate.find_leaks(make_docs([(1, text)]), table).collect() if r.share == 1] == [7]
