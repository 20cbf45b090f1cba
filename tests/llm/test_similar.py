"""Near copies by shingle similarity, as the pipeline's stage drops them."""

import random

import corpus_pipeline
from trigflow.llm import similar, simhash


def plain_shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    sets = [plain_shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    close = [(i, j) for i in range(len(rows)) for j in range(i)
             if sets[i] == sets[j] or sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for _ in rows:
        for i, j in close:
            label[i] = label[j] = min(label[i], label[j])
    return {min(rows[j][0] for j in range(len(rows)) if label[j] == label[i]) for i in range(len(rows))}


def test_stage_drops_what_is_four_fifths_alike(spark, make_docs):
    rnd = random.Random(3)
    words = [f"W{i}" for i in range(400)]
    rows, notice = [], [rnd.choice(words) for _ in range(30)]
    for k in range(12):  # copies with more and more words replaced, on both sides of 0.8
        base = [rnd.choice(words) for _ in range(rnd.choice([40, 150, 300]))]
        rows.append((1000 - 10 * k, " ".join(base)))
        for m in range(1, 6):
            edited = list(base)
            for at in rnd.sample(range(len(base)), max(1, m * len(base) // 150)):
                edited[at] = "new"
            rows.append((1000 - 10 * k + m, " ".join(edited)))
    # A common passage, and groups of near copies that are larger than SMALL_GROUP.
    rows += [(2000 + i, " ".join([rnd.choice(words) for _ in range(9)] + notice)) for i in range(70)]
    for at in (3000, 4000):
        base = [rnd.choice(words) for _ in range(120)]
        for i in range(60):
            edited = list(base)
            for j in rnd.sample(range(120), rnd.randint(1, 3)):
                edited[j] = "x"
            rows.append((at + i, " ".join(edited)))
    rows += [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a b c")]
    got = {r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, make_docs(rows), "").collect()}
    assert got == plain_kept(rows)
    assert {r.doc_id for r in simhash.drop_near_copies(make_docs(rows)).collect()} - got  # four bits leave some of them
    some = similar.drop_similar(make_docs([(7, "one two"), (7, "one two"), (None, "one two"), (None, "only here")]))
    assert sorted((r.doc_id or 0, r.text) for r in some.collect()) == [(0, "only here"), (7, "one two")]
    assert similar.drop_similar(make_docs([])).count() == 0


def test_large_groups_leave_as_trees_and_are_judged_in_tiles(spark, make_docs, monkeypatch):
    """Texts that share some seven tenths make links in proportion to their number, and none that is alike is lost."""
    rnd = random.Random(7)
    words = [f"W{i}" for i in range(400)]
    base = [rnd.choice(words) for _ in range(150)]
    rows = []
    for i in range(90):
        edited = list(base)
        for at in rnd.sample(range(150), rnd.randint(3, 6)):
            edited[at] = f"x{rnd.randrange(9000)}"
        rows.append((i, " ".join(edited)))
    sketch = similar.sketches(make_docs(rows), "doc_id", "text").collect()
    members = spark.createDataFrame([(k % 3, r.node, r.n, r.node, r.sig) for r in sketch for k in range(3)],
                                    "key long, node long, n int, label long, sig binary")
    links = similar.ties(members).collect()
    assert 80 < len({x for link in links for x in link}) and len(links) < 3 * len(rows)
    monkeypatch.setattr(similar, "TILE", 16)
    assert {r.doc_id for r in similar.drop_similar(make_docs(rows)).collect()} == plain_kept(rows)
