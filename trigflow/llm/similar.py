"""Near copies by the similarity of their word shingles.

SimHash fingerprints within four bits and MinHash bands find candidates; packed signatures sort out
those that only share a passage before a pair leaves its task. What is left in a key leaves it as a spanning
tree of its pairs; the trees' components meet in tiles of full sets, where all of their pairs are judged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trigflow.llm.arrow import give_back, sliced, texts
from trigflow.llm.columns import perhaps_in, unused
from trigflow.llm.graph import components
from trigflow.llm.simhash import fingerprint_links, forest
from trigflow.operators.align import key_runs
from trigflow.session import cut_lineage

WORDS = 5
#: Similarity (shared shingles over all shingles) of near copies, as a fraction: 0.8.
LEAST = (4, 5)
#: A pair at 0.8 shares no band with probability (1 - 0.8 ** ROWS) ** BANDS, 5 in 10^9; a closer one with less.
BANDS, ROWS = 48, 5
#: Signatures hold two bits of each of the BANDS * ROWS minima. Those of a pair at 0.8 agree in 204 of 240 on average,
#: and in fewer than AGREE with probability 1.2 in 10^9; at a similarity of 0.4 one pair in 10^6 agrees as much.
AGREE = 168
#: Shingles whose minima are taken at once, links that leave a task at once, and pairs that share a sent set.
BLOCK, PAIRS, STAR = 1 << 12, 1 << 16, 256
#: Nodes of a block: a component of m nodes is judged in tiles of two blocks, so a set is sent m / TILE times, once up to TILE.
TILE = 256

_DRAWN = np.random.default_rng(20)
FACTORS = _DRAWN.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32) | np.uint32(1)
MIXERS = _DRAWN.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_PAIRS_OF_BITS = np.uint64(0x5555555555555555)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of each five consecutive words; of all words where there are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    h = np.zeros(max(1, len(w) - WORDS + 1), np.uint64)
    for i in range(min(WORDS, len(w))):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i:i + len(h)]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ (h >> np.uint64(32)))


def minima(grams: np.ndarray) -> np.ndarray:
    """The least shingle under each of BANDS * ROWS orders."""
    low = (grams >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), BLOCK):
        least = np.minimum(least, (FACTORS * low[at:at + BLOCK]).min(axis=1))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key of each band: its minima under ROWS orders, and the number of the band."""
    key = ((least.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1)) * MIXERS).sum(axis=1, dtype=np.uint64)
    key ^= key >> np.uint64(31)
    return (key * np.uint64(0x9E3779B97F4A7C15) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def signature(least: np.ndarray) -> bytes:
    """Two bits of each minimum, in eight 64-bit words."""
    two = ((least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(30)
    packed = (two.astype(np.uint8).reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    return packed.tobytes().ljust(64, b"\0")


def print_of(grams: np.ndarray) -> int:
    """64-bit SimHash of a set of shingles: a bit is 1 if set in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(grams), BLOCK):
        part = grams[at:at + BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(grams), bitorder="little").view("<i8")[0])


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a similarity of LEAST or more."""
    both = np.concatenate([a, b])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared * LEAST[1] >= LEAST[0] * (len(both) - shared)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, node, n, fp, sig, keys) of each row: equal sets of shingles are one node."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t) for t in texts(batch.column(1))]
        node = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        least = [minima(s) for s in sets]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), batch.column(2), pa.array(node), pa.array([len(s) for s in sets], pa.int32()),
             pa.array([print_of(s) for s in sets], pa.int64()), pa.array([signature(x) for x in least], pa.binary()),
             pa.array([band_keys(x) if len(s) else [] for x, s in zip(least, sets)], pa.list_(pa.int64()))],
            names=["doc_id", "text_hash", "node", "n", "fp", "sig", "keys"])

    return docs.select(F.col(id_col), F.col(text_col), F.xxhash64(text_col)).toDF("doc_id", "text", "text_hash").mapInArrow(
        sliced(work, 1), "doc_id long, text_hash long, node long, n int, fp long, sig binary, keys array<long>")


def fitting(i: np.ndarray, j: np.ndarray, n: np.ndarray, label: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) of a group have different labels, sizes that allow LEAST, and signatures that agree."""
    least, most = np.minimum(n[i], n[j]).astype(np.int64), np.maximum(n[i], n[j]).astype(np.int64)
    fit = (label[i] != label[j]) & (least * LEAST[1] >= most * LEAST[0])
    at = np.flatnonzero(fit)
    x = sig[i[at]] ^ sig[j[at]]
    apart = np.bitwise_count((x | (x >> np.uint64(1))) & _PAIRS_OF_BITS).sum(axis=1, dtype=np.int64)
    fit[at] = apart <= BANDS * ROWS - AGREE
    return fit


def tree_of_group(node: np.ndarray, n: np.ndarray, label: np.ndarray, sig: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join what the fitting pairs of a key's members, sorted by their number of shingles, join; fewer than members."""
    left = np.arange(len(node))
    while len(left) > 1:
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            i = reached.pop()
            sizes = n[left]
            lo = int(np.searchsorted(sizes, -(-n[i] * LEAST[0] // LEAST[1])))
            hi = int(np.searchsorted(sizes, n[i] * LEAST[1] // LEAST[0], side="right"))
            near = left[lo:hi]
            fit = fitting(np.full(len(near), i), near, n, label, sig)
            if fit.any():
                yield np.full(int(fit.sum()), node[i]), node[near[fit]]
                reached.extend(near[fit].tolist())
                left = np.concatenate([left[:lo], near[~fit], left[hi:]])


def ties(members: DataFrame) -> DataFrame:
    """Links (a, b) that join what the fitting pairs of nodes with a key in common join. ``members(key, node, n, label, sig)``."""
    def work(batches):
        held: list[np.ndarray] = []
        left, right, count = [], [], 0

        def take():
            nonlocal left, right, count
            a, b = forest(*(np.concatenate(x or [np.zeros(0, np.int64)]) for x in (left, right)))
            left, right, count = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        def groups(columns):
            nonlocal count
            edge = np.flatnonzero(np.diff(columns[0])) + 1
            starts, stops = np.r_[0, edge], np.r_[edge, len(columns[0])]
            many = stops - starts > 1
            for s, e in zip(starts[many].tolist(), stops[many].tolist()):
                for a, b in tree_of_group(*(c[s:e] for c in columns[1:])):
                    left.append(a)
                    right.append(b)
                    count += len(a)
                    if count > PAIRS:
                        yield take()

        for batch in batches:
            new = [c.to_numpy() for c in batch.columns[:4]]
            new.append(np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint64).reshape(-1, 8))
            held = [np.concatenate(x) for x in zip(held, new)] if held else new
            if len(held[0]) > 1 << 16 and held[0][0] != held[0][-1]:
                cut = int(np.searchsorted(held[0], held[0][-1]))  # the last key may go on in the next batch
                yield from groups([c[:cut] for c in held])
                held = [c[cut:] for c in held]
        if held and len(held[0]):
            yield from groups(held)
        yield take()
        held.clear()
        give_back()

    return (members.select("key", "node", "n", "label", "sig").repartition("key").sortWithinPartitions("key", "n", "node")
            .mapInArrow(work, "a long, b long"))


def judged_in_tiles(groups: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join what the alike pairs of each group join. ``groups(node, root)``, ``nodes(node, n, label, sig)``.

    Every fitting pair of a group is judged by its full sets, unless its sides are joined already. ``sets(node, grams)``.
    """
    def judge(rows):
        node, n, label, block = (np.concatenate([r[k] for r in rows]) for k in range(4))
        sig, grams = np.concatenate([r[4] for r in rows]), [g for r in rows for g in r[5]]
        tile_of_two = block[0] != block[-1]
        for x in range(len(node)):
            y = np.arange(x + 1, len(node))
            if tile_of_two:
                y = y[block[y] != block[x]]
            for k in y[fitting(np.full(len(y), x), y, n, label, sig)].tolist():
                if label[k] != label[x] and alike(grams[x], grams[k]):
                    label[label == label[k]] = label[x]
                    yield node[x], node[k]

    def work(batches):
        tile, rows = None, []

        def close():
            links = list(judge(rows)) if rows and (tile[1] == tile[2] or rows[0][3][0] != rows[-1][3][-1]) else []
            rows.clear()
            a, b = np.array(links, np.int64).reshape(-1, 2).T
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            sets_at = set_views(batch.column(8))
            for key, s, e in key_runs(batch, 3):
                if key != tile:
                    yield close()
                    tile = key
                part = batch.slice(s, e - s)
                node, n, label, block = (part.column(k).to_numpy().copy() for k in (4, 5, 6, 3))
                sig = np.frombuffer(b"".join(part.column(7).to_pylist()), np.uint64).reshape(-1, 8)
                rows.append((node, n, label, block, sig, [sets_at(k).copy() for k in range(s, e)]))
        yield close()
        give_back()

    blocks = groups.groupBy("root").agg(F.ceil(F.count("*") / TILE).alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    placed = groups.join(blocks, "root").join(nodes, "node").select(
        "root", block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"), "node", "n", "label", "sig")
    tile = ["root", "i", "j"]
    rows = placed.join(sets, "node").select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                                            "block", "node", "n", "label", "sig", "grams")
    return rows.repartition(*tile).sortWithinPartitions(*tile, "block", "n", "node").mapInArrow(work, "a long, b long")


def named_sets(nodes: DataFrame, docs: DataFrame, firsts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, grams) of ``nodes(node)``, from one row each as ``firsts(node, doc_id, text_hash)`` names it.

    Only rows that may be named are shuffled, as sets of shingles.
    """
    def sets_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array([shingles(t).tobytes() for t in texts(batch.column(1))], pa.binary())],
            names=["doc_id", "text_hash", "grams"])

    named = nodes.join(firsts, "node").select("node", "doc_id", "text_hash")
    own = docs.select(F.col(id_col).cast("long"), F.col(text_col), F.xxhash64(text_col)).toDF("doc_id", "text", "text_hash")
    some = perhaps_in(own, row_key("doc_id", "text_hash"), named.select(row_key("doc_id", "text_hash").alias("key")), "hit")
    sets = some.where("hit").drop("hit").mapInArrow(sliced(sets_of, 1), "doc_id long, text_hash long, grams binary").alias("s")
    named = named.alias("m")
    return cut_lineage(
        sets.join(named, F.col("s.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("s.text_hash") == F.col("m.text_hash")))
        .select("m.node", "s.grams").dropDuplicates(["node"]))


def confirmed(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose sets of shingles are alike.

    Pairs with the same ``a`` form stars of some hundred: the set of ``a`` is sent once a star, that of ``b`` once a pair.
    """
    def work(batches):
        star, centre = None, np.zeros(0, np.uint64)
        for batch in batches:
            keep, sets = [], set_views(batch.column(3))
            for k, (a, part, b) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:3]))):
                if b is None:
                    star, centre = (a, part), sets(k).copy()  # the batch it lies in may go before its pairs are done
                elif star != (a, part):
                    raise ValueError("a star without its centre")
                keep.append(b is not None and alike(centre, sets(k)))
            yield batch.select([0, 2]).filter(pa.array(keep, pa.bool_()))
        give_back()

    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = named_sets(nodes, docs, firsts, id_col, text_col)
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).alias("parts"))
    part = F.pmod(F.xxhash64("b"), F.col("parts")).alias("part")
    rays = pairs.join(sizes, "a").select("a", part, "b")
    rows = rays.join(sets.withColumnRenamed("node", "b"), "b").select("a", "part", "b", "grams").unionAll(
        rays.select("a", "part").distinct().join(sets.withColumnRenamed("node", "a"), "a").select(
            "a", "part", F.lit(None).cast("long").alias("b"), "grams"))
    return cut_lineage(rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
                       .mapInArrow(work, "a long, b long"))


def set_views(column: pa.Array) -> Callable[[int], np.ndarray]:
    """The k-th set of a column of packed sets, read where it lies."""
    stops = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return lambda k: np.frombuffer(data[stops[k]:stops[k + 1]], np.uint64)


def row_key(doc_id: str, text_hash: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(doc_id), F.lit(-1)), F.col(doc_id).isNull(), F.col(text_hash))


def near_groups(rows: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, root) of all nodes that have a near copy, from the :func:`sketches` of ``docs``."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    firsts = cut_lineage(rows.groupBy("node").agg(first, F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("sig").alias("sig"))
                         .select("node", "first.doc_id", "first.text_hash", "n", "fp", "sig"))
    named = firsts.select("node", "doc_id", "text_hash")

    def confirm(pairs: DataFrame) -> DataFrame:
        return confirmed(pairs, docs, named, id_col, text_col)

    # Fingerprints: one node stands for each, others with the same one are linked to it.
    of_print = firsts.where("n > 0").groupBy("fp").agg(F.min("node").alias("node"))
    equal = firsts.where("n > 0").select("fp", F.col("node").alias("b")).join(of_print, "fp").where("node <> b").select(
        F.col("node").alias("a"), "b")
    close = fingerprint_links(of_print).join(of_print.select(F.col("fp").alias("a"), F.col("node").alias("na")), "a").join(
        of_print.select(F.col("fp").alias("b"), F.col("node").alias("nb")), "b").select(
        F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"))
    links = confirm(cut_lineage(equal.unionAll(close).distinct()))
    roots = cut_lineage(components(links))

    def labelled(table: DataFrame) -> DataFrame:
        return table.drop("label").join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")

    keys = labelled(rows.select("node", "keys").dropDuplicates(["node"])).select("node", "label", F.explode("keys").alias("key"))
    open_keys = keys.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    members = keys.join(open_keys.select("key"), "key").join(firsts.select("node", "n", "sig"), "node")
    groups = cut_lineage(components(ties(members)))
    if groups.isEmpty():
        return roots
    sets = named_sets(groups.select("node"), docs, named, id_col, text_col)
    found = judged_in_tiles(groups, labelled(firsts.select("node", "n", "sig")), sets)
    return cut_lineage(components(cut_lineage(links.unionAll(found))))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, all columns as they are: that with the smallest id.

    Texts that share 80% of their five-word shingles are linked, and a group is all that links join.
    NULL and wordless texts are one group. A NULL id comes last; of rows with the same id one with
    the smallest hash of the text stays, and of rows with the same id and text one of them. An empty
    table stays empty, texts are read whole, and further columns may have any name.
    """
    rows = cut_lineage(sketches(docs, id_col, text_col))
    roots = near_groups(rows, docs, id_col, text_col)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    placed = rows.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "doc_id", "text_hash")
    ids = placed.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("times"))
    first = ids.groupBy("root").agg(F.min(order).alias("first"))
    judged = cut_lineage(ids.join(first, "root").select(
        "doc_id", "text_hash", "times", (F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash") == F.col("first")).alias("stays")))
    # Rows that neither go nor repeat are passed on where they lie; the rest meets its verdict by key.
    text_hash, hit, key_id, key_hash = unused(docs, "text_hash", "hit", "key_id", "key_hash")
    own = docs.withColumn(text_hash, F.xxhash64(text_col))
    number = F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)), F.col(id_col).isNull(), F.col(text_hash))
    special = judged.where("NOT stays OR times > 1").select(row_key("doc_id", "text_hash").alias("key"))
    own = perhaps_in(own, number, special, hit)
    kept = judged.where("stays").select(F.col("doc_id").alias(key_id), F.col("text_hash").alias(key_hash))
    met = own.where(F.col(hit)).join(
        kept, F.col(id_col).eqNullSafe(F.col(key_id)) & (F.col(text_hash) == F.col(key_hash)), "left_semi")
    return own.where(~F.col(hit)).select(*docs.columns).unionAll(
        met.dropDuplicates([id_col, text_hash]).select(*docs.columns))
