"""Shards of near-equal bytes as leaves of a k-d tree over document metadata, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trigflow.operators.running import row_rank
from trigflow.session import scratch_path

SHARDS = 16
#: Cells of one pass over all nodes of a level, and of a node at least.
CELLS, LEAST_CELLS = 1 << 16, 16
#: Coordinates are cut to this size, so differences stay within a long.
LIMIT = (1 << 61) - 1
#: Rows that one input partition numbers on its own: the low bits of the row number.
PART_BITS = 33


def text_code(column: Column) -> Column:
    """The first six UTF-8 bytes of a string as a number of the same order; NULL before all."""
    return F.coalesce(F.conv(F.rpad(F.substring(F.hex(column.cast("string")), 1, 12), 12, "0"), 16, 10).cast("long"), F.lit(-1))


def number_code(column: Column) -> Column:
    """A number as a long within LIMIT; NULL before all."""
    whole = F.floor(F.least(F.greatest(column.cast("double"), F.lit(-float(LIMIT))), F.lit(float(LIMIT))))
    exact = column.try_cast("long")
    return F.coalesce(F.least(F.greatest(F.coalesce(exact, whole.cast("long")), F.lit(-LIMIT)), F.lit(LIMIT)), F.lit(-LIMIT - 1))


def tie_code(doc_id: Column, text: Column) -> Column:
    """60 bits of a digest of id and text: the order of rows with equal coordinates."""
    said = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(text))
    return F.conv(F.substring(F.md5(said), 1, 15), 16, 10).cast("long")


def _values(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A table of a few numbers, one row per tree node, as literals."""
    said = ", ".join("(" + ", ".join(f"CAST({v} AS BIGINT)" for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {said} AS t({', '.join(columns)})")


def _coordinate(k: int) -> Column:
    """The coordinate of a row along its node's dimension."""
    out = F.col("c0")
    for i in range(1, k):
        out = F.when(F.col("dim") == i, F.col(f"c{i}")).otherwise(out)
    return out


def _medians(rows: DataFrame, nodes: dict[int, dict], k: int) -> None:
    """Finds the row at which each node is cut, by narrowing histograms of weight over all nodes at once.

    Rows are ordered by coordinate, then digest, then row number. A pass adds up the weight of each
    cell; the cell that holds the wanted share is cut again until it holds one row. A row belongs to
    the left if the middle of its weight does, so the cut is the nearest possible.
    """
    spark = rows.sparkSession
    for s in nodes.values():
        s.update(phase=0, c=0, t=0, before=0, at=None)
    while open_nodes := {n: s for n, s in nodes.items() if s["at"] is None}:
        cells = max(LEAST_CELLS, CELLS // len(open_nodes))
        for s in open_nodes.values():
            s["step"] = -(-(s["hi"] - s["lo"] + 1) // cells)
        names = ["dim", "phase", "c", "t", "lo", "hi", "step", "before", "weight", "left", "leaves"]
        state = _values(spark, ["node", *names], [(n, *(s[x] for x in names)) for n, s in open_nodes.items()])
        x, phase = _coordinate(k), F.col("phase")
        v = F.when(phase == 0, x).when(phase == 1, F.col("tie")).otherwise(F.col("rid"))
        held = ((phase == 0) | (x == F.col("c"))) & ((phase < 2) | (F.col("tie") == F.col("t")))
        cell = F.expr("(v - lo) div step").alias("cell")
        sums = (rows.join(F.broadcast(state), "node").where(held).withColumn("v", v).where("v between lo and hi")
                .groupBy("node", "weight", "left", "leaves", "before", cell)
                .agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.min("v").alias("v0"), F.max("v").alias("v1")))
        upto = F.expr("before + sum(w) OVER (PARTITION BY node ORDER BY cell ROWS UNBOUNDED PRECEDING)")
        first = F.min_by(F.struct("cell", "w", "n", "v0", "v1", "upto"), "cell").alias("hit")
        found = (sums.withColumn("upto", upto)
                 .where("CAST(upto AS DECIMAL(38,0)) * leaves > CAST(weight AS DECIMAL(38,0)) * left")
                 .groupBy("node").agg(first).select("node", "hit.*").collect())  # one row per open node
        for r in found:
            s = nodes[r["node"]]
            s["before"] = r["upto"] - r["w"]
            s["lo"], s["hi"] = r["v0"], r["v1"]
            if r["n"] == 1:
                s["at"] = r["v0"]
                s["goes_left"] = int((2 * s["before"] + r["w"]) * s["leaves"] <= 2 * s["weight"] * s["left"])
            elif r["v0"] == r["v1"]:  # several rows at one coordinate: go on along the next key
                s["c" if s["phase"] == 0 else "t"] = r["v0"]
                s["phase"] += 1
                s["lo"], s["hi"] = (0, 1 << 60) if s["phase"] == 1 else (0, 1 << 62)


def _split(rows: DataFrame, nodes: dict[int, dict], k: int) -> DataFrame:
    """Rows with their node replaced by the child they belong to."""
    names = ["dim", "phase", "c", "t", "at", "goes_left", "left"]
    state = _values(rows.sparkSession, ["node", *names], [(n, *(s[x] for x in names)) for n, s in nodes.items()])
    at, flag, phase = F.col("at"), F.col("goes_left") == 1, F.col("phase")

    def before(value: Column, edge: Column, equal: Column) -> Column:
        return F.when(value < edge, True).when(value > edge, False).otherwise(equal)

    x = _coordinate(k)
    goes = (F.when(phase == 0, before(x, at, flag))
            .when(phase == 1, before(x, F.col("c"), before(F.col("tie"), at, flag)))
            .otherwise(before(x, F.col("c"), before(F.col("tie"), F.col("t"), before(F.col("rid"), at, flag)))))
    moved = F.when(F.col("left").isNull() | goes, F.col("node")).otherwise(F.col("node") + F.col("left"))
    return rows.join(F.broadcast(state), "node", "left").select(*[c for c in rows.columns if c != "node"], moved.alias("node"))


def _kept(rows: DataFrame, name: str) -> DataFrame:
    spark = rows.sparkSession
    path = scratch_path(spark, name)
    rows.write.parquet(path)
    return spark.read.parquet(path)


def kd_shards(docs: DataFrame, dims: Mapping[str, Column], shards: int | None = None, target_bytes: int | None = None,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each row: the leaf of a k-d tree it lies in and its place there.

    A node with more than one leaf to give is cut along the dimension in which its rows spread
    widest (as a share of the spread of all rows; of equal ones the first named) at the weighted
    median, or at the share of its left leaves where their number is odd, until each leaf holds
    one share: 1 / ``shards`` of the bytes, or at most about ``target_bytes``. Leaves are numbered
    from left to right. ``dims`` names numeric columns as :func:`text_code` and :func:`number_code`
    make them.

    A row weighs its UTF-8 bytes and one more, a NULL text one. Each cut misses its share by half a
    row at most, so leaves differ by less than the two largest rows. Rows with equal coordinates
    follow a digest of id and text, so a hot value is cut like any other; identical rows follow the
    number that reading gave them. NULL coordinates come first. Slots are numbered from 0 in each
    shard. An empty table gives no rows. Further columns of ``docs`` play no part.
    """
    spark, k = docs.sparkSession, len(dims)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = _kept(docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"),
        tie_code(F.col(id_col), text).alias("tie"), *[c.alias(f"c{i}") for i, c in enumerate(dims.values())],
        F.lit(0).cast("long").alias("node")), "kd-rows")
    spread = [f for i in range(k) for f in (F.min(f"c{i}").alias(f"lo{i}"), F.max(f"c{i}").alias(f"hi{i}"))]
    whole = rows.agg(F.sum("size").alias("weight"), *spread).first()
    if whole["weight"] is None:
        leaves = {}
    else:
        leaves = {0: shards or max(1, -(-whole["weight"] // target_bytes))}
    width = [max(1, (whole[f"hi{i}"] or 0) - (whole[f"lo{i}"] or 0)) for i in range(k)]
    while any(n > 1 for n in leaves.values()):
        # One row per tree node of the level: never more than there are shards.
        stats = rows.groupBy("node").agg(F.sum("size").alias("weight"), *spread).collect()
        nodes = {}
        for r in stats:
            if leaves[r["node"]] > 1:
                dim = max(range(k), key=lambda i: ((r[f"hi{i}"] - r[f"lo{i}"]) / width[i], -i))
                nodes[r["node"]] = dict(dim=dim, lo=r[f"lo{dim}"], hi=r[f"hi{dim}"], weight=r["weight"],
                                        leaves=leaves[r["node"]], left=-(-leaves[r["node"]] // 2))
        if not nodes:
            break  # too few rows for the leaves that are left
        _medians(rows, nodes, k)
        rows = _kept(_split(rows, nodes, k), "kd-level")
        after = {n: c for n, c in leaves.items() if n not in nodes}
        for n, s in nodes.items():
            after[n], after[n + s["left"]] = s["left"], s["leaves"] - s["left"]
        seen = {r["node"] for r in rows.select("node").distinct().collect()}
        leaves = {n: c for n, c in after.items() if n in seen}
    ranked = row_rank(rows.select("doc_id", "size", "crc", "tie", "rid", "node"), ["node"], ["tie", "rid"],
                      F.shiftright("rid", PART_BITS), "place")
    return ranked.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.col("node").cast("int").alias("shard"),
                         (F.col("place") - 1).alias("slot"))


def document_dims() -> dict[str, Column]:
    """Metadata of ``documents``, in the order that decides between equal spreads."""
    return {"source": text_code(F.col("source")), "lang": text_code(F.col("lang")),
            "n_chars": number_code(F.col("n_chars")), "doc_id": number_code(F.col("doc_id"))}


def op12_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 16 shards of near-equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return kd_shards(docs, document_dims(), SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _sql_levels() -> str:
    """The levels of the tree, each by a window over its nodes. One leaf count per level, as 16 is a power of two."""
    out, dims = [], ["source", "lang", "n_chars", "doc_id"]
    for level, leaves in enumerate((16, 8, 4, 2)):
        spread = ", ".join(f"max(c{i}) OVER w - min(c{i}) OVER w AS s{i}" for i in range(len(dims)))
        shares = [f"s{i} / (SELECT greatest(1, max(c{i}) - min(c{i})) FROM t0)" for i in range(len(dims))]
        widest = " ".join(f"WHEN {s} = greatest({', '.join(shares)}) THEN c{i}" for i, s in enumerate(shares))
        out.append(f"""s{level} AS (SELECT *, {spread}, sum(size) OVER w AS weight FROM t{level} WINDOW w AS (PARTITION BY node)),
x{level} AS (SELECT *, CASE {widest} END AS x FROM s{level}),
u{level} AS (SELECT *, sum(size) OVER (PARTITION BY node ORDER BY x, tie ROWS UNBOUNDED PRECEDING) AS upto FROM x{level}),
t{level + 1} AS (SELECT doc_id, size, crc_text, tie, c0, c1, c2, c3,
  node + CASE WHEN 2 * upto - size <= weight THEN 0 ELSE {leaves // 2} END AS node FROM u{level})""")
    return ",\n".join(out)


def _sql_code(column: str) -> str:
    return f"coalesce(CAST('0x' || rpad(substr(hex(CAST({column} AS VARCHAR)), 1, 12), 12, '0') AS BIGINT), -1)"


#: CRC-32 of UTF-8 bytes: a table by the rule of the polynomial, then one step a byte.
_SQL_CRC = """k AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, s: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
b AS (SELECT *, list_prepend(4294967295, list_transform(regexp_extract_all(hex(said), '..'),
    lambda h: CAST('0x' || h AS BIGINT))) AS bytes FROM d),"""

ORACLE_SQL = f"""
WITH d AS (SELECT *, coalesce(text, '') AS said FROM documents),
{_SQL_CRC}
t0 AS (SELECT doc_id, strlen(said) + 1 AS size,
    xor(list_reduce(bytes, lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS crc_text,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(said)), 1, 15) AS BIGINT) AS tie,
    {_sql_code('source')} AS c0, {_sql_code('lang')} AS c1, coalesce(n_chars, {-LIMIT - 1}) AS c2,
    coalesce(doc_id, {-LIMIT - 1}) AS c3, 0 AS node FROM b, k),
{_sql_levels()}
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc_text AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(node AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY node ORDER BY tie) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM t4
"""
