"""Secret scans over a ledger of content-addressed texts, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trigflow.llm.columns import unused
from trigflow.session import scratch_path

#: Kinds in the order in which ties are listed, pattern, group to measure, least characters.
BASE_RULES = [
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|"""
     r"""[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
#: Rules of our own: spans beside the base ones.
MORE_RULES = [
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("ghp", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("basic", r"://[A-Za-z0-9_.-]+:[^\x00-\x20@/:]+@[A-Za-z0-9.-]+", 0, 1),
]
RULES = BASE_RULES + MORE_RULES
RULE_VERSION = 1
SPAN = "struct<start:int,kind:int,stop:int,first:int,after:int>"
NO_SPANS = f"array<{SPAN}>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(values: Column, kind: str, op: Callable[[Column, Column], Column]) -> Column:
    """For an array of numbers, what ``op`` makes of each and all before it, starting at 0.

    An array that grows inside a fold is copied at each step; blocks of about the square root of
    the length keep that to n to the power of 1.5.
    """
    zero = F.lit(0).cast(kind)

    def folded(part: Column, start: Column) -> Column:
        empty = F.array().cast(f"array<{kind}>")
        step = lambda s, x: F.struct(op(s["at"], x).alias("at"), F.concat(s["out"], F.array(op(s["at"], x))).alias("out"))
        return F.aggregate(part, F.struct(start.alias("at"), empty.alias("out")), step, lambda s: s["out"])

    def whole(x: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(x))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / width).cast("int") - 1),
                             lambda b: F.slice(x, b * width + 1, width))
        return _let(blocks, lambda bs: _let(
            F.concat(F.array(zero), folded(F.transform(bs, lambda b: F.aggregate(b, zero, op)), zero)),
            lambda starts: F.flatten(F.transform(bs, lambda b, i: folded(b, F.get(starts, i))))))

    return F.when(F.size(values) == 0, F.array().cast(f"array<{kind}>")).otherwise(_let(values, whole))


def _spans(text: Column, number: int, pattern: str, group: int, least: int) -> Column:
    """Spans of one rule, in code points and in UTF-8 bytes: running sums of the lengths of matches and pieces between."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits

    def placed(parts: Column) -> Column:
        def ends(size: Callable[[Column], Column]) -> Column:
            return _running(F.transform(parts["hits"], lambda h, i: size(h) + size(F.get(parts["gaps"], i))), "int",
                            lambda x, y: x + y)

        def span(at: Column) -> Column:
            h = F.get(parts["hits"], at)
            stop, after = F.get(parts["stops"], at), F.get(parts["afters"], at)
            return F.struct((stop - F.length(h)).alias("start"), F.lit(number).alias("kind"), stop.alias("stop"),
                            (after - F.octet_length(h)).alias("first"), after.alias("after"))

        with_ends = F.struct(parts["hits"].alias("hits"), parts["long"].alias("long"), ends(F.length).alias("stops"),
                             ends(F.octet_length).alias("afters"))

        def all_spans(p: Column) -> Column:
            nonlocal parts
            parts = p
            good = F.filter(F.sequence(F.lit(0), F.size(p["hits"]) - 1), lambda i: F.get(p["long"], i))
            return F.transform(good, span)

        return _let(with_ends, all_spans)

    found = _let(F.struct(hits.alias("hits"), F.split(text, pattern, -1).alias("gaps"),
                          F.transform(measured, lambda m: F.length(m) >= least).alias("long")), placed)
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(F.array()).cast(NO_SPANS)


def versions(table: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """Every (path, version) row with the address of its content; NULL content is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return table.select(F.col(path_col).alias("path"), text.alias("content"), F.sha2(text, 256).alias("blob"))


def scan(history: DataFrame, ledger: DataFrame | None = None, rules: list | None = None,
         version: int = RULE_VERSION) -> DataFrame:
    """Ledger entries (blob, version, spans) of contents that ``ledger`` has no entry for.

    ``history`` is the result of :func:`versions`; each content is scanned once, at its
    smallest path. Content without findings gets an entry with an empty array, so it is
    never scanned again. An empty history gives no entries.
    """
    # Addresses are shuffled to choose the copy that is scanned, then the texts meet the choice.
    chosen = history.groupBy("blob").agg(F.min(F.struct(F.col("path").isNull().alias("none"), "path")).alias("_at"))
    chosen = chosen.select("blob", F.col("_at.path").alias("path"))
    if ledger is not None:
        chosen = chosen.join(ledger.where(F.col("version") == version).select("blob").distinct(), "blob", "left_anti")
    spans = F.array_sort(F.flatten(F.array(
        *[_spans(F.col("content"), n, p, g, m) for n, (_, p, g, m) in enumerate(rules or RULES)])))
    todo = history.join(chosen.withColumnsRenamed({"path": "_path", "blob": "_blob"}),
                      (F.col("blob") == F.col("_blob")) & F.col("path").eqNullSafe(F.col("_path")), "left_semi")
    return todo.select("blob", F.lit(version).alias("version"), spans.alias("spans")).dropDuplicates(["blob"])


def updated_ledger(history: DataFrame, ledger: DataFrame | None = None, version: int = RULE_VERSION) -> DataFrame:
    """``ledger`` and the entries of contents it does not know, which are written to the shared folder and read again.

    Without a ledger an empty one is assumed, so a first run scans every content.
    """
    spark = history.sparkSession
    if ledger is None:
        ledger = spark.sql(f"SELECT CAST(NULL AS STRING) AS blob, 0 AS version, CAST(NULL AS {NO_SPANS}) AS spans WHERE false")
    path = scratch_path(spark, "ledger")
    scan(history, ledger, version=version).write.parquet(path)
    return ledger.select("blob", "version", "spans").unionAll(spark.read.parquet(path))


def findings(history: DataFrame, ledger: DataFrame, version: int = RULE_VERSION) -> DataFrame:
    """Every path with the spans of its content: (path, blob, spans), one row per history row."""
    entries = ledger.where((F.col("version") == version) & (F.size("spans") > 0)).select("blob", "spans")
    return history.select("path", "blob").join(entries, "blob", "left").select(
        "path", "blob", F.coalesce("spans", F.array().cast(NO_SPANS)).alias("spans"))


def span_text(spans: Column, rules: list | None = None) -> Column:
    kinds = F.array(*[F.lit(r[0]) for r in rules or RULES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with every span, overlaps joined, replaced by ``mask``; NULL stays NULL.

    Pieces between spans are cut from the bytes, where a place is found at once, and joined.
    """
    def masked(p: Column) -> Column:
        # bytes before this are gone or kept already: the furthest end of the spans before
        past = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(p["reach"], i - 1))
        first = F.filter(F.sequence(F.lit(0), F.size(p["spans"]) - 1), lambda i: F.get(p["spans"], i)["first"] >= past(i))
        piece = lambda at, stop: F.decode(F.substring(p["data"], at + 1, stop - at), "UTF-8")
        kept = F.transform(first, lambda i: piece(past(i), F.get(p["spans"], i)["first"]))
        return F.array_join(F.concat(kept, F.array(piece(F.get(p["reach"], F.size(p["spans"]) - 1), F.octet_length(p["data"])))), mask)

    reach = _running(F.transform(spans, lambda x: x["after"]), "int", lambda x, y: F.greatest(x, y))
    parts = F.struct(F.encode(text, "UTF-8").alias("data"), spans.alias("spans"), reach.alias("reach"))
    return F.when(F.size(spans) > 0, _let(parts, masked)).otherwise(text)


def redact_all(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None) -> DataFrame:
    """``docs`` with every secret of ``text_col`` masked; other columns stay, but n_chars follows the text.

    Entries are written as a ledger to the shared folder and read again; ``ledger`` holds those of
    earlier scans, whose contents are not scanned again. NULL and empty texts stay as they are,
    repeated rows all stay, an empty table stays empty, and columns may have any name.
    """
    entries = updated_ledger(versions(docs, id_col, text_col), ledger)
    blob, spans, own = unused(docs, "blob", "spans", "own")
    found = entries.where((F.col("version") == RULE_VERSION) & (F.size("spans") > 0)).select(
        F.col("blob").alias(blob), F.col("spans").alias(spans))
    joined = docs.withColumn(own, F.sha2(F.col(text_col), 256)).join(found, F.col(own) == F.col(blob), "left")
    text = F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(redact(F.col(text_col), F.col(spans)))
    out = joined.withColumn(text_col, text)
    if "n_chars" in docs.columns:
        n = F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length(text_col))
        out = out.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all ``documents``, each content scanned once into a ledger."""
    history = versions(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] < len(BASE_RULES))
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return findings(history, updated_ledger(history)).select(
        F.col("path").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"),
        count(2).alias("n_hex"), F.sha2(span_text(base), 256).alias("base_sha256"), span_text(spans).alias("spans"))


def _sql_rule(number: int, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, {number} AS kind, sum(length(hit)) OVER w - length(hit) + sum(length(gap)) OVER w AS start,
  sum(length(hit)) OVER w + sum(length(gap)) OVER w AS stop, length(measured) >= {least} AS good
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{quoted}', 0)) AS hit,
        unnest(regexp_extract_all(text, '{quoted}', {group})) AS measured,
        unnest(regexp_split_to_array(text, '{quoted}')[:-2]) AS gap,
        generate_subscripts(regexp_extract_all(text, '{quoted}', 0), 1) AS i
      FROM t WHERE regexp_matches(text, '{quoted}'))
WINDOW w AS (PARTITION BY doc_id ORDER BY i)"""


ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(_sql_rule(n, p, g, m) for n, (_, p, g, m) in enumerate(RULES))}),
k AS (SELECT *, ['{"', '".join(r[0] for r in RULES)}'][kind + 1] || ':' || start || ':' || stop AS said FROM f WHERE good),
s AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
        count(*) FILTER (kind = 2) AS n_hex,
        coalesce(string_agg(said, ',' ORDER BY start, kind) FILTER (kind < {len(BASE_RULES)}), '') AS base,
        string_agg(said, ',' ORDER BY start, kind) AS spans FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN s USING (doc_id)
"""
