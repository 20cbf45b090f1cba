"""WARC archives with revisit records, and a two-level capture index over them.

Archives are written by Spark's own text sink, whose line separator is the two line ends that
close a WARC record, so a lost executor's files are never half committed and any store works.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trigflow.session import cut_lineage, scratch_path

END = "\r\n\r\n"
#: Responses named by revisits are broadcast up to this many rows, and joined by a shuffle beyond it.
BROADCAST_RESPONSES = 100_000
RECORDS_PER_FILE = 5_000
LINES_PER_BLOCK = 3_000
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2020-01-01T00:00:00Z"
CAPTURE = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
           "file string, position long, length long")
BLOCK = "part int, block int, first_key string, last_key string, n int, data binary"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: each five hexadecimal digits are four characters."""
    digest, table = F.sha1(payload), F.lit(BASE32)
    out = []
    for i in range(8):
        value = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substr(table, F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def with_roles(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
               payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to) of each page.

    Of pages with equal payloads of ``min_bytes`` or more, those with the largest id are
    responses and have a NULL ``refers_to``; the others revisit it. A NULL payload is empty.
    A NULL id is smaller than any other and a response only among NULL ids.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"),
                        F.octet_length(payload).cast("long").alias("payload_bytes"),
                        base32_sha1(payload).alias("payload_digest"))
    shared = (rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
              .agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n"))
    shared = cut_lineage(shared)
    few = shared.limit(BROADCAST_RESPONSES + 1).count() <= BROADCAST_RESPONSES
    revisits = (F.col("payload_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("response"))
    return rows.join(F.broadcast(shared) if few else shared, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisits, F.col("response")).alias("refers_to"))


def record(page_id: Column, url: Column, payload: Column, size: Column, digest: Column, refers_to: Column) -> Column:
    """A WARC/1.1 record without its closing line ends."""
    new = refers_to.isNull()
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    address = F.regexp_replace(url, r"[\x00-\x20\x7f]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    size.cast("string"), F.lit(END))
    block = F.when(new, F.concat(http, payload)).otherwise(http)
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), F.when(new, F.lit("WARC-Type: response")).otherwise("WARC-Type: revisit"),
        F.concat(F.lit("WARC-Record-ID: "), name(page_id)), F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), address),
        F.when(~new, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(~new, F.concat(F.lit("WARC-Refers-To: "), name(refers_to))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(head, F.lit(END), block)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, **columns: str) -> None:
    """One record per row of ``pages`` into archives below ``folder``; an empty table writes none."""
    rows = with_roles(pages, min_bytes, **columns)
    cols = [F.col(c) for c in ("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")]
    (rows.select(record(*cols).alias("value")).write.option("lineSep", END)
     .option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder))


def parse(content: bytes) -> Iterator[tuple]:
    """Records of one archive: (page, url, type, refers, bytes, digest, position, length)."""
    at = 0
    while at < len(content):
        cut = content.index(b"\r\n\r\n", at)
        fields = dict(x.split(": ", 1) for x in content[at:cut].decode().split("\r\n")[1:])
        start, size = cut + 4, int(fields["Content-Length"])
        body = content.index(b"\r\n\r\n", start) + 4
        stop = start + size
        length = int(re.search(rb"Content-Length: (\d+)", content[start:body])[1])
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        kind = fields["WARC-Type"]
        if kind == "response":
            payload = content[body:stop]
            if len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"damaged record at byte {at}")
        page = re.fullmatch(r"<urn:x-page:(.*)>", fields["WARC-Record-ID"])[1]
        refers = re.fullmatch(r"<urn:x-page:(.*)>", fields.get("WARC-Refers-To", "<urn:x-page:none>"))[1]
        number = lambda x: None if x == "none" else int(x)
        yield (number(page), fields.get("WARC-Target-URI"), kind, number(refers), length, digest, at, stop - at)
        at = stop + 4


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Captures in all archives below ``folder``: every record parsed, payloads checked against their digests."""
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(),
             pa.int64()]
    names = [x.split()[0] for x in CAPTURE.split(", ")]

    def captures(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows = [(*r[:6], path.as_py(), *r[6:]) for r in parse(content.as_py())]
                columns = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("path", "content").mapInArrow(captures, CAPTURE)


def index_key(url: Column) -> Column:
    """Reversed host, closing bracket, rest: ``org,example,www)/a``; NULL is the empty key."""
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    tail = F.regexp_extract(rest, r"^[^/?#]*(?s:(.*))$", 1)
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), ","), F.lit(")"), tail), F.lit(""))


def write_index(captures: DataFrame, folder: str, parts: int | None = None) -> None:
    """Sorted captures in compressed blocks below ``folder/blocks``, their sparse directory in ``folder/directory``.

    The order is (key, page, file, position), so one host may span any number of partitions.
    """
    spark = captures.sparkSession
    rows = captures.withColumn("key", index_key(F.col("url")))
    order = ["key", "page_id", "file", "position"]
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = ["key", *captures.columns]

    def blocks(batches):
        part, number, lines = TaskContext.get().partitionId(), 0, []

        def block(lines):
            keys = [x.split("\t", 1)[0] for x in (lines[0], lines[-1])]
            data = zlib.compress("\n".join(lines).encode())
            return pa.RecordBatch.from_pylist([{"part": part, "block": number, "first_key": keys[0], "last_key": keys[1],
                                                "n": len(lines), "data": data}], schema=schema)

        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_key", pa.string()),
                            ("last_key", pa.string()), ("n", pa.int32()), ("data", pa.binary())])
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                lines.append("\t".join("" if v is None else re.sub(r"[\t\r\n]", " ", str(v)) for v in row))
                if len(lines) == LINES_PER_BLOCK:
                    yield block(lines)
                    number, lines = number + 1, []
        if lines:
            yield block(lines)

    (rows.select(*names).repartitionByRange(parts, *order).sortWithinPartitions(*order)
     .mapInArrow(blocks, BLOCK).write.parquet(f"{folder}/blocks"))
    spark.read.schema(BLOCK).parquet(f"{folder}/blocks").drop("data").write.parquet(f"{folder}/directory")


def _lines(data: bytes) -> list[str]:
    return zlib.decompress(data).decode().split("\n")


def _captured(lines: list[str]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [(x.split()[0], kinds[x.split()[1]]) for x in CAPTURE.split(", ")]
    columns = list(zip(*(x.split("\t")[1:] for x in lines))) or [()] * len(fields)
    arrays = [pa.array([None if v == "" else int(v) if k == pa.int64() else v for v in c], k)
              for c, (_, k) in zip(columns, fields)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """All captures of the index, block by block."""
    def decode(batches):
        for batch in batches:
            for data in batch.column(0):
                yield _captured(_lines(data.as_py()))

    return spark.read.schema(BLOCK).parquet(f"{folder}/blocks").select("data").mapInArrow(decode, CAPTURE)


def lookup(spark: SparkSession, folder: str, urls: list[str]) -> list[tuple[str, int, str, bytes]]:
    """(url, page, type, record bytes) of the captures of a bounded list of URLs.

    The directory names the few blocks that may hold a key; a binary search inside each block
    finds its lines, and only the bytes of the records found are read from the archives.
    """
    if not urls:
        return []
    asked = spark.createDataFrame([(u,) for u in urls], "asked string")
    keys = sorted({r[0] for r in asked.select(index_key(F.col("asked"))).collect()})

    def wanted(batches):
        for batch in batches:
            first, last = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = [bisect.bisect_left(keys, a) < bisect.bisect_right(keys, b) for a, b in zip(first, last)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    directory = spark.read.schema(BLOCK).parquet(f"{folder}/directory").select("part", "block", "first_key", "last_key")
    chosen = directory.mapInArrow(wanted, "part int, block int, first_key string, last_key string").collect()
    blocks = spark.read.schema(BLOCK).parquet(f"{folder}/blocks")
    out, hadoop = [], spark.sparkContext._jvm.org.apache.hadoop.fs
    for entry in chosen:
        data = blocks.where((F.col("part") == entry.part) & (F.col("block") == entry.block)).first()["data"]
        lines = _lines(bytes(data))
        heads = [x.split("\t", 1)[0] for x in lines]
        for key in keys:
            for row in _captured(lines[bisect.bisect_left(heads, key):bisect.bisect_right(heads, key)]).to_pylist():
                path = hadoop.Path(row["file"])
                stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
                stream.seek(row["position"])
                content = bytes(stream.readNBytes(row["length"]))
                stream.close()
                out.append((row["url"], row["page_id"], row["record_type"], content))
    return out


def archive(pages: DataFrame, folder: str, min_bytes: int = 0, **columns: str) -> DataFrame:
    """Writes archives and index below ``folder``, reads both back, returns the captures: one row per page."""
    spark = pages.sparkSession
    write_archives(pages, f"{folder}/archives", min_bytes, **columns)
    write_index(cut_lineage(read_archives(spark, f"{folder}/archives")), f"{folder}/index")
    return read_index(spark, f"{folder}/index")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` written as archives and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return archive(pages, scratch_path(spark, "warc")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS h FROM p),
m AS (SELECT h, max(page_id) AS response FROM d GROUP BY h)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: '{BASE32}'[1 + ((
    (('0x' || h[1 + 5 * (i // 4) : 5 + 5 * (i // 4)])::INT >> (15 - 5 * (i % 4))::INT) & 31))::INT]), 'string_agg', '')
    AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = response THEN NULL ELSE response END AS refers_to
FROM d JOIN m USING (h)
"""
