"""WARC archives: one record a row when written, one nested row a capture when read back.

A capture is written as three records that name each other by ``WARC-Concurrent-To``: the request, the response (or the revisit of an
equal payload that another response holds) and the metadata.  Records are lines of Spark's text writer, whose line ends are the two line
breaks that close a record, so archives are written in parallel, to any store, in files of bounded size.  A file is read
as a whole by one task, as compressed archives can only be read from their start; every record is found by its declared length.

Reading assembles transactions: requests and metadata are grouped by the record that they are concurrent to, whichever side names the
other, and joined to the responses and revisits.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm._arrow import bounded

#: Shorter payloads are always written.
LEAST = 1000
#: Records of one file: a thousand captures, so that a file fits a task many times over.
RECORDS = 3000
END = "\r\n"
CLOSE = END + END
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of blocks that one Arrow batch gathers before it goes on.
BATCH = 8_000_000

_SCHEMA = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("concurrent_to", T.ArrayType(T.StringType())),
        T.StructField("refers_to", T.StringType()),
        T.StructField("uri", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("http", T.StringType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("intact", T.BooleanType()),
    ]
)


def _id(*parts: Column) -> Column:
    """A record's identifier, by name: equal parts give equal identifiers."""
    h = F.sha2(F.concat_ws("\n", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts)).cast("binary"), 256)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), cut[0], F.lit("-"), cut[1], F.lit("-8"), cut[2], F.lit("-8"), cut[3], F.lit("-"), cut[4], F.lit(">"))


def _uri(url: Column) -> Column:
    """The URL, with what may not stand in a header line percent-encoded."""
    out = url
    for c in (" ", "\r", "\n", "\t", "<", ">"):
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return out


def _record(kind: str, rid: Column, date: str, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record without its closing line breaks; headers whose value is null are left out."""
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), rid), F.lit(f"WARC-Date: {date}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(END, *lines), F.lit(CLOSE), block)


def records(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Three rows ``(value)`` for each page ``(page_id, url, html)``: its request, its response or revisit, its metadata.

    Of pages with equal payloads of ``LEAST`` bytes or more, that with the largest id (null: least; of equal ids the
    largest URL) is written whole and the others revisit it.  Rows equal in id, URL and text are one capture, written as
    often as it comes.  A null text is an empty payload; a null URL or id is left out of the headers.
    """
    body = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", body.alias("body"), F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).cast("long").alias("size"))
    long = pages.select("page_id", "url", F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).alias("size")).where(F.col("size") >= LEAST)
    firsts = long.groupBy("digest").agg(F.max(F.struct(F.col("page_id").alias("page"), F.col("url").alias("at"))).alias("first"), F.count("*").alias("n")).where("n > 1")
    rows = rows.join(firsts.select(F.col("digest").alias("same"), "first"), (F.col("digest") == F.col("same")) & (F.col("size") >= LEAST), "left")
    own = F.col("same").isNull() | (F.col("page_id").eqNullSafe(F.col("first.page")) & F.col("url").eqNullSafe(F.col("first.at")))
    name = lambda kind, page, at: _id(F.lit(kind), page, at, F.col("digest"))
    rid, uri = name("response", F.col("page_id"), F.col("url")), _uri(F.col("url"))
    host, path = F.regexp_extract(uri, r"^[A-Za-z]+://([^/]*)", 1), F.regexp_extract(uri, r"^[A-Za-z]+://[^/]*(/.*)$", 1)
    asked = F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(path), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(CLOSE))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(CLOSE))
    payload = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    http = lambda kind: ("Content-Type", F.lit(f"application/http; msgtype={kind}"))
    target = ("WARC-Target-URI", uri)
    request = _record("request", name("request", F.col("page_id"), F.col("url")), date, [target, ("WARC-Concurrent-To", rid), http("request")], F.coalesce(asked, F.lit("GET / HTTP/1.1\r\n\r\n")))
    response = _record("response", rid, date, [target, payload, http("response")], F.concat(head, "body"))
    refers = ("WARC-Refers-To", name("response", F.col("first.page"), F.col("first.at")))
    revisit = _record("revisit", rid, date, [target, payload, refers, ("WARC-Refers-To-Target-URI", _uri(F.col("first.at"))), ("WARC-Profile", F.lit(PROFILE)), http("response")], head)
    fields = F.coalesce(F.concat(F.lit("page_id: "), F.col("page_id").cast("string"), F.lit(END)), F.lit(""))
    metadata = _record("metadata", name("metadata", F.col("page_id"), F.col("url")), date, [target, ("WARC-Concurrent-To", rid), ("Content-Type", F.lit("application/warc-fields"))], fields)
    return rows.select(F.explode(F.array(request, F.when(own, response).otherwise(revisit), metadata)).alias("value"))


def write(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", records_per_file: int = RECORDS, compression: str = "gzip") -> None:
    """Writes the pages as WARC archives into the new folder ``path``; ``compression``: ``gzip`` or ``none``.  An empty table gives no records."""
    out = records(pages, date).write.option("lineSep", CLOSE).option("compression", compression).option("maxRecordsPerFile", records_per_file)
    out.text(path)


def _inflated(data: bytes) -> bytes:
    """Plain bytes of an archive: of one gzip member, of one member a record, or as they stand."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data
        if not member.eof:
            raise ValueError("the archive ends inside a gzip member")
    return b"".join(out)


def _hex(value: str | None) -> str | None:
    """A labelled SHA-1 digest, base 32 or hex, as bare lowercase hex; another algorithm gives null."""
    kind, _, text = (value or "").partition(":")
    if kind.lower() != "sha1":
        return None
    return base64.b32decode(text.upper()).hex() if len(text) == 32 else text.lower()


def parse(data: bytes, file: str) -> Iterator[tuple]:
    """Records of one archive, in the order of ``_SCHEMA``.  What is no record is an error that names the file and the place."""
    at = 0
    while at < len(data):
        if data.startswith(b"\r\n", at):  # line breaks between records
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n") if end >= 0 else [""]
        fields: dict[str, list[str]] = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            fields.setdefault(name.strip().lower(), []).append(value.strip())
        get = lambda name: fields.get(name, [None])[0]  # noqa: B023, E731
        size = get("content-length") or ""
        start = end + 4
        if not lines[0].startswith("WARC/") or not size.isdigit() or start + int(size) > len(data):
            raise ValueError(f"no whole WARC record at byte {at} of {file}")
        block = data[start : start + int(size)]
        kind, mime = get("warc-type"), get("content-type") or ""
        http, payload = None, block
        if mime.startswith("application/http"):
            head, gap, payload = block.partition(b"\r\n\r\n")
            http = (head + gap).decode("utf-8", "replace")
        named = _hex(get("warc-payload-digest"))
        if kind == "revisit":
            sizes = [x.partition(":")[2].strip() for x in (http or "").split("\r\n") if x.lower().startswith("content-length:")]
            length, digest, intact = int(sizes[0]) if sizes and sizes[0].isdigit() else None, named, None
        else:
            length, digest = len(payload), hashlib.sha1(payload).hexdigest()
            intact = None if named is None else named == digest
        yield file, at, kind, get("warc-record-id"), fields.get("warc-concurrent-to", []), get("warc-refers-to"), get("warc-target-uri"), get("warc-date"), get("content-type"), http, payload, length, digest, intact
        at = start + int(size)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(_SCHEMA)

    def full(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows, held = [], 0
            for row in parse(_inflated(content.as_py()), file):
                rows.append(row)
                held += len(row[10])
                if held > BATCH or len(rows) == 1024:
                    yield full(rows)
                    rows, held = [], 0
            if rows:
                yield full(rows)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under ``path``, plain or compressed: one row a record, with its payload, length and SHA-1.

    A revisit has no payload: its length is that of the headers it repeats and its digest the declared one.  ``intact`` tells
    whether a declared digest is the payload's own (null: none declared).  Files that hold nothing give no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0")
    return bounded(files.select("path", "content")).mapInArrow(_parsed, _SCHEMA)


def captures(rows: DataFrame) -> DataFrame:
    """One nested row a capture: ``(capture, requests, metadata)`` for each response, revisit and resource of ``rows``.

    A request or metadata record belongs to a capture if either names the other as concurrent; equal records count once.  A capture's few
    records meet in its row.  Captures without them have empty arrays; a request whose capture is missing is left out.
    """
    main = F.col("type").isin("response", "revisit", "resource")
    what = F.struct(F.col("id"), F.col("http"), F.col("payload"))
    others = rows.where(F.col("type").isin("request", "metadata")).select("id", "type", "concurrent_to", what.alias("what"))
    named = others.select(F.explode("concurrent_to").alias("of"), "type", "what")
    naming = rows.where(main).select(F.col("id").alias("of"), F.explode("concurrent_to").alias("other"))
    links = named.unionByName(naming.join(others, F.col("other") == F.col("id")).select("of", "type", "what"))
    kinds = [F.collect_set(F.when(F.col("type") == kind, F.col("what"))).alias(name) for kind, name in (("request", "requests"), ("metadata", "metadata"))]
    tied = links.groupBy("of").agg(*kinds)
    whole = rows.where(main).select("id", F.struct(*(c for c in rows.columns if c != "concurrent_to")).alias("capture"))
    joined = whole.join(tied, F.col("id") == F.col("of"), "left")
    empty = F.array().cast(dict(tied.dtypes)["requests"])
    return joined.select("capture", *(F.coalesce(name, empty).alias(name) for name in ("requests", "metadata")))
