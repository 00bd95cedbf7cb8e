"""WARC archives: written through Spark's text sink, read back whole, assembled into one nested row for each capture."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.storage import materialise, new_path, release

CRLF = "\r\n"
#: What ends every record; the text sink puts it after each row.
RECORD_END = CRLF + CRLF
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = (
    "record_id string, type string, target_uri string, concurrent_to string, refers_to string, stated_digest string, "
    "http_head string, fields map<string,string>, payload_bytes long, payload_digest string, payload binary"
)


def _id(kind: str, key: Column) -> Column:
    h = F.md5(F.concat(F.lit(f"{kind}:"), key))
    dashed = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">"))


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """A record as one string, without its end. Headers that are null are left out."""
    lines = [F.coalesce(F.concat(F.lit(f"{k}: "), v if isinstance(v, Column) else F.lit(v), F.lit(CRLF)), F.lit("")) for k, v in headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF))
    return F.concat(F.lit("WARC/1.1" + CRLF), *lines, length, block)


def _clean_uri(c: Column) -> Column:
    """No line ends or blanks in a header."""
    return F.regexp_replace(F.regexp_replace(c, "[\\r\\n]", "%0A"), "\\s", "%20")


def duplicate_payloads(rows: DataFrame, least_bytes: int) -> DataFrame:
    """(digest, original): of the payloads of least_bytes and more that stand on several rows, page_id and key of the row with the smallest id."""
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "key")))
    long = rows.select("digest", "page_id", "key", "payload_bytes").where(F.col("payload_bytes") >= least_bytes)
    return long.groupBy("digest").agg(first.alias("original"), F.count("*").alias("copies")).where("copies > 1").select("digest", "original")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 100, every_row: bool = True) -> str:
    """Writes a request, a response or revisit, and a metadata record for every row, as gzip WARC 1.1 files under path.

    The request and the metadata record name the response or revisit in WARC-Concurrent-To. Of rows with equal payloads of
    least_bytes and more, the one with the smallest id is a response with the payload and the others are revisits that refer
    to it and carry the digest alone; all other rows are responses, also those that repeat that id or have none. A null payload
    is empty; null ids and urls are allowed. Record ids are made of id, url, digest and the row's number, so rows that share an
    id stay apart; without every_row, rows alike in id, url and payload share their record ids. The numbers are materialised.
    Files are written by Spark's committer, so a lost executor leaves none half done.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    base = base.withColumns({"digest": F.sha2(F.col("payload").cast("binary"), 256), "payload_bytes": F.octet_length("payload"), "number": F.monotonically_increasing_id()})
    numbered = F.lit(every_row) | F.col("page_id").isNull()
    key = F.to_json(F.struct("page_id", "url", "digest", F.when(numbered, F.col("number")).alias("number")))
    base = materialise(base.withColumn("key", F.md5(key)).drop("number"), "warc-rows")
    rows = base.join(duplicate_payloads(base, least_bytes), "digest", "left")
    revisit = F.coalesce(F.col("original.page_id") != F.col("page_id"), F.lit(False))
    main = _id("response", F.col("key"))
    uri = _clean_uri(F.col("url"))
    stamp = ("WARC-Date", "2024-01-01T00:00:00Z")
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    head = F.lit(CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "", ""]))
    http = ("Content-Type", "application/http; msgtype=response")
    response = _record([("WARC-Type", "response"), ("WARC-Record-ID", main), stamp, ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest), http], F.concat(head, "payload"))
    again = _record(
        [
            ("WARC-Type", "revisit"), ("WARC-Record-ID", main), stamp, ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest),
            ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _id("response", F.col("original.key"))), http,
        ],
        head,
    )
    ask = F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1" + CRLF + CRLF))
    request = _record(
        [("WARC-Type", "request"), ("WARC-Record-ID", _id("request", F.col("key"))), stamp, ("WARC-Target-URI", uri), ("WARC-Concurrent-To", main), ("Content-Type", "application/http; msgtype=request")],
        ask,
    )
    about = F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF))
    metadata = _record(
        [("WARC-Type", "metadata"), ("WARC-Record-ID", _id("metadata", F.col("key"))), stamp, ("WARC-Target-URI", uri), ("WARC-Concurrent-To", main), ("Content-Type", "application/warc-fields")],
        about,
    )
    # The three records of a row stay one string, so that no row is copied three times; each but the last gets its end here.
    whole = F.concat(request, F.lit(RECORD_END), F.when(revisit, again).otherwise(response), F.lit(RECORD_END), metadata)
    rows.select(whole.alias("value")).write.option("lineSep", RECORD_END).option("compression", "gzip").text(path)
    release(base)
    return path


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of every record, by Content-Length; bytes between records are skipped."""
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split(CRLF)[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = end + 4
        at = start + int(headers.get("content-length", "0"))
        yield headers, data[start:at]


def unpack(data: bytes) -> bytes:
    """A file of one or more gzip members, or plain."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data.lstrip(b"\x00")
    return b"".join(out)


def _reader(with_payload: bool):
    def rows(data: bytes) -> Iterator[tuple]:
        for headers, block in parse_records(unpack(data)):
            kind = headers.get("warc-type")
            head, payload, fields = None, b"", None
            if kind in ("response", "request", "revisit"):
                raw, _, payload = block.partition(b"\r\n\r\n")
                head = raw.decode("utf-8", "replace")
            elif kind == "metadata":
                fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split(CRLF) if x)]
            body = kind in ("response", "revisit")
            yield (
                headers.get("warc-record-id"), kind, headers.get("warc-target-uri"), headers.get("warc-concurrent-to"), headers.get("warc-refers-to"),
                (headers.get("warc-payload-digest") or "").removeprefix("sha256:") or None, head, fields,
                len(payload) if body else None, hashlib.sha256(payload).hexdigest() if body else None, payload if body and with_payload else None,
            )

    schema = pa.schema(
        [(k, pa.string()) for k in ("record_id", "type", "target_uri", "concurrent_to", "refers_to", "stated_digest", "http_head")]
        + [("fields", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held, weight = [], 0
                for row in rows(content.as_py()):
                    held.append(row)
                    weight += 500 + len(row[-1] or b"")
                    if weight > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                        held, weight = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    return run


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every record of the archives under path, payload measured and hashed as read. Files are read whole, one at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_reader(with_payload), RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: its response or revisit, requests and metadata, joined through WARC-Concurrent-To.

    A capture is a record id that a response or revisit bears or others are concurrent to. Records that repeat an id are one.
    """
    capture = F.coalesce("concurrent_to", "record_id")
    main = F.col("type").isin("response", "revisit")
    nested = F.struct("record_id", "type", "target_uri", "refers_to", "stated_digest", "http_head", "payload_bytes", "payload_digest", "payload")
    return (
        records.withColumn("capture", capture)
        .groupBy("capture")
        .agg(
            F.first(F.when(main, nested), ignorenulls=True).alias("response"),
            F.collect_set(F.when(F.col("type") == "request", F.struct("record_id", "target_uri", "http_head"))).alias("requests"),
            F.first(F.when(F.col("type") == "metadata", F.struct("record_id", "fields")), ignorenulls=True).alias("metadata"),
        )
    )


def resolve(captures: DataFrame) -> DataFrame:
    """Captures with page_id, and for revisits what they refer to: the response's page_id, payload size and digest.

    A revisit is checked against the digest that it states. Where several captures have no page id they stay apart.
    """
    flat = captures.select("capture", F.expr("try_cast(metadata.fields['pageId'] as bigint)").alias("page_id"), "response", "requests", "metadata")
    originals = flat.where("response.type = 'response'").select(
        F.col("capture").alias("original"), F.col("page_id").alias("original_page"), F.col("response.payload_bytes").alias("original_bytes"), F.col("response.payload_digest").alias("original_digest")
    )
    # Captures that refer to nothing get a key of their own: nulls would all be dealt to one task.
    keyed = flat.withColumn("wanted", F.coalesce("response.refers_to", F.concat(F.lit("nothing:"), F.col("capture"))))
    return keyed.join(originals, F.col("wanted") == F.col("original"), "left").drop("wanted")


def write_and_read(pages: DataFrame, path: str | None = None, every_row: bool = True) -> DataFrame:
    """Archives of pages, written and read back: page_id, payload_bytes, payload_digest, record_type, refers_to, requests.

    With every_row there is one row for each of pages; without it, rows alike in page_id, url and html are one capture (rows
    without page_id are not). Empty tables give no row.
    """
    spark = pages.sparkSession
    path = write_archives(pages, path or f"{new_path(spark, 'warc')}", every_row=every_row)
    back = resolve(assemble(read_records(spark, path, with_payload=False)))
    revisit = F.col("response.type") == "revisit"
    return back.select(
        "page_id",
        F.when(revisit, F.col("original_bytes")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.when(F.col("original_digest") == F.col("response.stated_digest"), F.col("original_digest"))).otherwise(F.col("response.payload_digest")).alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.when(revisit, F.col("original_page")).alias("refers_to"),
        F.size("requests").cast("long").alias("n_requests"),
    )
