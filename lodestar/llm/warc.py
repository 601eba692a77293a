"""WARC archives of pages: writing, reading back, and putting transactions together.

Every page is three records: a response (or a revisit of one with the same
payload), its request and its metadata. The response names the others in
``WARC-Concurrent-To``; reading joins them again by those names. The records are
UTF-8 texts that end with two line ends, so Spark's text writer makes the archives,
one gzip file for ``records_per_file`` records.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import durable

RECORDS_PER_FILE = 30_000
_DATE = "2024-01-01T00:00:00Z"  # pages carry no time of capture
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
_END = b"\r\n\r\n"


def sha1_base32(text: Column) -> Column:
    """Upper-case base32 of the SHA-1: twenty bits make four digits."""
    hexed = F.sha1(text.cast("binary"))
    fours = [
        F.translate(F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0"), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
        for i in range(8)
    ]
    return F.concat(*fours)


def _urn(hexed: Column) -> Column:
    """A record name from 32 hexadecimal digits."""
    cut = [F.substring(hexed, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """One record without its end; headers that are NULL are left out."""
    lines = [F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value) for name, value in headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines, length), F.lit("\r\n\r\n"), block)


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write ``pages`` (``page_id``, ``url``, ``html``) as gzip WARC archives below ``path``.

    Of pages with equal payloads of ``least_bytes`` or more, the one with the
    largest page_id is a response and the others revisit it; rows that repeat that
    page_id and payload are all responses, and so are pages without page_id
    where no page of the group has one. A NULL html is an empty payload, a NULL url
    leaves the header out; control characters in a url are percent-encoded. Other
    columns are ignored.
    """
    taken = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    taken = taken.withColumns({"digest": sha1_base32(F.col("html")), "size": F.octet_length("html").cast("long")})
    # Sizes and digests only; the payloads themselves are moved once, to meet their group.
    kept = taken.groupBy("digest", "size").agg(F.max("page_id").alias("kept_id"))
    rows = taken.join(kept, ["digest", "size"])
    again = (F.col("size") >= least_bytes) & F.col("kept_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept_id"))
    rows = rows.withColumns({"again": again, "own": F.expr("md5(uuid())"), "request": _urn(F.expr("md5(uuid())")), "metadata": _urn(F.expr("md5(uuid())"))})
    first = _urn(F.md5(F.concat_ws("|", F.col("digest"), F.col("size").cast("string"))))
    single = (F.col("size") < least_bytes) | F.col("kept_id").isNull()
    rows = rows.withColumns({"first": first, "record": F.when(F.col("again") | single, _urn(F.col("own"))).otherwise(first)})
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    response = _record(
        [
            ("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")), ("WARC-Record-ID", F.col("record")), ("WARC-Date", _DATE),
            ("WARC-Target-URI", uri), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Concurrent-To", F.col("request")), ("WARC-Concurrent-To", F.col("metadata")),
            ("WARC-Refers-To", F.when(F.col("again"), F.col("first"))),
            ("WARC-Profile", F.when(F.col("again"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ("Content-Type", "application/http; msgtype=response"),
        ],
        F.concat(F.lit(_HTTP), F.col("size").cast("string"), F.lit("\r\n\r\n"), F.when(F.col("again"), "").otherwise(F.col("html"))),
    )
    request = _record(
        [("WARC-Type", "request"), ("WARC-Record-ID", F.col("request")), ("WARC-Date", _DATE), ("WARC-Target-URI", uri), ("Content-Type", "application/http; msgtype=request")],
        F.lit("GET / HTTP/1.1\r\n\r\n"),
    )
    metadata = _record(
        [("WARC-Type", "metadata"), ("WARC-Record-ID", F.col("metadata")), ("WARC-Date", _DATE), ("WARC-Target-URI", uri), ("Content-Type", "application/warc-fields")],
        F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n")),
    )
    records = rows.select(F.explode(F.array(request, response, metadata)).alias("value"))
    records.write.option("lineSep", _END.decode()).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


class _Stream:
    """Reads a gzip archive piece by piece."""

    def __init__(self, packed: bytes):
        self.packed, self.at, self.held = packed, 0, bytearray()
        self.opened = zlib.decompressobj(31)

    def _more(self) -> bool:
        if self.opened.eof and self.opened.unused_data:  # the next member
            rest, self.opened = self.opened.unused_data, zlib.decompressobj(31)
            self.held += self.opened.decompress(rest)
            return True
        piece = self.packed[self.at : self.at + (1 << 18)]
        self.at += len(piece)
        self.held += self.opened.decompress(piece) if piece else b""
        return bool(piece)

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (found := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                return None
        return self.take(found + len(mark))[: -len(mark)]

    def take(self, size: int) -> bytes:
        while len(self.held) < size:
            if not self._more():
                raise ValueError("a record is cut short")
        out = bytes(self.held[:size])
        del self.held[:size]
        return out


def records(packed: bytes):
    """(headers, block) of each record of a gzip archive; repeated headers are lists."""
    stream = _Stream(packed)
    while (head := stream.until(_END)) is not None:
        headers: dict[str, list[str]] = {}
        for line in head.decode().split("\r\n")[1:]:
            name, _, value = line.partition(": ")
            headers.setdefault(name.lower(), []).append(value)
        block = stream.take(int(headers["content-length"][0]))
        if stream.take(len(_END)) != _END:
            raise ValueError("a record has no end")
        yield headers, block


_READ = "type string, record string, uri string, concurrent array<string>, refers string, payload_bytes long, payload_digest string, payload string, fields string"


def _read(payloads: bool):
    def row(headers: dict[str, list[str]], block: bytes) -> tuple:
        kind, one = headers["warc-type"][0], lambda name: headers.get(name, [None])[0]
        size = digest = payload = fields = None
        if kind == "response":
            _, _, body = block.partition(_END)
            size, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
            if one("warc-payload-digest") != f"sha1:{digest}":
                raise ValueError(f"payload of {one('warc-record-id')} doesn't have its digest")
            payload = body.decode(errors="replace") if payloads else None
        elif kind == "revisit":
            head, _, _ = block.partition(_END)
            size, digest = int(head.rpartition(b": ")[2]), one("warc-payload-digest").removeprefix("sha1:")
        elif kind in ("request", "metadata"):
            fields = block.decode(errors="replace")
        return kind, one("warc-record-id"), one("warc-target-uri"), headers.get("warc-concurrent-to", []), one("warc-refers-to"), size, digest, payload, fields

    def run(batches):
        names = [x.split()[0] for x in _READ.split(", ")]
        kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            for packed in batch.column("content"):
                held = []
                for headers, block in records(packed.as_py()):
                    held.append(row(headers, block))
                    if len(held) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held), kinds)], names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held), kinds)], names)

    return run


def read_captures(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One nested row for each capture in the archives below ``path``.

    ``capture`` (type, record, uri, payload_bytes, payload_digest, payload, and for a
    revisit the page it refers to), ``request`` (record, fields: its lines) and
    ``metadata`` (record, page_id, fields). Records belong together where one names
    the other in a concurrent-to header, in either direction and any order; what
    the capture names itself comes before what names it, and of several of a
    kind the smallest name stays. A partner that is missing is NULL. A request
    or metadata record without a capture of its own is a row with a NULL capture,
    so no record goes without a trace. Captures with one name stay apart. A
    revisit has the size and digest of the payload it stands for, and no payload.
    ``payloads=False`` leaves payloads out. Bytes that are not UTF-8 become U+FFFD.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(_read(payloads), _READ)
    found = durable(found).withColumn("_n", F.monotonically_increasing_id())  # the archives are read once
    main = found.where("type in ('response', 'revisit')")
    others = found.where("type in ('request', 'metadata')").select(F.col("record").alias("name"), F.col("type").alias("kind"), "fields", F.col("concurrent").alias("names"), F.col("_n").alias("_p"))
    partner = F.struct("far", "name", "fields", "_p").alias("partner")
    named = main.select("_n", F.explode("concurrent").alias("name")).join(others.drop("names"), "name").withColumn("far", F.lit(0))
    names = others.withColumn("record", F.explode("names")).join(main.select("record", F.col("_n").alias("_n")), "record").withColumn("far", F.lit(1))
    ties = named.select("_n", "kind", partner).unionByName(names.select("_n", "kind", partner))
    tied = ties.groupBy("_n").agg(*(F.min(F.when(F.col("kind") == k, F.col("partner"))).alias(k) for k in ("request", "metadata")))
    joined = main.join(tied, "_n", "left")
    page = F.regexp_extract("metadata.fields", r"page-id: (-?\d+)", 1)
    joined = joined.withColumn("page_id", F.when(page != "", page.cast("long")))
    firsts = joined.where("type = 'response'").groupBy("record").agg(F.max("page_id").alias("refers_to")).withColumnRenamed("record", "refers")
    whole = joined.where("type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).unionByName(joined.where("type = 'revisit'").join(firsts, "refers", "left").select(*joined.columns, "refers_to"))

    def nested(df: DataFrame, capture: Column, request: Column, metadata: Column) -> DataFrame:
        return df.select(capture.alias("capture"), request.alias("request"), metadata.alias("metadata"))

    request = F.when(F.col("request").isNotNull(), F.struct(F.col("request.name").alias("record"), F.col("request.fields").alias("fields")))
    metadata = F.when(F.col("metadata").isNotNull(), F.struct(F.col("metadata.name").alias("record"), "page_id", F.col("metadata.fields").alias("fields")))
    captures = nested(whole, F.struct("type", "record", "uri", "payload_bytes", "payload_digest", "payload", "refers_to"), request, metadata)

    used = tied.select(F.explode(F.array("request._p", "metadata._p")).alias("_p"))
    alone = others.join(used, "_p", "left_anti").withColumnRenamed("name", "record")
    page = F.regexp_extract("fields", r"page-id: (-?\d+)", 1)
    alone = alone.withColumn("page_id", F.when(page != "", page.cast("long")))
    none = F.lit(None).cast(captures.schema["capture"].dataType)
    rest = nested(alone, none, F.when(F.col("kind") == "request", F.struct("record", "fields")), F.when(F.col("kind") == "metadata", F.struct("record", "page_id", "fields")))
    return captures.unionByName(rest)
