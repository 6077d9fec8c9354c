"""WARC archives of pages: writing with segmented records, and reading with reassembly.

Writing: each page is one record holding an HTTP response. Of pages with equal payloads of some
length, the one with the smallest id is stored in full, the others as revisit records that refer
to it. Bodies beyond one chunk are framed by chunked transfer coding. A record block beyond
``SEGMENT_BYTES`` is cut into segments: the first record, then continuation records that name it
as their origin, the last of them with the length of the whole block.

Reading: tasks stream the archives of their partition record by record. Segments are grouped by
origin, put in order of their numbers, and joined; the joined block must have the stated length,
and the numbers must have no gap. Then HTTP headers are split off and chunk framing is undone.
A group is one page's segments, so it is no larger than the page.

Archives are written by Spark's text writer, one record a row, and closed every
``RECORDS_PER_FILE`` records, so a reading task holds a bounded file. Digest and id alone are
shuffled to find equal payloads, with partial aggregates: a payload that a third of all pages
share is reduced where it is read.

Defined results: a null page is an empty payload. A null id is written without an id, never
becomes the record others refer to, and is read back as null. Rows that share the smallest id of
equal payloads are all stored in full. Rows that repeat id and payload are read back as often as
they were written. An empty table makes an archive without records. A record whose segments have
a gap or the wrong total has ``problem`` set and a null payload; reading goes on.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowloom.llm.batches import pieces
from flowloom.plans.staging import stage

VERSION = b"WARC/1.1\r\n"
DATE = "2024-01-01T00:00:00Z"
CHUNK_BYTES = 4096
SEGMENT_BYTES = 16384
LEAST_REVISIT = 100
RECORDS_PER_FILE = 5000
READ_BYTES = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def header(fields: list[tuple[str, object]]) -> bytes:
    lines = [f"{k}: {v}\r\n" for k, v in fields if v is not None]
    return VERSION + "".join(lines).encode() + b"\r\n"


def record_id(page_id) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def safe_uri(url: str | None) -> str | None:
    """The address without characters that would end a header line."""
    if not url:
        return None
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [body[i : i + size] for i in range(0, len(body), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    """The body inside chunked transfer framing; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        line = framed.index(b"\r\n", at)
        size = int(framed[at:line].split(b";")[0].strip(), 16)
        if size == 0:
            return b"".join(out)
        start = line + 2
        if framed[start + size : start + size + 2] != b"\r\n":
            raise ValueError("chunk does not end where its size says")
        out.append(framed[start : start + size])
        at = start + size + 2


def http_block(body: bytes | None, length: int) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if body is not None and length > CHUNK_BYTES:
        return head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(body)
    return head + b"Content-Length: %d\r\n\r\n" % length + (body or b"")


def records(page_id, url, body: bytes, digest: str, refers_to, segment_bytes: int) -> Iterator[bytes]:
    """The records of a page, each without the line break that ends it."""
    common = [("WARC-Date", DATE), ("WARC-Target-URI", safe_uri(url))]
    mark = ("WARC-Payload-Digest", f"sha256:{digest}")
    kind = ("Content-Type", "application/http; msgtype=response")
    name = record_id(page_id)
    if refers_to is not None:
        block = http_block(None, len(body))
        fields = [
            ("WARC-Type", "revisit"),
            ("WARC-Record-ID", name),
            *common,
            mark,
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", record_id(refers_to)),
        ]
        yield header([*fields, kind, ("Content-Length", len(block))]) + block + b"\r\n"
        return
    block = http_block(body, len(body))
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    for number, part in enumerate(parts, 1):
        first = number == 1
        fields = [("WARC-Type", "response" if first else "continuation")]
        fields += [("WARC-Record-ID", name if first else f"{name[:-1]}:segment:{number}>"), *common, mark]
        if len(parts) > 1:
            fields.append(("WARC-Segment-Number", number))
            if not first:
                fields.append(("WARC-Segment-Origin-ID", name))
            if number == len(parts):
                fields.append(("WARC-Segment-Total-Length", len(block)))
        yield header([*fields, kind, ("Content-Length", len(part))]) + part + b"\r\n"


def revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Stored (page_id, refers_to) of the pages whose payload another page stores."""
    marks = pages.where(F.octet_length("html") >= least).select(
        "page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest")
    )
    firsts = (
        marks.groupBy("digest")
        .agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies"))
        .where("copies > 1 AND refers_to IS NOT NULL")
        .select("digest", "refers_to")
    )
    others = marks.join(firsts, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    # An id may be repeated with other payloads, so the payload's digest stays with it.
    return stage(others.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to").distinct())


def write_archives(
    pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, least_revisit: int = LEAST_REVISIT
) -> None:
    """Compressed archives of (page_id, url, html) below ``path``."""
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")
    )
    known = revisits(pages, least_revisit)
    marked = pages.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    same = marked["page_id"].eqNullSafe(known["_id"]) & (marked["digest"] == known["_digest"])
    planned = marked.join(known, same, "left").select(
        "page_id", "url", F.col("html").cast("binary").alias("html"), "digest", "refers_to"
    )
    schema = pa.schema([("value", pa.binary())])

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "html"):
                columns = [piece.column(i).to_pylist() for i in range(5)]
                made = [r for row in zip(*columns, strict=True) for r in records(*row, segment_bytes)]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], schema=schema)

    # The writer copies the bytes as they are; they need not be valid text.
    rows = planned.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    (
        rows.write.option("lineSep", "\r\n")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .text(path)
    )


def inflated(data: bytes) -> Iterator[bytes]:
    """Pieces of a file, decompressed where it is compressed (also member by member)."""
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(data), READ_BYTES):
            yield data[at : at + READ_BYTES]
        return
    view, at = memoryview(data), 0
    while at < len(data):
        engine = zlib.decompressobj(31)
        while not engine.eof and at < len(data):
            feed = view[at : at + READ_BYTES]
            yield engine.decompress(feed)
            at += len(feed) - len(engine.unused_data)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of every record of an archive."""
    source, held = inflated(data), bytearray()

    def fill(size: int) -> bool:
        while len(held) < size:
            piece = next(source, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not fill(len(held) + 1):
                return
        lines = held[:end].decode("utf-8", "replace").strip().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(fields["content-length"])
        if not fill(end + 4 + length + 4):
            raise ValueError("archive ends inside a record")
        yield fields, bytes(held[end + 4 : end + 4 + length])
        del held[: end + 8 + length]


RAW = (
    "record_id string, kind string, uri string, origin string, segment int, total long, "
    "refers_to string, digest string, block binary"
)


def raw_records(spark: SparkSession, path: str, segmented: bool) -> DataFrame:
    """Records of the archives as they are: those cut into segments, or the others."""
    schema = pa.schema(
        [
            *[(n, pa.string()) for n in ("record_id", "kind", "uri", "origin")],
            ("segment", pa.int32()),
            ("total", pa.int64()),
            *[(n, pa.string()) for n in ("refers_to", "digest")],
            ("block", pa.binary()),
        ]
    )

    def number(value: str | None) -> int | None:
        return None if value is None else int(value)

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for f, block in parsed(content.as_py()):
                    if ("warc-segment-number" in f) != segmented:
                        continue
                    name = f.get("warc-record-id")
                    origin = f.get("warc-segment-origin-id", name)
                    part, total = f.get("warc-segment-number"), f.get("warc-segment-total-length")
                    rows.append(
                        (name, f.get("warc-type"), f.get("warc-target-uri"), origin, number(part))
                        + (number(total), f.get("warc-refers-to"), f.get("warc-payload-digest"), block)
                    )
                    size += len(block)
                    if size >= READ_BYTES:
                        yield to_batch(rows)
                        rows, size = [], 0
                yield to_batch(rows)

    def to_batch(rows):
        columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
        arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("content").mapInArrow(run, RAW)


def reassembled(parts: DataFrame) -> DataFrame:
    """One row per origin: its segments joined in order, or the reason why they cannot be."""
    grouped = parts.groupBy("origin", "digest").agg(
        F.first("uri", ignorenulls=True).alias("uri"),
        F.min(F.when(F.col("segment") == 1, F.col("kind"))).alias("kind"),
        F.max("total").alias("total"),
        F.sort_array(F.collect_set(F.struct("segment", "block"))).alias("parts"),
        F.sum(F.when(F.col("segment") == 1, 1).otherwise(0)).alias("copies"),
    )
    size = F.aggregate(
        "parts", F.lit(0).cast("long"), lambda a, p: a + F.octet_length(p["block"])
    )
    last = F.element_at("parts", -1)["segment"]
    problem = (
        F.when(F.col("copies") == 0, "first segment missing")
        .when(F.col("total").isNull(), "last segment missing")
        .when((last != F.size("parts")), "segment missing or changed")
        .when(size != F.col("total"), "total length differs")
    )
    block = F.aggregate(
        "parts", F.lit(b""), lambda a, p: F.concat(a, p["block"])
    )
    return (
        grouped.withColumn("problem", problem)
        .withColumn("block", F.when(F.col("problem").isNull(), block))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest("copies", F.lit(1)))))
        .select(
            F.col("origin").alias("record_id"),
            "kind",
            "uri",
            F.lit(None).cast("string").alias("refers_to"),
            "digest",
            "block",
            "problem",
        )
    )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, uri, record_type, refers_to, stated_digest, stated_bytes, payload, problem).

    ``payload`` is null for a revisit; ``stated_bytes`` is the length in the HTTP headers, where
    there is one.
    """
    fields = ["record_id", "kind", "uri", "refers_to", "digest", "block"]
    whole = raw_records(spark, path, False).select(*fields, F.lit(None).cast("string").alias("problem"))
    both = whole.unionByName(reassembled(raw_records(spark, path, True)))
    schema = pa.schema(
        [
            ("page_id", pa.int64()),
            ("uri", pa.string()),
            ("record_type", pa.string()),
            ("refers_to", pa.int64()),
            ("stated_digest", pa.string()),
            ("stated_bytes", pa.int64()),
            ("payload", pa.binary()),
            ("problem", pa.string()),
        ]
    )

    def opened(kind, block, problem):
        if block is None:
            return None, None, problem
        head, _, body = block.partition(b"\r\n\r\n")
        lines = head.decode("latin-1").lower().split("\r\n")[1:]
        fields = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        stated = int(fields["content-length"]) if "content-length" in fields else None
        if kind == "revisit":
            return stated, None, problem
        if fields.get("transfer-encoding") == "chunked":
            try:
                return stated, unchunked(body), problem
            except ValueError as error:
                return stated, None, str(error)
        if stated is not None and stated != len(body):
            return stated, None, "body length differs"
        return stated, body, problem

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "block"):
                rows = piece.to_pydict()
                made = [opened(*x) for x in zip(rows["kind"], rows["block"], rows["problem"], strict=True)]
                digests = [d.removeprefix("sha256:") if d else None for d in rows["digest"]]
                columns = [
                    [page_of(x) for x in rows["record_id"]],
                    rows["uri"],
                    rows["kind"],
                    [page_of(x) for x in rows["refers_to"]],
                    digests,
                    *[[m[i] for m in made] for i in range(3)],
                ]
                arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return both.mapInArrow(
        run,
        "page_id long, uri string, record_type string, refers_to long, stated_digest string, "
        "stated_bytes long, payload binary, problem string",
    )
