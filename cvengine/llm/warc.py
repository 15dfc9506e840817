"""Pages written to WARC archives as segmented, chunked HTTP responses, and read back whole."""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cvengine.llm.common import numbered, small_text_batches, stage, table
from cvengine.session import new_path

CRLF = "\r\n"
#: Characters of a transfer chunk and of a record's block.
CHUNK = 4096
SEGMENT = 16384
#: Records of one archive file, which a task reads whole.
RECORDS_PER_FILE = 1000
#: Bytes that a task holds as parsed records before it passes them on.
HELD_BYTES = 8 << 20
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CONTROL = re.compile(r"[\x00-\x1F\x7F]+")


def payload_digest(payload: Column) -> Column:
    """The SHA-1 of a payload in base32: 160 bits are four groups of eight digits."""
    groups = [F.lpad(F.conv(F.substring(F.sha1(payload), 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _record_id(kind: str, page_id: int | None, url: str | None, digest: str, part: int = 0, row: int = 0) -> str:
    """A URN made from what identifies a record, so that a task that runs twice writes the same id."""
    key = f"{kind}|{page_id}|{url or ''}|{digest}|{part}|{row}".encode("utf-8", "surrogatepass")
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(key).hexdigest())}>"


def _record(fields: dict[str, str | None], block: str) -> str:
    """A record without the line ends that follow it; fields without a value are left out."""
    lines = ["WARC/1.1", *[f"{name}: {value}" for name, value in fields.items() if value], f"Content-Length: {len(block.encode())}"]
    return CRLF.join([*lines, "", block])


def page_records(page_id: int | None, url: str | None, payload: str, digest: str, original: dict | None, row: int) -> list[str]:
    """The records of a page: a revisit of ``original``, or a response and, if it is long, its continuations."""
    link = _CONTROL.sub("", url or "")
    common = {"WARC-Target-URI": link, "WARC-Date": "1970-01-01T00:00:00Z"}
    own = {"WARC-Page-ID": None if page_id is None else str(page_id), "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}
    head = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"
    if original is not None:
        named = {
            "WARC-Type": "revisit",
            "WARC-Record-ID": _record_id("revisit", page_id, url, digest, row=row),
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            "WARC-Refers-To": _record_id("response", original["page_id"], original["link"], digest, row=original["__row"]),
        }
        return [_record(named | common | own, head + CRLF)]
    chunks = [payload[at : at + CHUNK] for at in range(0, len(payload), CHUNK)]
    framed = [f"{len(c.encode()):x}{CRLF}{c}{CRLF}" for c in chunks]
    http = "".join([head, f"Transfer-Encoding: chunked{CRLF * 2}", *framed, f"0{CRLF * 2}"])
    origin = _record_id("response", page_id, url, digest, row=row)
    blocks = [http[at : at + SEGMENT] for at in range(0, len(http), SEGMENT)]
    records = []
    for number, block in enumerate(blocks, 1):
        first = number == 1
        named = {"WARC-Type": "response" if first else "continuation"}
        named["WARC-Record-ID"] = origin if first else _record_id("continuation", page_id, url, digest, number, row)
        if len(blocks) > 1:
            named["WARC-Segment-Number"] = str(number)
            named["WARC-Segment-Origin-ID"] = None if first else origin
            named["WARC-Segment-Total-Length"] = str(len(http.encode())) if number == len(blocks) else None
        records.append(_record(named | common | (own if first else {}), block))
    return records


def warc_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The records of ``pages`` (page_id, url, html), one per row in ``value``, without the two line ends that follow each.

    Which page of equal payloads comes first is an aggregate by digest; the few digests that several pages share are
    joined back; only that join may move payloads. Rows are numbered in a staged copy, and the number is part of the record id.
    """
    small_text_batches(pages.sparkSession)
    rows = numbered(pages.select("page_id", "url", "html"))
    rows = rows.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"), "__row")
    rows = rows.withColumn("digest", payload_digest(F.col("payload").cast("binary")))
    place = F.struct(F.col("page_id").isNull().alias("missing"), "page_id", F.coalesce("url", F.lit("")).alias("link"))
    shared = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.min(F.struct(place.alias("place"), "__row")).alias("first"), F.count(F.lit(1)).alias("n"))
    shared = stage(shared.where("n > 1").select(F.col("digest").alias("same"), "first"), "shared-payloads")
    rows = rows.join(shared, rows["digest"] == shared["same"], "left")
    rows = rows.select("page_id", "url", "payload", "digest", F.when(F.col("first.place") != place, F.struct("first.place.*", "first.__row")).alias("original"), "__row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "original", "__row"))):
                made = page_records(*(x.as_py() for x in row))
                held += made
                size += sum(map(len, made))
                if size >= HELD_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])

    return rows.mapInArrow(run, "value string")


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Writes a folder of gzip WARC files at ``path``, any place that Spark writes to.

    Of the pages whose payloads (html as UTF-8, nothing for NULL) are equal and have ``least_bytes`` bytes or more,
    that of the smallest page_id (NULL last; of several rows of that page_id the least url, NULL as an empty one) becomes a response
    record and the others revisit it; all smaller ones are responses. A response longer than SEGMENT characters continues in further
    records. Rows equal in page_id, url and html have a record each, of the same kind; a page without page_id is a response
    if no other has its payload, and revisits one otherwise. Control characters in a url are left out of its header; pages without url or
    page_id lack that header. The text writer ends each record with the two line ends the format asks for.
    """
    records = warc_records(pages, least_bytes)
    records.write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


_FIELDS = {
    "warc-type": "record_type",
    "warc-record-id": "record_id",
    "warc-segment-number": "segment",
    "warc-segment-origin-id": "origin_id",
    "warc-segment-total-length": "total_length",
    "warc-target-uri": "url",
    "warc-page-id": "page_id",
    "warc-payload-digest": "header_digest",
    "warc-refers-to": "refers_to_id",
}
_NUMBERS = {"segment", "total_length", "page_id"}
_RECORD = T.StructType([T.StructField(n, T.LongType() if n in _NUMBERS else T.StringType()) for n in _FIELDS.values()]).add("block", T.BinaryType())


def parse_archive(content: bytes) -> Iterator[dict]:
    """The records of one archive file, read front to back; a file that ends inside a record raises."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 16)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("the archive ends inside a record")
        record = {out: fields.get(name) for name, out in _FIELDS.items()}
        yield record | {n: None if record[n] is None else int(record[n]) for n in _NUMBERS} | {"block": block}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives in a folder."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for content in batch.column("content"):
                for record in parse_archive(content.as_py()):
                    held.append(record)
                    size += len(record["block"])
                    if size >= HELD_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BinaryType(): pa.binary()}
    schema = pa.schema([(f.name, kinds[f.dataType]) for f in _RECORD.fields])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(parse, _RECORD)


def http_payload(block: bytes) -> bytes | None:
    """The body of an HTTP response; chunked transfer framing is taken off. None if the framing is broken."""
    head, _, body = block.partition(b"\r\n\r\n")
    if b"transfer-encoding: chunked" not in head.lower():
        return body
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            return None
        if size == 0:
            return b"".join(parts)
        if size < 0 or body[end + 2 + size : end + 4 + size] != b"\r\n":
            return None
        parts.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per page of the archives: page_id, url, record_type, record_id, refers_to_id, header_digest, payload, whole.

    Continuation records are grouped by their origin and put in order of segment number; ``whole`` says that the numbers
    have no gap, that the lengths add up to the total of the last segment, and that the chunk framing is sound;
    otherwise ``payload`` is NULL. Only segmented records are shuffled. Revisits have no payload of their own.
    Records that occur twice count once per segment.
    """
    records = read_records(spark, path)
    alone = records.where("segment IS NULL").withColumn("fits", F.lit(True))
    parts = F.sort_array(F.collect_set(F.struct("segment", "total_length", "block")))
    first = {c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("record_type", "url", "page_id", "header_digest")}
    joined = (
        records.where("segment IS NOT NULL")
        .groupBy(F.coalesce("origin_id", "record_id").alias("record_id"))
        .agg(parts.alias("parts"), *first.values())
        .withColumn("numbers", F.transform("parts", lambda p: p["segment"]))
        .withColumn("blocks", F.transform("parts", lambda p: p["block"]))
        .withColumn("length", F.aggregate("blocks", F.lit(0).cast("long"), lambda sum_, b: sum_ + F.octet_length(b)))
        .withColumn("total", F.element_at("parts", -1)["total_length"])
        .withColumn("fits", (F.col("numbers") == F.sequence(F.lit(1).cast("long"), F.size("parts").cast("long"))) & F.coalesce(F.col("length") == F.col("total"), F.lit(False)))
    )
    alone = alone.withColumn("blocks", F.array("block"))
    names = ["record_id", "record_type", "page_id", "url", "header_digest", "refers_to_id", "fits", "blocks"]
    joined = joined.withColumn("refers_to_id", F.lit(None).cast("string"))
    whole = alone.select(*names).unionAll(joined.select(*names))

    def unframe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # the segments are joined here, once; joining them one by one as columns would copy what is there each time
            rows = zip(batch.column("record_type").to_pylist(), batch.column("fits").to_pylist(), batch.column("blocks"))
            payloads = [http_payload(b"".join(blocks.as_py())) if fits and kind == "response" else None for kind, fits, blocks in rows]
            sound = [fits and (p is not None or kind != "response") for p, fits, kind in zip(payloads, batch.column("fits").to_pylist(), batch.column("record_type").to_pylist())]
            columns = [batch.column(n) for n in names[:-2]] + [pa.array(payloads, pa.binary()), pa.array(sound, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names[:-2], "payload", "whole"])

    kept = [whole.schema[n] for n in names[:-2]]
    return whole.mapInArrow(unframe, T.StructType([*kept, T.StructField("payload", T.BinaryType()), T.StructField("whole", T.BooleanType())]))


def round_trip(pages: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` to archives at ``path``, reads them, and returns a row per page with the digest of what came back.

    page_id, payload_bytes, payload_digest (of the payload read, for a revisit of the one it refers to), record_type,
    refers_to, url, intact (the payload is whole and has the digest its record names). No rows for an empty table.
    """
    write_archives(pages, path, least_bytes)
    read = read_archives(pages.sparkSession, path)
    slim = read.select(
        "record_id", "record_type", "page_id", "url", "refers_to_id", F.substring("header_digest", 6, 32).alias("named"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), payload_digest(F.col("payload")).alias("payload_digest"), "whole",
    )
    slim = stage(slim, "archive-pages")
    answers = slim.where("record_type = 'response'")
    original = answers.select(
        F.col("record_id").alias("original_id"), F.col("page_id").alias("original_page"), F.col("payload_bytes").alias("original_bytes"), F.col("payload_digest").alias("original_digest"), F.col("whole").alias("original_whole")
    )
    again = slim.where("record_type = 'revisit'").join(original, F.col("refers_to_id") == F.col("original_id"), "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "intact"]
    intact = F.coalesce(F.col("whole") & (F.col("named") == F.col("payload_digest")), F.lit(False))
    own = answers.withColumn("refers_to", F.lit(None).cast("long")).withColumn("intact", intact)
    taken = again.withColumns({"payload_bytes": F.col("original_bytes"), "payload_digest": F.col("original_digest"), "refers_to": F.col("original_page")})
    taken = taken.withColumn("intact", F.coalesce(F.col("original_whole") & (F.col("named") == F.col("original_digest")), F.lit(False)))
    return own.select(*columns).unionAll(taken.select(*columns))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back, with the kind of their record and the digest of what came back."""
    found = round_trip(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "intact")


CHECK_SQL = f"""
WITH page AS (SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
hashed AS (
  SELECT page_id, url, payload, sha1(payload) AS hex, rank() OVER same AS place, first_value(page_id) OVER same AS first_id
  FROM page WINDOW same AS (PARTITION BY payload ORDER BY page_id NULLS LAST, coalesce(url, ''))),
digits AS (
  SELECT *, [('0x' || substr(hex, 1 + 10 * g, 10))::BIGINT FOR g IN range(0, 4)] AS groups FROM hashed),
named AS (
  SELECT *, list_aggregate([substr('{BASE32}', CAST((groups[1 + i // 8] >> (5 * (7 - i % 8))) & 31 AS BIGINT) + 1, 1) FOR i IN range(0, 32)], 'string_agg', '') AS digest FROM digits)
SELECT page_id, strlen(payload) AS payload_bytes, digest AS payload_digest,
       CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN place > 1 THEN first_id END AS refers_to, url, true AS intact
FROM named
"""
