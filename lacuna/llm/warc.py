"""WARC archives as tables of record segments: oversized payloads are rows of chunks."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.common import map_arrow

CRLF = b"\r\n"
SEGMENT_BYTES = 1 << 16
RECORDS_PER_FILE = 4000
DATE = "2020-01-01T00:00:00Z"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ROWS = "record string, segment long, chunk long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, last boolean, body binary, fault string"


def base32_sha1(payload):
    """Bare upper-case base32 of a binary column's SHA-1, by JVM functions: 10 hex digits are 8 letters."""
    digest = F.sha1(payload)
    part = lambda k: F.lpad(F.conv(F.substring(digest, 10 * k + 1, 10), 16, 32), 8, "0")
    return F.translate(F.upper(F.concat(*map(part, range(4)))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def plan_records(pages: DataFrame, min_revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Each page with its payload's size and digest, its record type and the record it refers to.

    Of payloads that are equal and of ``min_revisit_bytes`` at least, the record with the
    smallest id is the response and the others revisit it (rows that repeat the smallest id
    are responses as well). A null payload counts as empty; a null id never is the smallest
    unless there is no other.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    sized = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    first = (
        sized.where(F.col("payload_bytes") >= min_revisit_bytes)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
        .where("copies > 1")
        .drop("copies")
    )
    # few digests are copied; a hot one has one row here, and the join's other side is split by AQE
    of_page = sized.drop("payload", "url").join(first, "payload_digest").where("payload_bytes >= %d" % min_revisit_bytes).select("page_id", "payload_digest", "first_id").distinct()
    joined = sized.alias("s").join(of_page.alias("o"), F.col("s.page_id").eqNullSafe(F.col("o.page_id")) & (F.col("s.payload_digest") == F.col("o.payload_digest")), "left")
    revisit = F.col("o.first_id").isNotNull() & ~F.col("o.first_id").eqNullSafe(F.col("s.page_id"))
    return joined.select(
        "s.*",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("o.first_id")).alias("refers_to"),
    )


def segments(records: DataFrame, size: int = SEGMENT_BYTES) -> DataFrame:
    """A row for each WARC record of the planned records: record, segment, value (header and block as bytes).

    A payload above ``size`` becomes a response and continuation records, cut from the payload one
    by one, so no row is larger than that; all by JVM functions.
    """
    crlf = F.lit("\r\n")
    revisit = F.col("record_type") == "revisit"
    total = F.when(revisit, 1).otherwise(F.greatest(F.ceil(F.col("payload_bytes") / size), F.lit(1))).cast("int")
    keyed = records.withColumn("record", F.lower(F.hex(F.monotonically_increasing_id()))).withColumn("total", total)
    rows = keyed.withColumn("segment", F.explode(F.sequence(F.lit(1), F.col("total"))))
    first, split = F.col("segment") == 1, F.col("total") > 1
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), crlf, crlf)
    body = F.when(revisit, F.lit(b"")).otherwise(F.substring(F.col("payload"), (F.col("segment") - 1) * size + 1, F.lit(size)))
    rows = rows.withColumn("block", F.concat(F.when(first, http.cast("binary")).otherwise(F.lit(b"")), body))
    line = lambda name, *parts: F.concat(F.lit(f"{name}: "), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(first, F.col("record_type")).otherwise("continuation")),
        line("WARC-Record-ID", "<urn:page:", F.col("record"), ":", F.col("segment"), ">"),
        line("WARC-Date", DATE),
        line("WARC-Target-URI", F.trim(F.regexp_replace(F.coalesce("url", F.lit("")), r"[\s\p{Z}\p{Cc}]+", " "))),
        line("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        line("X-Payload-Length", F.col("payload_bytes")),
        line("WARC-Payload-Digest", "sha1:", F.col("payload_digest")),
        F.when(revisit, line("WARC-Refers-To", "<urn:page:", F.col("refers_to"), ">")),
        F.when(revisit, line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(split, line("WARC-Segment-Number", F.col("segment"))),
        F.when(split & ~first, line("WARC-Segment-Origin-ID", "<urn:page:", F.col("record"), ":1>")),
        F.when(split & (F.col("segment") == F.col("total")), line("WARC-Segment-Total-Length", F.octet_length(http) + F.col("payload_bytes"))),
        line("Content-Type", "application/http; msgtype=response"),
        line("Content-Length", F.octet_length("block")),
    )
    return rows.select("record", "segment", F.concat(head.cast("binary"), F.lit(b"\r\n\r\n"), F.col("block")).alias("value"))


def write_warc(records: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write planned records as gzipped WARC files, each row of the written table being one WARC record.

    No row is larger than a segment and no file holds more than ``records_per_file`` of them, so a
    file can be read back within bounded memory. A file is one gzip stream.
    """
    # a cast keeps the bytes as they are; blank lines close each record
    writer = segments(records, segment_bytes).select(F.col("value").cast("string").alias("value")).write
    writer.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _parts(content: bytes, step: int = 1 << 20):
    """The bytes of a plain or gzipped file, piece by piece."""
    if content[:2] != b"\x1f\x8b":
        for i in range(0, len(content), step):
            yield content[i : i + step]
        return
    unzip, left = zlib.decompressobj(31), content
    while left:
        yield unzip.decompress(left, step)
        left = unzip.unconsumed_tail
        if unzip.eof:  # a further member
            left, unzip = unzip.unused_data, zlib.decompressobj(31)


def parse_warc(content: bytes, size: int = SEGMENT_BYTES, strict: bool = True):
    """(header fields, chunk number, chunk, whether it is the last) for the block of each WARC record.

    Chunks hold ``size`` bytes at most, so a record is never held whole, however large. Damage is
    an error; if not ``strict``, it is a record whose one field ``fault`` names it, and reading goes
    on at the next line that begins a record.
    """
    buffer, parts, broken = bytearray(), _parts(content), ""

    def more() -> bool:
        nonlocal broken
        try:
            part = next(parts, None)
        except zlib.error:
            part, broken = None, "its compressed data are damaged"
        buffer.extend(part or b"")
        return part is not None

    def header():
        """Header fields of the next record, None at the end, or what is wrong."""
        while len(buffer) < 4 and more():
            pass
        while buffer[:2] == CRLF:
            del buffer[:2]
            if len(buffer) < 4:
                more()
        while not buffer.strip():
            if not more():
                return broken or None
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                return broken or "a WARC header has no end"
        lines = bytes(buffer[:end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            return f"not a WARC record: {lines[0][:40]}"
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if not re.fullmatch("[0-9]{1,18}", fields.get("content-length", "")):
            return "a WARC record has no length"
        del buffer[: end + 4]
        return fields

    while True:
        fields = header()
        n, fault = 0, fields if isinstance(fields, str) else None
        if fields is None:
            return
        left = 0 if fault else int(fields["content-length"])
        while not fault and (left or not n):
            want = min(left, size)
            while len(buffer) < want and not fault:
                if not more():
                    fault = broken or "a WARC record is cut short"
            if not fault:
                chunk = bytes(buffer[:want])
                del buffer[:want]
                left -= want
                yield fields, n, chunk, not left
                n += 1
        if not fault:
            continue
        if strict:
            raise ValueError(fault)
        yield {"fault": fault, "warc-record-id": "" if isinstance(fields, str) else fields.get("warc-record-id", "")}, 0, b"", True
        while True:  # to the next beginning of a record; what may be half of one stays
            at = buffer.find(b"\nWARC/1.", 1)
            if at >= 0:
                del buffer[: at + 1]
                break
            del buffer[: max(0, len(buffer) - 8)]
            if not more():
                return


def payload_chunks(content: bytes, size: int = SEGMENT_BYTES, strict: bool = True):
    """The chunks of ``parse_warc`` without the HTTP header that a block of HTTP other than a continuation begins with."""
    head = None
    for fields, n, chunk, last in parse_warc(content, size, strict):
        if n == 0:
            http = fields.get("content-type", "application/http").startswith("application/http")
            head = b"" if http and fields.get("warc-type") != "continuation" else None
        if head is not None:
            head += chunk
            end = head.find(b"\r\n\r\n")
            if end < 0 and not last:
                chunk = b""
            else:
                chunk, head = head[end + 4 :] if end >= 0 else b"", None
        yield fields, n, chunk, last


def read_segments(spark: SparkSession, path: str, bodies: bool = False) -> DataFrame:
    """The chunked record table of the archives under ``path``: rows by record, segment and chunk number.

    Records that are whole run through an incremental digest where they are read and leave their
    body there, in one row a record; ``bodies`` keeps it, in chunk rows. The segments of oversized
    payloads are chunk rows with their bodies. Records other than responses, resources, revisits and
    continuations are passed over; fields that an archive does not have are null; damage is a row
    with its ``fault``.
    """

    def number(text: str) -> int | None:
        return int(text) if re.fullmatch("-?[0-9]{1,18}", text) else None

    def rows(batches):
        for b in batches:
            for content in b.column(0).to_pylist():
                digest, size = hashlib.sha1(), 0
                for f, chunk, body, last in payload_chunks(content, strict=False):
                    own = f.get("warc-record-id", "").strip("<>")
                    if "fault" in f:  # of a record whose chunks have gone out already, or of one that is not known
                        yield {"record": own, "segment": 0, "chunk": 0, "last": True, "fault": f["fault"]}
                        continue
                    kind, n = f.get("warc-type", ""), number(f.get("warc-segment-number", "0")) or 0
                    if kind not in ("response", "resource", "revisit", "continuation"):
                        continue
                    whole = kind in ("response", "resource") and n == 0
                    if chunk == 0:
                        digest, size = hashlib.sha1(), 0
                    if whole:
                        digest.update(body)
                        size += len(body)
                    if not (last or n or bodies):
                        continue
                    refers = f.get("warc-refers-to", "").strip("<>")
                    said = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    yield {
                        "record": f.get("warc-segment-origin-id", "").strip("<>") or own, "segment": n, "chunk": chunk, "page_id": number(f.get("x-page-id", "")), "url": f.get("warc-target-uri", "" if "x-page-id" in f else None),
                        "record_type": "revisit" if kind == "revisit" else "response", "refers_to": number(refers.removeprefix("urn:page:")),
                        "payload_bytes": size if whole else number(f.get("x-payload-length", "")),
                        "payload_digest": base64.b32encode(digest.digest()).decode() if whole and last else said,
                        "last": last and (n == 0 or "warc-segment-total-length" in f), "body": body if n or bodies else None,
                    }

    schema = pa.schema([("record", pa.string()), ("segment", pa.int64()), ("chunk", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("last", pa.bool_()), ("body", pa.binary()), ("fault", pa.string())])

    def run(batches):
        held, size = [], 0
        for row in rows(batches):
            held.append(row)
            size += len(row.get("body") or b"")
            if len(held) >= 1000 or size >= 4 << 20:
                yield pa.RecordBatch.from_pylist(held, schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.transform(map_arrow, run, ROWS)


def read_all(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, record, fault.

    The chunks of an oversized payload meet in order in one partition and run through one
    incremental digest. ``fault`` is null for a record that is whole; otherwise it tells what is damaged,
    or that segments of a payload are missing or do not give its stated size.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record"]

    def run(batches):
        digest, size, record, expected, fault, first = hashlib.sha1(), 0, None, (1, 0), None, None

        def close(said: str | None):
            """The row of the payload that is being read, with what is wrong with it."""
            return {**first, "payload_bytes": size, "payload_digest": base64.b32encode(digest.digest()).decode(), "fault": said}

        for b in batches:
            out = []
            for row in b.to_pylist():
                n = row["segment"]
                if n == 0:
                    out.append({c: row[c] for c in (*names, "fault")})
                    continue
                here = (n, row["chunk"])
                if row["record"] != record:
                    if first is not None:
                        out.append(close("its last segment is missing"))
                    digest, size, record, expected, first = hashlib.sha1(), 0, row["record"], (0, 0), {c: row[c] for c in names}
                    fault = None if here == (1, 0) else "its first segment is missing"
                elif first is None:
                    continue  # more than once, or behind the last segment
                # the next chunk of the segment, or the first of the next segment
                elif here not in (expected, (expected[0] + 1, 0)):
                    fault = fault or f"segment {n} is out of place"
                digest.update(row["body"])
                size, expected = size + len(row["body"]), (n, row["chunk"] + 1)
                if row["last"]:
                    stated = row["payload_bytes"]
                    out.append(close(fault or (f"it has {size} bytes of {stated}" if stated not in (None, size) else None)))
                    first = None
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if first is not None:
            yield pa.RecordBatch.from_pylist([close("its last segment is missing")], schema)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record", pa.string()), ("fault", pa.string())])
    rows = read_segments(spark, path).repartition("record", F.when(F.col("segment") == 0, F.col("page_id"))).sortWithinPartitions("record", "segment", "chunk")
    return rows.transform(map_arrow, run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record string, fault string")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records that are whole: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""
    return read_all(spark, path).where("fault is null").drop("record", "fault")


def quarantine(spark: SparkSession, path: str) -> DataFrame:
    """What could not be read: page_id, url (null if not known), record, fault."""
    return read_all(spark, path).where("fault is not null").select("page_id", "url", "record", "fault")
