"""Web archives: writing legacy ARC files, converting them to WARC, reading WARC back.

An ARC file starts with a version block that names the fields of its record lines; version 1 has five fields,
version 2 ten, and the last one is always the length of what follows. The converter reads each record by that
declared length, splits the HTTP headers from the payload and synthesises what WARC wants and ARC lacks: record
identifiers, ISO timestamps, record types and digests. A payload that occurs again is stored once; the other
records become revisits of it.

Each record is a gzip member of its own, as both formats want it. Files are written by Spark's text writer, with the
separator of the format (also a member) as line separator, and read as binary files, so they may lie in any store
that Spark reaches. Records are decoded one after another from the compressed bytes of a file; a file is as large as
the split it was made from.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path, stash

ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ID_HEADER = "X-Archive-Page-Id"
BATCH_BYTES = 16 << 20
LEVEL = 6  # of compression
FEW = 200_000  # repeated payloads at most that are broadcast; with more of them, records are shuffled to them
SEPARATOR = b"\r\n\r\n"  # of WARC records


def member(data: bytes) -> bytes:
    """A gzip member without time or name."""
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def _write_members(records: DataFrame, separator: bytes, path: str) -> None:
    """Write members (``record binary``) with the separator's member between them. The encoding concerns the separator
    only; records are written as they are."""
    lines = records.select(F.col("record").cast("string"))
    lines.write.option("encoding", "ISO-8859-1").option("lineSep", member(separator).decode("latin-1")).text(path)


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _split_http(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers by lower-case name, the header bytes with their blank line, and the payload."""
    end = block.find(b"\r\n\r\n") + 4
    head = block[: max(end, 4)] if end >= 4 else b""
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if v}, head, block[len(head) :]


def _flush(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns)


def _batched(rows: Iterator[tuple[int, dict]], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Data frames of about BATCH_BYTES; each row comes with its size."""
    held, size = [], 0
    for n, row in rows:
        held.append(row)
        size += n + 200
        if size >= BATCH_BYTES:
            yield _flush(held, columns)
            held, size = [], 0
    if held:
        yield _flush(held, columns)


def write_arc(df: DataFrame, path: str, id_col: str, url_col: str, body_col: str, archived_at: str = "20240101000000") -> None:
    """Write ARC files, of version 1 and 2 by turns, with each row's body as an HTTP response."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        version = 1 + part % 2
        about = f"{version} 0 tidelake\n{ARC_FIELDS[version]}\n"
        first = f"filedesc://part-{part:05d}.arc 0.0.0.0 {archived_at} text/plain "
        middle = "" if version == 1 else f"200 - - 0 part-{part:05d}.arc "

        def rows() -> Iterator[tuple[int, dict]]:
            yield 0, {"record": member(f"{first}{middle}{len(about)}\n{about}".encode())}
            for batch in batches:
                for page, url, body in zip(batch["id"], batch["url"], batch["body"], strict=True):
                    data = body.encode("utf-8")
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(data)}\r\n{ID_HEADER}: {page}\r\n\r\n"
                    block = head.encode("utf-8") + data
                    place = re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url) or "unknown:"
                    line = f"{place} 0.0.0.0 {archived_at} text/html {middle}{len(block)}\n"
                    yield len(block), {"record": member(line.encode() + block)}

        yield from _batched(rows(), ["record"])

    text = F.coalesce(F.col(body_col), F.lit("")).alias("body")
    read = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), text)
    records = read.mapInPandas(run, "record binary")
    _write_members(records, b"\n", path)


def arc_records(data: bytes) -> Iterator[dict]:
    """Records of one gzipped ARC file. The version block says which fields a record line has; lengths are declared."""
    with gzip.open(io.BytesIO(data)) as file:
        fields: list[str] | None = None
        while line := file.readline():
            line = line.rstrip(b"\r\n")
            if not line:
                continue
            values = line.decode("utf-8", "replace").split(" ")
            block = file.read(int(values[-1]))
            if len(block) < int(values[-1]):
                raise ValueError(f"ARC record shorter than declared: {line[:200]!r}")
            if values[0].startswith("filedesc:"):
                about = block.decode("utf-8", "replace").splitlines()
                fields = about[1].split(" ")
                if fields != ARC_FIELDS.get(int(about[0].split(" ")[0])).split(" "):
                    raise ValueError(f"unknown ARC version block: {about[:2]}")
                yield dict(zip(fields, values, strict=True)) | {"kind": "warcinfo", "block": block}
                continue
            if fields is None or len(values) != len(fields):
                raise ValueError(f"ARC record line does not fit its version: {line[:200]!r}")
            record = dict(zip(fields, values, strict=True))
            yield record | {"kind": "response" if record["URL"].startswith(("http://", "https://")) else "resource", "block": block}


def _iso(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


CONVERTED = "page string, url string, date string, kind string, record_id string, digest string, size long"
STORED = f"{CONVERTED}, head binary, record binary"


def converted(spark: SparkSession, path: str, with_record: bool) -> DataFrame:
    """ARC files as WARC records to be: identifiers, timestamps, types and digests synthesised; ``with_record`` also the
    HTTP headers and the finished record, for the case that the payload is stored."""
    schema = STORED if with_record else CONVERTED
    columns = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple[int, dict]]:
            for batch in batches:
                for data in batch["content"]:
                    for r in arc_records(bytes(data)):
                        if r["kind"] == "warcinfo":
                            continue
                        http, head, payload = _split_http(r["block"])
                        digest = payload_digest(payload)
                        page = http.get(ID_HEADER.lower())
                        known = uuid.uuid5(uuid.NAMESPACE_URL, f"{r['URL']} {r['Archive-date']} {page} {digest}")
                        row = {
                            "page": page, "url": r["URL"], "date": _iso(r["Archive-date"]), "kind": r["kind"], "record_id": f"<urn:uuid:{known}>",
                            "digest": digest, "size": len(payload),
                        }
                        if with_record:
                            row |= {"head": head, "record": warc_record(row, r["block"])}
                            yield len(row["record"]), row
                        else:
                            yield 0, row

        yield from _batched(rows(), columns)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def warc_record(row: dict, block: bytes, of: tuple[str, str, str] | None = None) -> bytes:
    """The member of a record; with ``of`` (identifier, address, date) a revisit of that record."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if of else row['kind']}",
        f"WARC-Target-URI: {row['url']}",
        f"WARC-Date: {row['date']}",
        f"WARC-Record-ID: {row['record_id']}",
        f"WARC-Payload-Digest: sha1:{row['digest']}",
        f"WARC-Block-Digest: sha1:{payload_digest(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if of:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {of[0]}",
            f"WARC-Refers-To-Target-URI: {of[1]}",
            f"WARC-Refers-To-Date: {of[2]}",
        ]
    return member(("\r\n".join(lines) + "\r\n\r\n").encode("utf-8") + block)


def _made_last(rows: pd.DataFrame) -> pd.DataFrame:
    """``again``: the member of a revisit; ``info``: the one that a file starts with; null for rows that have none."""
    again, info = [], []
    for r in rows.to_dict("records"):
        of = (r["of_id"], r["of_url"], r["of_date"]) if isinstance(r["of_id"], str) else None
        again.append(warc_record(r, bytes(r["head"]), of) if of else None)
        info.append(_warcinfo(r["part"]) + member(SEPARATOR) if r["place"] == 0 else None)
    return pd.DataFrame({"again": pd.Series(again, dtype=object), "info": pd.Series(info, dtype=object)})


def arc_to_warc(spark: SparkSession, arc_path: str, warc_path: str, id_type: str = "long", least_bytes: int = 0) -> None:
    """Convert ARC files to WARC files.

    Of records with equal payloads of at least ``least_bytes`` bytes, that with the largest id stays a response
    (rows that repeat its id too); the others become revisits. Records without an id count as smallest.
    """
    # ids and digests of all records meet first; finished (compressed) records move once at most, to what decides on them
    found = stash(converted(spark, arc_path, with_record=False), "records")
    own = F.when(F.col("page") != "", F.col("page").try_cast(id_type))
    largest = F.max(F.struct(own.alias("page"), "record_id", "url", "date"))  # null is smallest
    grouped = found.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(largest.alias("first"), F.count("*").alias("n"))
    firsts = stash(grouped.where("n > 1").select("digest", "size", "first"), "firsts")
    if firsts.count() <= FEW:
        firsts = F.broadcast(firsts)

    records = converted(spark, arc_path, with_record=True).join(firsts, ["digest", "size"], "left")
    revisit = F.col("first").isNotNull() & ~own.eqNullSafe(F.col("first.page"))
    of = [F.when(revisit, F.col(f"first.{c}")).alias(f"of_{n}") for n, c in (("id", "record_id"), ("url", "url"), ("date", "date"))]
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place")
    small = F.struct("url", "date", "kind", "record_id", "digest", "head", F.spark_partition_id().alias("part"), place, *of)
    made = F.pandas_udf(_made_last, "again binary, info binary")
    told = records.withColumn("made", made(small))
    stored = told.select(F.concat(F.coalesce("made.info", F.lit(b"")), F.coalesce("made.again", "record")).alias("record"))
    _write_members(stored, SEPARATOR, warc_path)


def _warcinfo(part: int) -> bytes:
    about = b"software: tidelake\r\nformat: WARC File Format 1.1\r\n"
    known = uuid.uuid5(uuid.NAMESPACE_URL, f"warcinfo {part}")
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{known}>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(about)}\r\n\r\n"
    return member(head.encode() + about)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of one gzipped WARC file."""
    with gzip.open(io.BytesIO(data)) as file:
        while line := file.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {line[:80]!r}")
            headers = {}
            while (line := file.readline().rstrip(b"\r\n")):
                k, _, v = line.decode("utf-8", "replace").partition(":")
                headers[k.strip().lower()] = v.strip()
            block = file.read(int(headers["content-length"]))
            if len(block) < int(headers["content-length"]):
                raise ValueError("WARC record shorter than declared")
            yield headers, block


def read_warc(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, record_id, refers_to_id, url, payload`` per record
    other than warcinfo; the payload of a revisit is null. Digests of stored blocks and payloads are verified."""
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "record_id", "refers_to_id", "url", "payload"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple[int, dict]]:
            for batch in batches:
                for data in batch["content"]:
                    for warc, block in warc_records(bytes(data)):
                        kind = warc["warc-type"]
                        if kind == "warcinfo":
                            continue
                        http, _, payload = _split_http(block)
                        digest = warc["warc-payload-digest"].removeprefix("sha1:")
                        if warc["warc-block-digest"] != f"sha1:{payload_digest(block)}" or kind != "revisit" and payload_digest(payload) != digest:
                            raise ValueError(f"digest of {warc['warc-record-id']} differs from what is stored")
                        yield len(block), {
                            "page_id": http.get(ID_HEADER.lower()), "payload_bytes": int(http["content-length"]), "payload_digest": digest,
                            "record_type": kind, "record_id": warc["warc-record-id"], "refers_to_id": warc.get("warc-refers-to"),
                            "url": warc["warc-target-uri"], "payload": None if kind == "revisit" else payload,
                        }

        yield from _batched(rows(), columns)

    kinds = "page_id string, payload_bytes long, payload_digest string, record_type string, record_id string, refers_to_id string, url string, payload binary"
    found = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, kinds)
    return found.withColumn("page_id", F.when(F.col("page_id") != "", F.col("page_id").try_cast(id_type)))


def archive_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Pages written as ARC, converted to WARC and read back: ``id_col, payload_bytes, payload_digest, record_type,
    refers_to`` for each row.

    A null body is an empty payload, a null url the place ``unknown:``, which makes a resource, told as response
    here. Rows that repeat the largest id of equal payloads are all responses; a null id counts as smallest. An
    empty table gives no rows; other columns are not read. The archives stay in the shared folder.
    """
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(df, arc, id_col, url_col, body_col)
    arc_to_warc(spark, arc, warc, kind, least_bytes)
    read = stash(read_warc(spark, warc, kind).drop("payload", "url"), "read")
    responses = read.where("record_type <> 'revisit'").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.max("page_id").alias("refers_to"))
    joined = read.join(responses, "refers_to_id", "left")
    told = F.when(F.col("record_type") == "revisit", "revisit").otherwise("response").alias("record_type")
    return joined.select(F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", told, "refers_to")
