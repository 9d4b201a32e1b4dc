"""WARC archives as a chunked record table: written by Spark, read back as a stream of chunks."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ._common import cut, join_keyed, read, remove_folder, shared_folder

#: Longest payload of one record or continuation, and longest chunk that a reader holds. An Arrow batch of
#: Spark's default 10,000 rows is then 160 MB at most, whatever the length of a payload.
CHUNK_BYTES = 16_384
#: A table of revisits of at most so many rows is broadcast to the pages; a larger one is shuffled.
BROADCAST_ROWS = 100_000
# Fixed values of the format.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "page_id long, record_id string, record_type string, refers_to long, chunk_no long, chunk_bytes long, digest_so_far string, last boolean, payload_bytes long, payload_digest string, intact boolean, data binary"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column."""
    digest = F.sha1(payload)
    groups = [F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
    return F.concat(*(F.substring(F.lit(BASE32), F.shiftright(g, s).bitwiseAND(31) + 1, F.lit(1)) for g in groups for s in (15, 10, 5, 0)))


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, sha, refers_to) of the pages that another page with an equal payload stands for: the one with the largest page_id.

    `pages` has page_id and payload (binary, not null). Payloads are equal when SHA-256 and length agree.
    """
    digests = cut(pages.select("page_id", F.sha2("payload", 256).alias("sha"), F.length("payload").alias("n")).where(F.col("n") >= least_bytes))
    groups = digests.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1 and refers_to is not null").drop("c")
    found = join_keyed(digests, groups, "sha", "inner").where("page_id is null or page_id <> refers_to")
    return found.select("page_id", "sha", "refers_to").distinct()


def record_lines(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """(line): the records of an archive in order, as bytes in a string column, each without its final newline.

    A payload longer than `chunk_bytes` becomes a record and continuation records that follow it at once.
    """
    raw = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), raw.alias("payload"))
    others = cut(revisits(base, least_bytes))
    others = others.select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), "refers_to")
    if others.count() <= BROADCAST_ROWS:
        others = F.broadcast(others)
    rows = base.join(others, base.page_id.eqNullSafe(others["_id"]) & (F.sha2("payload", 256) == others["_sha"]), "left").select("page_id", "url", "payload", "refers_to", base32_sha1(F.col("payload")).alias("digest"))

    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    record = lambda i: text("<urn:page:", F.coalesce(i.cast("string"), F.lit("null")), ":", F.col("digest"), ">")
    n = F.length("payload")
    http = text("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ", n.cast("string"), "\r\n\r\n")
    is_revisit = F.col("refers_to").isNotNull()
    segments = F.when(is_revisit, 1).otherwise(F.greatest(F.lit(1), F.ceil(n / chunk_bytes))).cast("int")
    # white space and control characters in a URL are percent-encoded, so they can't end the line
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    parts = rows.select("*", record(F.col("page_id")).alias("id"), http.alias("http"), url.alias("uri"), segments.alias("segments"), F.explode(F.sequence(F.lit(1), segments)).alias("k"))
    chunk = F.when(is_revisit, F.lit(b"")).otherwise(F.substring(F.col("payload"), (F.col("k") - 1) * chunk_bytes + 1, F.lit(chunk_bytes)))
    block = F.when(F.col("k") == 1, F.concat(F.col("http").cast("binary"), chunk)).otherwise(chunk)
    total = F.length("http") + F.when(is_revisit, 0).otherwise(n)
    first = text(
        "WARC-Type: ", F.when(is_revisit, "revisit").otherwise("response"), "\r\nWARC-Record-ID: ", F.col("id"), "\r\n",
        F.coalesce(text("WARC-Target-URI: ", F.col("uri"), "\r\n"), F.lit("")), "Content-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:", F.col("digest"), "\r\n",
        F.when(is_revisit, text("WARC-Profile: ", PROFILE, "\r\nWARC-Refers-To: ", record(F.col("refers_to")), "\r\n")).otherwise(""),
        F.when(F.col("segments") > 1, "WARC-Segment-Number: 1\r\n").otherwise(""),
    )
    later = text(
        "WARC-Type: continuation\r\nWARC-Record-ID: ", F.regexp_replace("id", ">$", F.concat(F.lit(":"), F.col("k").cast("string"), F.lit(">"))), "\r\nWARC-Segment-Origin-ID: ", F.col("id"), "\r\nWARC-Segment-Number: ", F.col("k").cast("string"), "\r\n",
        F.when(F.col("k") == F.col("segments"), text("WARC-Segment-Total-Length: ", total.cast("string"), "\r\n")).otherwise(""),
    )
    made = parts.select(F.when(F.col("k") == 1, first).otherwise(later).alias("head"), block.alias("block"))
    head = text("WARC/1.1\r\n", F.col("head"), f"WARC-Date: {date}\r\nContent-Length: ", F.length("block").cast("string"), "\r\n\r\n")
    return made.select(F.concat(head.cast("binary"), F.col("block"), F.lit(b"\r\n\r")).cast("string").alias("line"))


def write_warc(pages: DataFrame, path: str, **options) -> None:
    """Write an archive folder of gzip-compressed files, each of whole records in order, with Spark's own writer.

    One record for each row: the row with the largest page_id of those with equal payloads of at least
    `least_bytes` bytes is a response, the others are revisits of it; smaller payloads are all responses.
    Null payloads are empty ones, equal to each other. A null url is left out; a null page_id is written
    as such, and is a response only if no other row has its payload. Rows that repeat page_id and
    payload are all written alike. Columns of other names are ignored. Options: see record_lines().
    """
    record_lines(pages, **options).write.option("lineSep", "\n").option("compression", "gzip").text(path)


def _parse(chunk_bytes: int, with_data: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int64()), ("chunk_bytes", pa.int64()), ("digest_so_far", pa.string()), ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_()), ("data", pa.binary())])
        out: list[tuple] = []
        record: dict = {}  # of the record that is being read, over its continuations
        head: dict[str, str] = {}
        state, need, held = "between", 0, bytearray()

        def page(urn: str | None) -> int | None:
            part = urn.split(":")[2] if urn else "null"
            return None if part == "null" else int(part)

        def emit(last: bool) -> None:
            declared = record["digest"]
            so_far = base64.b32encode(record["sha"].copy().digest()).decode()
            revisit = record["type"] == "revisit"
            total = record["http_length"] if revisit else record["n"]
            out.append((page(record["id"]), record["id"], record["type"], page(record["refers"]), record["chunk"], len(held), so_far, last, total if last else None, (declared if revisit else so_far) if last else None, revisit or (so_far == declared and record["n"] == record["http_length"]) if last else None, bytes(held) if with_data else None))
            record["chunk"] += 1
            held.clear()

        def payload(data: bytes) -> None:
            at = 0
            while at < len(data):
                if len(held) == chunk_bytes:
                    emit(False)
                piece = data[at : at + chunk_bytes - len(held)]
                held.extend(piece)
                record["sha"].update(piece)
                record["n"] += len(piece)
                at += len(piece)

        for batch in it:
            for value in batch.column(0):
                line = value.as_py() + b"\n"
                if state == "between":
                    if line.startswith(b"WARC/"):
                        state, head = "head", {}
                elif state == "head":
                    if line != b"\r\n":
                        name, _, v = line.decode().partition(":")
                        head[name.lower()] = v.strip()
                        continue
                    need = int(head["content-length"])
                    if head["warc-type"] == "continuation":
                        if record.get("id") != head["warc-segment-origin-id"].strip("<>"):
                            raise ValueError(f"{head['warc-record-id']} does not follow its record")
                        record["open"] = "warc-segment-total-length" not in head
                        state = "payload"
                    else:
                        record = {"id": head["warc-record-id"].strip("<>"), "type": head["warc-type"], "refers": head.get("warc-refers-to", "").strip("<>"), "digest": head["warc-payload-digest"].partition(":")[2], "sha": hashlib.sha1(), "n": 0, "chunk": 0, "http_length": 0, "open": "warc-segment-number" in head}
                        state = "http"
                elif state == "http":
                    need -= len(line)
                    if line.lower().startswith(b"content-length:"):
                        record["http_length"] = int(line.partition(b":")[2])
                    if line == b"\r\n":
                        state = "payload"
                else:
                    payload(line[:need])
                    rest, need = line[need:], max(0, need - len(line))
                    if need == 0 and rest:
                        if rest != b"\r\n":
                            raise ValueError(f"{record['id']} is longer than declared")
                        if not record["open"]:
                            emit(True)
                        state = "between"
                if len(out) >= 1000 or (with_data and len(out) * chunk_bytes > 1 << 24):
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)

    return run


def read_warc(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunked record table of an archive folder: a row for each record and chunk number (see CHUNKS).

    Files are read line by line and records parsed as a stream, so a task holds one chunk and never a
    whole payload; compressed files aren't split, so their records and continuations come in order.
    digest_so_far is the digest of the payload up to the end of the chunk. The last chunk of a record has
    the whole payload's length and digest, and whether they are as the record declares. A record without
    payload has one empty chunk. A revisit's length and digest are those that it declares.
    """
    ship(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("line"))
    return lines.mapInArrow(_parse(chunk_bytes, with_data), CHUNKS)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    write_warc(read(spark, sf_dir, "pages"), path)
    records = read_warc(spark, path, with_data=False).where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
    out = cut(records)
    remove_folder(spark, path)
    return out


def _base32(hex_sql: str) -> str:
    group = lambda i: f"('0x' || substr({hex_sql}, {5 * i + 1}, 5))::INTEGER"
    return " || ".join(f"substr('{BASE32}', (({group(i)} >> {s}) & 31) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))


QUERIES = {"op3_warc": op3_warc}
ORACLES = {
    "op3_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
        SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_base32("h")} AS payload_digest,
               CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to, true AS intact
        FROM p"""
}
