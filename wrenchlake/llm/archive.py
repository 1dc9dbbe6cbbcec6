"""Content-addressed WARC archive.

An archive is two Parquet tables. `payloads` holds each distinct payload once, under the SHA-256 of its bytes and its
length. `headers` holds, per record, the exact header bytes and the address of its payload. Nothing else is stored:
the original record is header + payload + the closing line breaks, got back by joining the two on the address. Reading verifies
every payload against its address and against the digest and length that the header states, and fails on a mismatch.

Which record of a group of equal payloads is the response is decided by an aggregation on the address, which combines on
the map side; the payload bytes themselves are never shuffled to find copies. A copied payload may be as
frequent as it likes: addresses with many records are joined by broadcast, of which there are at most `HOT_KEYS`.

Null html is an empty payload, which has a digest like any other. A null url leaves the target header out. Rows with a null
page_id get a record without an id; copies of one row each get a record, and of equal ids in a group the id names them all.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenchlake.llm.common import arrow_pass, checked_broadcast, join_counted
from wrenchlake.session import new_shared_folder, stage

END = b"\r\n\r\n"
DATE = "2025-01-01T00:00:00Z"
#: From how many payload bytes on a record may be a revisit.
LEAST_BYTES = 0


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_bytes(
    page_id: int | None, url: str | None, kind: str, digest: str, length: int, refers_to: int | None
) -> bytes:
    """The header block of a record, without the empty line that ends it.

    Line breaks in a url would end its header line early, so they are percent-encoded.
    """
    lines = ["WARC/1.1", f"WARC-Type: {kind}"]
    if page_id is not None:
        lines.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    lines.append(f"WARC-Date: {DATE}")
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    lines += ["Content-Type: text/html; charset=utf-8", f"WARC-Payload-Digest: sha1:{digest}"]
    lines.append(f"Content-Length: {0 if kind == 'revisit' else length}")
    return "\r\n".join(lines).encode()


def parse_header(raw: bytes) -> dict[str, str]:
    lines = raw.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC header")
    return dict(line.split(": ", 1) for line in lines[1:])


def _digests(pages: DataFrame) -> DataFrame:
    def rows(batch: pa.RecordBatch) -> dict[str, object]:
        html = [(x or "").encode() for x in batch.column(batch.schema.get_field_index("html")).to_pylist()]
        return {
            "page_id": batch.column(batch.schema.get_field_index("page_id")),
            "url": batch.column(batch.schema.get_field_index("url")),
            "address": [hashlib.sha256(x).digest() for x in html],
            "digest": [sha1_base32(x) for x in html],
            "length": [len(x) for x in html],
        }

    schema = "page_id long, url string, address binary, digest string, length long"
    return arrow_pass(pages.select("page_id", "url", "html"), rows, schema)


def write_archive(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> None:
    """Write a record per page to `folder`/headers and each distinct payload once to `folder`/payloads."""
    records = stage(_digests(pages))
    owners = stage(
        records.groupBy("address").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("copies"))
    )
    joined = join_counted(records, owners, "address", "copies", records.count())
    revisit = (F.col("length") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("owner"))
    typed = joined.withColumn("kind", F.when(revisit, "revisit").otherwise("response"))

    def rows(batch: pa.RecordBatch) -> dict[str, object]:
        got = batch.to_pydict()
        names = ("page_id", "url", "kind", "digest", "length", "owner")
        return {
            "page_id": got["page_id"],
            "header": [header_bytes(*x) for x in zip(*[got[n] for n in names])],
            "address": got["address"],
            "stored_bytes": got["length"],
        }

    schema = "page_id long, header binary, address binary, stored_bytes long"
    arrow_pass(typed, rows, schema).write.parquet(f"{folder}/headers")

    # A payload is written by its owner. Pages that own none have an address with copies; only these are listed.
    known = F.col("page_id").isNotNull()
    extra = stage(typed.filter(known & (F.col("page_id") != F.col("owner"))).select(F.col("page_id").alias("__copy")).distinct())
    owned = pages.filter(known)
    if not extra.isEmpty():
        owned = owned.join(extra, F.col("page_id") == F.col("__copy"), "left_anti")

    def payload(batch: pa.RecordBatch) -> dict[str, object]:
        html = [(x or "").encode() for x in batch.column(batch.schema.get_field_index("html")).to_pylist()]
        return {"address": [hashlib.sha256(x).digest() for x in html], "payload": html}

    # An id given more than once, or none, does not tell which of its rows is a copy: what such an owner has to write is told by address.
    several = stage(records.filter(known).groupBy("page_id").count().filter("count > 1").select(F.col("page_id").alias("__id")))
    own_id = F.col("page_id") == F.col("__id")
    stored = "address binary, payload binary"
    found = arrow_pass(owned.join(checked_broadcast(several), own_id, "left_anti").select("html"), payload, stored)
    if not several.isEmpty() or not records.filter(~known).isEmpty():
        unclear = pages.filter(~known).unionByName(pages.join(checked_broadcast(several), own_id, "left_semi"))
        theirs = owners.filter("owner is null").unionByName(
            owners.join(checked_broadcast(several), F.col("owner") == F.col("__id"), "left_semi")
        )
        once = arrow_pass(unclear.select("html"), payload, stored).dropDuplicates(["address"])
        found = found.unionByName(once.join(theirs.select(F.col("address").alias("__a")), F.col("address") == F.col("__a"), "left_semi"))
    found.write.parquet(f"{folder}/payloads")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """The records as they were: page_id, header, payload (the full one, also for revisits), record (bytes as exchanged),
    and what header and payload say: payload_bytes, payload_digest, record_type, refers_to."""
    headers = spark.read.parquet(f"{folder}/headers").withColumnRenamed("stored_bytes", "__stored")
    payloads = spark.read.parquet(f"{folder}/payloads")

    def rows(batch: pa.RecordBatch) -> dict[str, object]:
        got = batch.to_pydict()
        out: dict[str, list] = {n: [] for n in ("record", "payload_bytes", "payload_digest", "record_type", "refers_to")}
        for header, payload, address, stored in zip(got["header"], got["payload"], got["address"], got["__stored"]):
            fields = parse_header(header)
            digest = sha1_base32(payload) if payload is not None else ""
            if payload is None or len(payload) != stored or hashlib.sha256(payload).digest() != address:
                raise ValueError("a payload does not have its address")
            kind = fields["WARC-Type"]
            sent = payload if kind == "response" else b""
            if fields["WARC-Payload-Digest"] != f"sha1:{digest}" or int(fields["Content-Length"]) != len(sent):
                raise ValueError("a payload does not fit its header")
            to = fields.get("WARC-Refers-To")
            out["record"].append(header + END + sent + END)
            out["payload_bytes"].append(len(payload))
            out["payload_digest"].append(digest)
            out["record_type"].append(kind)
            out["refers_to"].append(int(to.removeprefix("<urn:page:").removesuffix(">")) if to else None)
        return out | {n: got[n] for n in ("page_id", "header", "payload")}

    schema = (
        "page_id long, header binary, payload binary, record binary, payload_bytes long, payload_digest string,"
        " record_type string, refers_to long"
    )
    return arrow_pass(headers.join(payloads, "address", "left"), rows, schema)


def op1_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_shared_folder(spark)
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archive(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
