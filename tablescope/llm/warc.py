"""WARC archives, index first.

Writing puts every record into an archive (one gzip member each) in the shared folder and
returns one index row a record: file, offset, length, URL, digest, type. Reading selects
index rows, sorts them by file and offset, and coalesces neighbouring byte ranges into few
reads. Records with equal payloads are written once; the others revisit the one with the
smallest page id and take their payload's length from it when read.

Archives of a lost or repeated task attempt have names of their own and are in no index.
Files are reached through pyarrow's file systems by the URI of the folder, so a cluster's
store works like a local folder.

Defined results: null html is an empty payload, null URLs leave the header out; repeated
rows each give a record, and those of a response's page are responses too; a null page id
counts as the largest and is referred to by none.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import tidy, tidy_group
from .common import MAX_ID, partitions, shared_dir, stored

#: An archive is closed beyond ROLL bytes; reads join ranges at most GAP bytes apart up to READ bytes.
ROLL, GAP, READ = 64 << 20, 64 << 10, 8 << 20
DATE = "1970-01-01T00:00:00Z"
INDEX = "file string, offset long, length long, url string, payload_digest string, payload_bytes long, record_type string, page_id long, refers_to long"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head only."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(body)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
    number = lambda k: int(fields[k]) if k in fields else None
    return {"record_type": fields["WARC-Type"], "url": fields.get("WARC-Target-URI"), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "page_id": number("X-Page-ID"), "refers_to": number("X-Refers-To-Page-ID"), "payload": payload}


def decided(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload and ``refers_to``: the smallest page id with an equal payload of
    at least ``min_bytes`` bytes, null where it is the row's own."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("key", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    first = own.groupBy("key", "size").agg(F.min(F.coalesce("page_id", F.lit(MAX_ID))).alias("first")).where(F.col("first") < MAX_ID)
    other = (F.col("size") >= min_bytes) & (F.col("first") < F.coalesce("page_id", F.lit(MAX_ID)))
    return own.join(first, ["key", "size"], "left").select("page_id", "url", "payload", F.when(other, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write the records of ``pages`` and return their index, itself written as a table."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"

    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page, url, payload, first in zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "payload", "refers_to"))):
                    if out is None or at > ROLL:
                        if out is not None:
                            out.close()
                        name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    digest = digest32(payload)
                    member = gzip.compress(record(page, url, payload, digest, first), 6, mtime=0)
                    out.write(member)
                    rows.append((f"{folder}/{name}", at, len(member), url, digest, len(payload), "response" if first is None else "revisit", page, first))
                    at += len(member)
                cols = list(zip(*rows)) or [()] * 9
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["file", "offset", "length", "url", "payload_digest", "payload_bytes", "record_type", "page_id", "refers_to"])
        finally:
            if out is not None:
                out.close()

    return stored(decided(pages, min_bytes).mapInArrow(tidy(run), INDEX), "warc-index")


def ranges(offset: np.ndarray, length: np.ndarray, gap: int = GAP, most: int = READ) -> list[tuple[int, int]]:
    """Row ranges of sorted records that one read fetches each."""
    out, i = [], 0
    end = offset + length
    for j in range(1, len(offset) + 1):
        if j == len(offset) or offset[j] - end[j - 1] > gap or end[j] - offset[i] > most:
            out.append((i, j))
            i = j
    return out


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the selected ``index`` rows: what their headers say, and for responses
    the payload, its length and its digest, recomputed from what was read."""
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_digest": pa.string(), "payload_bytes": pa.int64()}
    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long" + ", payload binary" * with_payload
    if with_payload:
        kinds["payload"] = pa.binary()

    def of_file(group: pa.Table) -> pa.Table:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(group.column("file")[0].as_py())
        order = np.argsort(group.column("offset").to_numpy(), kind="stable")
        offset, length = group.column("offset").to_numpy()[order], group.column("length").to_numpy()[order]
        rows = {k: [] for k in kinds}
        with store.open_input_file(path) as f:
            for i, j in ranges(offset, length):
                data = f.read_at(int(offset[j - 1] + length[j - 1] - offset[i]), int(offset[i]))
                for k in range(i, j):
                    at = int(offset[k] - offset[i])
                    got = parse(zlib.decompress(data[at : at + int(length[k])], 31))
                    if got["record_type"] == "response":
                        digest = digest32(got["payload"])
                        if digest != got["payload_digest"]:
                            raise ValueError(f"{path} at {offset[k]}: payload digest is {digest}, header says {got['payload_digest']}")
                        got["payload_bytes"] = len(got["payload"])
                    else:
                        got["payload_bytes"] = got["payload"] = None
                    for name, values in rows.items():
                        values.append(got[name])
        return pa.table({k: pa.array(v, kinds[k]) for k, v in rows.items()})

    # the rows are small but what they read is not: no merging of partitions by size
    spread = index.select("file", "offset", "length").repartition(partitions(index.sparkSession), "file")
    return spread.groupBy("file").applyInArrow(tidy_group(of_file), schema)


def resolved(records: DataFrame) -> DataFrame:
    """``records`` with the length of each revisit's payload, from the response it refers to."""
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("full")).distinct()
    return records.select(cols).join(responses, ["refers_to", "payload_digest"], "left").select("page_id", F.coalesce("payload_bytes", "full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def warc_report(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages, read every record back and describe it."""
    records = stored(read_records(write_archives(pages, min_bytes=min_bytes), with_payload=False), "warc-records")
    return resolved(records)
