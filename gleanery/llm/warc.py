"""WARC archives with the index written first-hand.

Writing: every task writes one gzip-per-record archive into the shared folder and returns, for each
record, archive, offset, length, URL, digest and page; these rows become the index, a table. A retried
task writes a new file; only files named in the committed index count. Records with equal payloads
(SHA-256 and length) refer to the response with the smallest page id.

Reading: the selected index rows are dealt by archive and stripe and sorted by offset; neighbouring
ranges are coalesced into one read. Each record is parsed and its payload digest verified.

Defined results: a null html is an empty payload; a null URL leaves the header out; control characters
in a URL are percent-encoded; repeated rows with the smallest page id of their payload are each a
response; an empty table gives an empty index; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fresh_path, materialize, tune

#: Bytes of an archive that one reading task takes at most, bytes between two ranges that are read
#: along rather than skipped, and bytes of one coalesced read.
STRIPE = 64 << 20
GAP = 64 << 10
READ = 8 << 20

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:gleanery:page")


def sha1_base32(payload: bytes) -> str:
    """The digest as WARC writes it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(page))}>"


def build_record(page: object, url: str | None, payload: bytes, digest: str, refers_to: object | None) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page)}", "WARC-Date: 2020-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {page}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=1, mtime=0)


def parse_record(member: bytes) -> dict:
    """Headers, payload and payload length of a gzip member; raises if lengths or digests disagree."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"broken record {fields.get('WARC-Record-ID')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != stated or sha1_base32(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return {"fields": fields, "payload": payload, "payload_bytes": stated, "digest": digest}


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write every row as a record and return the stored index: page, url, digest, record_type, archive, offset, length."""
    spark = pages.sparkSession
    tune(spark)
    folder = fresh_path(spark, "warc")
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    key = [F.unhex(F.sha2(F.col("html").cast("binary"), 256)).alias("sha"), F.octet_length("html").alias("bytes")]
    first = rows.filter(F.octet_length("html") >= least_bytes).groupBy(*key).agg(F.min("page").alias("first"))
    dealt = rows.select("page", "url", "html", *key).join(first, ["sha", "bytes"], "left").select("page", "url", "html", "first")
    kind = dict(rows.dtypes)["page"]
    schema = f"page {kind}, url string, digest string, record_type string, archive string, offset long, length long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, out, path, at = None, None, None, 0
        try:
            for b in batches:
                if b.num_rows and out is None:
                    store, base = fs.FileSystem.from_uri(folder)
                    store.create_dir(base, recursive=True)
                    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    path, out = f"{folder}/{name}", store.open_output_stream(f"{base}/{name}", compression=None)
                found: dict[str, list] = {"url": [], "digest": [], "record_type": [], "archive": [], "offset": [], "length": []}
                for page, url, text, first_page in zip(*(c.to_pylist() for c in b.columns)):
                    payload = text.encode()
                    digest, refers = sha1_base32(payload), first_page if first_page is not None and first_page != page else None
                    member = build_record(page, url, payload, digest, refers)
                    out.write(member)
                    for k, v in (("url", url), ("digest", digest), ("record_type", "response" if refers is None else "revisit"), ("archive", path), ("offset", at), ("length", len(member))):
                        found[k].append(v)
                    at += len(member)
                yield pa.record_batch([b.column(0), *(pa.array(v, pa.int64() if k in ("offset", "length") else pa.string()) for k, v in found.items())], names=["page", *found])
        finally:
            if out is not None:
                out.close()

    return materialize(dealt.mapInArrow(write, schema), "warc-index")


def read_records(index: DataFrame, payloads: bool = False) -> DataFrame:
    """Read the records of the selected index rows: page, payload_bytes, payload_digest, record_type, refers_to and, on demand, payload."""
    tune(index.sparkSession)
    kind = dict(index.dtypes)["page"]
    schema = f"page {kind}, payload_bytes long, payload_digest string, record_type string, refers_to string" + (", payload binary" if payloads else "")
    stripe = F.floor(F.col("offset") / STRIPE)
    dealt = index.select("page", "archive", "offset", "length", "digest", stripe.alias("stripe")).repartition("archive", "stripe").sortWithinPartitions("archive", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        name, handle = None, None
        for b in batches:
            page, archive, offset, length, digest = (b.column(i).to_pylist() for i in range(5))
            found: dict[str, list] = {"payload_bytes": [], "payload_digest": [], "record_type": [], "refers_to": [], "payload": []}
            i = 0
            while i < len(page):
                j = i + 1  # the run i..j-1 is one read
                while j < len(page) and archive[j] == archive[i] and offset[j] - (offset[j - 1] + length[j - 1]) <= GAP and offset[j] + length[j] - offset[i] <= READ:
                    j += 1
                if archive[i] != name:
                    name = archive[i]
                    store, path = fs.FileSystem.from_uri(name)
                    handle = store.open_input_file(path)
                chunk = io.BytesIO(handle.read_at(offset[j - 1] + length[j - 1] - offset[i], offset[i])).getbuffer()
                for k in range(i, j):
                    at = offset[k] - offset[i]
                    record = parse_record(bytes(chunk[at : at + length[k]]))
                    if record["digest"] != digest[k] or record["fields"]["X-Page-ID"] != str(page[k]):
                        raise ValueError(f"{name} at {offset[k]} holds another record than the index says")
                    found["payload_bytes"].append(record["payload_bytes"])
                    found["payload_digest"].append(record["digest"])
                    found["record_type"].append(record["fields"]["WARC-Type"])
                    found["refers_to"].append(record["fields"].get("X-Refers-To-Page-ID"))
                    found["payload"].append(record["payload"])
                i = j
            types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
            columns = [pa.array(v, t) for v, t in zip(found.values(), types)]
            yield pa.record_batch([b.column(0), *columns][: 6 if payloads else 5], names=["page", *found][: 6 if payloads else 5])

    return dealt.mapInArrow(read, schema).withColumn("refers_to", F.col("refers_to").cast(kind))
