"""WARC archives and revisit resolution.

Headers (id, payload digest, size) are shuffled by digest; of each group of equal payloads one record stays a response
and the others become revisits of it. The verdicts, which name revisits only, are a table: where the optimizer finds it
small it is broadcast, else payloads are shuffled once, by (id, digest), which no page is hot in. Archives are written once, in that form, with fresh headers:
one gzip member per record, files rotated by size, in the folder that the cluster shares. Every attempt of a task writes
files of its own, and only those that the committed manifest names are read; a lost executor leaves at most unused files.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, stash, text_of

#: Payloads shorter than this are always kept as responses.
MIN_REVISIT = 1000
FILE_BYTES = 256 << 20
READ_BYTES = 1 << 20
DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def record(kind: str, record_id: str, uri: str | None, digest: str | None, block: bytes, more: tuple = ()) -> bytes:
    """One record, not compressed. Line breaks in a URI are dropped."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE)]
    if uri:
        head.append(("WARC-Target-URI", uri.replace("\r", "").replace("\n", "")))
    if digest:
        head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    head += [*more, ("Content-Type", "application/http; msgtype=response" if digest else "application/warc-fields"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    made = zlib.compressobj(1, zlib.DEFLATED, 31)
    return made.compress(data) + made.flush()


def record_id(page_id: int | None, digest: str) -> str:
    return f"urn:page:{'' if page_id is None else page_id}:{digest}"


class Records:
    """Records of an archive, read in pieces: (headers, block)."""

    def __init__(self, stream):
        self.stream, self.unpack, self.data, self.raw, self.ended = stream, zlib.decompressobj(31), bytearray(), b"", False

    def fill(self) -> bool:
        while not self.ended:
            if not self.raw:
                self.raw = self.stream.read(READ_BYTES)
                if not self.raw:
                    self.ended = True
                    return False
            if self.unpack.eof:
                self.unpack = zlib.decompressobj(31)
            got = self.unpack.decompress(self.raw, READ_BYTES)
            self.raw = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
            if got:
                self.data += got
                return True
        return False

    def __iter__(self):
        while True:
            while (end := self.data.find(b"\r\n\r\n")) < 0:
                if not self.fill():
                    return
            lines = self.data[:end].decode().split("\r\n")
            head = dict(x.split(": ", 1) for x in lines[1:])
            size = int(head["Content-Length"])
            while len(self.data) < end + 8 + size:
                if not self.fill():
                    raise ValueError("an archive ends within a record")
            block = bytes(self.data[end + 4 : end + 4 + size])
            del self.data[: end + 8 + size]
            yield head, block


def resolve(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", min_bytes: int = MIN_REVISIT) -> DataFrame:
    """(id, digest, original) of the records that shall be revisits.

    Of equal payloads of min_bytes or more the record with the largest id is the original. Rows that repeat an id and
    its payload are the same record. A null id is below all others.
    """
    payload = text_of(html_col).cast("binary")
    heads = pages.select(F.col(id_col).cast("long").alias("id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= min_bytes)
    originals = heads.groupBy("digest").agg(F.max("id").alias("original"), F.count("*").alias("copies")).where("copies > 1 AND original IS NOT NULL")
    originals = stash(originals.select("digest", "original"), "warc-originals")  # a table, so that a join on a hot digest can be split
    return heads.join(originals, "digest").where("NOT id <=> original").select("id", "digest", "original").distinct()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes one record per row and returns the manifest (path, records). A null payload is an empty one."""
    payload = text_of(html_col).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.sha1(payload).alias("digest"), payload.alias("payload"))
    revisits = stash(resolve(pages, id_col, html_col, min_bytes), "warc-revisits").withColumnsRenamed({"id": "r_id", "digest": "r_digest"})
    same = F.col("id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest"))
    rows = rows.join(revisits, same, "left").select("id", "url", "digest", "original", F.when(F.col("original").isNull(), F.col("payload")).alias("payload"))

    def run(batches):
        from pyarrow import fs

        out, path, written, count = None, None, 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, digest, original, payload = (c[i].as_py() for c in batch.columns)
                if out is None:
                    path, written, count = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    store, place = fs.FileSystem.from_uri(path)
                    store.create_dir(place.rpartition("/")[0])
                    out = store.open_output_stream(place, compression=None)
                    out.write(member(record("warcinfo", f"urn:uuid:{uuid.uuid4()}", None, None, b"format: WARC File Format 1.1\r\n")))
                more = (("X-Page-Id", "" if page is None else str(page)),)
                if original is None:
                    data = record("response", record_id(page, digest), url, digest, HTTP + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload, more)
                else:
                    more += (("WARC-Refers-To", f"<{record_id(original, digest)}>"), ("WARC-Profile", PROFILE))
                    data = record("revisit", record_id(page, digest), url, digest, HTTP + b"\r\n", more)
                data = member(data)
                out.write(data)
                written, count = written + len(data), count + 1
                if written >= file_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [path], "records": [count]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [count]})

    return stash(rows.mapInArrow(run, "path string, records long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """(record_id, page_id, record_type, uri, payload_digest, payload_bytes, refers_id) of all records but warcinfo.

    Payload and digest of a response are taken from the block itself; a response that contradicts its header is an error.
    """
    names = ["record_id", "page_id", "record_type", "uri", "payload_digest", "payload_bytes", "refers_id"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    def run(batches):
        from pyarrow import fs

        rows = []
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_stream(place, compression=None) as stream:
                    for head, block in Records(stream):
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        digest, n = head["WARC-Payload-Digest"].removeprefix("sha1:"), None
                        if head["WARC-Type"] == "response":
                            payload = block[block.index(b"\r\n\r\n") + 4 :]
                            n = len(payload)
                            if hashlib.sha1(payload).hexdigest() != digest:
                                raise ValueError(f"the payload of {head['WARC-Record-ID']} is not what its header says")
                        page = head["X-Page-Id"]
                        rows.append((head["WARC-Record-ID"].strip("<>"), int(page) if page else None, head["WARC-Type"], head.get("WARC-Target-URI"), digest, n, head.get("WARC-Refers-To", "").strip("<>") or None))
                        if len(rows) >= 4096:
                            yield batch_of(rows)
                            rows = []
        if rows:
            yield batch_of(rows)

    spark = manifest.sparkSession
    paths = manifest.select("path").repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path")
    return paths.mapInArrow(run, "record_id string, page_id long, record_type string, uri string, payload_digest string, payload_bytes long, refers_id string")


def resolve_archives(manifest: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to. Revisits take what they lack from the response."""
    records = stash(read_archives(manifest), "warc-records")
    revisits = records.where("record_type = 'revisit'")
    asked = revisits.select("refers_id").distinct()
    originals = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("o_id"), F.col("payload_bytes").alias("o_bytes"), F.col("payload_digest").alias("o_digest"))
    originals = stash(originals.join(asked, "refers_id", "left_semi").dropDuplicates(["refers_id"]), "warc-responses")  # as above
    responses = records.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = revisits.join(originals, "refers_id").select("page_id", F.col("o_bytes").alias("payload_bytes"), F.col("o_digest").alias("payload_digest"), "record_type", F.col("o_id").alias("refers_to"))
    return responses.unionAll(revisits)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Writes deduplicated archives of the pages into the shared folder and resolves what they hold. An empty table gives no rows."""
    folder = new_path(pages.sparkSession, "warc")
    return resolve_archives(write_archives(pages, folder, id_col, url_col, html_col, min_bytes))
