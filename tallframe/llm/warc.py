"""WARC archives with revisit resolution.

Headers (id, payload digest, size) are shuffled by digest; the smallest id of
each digest is the response and the others become revisit records that refer
to it, with fresh headers.  Tasks write WARC/1.1 files, a gzip member for each
record, under names of their own; a manifest lists the files of the tasks that
finished, so retried tasks leave nothing that is read.

Reading streams the files of the manifest record by record (payload text may
hold anything, separators too), checks digests, and joins revisits to responses
by the id they refer to.

Nulls: a null payload is the empty one; a null id is kept, never becomes a
response that others refer to, and comes back null.  Payloads under
``min_revisit`` bytes are always responses.  Repeated ids: every row stays a
record.  Very long payloads are written whole; a task holds one record and a
batch of rows.  An empty table gives no records and an empty result.  Only key,
payload and url are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bit_map, mark_hits, materialize, new_path, open_folder

END = b"\r\n\r\n"
URN = "urn:tallframe:page:"
MIN_REVISIT = 100
#: Bytes of an archive file, about.
FILE_BYTES = 64_000_000


def headers(pages: DataFrame, key: str = "page_id", payload: str = "html") -> DataFrame:
    """key, payload_digest, payload_bytes: all that revisit resolution shuffles."""
    data = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    return pages.select(
        F.col(key).alias("key"), F.sha2(data, 256).alias("payload_digest"), F.octet_length(data).cast("long").alias("payload_bytes")
    )


def resolve(heads: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """payload_digest, response: the id that others of that digest refer to,
    only for digests that occur more than once.  Grouped with partial sums, so
    a payload that a third of the pages share costs one row per task."""
    return (
        heads.where(F.col("payload_bytes") >= min_revisit)
        .groupBy("payload_digest").agg(F.min("key").alias("response"), F.count("*").alias("n"))
        .where("n > 1 and response is not null").drop("n")
    )


def _record(kind: str, key: str | None, digest: str, refers: str | None, url: str | None, body: bytes) -> bytes:
    """One WARC record with its two closing line ends."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = http + b"\r\n" if kind == "revisit" else http + b"Content-Length: %d\r\n\r\n" % len(body) + body
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(key)}", "WARC-Target-URI: " + re.sub(r"[\r\n]", " ", url or ""),
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + END + block + END


def _urn(key: str | None) -> str:
    return f"<{URN}{key or ''}>"


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", payload: str = "html", url: str | None = "url") -> DataFrame:
    """Write one record per row of ``pages``; returns the manifest (file), a
    table.  Payloads stay where they are but for those of repeated digests that
    are responses; revisits are made from headers.  Bit maps of fixed size tell
    which these are: false positives cost a shuffle, but no result."""
    digest = F.sha2(F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8"), 256)
    target = F.col(url) if url and url in pages.columns else F.lit("")
    rows = pages.select(
        F.col(key).cast("string").alias("key"), F.col(key).alias("raw"), digest.alias("payload_digest"), target.alias("url"),
        F.coalesce(F.col(payload), F.lit("")).alias("body"),
    )
    rows = rows.withColumn("h", F.xxhash64("payload_digest")).withColumn("hk", F.xxhash64("payload_digest", "key"))
    again = materialize(resolve(headers(pages, key, payload)), "repeated")
    repeated = mark_hits(rows, "h", bit_map(again.select(F.xxhash64("payload_digest").alias("h"))), "hit")
    is_revisit = F.col("response").isNotNull() & ~F.col("raw").eqNullSafe(F.col("response"))
    heads = materialize(repeated.where("hit").drop("body").join(again, "payload_digest", "left"), "hit-heads")
    marked = mark_hits(repeated, "hk", bit_map(heads.where(~is_revisit).select(F.col("hk").alias("h"))), "full")
    whole = marked.where("hit and full").join(again, "payload_digest", "left").where(~is_revisit)
    cols = ["key", "payload_digest", F.lit(None).cast("string").alias("refers"), "url", "body"]
    records = (
        marked.where("not hit").select(*cols).unionByName(whole.select(*cols))
        .unionByName(heads.where(is_revisit).select("key", "payload_digest", F.col("response").cast("string").alias("refers"), "url", F.lit(None).cast("string").alias("body")))
    )

    def run(batches):
        from pyspark import TaskContext

        fs, base = open_folder(folder)
        fs.create_dir(base, recursive=True)
        out, size, names = None, 0, []
        for b in batches:
            # columns are taken one row at a time: payloads of a batch aren't unpacked together
            for k, d, r, u, body in zip(*(b.column(i) for i in range(5))):
                if out is None:
                    names.append(f"part-{TaskContext.get().partitionId():06d}-{len(names):04d}-{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{base}/{names[-1]}"), 0
                kind, text = ("revisit", b"") if r.is_valid else ("response", body.as_buffer().to_pybytes() if body.is_valid else b"")
                record = _record(kind, k.as_py(), d.as_py(), r.as_py(), u.as_py(), text)
                c = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip member of its own
                size += out.write(c.compress(record) + c.flush())
                if size >= FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["file"])

    return materialize(records.mapInArrow(run, "file string"), "warc-files")


def parse(chunks):
    """(headers, block) of each record of an archive that comes in chunks of
    bytes: plain, or gzip members of any number of records.  One record is held."""
    data, at = bytearray(), 0

    def plain():
        member = None
        for chunk in chunks:
            if member is None and chunk[:2] != b"\x1f\x8b":
                yield chunk
                continue
            while chunk:
                member = member or zlib.decompressobj(31)
                yield member.decompress(chunk)
                chunk = member.unused_data
                if member.eof:
                    member = zlib.decompressobj(31)

    source = plain()

    def need(found) -> bool:
        """Read on until ``found()`` holds or the archive ends."""
        while not found():
            more = next(source, None)
            if more is None:
                return False
            data.extend(more)
        return True

    while True:
        del data[:at]
        at = 0
        if not need(lambda: data.find(END) >= 0):
            if data.strip():
                raise ValueError("the archive ends within a record")
            return
        stop = data.index(END)
        first, *lines = data[:stop].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at {first[:40]!r}")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        start = stop + 4
        end = start + int(head["Content-Length"])
        if not need(lambda: len(data) >= end + 4):
            raise ValueError("the archive ends within a record")
        yield head, bytes(data[start:end])
        at = end + 4


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """key (string, null if the record had none), record_type, payload_bytes,
    payload_digest, refers_to (string) of the archives in ``manifest(file)``.
    Size and digest of responses are recomputed from the stored payload."""
    names = ["key", "record_type", "payload_bytes", "payload_digest", "refers_to"]

    def run(batches):
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        fs, base = open_folder(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                out = []
                with fs.open_input_stream(f"{base}/{name}") as f:
                    for head, raw in parse(iter(lambda: f.read(1 << 20), b"")):
                        ident = head["WARC-Record-ID"][len(URN) + 1 : -1]
                        refers, kind = head.get("WARC-Refers-To"), head["WARC-Type"]
                        digest, size = head["WARC-Payload-Digest"].removeprefix("sha256:"), None
                        if kind == "response":
                            body = raw[raw.index(END) + 4 :]
                            size = len(body)
                            if hashlib.sha256(body).hexdigest() != digest:
                                raise ValueError(f"record {ident} doesn't hold the payload of its digest")
                        out.append((ident or None, kind, size, digest, refers and refers[len(URN) + 1 : -1]))
                        if len(out) >= 5000:
                            yield batch(out)
                            out = []
                if out:
                    yield batch(out)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number given here isn't coalesced: rows are few, files large
    return manifest.repartition(n, "file").mapInArrow(run, "key string, record_type string, payload_bytes long, payload_digest string, refers_to string")


def join_revisits(records: DataFrame) -> DataFrame:
    """Records with the payload size of each revisit taken from the response it
    refers to; every revisit must find its response."""
    originals = records.where("record_type = 'response'").select(
        F.col("key").alias("refers_to"), F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("n")
    )
    back = records.where("record_type = 'revisit'")
    # repeated ids may give a response twice: one is enough
    originals = originals.join(back.select("refers_to").distinct(), "refers_to", "left_semi").groupBy("refers_to", "d").agg(F.min("n").alias("n"))
    found = back.join(originals, (back["refers_to"] == originals["refers_to"]) & (back["payload_digest"] == originals["d"]), "left")
    size = F.coalesce("n", F.raise_error(F.concat(F.lit("no response for "), back["key"])).cast("long"))
    fixed = found.select(back["key"], "record_type", size.alias("payload_bytes"), "payload_digest", back["refers_to"])
    return records.where("record_type = 'response'").unionByName(fixed)


def round_trip(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url") -> DataFrame:
    """Write deduplicated archives for ``pages`` and return what reading them
    back gives: key, payload_bytes, payload_digest, record_type, refers_to."""
    folder = new_path(pages.sparkSession, "warc")
    manifest = write_archives(pages, folder, key, payload, url)
    kind = pages.schema[key].dataType
    records = materialize(read_archives(manifest, folder), "warc-heads")
    return join_revisits(records).select(
        F.col("key").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
