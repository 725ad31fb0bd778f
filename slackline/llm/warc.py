"""WARC archives as a chunked record table.

What each record is, response or revisit, is decided on narrow rows of digests and written first;
only then payloads are shuffled, once, to the records that carry them. A payload travels as rows of
(record id, chunk number, bytes), at most CHUNK bytes a row, cut in the JVM and in order within
their record. Writers stream the rows into one gzip member per record, and readers stream members
back into the same kind of rows, each carrying the byte count and digest up to and including its
chunk; both raise if a whole payload's digest is not the stated one. Neither holds a whole record.
Archives go through pyarrow.fs to the folder that the cluster shares: each task writes a file under
its attempt's name and renames it when it is complete, so a task that is run again replaces its
file.

Of records with equal payloads of at least ``least`` bytes, that of the largest page_id is written
as response and the others as revisit records that refer to it. A record is known by its page_id,
payload digest, url and copy number, so its id doesn't depend on where its row lies.

Defined cases: null html is an empty payload, empty payloads are equal to each other; null url
leaves the header out; a null page_id is less than any other and refers_to may be null for it; of
rows that repeat a page_id with the same payload that of the least url (null last) is the response;
an empty table writes nothing; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slackline.plans.scratch import Scratch

CHUNK = 256 * 1024
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"


def _row_key(*of: F.Column) -> F.Column:
    """A digest of values, null told from any text."""
    return F.md5(F.to_json(F.array(*(F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")) for c in of))))


def _record_id(key: F.Column, copy: F.Column) -> F.Column:
    h = F.md5(F.concat_ws(":", key, copy.cast("string")))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def record_table(pages: DataFrame, scratch: Scratch, least: int = 0) -> DataFrame:
    """key, copies, record_id, page_id, url, n_bytes, sha1, refers_to: a row per record, without payloads."""
    rows = _keyed(pages).groupBy("key", "page_id", "url", "n_bytes", "sha1").agg(F.count("*").alias("copies"))
    rows = scratch.save(rows, "keys")
    last = rows.where(F.col("n_bytes") >= least).groupBy("sha1").agg(F.max("page_id").alias("last_id"), F.sum("copies").alias("n")).where("n > 1")
    first = rows.join(last.select("sha1", "last_id"), "sha1").where("page_id <=> last_id").groupBy("sha1").agg(F.min(F.struct(F.col("url").isNull(), "url", "key")).alias("r"))
    first = scratch.save(first.select("sha1", F.col("r.key").alias("last_key")), "last")
    told = rows.join(first, "sha1", "left").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    revisit = F.col("last_key").isNotNull() & ((F.col("last_key") != F.col("key")) | (F.col("copy") > 0))
    made = told.select(
        "key", "copies", _record_id(F.col("key"), F.col("copy")).alias("record_id"), "page_id", "url", "n_bytes", "sha1",
        F.when(revisit, _record_id(F.col("last_key"), F.lit(0))).alias("refers_to"),
    )
    return scratch.save(made, "records")


def _keyed(pages: DataFrame) -> DataFrame:
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"n_bytes": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload")})
    return rows.withColumn("key", _row_key(F.col("page_id"), F.col("url"), F.col("sha1")))


def chunk_table(pages: DataFrame, scratch: Scratch, least: int = 0, chunk: int = CHUNK) -> DataFrame:
    """``pages(page_id, url, html)`` to record_id, page_id, url, n_bytes, sha1, refers_to, chunk_no, data; refers_to is null for responses.

    A record's chunks are in one partition, side by side and in order.
    """
    records = record_table(pages, scratch, least)
    head = "record_id", "page_id", "url", "n_bytes", "sha1", "refers_to"
    responses, payloads = records.where("refers_to is null"), _keyed(pages).select("key", "payload")
    once = payloads.join(responses.where("copies = 1").select("key", *head), "key")
    repeated = responses.where("copies > 1")
    if not repeated.isEmpty():  # equal rows: their payload is brought together map-side
        again = payloads.join(repeated.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("payload").alias("payload"))
        once = once.unionByName(again.join(repeated.select("key", *head), "key"))
    count = F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / chunk).cast("int"))
    data = F.when(F.col("n_bytes") <= chunk, F.col("payload")).otherwise(F.expr(f"substring(payload, chunk_no * {chunk} + 1, {chunk})"))
    cut = once.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), count - 1))).select(*head, "chunk_no", data.alias("data"))
    return cut.unionByName(records.where("refers_to is not null").select(*head, F.lit(0).alias("chunk_no"), F.lit(b"").alias("data")))


def _base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_head(record_id: str, page_id: int | None, url: str | None, n_bytes: int, sha1: str, refers_to: str | None) -> bytes:
    """The WARC and HTTP headers that come before a payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes
    size = len(http) + (0 if refers_to else n_bytes)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to:
        lines += [f"WARC-Refers-To: <urn:uuid:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{_base32(bytes.fromhex(sha1))}", "Content-Type: application/http; msgtype=response", f"Content-Length: {size}"]
    return "\r\n".join(lines).encode() + CRLF + CRLF + http


def write_archives(chunks: DataFrame, folder: str, scratch: Scratch) -> DataFrame:
    """Writes ``folder``/part-N.warc.gz from chunk rows as ``chunk_table`` gives them; the manifest: file, n_records."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        name, temp = f"{base}/part-{task.partitionId():05d}.warc.gz", f"{base}/_attempt-{task.taskAttemptId()}"
        out = packer = digest = now = None
        n = 0

        def close() -> None:
            if not now[1] and digest.hexdigest() != now[2]:
                raise ValueError(f"the payload of record {now[0]} is not the one that was announced")
            out.write(packer.compress(CRLF + CRLF) + packer.flush())

        for batch in batches:
            for rid, page, url, size, sha1, refers, data in zip(*(batch[c] for c in ("record_id", "page_id", "url", "n_bytes", "sha1", "refers_to", "data")), strict=True):
                if now is None or rid != now[0]:
                    if out is None:
                        store.create_dir(base)
                        out = store.open_output_stream(temp, compression=None)
                    else:
                        close()
                    packer, digest, now, n = zlib.compressobj(3, zlib.DEFLATED, 31), hashlib.sha1(), (rid, refers, sha1), n + 1
                    out.write(packer.compress(record_head(rid, None if pd.isna(page) else int(page), url, int(size), sha1, refers)))
                digest.update(data)
                out.write(packer.compress(data))
        if out is None:
            return
        close()
        out.close()
        store.move(temp, name)
        yield pd.DataFrame({"file": [name.rsplit("/", 1)[1]], "n_records": [n]})

    return scratch.save(chunks.mapInPandas(run, "file string, n_records long"), "manifest")


class _Stream:
    """Bytes of a file of gzip members, as they are asked for."""

    def __init__(self, raw, block: int):
        self.raw, self.block, self.packed, self.held, self.one = raw, block, b"", bytearray(), None

    def more(self) -> bool:
        while True:
            if not self.packed:
                self.packed = self.raw.read(self.block)
                if not self.packed:
                    return False
            if self.one is None:
                self.one = zlib.decompressobj(31)
            got = self.one.decompress(self.packed, self.block)
            self.packed = self.one.unconsumed_tail
            if self.one.eof:
                self.packed, self.one = self.one.unused_data, None
            if got:
                self.held += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        at = 0
        while (k := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark))
            if not self.more():
                if bytes(self.held).strip():
                    raise ValueError("the archive ends inside a record")
                return None
        out = bytes(self.held[:k])
        del self.held[: k + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def read_records(raw, chunk: int = CHUNK) -> Iterator[tuple]:
    """(record_id, page_id, record_type, refers_to, stated digest, chunk_no, n_bytes so far, digest so far, last, data) of an open archive."""
    stream = _Stream(raw, 1 << 20)
    bare = lambda v: v[10:-1] if v.startswith("<urn:uuid:") else None
    while (head := stream.until(CRLF + CRLF)) is not None:
        f = _fields(head.lstrip())
        left = int(f["content-length"])
        http = stream.until(CRLF + CRLF)
        left -= len(http) + 4
        page = int(f["x-page-id"]) if "x-page-id" in f else None
        of = (bare(f["warc-record-id"]), page, f["warc-type"], bare(f.get("warc-refers-to", "")), f["warc-payload-digest"].removeprefix("sha1:"))
        digest, at, k = hashlib.sha1(), 0, 0
        while True:
            data = stream.take(min(chunk, left))
            left -= len(data)
            at += len(data)
            digest.update(data)
            yield (*of, k, at, _base32(digest.digest()), left == 0, data)
            k += 1
            if not left:
                break
        if stream.take(4) != CRLF + CRLF:
            raise ValueError("a record's length is wrong")
        if of[2] == "response" and _base32(digest.digest()) != of[4]:
            raise ValueError(f"the payload of record {of[0]} doesn't have the digest that it states")


CHUNK_ROWS = "record_id string, page_id long, record_type string, refers_to string, stated_digest string, chunk_no int, n_bytes long, digest string, last boolean, data binary"


def read_archives(manifest: DataFrame, folder: str, with_data: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Chunk rows of the archives that the manifest names; without data, only each record's last row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        columns = [c.split()[0] for c in CHUNK_ROWS.split(", ")]
        for batch in batches:
            for name in batch["file"]:
                rows, size = [], 0

                def frame() -> pd.DataFrame:
                    out = pd.DataFrame(rows, columns=columns)
                    out["page_id"] = out["page_id"].astype("Int64")
                    return out

                with store.open_input_stream(f"{base}/{name}", compression=None) as raw:
                    for row in read_records(raw, chunk):
                        if with_data or row[8]:
                            rows.append(row if with_data else (*row[:-1], None))
                            size += 300 + len(row[9]) * with_data
                        if size > 8_000_000:
                            yield frame()
                            rows, size = [], 0
                yield frame()

    files = manifest.select("file").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4, "file")
    return files.mapInPandas(run, CHUNK_ROWS)


def archive_round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as the written archives tell."""
    scratch = Scratch(pages.sparkSession, "warc")
    folder = scratch.path("archives")
    manifest = write_archives(chunk_table(pages, scratch, least), folder, scratch)
    read = scratch.save(read_archives(manifest, folder, with_data=False).drop("data", "chunk_no", "last"), "read")
    told = read.where("refers_to is null").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("of_page"), F.col("n_bytes").alias("of_bytes"), F.col("digest").alias("of_digest"))
    revisits = read.where("refers_to is not null").select("page_id", "record_type", "refers_to").join(told, "refers_to")
    own = read.where("refers_to is null").select("page_id", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(revisits.select("page_id", F.col("of_bytes").alias("payload_bytes"), F.col("of_digest").alias("payload_digest"), "record_type", F.col("of_page").alias("refers_to")))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


_BASE32 = "(SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1), '' ORDER BY i) FROM range(32) r(i))"
OP7_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last_id FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last_id THEN last_id END AS refers_to FROM g
"""
