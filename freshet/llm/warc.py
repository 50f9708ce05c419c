"""Pages in and out of WARC archives: sharded, sorted, deterministic, with records of equal payload written once."""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from freshet.llm.base import arrow_rows, checkpoint_folder, salted_join, shipped_by_value, stored

shipped_by_value(__name__)

#: Uncompressed payload of a shard, and compressed size at which a file is closed.
SHARD_BYTES, ROLL_BYTES = 256 << 20, 64 << 20
#: Even few pages are written by so many shards, so that a job has tasks to share.
LEAST_SHARDS = 64
BATCH = 64
#: Most revisits whose targets are sent to every executor, 100 bytes each; more meet the pages in a shuffle.
SENT_ROWS = 500_000
_DATE = "1970-01-01T00:00:00Z"  # the pages carry no time; a fixed one keeps the bytes the same
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "shard long, file string, records long, bytes long, sha1 string"
_PACKED = "shard long, page_id string, url string, length long, digest string, sha string, member binary"
_RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _header_value(text) -> str:
    """A header's value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in text or "")


def _framed(page_id, url, kind: str, block: bytes, digest: str, length: int, more=()) -> bytes:
    headers = [("WARC-Type", kind), ("WARC-Record-ID", _record_id(page_id)), ("WARC-Date", _DATE), ("WARC-Target-URI", _header_value(url)),
               ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
               ("Content-Type", "application/http;msgtype=response"), ("X-Page-ID", "" if page_id is None else str(page_id)),
               ("X-Payload-Length", str(length)), *more, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def response(page_id, url, payload: bytes) -> bytes:
    """A record with the payload, uncompressed."""
    return _framed(page_id, url, "response", _HTTP % len(payload) + payload, base32_sha1(payload), len(payload))


def revisit(page_id, url, digest: str, length: int, refers_to: int) -> bytes:
    """A record that names the page whose response has the payload, uncompressed."""
    more = [("WARC-Profile", _REVISIT), ("WARC-Refers-To", _record_id(refers_to)), ("X-Refers-To-Page", str(refers_to))]
    return _framed(page_id, url, "revisit", _HTTP % length, digest, length, more)


def _member(data: bytes) -> bytes:
    """The record as a gzip member of its own, the same bytes at every run."""
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=6, mtime=0, filename="") as z:
        z.write(data)
    return out.getvalue()


class _Shard:
    """The files of one shard while a task writes them.

    A file is written under a name of this attempt and renamed when it is whole.
    The final name and the bytes follow from the input alone, so an attempt that
    runs again or twice replaces a file by the same file.
    """

    def __init__(self, store, folder: str, shard: int, roll: int):
        self.store, self.folder, self.shard, self.roll = store, folder, shard, roll
        self.done, self.out = [], None

    def add(self, member: bytes) -> None:
        if self.out is None:
            self.temporary = f"{self.folder}/_temporary/{uuid.uuid4().hex}"
            self.out = self.store.open_output_stream(self.temporary, compression=None)
            self.records, self.size, self.digest = 0, 0, hashlib.sha1()
        self.out.write(member)
        self.digest.update(member)
        self.records, self.size = self.records + 1, self.size + len(member)
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            name = f"part-{self.shard:06d}-{len(self.done):05d}.warc.gz"
            self.store.move(self.temporary, f"{self.folder}/{name}")
            self.done.append((self.shard, name, self.records, self.size, self.digest.hexdigest()))
            self.out = None


def _packer(starts):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pages as compressed responses with their shard, so that only compressed bytes are shuffled."""
        bounds = starts.value
        for batch in batches:
            rows = []
            for page_id, url, html, sha in zip(batch["page_id"], batch["url"], batch["html"], batch["sha"]):
                payload, number = (html or "").encode("utf-8", "surrogatepass"), _number(page_id)
                shard = 0 if number is None else max(bisect.bisect_right(bounds, number) - 1, 0)
                rows.append((shard, page_id, url, len(payload), base32_sha1(payload), sha, _member(response(number, url, payload))))
            yield pd.DataFrame(rows, columns=["shard", "page_id", "url", "length", "digest", "sha", "member"])
    return pack


def _number(text) -> int | None:
    return None if text is None else int(text)


def _writer(uri: str, roll: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = pafs.FileSystem.from_uri(uri)
        shard, done = None, []
        for batch in batches:
            for row in batch.itertuples(index=False):
                if shard is None or shard.shard != row.shard:
                    if shard is not None:
                        shard.close()
                        done += shard.done
                    shard = _Shard(store, folder, int(row.shard), roll)
                shard.add(bytes(row.member) if row.refers_to is None else _member(
                    revisit(_number(row.page_id), row.url, row.digest, row.length, _number(row.refers_to))))
        if shard is not None:
            shard.close()
            done += shard.done
        if done:
            yield pd.DataFrame(done, columns=["shard", "file", "records", "bytes", "sha1"])
    return write


def shard_starts(sizes: DataFrame, shard_bytes: int = SHARD_BYTES) -> list[int]:
    """The first page_id of every shard, from (page_id, size): one number for each ``shard_bytes`` of pages.

    A page's shard is the bytes before it, in the order of page_id, over a
    shard's bytes.  Spark sorts by ranges, whose bounds may differ from run to
    run; what lies before a page doesn't, so shards are the same at every run.
    """
    per_page = sizes.filter("page_id IS NOT NULL").groupBy("page_id").agg(F.sum("size").alias("size"))
    width = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(per_page.repartitionByRange(width, "page_id").withColumn("range", F.spark_partition_id()), "ranged")
    total = ranged.agg(F.sum("size")).first()[0] or 0
    goal = max(min(shard_bytes, -(-total // LEAST_SHARDS)), 1)
    sums = ranged.groupBy("range").agg(F.sum("size").alias("s"))
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    offsets = sums.select("range", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy("range").orderBy("page_id").rowsBetween(W.unboundedPreceding, 0)
    running = ranged.withColumn("end", F.sum("size").over(inside)).join(offsets, "range")
    shard = F.floor((F.col("offset") + F.col("end") - F.col("size")) / F.lit(goal))
    firsts = running.groupBy(shard.alias("shard")).agg(F.min("page_id").alias("start"))
    return sorted(r["start"] for r in firsts.collect())


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, shard_bytes: int = SHARD_BYTES,
                   roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to WARC files in the new ``folder``; their manifest.

    The payload is the html in UTF-8, empty for NULL.  Of pages with equal
    payloads of ``least_bytes`` or more, the one with the smallest page_id is a
    response and the others revisit it; so are rows that repeat it responses too,
    and pages whose payload no page with a page_id has.  Further columns are not
    written.

    Pages lie in the order of page_id: shards in order, in each shard files in
    order, closed at ``roll_bytes`` compressed.  Each task writes whole shards,
    one record at a time, to temporary names and renames whole files.  Which
    files count is said by the manifest, a table that Spark commits when all
    shards are done: (shard, file, records, bytes, sha1).  A task that is lost
    and runs again writes the same names and bytes.
    """
    store, path = pafs.FileSystem.from_uri(folder)
    store.create_dir(f"{path}/_temporary", recursive=True)
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha2(F.encode(html, "UTF-8"), 256).alias("sha"))
    size = F.octet_length(html).cast("long")
    facts = stored(rows.select("page_id", "sha", (size + 512).alias("size"), (size >= least_bytes).alias("ok")).distinct(), "facts")
    firsts = facts.filter("ok").groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    revisits = salted_join(facts, firsts, ["sha"], "page_id").filter("page_id IS NULL OR page_id > first").select(
        F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), F.col("first").cast("string").alias("refers_to"))
    revisits = stored(revisits, "revisits")
    few = revisits.limit(SENT_ROWS + 1).count() <= SENT_ROWS
    starts = pages.sparkSession.sparkContext.broadcast(shard_starts(facts.select("page_id", "size"), shard_bytes))
    packed = rows.withColumn("page_id", F.col("page_id").cast("string")).mapInPandas(_packer(starts), _PACKED).withColumn("id", F.col("page_id").cast("long"))
    whole = packed.join(F.broadcast(revisits) if few else revisits, F.expr("sha = _sha AND id <=> _id"), "left").drop("_sha", "_id")
    width = max(LEAST_SHARDS, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    in_order = whole.repartition(width, "shard").sortWithinPartitions("shard", "id", "url", "sha").drop("id", "sha")
    with arrow_rows(pages.sparkSession, BATCH):
        in_order.mapInPandas(_writer(folder, roll_bytes), _MANIFEST).write.parquet(f"{folder}/manifest")
    store.delete_dir(f"{path}/_temporary")
    return pages.sparkSession.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def parse(stream) -> Iterator[tuple]:
    """The records of an uncompressed stream, one at a time; digests and lengths are checked."""
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no record starts with {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) != b"\r\n":
            name, _, value = line.decode("utf-8", "surrogatepass").partition(": ")
            headers[name] = value.rstrip("\r\n")
        block = stream.read(int(headers["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n" or f"sha1:{base32_sha1(block)}" != headers["WARC-Block-Digest"]:
            raise ValueError(f"record {headers['WARC-Record-ID']} is damaged")
        digest, length = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"])
        payload = block.partition(b"\r\n\r\n")[2]
        kind = headers["WARC-Type"]
        if kind == "response" and (len(payload) != length or base32_sha1(payload) != digest):
            raise ValueError(f"payload of {headers['WARC-Record-ID']} is damaged")
        yield headers, payload, (int(headers["X-Page-ID"]) if headers["X-Page-ID"] else None), length, digest, kind


def _reader(uri: str):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for name, expected in zip(batch["file"], batch["records"]):
                rows, seen = [], 0
                with store.open_input_stream(f"{folder}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for headers, _, page_id, length, digest, kind in parse(io.BufferedReader(stream)):
                        to = headers.get("X-Refers-To-Page")
                        rows.append((page_id, headers["WARC-Target-URI"], length, digest, kind, int(to) if to else None))
                        seen += 1
                        if len(rows) == 1000:
                            yield _frame(rows)
                            rows = []
                if seen != expected:
                    raise ValueError(f"{name} has {seen} records, not {expected}")
                yield _frame(rows)
    return read


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    return frame.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the files that the manifest of ``folder`` names, each file streamed and checked by one task."""
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    width = max(LEAST_SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("file", "records").repartition(width, "file").mapInPandas(_reader(folder), _RECORDS)


def new_folder(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/warc-{uuid.uuid4().hex}"
