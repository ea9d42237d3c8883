"""WARC archives: a deterministic sharded writer and its reader.

Pages are cut into ranges of page_id of about equal bytes, worked out from a histogram, sorted inside
the range, and written as gzip members, one per record. A file ends when its compressed size reaches
the limit. A task writes under a temporary name and reports what it wrote; only the reports of tasks
that Spark counts as done make the manifest, only files of the manifest get their final names, and
readers go by the manifest. A lost or repeated task leaves a temporary file that nobody reads.
Neither the clock nor the number of tasks enters names or bytes.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringsift.session import scratch_path

from .common import stored

#: Compressed bytes at which a file ends, and page bytes of a range.
FILE_BYTES, RANGE_BYTES = 8 << 20, 32 << 20
#: Bins of the histogram of page_id.
BINS = 1 << 12
#: Payloads of at least so many bytes are stored once.
LEAST_REVISIT = 0
#: Pages carry no time of capture.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "name string, temporary string, range bigint, file bigint, records bigint, bytes bigint, sha1 string"
RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(kind: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v is not None) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def _name(page_id: int | None, place: int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{place}>"


def page_record(page_id: int | None, place: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit of the first record of ``refers_to``; ``place`` tells repeated page ids apart."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    headers = [
        ("WARC-Record-ID", _name(page_id, place)), ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else quote(url, safe="%/:?#[]@!$&'()*+,;=~")),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Profile", PROFILE if revisit else None), ("WARC-Refers-To", _name(refers_to, 0) if revisit else None),
    ]
    return _record("revisit" if revisit else "response", headers, http if revisit else http + payload)


def _ranges(pages: DataFrame, range_bytes: int) -> DataFrame:
    """pages with ``_range``: consecutive bins of page_id up to ``range_bytes``; a bin beyond that is split by hash."""
    edge = pages.agg(F.min("page_id").alias("low"), F.max("page_id").alias("high")).first()
    low = edge["low"] or 0
    width = ((edge["high"] or 0) - low) // BINS + 1
    binned = pages.withColumn("_bin", F.coalesce(F.expr(f"(page_id - {low}L) div {width}L"), F.lit(-1).cast("bigint")))
    sizes = binned.groupBy("_bin").agg(F.sum(F.octet_length("_payload") + 64).alias("b"))
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    plan = sizes.select(
        "_bin", (F.ceil(F.col("b") / range_bytes) - 1).alias("more"),
        F.floor(F.coalesce(F.sum("b").over(before), F.lit(0)) / range_bytes).cast("bigint").alias("at"),
    )
    joined = binned.join(stored(plan, "ranges"), "_bin")
    return joined.withColumn("_range", F.col("at") + F.pmod(F.xxhash64("page_id"), F.col("more") + 1)).drop("_bin", "at", "more")


def write(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, range_bytes: int = RANGE_BYTES, least: int = LEAST_REVISIT) -> DataFrame:
    """Write one record per row of pages (page_id, url, html) and return the manifest.

    A null html is an empty payload; a null url leaves out its header. Of equal payloads of at least
    ``least`` bytes the record of the smallest page_id is the response and the others revisit it; of
    rows that repeat that page_id, the first is the response. Rows without a page_id are responses.
    An empty table gives an empty manifest. Further columns are left out.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("_payload"))
    dealt = _ranges(rows, range_bytes).withColumn("_sha", F.sha1("_payload"))
    # Equal payloads meet as digests; the marks then travel to their pages along with the sort.
    seen = dealt.filter(F.octet_length("_payload") >= least).filter("page_id is not null").select("_range", "page_id", "_sha")
    firsts = seen.groupBy("_sha").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    marks = seen.join(firsts, "_sha").distinct()
    none = F.lit(None)
    both = dealt.select("_range", "page_id", "_sha", F.lit(1).alias("_kind"), "url", "_payload", none.cast("bigint").alias("_first")).unionByName(
        marks.select("_range", "page_id", "_sha", F.lit(0).alias("_kind"), none.cast("string").alias("url"), none.cast("binary").alias("_payload"), "_first")
    )
    sorted_rows = both.repartition("_range").sortWithinPartitions("_range", "page_id", "_sha", "_kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(f"{root}/_temporary", recursive=True)
        out = _Files(store, root, file_bytes)
        page = place = mark = None
        for batch in batches:
            for at in range(batch.num_rows):
                range_, page_id, sha, kind, url, payload, first = (c[at].as_py() for c in batch.columns)
                if (range_, page_id) != page:
                    page, place, mark = (range_, page_id), 0, None
                if kind == 0:
                    mark = (sha, first)
                    continue
                told = mark is not None and mark[0] == sha
                refers_to = mark[1] if told and (mark[1] != page_id or len(mark) > 2) else None
                if told and refers_to is None:
                    mark = (*mark, "written")
                # The first record of a page that others revisit comes first among the rows of its page_id only
                # by digest; its place is part of its name.
                yield from out.add(range_, page_record(page_id, place, url, payload, refers_to))
                place += 1
        yield from out.close()

    reported = stored(sorted_rows.mapInArrow(run, MANIFEST), "reported")
    return _commit(spark, reported, folder)


class _Files:
    """The file that is being written, and the reports of those that have ended."""

    def __init__(self, store: fs.FileSystem, root: str, limit: int) -> None:
        self.store, self.root, self.limit = store, root, limit
        self.range: int | None = None
        self.stream = None

    def add(self, range_: int, record: bytes) -> Iterator[pa.RecordBatch]:
        if self.range != range_:
            yield from self.close()
            self.range, self.file = range_, 0
        if self.stream is None:
            self.name = f"{self.range:08d}-{self.file:05d}.warc.gz"
            self.temporary = f"_temporary/{self.name}.{uuid.uuid4().hex}"
            self.stream = self.store.open_output_stream(f"{self.root}/{self.temporary}", compression=None)
            self.records, self.bytes, self.sha1 = 0, 0, hashlib.sha1()
            self._put(_record("warcinfo", [("WARC-Record-ID", f"<urn:file:{self.name}>"), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self._put(record)
        self.records += 1
        if self.bytes >= self.limit:
            yield from self.close()

    def _put(self, record: bytes) -> None:
        self.stream.write(record)
        self.sha1.update(record)
        self.bytes += len(record)

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.stream is None:
            return
        self.stream.close()
        self.stream = None
        yield pa.RecordBatch.from_pylist([{
            "name": self.name, "temporary": self.temporary, "range": self.range, "file": self.file,
            "records": self.records, "bytes": self.bytes, "sha1": self.sha1.hexdigest(),
        }])
        self.file += 1


def _commit(spark: SparkSession, reported: DataFrame, folder: str) -> DataFrame:
    """Give the reported files their final names (again, if a task is repeated), then write the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(f"{root}/data", recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                final = f"{root}/data/{row['name']}"
                if store.get_file_info(final).type == fs.FileType.NotFound:
                    store.move(f"{root}/{row['temporary']}", final)
            yield batch

    reported.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(reported.schema).parquet(f"{folder}/manifest")


def parse(content: bytes) -> Iterator[dict]:
    """The records of an archive; digests and lengths are checked against what they describe."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(content))
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError("not the start of a record")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            key, _, value = line.decode().partition(":")
            headers[key.lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if headers["warc-block-digest"] != f"sha1:{digest(block)}" or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"damaged record {headers['warc-record-id']}")
        if headers["warc-type"] == "warcinfo":
            continue
        http, _, payload = block.partition(b"\r\n\r\n")
        told = headers["warc-payload-digest"].removeprefix("sha1:")
        if headers["warc-type"] == "response" and digest(payload) != told:
            raise ValueError(f"damaged payload of {headers['warc-record-id']}")
        length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        page = headers["warc-record-id"].split(":")[2]
        refers = headers.get("warc-refers-to")
        yield {
            "page_id": int(page) if page else None, "url": headers.get("warc-target-uri"), "payload_bytes": length, "payload_digest": told,
            "record_type": headers["warc-type"], "refers_to": int(refers.split(":")[2]) if refers else None, "payload": payload,
        }


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per page record of the archives in the manifest of ``folder``."""
    manifest = spark.read.parquet(f"{folder}/manifest").select("name", "bytes")
    if manifest.isEmpty():
        return spark.createDataFrame([], RECORD)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(f"{folder}/data")
    known = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), "content").join(manifest, ["name", "bytes"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for content in batch.column(0):
                rows = [{k: v for k, v in r.items() if k != "payload"} for r in parse(content.as_py())]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return known.select("content").mapInArrow(run, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to a new folder of the shared store and read the archives back."""
    folder = scratch_path(pages.sparkSession, "warc")
    write(pages, folder)
    return read(pages.sparkSession, folder)
