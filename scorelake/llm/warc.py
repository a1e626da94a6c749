"""Deterministic WARC archives of pages, and their reader.

Pages are range-sorted by id: sampled splitters give ranges of near-equal bytes, each range is sorted and written by
one task. Files roll at a compressed size. Headers are made anew and digests computed from the payload, dates and
record ids follow from the page, so a task that runs twice writes the same bytes. Each file is written under a
name of its attempt and renamed when complete; the table of finished files is the manifest, stored by Spark, and
only files in it are read. Files go through ``pyarrow.fs``, so the folder may be in any store it knows.
"""

from __future__ import annotations

import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.sharding import range_of, splitters_of
from scorelake.llm.storage import small_batches, stored

#: Compressed bytes after which a file is closed.
ROLL_BYTES = 16 << 20
#: Ranges, and so files, of a table with enough ids.
MIN_SHARDS = 16
#: Shorter payloads are always written out.
MIN_SHARED = 1000
# Fixed values of the format.
VERSION = "WARC/1.1"
DATE = "2000-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:pages")

MANIFEST = "file string, shard int, part int, records long, bytes long, sha256 string"
RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id} {digest} {copy}')}>"


def _head(fields: list[tuple[str, object]]) -> bytes:
    return "".join([VERSION, "\r\n", *[f"{k}: {v}\r\n" for k, v in fields if v is not None], "\r\n"]).encode()


def _member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, copy: int, refers_to: int | None,
                revisit: bool) -> bytes:
    """A response with its payload, or a revisit that names the page whose response holds it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = None if url is None else urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest, copy)),
        ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"), ("X-Page-ID", page_id),
        ("X-Payload-Length", len(payload)), ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block))]
    if revisit:
        fields[4:4] = [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(refers_to, digest, 0)),
                       ("X-Refers-To-Page", refers_to)]
    return _head(fields) + block + b"\r\n\r\n"


class _Files:
    """The files of one task's ranges."""

    def __init__(self, folder: str, roll: int, attempt: int):
        from pyarrow import fs

        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.roll, self.attempt, self.out = roll, attempt, None
        self.shard = self.part = -1

    def begin(self, shard: int) -> None:
        if shard != self.shard:
            self.shard, self.part = shard, -1
        self.part += 1
        self.name = f"pages-{self.shard:06d}-{self.part:05d}.warc.gz"
        self.temp = f"{self.folder}/_open-{self.name}-{self.attempt}"
        self.out, self.size, self.records, self.sum = self.store.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha256()
        block = b"software: scorelake\r\nformat: WARC File Format 1.1\r\n"
        self.put(_head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(SPACE, self.name)}>"),
                        ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields"),
                        ("Content-Length", len(block))]) + block + b"\r\n\r\n")

    def put(self, record: bytes) -> None:
        data = _member(record)
        self.out.write(data)
        self.sum.update(data)
        self.size += len(data)
        self.records += 1

    def end(self) -> tuple:
        self.out.close()
        self.out = None
        self.store.move(self.temp, f"{self.folder}/{self.name}")
        return self.name, self.shard, self.part, self.records - 1, self.size, self.sum.hexdigest()


def _written(folder: str, roll: int):
    """Write sorted rows (shard, page_id, digest, order, url, html, refers_to); give the finished files."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, done, seen, mark, copy = _Files(folder, roll, TaskContext.get().taskAttemptId()), [], None, None, 0
        for batch in batches:
            for shard, page, digest, order, url, html, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if order == 0:
                    mark = (page, digest, refers)
                    continue
                payload = (html or "").encode()
                copy = copy + 1 if seen == (page, digest) else 0
                revisit = mark is not None and mark[:2] == (page, digest) and (mark[2] != page or copy > 0)
                seen = (page, digest)
                if files.out is not None and (files.shard != shard or files.size >= roll):
                    done.append(files.end())
                if files.out is None:
                    files.begin(shard)
                files.put(page_record(page, url, payload, digest, copy, mark[2] if revisit else None, revisit))
        if files.out is not None:
            done.append(files.end())
        names = [c.split()[0] for c in MANIFEST.split(", ")]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names)
    return run


def _tie() -> Column:
    """The digest's leading 60 bits: rows of one id are ranged by their payloads, so an id that a third of all rows share is cut
    like any other stretch, and the order of ranges is that of (id, digest)."""
    return F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")


def write_warc(pages: DataFrame, folder: str, roll: int = ROLL_BYTES, least: int = MIN_SHARDS) -> DataFrame:
    """Write a record for every row (page_id, url, html) below ``folder``; the manifest of the files.

    Among records of equal payloads of ``MIN_SHARED`` bytes or more the one of the largest page id is a response
    and the others revisit it; shorter ones are all responses. Where the largest id repeats, the first of its rows by
    url is the response. A null html is an empty payload, a null url leaves out its header. A null page id stands
    below all others. Only ids and digests are grouped to find equal payloads; each page is moved once.
    Rows alike in both id and payload stay together: the second and later ones are revisits of a few hundred bytes, or short records.
    Other columns are not written. An empty table writes nothing. ``folder`` must be a URI or an absolute path that
    all executors reach.
    """
    spark = pages.sparkSession
    small_batches(pages)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    keys = stored(rows.select("page_id", "digest", F.octet_length("html").alias("bytes")), "page-keys")
    splitters, _ = splitters_of(keys.withColumn("tie", _tie()), "page_id", "tie", "bytes", least)
    shards = len(splitters[0]) + 1
    leads = keys.where(F.col("bytes") >= MIN_SHARED).groupBy("digest").agg(
        F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    marks = keys.join(leads, "digest").select("page_id", "digest", "refers_to").distinct()
    place = range_of(splitters)
    both = rows.select("page_id", "digest", F.lit(1).alias("order"), "url", "html", F.lit(None).cast("long").alias("refers_to")).union(
        marks.select("page_id", "digest", F.lit(0), F.lit(None).cast("string"), F.lit(None).cast("string"), "refers_to"))
    both = both.select(place(F.col("page_id"), _tie()).cast("int").alias("shard"), *both.columns)
    both = both.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", "order", "url")
    _make_folder(spark, folder)
    return stored(both.mapInArrow(_written(folder, roll), MANIFEST), "warc-manifest")


def _make_folder(spark, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def members(data: bytes) -> Iterator[bytes]:
    """The unpacked members of a gzip file."""
    at, view = 0, memoryview(data)
    while at < len(data):
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            chunk = view[at:at + 65536]
            if not chunk:
                raise ValueError("the archive breaks off inside a member")
            parts.append(unpack.decompress(chunk))
            at += len(chunk) - len(unpack.unused_data)
        yield b"".join(parts)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, by lower-case name, and block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record: {version[:40]}")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    return fields, rest[:int(fields["content-length"])]


def _records(batches):
    for batch in batches:
        for data in batch.column(0):
            out = []
            for member in members(data.as_py()):
                fields, block = parse_record(member)
                kind = fields["warc-type"]
                if kind == "warcinfo":
                    continue
                if "sha1:" + hashlib.sha1(block).hexdigest() != fields["warc-block-digest"]:
                    raise ValueError(f"block digest differs in {fields['warc-record-id']}")
                digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"])
                payload = None
                if kind == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
                    if "sha1:" + digest != fields["warc-payload-digest"]:
                        raise ValueError(f"payload digest differs in {fields['warc-record-id']}")
                page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page")
                out.append((None if page is None else int(page), fields.get("warc-target-uri"), payload, size, digest, kind,
                            None if refers is None else int(refers)))
            names = [c.split()[0] for c in RECORDS.split(", ")]
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """Every page record of the manifest's files, digests checked against the bytes. ``url`` is as in the header,
    percent-encoded; ``payload`` is null for a revisit."""
    spark = manifest.sparkSession
    files = spark.read.format("binaryFile").option("pathGlobFilter", "pages-*.warc.gz").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.join(manifest.select("file"), "file", "left_semi").select("content").mapInArrow(_records, RECORDS)
