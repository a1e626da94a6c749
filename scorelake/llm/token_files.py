"""Token ids of all documents in one running order, in files with compressed boundaries.

Documents are ordered by (id, place in the table). Sampled splitters cut that order into ranges of near-equal bytes; each
range is sorted and written by one task, in files of bounded size. A file holds the ids end to end in two bytes each (four for
larger vocabularies), then the ends of its documents and their document ids as Elias-Fano sequences, then a tail that
tells where they begin. So a document is found by its number without a table of 64-bit offsets: two selects give its
bounds, one read its ids. Texts are tokenized before the shuffle, which moves ids only.

Each file is written under a name of its attempt and renamed when complete. The table of finished files, stored by Spark, is
the manifest; only files in it are read. A task that runs twice writes the same bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.elias_fano import EliasFano, pack
from scorelake.llm.sharding import LOWEST, Splitters, ranges_of, splitters_of
from scorelake.llm.storage import make_folder, removed, settled, stored
from scorelake.llm.word_tokens import token_slices, word_tokenizer

#: Ranges, and so files, of a table with enough documents.
MIN_SHARDS = 16
#: Ids and documents after which a file is closed.
ROLL_IDS = 1 << 26
ROLL_DOCS = 1 << 20
#: Ids read at a time, one document at least.
READ_IDS = 1 << 20

# Fixed values of the format. Tail: bytes of an id, documents, ids, those without a document id, offsets of both sequences.
MAGIC = b"SLTOK1\0\0"
TAIL = "<QQQQQQ8s"
TAIL_BYTES = struct.calcsize(TAIL)

FILES = "file string, shard int, part int, docs long, ids long, docs_before long, ids_before long, bytes long"
MANIFEST = "file string, shard int, part int, docs long, ids long, first long, start long, bytes long"
ROWS = "number long, doc_id long, start long, ids array<int>"


def _tokens(path: str, end_id: int, kind: str, splitters: Splitters):
    """(doc_id, tie, text) to (shard, doc_id, tie, ids as bytes)."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).fill_null(LOWEST).to_numpy()
            shards = pa.array(ranges_of(splitters, keys, batch.column(1).to_numpy()), pa.int32())
            for low, ids, bounds in token_slices(batch.column(2), path):
                n = np.diff(bounds) + 1
                flat = np.full(len(ids) + len(n), end_id, kind)
                ends = np.cumsum(n)
                flat[np.delete(np.arange(len(flat)), ends - 1)] = ids
                width = flat.dtype.itemsize
                offsets = np.concatenate(([0], ends * width)).astype(np.int32)
                data = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
                part = batch.slice(low, len(n))
                yield pa.RecordBatch.from_arrays([shards.slice(low, len(n)), part.column(0), part.column(1), data],
                                                 ["shard", "doc_id", "tie", "data"])
    return run


class _Writer:
    """The files of one range."""

    def __init__(self, folder: str, shard: int, attempt: int, width: int):
        from pyarrow import fs

        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.shard, self.attempt, self.width = shard, attempt, width
        self.part, self.docs, self.ids, self.out, self.done = 0, 0, 0, None, []

    def add(self, doc_id: int | None, data) -> None:
        if self.out is None:
            self.name = f"tokens-{self.shard:06d}-{self.part:05d}.bin"
            self.temp = f"{self.folder}/_open-{self.name}-{self.attempt}"
            self.out = self.store.open_output_stream(self.temp, compression=None)
            self.named, self.ends, self.nulls, self.here = [], [], 0, 0
        self.out.write(data)
        self.here += len(data) // self.width
        self.ends.append(self.here)
        if doc_id is None:
            self.nulls += 1  # they come first
        else:
            self.named.append(doc_id)
        if self.here >= ROLL_IDS or len(self.ends) >= ROLL_DOCS:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        ends, named = pack(np.array(self.ends, np.int64)), pack(np.array(self.named, np.int64))
        at = self.here * self.width
        self.out.write(ends)
        self.out.write(named)
        self.out.write(struct.pack(TAIL, self.width, len(self.ends), self.here, self.nulls, at, at + len(ends), MAGIC))
        self.out.close()
        self.out = None
        self.store.move(self.temp, f"{self.folder}/{self.name}")
        size = at + len(ends) + len(named) + TAIL_BYTES
        self.done.append((self.name, self.shard, self.part, len(self.ends), self.here, self.docs, self.ids, size))
        self.part, self.docs, self.ids = self.part + 1, self.docs + len(self.ends), self.ids + self.here


def _written(folder: str, width: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer, done = None, []
        for batch in batches:
            for shard, doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if writer is None or writer.shard != shard:
                    if writer is not None:
                        writer.close()
                        done += writer.done
                    writer = _Writer(folder, shard, TaskContext.get().taskAttemptId(), width)
                writer.add(doc_id, data.as_buffer())
        if writer is not None:
            writer.close()
            done += writer.done
        names = [c.split()[0] for c in FILES.split(", ")]
        kinds = (pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 5)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names)
    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
                 least: int = MIN_SHARDS) -> DataFrame:
    """Write every document's ids and ``end_id`` below ``folder``, in ascending order of its id; the manifest of the files.

    The manifest has one row per file: file, shard, part, docs, ids, first (number of its first document), start (ids of all
    files before it), bytes. A null, empty or blank text is the end id alone. A null document id stands below all others; rows
    of one id follow in the order of the table, each a document of its own. Other columns are not looked at. An empty table
    writes nothing. An id that a third of all rows share is cut over files like any other stretch.
    ``folder``: a URI that all executors reach.
    """
    spark = docs.sparkSession
    rows = settled(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("tie"), "text")
    keys = stored(rows.select("doc_id", "tie", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("size")), "token-keys")
    splitters, _ = splitters_of(keys, "doc_id", "tie", "size", least)
    removed(keys)
    ids = max(word_tokenizer(tokenizer_path).exact.get_vocab_size(), end_id + 1)
    kind = "<u2" if ids <= 1 << 16 else "<u4"
    tokens = rows.mapInArrow(_tokens(tokenizer_path, end_id, kind, splitters), "shard int, doc_id long, tie long, data binary")
    ordered = tokens.repartitionById(len(splitters[0]) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "tie")
    ordered = ordered.select("shard", "doc_id", "data")
    make_folder(spark, folder)
    files = stored(ordered.mapInArrow(_written(folder, np.dtype(kind).itemsize), FILES), "token-files")
    # One row for each range, of which there are at most a few times sharding.MAX_RANGES.
    totals = sorted(files.groupBy("shard").agg(F.sum("docs").alias("docs"), F.sum("ids").alias("ids")).collect())
    offsets, first, start = [], 0, 0
    for r in totals:
        offsets.append((r.shard, first, start))
        first, start = first + r.docs, start + r.ids
    known = F.broadcast(spark.createDataFrame(offsets, "shard int, first_of long, start_of long"))
    manifest = files.join(known, "shard").select(
        "file", "shard", "part", "docs", "ids", (F.col("first_of") + F.col("docs_before")).alias("first"),
        (F.col("start_of") + F.col("ids_before")).alias("start"), "bytes")
    manifest = stored(manifest, "token-manifest", narrow=True)
    removed(files)
    return manifest


class TokenFile:
    """One file: documents by their place in it."""

    def __init__(self, store, path: str, size: int):
        self.file = store.open_input_file(path)
        tail = self.read(size - TAIL_BYTES, TAIL_BYTES)
        self.width, self.docs, self.ids, self.nulls, ends, named, magic = struct.unpack(TAIL, tail)
        if magic != MAGIC:
            raise ValueError(f"no token file: {path}")
        self.ends, self.named = EliasFano(self.read, ends), EliasFano(self.read, named)

    def read(self, at: int, size: int) -> bytes:
        return self.file.read_at(size, at)

    def tokens(self, first: int, last: int) -> np.ndarray:
        data = np.frombuffer(self.read(first * self.width, (last - first) * self.width), f"<u{self.width}")
        return data.astype(np.int32)

    def bounds(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where documents begin and end among the file's ids."""
        start = np.zeros(len(places), np.int64)
        start[places > 0] = self.ends.select(places[places > 0] - 1)
        return start, self.ends.select(places)

    def doc_ids(self, places: np.ndarray) -> list[int | None]:
        out: list[int | None] = [None] * len(places)
        known = np.flatnonzero(places >= self.nulls)
        for i, d in zip(known.tolist(), self.named.select(places[known] - self.nulls).tolist()):
            out[i] = d
        return out


def _batch(number, doc_ids, start, ends, flat) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
    return pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(start, pa.int64()), lists],
                                      ["number", "doc_id", "start", "ids"])


def _read_whole(folder: str):
    """Rows (file, bytes, first, start) to all documents of each file."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, size, first, start in zip(*(c.to_pylist() for c in batch.columns)):
                file = TokenFile(store, f"{path}/{name}", size)
                ends = np.concatenate(([0], file.ends.all()))
                named = [None] * file.nulls + file.named.all().tolist()
                low = 0
                while low < file.docs:
                    high = max(low + 1, int(np.searchsorted(ends, ends[low] + READ_IDS, side="right")) - 1)
                    own = ends[low:high + 1]
                    yield _batch(np.arange(first + low, first + high), named[low:high], start + own[:-1], own - own[0],
                                 file.tokens(int(own[0]), int(own[-1])))
                    low = high
                file.file.close()
    return run


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Every document of the manifest's files: number (its place among all, from 0), doc_id, start (ids of all before it), ids."""
    files = manifest.count()
    numbered = manifest.select("file", "bytes", "first", "start", F.monotonically_increasing_id().alias("_n"))
    dealt = numbered.repartitionById(max(files, 1), F.pmod(F.col("_n") + F.shiftright("_n", 33), F.lit(max(files, 1))).cast("int"))
    return dealt.select("file", "bytes", "first", "start").mapInArrow(_read_whole(folder), ROWS)


def _read_some(folder: str):
    """Rows (file, bytes, first, start, number), sorted by file, to the documents named; one file is open at a time."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        held, file = None, None
        for batch in batches:
            names, number = np.array(batch.column(0).to_pylist()), batch.column(4).to_numpy()
            first, start, size = (batch.column(i).to_numpy() for i in (2, 3, 1))
            for low in np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1]))).tolist() if len(names) else []:
                own = np.flatnonzero(names == names[low])
                if held != names[low]:
                    if file is not None:
                        file.file.close()
                    held, file = names[low], TokenFile(store, f"{path}/{names[low]}", int(size[low]))
                begin, end = file.bounds(number[own] - first[own])
                doc_ids = file.doc_ids(number[own] - first[own])
                done = 0
                while done < len(own):
                    sizes = np.cumsum(end[done:] - begin[done:])
                    upto = done + max(1, int(np.searchsorted(sizes, READ_IDS, side="right")))
                    parts = [file.tokens(int(a), int(b)) for a, b in zip(begin[done:upto], end[done:upto])]
                    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
                    yield _batch(number[own[done:upto]], doc_ids[done:upto], start[own[done:upto]] + begin[done:upto], ends, np.concatenate(parts))
                    done = upto
        if file is not None:
            file.file.close()
    return run


def documents_at(manifest: DataFrame, folder: str, wanted: DataFrame, number_col: str = "number") -> DataFrame:
    """The documents with the numbers in ``wanted``, one row for each row of it; numbers beyond the files and nulls give none.

    Only the blocks of boundaries and the ids asked for are read. The range of a number follows from the first numbers of all
    ranges, of which there are at most a few times ``sharding.MAX_RANGES``; only rows and files of one range are joined.
    """
    ranges = sorted(manifest.groupBy("shard").agg(F.min("first").alias("first")).collect(), key=lambda r: r.first)
    firsts, shards = [r.first for r in ranges], [r.shard for r in ranges]

    @F.pandas_udf("int")
    def shard_of(number):
        import pandas as pd

        at = np.searchsorted(np.array(firsts, np.int64), number.to_numpy(np.int64), side="right") - 1
        return pd.Series([shards[i] if i >= 0 else -1 for i in at.tolist()], dtype="int32")

    asked = wanted.select(F.col(number_col).cast("long").alias("number")).where("number is not null")
    asked = asked.withColumn("shard", shard_of("number"))
    found = asked.join(manifest, "shard").where((F.col("number") >= F.col("first")) & (F.col("number") < F.col("first") + F.col("docs")))
    found = found.select("file", "bytes", "first", "start", "number").sortWithinPartitions("file", "number")
    return found.mapInArrow(_read_some(folder), ROWS)
