"""Harmonic packing of token sequences.

A piece of more than C/(k+1) and at most C/k tokens is of class k, and k pieces of it fill a sequence of capacity
C. Every task fills sequences of each class on its own, so nothing is sorted, shuffled or shared. A document is
cut at the capacity; what is left stays whole where k pieces like it fill ``1 - SLACK`` of a sequence, else it
gives up a piece of the next class's exact size, C/(k+1), and the rest is classed anew. At the end of a task the pieces
of unfilled sequences, at most C tokens for a class, are laid end to end and cut at the capacity, the last of
them into sequences of powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.storage import small_batches
from scorelake.llm.word_tokens import token_slices

CAPACITY = 2048
SLACK = 1 / 32
END_ID = 1
#: Sequences of one task are numbered from its partition times this.
SEQUENCES_OF_TASK = 1 << 36

SCHEMA = "doc_id long, start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long"


def cuts(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, class) of every piece, by document and start."""
    doc, start, size, kind = [], [], [], []

    def add(d, s, n, k):
        doc.append(d), start.append(s), size.append(n), kind.append(k)

    full = lengths // capacity
    at = np.repeat(np.arange(len(lengths)), full)
    turn = np.arange(len(at)) - np.repeat(np.cumsum(full) - full, full)
    add(at, turn * capacity, np.full(len(at), capacity), np.ones(len(at), np.int64))
    d = np.flatnonzero(lengths % capacity)
    left, s = (lengths % capacity)[d], (full * capacity)[d]
    while len(d):
        k = capacity // left
        whole = left * k >= capacity * (1 - SLACK)
        n = np.where(whole, left, capacity // (k + 1))
        add(d, s, n, np.where(whole, k, k + 1))
        d, s, left = d[~whole], (s + n)[~whole], (left - n)[~whole]
    doc, start, size, kind = (np.concatenate(x).astype(np.int64) for x in (doc, start, size, kind))
    order = np.lexsort((start, doc))
    return doc[order], start[order], size[order], kind[order]


class Packer:
    """The open sequences of one task."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.next = capacity, first_sequence
        # class -> pieces of its open sequence: (doc_id, start, ids, doc_tokens)
        self.open: dict[int, list[tuple]] = {}
        self.out: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, n in pieces:
            self.out.append((doc, start, ids, n, self.next, offset))
            offset += len(ids)
        self.next += 1

    def add(self, kind: int, piece: tuple) -> None:
        held = self.open.setdefault(kind, [])
        held.append(piece)
        if len(held) == kind:
            self._close(held)
            self.open[kind] = []

    def finish(self) -> None:
        held = [p for kind in sorted(self.open) for p in self.open[kind]]
        left = sum(len(p[2]) for p in held)
        room, pieces = self._room(left), []
        for doc, start, ids, n in held:
            while len(ids):
                take = min(room, len(ids))
                pieces.append((doc, start, ids[:take], n))
                ids, start, room, left = ids[take:], start + take, room - take, left - take
                if not room:
                    self._close(pieces)
                    room, pieces = self._room(left), []
        self.open = {}

    def _room(self, left: int) -> int:
        """Size of the next sequence: full, or the largest power of two that what is left fills."""
        return self.capacity if left >= self.capacity else 1 << max(left.bit_length() - 1, 0)

    def taken(self) -> pa.RecordBatch:
        out, self.out = self.out, []
        doc, start, ids, n, sequence, offset = zip(*out) if out else ((),) * 6
        size = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
        ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(size),
             pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(n, pa.int64()),
             pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
            ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def _packed(path: str, capacity: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(capacity, TaskContext.get().partitionId() * SEQUENCES_OF_TASK)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for low, ids, bounds in token_slices(batch.column(1), path):
                n = np.diff(bounds) + 1
                # Every document's ids, each followed by the end id.
                flat = np.full(len(ids) + len(n), END_ID, np.uint32)
                ends = np.cumsum(n)
                flat[np.delete(np.arange(len(flat)), ends - 1)] = ids
                base = ends - n
                for d, start, size, kind in zip(*(x.tolist() for x in cuts(n, capacity))):
                    at = base[d] + start
                    packer.add(kind, (doc_ids[low + d], start, flat[at:at + size], int(n[d])))
                yield packer.taken()
                for kind, held in packer.open.items():  # let go of the slice
                    packer.open[kind] = [(d, s, i.copy() if i.base is flat else i, k) for d, s, i, k in held]
        packer.finish()
        yield packer.taken()
    return run


def packed(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents in sequences of at most ``capacity`` tokens.

    doc_id, start (tokens of its document before it), length, ids, doc_tokens (with the end id), sequence_id, offset.
    A document is its token ids and the id 1. A null, empty or blank text is that id alone. Repeated rows and ids
    are documents of their own; a null id stays null. Other columns are not looked at. Each id lies in exactly
    one piece; pieces of a sequence follow each other without a gap. Sequences short of the capacity are of
    a power of two, or short by the little that classes leave. ``capacity`` is a power of two.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    small_batches(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_packed(tokenizer_path, capacity), SCHEMA)
