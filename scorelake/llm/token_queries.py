"""Packed sequences and byte-level tokens of all documents."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers

from scorelake.llm.byte_tokens import byte_tokenizer, encoded, list_parts
from scorelake.llm.packing import packed
from scorelake.llm.registry import query, table


def _piece_digests(batches):
    """The pieces with the crc32 of their ids, little-endian unsigned 32-bit, in the ids' place."""
    for batch in batches:
        ids = batch.column(3)
        flat = memoryview(np.ascontiguousarray(ids.values.to_numpy(), "<i4")).cast("B")
        at = ids.offsets.to_numpy().tolist()
        crc = [zlib.crc32(flat[4 * a:4 * b]) for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64()), *batch.columns[4:]],
                                         [*batch.schema.names[:3], "ids_crc32", *batch.schema.names[4:]])


@query("op4_harmonic_packing")
def op4(spark, sf_dir):
    pieces = packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.mapInArrow(_piece_digests, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                                             "sequence_id long, offset long")


BYTE_FILE = public_tokenizers.path("byte_bpe_50k.json")


def _text_digests(batches):
    """Digests of each row's ids and of the text they decode to."""
    tokenizer = byte_tokenizer(BYTE_FILE, public_tokenizers.PATTERN)
    for batch in batches:
        ids, bounds = list_parts(batch.column(1))
        raw = memoryview(np.ascontiguousarray(ids, "<i4")).cast("B") if len(ids) else b""
        own = [hashlib.sha256(raw[4 * a:4 * b]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        texts = [hashlib.sha256(t.decode("utf-8", "replace").encode()).hexdigest() for t in tokenizer.decoded(ids, bounds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), pa.array(own), pa.array(texts)],
                                         ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


@query("op10_tree_bpe")
def op10(spark, sf_dir):
    tokens = encoded(table(spark, sf_dir, "documents"), BYTE_FILE, public_tokenizers.PATTERN, ["doc_id"])
    return tokens.mapInArrow(_text_digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
