"""Token files of all documents, written and read back."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers

from scorelake.llm.byte_tokens import list_parts
from scorelake.llm.registry import query, table
from scorelake.llm.token_files import read_tokens, write_tokens
from scorelake.session import scratch_path

END_ID = 2


def _digests(batches):
    """Number of ids of each row, and their crc32 as little-endian unsigned 32-bit numbers."""
    for batch in batches:
        ids, bounds = list_parts(batch.column(2))
        raw = memoryview(np.ascontiguousarray(ids, "<i4")).cast("B") if len(ids) else b""
        crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())],
                                         ["doc_id", "start", "n_tokens", "ids_crc32"])


@query("op12_elias_fano_tokens")
def op12(spark, sf_dir):
    folder = scratch_path(spark, "tokens")
    manifest = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder, END_ID)
    rows = read_tokens(manifest, folder).select("doc_id", "start", "ids")
    return rows.mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")
