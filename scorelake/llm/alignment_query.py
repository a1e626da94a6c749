"""Alignment of byte-level and piece tokens over all documents."""

from __future__ import annotations

import public_tokenizers

from scorelake.llm.alignment import aligned_documents
from scorelake.llm.registry import query, table


@query("op11_identity_alignment")
def op11(spark, sf_dir):
    found = aligned_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN,
                              public_tokenizers.path("piece_bpe_32k.model"))
    return found.drop("row")
