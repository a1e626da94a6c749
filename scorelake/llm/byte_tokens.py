"""Byte-level byte-pair encoding and decoding of whole texts.

Texts are split by the tokenizer's own pattern and merged inside its pieces. A piece longer than ``LEAF`` bytes,
such as a long run of letters, is not merged whole, which costs the square of its length: it is halved until
the parts are short, the parts are encoded side by side, and neighbours are joined as a tree. At each join the
last and first few tokens are encoded anew as one window, which grows until its first and last token are the
ones that the two sides have there. A sequence of tokens is the encoding of its bytes exactly when each two
neighbours are the encoding of theirs, so the joined sequence is then the encoding of the whole.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm import arrays as A
from scorelake.llm.storage import with_text
from scorelake.llm.word_tokens import byte_letters

LEAF = 256
WINDOW = 4
THREADS = 2


class ByteTokenizer:
    """``path``: tokenizer file; the pieces' pattern is the one of its byte-level pre-tokenizer."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): rank for token, rank in held["model"]["vocab"].items()
                 if token not in self.special}
        self.fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(pattern)
        self.breaks = regex.compile("|".join(f"({regex.escape(s)})" for s in self.special)) if self.special else None
        size = 1 + max([*ranks.values(), *self.special.values()])
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        for token, rank in self.special.items():
            tokens[rank] = token.encode()
        self.sizes = np.array([len(t) for t in tokens])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def piece(self, data: bytes) -> list[int]:
        """Tokens of one piece, whatever its length."""
        if len(data) <= LEAF:
            return self._merged(data)
        parts = [data]
        while len(parts[0]) > LEAF or any(len(p) > LEAF for p in parts):
            parts = [h for p in parts for h in ((p[:len(p) // 2], p[len(p) // 2:]) if len(p) > LEAF else (p,))]
        with ThreadPoolExecutor(THREADS) as pool:
            done = list(pool.map(self._merged, parts, chunksize=64))
            while len(done) > 1:
                pairs = [(done[i], done[i + 1]) for i in range(0, len(done) - 1, 2)]
                done = [*pool.map(lambda p: self.joined(*p), pairs), *done[2 * len(pairs):]]
        return done[0]

    def _merged(self, data: bytes) -> list[int]:
        return self.fast._core_bpe.encode_single_piece(data)

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of two neighbours' bytes, from the tokens of each."""
        n = WINDOW
        while True:
            a, b = left[-n:], right[:n]
            window = self._merged(self.text(a + b))
            if (n >= len(left) or window[0] == a[0]) and (n >= len(right) or window[-1] == b[-1]):
                return left[:-n] + window + right[n:]
            n *= 2

    def text(self, ids: list[int]) -> bytes:
        return b"".join(map(self.fast.decode_single_token_bytes, ids))

    def _ordinary(self, text: str, long_pieces: bool) -> np.ndarray:
        if not long_pieces:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array([t for m in self.pieces.finditer(text) for t in self.piece(m.group().encode())], np.uint32)

    def encode(self, text: str, long_pieces: bool) -> np.ndarray:
        if self.breaks is None or not any(s in text for s in self.special):
            return self._ordinary(text, long_pieces)
        out, at = [], 0
        for m in self.breaks.finditer(text):
            out += [self._ordinary(text[at:m.start()], long_pieces), np.array([self.special[m.group()]], np.uint32)]
            at = m.end()
        return np.concatenate([*out, self._ordinary(text[at:], long_pieces)])

    def decoded(self, ids: np.ndarray, bounds: np.ndarray) -> Iterator[bytes]:
        """Bytes of each run of ids."""
        size = self.sizes[ids]
        ends = np.concatenate(([0], np.cumsum(size)))
        place = np.arange(ends[-1]) - np.repeat(ends[:-1] - self.starts[ids], size)
        raw = self.bytes[place].tobytes()
        for a, b in zip(ends[bounds[:-1]], ends[bounds[1:]]):
            yield raw[a:b]


@functools.cache
def byte_tokenizer(path: str, pattern: str) -> ByteTokenizer:
    """One tokenizer for each worker process."""
    return ByteTokenizer(path, pattern)


def longest_runs(words: A.Words) -> np.ndarray:
    """Bytes of the longest word or gap of each text, which bound its longest piece."""
    size = np.zeros(len(words.counts), np.int64)
    text = words.text_of_word()
    np.maximum.at(size, text, words.stop - words.start)
    last = np.concatenate((words.offsets[:1], words.stop))
    gap = words.start - np.maximum(last[:-1], words.offsets[text])
    np.maximum.at(size, text, gap)
    end = np.where(words.counts > 0, words.stop[np.maximum(words.bounds[1:] - 1, 0)] if len(words.stop) else 0, words.offsets[:-1])
    return np.maximum(size, words.offsets[1:] - end)


def _encoded(path: str, pattern: str, keys: int, place: int):
    def run(batches):
        tokenizer = byte_tokenizer(path, pattern)
        for batch in batches:
            for low, high, data, offsets in A.slices(batch.column(place)):
                long_pieces = longest_runs(A.Words(data, offsets)) > LEAF
                raw = data.tobytes()
                ids = [tokenizer.encode(raw[a:b].decode("utf-8", "replace"), long)
                       for a, b, long in zip(offsets[:-1].tolist(), offsets[1:].tolist(), long_pieces.tolist())]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*[c[low:high] for c in batch.columns[:keys]], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    [*batch.schema.names[:keys], "ids"])
    return run


def encoded(docs: DataFrame, path: str, pattern: str, keys: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keys`` of every row and ``ids``, the tokens of its whole text as the file's tokenizer gives
    them without added special tokens. Special tokens written out in a text count as such, as there. A null
    or empty text has no tokens. Rows are encoded one by one, repeated ones alike; texts may be of any length. A key named ``ids``
    comes back as ``ids_``."""
    held, kinds, place = with_text(docs, keys, text_col, added=["ids"])
    return held.mapInArrow(_encoded(path, pattern, len(keys), place), f"{kinds}ids array<int>")


def list_parts(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists and where each begins and ends among them; a null is an empty list."""
    size = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(size)))


def _decoded(path: str, pattern: str, keys: int):
    def run(batches):
        tokenizer = byte_tokenizer(path, pattern)
        for batch in batches:
            ids, bounds = list_parts(batch.column(batch.num_columns - 1))
            texts = [t.decode("utf-8", "replace") for t in tokenizer.decoded(ids, bounds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:keys], pa.array(texts, pa.string())],
                                             [*batch.schema.names[:keys], "text"])
    return run


def decoded(tokens: DataFrame, path: str, pattern: str, keys: list[str], ids_col: str = "ids") -> DataFrame:
    """The columns ``keys`` of every row and the text of its ids, special tokens written out; a null list is an
    empty text. Bytes that are no UTF-8 become replacement characters. A key named ``text`` comes back as ``text_``."""
    held, kinds, _ = with_text(tokens, keys, ids_col, "array<int>", ["text"])
    return held.mapInArrow(_decoded(path, pattern, len(keys)), f"{kinds}text string")
