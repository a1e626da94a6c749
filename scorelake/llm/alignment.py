"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids meet in a corpus.

Both token sequences of a text cover the same bytes. Where a token of A and one of B end at the same byte, the text is
cut; the tokens between two cuts form a group, and every A token of a group is linked to every B token in it. Most groups
are one token of each with the same bytes. For those an array made once from the vocabularies gives the B id of every
A id, so they are counted in vectors as long as A's vocabulary and never become rows. Only pairs of irregular groups are
counted by a shuffle, one row for each distinct pair of a batch of documents.

To score documents by corpus-wide counts, the vectors and the counts of the ``TOP_PAIRS`` commonest irregular pairs go to the
tasks, which look up almost every link there; the pairs left are rare, so that the join that counts them has no hot key.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm import arrays as A
from scorelake.llm.byte_tokens import LEAF, byte_tokenizer, longest_runs
from scorelake.llm.storage import removed, small_batches, stored

#: Irregular pairs whose counts are sent to the tasks.
TOP_PAIRS = 1 << 17
#: Entries of pairs held before they are summed up.
HELD_PAIRS = 1 << 20
#: Letters of a text that one call of tokenizer B gets, where the text has a space to cut at.
CUT = 1 << 18
SPACE = "▁"

#: One document: counts, digest of its groups, then entries of 64 bits: A id and times linked to the id of its bytes; pair and times linked.
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, same binary, pairs binary"


class PieceTokenizer:
    """Tokenizer B: ids of a text after a space, and the bytes of every id."""

    def __init__(self, path: str):
        import sentencepiece

        self.held = sentencepiece.SentencePieceProcessor(model_file=path)
        tokens = []
        for i in range(self.held.get_piece_size()):
            piece = self.held.id_to_piece(i)
            tokens.append(bytes([int(piece[3:5], 16)]) if self.held.is_byte(i) else piece.replace(SPACE, " ").encode())
        self.tokens = tokens
        self.sizes, self.starts, self.bytes = token_table(tokens)

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text. No piece holds a space after another letter, so a long text may be cut before a run of
        spaces: of these the tokenizer adds the first itself."""
        parts, at = [], 0
        while len(text) - at > CUT:
            cut = at + CUT
            while cut < len(text) - 1 and not (text[cut] == " " and text[cut - 1] != " "):
                cut += 1
            if cut >= len(text) - 1:  # an empty rest would get no space
                break
            parts.append(self.held.encode_as_numpy(text[at:cut]))
            at = cut + 1
        parts.append(self.held.encode_as_numpy(text[at:]))
        return np.concatenate(parts).astype(np.int64)


def token_table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in tokens], np.int64)
    return sizes, np.cumsum(sizes) - sizes, np.frombuffer(b"".join(tokens), np.uint8)


@functools.cache
def piece_tokenizer(path: str) -> PieceTokenizer:
    """One tokenizer for each worker process."""
    return PieceTokenizer(path)


@functools.cache
def same_bytes(byte_path: str, pattern: str, piece_path: str) -> np.ndarray:
    """For every A id the B id of the same bytes, -1 where there is none; a piece goes before a single byte."""
    a, b = byte_tokenizer(byte_path, pattern), piece_tokenizer(piece_path)
    ids: dict[bytes, int] = {}
    for i in sorted(range(len(b.tokens)), key=lambda i: b.held.is_byte(i)):
        if not (b.held.is_control(i) or b.held.is_unknown(i)):
            ids.setdefault(b.tokens[i], i)
    raw = a.bytes.tobytes()
    out = np.array([ids.get(raw[s:s + n], -1) for s, n in zip(a.starts.tolist(), a.sizes.tolist())], np.int64)
    out[list(a.special.values())] = -1
    return out


def gathered(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Bytes of a sequence of ids, end to end."""
    sizes, starts, data = table
    n = sizes[ids]
    ends = np.cumsum(n)
    return data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[ids] - (ends - n), n)]


def _summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and the sum of their times."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(times, first) if len(first) else times


class Groups:
    """Groups of a run of documents: ``a`` and ``b`` are their ids end to end, ``a_ends`` and ``b_ends`` where tokens end in bytes."""

    def __init__(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray):
        self.a, self.b = a, b
        at = np.searchsorted(b_ends, a_ends)
        shared = np.flatnonzero(b_ends[np.minimum(at, len(b_ends) - 1)] == a_ends) if len(b) else np.empty(0, np.int64)
        self.a_stop, self.b_stop = shared + 1, at[shared] + 1
        self.a_start = np.concatenate(([0], self.a_stop[:-1])).astype(np.int64)[:len(shared)]
        self.b_start = np.concatenate(([0], self.b_stop[:-1])).astype(np.int64)[:len(shared)]
        self.n_a, self.n_b = self.a_stop - self.a_start, self.b_stop - self.b_start

    def regular(self, same: np.ndarray) -> np.ndarray:
        """Groups of one token each whose ids have the same bytes by the array."""
        out = (self.n_a == 1) & (self.n_b == 1)
        out[out] = same[self.a[self.a_start[out]]] == self.b[self.b_start[out]]
        return out

    def pairs(self, chosen: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document, pair, times linked) of some groups, piecewise; pairs are A id * 2^32 + B id and may come again."""
        links = self.n_a[chosen] * self.n_b[chosen]
        large = links > HELD_PAIRS
        for g, d in zip(chosen[large].tolist(), doc[large].tolist()):  # linked by distinct ids, a stretch of A at a time
            a, a_times = np.unique(self.a[self.a_start[g]:self.a_stop[g]], return_counts=True)
            b, b_times = np.unique(self.b[self.b_start[g]:self.b_stop[g]], return_counts=True)
            step = max(1, HELD_PAIRS // len(b))
            for i in range(0, len(a), step):
                key = ((a[i:i + step, None] << 32) | b).ravel()
                yield np.full(len(key), d), key, (a_times[i:i + step, None] * b_times).ravel()
        chosen, doc, links = chosen[~large], doc[~large], links[~large]
        low, total = 0, np.concatenate(([0], np.cumsum(links)))
        while low < len(chosen):
            high = max(low + 1, int(np.searchsorted(total, total[low] + HELD_PAIRS, side="right")) - 1)
            g, n = chosen[low:high], links[low:high]
            place = np.arange(total[high] - total[low]) - np.repeat(total[low:high] - total[low], n)
            width = np.repeat(self.n_b[g], n)
            a = self.a[np.repeat(self.a_start[g], n) + place // width]
            b = self.b[np.repeat(self.b_start[g], n) + place % width]
            yield np.repeat(doc[low:high], n), (a << 32) | b, np.ones(len(a), np.int64)
            low = high


class Spelled:
    """Decimal ids with the sign that stands after each, put together for many groups at once."""

    def __init__(self, size: int):
        self.sizes, self.starts, self.data = token_table([b"%d" % i for i in range(size)])

    def text(self, groups: Groups, first: int, last: int) -> bytes:
        """``a1,a2|b1;a3|b2,b3`` of a run of groups."""
        if first == last:
            return b""
        n_a, n_b = groups.n_a[first:last], groups.n_b[first:last]
        a = groups.a[groups.a_start[first]:groups.a_stop[last - 1]]
        b = groups.b[groups.b_start[first]:groups.b_stop[last - 1]]
        total = n_a + n_b
        ends = np.cumsum(total)
        begin = ends - total
        ids, sign = np.empty(ends[-1], np.int64), np.full(ends[-1], ord(","), np.uint8)
        from_a = np.zeros(ends[-1], bool)
        from_a[np.arange(len(a)) + np.repeat(begin - (np.cumsum(n_a) - n_a), n_a)] = True
        ids[from_a], ids[~from_a] = a, b
        sign[begin + n_a - 1], sign[ends - 1] = ord("|"), ord(";")
        size = self.sizes[ids] + 1
        stop = np.cumsum(size)
        out = np.empty(stop[-1], np.uint8)
        digit = np.ones(len(out), bool)
        digit[stop - 1] = False
        out[~digit] = sign
        out[digit] = gathered(ids, (self.sizes, self.starts, self.data))
        return out[:-1].tobytes()


def _entries(doc: np.ndarray, keys: np.ndarray, times: np.ndarray, docs: int) -> pa.Array:
    """Entries of each document, sorted by document, as bytes."""
    bounds = np.searchsorted(doc, np.arange(docs + 1))
    flat = np.stack((keys, times), axis=1).astype("<i8")
    return pa.BinaryArray.from_buffers(pa.binary(), docs, [None, pa.py_buffer((16 * bounds).astype(np.int32)), pa.py_buffer(flat)])


def _by_document(parts: list, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, key) with the sum of times."""
    doc, key, times = (np.concatenate(x) if parts else np.empty(0, np.int64) for x in (zip(*parts) if parts else ((), (), ())))
    order = np.lexsort((key, doc))
    doc, key, times = doc[order], key[order], times[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))) if len(doc) else np.empty(0, bool)
    first = np.flatnonzero(new)
    return doc[first], key[first], np.add.reduceat(times, first) if len(first) else times


def _aligned(byte_path: str, pattern: str, piece_path: str):
    def run(batches) -> Iterator[pa.RecordBatch]:
        a_side, b_side, same = byte_tokenizer(byte_path, pattern), piece_tokenizer(piece_path), same_bytes(byte_path, pattern, piece_path)
        a_table, b_table = (a_side.sizes, a_side.starts, a_side.bytes), (b_side.sizes, b_side.starts, b_side.bytes)
        spelled = Spelled(max(len(a_side.sizes), len(b_side.sizes)))
        for batch in batches:
            for low, high, data, offsets in A.slices(batch.column(2)):
                raw, n = data.tobytes(), high - low
                long_pieces = longest_runs(A.Words(data, offsets)) >= LEAF  # with the space before
                a_ids, b_ids, held = [], [], []
                for i, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    if begin == end:
                        continue
                    text = raw[begin:end].decode("utf-8", "replace")
                    a, b = a_side._ordinary(" " + text, bool(long_pieces[i])).astype(np.int64), b_side.encode(text)
                    want = b" " + raw[begin:end]
                    if gathered(a, a_table).tobytes() == want and gathered(b, b_table).tobytes() == want:
                        a_ids.append(a), b_ids.append(b), held.append(i)
                a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a_ids, b_ids))
                a_ends, b_ends = np.cumsum(a_table[0][a]), np.cumsum(b_table[0][b])
                groups = Groups(a, b, a_ends, b_ends)
                n_a, n_b = np.zeros(n, np.int64), np.zeros(n, np.int64)
                n_a[held], n_b[held] = [len(x) for x in a_ids], [len(x) for x in b_ids]
                # Every document ends a group.
                bounds = np.searchsorted(groups.a_stop, np.concatenate(([0], np.cumsum(n_a))), side="right")
                doc = np.repeat(np.arange(n), np.diff(bounds))
                links = A.sums(groups.n_a * groups.n_b, bounds)
                regular = groups.regular(same)
                plain = _by_document([(doc[regular], groups.a[groups.a_start[regular]], np.ones(int(regular.sum()), np.int64))], n)
                chosen = np.flatnonzero(~regular)
                parts, size = [], 0
                for part in groups.pairs(chosen, doc[chosen]):
                    parts.append(part)
                    size += len(part[0])
                    if size > 4 * HELD_PAIRS:
                        parts, size = [_by_document(parts, n)], 0
                d, pair, times = _by_document(parts, n)
                # An irregular group may hold a pair of the same bytes as well: it counts with its like.
                also = same[pair >> 32] == (pair & 0xFFFFFFFF)
                d_same, a_same, t_same = _by_document([plain, (d[also], pair[also] >> 32, times[also])], n)
                digests = [hashlib.sha256(spelled.text(groups, g, h)).hexdigest() if h > g else ""
                           for g, h in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[low:high], batch.column(1)[low:high], pa.array(n_a), pa.array(n_b), pa.array(np.diff(bounds)), pa.array(links),
                     pa.array(digests, pa.string()), _entries(d_same, a_same, t_same, n), _entries(d[~also], pair[~also], times[~also], n)],
                    [c.split()[0] for c in ALIGNED.split(", ")])
    return run


def alignments(docs: DataFrame, byte_path: str, pattern: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A stored table (``ALIGNED``), one row for each document, for :func:`pair_counts` and :func:`link_scores`.

    A text is a space and the text as given, without special tokens. Texts that are null, empty, or whose bytes the tokens of
    one side do not give back have no tokens, no groups and an empty digest. Ids may be null or repeat; other columns are not
    looked at. A task holds the tokens of a quarter of a megabyte of text, one text at least, and its distinct pairs.
    """
    small_batches(docs)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))
    return stored(rows.mapInArrow(_aligned(byte_path, pattern, piece_path), ALIGNED), "aligned")


def entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the batch, key, times) of all entries of a column."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64) // 16
    flat = np.empty((0, 2), np.int64) if data is None else np.frombuffer(data, "<i8", count=2 * ends[-1]).reshape(-1, 2)[ends[0]:]
    return np.repeat(np.arange(len(column)), np.diff(ends)), flat[:, 0], flat[:, 1]


def _same_documents(size: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(entries(batch.column(0))[1], minlength=size)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["a", "documents"])
    return run


def _pair_documents(batches) -> Iterator[pa.RecordBatch]:
    keys, times, size = [], [], 0

    def summed():
        key, n = _summed(np.concatenate(keys), np.concatenate(times))
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["pair", "documents"])

    for batch in batches:
        _, pair, _ = entries(batch.column(0))
        pair, n = np.unique(pair, return_counts=True)
        keys.append(pair), times.append(n)
        size += len(pair)
        if size > HELD_PAIRS:
            yield summed()
            keys, times, size = [], [], 0
    if keys:
        yield summed()


class Counts:
    """Documents that hold each pair: ``same`` by A id for pairs of the same bytes, ``pairs`` a stored table for all others."""

    def __init__(self, aligned: DataFrame, size: int):
        """``size``: ids of tokenizer A."""
        found = aligned.select("same").mapInArrow(_same_documents(size), "a long, documents long")
        self.same = np.zeros(size, np.int64)
        for r in found.groupBy("a").agg(F.sum("documents").alias("n")).collect():  # as many rows as A has ids
            self.same[r.a] = r.n
        pairs = aligned.select("pairs").mapInArrow(_pair_documents, "pair long, documents long")
        self.pairs = stored(pairs.groupBy("pair").agg(F.sum("documents").alias("documents")), "pair-counts")

    def best(self) -> np.ndarray:
        """The highest count of each A id."""
        out = self.same.copy()
        for r in self.pairs.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("documents").alias("n")).collect():
            out[r.a] = max(out[r.a], r.n)
        return out


def pair_counts(aligned: DataFrame, byte_path: str, pattern: str, piece_path: str) -> DataFrame:
    """(a, b, documents) for all linked pairs of ids: how many documents hold them linked."""
    same = same_bytes(byte_path, pattern, piece_path)
    counts = Counts(aligned, len(same))
    ids = np.flatnonzero(counts.same)
    spark = aligned.sparkSession
    plain = spark.createDataFrame([(int(a), int(same[a]), int(counts.same[a])) for a in ids], "a long, b long, documents long")
    return plain.union(counts.pairs.select(F.shiftright("pair", 32), F.col("pair").bitwiseAND(0xFFFFFFFF), "documents"))


def _looked_up(same: np.ndarray, best: np.ndarray, keys: np.ndarray, counts: np.ndarray):
    """(row, same, pairs) to (row, best links, sum of counts, pairs left with times linked)."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            doc, a, times = entries(batch.column(1))
            n_best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(total, doc, times * same[a])
            np.add.at(n_best, doc, times * (same[a] == best[a]))
            doc, pair, times = entries(batch.column(2))
            at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
            known = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
            count = counts[at[known]]
            np.add.at(total, doc[known], times[known] * count)
            np.add.at(n_best, doc[known], times[known] * (count == best[pair[known] >> 32]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_best), pa.array(total), _entries(doc[~known], pair[~known], times[~known], n)],
                ["row", "n_best", "count_sum", "left"])
    return run


def _left(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, pair, times = entries(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(pair), pa.array(times)], ["row", "pair", "times"])


def link_scores(aligned: DataFrame, size: int, top_pairs: int = TOP_PAIRS) -> DataFrame:
    """(row, n_best, count_sum) of every document: links whose pair is in as many documents as any pair of its A id, and the sum
    of the counts of all links. ``size``: ids of tokenizer A.

    What the tasks are sent is bounded by the vocabulary and by ``top_pairs``, which changes nothing but the size of the join.
    """
    spark = aligned.sparkSession
    counts = Counts(aligned, size)
    best = counts.best()
    top = counts.pairs.orderBy(F.desc("documents"), "pair").limit(top_pairs).toArrow()
    keys, n = (top.column(c).to_numpy() for c in ("pair", "documents"))
    order = np.argsort(keys)
    scored = aligned.select("row", "same", "pairs").mapInArrow(
        _looked_up(counts.same, best, keys[order], n[order]), "row long, n_best long, count_sum long, left binary")
    scored = stored(scored, "link-scores")
    rest = scored.where("octet_length(left) > 0").select("row", "left").mapInArrow(_left, "row long, pair long, times long")
    # As many rows as tokenizer A has ids.
    highest = F.broadcast(spark.createDataFrame(pa.table({"a": np.arange(size), "best": best})))
    rest = rest.join(counts.pairs, "pair").join(highest, F.shiftright("pair", 32) == F.col("a"))
    rest = rest.select("row", F.when(F.col("documents") == F.col("best"), F.col("times")).otherwise(0).alias("n_best"),
                       (F.col("times") * F.col("documents")).alias("count_sum"))
    both = scored.select("row", "n_best", "count_sum").union(rest)
    return both.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def aligned_documents(docs: DataFrame, byte_path: str, pattern: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text",
                      top_pairs: int = TOP_PAIRS) -> DataFrame:
    """One row for each document: row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum (see
    :func:`alignments` and :func:`link_scores`); an empty table gives no rows."""
    aligned = alignments(docs, byte_path, pattern, piece_path, id_col, text_col)
    scores = link_scores(aligned, len(same_bytes(byte_path, pattern, piece_path)), top_pairs)
    return aligned.drop("same", "pairs").join(scores, "row")
