"""Ranked lexical search: the best documents of a whole table for every item of a set, scores in whole numbers.

Only terms that some item holds can score, so every document is cut down to its bag: those terms with their counts, and
m, which stands for the document's length. Documents with equal bags and m have equal scores for every item. They form a
class, found by the hash of the bag and told apart by the bag itself; of each class only its first documents by id are kept,
as many as a ranking is long, which Spark cuts in each task before the shuffle. Each class is scored once against all
items that share a term with it. A task keeps, for each item, the classes that could still be in the ranking, then their
documents in ascending order, and the rankings of all tasks are merged.

Items are worked on in blocks whose vocabulary is bounded, one pass over the texts each; what travels to the tasks is
one block's terms and postings.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm import arrays as A
from scorelake.llm.storage import removed, small_batches, stored

#: Bytes of the items' texts in a block: bounds what is sent to the tasks and held by the driver. A longer item is a block.
BLOCK_BYTES = 4 << 20
#: Scores held at a time: classes of a step times items of a block.
HELD_SCORES = 1 << 21

# Fixed values of the score: length weight b in hundredths, scale of a term's share, weight of length in it.
B, SCALE, K = 25, 1_000_000_000, 12

# Bytes that are no part of a term: all of ASCII but letters and digits.
TERM_BYTE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
SALT = np.uint64(0x6A09E667F3BCC909)


class Terms:
    """The terms of a slice of texts: ``start`` and ``stop`` in bytes, ``bounds`` of each text's terms, all in lower case."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = A.lower_ascii(data)
        solid = TERM_BYTE[data]
        first, last = solid.copy(), solid.copy()
        if len(data):
            first[1:] &= ~solid[:-1]
            last[:-1] &= ~solid[1:]
            full = offsets[:-1] < offsets[1:]
            at = offsets[:-1][full]
            first[at] = solid[at]
            at = offsets[1:][full] - 1
            last[at] = solid[at]
        self.start, self.stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets)

    def hashes(self) -> np.ndarray:
        return A.run_hashes(A.byte_sums(self.data), self.start, self.stop)


class Vocabulary:
    """Distinct terms, found by hash and compared byte by byte."""

    def __init__(self, terms: list[bytes]):
        """``terms`` are distinct; a term's number is its place among them."""
        size = np.array([len(t) for t in terms], np.int64)
        ends = np.cumsum(size)
        data = np.frombuffer(b"".join(terms), np.uint8)
        hashes = A.run_hashes(A.byte_sums(data), ends - size, ends)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        self.size, self.at, self.data = size[self.order], (ends - size)[self.order], data
        # Terms of one hash stand side by side; each of them is compared.
        same = np.flatnonzero(self.hashes[1:] != self.hashes[:-1]) + 1
        self.alike = int(np.diff(np.concatenate(([0], same, [len(terms)]))).max()) if terms else 0

    def numbers(self, terms: Terms) -> tuple[np.ndarray, np.ndarray]:
        """(places among ``terms``, numbers here) of those that are known."""
        if not len(self.hashes) or not len(terms.start):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        h = terms.hashes()
        low = np.searchsorted(self.hashes, h)
        found, number = [], []
        for step in range(self.alike):
            at = np.minimum(low + step, len(self.hashes) - 1)
            hit = np.flatnonzero((self.hashes[at] == h) & (low + step < len(h) + len(self.hashes)) & (terms.stop - terms.start == self.size[at]))
            at = at[hit]
            n = self.size[at]
            ends = np.cumsum(n)
            inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
            differ = terms.data[np.repeat(terms.start[hit], n) + inside] != self.data[np.repeat(self.at[at], n) + inside]
            same = A.sums(differ.astype(np.int64), np.concatenate(([0], ends))) == 0
            found.append(hit[same])
            number.append(self.order[at[same]])
        found, number = np.concatenate(found), np.concatenate(number)
        if self.alike > 1:
            pairs = np.unique(np.stack((found, number)), axis=1)
            found, number = pairs[0], pairs[1]
        return found, number


def _item_terms(batches) -> Iterator[pa.RecordBatch]:
    """(row, text) to (row, terms in order)."""
    for batch in batches:
        for low, high, data, offsets in A.slices(batch.column(1)):
            terms = Terms(data, offsets)
            raw = terms.data.tobytes()
            words = pa.array([raw[a:b] for a, b in zip(terms.start.tolist(), terms.stop.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[low:high], pa.ListArray.from_arrays(pa.array(terms.bounds.astype(np.int32)), words)], ["row", "terms"])


def _bags(words: list[bytes]):
    """(doc_id, text) to (doc_id, number of all terms, hash of the bag, bag): pairs of a term's number and its count, 32 bits each."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(words)
        size = max(len(words), 1)
        for batch in batches:
            for low, high, data, offsets in A.slices(batch.column(1)):
                terms = Terms(data, offsets)
                at, number = known.numbers(terms)
                text = np.searchsorted(terms.bounds, at, side="right") - 1
                key, count = np.unique(text * size + number, return_counts=True)
                text, number = key // size, key % size
                bounds = np.searchsorted(text, np.arange(high - low + 1))
                pairs = np.stack((number, count), axis=1).astype("<u4")
                bags = pa.BinaryArray.from_buffers(pa.binary(), high - low, [None, pa.py_buffer((8 * bounds).astype(np.int32)), pa.py_buffer(pairs)])
                mixed = A.mix((number.astype(np.uint64) << np.uint64(32) | count.astype(np.uint64)) ^ SALT)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[low:high], pa.array(np.diff(terms.bounds)), pa.array(A.signed(A.sums(mixed, bounds))), bags],
                    ["doc_id", "n", "hash", "bag"])
    return run


def _unpacked(bags: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bag, term, count) of all entries of a column of bags."""
    _, offsets, data = bags.buffers()
    ends = np.frombuffer(offsets, np.int32)[bags.offset:bags.offset + len(bags) + 1].astype(np.int64) // 8
    pairs = np.frombuffer(data, "<u4").reshape(-1, 2)[ends[0]:ends[-1]] if data is not None else np.empty((0, 2), np.uint32)
    return np.repeat(np.arange(len(bags)), np.diff(ends)), pairs[:, 0].astype(np.int64), pairs[:, 1].astype(np.int64)


def _term_documents(size: int):
    """Bags to (term, documents that hold it), summed over a task."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_unpacked(batch.column(0))[1], minlength=size)
        term = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(total[term])], ["term", "df"])
    return run


def weights(df: dict[int, int], terms: int, documents: int) -> np.ndarray:
    """Weight of every term; 0 for those no document holds."""
    out = np.zeros(terms, np.int64)
    for term, n in df.items():
        out[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1)))
    return out


class Best:
    """The best rows of each item so far: score down, then id up, nulls after all ids."""

    def __init__(self, k: int, items: int):
        self.k = k
        #: The score below which an item's documents cannot rank any more.
        self.floor = np.ones(items, np.int64)
        self.held = [np.empty(0, np.int64) for _ in range(4)]  # item, score, whether the id is null, id
        self.lists: np.ndarray = np.empty(0, object)

    def add(self, item, score, null, first, lists) -> None:
        new = [np.concatenate(x) for x in zip(self.held, (item, score, null, first))]
        lists = np.concatenate((self.lists, lists))
        order = np.lexsort((new[3], new[2], -new[1], new[0]))
        item = new[0][order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[rank < self.k]
        self.held, self.lists = [x[order] for x in new], lists[order]
        full = np.flatnonzero(rank[rank < self.k] == self.k - 1)
        self.floor[self.held[0][full]] = self.held[1][full]

    def expanded(self) -> Iterator[tuple[int, int, int | None]]:
        """(item, score, id) of the documents that rank, class by class in ascending order of their ids."""
        rows = sorted((item, -score, null, doc) for item, score, ids in zip(self.held[0].tolist(), self.held[1].tolist(), self.lists) for null, doc in ids)
        n, before = 0, None
        for item, score, null, doc in rows:
            n = n + 1 if item == before else 1
            before = item
            if n <= self.k:
                yield item, -score, None if null else doc


def _scored(postings, weight: np.ndarray, items: int, k: int):
    """Classes (m, bag, first ids) to the rows (item, score, doc_id) that may rank."""
    begin, holder, repeats = postings
    step = max(1, HELD_SCORES // max(items, 1))

    def run(batches) -> Iterator[pa.RecordBatch]:
        best = Best(k, items)
        for batch in batches:
            m_all, firsts = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            lists = np.empty(len(firsts), object)
            lists[:] = [sorted((d["none"], d["id"]) for d in ids) for ids in firsts]
            null, first = (np.array([ids[0][i] for ids in lists], np.int64) for i in (0, 1))
            for low in range(0, len(batch), step):
                rows = slice(low, min(low + step, len(batch)))
                bag, term, count = _unpacked(batch.column(1)[rows])
                share = weight[term] * ((SCALE * count) // (1000 * count + K * m_all[rows][bag]))
                n = begin[term + 1] - begin[term]
                ends = np.cumsum(n)
                place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[term] - (ends - n), n)
                scores = np.zeros((rows.stop - rows.start) * items, np.int64)
                np.add.at(scores, np.repeat(bag, n) * items + holder[place], np.repeat(share, n) * repeats[place])
                scores = scores.reshape(-1, items)
                # Only what reaches the k-th score of its item can rank, of this step and of those before.
                least = best.floor
                if len(scores) > k:
                    least = np.maximum(least, np.partition(scores, len(scores) - k, axis=0)[len(scores) - k])
                at, item = np.nonzero(scores >= least)
                best.add(item, scores[at, item], null[rows][at], first[rows][at], lists[rows][at])
        out = list(best.expanded())
        item, score, doc = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(score, pa.int64()), pa.array(doc, pa.int64())],
                                         ["item", "score", "doc_id"])
    return run


def _postings(items: list[list[int]], terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each term, where its run begins, the items that hold it and how often."""
    pairs = np.array([(t, i) for i, held in enumerate(items) for t in held], np.int64).reshape(-1, 2)
    pairs, count = np.unique(pairs, axis=0, return_counts=True)
    return np.searchsorted(pairs[:, 0], np.arange(terms + 1)), pairs[:, 1], count.astype(np.int64)


def _block(docs: DataFrame, held: list, k: int) -> tuple[DataFrame, list[DataFrame]]:
    """(row, rank, doc_id, score) for the items of one block, and the tables it reads."""
    spark = docs.sparkSession
    words: dict[bytes, int] = {}
    items = [[words.setdefault(bytes(t), len(words)) for t in r.terms] for r in held]
    bags = stored(docs.mapInArrow(_bags(list(words)), "doc_id long, n long, hash long, bag binary"), "bags")
    whole = bags.where("n > 0")
    total = whole.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    counted = whole.where("octet_length(bag) > 0").select("bag").mapInArrow(_term_documents(len(words)), "term long, df long")
    # One row for each term of the block.
    df = {r.term: r.df for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect()}
    m = (100 - B + F.expr(f"({B} * n * {total.docs}L) div {max(total.terms, 1)}L")).alias("m")
    null, first = F.col("doc_id").isNull().cast("int").alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id")
    rows = whole.where("octet_length(bag) > 0").select("hash", m, "bag", null, first)
    of_class = Window.partitionBy("hash", "m", "bag").orderBy("none", "id")
    firsts = rows.withColumn("_n", F.row_number().over(of_class)).where(F.col("_n") <= k)
    classes = firsts.groupBy("hash", "m", "bag").agg(F.collect_list(F.struct("none", "id")).alias("ids")).select("m", "bag", "ids")
    scored = classes.mapInArrow(_scored(_postings(items, len(words)), weights(df, len(words), total.docs), len(items), k),
                                "item int, score long, doc_id long")
    in_order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = scored.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= k)
    names = F.broadcast(spark.createDataFrame([(i, r.row) for i, r in enumerate(held)], "item int, row long"))
    return ranked.join(names, "item").select("row", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), [bags]


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
                     item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents with a score above 0 for every row of ``items``.

    Terms are runs of letters and digits of ASCII, lower-cased, and of all other characters beyond ASCII. A text that is null or
    has no term counts as no document and matches nothing; an item without terms has no rows. Equal scores rank by
    ascending id, a null id last; rows of one id are documents of their own, and repeated item rows have rankings of their
    own under the same id. Scores are exact in 64 bits. Other columns are not looked at. Documents alike in their bag are kept up
    to ``k`` a class, as no later one can rank. Blocks of items (``block_bytes`` of text) only bound memory; N, L and df are
    those of the whole table in each.
    """
    small_batches(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    asked = stored(items.select(F.monotonically_increasing_id().alias("row"), F.col(item_col).alias("item_id"),
                                F.col(item_text_col).cast("string").alias("text")), "items")
    terms = stored(asked.select("row", "text").mapInArrow(_item_terms, "row long, terms array<binary>"), "item-terms")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-size // block_bytes))
    parts, block = [], F.pmod(F.xxhash64("row"), F.lit(blocks))
    for i in range(blocks):
        held = terms.where((block == i) & (F.size("terms") > 0)).orderBy("row").collect()
        if held:
            found, read = _block(rows, held, k)
            parts.append(stored(found, "ranked", narrow=True))
            removed(*read)
    removed(terms)
    if not parts:
        return asked.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found.join(asked.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")
