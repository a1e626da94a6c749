"""Passages that repeat, by a sparse suffix array.

A text's suffixes are kept only where content selects them: at the minimisers, the least hash of ``PREFIX`` words
among RUN = length - PREFIX + 1 neighbouring places. Every window of ``length`` words owns one, at the same
place in every copy, whatever stands around it; about 2 in RUN + 1 suffixes stay.

Kept suffixes are ordered and neighbours compared by their first ``PREFIX`` words; a suffix without an equal
neighbour is in no repeat. The others are extended left and right as far as the windows that own them reach,
their span. Suffixes of equal spans agree in all their windows. Where one prefix has unlike spans, a passage begins
or ends there, and the spans are compared window by window. Ordering and comparing is sort-and-group on hashes of the
words compared, and equal ones are folded before the shuffle, so a passage that many texts share is no hot key and
no two texts are ever paired. Spans and windows, whose equality is taken for that of their words, have 128 bits of two
unrelated bases; prefixes only bring candidates together and have 64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm import arrays as A
from scorelake.llm.beside import Beside
from scorelake.llm.storage import fresh, removed, settled, stored

#: Words a passage has at least.
LENGTH = 50
PREFIX = 16

SPAN, WINDOW = ["span", "span2"], ["window", "window2"]


def owners(h: np.ndarray, run: int) -> np.ndarray:
    """For every run of neighbours, the place of its least hash, the first of equals."""
    n = len(h) - run + 1
    if n <= 0:
        return np.empty(0, np.int64)
    value, place, size = h, np.arange(len(h)), 1
    while 2 * size <= run:
        value, place = _lesser(value[:-size], place[:-size], value[size:], place[size:])
        size *= 2
    rest = run - size
    return _lesser(value[:n], place[:n], value[rest:rest + n], place[rest:rest + n])[1]


def _lesser(v, p, w, q):
    left = (v < w) | ((v == w) & (p <= q))
    return np.where(left, v, w), np.where(left, p, q)


def _suffixes(length: int):
    """(prefix, span in two numbers, row, start, windows) of every kept suffix: ``start`` is its first window's first word.
    How far the suffix lies behind it is hashed into the span."""
    def run(batches):
        for batch in batches:
            row = batch.column(0).to_numpy()
            for low, _, data, offsets in A.slices(batch.column(1)):
                words = A.Words(data, offsets)
                inside = np.flatnonzero(words.window_mask(length))
                if not len(inside):
                    continue
                total = A.byte_sums(words.hashes())
                at = np.arange(len(words.start) - PREFIX + 1)
                first = A.run_hashes(total, at, at + PREFIX)
                owner = owners(first, length - PREFIX + 1)[inside]
                new = np.ones(len(inside), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1] + 1)
                cut = np.flatnonzero(new)
                start, place = inside[cut], owner[cut]
                windows = np.diff(np.append(cut, len(inside)))
                before = place - start
                stop = start + windows - 1 + length
                span = A.joined(A.run_hashes(total, start, stop), before.astype(np.uint64))
                total2 = A.byte_sums(words.hashes(base=1), 1)
                span2 = A.joined(A.run_hashes(total2, start, stop, 1), before.astype(np.uint64))
                text = np.searchsorted(words.bounds, start, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(A.signed(first[place])), pa.array(A.signed(span)), pa.array(A.signed(span2)), pa.array(row[low + text]),
                     pa.array((start - words.bounds[text]).astype(np.int32)), pa.array(windows.astype(np.int32))],
                    ["prefix", *SPAN, "row", "start", "windows"])
    return run


def _windows(length: int):
    """(prefix, span, offset, window): hashes of every window of the spans asked for."""
    def work(batch, entries):
        asked = entries.column("asked").combine_chunks()
        size = asked.value_lengths().to_numpy()
        cell = asked.flatten()
        prefix, span, span2, start, windows = (cell.field(i).to_numpy() for i in range(5))
        edge = np.concatenate(([0], np.cumsum(size)))
        for low, high, data, offsets in A.slices(batch.column(1)):
            words = A.Words(data, offsets)
            total, total2 = A.byte_sums(words.hashes()), A.byte_sums(words.hashes(base=1), 1)
            own = slice(edge[low], edge[high])
            n = windows[own]
            base = np.repeat(words.bounds[:-1], size[low:high]) + start[own]
            offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(base, n) + offset
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(prefix[own], n)), pa.array(np.repeat(span[own], n)), pa.array(np.repeat(span2[own], n)),
                 pa.array(offset.astype(np.int32)), pa.array(A.signed(A.run_hashes(total, at, at + length))),
                 pa.array(A.signed(A.run_hashes(total2, at, at + length, 1)))],
                ["prefix", *SPAN, "offset", *WINDOW])
    return work


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    docs = settled(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Every passage of ``length`` or more words that stands at least twice in the corpus, once for each place.

    row, doc_id, start_word, n_words, first_row, first_doc_id, first_word: ``first_*`` is the passage's first place by
    row, the place itself where it is the first. Places whose windows lead to consecutive first places are one passage,
    so a text may hold several, also overlapping ones. ``row`` is the row's place in ``docs``
    (``monotonically_increasing_id``). Words are runs other than space and the controls 9 to 13 and compare byte
    by byte. A passage that repeats within one text counts. Null and short texts hold none; repeated rows repeat
    each other; ids may be null or repeat, as ``row`` tells places apart. Other columns are not looked at.
    """
    rows = _rows(docs, id_col, text_col)
    suffixes = stored(rows.where("text is not null").select("row", "text").mapInArrow(
        _suffixes(length), "prefix long, span long, span2 long, row long, start int, windows int"), "suffixes")
    twice = suffixes.groupBy("prefix").agg(F.count("*").alias("members")).where("members > 1").select("prefix")
    shared = stored(suffixes.join(twice, "prefix", "left_semi"), "shared-suffixes")
    removed(suffixes)

    first = F.min(F.struct("row", "start")).alias("first")
    spans = shared.groupBy("prefix", *SPAN).agg(F.count("*").alias("members"), first, F.first("windows").alias("windows"))
    spans = stored(spans, "spans")
    unlike = spans.groupBy("prefix").agg(F.count("*").alias("spans")).where("spans > 1").select("prefix")
    plain = spans.join(unlike, "prefix", "left_anti").select("prefix", *SPAN, "first")
    # (row, low, high): first words of the windows that repeat, with the place of the first one's copy.
    whole = shared.join(plain, ["prefix", *SPAN]).select(
        "row", F.col("start").cast("long").alias("low"), (F.col("start") + F.col("windows") - 1).cast("long").alias("high"),
        F.col("first.row").alias("first_row"), F.col("first.start").cast("long").alias("first_low"))

    edges = stored(spans.join(unlike, "prefix", "left_semi"), "edge-spans")
    asked = edges.groupBy(F.col("first.row").alias("row")).agg(
        F.collect_list(F.struct("prefix", *SPAN, F.col("first.start").alias("start"), "windows")).alias("asked"))
    windows = Beside(asked, "asked").mapped(rows.select("row", "text"), _windows(length), "prefix long, span long, span2 long, offset int, window long, window2 long")
    windows = windows.join(edges.select("prefix", *SPAN, "members", "first"), ["prefix", *SPAN])
    windows = stored(windows.select("prefix", *SPAN, "offset", *WINDOW, "members", F.col("first.row").alias("row"),
                                    (F.col("first.start") + F.col("offset")).alias("start")), "windows")
    again = windows.groupBy(*WINDOW).agg(F.sum("members").alias("members"), first).where("members > 1")
    marks = windows.select("prefix", *SPAN, "offset", *WINDOW).join(again, WINDOW)
    marks = marks.groupBy("prefix", *SPAN).agg(F.collect_list(F.struct("offset", "first")).alias("marks"))
    single = shared.join(marks, ["prefix", *SPAN]).select("row", "start", F.explode("marks").alias("m")).select(
        "row", (F.col("start") + F.col("m.offset")).cast("long").alias("low"),
        (F.col("start") + F.col("m.offset")).cast("long").alias("high"),
        F.col("m.first.row").alias("first_row"), F.col("m.first.start").cast("long").alias("first_low"))

    found = whole.union(single)
    in_order = Window.partitionBy("row").orderBy("low")
    goes_on = ((F.col("low") == F.lag(F.col("high")).over(in_order) + 1)
               & (F.col("first_row") == F.lag("first_row").over(in_order))
               & (F.col("first_low") - F.col("low") == F.lag(F.col("first_low") - F.col("low")).over(in_order)))
    found = found.withColumn("new", F.when(goes_on, 0).otherwise(1))
    found = found.withColumn("passage", F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    found = found.groupBy("row", "passage").agg(
        F.min("low").alias("start_word"), (F.max("high") - F.min("low") + length).alias("n_words"),
        F.first("first_row").alias("first_row"), F.min("first_low").alias("first_word"))
    found = stored(found, "passages")
    removed(shared, spans, edges, windows)
    ids = rows.select("row", "doc_id")
    out = found.join(ids, "row").join(ids.select(F.col("row").alias("first_row"), F.col("doc_id").alias("first_doc_id")), "first_row")
    return out.select("row", "doc_id", "start_word", "n_words", "first_row", "first_doc_id", "first_word")


def _cut(text: pa.Array, ranges: list[list[dict]]) -> list[str | None]:
    """Texts without the words of the ranges given, sorted by their first word; null where nothing is left."""
    out: list[str | None] = []
    for low, high, data, offsets in A.slices(text):
        words = A.Words(data, offsets)
        raw = data.tobytes()
        for i in range(high - low):
            first, last = words.bounds[i], words.bounds[i + 1]
            parts, at = [], int(offsets[i])
            for r in ranges[low + i]:
                begin, end = first + r["low"], min(first + r["high"], last)
                cut = int(words.start[begin])
                if cut > at:
                    parts.append(raw[at:cut])
                at = max(at, int(words.start[end]) if end < last else int(words.stop[end - 1]))
            parts.append(raw[at:int(offsets[i + 1])])
            left = b"".join(parts)
            out.append(left.decode("utf-8", "replace") if left.strip(b" \t\n\x0b\x0c\r") else None)
    return out


def _without(column: int):
    def work(batch, hit, entries):
        texts = batch.column(column).to_pylist()
        cut = _cut(batch.column(column).take(pa.array(hit)), entries.column("ranges").to_pylist())
        keep = np.ones(len(batch), bool)
        for i, text in zip(hit.tolist(), cut):
            texts[i], keep[i] = text, text is not None
        columns = [pa.array(texts, c.type) if i == column else c for i, c in enumerate(batch.columns)]
        # Batches without a cut go out as they came, so the schema must be theirs.
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep))
    return work


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with every repeated passage cut out but at its first place; a text left blank goes.

    Where a text repeats itself with a period shorter than ``length``, later places overlap the first and their words go
    with them: the text shrinks to one period, and the first place does not survive whole. Cuts run from a
    passage's first word to the next word kept. All columns stay as they are, the text column
    excepted. Rows that lose nothing, null and blank texts among them, come back unchanged.
    """
    docs = settled(docs)
    found = repeated_passages(docs, id_col, text_col, length)
    later = found.where("row <> first_row or start_word <> first_word")
    ranges = Beside(later.groupBy("row").agg(F.sort_array(F.collect_list(
        F.struct(F.col("start_word").alias("low"), (F.col("start_word") + F.col("n_words")).alias("high")))).alias("ranges")), "ranges")
    place = fresh(docs, "row_place")
    named = docs.select(F.monotonically_increasing_id().alias(place),
                        *[F.col(f"`{c}`").cast("string").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
    return ranges.over(named, _without(1 + docs.columns.index(text_col))).drop(place)
