"""Quality rules: base counts, and the divergence of a text's histograms from those of each language.

A language's references are gathered from the whole corpus: the median share of each character class over its
texts, which a minority of odd texts cannot move, and the share of each common word (lower-cased A-Z), which is one that makes up at least 1 / ``COMMON`` of the
language's words, so a language has at most ``COMMON`` of them, and one entry for all other words. Copies of a text count
once, a text weighs no more than ``MAX_TEXT_WORDS`` of its words, and one that mostly repeats itself gives no words. A text
diverges from a language by the Jensen-Shannon distance (base 2, 0 to 1) of each of the two histograms. It is
kept when some language is near enough by both, whatever its own label says; one whose label has no reference is not compared.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm import arrays as A
from scorelake.llm import text_measures as M
from scorelake.llm.beside import Beside
from scorelake.llm.storage import fresh, removed, remove_path, settled, small_batches, stored, with_text

COMMON = 200
#: A language of fewer words gives no reference.
MIN_REFERENCE_WORDS = 2000
#: The words of a longer text are weighed down to so many.
MAX_TEXT_WORDS = 1000
#: Parts of a word that weights are counted in.
PARTS = 1_000_000
#: Language codes beyond this number stop the job: the references travel with every task.
MAX_LANGUAGES = 500
#: Words held by a task before it hands on their counts.
HELD_WORDS = 1_500_000

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A text of fewer words is not compared by words, one of fewer characters not by classes.
MIN_WORDS_COMPARED = 100
MIN_CHARS_COMPARED = 200
MAX_CLASS_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.4

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class References:
    """``classes`` (languages x classes) and ``words`` (languages x common words, and the rest) as shares."""
    languages: tuple[str, ...]
    classes: np.ndarray
    common: np.ndarray
    words: np.ndarray


def _word_counts(batches):
    """(lang, key, n): how often each word stands in each language, in parts of a word, summed over some millions of words."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def summed():
        for lang, parts in held.items():
            key, weight = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(key)
            key = key[order]
            at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            n = np.add.reduceat(weight[order], at)
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(at)), pa.array(key[at]), pa.array(n)],
                                             ["lang", "key", "n"])
        held.clear()

    for batch in batches:
        langs = batch.column(0).to_pylist()
        for low, high, data, offsets in A.slices(batch.column(1)):
            words = A.Words(data, offsets)
            hashes = words.hashes(lower=True)
            h = A.signed(hashes)
            weight = PARTS * np.minimum(words.counts, MAX_TEXT_WORDS) // np.maximum(words.counts, 1)
            weight[100 * M.repeated_words(words, hashes, 3) > MAX_REPEAT_PERCENT * words.counts] = 0
            weight = np.repeat(weight.astype(np.int64), words.counts)
            code: dict[str, int] = {}
            own = np.repeat([code.setdefault(x, len(code)) for x in langs[low:high]], words.counts)
            for lang, c in code.items():
                mine = (own == c) & (weight > 0)
                if mine.any():
                    held.setdefault(lang, []).append((h[mine], weight[mine]))
            size += len(h)
            if size > HELD_WORDS:
                yield from summed()
                size = 0
    yield from summed()


def _class_shares(batches):
    """(lang, share of each class) of every text long enough to be compared."""
    for batch in batches:
        parts = []
        for _, _, data, offsets in A.slices(batch.column(1)):
            parts.append(_shares(M.class_counts(data, offsets)))
        shares = np.concatenate(parts) if parts else np.empty((0, len(M.CLASSES)))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(shares[:, c]) for c in range(len(M.CLASSES))]],
                                         ["lang", *M.CLASSES])


def _of_firsts(firsts: Beside, work):
    """``work`` on (lang, text) of the rows (row, lang, text) that are the first of their copies."""
    def firsts_of(batches):
        for batch in batches:
            hit, _ = firsts.of(batch.column(0).to_numpy())
            if len(hit):
                yield batch.select(["lang", "text"]).take(pa.array(hit))

    return lambda batches: work(firsts_of(batches))


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> References:
    """The references of every language of the corpus with ``MIN_REFERENCE_WORDS`` words, of the ``MAX_LANGUAGES`` with the most
    words where labels name more; rows of a null language or text give nothing."""
    small_batches(docs)
    docs = settled(docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "lang", "text")
    known_texts = texts.where("lang is not null and text is not null")
    copies = known_texts.groupBy("lang", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    firsts = Beside(copies.agg(F.min("row").alias("row")).select("row"), "first-texts")
    counts = texts.mapInArrow(_of_firsts(firsts, _word_counts), "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    counts = stored(counts, "word-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).where(F.col("total") >= MIN_REFERENCE_WORDS * PARTS)
    totals = totals.orderBy(F.desc("total"), "lang").limit(MAX_LANGUAGES).collect()
    total = {r.lang: r.total for r in totals}
    known = sorted(total)
    if not known:
        removed(counts)
        remove_path(docs.sparkSession, firsts.path)
        return References((), np.zeros((0, len(M.CLASSES))), np.empty(0, np.int64), np.zeros((0, 1)))
    least = F.create_map(*[x for lang in known for x in (F.lit(lang), F.lit(total[lang]))])[F.col("lang")]
    rows = counts.where(F.col("n") * COMMON >= least).collect()
    removed(counts)
    common = np.array(sorted({r.key for r in rows}), np.int64)
    words = np.zeros((len(known), len(common) + 1))
    for r in rows:
        words[known.index(r.lang), np.searchsorted(common, r.key)] = r.n / total[r.lang]
    words[:, -1] = np.maximum(1 - words.sum(axis=1), 0)

    long_enough = texts.where(F.octet_length("text") >= MIN_CHARS_COMPARED).where(F.col("lang").isin(known))
    shares = long_enough.mapInArrow(_of_firsts(firsts, _class_shares), "lang string, " + ", ".join(f"{c} double" for c in M.CLASSES))
    middle = shares.groupBy("lang").agg(*[F.percentile_approx(c, 0.5, 1000).alias(c) for c in M.CLASSES])
    classes = np.zeros((len(known), len(M.CLASSES)))
    for r in middle.collect():
        classes[known.index(r.lang)] = [r[c] for c in M.CLASSES]
    remove_path(docs.sparkSession, firsts.path)
    removed(docs)
    return References(tuple(known), _shares(classes), common, words)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of ``p`` from ``q``; both are shares."""
    middle = (p + q) / 2

    def half(x):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / middle), 0).sum(axis=-1)

    return np.sqrt(np.clip((half(p) + half(np.broadcast_to(q, p.shape))) / 2, 0, 1))


def _shares(counts: np.ndarray) -> np.ndarray:
    total = counts.sum(axis=1, keepdims=True)
    return counts / np.where(total > 0, total, 1)


def distances(words: A.Words, h: np.ndarray, ref: References) -> tuple[np.ndarray, np.ndarray]:
    """(texts x languages) distances by character classes and by common words."""
    n, wide = len(words.counts), len(ref.common) + 1
    classes = _shares(M.class_counts(words.data, words.offsets))
    place = np.searchsorted(ref.common, A.signed(h))
    place[place == len(ref.common)] = 0
    if len(ref.common):
        place = np.where(ref.common[place] == A.signed(h), place, wide - 1)
    else:
        place = np.zeros(len(h), np.int64)
    used = _shares(np.bincount(words.text_of_word() * wide + place, minlength=n * wide).reshape(n, wide))
    by_class, by_word = np.zeros((n, len(ref.languages))), np.zeros((n, len(ref.languages)))
    for i in range(len(ref.languages)):
        by_class[:, i] = js_distance(classes, ref.classes[i])
        by_word[:, i] = js_distance(used, ref.words[i])
    return by_class, by_word


def _verdicts(ref: References, extra: int, place: int):
    def run(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in (*COUNTS, "base_failed", "class_distance", "word_distance", "language", "kept")}
            for low, high, data, offsets in A.slices(batch.column(place)):
                words = A.Words(data, offsets)
                counts = M.base_counts(words, words.hashes())
                for k in COUNTS:
                    out[k].append(counts[k])
                n = counts["n_words"]
                failed = (n < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * n)
                kept = ~failed
                best = np.full(len(n), -1)
                near = [np.full(len(n), np.nan), np.full(len(n), np.nan)]
                if ref.languages:
                    by_class, by_word = distances(words, words.hashes(lower=True), ref)
                    by_class[np.diff(offsets) < MIN_CHARS_COMPARED] = 0
                    by_word[n < MIN_WORDS_COMPARED] = 0
                    worst = np.maximum(by_class / MAX_CLASS_DISTANCE, by_word / MAX_WORD_DISTANCE)
                    best = worst.argmin(axis=1)
                    rows = np.arange(len(n))
                    kept &= worst[rows, best] <= 1
                    near = [by_class[rows, best], by_word[rows, best]]
                    # A label without a reference: nothing to compare with.
                    alone = batch.column(extra - 1).to_numpy(zero_copy_only=False)[low:high]
                    kept[alone] = ~failed[alone]
                    best[alone] = -1
                    for distance in near:
                        distance[alone] = np.nan
                out["base_failed"].append(failed)
                out["class_distance"].append(near[0])
                out["word_distance"].append(near[1])
                out["language"].append(best)
                out["kept"].append(kept)
            cols = {k: np.concatenate(v) if v else np.empty(0) for k, v in out.items()}
            names = np.array([*ref.languages, None], object)
            arrays = [*batch.columns[:extra]]
            for k in out:
                if k == "language":
                    arrays.append(pa.array(names[cols[k].astype(int)], pa.string()))
                elif k in COUNTS:
                    arrays.append(pa.array(cols[k].astype(np.int64)))
                elif k in ("base_failed", "kept"):
                    arrays.append(pa.array(cols[k].astype(bool)))
                else:
                    arrays.append(pa.array(cols[k].astype(float), from_pandas=True))
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:extra], *out])
    return run


def quality_rules(docs: DataFrame, keys: list[str], text_col: str = "text", lang_col: str = "lang",
                  ref: References | None = None) -> DataFrame:
    """The columns ``keys`` of every row with its counts, distances to the nearest language, and verdict.

    ``base_failed``: fewer than 50 words, or more than half of them inside repeated runs of three words.
    ``kept``: not failed, and within both distances of some language. Short texts are not compared: by classes
    below 200 bytes, by words below 100 words. A text labelled with a language that has no reference is not compared: its
    distances and ``language`` are null and only the base rules decide; a text of a null label is compared. With no reference at all (an empty corpus, only null languages, or too
    few words) distances and ``language`` are null and only the base rules decide. A null text has no words and
    fails. Repeated rows are judged one by one. A key that bears the name of an added column comes back with a ``_`` behind it.
    """
    if ref is None:
        ref = references(docs, text_col, lang_col)
    alone = fresh(docs, "no_reference")
    labelled = F.col(f"`{lang_col}`").cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    docs = docs.withColumn(alone, labelled.isNotNull() & ~F.coalesce(labelled.isin(list(ref.languages)), F.lit(False)))
    names = [*COUNTS, "base_failed", "class_distance", "word_distance", "language", "kept"]
    held, kinds, place = with_text(docs, [*keys, alone], text_col, added=names)
    added = ", ".join([f"{c} long" for c in COUNTS] + ["base_failed boolean", "class_distance double",
                                                       "word_distance double", "language string", "kept boolean"])
    return held.mapInArrow(_verdicts(ref, len(keys) + 1, place), kinds + added).drop(alone)
