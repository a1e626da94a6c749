"""Quality scores by pairwise ranking (Bradley-Terry) over features of the text alone.

For a good document i and a bad document j the model says P(i before j) = sigmoid(w . (x_i - x_j)). The
weights come from Newton steps on the logistic loss of feature differences, with a ridge. The cut between
good and bad is a quantile of the training documents' scores; the reported score is the logistic function of
the distance to that cut, moved so that the cut falls on ``CUT_SCORE``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm import arrays as A
from scorelake.llm import text_measures as M
from scorelake.llm.storage import small_batches, with_text

#: Labelled documents the model is fitted on at most, the first by a hash of the id.
MAX_LABELLED = 20_000
PAIRS = 60_000
RIDGE = 1e-2
STEPS = 15
CUT_SCORE = 0.3
LOST = 2
SEED = 17

LEVELS = ("upper", "digit", "mark", "symbol", "wide", "stop", "blank", "rules_symbol", "repeated", "dup_lines", "distinct", "top_word")


def features(words: A.Words) -> np.ndarray:
    """One row of features for each text, all zero for a text without words."""
    h = words.hashes()
    counts = M.base_counts(words, h)
    classes = M.class_counts(words.data, words.offsets)
    n, chars = counts["n_words"], classes.sum(axis=1)
    per_char, per_word = np.maximum(chars, 1)[:, None], np.maximum(n, 1)
    shares = classes / per_char
    key = A.joined(h, words.text_of_word().astype(np.uint64))
    order = np.argsort(key, kind="stable")
    new = np.concatenate(([True], key[order][1:] != key[order][:-1])) if len(key) else np.empty(0, bool)
    at = np.flatnonzero(new)
    text = words.text_of_word()[order[at]] if len(at) else np.empty(0, np.int64)
    distinct = np.bincount(text, minlength=len(n))
    top = np.zeros(len(n), np.int64)
    np.maximum.at(top, text, np.diff(np.append(at, len(key))))
    lines = A.sums(words.data == 10, words.offsets) + 1
    level = np.stack([
        *[shares[:, M.CLASSES.index(c)] for c in LEVELS[:7]], counts["n_symbols"] / np.maximum(chars, 1),
        counts["n_repeat_words"] / per_word, counts["n_dup_lines"] / lines, distinct / per_word, top / per_word], 1)
    size = np.stack([np.log1p(n), np.log1p(counts["word_chars"] / per_word), np.log1p(lines / per_word * 10)], 1)
    out = np.concatenate((level, np.sqrt(level), np.log1p(100 * level), level > 0.02, size,
                          (n < 50)[:, None], (n < 20)[:, None]), axis=1)
    out[n == 0] = 0
    return out


def _feature_rows(batches):
    for batch in batches:
        for low, high, data, offsets in A.slices(batch.column(1)):
            x = features(A.Words(data, offsets))
            yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], batch.column(2)[low:high], pa.array(list(x))], ["label", "id", "x"])


@dataclass(frozen=True)
class Ranking:
    """``cut`` is the score at the chosen quantile; ``weights`` apply to (x - mean) / scale."""
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.raw(x) - self.cut + np.log(CUT_SCORE / (1 - CUT_SCORE)), -40, 40)
        return 1 / (1 + np.exp(-z))


def fitted(x: np.ndarray, good: np.ndarray) -> Ranking | None:
    """Model of labelled rows; None without both labels."""
    if not good.any() or good.all():
        return None
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(SEED)
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    d = z[rng.choice(better, PAIRS)] - z[rng.choice(worse, PAIRS)]
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -40, 40)))
        gradient = d.T @ (1 - p) / PAIRS - RIDGE * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / PAIRS + RIDGE * np.eye(len(w))
        w = w + np.linalg.solve(hessian, gradient)
    raw = z @ w
    # The quantile that parts good from bad best; a good document lost weighs as much as LOST bad ones passed.
    order = np.argsort(raw, kind="stable")
    missed = np.cumsum(good[order]) / good.sum()
    passed = 1 - np.cumsum(~good[order]) / (~good).sum()
    best = int(np.argmin(LOST * missed + passed))
    above = raw[order[min(best + 1, len(raw) - 1)]]
    return Ranking(w, mean, scale, float((raw[order[best]] + above) / 2))


def learned(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            label_col: str = "quality") -> Ranking | None:
    """Fit on labelled documents whose crc32 of the id is not divisible by five.

    At most ``MAX_LABELLED`` labels are used, the first by a hash of the id, so that the sample is the same
    on every run and joins as a table of bounded size. Null labels and ids and other label values are left
    out; a label given twice counts once, the lower of two, and so does a document that repeats a labelled id.
    """
    small_batches(docs)
    known = labels.where(F.col(label_col).isin(0, 1)).where(F.crc32(F.col(id_col).cast("string")) % 5 != 0)
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(MAX_LABELLED)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(sample), "id").select("label", "text", "id").mapInArrow(_feature_rows, "label int, id long, x array<double>")
    # Of rows that share an id one counts, so that no id takes the place of others.
    found = rows.groupBy("id", "label").agg(F.min("x").alias("x")).orderBy(F.xxhash64("label", "x"), "id").select("label", "x").toArrow()
    if not len(found):
        return None
    x = np.array(found["x"].combine_chunks().flatten()).reshape(len(found), -1)
    return fitted(x, found["label"].to_numpy() == 1)


def _scored(model: Ranking | None, extra: int, place: int):
    def run(batches):
        for batch in batches:
            parts = []
            for _, _, data, offsets in A.slices(batch.column(place)):
                words = A.Words(data, offsets)
                parts.append(np.full(len(words.counts), 0.5) if model is None else model.score(features(words)))
            score = np.concatenate(parts) if parts else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:extra], pa.array(score)], [*batch.schema.names[:extra], "score"])
    return run


def quality_scores(docs: DataFrame, model: Ranking | None, keys: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keys`` and a score from 0 to 1 for every row; null, empty and blank texts get the score of
    all-zero features. Without a model (no labelled pair) every score is 0.5. Repeated rows score alike. A key named ``score``
    comes back as ``score_``."""
    held, kinds, place = with_text(docs, keys, text_col, added=["score"])
    return held.mapInArrow(_scored(model, len(keys), place), f"{kinds}score double")
