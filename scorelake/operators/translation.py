"""Corpus BLEU, chrF and TER.

Each row yields a few counts; the corpus score is a formula over their sums, so the job is one pass and
one tiny aggregate. Counting runs in Python workers because clipped n-gram matches need a multiset per
text, which array lambdas can only do in quadratic time. The rules follow the published definitions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Orders and weight of the published scores, and the patterns of the 13a rules below.
BLEU_ORDER = 4
CHRF_ORDER = 6
CHRF_BETA = 2


def tokens_13a(text: Column) -> Column:
    """Tokens by the 13a rules, as one string with single blanks."""
    out = F.replace(text, F.lit("<skipped>"), F.lit(""))
    for find, put in (("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        out = F.replace(out, F.lit(find), F.lit(put))
    out = F.concat(F.lit(" "), out, F.lit(" "))
    out = F.regexp_replace(out, r"([\x7B-\x7E\x5B-\x60\x20-\x26\x28-\x2B\x3A-\x40\x2F])", " $1 ")
    out = F.regexp_replace(out, r"([^0-9])([\.,])", "$1 $2 ")
    out = F.regexp_replace(out, r"([\.,])([^0-9])", " $1 $2")
    out = F.regexp_replace(out, r"([0-9])(-)", "$1 $2 ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def _grams(items: Sequence, n: int) -> Counter:
    return Counter(tuple(items[i : i + n]) for i in range(len(items) - n + 1))


def _bleu_counts(pred: str, refs: Sequence[str]) -> list[int]:
    words = pred.split()
    ref_words = [r.split() for r in refs]
    closest = min((abs(len(r) - len(words)), len(r)) for r in ref_words)[1]
    out = [len(words), closest]
    for n in range(1, BLEU_ORDER + 1):
        have = _grams(words, n)
        best: Counter = Counter()
        for r in ref_words:
            best |= _grams(r, n)
        out += [sum((have & best).values()), sum(have.values())]
    return out


def _chrf_counts(pred: str, refs: Sequence[str]) -> list[int]:
    squeezed = "".join(pred.split())
    options = []
    for ref in refs:
        tight = "".join(ref.split())
        counts: list[int] = []
        for n in range(1, CHRF_ORDER + 1):
            a = Counter(squeezed[i : i + n] for i in range(len(squeezed) - n + 1))
            b = Counter(tight[i : i + n] for i in range(len(tight) - n + 1))
            counts += [sum(a.values()) if tight[n - 1 :] else 0, sum(b.values()), sum((a & b).values())]
        options.append(counts)
    return max(options, key=_chrf_value)


def _chrf_value(counts: Sequence[float]) -> float:
    precision = recall = 0.0
    orders = 0
    for hyp, ref, match in zip(counts[0::3], counts[1::3], counts[2::3]):
        if hyp > 0 and ref > 0:
            precision += match / hyp
            recall += match / ref
            orders += 1
    if not orders:
        return 0.0
    precision, recall = precision / orders, recall / orders
    if precision + recall == 0:
        return 0.0
    return (1 + CHRF_BETA**2) * precision * recall / (CHRF_BETA**2 * precision + recall)


#: Cells of edit tables worked on side by side.
CELLS = 1 << 20
#: Above every distance.
FAR = 1 << 28

Pair = tuple[list[int], list[int]]


def _stacked(sequences: Sequence[Sequence[int]], fill: int) -> np.ndarray:
    out = np.full((len(sequences), max(map(len, sequences), default=0)), fill, np.int32)
    for row, held in zip(out, sequences):
        row[:len(held)] = held
    return out


def _steps(row: np.ndarray, words: np.ndarray, sizes: np.ndarray, refs: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of edit tables, all side by side, after each word of ``words``. Longest sequences come first; those that have ended
    keep their last row. ``row`` is changed in place."""
    columns = np.arange(row.shape[1], dtype=np.int32)
    for step in range(words.shape[1]):
        n = int(np.searchsorted(-sizes, -step, side="left"))
        part = row[:n]
        new = np.empty_like(part)
        new[:, 0] = part[:, 0] + 1
        new[:, 1:] = np.minimum(part[:, 1:] + 1, part[:, :-1] + (refs[:n] != words[:n, step, None]))
        row[:n] = np.minimum.accumulate(new - columns, axis=1) + columns
        yield row


def _tables(pairs: Sequence[Pair]) -> list[np.ndarray]:
    """Edit distances between all prefixes of each pair."""
    out: list[np.ndarray] = [np.empty(0)] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda i: (-len(pairs[i][0]), len(pairs[i][1])))
    at = 0
    while at < len(order):
        widest, n = 0, 0
        while at + n < len(order):
            widest = max(widest, len(pairs[order[at + n]][1]))
            if n and (n + 1) * (widest + 1) * (len(pairs[order[at]][0]) + 1) > CELLS:
                break
            n += 1
        own = order[at:at + n]
        words, refs = _stacked([pairs[i][0] for i in own], -1), _stacked([pairs[i][1] for i in own], -2)
        whole = np.empty((words.shape[1] + 1, len(own), refs.shape[1] + 1), np.int32)
        whole[0] = np.arange(refs.shape[1] + 1)
        for step, after in enumerate(_steps(whole[0].copy(), words, np.array([len(pairs[i][0]) for i in own]), refs), 1):
            whole[step] = after
        for k, i in enumerate(own):
            out[i] = whole[:len(pairs[i][0]) + 1, k, :len(pairs[i][1]) + 1]
        at += n
    return out


def _spliced(starts: list[np.ndarray], words: list[list[int]], refs: list[list[int]], ends: list[np.ndarray]) -> np.ndarray:
    """Edit distances of sequences that differ from known ones in a stretch only: ``starts`` are the rows before it, ``words`` the
    stretch, ``ends`` the distances from every column to the end after it."""
    out = np.empty(len(words), np.int64)
    order = sorted(range(len(words)), key=lambda i: (-len(words[i]), len(refs[i])))
    widest = max(map(len, refs)) + 1
    step = max(1, CELLS // widest)
    for at in range(0, len(order), step):
        own = order[at:at + step]
        held, goal = _stacked([words[i] for i in own], -1), _stacked([refs[i] for i in own], -2)
        row, end = _stacked([starts[i] for i in own], FAR), _stacked([ends[i] for i in own], FAR)
        for _ in _steps(row, held, np.array([len(words[i]) for i in own]), goal):
            pass
        out[own] = (row.astype(np.int64) + end).min(axis=1)
    return out


# Limits of the shift search in the published TER procedure.
MAX_SHIFT_SIZE = 10
MAX_SHIFT_DISTANCE = 50


def _alignment(table: np.ndarray, hyp: Sequence[int], ref: Sequence[int]) -> tuple[list[bool], list[bool], list[int]]:
    """For the best path: which hypothesis and reference words are wrong, and where each reference word aligns."""
    i, j = len(hyp), len(ref)
    hyp_wrong, ref_wrong, at = [False] * i, [False] * j, [-1] * j
    while i or j:
        same = i and j and table[i, j] == table[i - 1, j - 1] + (hyp[i - 1] != ref[j - 1])
        if same:
            wrong = hyp[i - 1] != ref[j - 1]
            i, j = i - 1, j - 1
            hyp_wrong[i], ref_wrong[j], at[j] = wrong, wrong, i
        elif i and table[i, j] == table[i - 1, j] + 1:
            i -= 1
            hyp_wrong[i] = True
        else:
            j -= 1
            ref_wrong[j], at[j] = True, i - 1
    return hyp_wrong, ref_wrong, at


def _shifts(hyp: list[int], ref: list[int], table: np.ndarray) -> list[tuple[int, int, int]]:
    """(length, start, where it goes) of every phrase that may move: one that stands wrong both here and in the reference."""
    hyp_wrong, ref_wrong, at = _alignment(table, hyp, ref)
    places: dict[int, list[int]] = {}
    for j, word in enumerate(ref):
        places.setdefault(word, []).append(j)
    out = []
    for start in range(len(hyp)):
        for j in places.get(hyp[start], ()):
            if abs(j - start) > MAX_SHIFT_DISTANCE:
                continue
            length, wrong_here, wrong_there = 0, False, False
            while length < MAX_SHIFT_SIZE and start + length < len(hyp) and j + length < len(ref) and hyp[start + length] == ref[j + length]:
                wrong_here |= hyp_wrong[start + length]
                wrong_there |= ref_wrong[j + length]
                length += 1
                if wrong_here and wrong_there and not start <= at[j] < start + length:
                    out.append((length, start, (at[j] + 1) if at[j] < start else (at[j] + 1 - length)))
    return out


def _moved(hyp: list[int], length: int, start: int, goes: int) -> list[int]:
    rest = hyp[:start] + hyp[start + length:]
    return rest[:goes] + hyp[start:start + length] + rest[goes:]


def _best_shifts(pairs: Sequence[Pair], tables: Sequence[np.ndarray]) -> list[tuple[int, list[int]]]:
    """For each pair the phrase move that saves most edits. What stands before and after the words that a move changes is not
    worked out again: the table of the pair gives the distances up to there, that of the pair read backwards those from there."""
    back = _tables([(hyp[::-1], ref[::-1]) for hyp, ref in pairs])
    known: dict[tuple, int] = {}
    starts, words, refs, ends, moves = [], [], [], [], []
    for k, ((hyp, ref), table) in enumerate(zip(pairs, tables)):
        for length, start, goes in _shifts(hyp, ref, table):
            moved = _moved(hyp, length, start, goes)
            if moved == hyp:
                continue
            # A place behind the last word, or before the first, counts as there.
            place = min(max(goes if goes >= 0 else len(hyp) - length + goes, 0), len(hyp) - length)
            low, high = min(start, place), max(start, place) + length
            key = (k, low, high, tuple(moved[low:high]))
            if key not in known:
                known[key] = len(words)
                starts.append(table[low])
                words.append(moved[low:high])
                refs.append(ref)
                ends.append(back[k][len(hyp) - high][::-1])
            moves.append((k, length, start, goes, known[key]))
    best = [(0, 0, 0, 0)] * len(pairs)
    if moves:
        distance = _spliced(starts, words, refs, ends)
        for k, length, start, goes, at in moves:
            best[k] = max(best[k], (int(tables[k][-1, -1]) - int(distance[at]), length, -start, -goes))
    return [(saved, _moved(hyp, length, -start, -goes) if saved > 0 else hyp)
            for (saved, length, start, goes), (hyp, _) in zip(best, pairs)]


def _ter_edits_of(texts: Sequence[tuple[Sequence[str], Sequence[str]]]) -> list[int]:
    """Shifts plus edits of many (hypothesis, reference) pairs by the greedy search, side by side. Meant for sentences: the cost
    grows with the square of the length."""
    pairs: list[Pair] = []
    for pred, ref in texts:
        ids: dict[str, int] = {}
        pairs.append(([ids.setdefault(w, len(ids)) for w in pred], [ids.setdefault(w, len(ids)) for w in ref]))
    shifts, edits = [0] * len(pairs), [len(hyp) for hyp, _ in pairs]
    active = [i for i, (_, ref) in enumerate(pairs) if ref]
    while active:
        tables = _tables([pairs[i] for i in active])
        held = []
        for i, table in zip(active, tables):
            edits[i] = int(table[-1, -1])
            if edits[i]:
                held.append((i, table))
        active = []
        for (i, _), (saved, moved) in zip(held, _best_shifts([pairs[i] for i, _ in held], [t for _, t in held])):
            if saved > 0:
                shifts[i] += 1
                pairs[i] = moved, pairs[i][1]
                active.append(i)
    return [a + b for a, b in zip(shifts, edits)]


def _ter_edits(pred: Sequence[str], ref: Sequence[str]) -> int:
    return _ter_edits_of([(pred, ref)])[0]


#: Texts whose shifts are searched side by side.
TEXTS = 256


def _ter_counts(preds: Sequence[str], refs: Sequence[Sequence[str]]) -> list[list[float]]:
    """Fewest edits against any reference, and the references' mean length, of each row."""
    out: list[list[float]] = []
    for low in range(0, len(preds), TEXTS):
        words = [p.lower().split() for p in preds[low:low + TEXTS]]
        goals = [[r.lower().split() for r in own] for own in refs[low:low + TEXTS]]
        edits = iter(_ter_edits_of([(w, g) for w, own in zip(words, goals) for g in own]))
        out += [[float(min(next(edits) for _ in own)), sum(map(len, own)) / len(own)] for own in goals]
    return out


def _each(counter):
    """A counter of one row for many."""
    return lambda preds, refs: [counter(p, r) for p, r in zip(preds, refs)]


COUNTERS = {"bleu": _each(_bleu_counts), "chrf": _each(_chrf_counts), "ter": _ter_counts}
WIDTHS = {"bleu": 2 + 2 * BLEU_ORDER, "chrf": 3 * CHRF_ORDER, "ter": 2}


def row_counts(df: DataFrame, metric: str, pred: Column, refs: Column, keep: Sequence[str] = ()) -> DataFrame:
    """The counts of every row as ``s0, s1, …``."""
    counter, width = COUNTERS[metric], WIDTHS[metric]
    if metric == "bleu":
        pred, refs = tokens_13a(pred), F.transform(refs, tokens_13a)
    slim = df.select(*keep, pred.alias("_pred"), refs.alias("_refs"))
    names = [f"s{i}" for i in range(width)]
    schema = T.StructType(
        [*[slim.schema[c] for c in keep], *[T.StructField(n, T.DoubleType()) for n in names]]
    )

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = counter(batch["_pred"].tolist(), [list(r) for r in batch["_refs"]])
            table = pd.DataFrame(counts, columns=names, index=batch.index).astype("float64")
            yield pd.concat([batch[list(keep)], table], axis=1)

    return slim.mapInPandas(count, schema)


def _log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x)).otherwise(F.lit(-9999999999.0))


def bleu_score(s: Sequence[Column]) -> Column:
    """Score out of 100 with exponential smoothing of orders without a match."""
    hyp, ref = s[0], s[1]
    matches, totals = s[2::2], s[3::2]
    halving = F.lit(1.0)
    logs, open_orders = [], F.lit(True)
    for match, total in zip(matches, totals):
        open_orders = open_orders & (total > 0)
        halving = F.when(open_orders & (match == 0), halving * 2).otherwise(halving)
        value = F.when(match == 0, 100.0 / (halving * total)).otherwise(100.0 * match / total)
        logs.append(F.when(open_orders, _log(value)).otherwise(_log(F.lit(0.0))))
    brevity = F.when(hyp == 0, F.lit(0.0)).when(hyp < ref, F.exp(1 - ref / hyp)).otherwise(F.lit(1.0))
    any_match = matches[0] + matches[1] + matches[2] + matches[3]
    mean = (logs[0] + logs[1] + logs[2] + logs[3]) / BLEU_ORDER
    return F.when(any_match == 0, F.lit(0.0)).otherwise(brevity * F.exp(mean))


def chrf_score(s: Sequence[Column]) -> Column:
    precision = recall = orders = F.lit(0.0)
    for hyp, ref, match in zip(s[0::3], s[1::3], s[2::3]):
        both = (hyp > 0) & (ref > 0)
        precision = precision + F.when(both, match / hyp).otherwise(F.lit(0.0))
        recall = recall + F.when(both, match / ref).otherwise(F.lit(0.0))
        orders = orders + both.cast("double")
    p, r = precision / orders, recall / orders
    factor = float(CHRF_BETA**2)
    score = F.when(p + r > 0, 100.0 * (1 + factor) * p * r / (factor * p + r)).otherwise(F.lit(0.0))
    return F.when(orders > 0, score).otherwise(F.lit(0.0))


def ter_score(s: Sequence[Column]) -> Column:
    return (
        F.when(s[1] > 0, 100.0 * s[0] / s[1]).when(s[0] > 0, F.lit(100.0)).otherwise(F.lit(0.0))
    )


FORMULAS = {"bleu": bleu_score, "chrf": chrf_score, "ter": ter_score}


def corpus_score(df: DataFrame, metric: str, pred: Column, refs: Column, by: Sequence[str] = ()) -> DataFrame:
    counts = row_counts(df, metric, pred, refs, by)
    sums = counts.groupBy(*by).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(WIDTHS[metric])])
    score = FORMULAS[metric]([F.col(f"s{i}") for i in range(WIDTHS[metric])])
    return sums.select(*by, score.alias(metric))
