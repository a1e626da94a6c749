"""Text and multiple-choice scores of one row."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorelake.functions.numbers import BLANKS, strip


def normalised(
    text: Column,
    regexes_to_ignore: list[str] | None = None,
    ignore_case: bool = False,
    ignore_punctuation: bool = False,
    ignore_numbers: bool = False,
) -> Column:
    for pattern in regexes_to_ignore or []:
        text = F.regexp_replace(text, pattern, "")
    if ignore_case:
        text = F.lower(text)
    if ignore_punctuation:
        text = F.translate(text, string.punctuation, "")
    if ignore_numbers:
        text = F.translate(text, string.digits, "")
    return text


def exact_match(prediction: Column, reference: Column, **options) -> Column:
    return (normalised(prediction, **options) == normalised(reference, **options)).cast("double")


def collapsed(text: Column) -> Column:
    """Lower case with single blanks."""
    return F.regexp_replace(strip(F.lower(text)), BLANKS, " ")


def anls(references: Column, prediction: Column, threshold: float = 0.5) -> Column:
    """One minus the smallest normalised edit distance over the references, 0 below the threshold.

    Distances are taken on collapsed text, lengths on the text as given.
    """
    tidy = collapsed(prediction)
    raw_length = F.char_length(F.upper(prediction))

    def distance(reference: Column) -> Column:
        length = F.greatest(F.char_length(F.upper(reference)), raw_length)
        edits = F.levenshtein(collapsed(reference), tidy)
        return F.when(length == 0, F.lit(0.0)).otherwise(edits / length.cast("double"))

    score = 1.0 - F.array_min(F.transform(references, distance))
    return F.when(score >= threshold, score).otherwise(F.lit(0.0))


def best_over(references: Column, score: Callable[[Column], Column]) -> Column:
    return F.array_max(F.transform(references, score))


def any_match(references: Column, score: Callable[[Column], Column]) -> Column:
    """1 when any reference scores above nothing: how several accepted answers are graded."""
    return F.when(F.exists(references, lambda r: score(r) != 0), F.lit(1.0)).otherwise(F.lit(0.0))


def stripped_responses(responses: Column) -> Column:
    return F.transform(responses, strip)


def arg_min(values: Column) -> Column:
    """Zero-based place of the smallest value, the first of equals."""
    return F.array_position(values, F.array_min(values)) - 1


def arg_max(values: Column) -> Column:
    return F.array_position(values, F.array_max(values)) - 1


def choice_scores(
    losses: Column,
    choices: Column,
    gold: Column,
    is_greedy: Column | None = None,
    unconditional: Column | None = None,
) -> Column:
    """Scores of a multiple-choice row. ``losses`` are losses, so the smallest one is the answer.

    ``gold`` is an index, an array of indexes or the text of a choice; out of range counts as -100.
    """
    per_length = F.zip_with(losses, choices, lambda l, c: l / F.char_length(c).cast("double"))
    pred, pred_norm = arg_min(losses), arg_min(per_length)
    fields = {
        "gold": gold,
        "pred": pred,
        "pred_norm": pred_norm,
        "acc": (pred == gold).cast("double"),
        "acc_norm": (pred_norm == gold).cast("double"),
    }
    if is_greedy is not None:
        hit = F.when(gold >= 0, F.get(is_greedy, gold.cast("int"))).otherwise(F.lit(False))
        fields["exact_match"] = F.coalesce(hit, F.lit(False)).cast("int")
    if unconditional is not None:
        gain = F.zip_with(losses, unconditional, lambda a, b: a - b)
        fields["acc_mutual_info"] = (arg_max(gain) == gold).cast("double")
    return F.struct(*[value.alias(name) for name, value in fields.items()])


def gold_index(gold: Column, choices: Column, kind: str = "index") -> Column:
    """Index of the right choice, -100 when there is no such choice."""
    if kind == "index":
        return F.when(gold < F.size(choices), gold).otherwise(F.lit(-100)).cast("bigint")
    return F.when(
        F.array_contains(choices, gold), F.array_position(choices, gold) - 1
    ).otherwise(F.lit(-100)).cast("bigint")


def multi_gold_scores(losses: Column, choices: Column, golds: Column, is_greedy: Column) -> Column:
    """As :func:`choice_scores` when several choices are right."""
    per_length = F.zip_with(losses, choices, lambda l, c: l / F.char_length(c).cast("double"))
    valid = F.transform(golds, lambda g: F.when(g < F.size(choices), g).otherwise(F.lit(-100)).cast("bigint"))
    return F.struct(
        F.array_contains(valid, arg_min(losses)).cast("double").alias("acc"),
        F.array_contains(valid, arg_min(per_length)).cast("double").alias("acc_norm"),
        F.exists(
            valid, lambda g: (g != -100) & F.coalesce(F.get(is_greedy, g.cast("int")), F.lit(False))
        ).cast("int").alias("exact_match"),
    )


def likelihood_scores(loglikelihood: Column, is_greedy: Column) -> Column:
    return F.struct(loglikelihood.alias("perplexity"), is_greedy.cast("int").alias("acc"))


def brier(probabilities: Column, gold: Column) -> Column:
    """Squared distance between the probabilities and the one-hot truth."""
    parts = F.transform(
        probabilities,
        lambda p, i: F.pow(p.cast("double") - F.when(i == gold, 1.0).otherwise(0.0), F.lit(2.0)),
    )
    return F.aggregate(parts, F.lit(0.0), lambda total, part: total + part)
