"""Named response pipelines: ordered filters over all the responses of a document.

Every step maps an array-of-text column to the next column; the result is stored under the name of the
pipeline. A document has as many responses as the run repeats its prompt, a handful.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions import answers

Step = Callable[[Column], Column]


def each(text_filter: Callable[..., Column], **options) -> Step:
    return lambda responses: F.transform(responses, lambda r: text_filter(r, **options))


def take_first() -> Step:
    return lambda responses: F.get(responses, F.lit(0))


def take_first_k(k: int) -> Step:
    def step(responses: Column) -> Column:
        short = F.raise_error(F.lit(f"fewer than {k} responses to take from"))
        return F.when(F.size(responses) >= k, F.slice(responses, 1, k)).otherwise(
            short.cast("array<string>")
        )

    return step


def majority_vote() -> Step:
    """The most frequent response, the earliest of equals, as a one-element array."""

    def step(responses: Column) -> Column:
        distinct = F.array_distinct(responses)
        counted = F.transform(
            distinct,
            lambda d, i: F.struct(F.size(F.filter(responses, lambda r: r == d)).alias("n"), (-i).alias("at"), d.alias("text")),
        )
        return F.array(F.array_max(counted)["text"])

    return step


def map_to(table: dict[str, str], default: str | None = None) -> Step:
    def step(responses: Column) -> Column:
        if not table:
            return F.transform(responses, lambda r: F.lit(default).cast("string"))
        lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
        found = lambda r: F.coalesce(F.try_element_at(lookup, r), F.lit(default).cast("string"))
        return F.transform(responses, found)

    return step


def simple_multi_choice(question: str = "question") -> Step:
    """Keeps only the answer of the first response."""
    return lambda responses: answers.simple_choice_text(F.get(responses, F.lit(0)), F.col(question))


def multi_choice(choices: str = "choices", **options) -> Step:
    return each(answers.multi_choice_text, choices=F.col(choices), **options)


FILTERS: dict[str, Callable[..., Step]] = {
    "take_first": take_first,
    "take_first_k": take_first_k,
    "majority_vote": majority_vote,
    "regex": lambda **o: each(
        answers.regex_text, **{("pattern" if k == "regex_pattern" else k): v for k, v in o.items()}
    ),
    "remove_whitespace": lambda: each(answers.drop_leading_blank_text),
    "lowercase": lambda: each(F.lower),
    "uppercase": lambda: each(F.upper),
    "map": lambda mapping_dict=None, default_value=None: map_to(mapping_dict or {}, default_value),
    "multi_choice_regex": lambda **o: multi_choice(
        **{("pattern" if k == "regex_pattern" else k): v for k, v in o.items()}
    ),
    "simple_multi_choice": simple_multi_choice,
    "reasoning_answer": lambda: each(answers.reasoning_answer_text),
    "vqa_answer": lambda: each(answers.vqa_answer_text),
}
DEFAULT_PIPELINE = {"none": [("take_first", {})]}


def build(steps: Sequence[tuple[str, dict | None] | Step]) -> Step:
    built = [s if callable(s) else FILTERS[s[0]](**(s[1] or {})) for s in steps]

    def run(responses: Column) -> Column:
        for step in built:
            responses = step(responses)
        return responses

    return run


def apply_pipelines(
    df: DataFrame, pipelines: dict[str, Sequence] | None = None, responses: str = "resps"
) -> DataFrame:
    """One output column per pipeline, named after it."""
    pipelines = pipelines or DEFAULT_PIPELINE
    return df.withColumns({name: build(steps)(F.col(responses)) for name, steps in pipelines.items()})


def majority_by_rows(responses: DataFrame, by: Sequence[str], text: str = "resp", order: str = "idx") -> DataFrame:
    """Majority vote over responses kept one per row, with counts combined before the shuffle."""
    votes = responses.groupBy(*by, text).agg(F.count("*").alias("_n"), F.min(order).alias("_at"))
    return votes.groupBy(*by).agg(F.max_by(text, F.struct(F.col("_n"), -F.col("_at"))).alias("vote"))
