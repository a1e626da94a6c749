"""Model against model, run against run, published against recomputed, best items and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.draws import SEED, draw
from scorelake.functions.strings import fixed_decimals
from scorelake.operators.ranking import top_k

# Columns of judged items that both models share.
SHARED_COLUMNS = ("images", "question", "ground_truth", "criteria", "subtask", "website")
RENAMED_SUBTASKS = {"Evaluative Questions": "Divergent Thinking"}
DROPPED_SUBTASK = "Further Insights"
SUBTASKS = (
    "Concrete Recognition", "Analytical Questions", "Evaluative Questions", "Divergent Thinking",
    "Real-world Assistance",
)


def with_item_data(results: DataFrame, items: DataFrame, on: str = "id") -> DataFrame:
    """Item columns joined to result rows by id."""
    return results.join(items, on)


def against(first: DataFrame, second: DataFrame, on: str = "id", shared: Sequence[str] = SHARED_COLUMNS) -> DataFrame:
    """Rows of two models side by side with ``_1`` and ``_2`` and the score difference."""
    right = second.drop(*[c for c in shared if c in second.columns])
    both = (set(first.columns) & set(right.columns)) - {on}
    left = first.withColumnsRenamed({c: f"{c}_1" for c in both})
    right = right.withColumnsRenamed({c: f"{c}_2" for c in both})
    return left.join(right, on).withColumn("delta", F.col("score_1") - F.col("score_2"))


def run_difference(old: DataFrame, new: DataFrame, on: Sequence[str] = ("model", "task")) -> DataFrame:
    """Change of a value between runs in percentage points; a missing value counts as 0."""
    a = old.select(*on, F.col("value").alias("old_value"))
    b = new.select(*on, F.col("value").alias("new_value"))
    joined = a.join(b, list(on), "full")
    before, after = F.coalesce("old_value", F.lit(0.0)) * 100, F.coalesce("new_value", F.lit(0.0)) * 100
    diff = after - before
    shown = F.when(diff > 0, F.concat(F.lit("**+"), fixed_decimals(diff, 2), F.lit("**"))).otherwise(fixed_decimals(diff, 2))
    return joined.select(*on, before.alias("old_value"), after.alias("new_value"), diff.alias("difference"), shown.alias("shown"))


def good_enough(score: Column, above: float) -> Column:
    """Scores above a limit; missing and 0 never pass."""
    return F.coalesce((score != 0) & (score > above), F.lit(False))


def recoded_subtask(subtask: Column) -> Column:
    out = subtask
    for old, new in RENAMED_SUBTASKS.items():
        out = F.when(subtask == old, F.lit(new)).otherwise(out)
    return out


def best_per_subtask(items: DataFrame, k: int = 50, key: str = "id", shuffled: bool = False, seed: int = SEED) -> DataFrame:
    """Top k per subtask by score; equal scores go by id, or by a draw of it."""
    tie = [draw(F.col(key), 0, seed), F.col(key)] if shuffled else [F.col(key)]
    return top_k(items, k, ["subtask"], [F.col("score").desc(), *tie])


def literal_field(text: Column, field: str) -> Column:
    """A field of a dictionary written with single quotes."""
    parsed = F.from_json(text, "map<string,string>", {"allowSingleQuotes": "true"})
    return F.try_element_at(parsed, F.lit(field))


def counted(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def mean_count(df: DataFrame, by: str) -> DataFrame:
    return counted(df, [by]).agg(F.avg("n").alias("mean_count"), F.count("*").alias("groups"))


def renamed(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """A key column with some of its values renamed, such as a model published under another name."""
    out = F.col(column)
    for old, new in names.items():
        out = F.when(F.col(column) == old, F.lit(new)).otherwise(out)
    return df.withColumn(column, out)


def without(df: DataFrame, columns: Sequence[str] = (), ids: Sequence = (), key: str = "id") -> DataFrame:
    """A table less some columns, such as a stray index, and less some ids."""
    kept = df.filter(~F.col(key).isin(*ids)) if ids else df
    return kept.drop(*columns)


def item(df: DataFrame, wanted, key: str = "id") -> DataFrame:
    return df.filter(F.col(key) == F.lit(wanted))
