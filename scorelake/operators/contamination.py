"""Scores with and without the documents that were seen before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shared_line_ids(docs: DataFrame, known: DataFrame, key: str, text: str, shortest: int = 1) -> DataFrame:
    """Documents that hold a whole line of a known text. Lines travel as their hash, unique on both sides, so a
    line repeated everywhere costs one short row per document, and the semi join never multiplies rows."""
    def lines(df: DataFrame, *keep: str) -> DataFrame:
        split = df.select(*keep, F.explode(F.split(F.col(text), "\n")).alias("line"))
        return split.filter(F.char_length("line") >= shortest).select(*keep, F.sha2("line", 256).alias("line")).distinct()

    return lines(docs, key).join(lines(known), "line", "left_semi").select(key).distinct()


def scores_by_contamination(scores: DataFrame, flagged: DataFrame, key: str, value: Column, by: Sequence[str] = ()) -> DataFrame:
    """Mean score over documents not flagged and over flagged ones."""
    marks = flagged.select(key).distinct().withColumn("_seen", F.lit(True))
    joined = scores.join(marks, key, "left")
    seen = F.coalesce("_seen", F.lit(False))
    return joined.groupBy(*by).agg(
        F.avg(F.when(~seen, value)).alias("no_contamination"), F.avg(F.when(seen, value)).alias("only_contamination"),
        F.count("*").alias("num_samples"), F.count_if(seen).alias("num_contaminated"),
    )
