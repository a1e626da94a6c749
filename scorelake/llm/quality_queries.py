"""Quality verdicts and scores of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake.llm.quality_rank import CUT_SCORE, learned, quality_scores
from scorelake.llm.quality_rules import quality_rules
from scorelake.llm.registry import query, table


@query("op1_divergence_rules")
def op1(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"), ["doc_id"])


@query("op5_bradley_terry_quality")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = learned(docs, table(spark, sf_dir, "labels"))
    scores = quality_scores(docs, model, ["doc_id"])
    return scores.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score",
                         (F.col("score") >= CUT_SCORE).cast("int").alias("predicted"))
