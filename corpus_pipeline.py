"""The training-data pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage but the last returns the columns it was given, whatever their names, and works on all rows its
predecessor kept. Rows with a null or blank text are never good enough for the rules of the second stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm.beside import Beside, without_rows
from scorelake.llm.near_text import near_duplicates
from scorelake.llm.packing import packed
from scorelake.llm.quality_rank import CUT_SCORE, learned, quality_scores
from scorelake.llm.quality_rules import quality_rules, references
from scorelake.llm.repeats import without_repeats
from scorelake.llm.storage import fresh, settled, stored


def _filtered(docs: DataFrame, judge: Callable[[DataFrame, list[str], str], DataFrame], good) -> DataFrame:
    """The rows that a judge of (table, its columns, its text column) calls good; numbered names cannot clash."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[[c.lower() for c in docs.columns].index("text")]
    return judge(docs.toDF(*names), names, text).where(good).select(*names).toDF(*docs.columns)


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking learned from ``labels`` scores at the cut or above."""
    model = learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if model is None:
        return docs
    return _filtered(docs, lambda d, keys, text: quality_scores(d, model, keys, text), F.col("score") >= CUT_SCORE)


def ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near a language's reference."""
    ref = references(docs)
    lang = [c.lower() for c in docs.columns].index("lang")
    return _filtered(docs, lambda d, keys, text: quality_rules(d, keys, text, lang_col=keys[lang], ref=ref), F.col("kept"))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are 0.8 alike."""
    docs = settled(docs)
    place = fresh(docs, "row_place")
    gone = Beside(near_duplicates(docs, size=5, limit=0.8).where("not kept").select("row"), "duplicates")
    rows = docs.select(F.monotonically_increasing_id().alias(place), *[F.col(f"`{c}`") for c in docs.columns])
    return gone.over(rows, without_rows).drop(place)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that stand in an earlier place; ``n_chars`` follows."""
    out = without_repeats(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out


def sequenced(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048, piece by piece."""
    return packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", classified),
    ("quality_rules", ruled),
    ("minhash_near_dedup", deduplicated),
    ("suffix_dedup", unrepeated),
    ("packing", sequenced),
]

#: The rows cannot be stated in SQL; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
