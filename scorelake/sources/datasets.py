"""Readers that bring task data sets and question files into flat typed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.operators.assembly import union_all, with_dataset_name
from scorelake.sources.logs import logical_path

# Fixed values.
AUDIO_PREFIX = "<|audio_bos|><|AUDIO|><|audio_eos|>"
DESCRIBE_VIDEO = (
    "Please provide a detailed description of the video, focusing on the main subjects, their actions, "
    "and the background scenes"
)
MEDIA_COLUMNS = ("image", "images", "video", "audio", "processed_images")


def read_training_tasks(spark: SparkSession, root: str, tasks: Sequence[str], tag: str) -> DataFrame:
    """Train split of many tasks in one table, each row tagged with its data set name."""
    tables = [
        with_dataset_name(
            spark.read.parquet(f"{root.rstrip('/')}/{task}_Train").withColumn("task", F.lit(task)), tag
        )
        for task in tasks
    ]
    return union_all(tables)


def without_media(df: DataFrame, media: Sequence[str] = MEDIA_COLUMNS) -> DataFrame:
    """Rows as scorers see them; dropped columns are never read."""
    return df.drop(*media)


def question_rows(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in ("Q", "A", "DimensionName", "VideoID")])


CAPTION_SCHEMA = "video string, caption string, timestamp array<float>"


def caption_rows(spark: SparkSession, path: str) -> DataFrame:
    """(video, caption, timestamp) of JSON records, times at single precision."""
    return spark.read.schema(CAPTION_SCHEMA).option(
        "mode", "FAILFAST"
    ).option("multiLine", "true").json(path)


def audio_rows(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("audio string, prompt string, gt string, source string, task string").option(
        "mode", "FAILFAST"
    ).json(path)
    return rows.withColumn("prompt", F.concat(F.lit(AUDIO_PREFIX), "prompt"))


def video_url(video_id: Column, base: str = "https://www.youtube.com/watch?v=") -> Column:
    return F.concat(F.lit(base), video_id)


def image_questions(spark: SparkSession, splits: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Questions paired with their image bytes. ``splits`` maps a split name to (question file, image
    folder, image name prefix); columns a split lacks become null."""
    tables = []
    for split, (questions, folder, prefix) in splits.items():
        raw = spark.read.option("multiLine", "true").json(questions)
        rows = raw.select(F.explode("questions").alias("q")).select("q.*")
        name = F.concat(F.lit(prefix + "_"), F.lpad(F.col("image_id").cast("string"), 12, "0"), F.lit(".jpg"))
        images = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(folder).select(
            F.element_at(F.split("path", "/"), -1).alias("image_name"), F.col("content").alias("image")
        )
        joined = rows.withColumn("image_name", name).join(images, "image_name", "left")
        missing = F.raise_error(F.concat(F.lit("no image "), F.col("image_name"))).cast("binary")
        tables.append(
            joined.withColumn("image", F.coalesce("image", missing)).withColumn("split", F.lit(split))
        )
    return union_all(tables)


def described_videos(spark: SparkSession, folder: str) -> DataFrame:
    """One row per text file: name up to the first dot, the fixed question, the first line as answer."""
    path = logical_path(F.col("_metadata.file_path"))
    files = spark.read.text(folder, wholetext=True).select("value", F.element_at(F.split(path, "/"), -1).alias("file_name"))
    text = F.regexp_replace("value", "^\ufeff", "")
    first = F.regexp_extract(text, r"^([^\n]*\n?)", 1)
    return files.select(
        F.substring_index("file_name", ".", 1).alias("video_name"),
        F.lit(DESCRIBE_VIDEO).alias("question"), first.alias("answer"),
    )
