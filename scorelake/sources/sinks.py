"""Writers for parsed rows, summaries, reports and sample logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.strings import stringify_leaves


def write_parsed(rows: DataFrame, path: str, by: Sequence[str] = ("model", "task"), kind: str = "parquet") -> None:
    """Parsed rows as a table partitioned by model and task; each run replaces the partitions it holds.

    Spark writes to a side folder and moves it in place, so readers never see half a result.
    """
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).format(kind).save(path)


def long_metrics(summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key and metric."""
    metrics = [c for c in summary.columns if c not in keys]
    return summary.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        list(keys), metrics, "metric", "value"
    )


def write_summary(summary: DataFrame, path: str, keys: Sequence[str]) -> None:
    long_metrics(summary, keys).write.mode("overwrite").parquet(path)


def write_summary_json(summary: DataFrame, path: str) -> None:
    """One JSON object per group; missing values stay visible as null."""
    summary.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode(
        "overwrite"
    ).text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header and ``NaN`` for missing values."""
    rows.write.mode("overwrite").option("header", "true").option("nullValue", "NaN").csv(path)


#: Lines up to which a report is one file, written by one task.
REPORT_LINES = 100_000


def write_report(lines: DataFrame, path: str, order: Sequence[Column], line: str = "line") -> None:
    """Report lines in order, a line per group of a summary: one text file up to ``REPORT_LINES``, beyond that part files which
    are in order by name and are sorted and written side by side."""
    ordered = lines.orderBy(*order).select(line)
    if lines.limit(REPORT_LINES + 1).count() <= REPORT_LINES:
        ordered = ordered.coalesce(1)
    ordered.write.mode("overwrite").text(path)


def sample_lines(samples: DataFrame) -> DataFrame:
    """Log lines with every response and argument as text and the target as text."""
    shaped = samples.withColumns(
        {
            "resps": stringify_leaves(F.col("resps"), 2),
            "filtered_resps": stringify_leaves(F.col("filtered_resps"), 1),
            "target": F.col("target").cast("string"),
        }
    )
    if "arguments" in samples.columns:
        # First argument is the prompt; the rest are kept under their position.
        shaped = shaped.withColumn("input", F.get("arguments", F.lit(0))).withColumn(
            "arguments",
            F.map_from_entries(
                F.transform(
                    F.slice("arguments", F.lit(2), F.size("arguments")),
                    lambda a, i: F.struct(i.cast("string").alias("key"), a.cast("string").alias("value")),
                )
            ),
        )
    return shaped.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_sample_log(samples: DataFrame, path: str) -> None:
    sample_lines(samples).write.mode("overwrite").text(path)


def write_logs(lines: DataFrame, task_dir: str, order: Sequence[str] = ()) -> None:
    """Lines (model, log, value) as one log per model and name below a task folder. With ``order`` the
    lines of a log are in order over its part files; long logs spread over many tasks."""
    if order:
        keys = ["model", "log", *order]
        lines = lines.repartitionByRange(*keys).sortWithinPartitions(*keys)
    lines.select("model", "log", "value").write.mode("append").partitionBy("model", "log").text(task_dir)


def write_results(results: DataFrame, hashes: DataFrame, path: str) -> None:
    """Long results with the content hash of each task beside its metrics."""
    results.join(hashes, "task", "left").write.mode("overwrite").partitionBy("task").parquet(path)


def one_file_per_row(folder: str):
    """For ``mapInArrow``: write each row (name, content) as a file of that name below a folder all executors reach, and give the
    names. A task that runs again writes the same files; each is written under a name of its own and moved in place."""
    def run(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                temp = f"{path}/_{uuid.uuid4().hex}"
                with store.open_output_stream(temp, compression=None) as out:
                    out.write(content.as_buffer())
                store.move(temp, f"{path}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["name"])
    return run
