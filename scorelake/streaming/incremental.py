"""Parsing logs as they arrive, each file once, and summaries that keep running."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scorelake.functions.numbers import answer_length, last_numbers, parse_target
from scorelake.functions.scoring import with_scores
from scorelake.operators.ranking import latest
from scorelake.session import remove_path
from scorelake.sources import commits
from scorelake.sources.logs import file_attributes, logical_path, parse_lines, read_lines, read_results_files, task_prefix


def stream_lines(spark: SparkSession, pattern: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(pattern).select(
        "value", logical_path(F.col("_metadata.file_path")).alias("file"),
        F.lit("").alias("block"), F.lit(0).cast("bigint").alias("line"),
    )


def scored_lines(lines: DataFrame, task_kind: str) -> DataFrame:
    """Log lines to scored rows; works on a stream and on a table alike."""
    rows = parse_lines(lines)
    pred = last_numbers(F.coalesce("response", F.lit("")), answer_length(task_kind))
    kept = rows.select("model", "file_name", "doc_id", "target", "response")
    return with_scores(kept, pred, parse_target(F.col("target")), task_kind)


def parse_new_files(
    spark: SparkSession, pattern: str, task_kind: str, out: str, checkpoint: str, files_per_batch: int | None = None
) -> None:
    """Parse the files that are new since the last call and add them to the table at ``out``.

    The checkpoint remembers files; a batch that is retried overwrites its own folder, so no row is
    written twice.
    """
    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = scored_lines(stream_lines(spark, pattern, files_per_batch), task_kind)
    query = (
        stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


#: Update batches that are folded into a snapshot together.
COMPACT_EVERY = 16


def running_summary(
    scored: DataFrame, by: Sequence[str], totals: dict[str, Column], out: str, checkpoint: str, compact_every: int = COMPACT_EVERY
) -> None:
    """Keep sums and counts per group as state, and store the groups each batch changed.

    State holds one small row per group, whatever the number of log lines. Every ``compact_every`` batches are folded into
    a snapshot, so what a reader opens stays bounded however long the stream runs.
    """
    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if number % compact_every == compact_every - 1:
            compact(batch.sparkSession, out, by, number)

    sums = scored.groupBy(*by).agg(*[c.alias(n) for n, c in totals.items()])
    query = (
        sums.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def _updates(spark: SparkSession, out: str, upto: int | None = None) -> DataFrame | None:
    """The last committed snapshot and the batches after it, up to one of them."""
    known = commits.committed(spark, out)
    start = known[-1] if known else -1
    batches = [n for n in commits.numbered(spark, out, "batch") if n > start and (upto is None or n <= upto)]
    parts = [spark.read.option("basePath", out).parquet(*[f"{out}/batch={n}" for n in batches])] if batches else []
    if known:
        held = spark.read.parquet(f"{out}/_snapshots/upto={start}").withColumn("batch", F.lit(start))
        parts.append(held)
    return functools.reduce(DataFrame.unionByName, parts) if parts else None


def compact(spark: SparkSession, out: str, by: Sequence[str], upto: int) -> None:
    """Fold all batches up to one into a snapshot. Safe to call again: a snapshot counts from its commit on, and until then the
    one before it and its batches are read. Batches and snapshots that a commit replaced go with the next commit."""
    known = commits.committed(spark, out)
    if known and known[-1] >= upto:
        return
    rows = _updates(spark, out, upto)
    if rows is None:
        return
    latest(rows, by, F.col("batch")).drop("batch").write.mode("overwrite").parquet(f"{out}/_snapshots/upto={upto}")
    commits.commit(spark, out, upto)
    before = known[-1] if known else -1
    for n in commits.numbered(spark, out, "batch"):
        if n <= before:
            remove_path(spark, f"{out}/batch={n}")
    for n in commits.numbered(spark, f"{out}/_snapshots", "upto"):
        if n not in (before, upto):
            remove_path(spark, f"{out}/_snapshots/upto={n}")
    for n in known[:-1]:
        commits.forget(spark, out, n)


def current_summary(spark: SparkSession, out: str, by: Sequence[str]) -> DataFrame:
    """Latest stored state of every group."""
    rows = _updates(spark, out)
    if rows is None:
        raise FileNotFoundError(f"no summary below {out}")
    return latest(rows, by, F.col("batch")).drop("batch")


# ---- logs and the results files beside them ----

FILES = "path string, modificationTime timestamp, length long, content binary"
PAIRS = "model string, prefix string, status string, path string, results_path string"
HELD = "results string, waiting array<string>, reported boolean"


def stream_names(spark: SparkSession, root: str) -> DataFrame:
    """(model, prefix, path, is_results) of log and results files as they arrive; the files themselves are not read."""
    files = spark.readStream.format("binaryFile").schema(FILES).load(f"{root.rstrip('/')}/*/*{{.jsonl,_results.json}}")
    attributes = file_attributes(F.col("file"))
    named = files.select("path", logical_path(F.col("_metadata.file_path")).alias("file")).withColumns(attributes)
    is_results = F.col("file_name").endswith("_results.json")
    prefix = F.when(is_results, F.regexp_replace("file_name", r"_results\.json$", "")).otherwise(task_prefix(F.col("file_name")))
    return named.select("model", prefix.alias("prefix"), "path", is_results.alias("is_results"))


def _paired(wait_ms: int):
    """What one (model, prefix) has: the results file, the log files that wait for it, whether its lack was reported."""
    def update(key, frames, state: GroupState):
        import pandas as pd

        results, waiting, reported = state.get if state.exists else (None, [], False)
        waiting, rows = list(waiting), []
        if state.hasTimedOut:
            rows, reported = [(*key, "missing", path, None) for path in waiting], True
            state.update((results, waiting, reported))
        else:
            for frame in frames:
                for path, is_results in zip(frame["path"], frame["is_results"]):
                    if is_results:
                        results = path
                    else:
                        waiting.append(path)
            if results is not None:
                rows, waiting = [(*key, "paired", path, results) for path in sorted(waiting)], []
            state.update((results, waiting, reported))
            if waiting and not reported:
                state.setTimeoutDuration(wait_ms)
        yield pd.DataFrame(rows, columns=["model", "prefix", "status", "path", "results_path"])

    return update


def pair_new_files(spark: SparkSession, root: str, out: str, checkpoint: str, wait_ms: int) -> None:
    """Take in the files that are new since the last call, in one batch: parse logs below a task folder once both a log and the results file of its prefix are there, whichever comes first.

    State per (model, prefix) holds names, never rows: the results file, and the log files that wait for it. A log file is read
    when its pair is complete, with ``results_task`` beside each row, into ``out/rows``; a results file that comes again replaces
    the one held for logs that arrive after it. A log whose results file is not there after ``wait_ms`` of processing time is
    reported once with status ``missing`` in ``out/pairs``, by the first batch after that, and is still paired if the file comes
    later. A batch that is retried overwrites its own folders.
    """
    def save(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{out}/pairs/batch={number}")
        pairs = session.read.schema(PAIRS).parquet(f"{out}/pairs/batch={number}").where("status = 'paired'")
        # Names of one batch's files and of those that waited for it.
        names = pairs.select("path", "results_path").collect()
        if not names:
            return
        rows = parse_lines(read_lines(session, sorted({r.path for r in names})))
        tasks = read_results_files(session, sorted({r.results_path for r in names})).select("model", "prefix", F.col("task").alias("results_task")).distinct()
        paired = rows.withColumn("prefix", task_prefix(F.col("file_name"))).join(tasks, ["model", "prefix"])
        paired.drop("file", "block", "line").write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    found = stream_names(spark, root).groupBy("model", "prefix").applyInPandasWithState(
        _paired(wait_ms), PAIRS, HELD, "append", GroupStateTimeout.ProcessingTimeTimeout)
    # One batch a call: with timers there is always one more batch to run, so a trigger that runs until nothing is left never ends.
    query = found.writeStream.outputMode("append").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(once=True).start()
    query.awaitTermination()
