"""Session settings and durable storage shared by every job."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """Session for tests and the benchmark. On a cluster the submitter's own settings apply.

    ``spark.scorelake.spread`` asks the registered queries to deal small one-file tables over so many tasks.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("scorelake")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "20g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.scorelake.spread", str(shuffle_partitions))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, else one below the session's warehouse, which
    all executors share as well."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scorelake_scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/scorelake/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def durable(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Cut lineage with a table written to the shared folder, so the loss of an executor never redoes earlier
    rounds. Its folder is in ``stored_path``, for :func:`release` once no later step reads it.
    ``compression`` is the session's unless told; hashes in hexadecimal digits take half with ``zstd``."""
    path = scratch_path(df.sparkSession, "step")
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete stored tables that no later step reads."""
    for table in tables:
        path = getattr(table, "stored_path", None)
        if path:
            remove_path(table.sparkSession, path)
