"""Tables written between steps, in the folder all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.session import scratch_path


#: Rows of an Arrow batch. Texts are long: a batch of Spark's default ten thousand takes tens of megabytes, several times over.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> None:
    """Have the session send tables to Python in batches of at most ``BATCH_ROWS``, now and when results are read."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))


def stored(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps start from it, whatever executor is lost.

    ``narrow`` tables hold a few numbers a row; they are written by one task for each core, not one for each
    partition of a shuffle meant for texts, which would leave many tiny files.
    """
    path = scratch_path(df.sparkSession, name)
    (df.coalesce(df.sparkSession.sparkContext.defaultParallelism) if narrow else df).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def removed(*tables: DataFrame) -> None:
    """Delete stored tables that no later step reads."""
    for table in tables:
        path = getattr(table, "stored_path", None)
        if path:
            remove_path(table.sparkSession, path)


def remove_path(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def make_folder(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)


def fresh(df: DataFrame, name: str) -> str:
    """A column name the table does not have yet, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_text(df: DataFrame, keys: list[str], column: str, kind: str = "string", added: list[str] = ()) -> tuple[DataFrame, str, int]:
    """The columns ``keys`` and one more to work on; the schema of the keys, with a comma; the work column's place.

    A text among the keys is not sent twice. A key that bears the name of a column to be ``added``, in any case of letters, gets
    a ``_`` behind it.
    """
    small_batches(df)
    names, taken = [], {n.lower() for n in (*added, *(k for k in keys if k.lower() not in {a.lower() for a in added}))}
    for key in keys:
        name = key
        if key.lower() in {a.lower() for a in added}:
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
        names.append(name)
    held = [F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)]
    chosen = df.select(*held)
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in chosen.schema.fields)
    if kind == "string" and column in keys and df.select(F.col(f"`{column}`")).dtypes[0][1] == "string":
        return chosen, kinds, keys.index(column)
    return df.select(*held, F.col(f"`{column}`").cast(kind).alias(fresh(chosen, "work_on"))), kinds, len(keys)


def pin_splits(spark: SparkSession) -> None:
    """Have the session split files alike from now on. Left to itself, Spark asks at each planning how many cores it
    has just then and cuts files by that, so that an executor lost between two jobs would move rows to other partitions."""
    name = "spark.sql.files.minPartitionNum"
    if spark.conf.get(name, None) in (None, "<undefined>"):
        cores = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
        spark.conf.set(name, cores if cores and cores.isdigit() else str(spark.sparkContext.defaultParallelism))


def settled(df: DataFrame) -> DataFrame:
    """A table whose rows are numbered alike each time it is read, whatever executors come and go: itself where it is
    read from files without a shuffle, with their splits pinned, else a stored copy. The order of shuffled rows may
    change from one reading to the next, and a table held by the driver is cut by the cores there are."""
    small_batches(df)
    pin_splits(df.sparkSession)
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    files = all(leaves.apply(i).nodeName().startswith("Scan parquet") for i in range(leaves.size()))
    return df if files and "Exchange" not in plan.toString() else stored(df, "settled")
