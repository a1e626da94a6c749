"""The registered queries, each with the SQL it is checked against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str, heavy: bool = False) -> DataFrame:
    """A given table. ``heavy`` says that the query works long on every row: it is dealt over as many tasks as
    the session asks for with ``spark.scorelake.spread``, or read as it is where nothing is asked."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = int(spark.conf.get("spark.scorelake.spread", "0"))
    return df.repartition(parts) if heavy and parts else df


def derived(spark: SparkSession, sf_dir: str, text: str, heavy: bool = False) -> DataFrame:
    """A table derived by SQL whose ``{name}`` marks stand for the given tables."""
    used = {t: table(spark, sf_dir, t, heavy) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def plain(text: str) -> str:
    """The same SQL for an engine that knows the tables by name."""
    for name in TABLES:
        text = text.replace("{" + name + "}", name)
    return text


def r6(value: Column) -> Column:
    """Six decimals, rounded in binary as the check engine does; Spark's own ``round`` works on the
    decimal digits and differs on ties."""
    return F.signum(value) * F.floor(F.abs(value) * 1e6 + 0.5) / 1e6


def rounded(df: DataFrame) -> DataFrame:
    """Floating columns at six decimals, as their last digits depend on the order of summation."""
    return df.selectExpr(
        *[
            f"signum(`{n}`) * floor(abs(`{n}`) * 1e6D + 0.5D) / 1e6D AS `{n}`" if t in ("double", "float") else f"`{n}`"
            for n, t in df.dtypes
        ]
    )
