"""Numbered commits of a folder: an empty file says that everything a number stands for is written.

Creating one empty file either happens or not, in every store, so a job that ends in the middle leaves the last commit
in force. What a commit replaces is deleted by the commit after the next, so that a reader that began before it finds its files.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

FOLDER = "_commits"


def _path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none where there is no folder."""
    place, store = _path(spark, folder)
    if not store.exists(place):
        return []
    return sorted(s.getPath().getName() for s in store.listStatus(place))


def size(spark: SparkSession, folder: str) -> int:
    """Bytes of all files below a folder."""
    place, store = _path(spark, folder)
    return store.getContentSummary(place).getLength()


def numbered(spark: SparkSession, folder: str, key: str) -> list[int]:
    """The numbers of the folders ``key=number``, in order."""
    start = f"{key}="
    return sorted(int(n.removeprefix(start)) for n in names(spark, folder) if n.startswith(start) and n.removeprefix(start).isdigit())


def committed(spark: SparkSession, root: str) -> list[int]:
    """All commits in force or kept for readers, in order."""
    return [int(n) for n in names(spark, f"{root}/{FOLDER}") if n.isdigit()]


def commit(spark: SparkSession, root: str, number: int) -> None:
    place, store = _path(spark, f"{root}/{FOLDER}/{number:012d}")
    store.create(place, True).close()


def forget(spark: SparkSession, root: str, number: int) -> None:
    place, store = _path(spark, f"{root}/{FOLDER}/{number:012d}")
    store.delete(place, False)
