"""A table of unique keys that grows by batches, such as answered requests, without being rewritten.

Rows are dealt over folders by the leading digits of their hash. A batch writes new generations of the folders it touches
and a list of the generations of every folder, then commits; the files of all other folders stay as they are. A small folder
is rewritten with the batch, a large one gets the batch as one more layer, so that a batch costs what it holds and not what
the store holds; of rows with equal keys the one in the latest layer counts. A reader takes the last committed list, and for a
few keys reads only the folders they lie in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.session import durable, release, remove_path
from scorelake.sources import commits

#: Leading hexadecimal digits that name a folder: 256 folders for two, 4096 for three.
DIGITS = 2
#: Bytes of a folder up to which a batch rewrites it, and layers with which it is rewritten at any size.
SMALL_BYTES, LAYERS = 1 << 20, 8
#: Hashes are shuffled as the bytes their digits stand for, half as long; other keys as they are, longer than any such.
HASH, OTHER = r"^[0-9a-f]{64}$", bytes(33)


def packed(key: Column) -> Column:
    """A key as bytes, which differ where keys do."""
    return F.when(key.rlike(HASH), F.unhex(key)).otherwise(F.concat(key.cast("binary"), F.lit(OTHER)))


def unpacked(key: Column) -> Column:
    """The key that :func:`packed` made these bytes of."""
    other = F.substring(key, F.lit(1), F.length(key) - len(OTHER)).cast("string")
    return F.when(F.length(key) == 32, F.lower(F.hex(key))).otherwise(other)


class KeyedStore:
    """``key`` is a text column of hexadecimal hashes, ``root`` a folder all executors reach. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str = "request_hash", digits: int = DIGITS):
        self.spark, self.root, self.schema, self.key, self.digits = spark, root.rstrip("/"), schema, key, digits

    def _bucket(self) -> Column:
        return F.substring(self.key, 1, self.digits)

    def _generations(self, number: int | None) -> dict[str, tuple[int, ...]]:
        """Folder -> its layers as of a commit, oldest first; at most ``LAYERS`` rows for each of 16 ** digits folders."""
        if number is None:
            return {}
        rows = self.spark.read.schema("bucket string, generation long").parquet(f"{self.root}/_lists/{number:012d}").collect()
        found: dict[str, tuple[int, ...]] = {}
        for bucket, generation in sorted((r.bucket, r.generation) for r in rows):
            found[bucket] = (*found.get(bucket, ()), generation)
        return found

    def _last(self) -> int | None:
        known = commits.committed(self.spark, self.root)
        return known[-1] if known else None

    def _fields(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def _paths(self, generations: dict[str, tuple[int, ...]], buckets: set[str] | None = None) -> list[str]:
        return [f"{self.root}/data/generation={g}/bucket={b}" for b, held in sorted(generations.items()) if buckets is None or b in buckets for g in held]

    def _by_key(self, generations: dict[str, tuple[int, ...]], buckets: set[str] | None = None) -> DataFrame:
        """The rows by ``_key``, the packed key, each key once."""
        paths, others = self._paths(generations, buckets), [n for n in self._fields() if n != self.key]
        if not paths:
            # Known to be empty when a join is planned, which then shuffles nothing.
            return self.spark.createDataFrame([], self.schema).where(F.lit(False)).select(packed(F.col(self.key)).alias("_key"), *others)
        if all(len(held) == 1 for b, held in generations.items() if buckets is None or b in buckets):
            return self.spark.read.schema(self.schema).parquet(*paths).select(packed(F.col(self.key)).alias("_key"), *others)
        whole = self.spark.read.option("basePath", f"{self.root}/data").schema(f"{self.schema}, generation long, bucket string").parquet(*paths)
        layers = whole.select(packed(F.col(self.key)).alias("_key"), F.struct(*others).alias("_row"), "generation")
        return layers.groupBy("_key").agg(F.max_by("_row", "generation").alias("_row")).select("_key", *[F.col("_row")[n].alias(n) for n in others])

    def _read(self, generations: dict[str, tuple[int, ...]], buckets: set[str] | None = None) -> DataFrame:
        paths = self._paths(generations, buckets)
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        if all(len(held) == 1 for b, held in generations.items() if buckets is None or b in buckets):
            return self.spark.read.schema(self.schema).parquet(*paths)
        rows = self._by_key(generations, buckets).withColumn(self.key, unpacked(F.col("_key")))
        return rows.select(*self._fields())

    def rows(self) -> DataFrame:
        return self._read(self._generations(self._last()))

    def rows_for(self, keys: DataFrame) -> DataFrame:
        """All rows of the folders that ``keys`` fall in; every row with one of these keys is among them."""
        return self._read(self._generations(self._last()), self._touched(keys))

    def packed_rows_for(self, keys: DataFrame) -> DataFrame:
        """:meth:`rows_for` by ``_key``, the packed key: what a join shuffles is half as long."""
        return self._by_key(self._generations(self._last()), self._touched(keys))

    def _touched(self, rows: DataFrame) -> set[str]:
        return {r[0] for r in rows.where(F.col(self.key).isNotNull()).select(self._bucket()).distinct().collect()}

    def _bytes(self, bucket: str, generations: tuple[int, ...]) -> int:
        return sum(commits.size(self.spark, path) for path in self._paths({bucket: generations}))

    def upsert(self, batch: DataFrame, dealt: bool = False) -> int | None:
        """Add rows, which replace those with the same keys. Keys must be unique within the batch and not null. Gives the commit's
        number; nothing is written for an empty batch. Only folders that a key of the batch falls in are read or written, and of
        these only small ones, or such of ``LAYERS`` layers, are read. ``dealt`` says that the batch lies in so few and even
        partitions, by hash of the key or alike, that each may write to every folder; else it is dealt by folder."""
        fields = self._fields()
        fresh = batch.select(*fields).where(F.col(self.key).isNotNull())
        last = self._last()
        known, number = self._generations(last), 0 if last is None else last + 1
        merged = {b for b, held in known.items() if len(held) >= LAYERS or self._bytes(b, held) <= SMALL_BYTES}
        both = fresh
        if merged:
            fresh = durable(fresh)
            touched = self._touched(fresh)
            if not touched:
                release(fresh)
                return None
            merged &= touched
        if merged:
            both = self._read(known, merged).join(fresh, self.key, "left_anti").select(*fields).unionByName(fresh)
        both = both.withColumn("bucket", self._bucket())
        target = f"{self.root}/data/generation={number}"
        # A batch that failed before its commit may have left a part of this generation.
        remove_path(self.spark, target)
        spread = both if dealt and not merged else both.repartition("bucket")
        spread.write.option("compression", "zstd").partitionBy("bucket").parquet(target)
        release(fresh)
        written = {n.removeprefix("bucket=") for n in commits.names(self.spark, target) if n.startswith("bucket=")}
        if not written:
            remove_path(self.spark, target)
            return None
        layers = {b: (number,) if b in merged else (*known.get(b, ()), number) for b in written}
        lists = [(b, g) for b, held in {**known, **layers}.items() for g in held]
        remove_path(self.spark, f"{self.root}/_lists/{number:012d}")
        self.spark.createDataFrame(lists, "bucket string, generation long").coalesce(1).write.parquet(f"{self.root}/_lists/{number:012d}")
        commits.commit(self.spark, self.root, number)
        self._clean()
        return number

    def _clean(self) -> None:
        """Delete what neither of the last two commits reads."""
        known = commits.committed(self.spark, self.root)
        held = {(b, g) for n in known[-2:] for b, layers in self._generations(n).items() for g in layers}
        for old in known[:-2]:
            commits.forget(self.spark, self.root, old)
            remove_path(self.spark, f"{self.root}/_lists/{old:012d}")
        for g in commits.numbered(self.spark, f"{self.root}/data", "generation"):
            folder = f"{self.root}/data/generation={g}"
            there = {n.removeprefix("bucket=") for n in commits.names(self.spark, folder) if n.startswith("bucket=")}
            gone = {b for b in there if (b, g) not in held}
            if gone == there:
                remove_path(self.spark, folder)
            else:
                for b in gone:
                    remove_path(self.spark, f"{folder}/bucket={b}")


def answered_from_store(requests: DataFrame, store: KeyedStore, sampled: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(requests with their stored response, requests still to run). Sampled requests are never reused, or all their repeats
    would be alike. Requests are read twice, the store only where they fall; its keys are unique, so rows meet once. Requests
    that cannot be reused are not shuffled."""
    reusable = F.col(store.key).isNotNull()
    if sampled is not None:
        reusable &= F.coalesce(~sampled, F.lit(False))
    asked = requests.where(reusable)
    known = store.packed_rows_for(asked).select(F.col("_key").alias("_known"), "response")
    # Both results filter alike, so that Spark shuffles the requests once for both.
    met = asked.withColumn("_key", packed(F.col(store.key))).drop(store.key).where("_key is not null").join(known, F.col("_key") == F.col("_known"), "left")
    columns = [unpacked(F.col("_key")).alias(c) if c == store.key else F.col(c) for c in requests.columns]
    hits, missed = met.where("_known is not null").select(*columns, "response"), met.where("_known is null").select(*columns)
    return hits, missed.unionByName(requests.where(~reusable))


def record_answers(store: KeyedStore, answered: DataFrame) -> int | None:
    """Add newly answered requests; equal requests count once, the one asked last wins."""
    keyed = answered.where(F.col(store.key).isNotNull()).withColumn("_key", packed(F.col(store.key)))
    last = keyed.groupBy("_key").agg(F.max_by("response", "request_id").alias("response"))
    return store.upsert(last.select(unpacked(F.col("_key")).alias(store.key), "response"), dealt=True)
