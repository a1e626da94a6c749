"""Small subsets that cover an embedding space, and the embeddings they are chosen by."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.session import durable, release, scratch_path

CANDIDATES = 512


def subset_size(total: int, wanted: float) -> int:
    """A count, or below 1 a share of the total; both cut off."""
    return int(total * wanted) if wanted < 1.0 else int(wanted)


def _lower_distances(df: DataFrame, key: str, vector: str, centers: np.ndarray) -> DataFrame:
    """Narrow pass: bring every row's distance to its nearest center up to date."""
    def update(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                points = np.stack(batch[vector].to_numpy()).astype("float64")
                nearest = batch["distance"].to_numpy().copy()
                for center in centers:
                    gap = points - center
                    nearest = np.minimum(nearest, np.sqrt((gap * gap).sum(axis=1)))
                batch = batch.assign(distance=nearest)
            yield batch

    return df.mapInPandas(update, df.schema)


def k_center(df: DataFrame, k: float, key: str, vector: str, candidates: int = CANDIDATES) -> DataFrame:
    """Greedy k-center choice: start at the smallest key, then keep adding the row farthest from
    everything chosen; the smaller key wins ties. Returns (place, key, radius), radius being the
    distance at which the row was still uncovered.

    Each pass over the data brings distances up to date and returns the few farthest rows. Distances
    only ever shrink, so stale ones bound the rows left behind from above: as long as the best of the
    returned rows beats that bound it is the true next choice, and many rounds need no pass at all.
    The result equals one pass per round. The driver holds one batch of candidates; what is chosen is appended to a
    stored table after every pass, so k may be a share of the table, and the last pass's table is deleted.
    """
    spark = df.sparkSession
    total = df.count()
    size = subset_size(total, k)
    if size > total:
        raise ValueError(f"cannot choose {size} of {total} rows")
    schema, path = f"place int, {key} bigint, radius double", scratch_path(spark, "k-center")
    spark.createDataFrame([], schema).write.parquet(path)
    rows = durable(
        df.select(F.col(key).cast("bigint").alias(key), F.col(vector).cast("array<double>").alias(vector))
        .withColumn("distance", F.lit(float("inf")))
    )
    done = 0
    if size:
        start = rows.orderBy(key).limit(1).first()
        spark.createDataFrame([(0, start[key], None)], schema).write.mode("append").parquet(path)
        fresh = [np.asarray(start[vector], dtype="float64")]
        done = 1
    while done < size:
        before = rows
        # Farther rounds would each redo every earlier pass, and a lost executor all of them.
        rows = durable(_lower_distances(rows, key, vector, np.stack(fresh)))
        release(before)
        head = rows.orderBy(F.desc("distance"), key).limit(candidates + 1).collect()
        bound = head[candidates]["distance"] if len(head) > candidates else -1.0
        head = head[:candidates]
        points = np.stack([np.asarray(r[vector], dtype="float64") for r in head])
        nearest = np.array([r["distance"] for r in head])
        keys = np.array([r[key] for r in head])
        chosen, fresh = [], []
        while done < size:
            far = nearest.max()
            # The first choice after a pass is exact; later ones must beat every row left behind.
            if fresh and far <= bound:
                break
            at = min(np.flatnonzero(nearest == far), key=lambda i: keys[i])
            chosen.append((done, int(keys[at]), float(far)))
            done += 1
            fresh.append(points[at])
            gap = points - points[at]
            nearest = np.minimum(nearest, np.sqrt((gap * gap).sum(axis=1)))
        spark.createDataFrame(chosen, schema).write.mode("append").parquet(path)
    release(rows)
    return spark.read.schema(schema).parquet(path)


def covering_radius(df: DataFrame, chosen: DataFrame, key: str, vector: str, batch: int = CANDIDATES) -> DataFrame:
    """Greatest distance of any row from its nearest chosen row; the driver holds ``batch`` of them at a time."""
    centers = durable(df.join(chosen.select(key), key, "left_semi").select(F.col(vector).cast("array<double>").alias(vector)))
    rows = df.select(F.col(key), F.col(vector).cast("array<double>").alias(vector)).withColumn(
        "distance", F.lit(float("inf"))
    )
    held: list[np.ndarray] = []
    lowered = None
    for center in centers.toLocalIterator():
        held.append(np.asarray(center[vector], dtype="float64"))
        if len(held) == batch:
            before = lowered
            lowered = durable(_lower_distances(rows if lowered is None else lowered, key, vector, np.stack(held)))
            held = []
            if before is not None:
                release(before)
    rows = rows if lowered is None else lowered
    if held:
        rows = _lower_distances(rows, key, vector, np.stack(held))
    return rows.agg(F.max("distance").alias("radius"))


def mean_vector(df: DataFrame, vector: str, by: list[str], width: int) -> DataFrame:
    """Element-wise mean per group, zeros where a group has no vector; combined within tasks first.

    A vector is taken apart into one row per position and the means are put together again, whatever the width.
    A vector of another length stops the job.
    """
    wrong = F.raise_error(F.lit(f"a vector is not of length {width}")).cast(df.schema[vector].dataType)
    checked = F.when(F.col(vector).isNull() | (F.size(vector) == width), F.col(vector)).otherwise(wrong)
    cells = df.select(*by, checked.alias("_v")).select(*by, F.posexplode_outer("_v").alias("_at", "_x"))
    means = cells.groupBy(*by, "_at").agg(F.avg(F.col("_x").cast("double")).alias("_mean"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("_at").isNotNull(), F.struct("_at", "_mean"))))
    joined = F.transform(ordered, lambda cell: cell["_mean"])
    zeros = F.array_repeat(F.lit(0.0), width)
    return means.groupBy(*by).agg(F.when(F.size(ordered) > 0, joined).otherwise(zeros).alias("mean_vector"))


def joint_embedding(image: Column, text: Column, width: int) -> Column:
    """Image vector (zeros when there is none) followed by the text vector."""
    zeros = F.array(*[F.lit(0.0)] * width)
    return F.concat(F.coalesce(image, zeros), text)
