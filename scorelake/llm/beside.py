"""Work on the rows of a large table beside a small part of another, without moving the large one.

The small table holds row numbers (``monotonically_increasing_id`` of the large one), whose high bits name the
partition the row is read in. It is written to the shared folder in parts of a few partitions each, and every
task on the large table reads its own part. A join would have to shuffle all texts to find a few of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.session import scratch_path

#: Bits of a row number below its partition's.
LOCAL_BITS = 33
#: Partitions of the large table that share a part, so that parts are not too many.
PARTITIONS_OF_PART = 32


class Beside:
    """A table keyed by row numbers, for use inside tasks on the table they number. Rows are unique."""

    def __init__(self, table: DataFrame, name: str):
        self.path = scratch_path(table.sparkSession, name)
        part = F.floor(F.shiftright("row", LOCAL_BITS) / PARTITIONS_OF_PART).alias("part")
        table.select("*", part).repartition("part").write.partitionBy("part").parquet(self.path)
        self.held: tuple[int, pa.Table | None] | None = None

    def _part(self, number: int) -> pa.Table | None:
        if self.held is None or self.held[0] != number:
            from pyarrow import fs
            from pyarrow import parquet

            store, path = fs.FileSystem.from_uri(self.path)
            path = f"{path}/part={number}"
            found = None
            if store.get_file_info(path).type != fs.FileType.NotFound:
                files = [f.path for f in store.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet")]
                found = pa.concat_tables([parquet.ParquetFile(store.open_input_file(f)).read() for f in sorted(files)])
                found = found.sort_by("row").combine_chunks()
            self.held = (number, found)
        return self.held[1]

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, pa.Table | None]:
        """Places of those ``rows`` that are in the table, and their entries in the same order."""
        none = np.empty(0, np.int64)
        if not len(rows):
            return none, None
        table = self._part((int(rows[0]) >> LOCAL_BITS) // PARTITIONS_OF_PART)
        if table is None or not len(table):
            return none, None
        known = table.column("row").to_numpy()
        at = np.searchsorted(known, rows)
        hit = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == rows)
        return hit, table.take(pa.array(at[hit]))

    def mapped(self, rows: DataFrame, work: Callable[[pa.RecordBatch, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """``work`` on every batch of the rows that are in the table, with their entries. The first column of
        ``rows`` is the row number, made where the table itself is read."""
        def run(batches):
            for batch in batches:
                numbers = batch.column(0).to_numpy()
                # A batch lies within one partition.
                hit, entries = self.of(numbers)
                if len(hit):
                    yield from work(batch.take(pa.array(hit)), entries)
        return rows.mapInArrow(run, schema)

    def over(self, rows: DataFrame, work: Callable[[pa.RecordBatch, np.ndarray, pa.Table], pa.RecordBatch]) -> DataFrame:
        """All ``rows``; ``work`` changes the batches that hold some of the table: it gets their places and entries."""
        def run(batches):
            for batch in batches:
                hit, entries = self.of(batch.column(0).to_numpy())
                yield work(batch, hit, entries) if len(hit) else batch
        return rows.mapInArrow(run, rows.schema)


def without_rows(batch: pa.RecordBatch, hit: np.ndarray, _: pa.Table) -> pa.RecordBatch:
    keep = np.ones(len(batch), bool)
    keep[hit] = False
    return batch.filter(pa.array(keep))
