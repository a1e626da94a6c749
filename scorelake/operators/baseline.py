"""What guessing boxes at random would score."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.functions.boxes import ratio_bin
from scorelake.functions.draws import SEED, key_state, uniform_int
from scorelake.functions.scoring import METRICS
from scorelake.functions.weights import draws
from scorelake.operators.summaries import summarise_detection

# Fixed value: random boxes drawn per row.
SIMULATIONS = 100
#: Rows whose boxes are drawn at a time.
ROWS = 256


def with_random_box(df: DataFrame) -> DataFrame:
    """Add ``_box``: whole pixels, size and place uniform, in relative coordinates at single precision.
    Expects the image height and width as ``_ih`` and ``_iw``, the key's ``_state`` and the number of the
    draw as ``_repeat``."""
    state, stream = F.col("_state"), F.col("_repeat").cast("bigint") * 4
    sized = df.withColumns(
        {
            "_bw": uniform_int(state, 1, F.col("_iw"), stream),
            "_bh": uniform_int(state, 1, F.col("_ih"), stream + 1),
        }
    )
    placed = sized.withColumns(
        {
            "_bx": uniform_int(state, 0, F.col("_iw") - F.col("_bw"), stream + 2),
            "_by": uniform_int(state, 0, F.col("_ih") - F.col("_bh"), stream + 3),
        }
    )
    x, y, w, h = (F.col(c) for c in ("_bx", "_by", "_bw", "_bh"))
    corners = [x / F.col("_iw"), y / F.col("_ih"), (x + w) / F.col("_iw"), (y + h) / F.col("_ih")]
    return placed.withColumn("_box", F.array(*[c.cast("float").cast("double") for c in corners]))


def _mean_scores(state: np.ndarray, height: np.ndarray, width: np.ndarray, target: np.ndarray, simulations: int) -> list[np.ndarray]:
    """Mean of every measure over the random boxes of each row: the boxes of :func:`with_random_box`, a row down, a draw across."""
    u = draws(state, 0, 4 * simulations).T.reshape(len(state), simulations, 4) / 2.0 ** 32
    h, w = height[:, None], width[:, None]
    box_w, box_h = 1 + np.floor(u[..., 0] * w), 1 + np.floor(u[..., 1] * h)
    x, y = np.floor(u[..., 2] * (w - box_w + 1)), np.floor(u[..., 3] * (h - box_h + 1))
    corners = [c.astype(np.float32).astype(float) for c in (x / w, y / h, (x + box_w) / w, (y + box_h) / h)]
    goal = [target[:, i, None] for i in range(4)]
    mae = sum(np.abs(p - t) for p, t in zip(corners, goal)) / 4
    across = np.minimum(corners[2], goal[2]) - np.maximum(corners[0], goal[0])
    up = np.minimum(corners[3], goal[3]) - np.maximum(corners[1], goal[1])
    shared = np.where((across > 0) & (up > 0), across * up, 0.0)
    own = (corners[2] - corners[0]) * (corners[3] - corners[1])
    wanted = (goal[2] - goal[0]) * (goal[3] - goal[1])

    def ratio(top, bottom):
        """Boxes that do not meet score 0; a ratio to nothing is left out of the mean."""
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where(shared > 0, np.where(bottom > 0, top / bottom, np.nan), 0.0)
            counted = ~np.isnan(value)
            return np.where(counted, value, 0.0).sum(axis=1) / counted.sum(axis=1)

    union = own + wanted - shared
    iou = np.where((shared > 0) & (union > 0), shared / np.where(union > 0, union, 1), 0.0).mean(axis=1)
    return [mae.mean(axis=1), iou, ratio(2 * shared, own + wanted), ratio(shared, own), ratio(shared, np.broadcast_to(wanted, own.shape))]


def _scored(kept: int, simulations: int):
    def run(batches):
        for batch in batches:
            for low in range(0, len(batch), ROWS):
                part = batch.slice(low, ROWS)
                state, height, width = (part.column(kept + i).to_numpy(zero_copy_only=False).astype(float) for i in range(3))
                goals = part.column(kept + 3).to_pylist()
                boxes = np.array([t is not None and len(t) == 4 for t in goals])
                whole = boxes & np.array([t is not None and None not in t for t in goals]) & ~np.isnan(height) & ~np.isnan(width)
                if (height[whole] < 1).any() or (width[whole] < 1).any():
                    raise ValueError("an image has no pixels")
                out = [np.where(boxes, 0.0, np.nan) for _ in METRICS["Detection"]]
                out[0][:] = np.nan
                at = np.flatnonzero(whole)
                if len(at):
                    means = _mean_scores(state[at].astype(np.uint32), height[at], width[at], np.array([goals[i] for i in at]), simulations)
                    for column, mean in zip(out, means):
                        column[at] = mean
                yield pa.RecordBatch.from_arrays([*part.columns[:kept], *[pa.array(c, from_pandas=True) for c in out]],
                                                 [*part.schema.names[:kept], *METRICS["Detection"]])
    return run


def random_scores(
    rows: DataFrame, key: str, keep: Sequence[str] = (), simulations: int = SIMULATIONS, seed: int = SEED
) -> DataFrame:
    """Mean scores of random boxes for every row.

    ``rows`` has ``target`` and ``image_size_2d``. All boxes of a row are drawn and scored beside it as a stretch of a matrix, so
    rows are neither multiplied nor moved. A row whose target is no box has no scores; one of an image of unknown size
    has no error and meets nothing. An image without pixels stops the job.
    """
    height, width = F.get("image_size_2d", F.lit(0)), F.get("image_size_2d", F.lit(1))
    kept = list(dict.fromkeys([key, *keep]))
    slim = rows.select(*kept, key_state(F.col(key), seed).alias("_state"), height.cast("double").alias("_ih"), width.cast("double").alias("_iw"),
                       F.col("target").cast("array<double>").alias("_target"))
    kinds = [f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in kept]
    schema = ", ".join([*kinds, *[f"`{m}` double" for m in METRICS["Detection"]]])
    return slim.mapInArrow(_scored(len(kept), simulations), schema).withColumn("success", F.lit(True))


def random_baseline(
    rows: DataFrame, key: str, simulations: int = SIMULATIONS, seed: int = SEED
) -> DataFrame:
    """Random scores summarised per box-size bin. The row means are what thresholds are applied to, and
    the error shares go by the prefix ``mre`` although they hold absolute errors."""
    binned = rows.withColumn("size_bin", ratio_bin(F.col("box_img_ratio"), "percent"))
    means = random_scores(binned, key, ["size_bin"], simulations, seed)
    return summarise_detection(means, ["size_bin"], error_prefix="mre")
