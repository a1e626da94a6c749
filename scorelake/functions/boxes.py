"""Box overlap measures, box size shares and box targets.

Boxes are ``[x0, y0, x1, y1]`` arrays in relative coordinates with the origin at the lower left.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Overlap:
    """Intersection and areas of a predicted and a target box; null when either is not a box."""

    def __init__(self, pred: Column, target: Column):
        p = [F.get(pred, F.lit(i)) for i in range(4)]
        t = [F.get(target, F.lit(i)) for i in range(4)]
        self.valid = (F.size(pred) == 4) & (F.size(target) == 4)
        left, bottom = F.greatest(p[0], t[0]), F.greatest(p[1], t[1])
        right, top = F.least(p[2], t[2]), F.least(p[3], t[3])
        self.apart = (left >= right) | (bottom >= top)
        self.shared = (right - left) * (top - bottom)
        self.pred_area = (p[2] - p[0]) * (p[3] - p[1])
        self.target_area = (t[2] - t[0]) * (t[3] - t[1])

    def _ratio(self, top: Column, bottom: Column, when_flat: Column) -> Column:
        value = F.when(self.apart, F.lit(0.0)).when(bottom > 0, top / bottom).otherwise(when_flat)
        return F.when(self.valid, value)

    def iou(self) -> Column:
        union = self.pred_area + self.target_area - self.shared
        return self._ratio(self.shared, union, F.lit(0.0))

    def f1(self) -> Column:
        return self._ratio(2.0 * self.shared, self.pred_area + self.target_area, F.lit(None).cast("double"))

    def precision(self) -> Column:
        return self._ratio(self.shared, self.pred_area, F.lit(None).cast("double"))

    def recall(self) -> Column:
        return self._ratio(self.shared, self.target_area, F.lit(None).cast("double"))


def iou(pred: Column, target: Column) -> Column:
    return Overlap(pred, target).iou()


def f1(pred: Column, target: Column) -> Column:
    return Overlap(pred, target).f1()


def precision(pred: Column, target: Column) -> Column:
    return Overlap(pred, target).precision()


def recall(pred: Column, target: Column) -> Column:
    return Overlap(pred, target).recall()


def box_image_ratio(dimensions: Column, image_size: Column, target: Column) -> Column:
    """Share of the image a box covers: from its dimensions when known, else from the relative target."""
    first = F.get(dimensions, F.lit(0))
    measured = (F.get(first, F.lit(0)) * F.get(first, F.lit(1))) / (
        F.get(image_size, F.lit(0)).cast("double") * F.get(image_size, F.lit(1))
    )
    relative = F.abs(F.get(target, F.lit(2)) - F.get(target, F.lit(0))) * F.abs(
        F.get(target, F.lit(3)) - F.get(target, F.lit(1))
    )
    return F.when(dimensions.isNotNull(), measured).otherwise(relative)


def box_target(min_coord: Column, max_coord: Column, image_size: Column) -> Column:
    """Turn (row, column) corners counted from the top left into a relative box from the lower left."""
    height, width = F.get(image_size, F.lit(0)), F.get(image_size, F.lit(1))
    top, left = F.get(min_coord, F.lit(0)), F.get(min_coord, F.lit(1))
    bottom, right = F.get(max_coord, F.lit(0)), F.get(max_coord, F.lit(1))
    return F.array(left / width, (height - bottom) / height, right / width, (height - top) / height)


RATIO_STEPS = 18
RATIO_STEP_PERCENT = 5


def ratio_bin(ratio: Column, style: str = "range") -> Column:
    """Name of the 5 % bin a ratio falls in; from 90 % on there is one open bin.

    A missing ratio has no bin. Thresholds are literals, since ``floor(ratio / 0.05)`` splits differently at the edges.
    ``style`` is ``"range"`` for ``0.05~0.10`` names or ``"percent"`` for ``5% <= Box/Image < 10%``.
    """
    if style not in ("range", "percent"):
        raise ValueError("style must be 'range' or 'percent'")
    names = ratio_bin_names(style)
    chosen = F.when(ratio.isNotNull(), F.lit(names[-1]))
    for step in range(RATIO_STEPS, 0, -1):
        edge = step * RATIO_STEP_PERCENT / 100
        chosen = F.when(ratio < edge, F.lit(names[step - 1])).otherwise(chosen)
    return chosen


def ratio_bin_names(style: str = "range") -> list[str]:
    edges = [step * RATIO_STEP_PERCENT for step in range(1, RATIO_STEPS + 1)]
    if style == "range":
        inner = [f"{a / 100:.2f}~{b / 100:.2f}" for a, b in zip(edges, edges[1:])]
        return [f"<{edges[0] / 100:.2f}", *inner, f">={edges[-1] / 100:.2f}"]
    inner = [f"{a}% <= Box/Image < {b}%" for a, b in zip(edges, edges[1:])]
    return [f"Box/Image < {edges[0]}%", *inner, f"{edges[-1]}% <= Box/Image"]
