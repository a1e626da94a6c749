"""Scorers for numeric answers. A failed row carries nulls, never NaN."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions.numbers import answer_length

# Fixed value: keeps the relative error of a zero target finite.
EPSILON = 1e-15


def _matched(pred: Column, target: Column, k: int) -> tuple[list[Column], list[Column], Column]:
    """Pair the k predicted values with the target, repeating a single target as arrays broadcast."""
    p = [F.get(pred, F.lit(i)) for i in range(k)]
    if k == 1:
        return p, [F.get(target, F.lit(0))], pred.isNotNull() & (F.size(target) == 1)
    single = F.size(target) == 1
    t = [F.when(single, F.get(target, F.lit(0))).otherwise(F.get(target, F.lit(i))) for i in range(k)]
    return p, t, pred.isNotNull() & (single | (F.size(target) == k))


def _mean(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts) / float(len(parts))


def mean_absolute_error(pred: Column, target: Column, k: int) -> Column:
    p, t, ok = _matched(pred, target, k)
    return F.when(ok, _mean([F.abs(a - b) for a, b in zip(p, t)]))


def mean_relative_error(pred: Column, target: Column, k: int, epsilon: float = EPSILON) -> Column:
    """A negative target gives a negative error. Without the epsilon a zero target gives infinity
    (null when the prediction is zero as well)."""
    p, t, ok = _matched(pred, target, k)
    if epsilon:
        return F.when(ok, _mean([F.abs(a - b) / (b + epsilon) for a, b in zip(p, t)]))
    bare = [
        F.when(b != 0, F.abs(a - b) / b).when(a != b, F.lit(float("inf"))) for a, b in zip(p, t)
    ]
    return F.when(ok, _mean(bare))


METRICS = {"Detection": ("mae", "iou", "f1", "precision", "recall"), "AD": ("mae", "mre"), "TL": ("mae", "mre")}


def with_scores(
    df: DataFrame, pred: Column, target: Column, task_kind: str, on_failure: str = "null"
) -> DataFrame:
    """Add every metric of a row and ``success``.

    ``on_failure="null"`` leaves the overlap metrics of a failed row out of later means;
    ``"zero"`` counts them as 0. The two give different mean overlaps on the same rows.

    The work goes in steps of named columns: each value is then computed once and the generated methods
    stay small enough to be compiled, where one expression per metric repeats the corners many times.
    """
    if on_failure not in ("null", "zero"):
        raise ValueError("on_failure must be 'null' or 'zero'")
    k = answer_length(task_kind)
    names = df.columns
    if task_kind != "Detection":
        both = df.withColumns({"_p": pred, "_t": target})
        p, t, ok = _matched(F.col("_p"), F.col("_t"), k)
        cells = both.select(
            *names, F.coalesce(ok, F.lit(False)).alias("success"),
            *[c.alias(f"_p{i}") for i, c in enumerate(p)], *[c.alias(f"_t{i}") for i, c in enumerate(t)],
        )
        gaps = [F.abs(F.col(f"_p{i}") - F.col(f"_t{i}")) for i in range(k)]
        mre = _mean([gap / (F.col(f"_t{i}") + EPSILON) for i, gap in enumerate(gaps)])
        return cells.select(
            *names, F.when(F.col("success"), _mean(gaps)).alias("mae"),
            F.when(F.col("success"), mre).alias("mre"), "success",
        )
    corners = df.withColumns({"_p": pred, "_t": target}).select(
        *names, F.coalesce((F.size("_p") == 4) & (F.size("_t") == 4), F.lit(False)).alias("success"),
        *[F.get(F.col(c), F.lit(i)).alias(f"{c}{i}") for c in ("_p", "_t") for i in range(4)],
    )
    c = F.col
    sides = corners.select(
        *names, "success",
        _mean([F.abs(c(f"_p{i}") - c(f"_t{i}")) for i in range(4)]).alias("_mae"),
        (F.least("_p2", "_t2") - F.greatest("_p0", "_t0")).alias("_w"),
        (F.least("_p3", "_t3") - F.greatest("_p1", "_t1")).alias("_h"),
        ((c("_p2") - c("_p0")) * (c("_p3") - c("_p1"))).alias("_pa"),
        ((c("_t2") - c("_t0")) * (c("_t3") - c("_t1"))).alias("_ta"),
    )
    areas = sides.select(
        *names, "success", "_mae", "_pa", "_ta", (c("_w") * c("_h")).alias("_in"),
        (c("success") & (c("_w") > 0) & (c("_h") > 0)).alias("_meet"),
        F.when(c("success") | F.lit(on_failure == "zero"), F.lit(0.0)).alias("_zero"),
    )
    none = F.lit(None).cast("double")

    def ratio(top: Column, bottom: Column, flat: Column) -> Column:
        return F.when(c("_meet"), F.when(bottom > 0, top / bottom).otherwise(flat)).otherwise(c("_zero"))

    return areas.select(
        *names, F.when(c("success"), c("_mae")).alias("mae"),
        ratio(c("_in"), c("_pa") + c("_ta") - c("_in"), F.lit(0.0)).alias("iou"),
        ratio(2.0 * c("_in"), c("_pa") + c("_ta"), none).alias("f1"),
        ratio(c("_in"), c("_pa"), none).alias("precision"),
        ratio(c("_in"), c("_ta"), none).alias("recall"),
        "success",
    )


def online_scores(pred: Column, target: Column, kind: str) -> Column:
    """Scorers applied while a run is going on: ``box``, ``lesion``, ``mask`` or ``biometric``.

    Boxes and lesions divide by the bare target; masks and biometrics reject negative predictions.
    """
    if kind in ("box", "lesion"):
        k = 4 if kind == "box" else 2
        success = _matched(pred, target, k)[2]
        return F.struct(
            mean_absolute_error(pred, target, k).alias("mae"),
            mean_relative_error(pred, target, k, epsilon=0.0).alias("mre"),
            F.coalesce(success, F.lit(False)).alias("success"),
        )
    if kind in ("mask", "biometric"):
        allowed = F.when(F.get(pred, F.lit(0)) >= 0, pred)
        return F.struct(
            mean_absolute_error(allowed, target, 1).alias("ae"),
            mean_relative_error(allowed, target, 1).alias("re"),
            F.coalesce(_matched(allowed, target, 1)[2], F.lit(False)).alias("success"),
        )
    raise ValueError("kind must be 'box', 'lesion', 'mask' or 'biometric'")
