"""Named metrics and how they are aggregated."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions import textscores
from scorelake.operators import stats, translation
from scorelake.operators.ranking import joined_null_safe


@dataclass(frozen=True)
class Metric:
    """``aggregation`` names how rows become a score, ``parts`` is the number of row columns that it reads."""

    aggregation: str
    higher_is_better: bool
    output_type: str
    parts: int = 1

    @property
    def aggregate(self) -> Callable[..., Column]:
        return AGGREGATIONS[self.aggregation]


METRICS: dict[str, Metric] = {}
#: Aggregations that are one mergeable aggregate of the row columns.
AGGREGATIONS: dict[str, Callable[..., Column]] = {}
#: Aggregations over a table: (rows, by, columns, key) -> by and the score as ``value``.
TABLE_AGGREGATIONS: dict[str, Callable[..., DataFrame]] = {}


def register_aggregation(name: str, aggregate: Callable[..., Column]) -> None:
    if name in AGGREGATIONS or name in TABLE_AGGREGATIONS:
        raise ValueError(f"aggregation {name} exists")
    AGGREGATIONS[name] = aggregate


def register_table_aggregation(name: str, aggregate: Callable[..., DataFrame]) -> None:
    if name in AGGREGATIONS or name in TABLE_AGGREGATIONS:
        raise ValueError(f"aggregation {name} exists")
    TABLE_AGGREGATIONS[name] = aggregate


def register_metric(name: str, aggregation: str, higher_is_better: bool, output_type: str, parts: int = 1) -> None:
    if name in METRICS:
        raise ValueError(f"metric {name} exists")
    if aggregation not in AGGREGATIONS and aggregation not in TABLE_AGGREGATIONS:
        raise ValueError(f"no aggregation {aggregation}")
    METRICS[name] = Metric(aggregation, higher_is_better, output_type, parts)


for _name, _fn in {
    "mean": F.avg, "perplexity": stats.perplexity, "weighted_perplexity": stats.weighted_perplexity,
    "bits_per_byte": stats.bits_per_byte, "f1": stats.f1_score, "matthews_corrcoef": stats.matthews_corrcoef,
    "brier_score": lambda probabilities, gold: F.avg(textscores.brier(probabilities, gold)),
    "bypass": lambda _value: stats.bypass(),
}.items():
    register_aggregation(_name, _fn)


def _median(rows: DataFrame, by: Sequence[str], columns: Sequence[str], key: str) -> DataFrame:
    return stats.middle_in_order(rows, columns[0], [key], by).withColumnRenamed("median", "value")


def _all_right(rows: DataFrame, by: Sequence[str], columns: Sequence[str], key: str) -> DataFrame:
    paragraph, question, correct = columns
    whole = rows.groupBy(*by, paragraph, question).agg(F.min(F.col(correct).cast("int")).alias("_ok"))
    return whole.groupBy(*by).agg(F.avg("_ok").alias("value"))


def _translated(metric: str) -> Callable[..., DataFrame]:
    def score(rows: DataFrame, by: Sequence[str], columns: Sequence[str], key: str) -> DataFrame:
        found = translation.corpus_score(rows, metric, F.col(columns[0]), F.col(columns[1]), by)
        return found.withColumnRenamed(metric, "value")

    return score


register_table_aggregation("median", _median)
register_table_aggregation("acc_all", _all_right)
for _name in ("bleu", "chrf", "ter"):
    register_table_aggregation(_name, _translated(_name))

for _args in (
    ("acc", "mean", True, "multiple_choice"), ("acc_norm", "mean", True, "multiple_choice"),
    ("acc_mutual_info", "mean", True, "multiple_choice"), ("exact_match", "mean", True, "generate_until"),
    ("anls", "mean", True, "generate_until"), ("bypass", "bypass", True, "generate_until"),
    ("perplexity", "perplexity", False, "loglikelihood"),
):
    register_metric(*_args)
for _args in (
    ("word_perplexity", "weighted_perplexity", False, "loglikelihood_rolling"),
    ("byte_perplexity", "weighted_perplexity", False, "loglikelihood_rolling"),
    ("bits_per_byte", "bits_per_byte", False, "loglikelihood_rolling"), ("f1", "f1", True, "multiple_choice"),
    ("mcc", "matthews_corrcoef", True, "multiple_choice"), ("brier_score", "brier_score", False, "multiple_choice"),
    ("bleu", "bleu", True, "generate_until"), ("chrf", "chrf", True, "generate_until"), ("ter", "ter", True, "generate_until"),
):
    register_metric(*_args, parts=2)
register_metric("acc_all", "acc_all", True, "loglikelihood", parts=3)

# Aggregations whose error comes from resampling, those with a closed form, and the rounds that the
# costly ones take at most. All others have no error.
BOOTSTRAPPED = ("median", "matthews_corrcoef", "f1", "perplexity", "bleu", "chrf", "ter")
CLOSED = ("mean", "acc_all")
FEW_ROUNDS = {"bleu": 100, "chrf": 100, "ter": 100}

# Metrics a task gets when it names none.
DEFAULT_METRICS = {
    "loglikelihood": ("perplexity", "acc"),
    "multiple_choice": ("acc", "acc_norm"),
    "generate_until": ("exact_match",),
    "generate_until_multi_round": ("exact_match",),
}


def metrics_of(output_type: str, named: Sequence[str] | None = None, predict_only: bool = False) -> tuple[str, ...]:
    """A task's metrics: the ones it names, else the default ones, or only the stand-in."""
    if predict_only:
        return ("bypass",)
    return tuple(named) if named else DEFAULT_METRICS[output_type]


def columns_of(name: str) -> list[str]:
    """Row columns of a metric: its name, or ``<name>_0``, ``<name>_1`` and so on when it reads several."""
    parts = METRICS[name].parts
    return [name] if parts == 1 else [f"{name}_{i}" for i in range(parts)]


def aggregate(rows: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One aggregate per metric over its columns, all in one pass; for metrics that are mergeable aggregates."""
    cells = [METRICS[m].aggregate(*[F.col(c) for c in columns_of(m)]).alias(m) for m in metrics]
    return rows.groupBy(*by).agg(*cells)


def _resampled(rows: DataFrame, by: Sequence[str], name: str, key: str, rounds: int) -> DataFrame:
    """``by`` and the standard error of a metric by resampling."""
    kind, columns = METRICS[name].aggregation, columns_of(name)
    if kind in ("f1", "matthews_corrcoef"):
        gold, pred = F.col(columns[0]) == 1, F.col(columns[1]) == 1
        cells = {"tp": gold & pred, "fp": ~gold & pred, "fn": gold & ~pred, "tn": ~gold & ~pred}
        sums = {n: F.col(n) for n in cells}
        value = stats.mcc_of(**sums) if kind == "matthews_corrcoef" else stats.f1_of(sums["tp"], sums["fp"], sums["fn"])
        return stats.bootstrap_cells(rows, {n: c.cast("double") for n, c in cells.items()}, value, rounds, by)
    if kind == "perplexity":
        value = F.exp(-F.col("total") / F.col("resampled"))
        return stats.bootstrap_stderr(rows, {"total": F.col(columns[0])}, value, key, rounds, by)
    if kind == "median":
        # The value in the middle of rows drawn at random is any of them, so its deviation is theirs.
        n = F.count(columns[0])
        return rows.groupBy(*by).agg(F.when(n > 1, F.stddev_pop(columns[0])).alias("stderr"))
    width = translation.WIDTHS[kind]
    counts = translation.row_counts(rows, kind, F.col(columns[0]), F.col(columns[1]), list(dict.fromkeys([*by, key])))
    totals = {f"s{i}": F.col(f"s{i}") for i in range(width)}
    return stats.bootstrap_stderr(counts, totals, translation.FORMULAS[kind](list(totals.values())), key, rounds, by)


def scored_with_errors(
    rows: DataFrame, by: Sequence[str], metrics: Sequence[str], key: str, rounds: int = stats.ROUNDS
) -> DataFrame:
    """``by``, metric, value and stderr of every metric named.

    The error is a closed form for means, comes from ``rounds`` resamples for the aggregations of ``BOOTSTRAPPED``, and is
    null for the rest, with fewer than two rows, or when ``rounds`` is 0. ``key`` is a unique whole number, the order of
    a median. Closed forms and mergeable scores of all metrics take one pass.
    """
    missing = F.lit(None).cast("double")
    merged = [m for m in metrics if METRICS[m].aggregation in AGGREGATIONS]
    tables = []
    if merged:
        cells = []
        for m in merged:
            columns = [F.col(c) for c in columns_of(m)]
            closed = METRICS[m].aggregation in CLOSED and rounds > 0
            error = F.when(F.count("*") > 1, stats.mean_stderr(columns[0].cast("double"))) if closed else missing
            cells.append(F.struct(F.lit(m).alias("metric"), METRICS[m].aggregate(*columns).cast("double").alias("value"), error.alias("stderr")))
        wide = rows.groupBy(*by).agg(F.array(*cells).alias("_cells"))
        tables.append(wide.select(*by, F.explode("_cells").alias("_c")).select(*by, "_c.*"))
    for m in metrics:
        if m not in merged:
            scored = TABLE_AGGREGATIONS[METRICS[m].aggregation](rows, by, columns_of(m), key)
            tables.append(scored.select(*by, F.lit(m).alias("metric"), F.col("value").cast("double").alias("value"), missing.alias("stderr")))
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    errors = None
    for m in metrics:
        kind = METRICS[m].aggregation
        if rounds <= 0:
            continue
        if kind in BOOTSTRAPPED:
            found = _resampled(rows, by, m, key, min(rounds, FEW_ROUNDS.get(kind, rounds)))
        elif kind == "acc_all":
            _, question, correct = columns_of(m)
            whole = rows.groupBy(*by, question).agg(F.min(F.col(correct).cast("int")).cast("double").alias("_ok"))
            found = whole.groupBy(*by).agg(F.when(F.count("*") > 1, stats.mean_stderr(F.col("_ok"))).alias("stderr"))
        else:
            continue
        found = found.select(*by, F.lit(m).alias("metric"), F.col("stderr").alias("_error"))
        errors = found if errors is None else errors.unionByName(found)
    if errors is None:
        return out
    joined = joined_null_safe(out, errors, [*by, "metric"], "left")
    return joined.withColumn("stderr", F.coalesce("stderr", "_error")).drop("_error")


# How a task's own functions are found by name: for targets, row scores and aggregations of a task.
TASK_FUNCTIONS: dict[tuple[str, str], Callable[..., Column]] = {}


def register_task_function(task: str, role: str, function: Callable[..., Column]) -> None:
    """``role`` is target, score or aggregation; the function maps columns to a column."""
    if role not in ("target", "score", "aggregation"):
        raise ValueError("role must be target, score or aggregation")
    if (task, role) in TASK_FUNCTIONS:
        raise ValueError(f"task {task} has its {role}")
    TASK_FUNCTIONS[task, role] = function


def by_task(role: str, task: Column, *columns: Column, default: Callable[..., Column] | None = None) -> Column:
    """The value each row's own task gives it; ``default`` for tasks without a function, else null."""
    other = default(*columns) if default else F.lit(None)
    chosen = other
    for (name, known), function in sorted(TASK_FUNCTIONS.items()):
        if known == role:
            chosen = F.when(task == name, function(*columns)).otherwise(chosen)
    return chosen


def settings_for(model: str, per_model: dict[str, dict | None], dataset: dict | None = None) -> dict | None:
    """Settings of a model: its own entry, else ``default``, else the data set's."""
    return per_model.get(model) or per_model.get("default") or dataset
