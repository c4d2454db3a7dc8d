"""Logistic fits by Newton steps that are aggregations, and what stands on them: calibrated and stacked scores.

A step sums gradient and curvature over the rows of every group at once (partial sums before the shuffle), and only
those few sums a group are solved. Nothing is collected; a fit of a hundred groups is as many passes as one.
The number of steps is fixed, so any engine can state the same fit.

Defined cases: rows with a null feature or target take no part in a fit, and a null feature gives a null
score; groups with fewer rows than asked keep their scores; a ridge keeps separable groups finite.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.tables import keep

#: Newton steps of a fit, the ridge of its coefficients, and the rows below which scores stay as they are.
STEPS, RIDGE, LEAST_ROWS = 6, 1e-3, 50
#: Periods that a stack may be fitted for.
MOST_BLOCKS = 64


def logistic(weights: Column, x: Sequence[Column]) -> Column:
    """The probability of weights (constant first) and features."""
    z = F.get(weights, F.lit(0))
    for i, c in enumerate(x, 1):
        z = z + F.get(weights, F.lit(i)) * c
    return 1.0 / (1.0 + F.exp(-z))


def _solve(batches: Iterator[pa.RecordBatch], size: int, ridge: float) -> Iterator[pa.RecordBatch]:
    """A step of every group; the sums come as the gradient and then the upper half of the curvature."""
    upper = np.triu_indices(size)
    for b in batches:
        out = []
        for w, sums in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
            w, sums = np.array(w), np.array(sums)
            h = np.zeros((size, size))
            h[upper] = sums[size:]
            h = h + np.triu(h, 1).T + ridge * np.eye(size)
            out.append((w - np.linalg.solve(h, sums[:size] + ridge * w)).tolist())
        yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(out, pa.list_(pa.float64()))], names=[*b.schema.names[:-2], "w"])


def logistic_fit(rows: DataFrame, by: Sequence[str], x: Sequence[str], y: str, steps: int = STEPS, ridge: float = RIDGE) -> DataFrame:
    """(by, w, n): the weights of a logistic fit of ``y`` (0 to 1) on ``x`` for every group, constant first, and its rows."""
    size = len(x) + 1
    clean = rows.select(*by, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(x, 1)], F.col(y).cast("double").alias("_y")).na.drop()
    clean = keep(clean.withColumn("_x0", F.lit(1.0)), "fit")
    groups = keep(clean.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), "groups")
    coefficients = groups.select(*by, F.array(*[F.lit(0.0)] * size).alias("w"))
    kinds = ", ".join([*[f"`{c}` {groups.schema[c].dataType.simpleString()}" for c in by], "w array<double>"])
    for _ in range(steps):
        p = logistic(F.col("w"), [F.col(f"_x{i}") for i in range(1, size)])
        told = clean.join(coefficients, list(by)).withColumn("_p", p)
        sums = [F.sum((F.col("_p") - F.col("_y")) * F.col(f"_x{i}")) for i in range(size)]
        sums += [F.sum(F.col("_p") * (1 - F.col("_p")) * F.col(f"_x{i}") * F.col(f"_x{j}")) for i in range(size) for j in range(i, size)]
        step = told.groupBy(*by).agg(F.first("w").alias("w"), F.array(*sums).alias("_sums"))
        coefficients = keep(step.mapInArrow(lambda b: _solve(b, size, ridge), kinds), "step")
    return coefficients.join(groups, list(by))


def sigmoid_calibration(train: DataFrame, rows: DataFrame, score: str, label: str, by: Sequence[str] = (), least: int = LEAST_ROWS) -> DataFrame:
    """``rows`` with ``calibrated``: a logistic fit of the label (0 or 1) on the score, for every group of ``train``.

    Targets are smoothed, (n1 + 1) / (n1 + 2) and 1 / (n0 + 2), so no probability is fitted to 0 or 1. Groups
    with fewer than ``least`` rows in ``train`` keep their scores.
    """
    names = list(by) or ["_all"]
    whole = (lambda d: d) if by else (lambda d: d.withColumn("_all", F.lit(1)))
    t, r = whole(train).where(F.col(score).isNotNull() & F.col(label).isNotNull()), whole(rows)
    counts = t.groupBy(*names).agg(F.sum(F.col(label).cast("bigint")).alias("_n1"), F.sum(1 - F.col(label).cast("bigint")).alias("_n0"))
    target = F.when(F.col(label) == 1, (F.col("_n1") + 1) / (F.col("_n1") + 2)).otherwise(1 / (F.col("_n0") + 2))
    fit = logistic_fit(t.join(counts, names).withColumn("_target", target), names, [score], "_target").where(F.col("n") >= least)
    out = r.join(fit, names, "left").withColumn("calibrated", F.when(F.col("w").isNull(), F.col(score)).otherwise(logistic(F.col("w"), [F.col(score)])))
    return out.drop("w", "n", "_all")


def stacked_scores(rows: DataFrame, key: str, block: str, category: str, scores: Sequence[str], hit: str, least: int = LEAST_ROWS) -> DataFrame:
    """(key, category, block, stacked): scores of several models joined to one, never fitted on their own time or later.

    ``rows`` has a row for each key and class, with its period, the models' scores and whether the class is the
    true one. Each class of a period gets a logistic fit on all periods before; where those have fewer than ``least``
    rows the scores are averaged. A key's classes then add up to one.
    """
    mean = sum((F.col(s) for s in scores), F.lit(0.0)) / len(scores)
    rows = keep(rows.select(key, block, category, *scores, F.col(hit).cast("double").alias("_hit")), "stack")
    blocks = sorted(r[0] for r in rows.select(block).distinct().limit(MOST_BLOCKS + 1).collect() if r[0] is not None)
    if len(blocks) > MOST_BLOCKS:
        raise ValueError(f"more than {MOST_BLOCKS} periods")
    later = F.explode(F.filter(F.array(*[F.lit(b) for b in blocks]), lambda b: b > F.col(block))).alias("_for")
    past = rows.select(category, *scores, "_hit", later)
    fit = logistic_fit(past, [category, "_for"], scores, "_hit").where(F.col("n") >= least).withColumnRenamed("_for", block)
    told = rows.join(fit, [category, block], "left").withColumn("_p", F.when(F.col("w").isNull(), mean).otherwise(logistic(F.col("w"), [F.col(s) for s in scores])))
    total = F.sum("_p").over(Window.partitionBy(key))
    return told.select(key, category, block, F.when(total > 0, F.col("_p") / total).alias("stacked"))
