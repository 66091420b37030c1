"""A linear head trained by mini-batch steps of the cross-entropy.

The batches are those of the epoch plan (T5). Rows with their place in the plan
are stored in the plan's order, so a step's scan reads the row groups of its
batch. Every task sums the gradient of its rows in numpy, one row of sums per
Arrow batch; Spark adds those up per weight, and the driver, which holds the
weights (classes x dimensions), takes the step."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tessera.session import stored


def plan_rows(vectors: DataFrame, plan: DataFrame, key: str = "vec_id", label: str = "label", vec: str = "embedding") -> DataFrame:
    """``(epoch, step, label, x)`` of every planned row, in the order of steps."""
    rows = vectors.select(F.col(key).alias("block_id"), F.col(label).cast("int").alias("label"), F.col(vec).cast("array<double>").alias("x"))
    return stored(rows.join(plan.select("epoch", "step", "block_id"), "block_id").select("epoch", "step", "label", "x")
                  .repartitionByRange("epoch", "step").sortWithinPartitions("epoch", "step"), "head-rows")


def _gradients(weights: np.ndarray):
    """Of each Arrow batch: rows, loss and gradient (class by dimension, the bias
    last), summed."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            x, y = np.column_stack([x, np.ones(len(x))]), b.column("label").to_numpy(zero_copy_only=False)
            z = x @ weights.T
            z -= z.max(axis=1, keepdims=True)
            loss = np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            sums = np.concatenate([[len(y), loss.sum()], (p.T @ x).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], names=["i", "g"])
    return run


def head_step(batch: DataFrame, weights: np.ndarray, rate: float, decay: float = 0.0) -> tuple[np.ndarray, float]:
    """One step on the rows ``(label, x)`` of a batch: the new weights, and the
    mean loss before the step. Decay leaves the bias alone."""
    sums = batch.select("label", "x").mapInArrow(_gradients(weights), "i long, g double").groupBy("i").agg(F.sum("g").alias("g")).collect()
    if not sums:
        return weights, float("nan")
    g = np.zeros(2 + weights.size)
    for r in sums:
        g[r["i"]] = r["g"]
    shrink = np.full(weights.shape, 1 - rate * decay)
    shrink[:, -1] = 1
    return weights * shrink - rate * g[2:].reshape(weights.shape) / g[0], g[1] / g[0]


def train_head(rows: DataFrame, n_classes: int, n_dims: int, steps: Iterable[tuple[int, int]], rate: float = 0.5,
               decay: float = 0.0) -> tuple[np.ndarray, list[float]]:
    """Weights after the plan's ``steps`` (epoch, step), from zero, and the
    loss before each."""
    weights, losses = np.zeros((n_classes, n_dims + 1)), []
    for epoch, step in steps:
        weights, loss = head_step(rows.where((F.col("epoch") == epoch) & (F.col("step") == step)), weights, rate, decay)
        losses.append(loss)
    return weights, losses


def predicted(vectors: DataFrame, weights: np.ndarray, vec: str = "embedding") -> "F.Column":
    """The class with the highest logit, the lowest on ties (an expression)."""
    x = F.concat(F.col(vec).cast("array<double>"), F.array(F.lit(1.0)))
    logits = F.array(*[F.aggregate(F.zip_with(x, F.array(*[F.lit(float(w)) for w in row]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
                       for row in weights])
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")
