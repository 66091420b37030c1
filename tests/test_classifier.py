"""The head separates what is separable, and beats chance on the fixture."""

import random

from tessera.operators.vectors import classifier_accuracy, fit_classifier
from tests.conftest import SF001


def test_head_separates_shifted_classes(spark):
    rng = random.Random(3)
    rows = [([rng.gauss(2.0 * (j == y), 0.5) for j in range(6)], y) for y in range(4) for _ in range(60)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "embedding array<double>, label int, i int")
    model = fit_classifier(df.where("i % 3 <> 0"))
    assert classifier_accuracy(model, df.where("i % 3 = 0")).first().accuracy > 0.95


def test_head_beats_chance_on_the_vectors(spark):
    v = spark.read.parquet(f"{SF001}/embeddings.parquet")
    n_labels = v.select("label").distinct().count()
    model = fit_classifier(v, reg=0.01, max_iter=30)
    assert classifier_accuracy(model, v).first().accuracy > 2 / n_labels


def _plain_step(rows, w, rate, decay):
    import numpy as np
    g = np.zeros_like(w)
    loss = 0.0
    for x, y in rows:
        x = np.append(x, 1.0)
        z = w @ x
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        loss -= np.log(p[y])
        p[y] -= 1
        g += np.outer(p, x)
    keep = np.ones_like(w)
    keep[:, :-1] = 1 - rate * decay
    return w * keep - rate * g / len(rows), loss / len(rows)


def test_steps_against_a_loop_and_an_accuracy_floor(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from tessera.config import Params
    from tessera.operators.batching import epoch_plan
    from tessera.operators.head import plan_rows, predicted, train_head
    rng = random.Random(5)
    rows = [(i, [rng.gauss(2.0 * (j == i % 3), 0.7) for j in range(4)], i % 3) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    plan = epoch_plan(df.select(F.lit("train").alias("split"), F.col("vec_id").alias("block_id")), Params(batch_size=40), epochs=3)
    batches = {}
    for r in plan.collect():
        batches.setdefault((r.epoch, r.step), []).append(rows[r.block_id][1:])
    steps = sorted(batches)
    assert len(steps) == 9                                   # 150 rows: three full batches an epoch
    placed = plan_rows(df, plan)
    got, losses = train_head(placed, 3, 4, steps, 0.5, 0.01)
    want, want_losses = np.zeros((3, 5)), []
    for s in steps:
        want, loss = _plain_step(batches[s], want, 0.5, 0.01)
        want_losses.append(loss)
    assert np.allclose(got, want) and np.allclose(losses, want_losses) and losses[-1] < losses[0]
    assert df.where(predicted(df, got) == F.col("label")).count() > 0.9 * 150
    same, nothing = train_head(placed, 3, 4, [(99, 1)])
    assert (same == 0).all() and np.isnan(nothing[0])


def test_a_step_scans_its_batch(spark):
    from pyspark.sql import functions as F

    from tessera.config import Params
    from tessera.operators.batching import epoch_plan
    from tessera.operators.head import plan_rows
    df = spark.createDataFrame([(i, [1.0], 0) for i in range(64)], "vec_id long, embedding array<double>, label int")
    plan = epoch_plan(df.select(F.lit("train").alias("split"), F.col("vec_id").alias("block_id")), Params(batch_size=8), epochs=2)
    plan_text = plan_rows(df, plan).where("epoch = 1 AND step = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(epoch), IsNotNull(step), EqualTo(epoch,1), EqualTo(step,3)]" in plan_text
