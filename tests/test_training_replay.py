"""Training losses without a row for each occurrence and epoch."""

import math
import random
from collections import Counter

import pytest

from tessera.config import Params
from tessera.operators import training
from tessera.operators.batching import epoch_plan
from tessera.session import cut_lineage


def _loop(rows, plan, P, alpha):
    """The definition, one step after the other; a block counts as often as the plan names it."""
    tokens, order = {}, {}
    for _, b, t in rows:
        tokens.setdefault(b, []).append(t)
    for e, s, b in plan:
        order.setdefault((e, s), []).append(b)
    pairs, totals, waiting, want = Counter(), Counter(), [], {}
    for e, s in sorted(order):
        own = [p for b in order[e, s] for t in tokens.get(b, ()) for p in zip(t, t[1:])]
        if own:
            want[e, s] = sum(-math.log((pairs[p] + alpha) / (totals[p[0]] + alpha * P.n_ids)) for p in own) / len(own)
        waiting += own
        if s % P.grad_accum_steps == 0:
            pairs.update(waiting)
            totals.update(p[0] for p in waiting)
            waiting = []
    return want


@pytest.mark.parametrize("ids", [3, 60_000])
@pytest.mark.parametrize("small", [False, True])
def test_replayed_in_slices(spark, monkeypatch, ids, small):
    if small:
        for name, n in (("PART_ENTRIES", 50), ("HELD_ENTRIES", 40), ("SLICE", 20), ("STEPS_A_ROW", 3)):
            monkeypatch.setattr(training, name, n)
    rng = random.Random(ids)
    P = Params(vocab_size=ids, batch_size=2, grad_accum_steps=2, epochs=4)
    rows = [("train", 7 * i + 1, [rng.choice((1, rng.randrange(ids))) for _ in range(rng.choice((1, 2, 12)))]) for i in range(23)]
    blocks = spark.createDataFrame(rows + [("val", 5, [1, 1, 1])], "split string, block_id long, tokens array<int>").repartition(3)
    plan = epoch_plan(blocks, P).select("epoch", "step", "block_id")
    got = {(r.epoch, r.step): r.loss for r in training.training_steps(blocks, plan, P).collect()}
    assert got == pytest.approx(_loop(rows, [tuple(r) for r in plan.collect()], P, P.alpha))


def test_a_block_that_comes_twice(spark):
    P = Params(vocab_size=4, batch_size=2, grad_accum_steps=1, epochs=2)
    rows = [("train", 0, [1, 2, 1, 2]), ("train", 1, [2, 2, 3]), ("train", 1, [2, 2]), ("train", 2, [1, 2, 3])]
    blocks = spark.createDataFrame(rows, "split string, block_id long, tokens array<int>")
    plan = [(e, s, b) for e in (0, 1) for s, b in ((1, 0), (1, 1), (2, 0), (2, 0), (3, 1 + e))]
    got = {(r.epoch, r.step): r.loss for r in training.training_steps(blocks, spark.createDataFrame(plan, "epoch int, step long, block_id long"), P).collect()}
    assert got == pytest.approx(_loop(rows, plan, P, P.alpha))


def test_no_occurrence_becomes_a_row(spark):
    """Neither a window over occurrences nor a copy of them for every epoch: what is
    shuffled are packed counts, a few rows a task whatever the epochs."""
    P = Params(vocab_size=50, batch_size=2, epochs=30)
    rng = random.Random(4)
    rows = [("train", i, [rng.randrange(50) for _ in range(200)]) for i in range(40)]
    blocks = spark.createDataFrame(rows, "split string, block_id long, tokens array<int>").coalesce(2)
    plan = cut_lineage(epoch_plan(blocks, P).select("epoch", "step", "block_id"))
    shown = training.training_steps(blocks, plan, P)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in shown and "Generate" not in shown and "entries#" in shown
