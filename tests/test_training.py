"""Training loss and interpolated n-grams against plain loops."""

import math
import random
import re
from collections import Counter

import pytest

from tessera.config import Params
from tessera.operators.batching import epoch_plan
from tessera.operators.interpolated import evaluate_ngrams, fit_ngrams, history, shift_ngrams
from tessera.operators.training import running_before, training_loss, training_steps


def _blocks(spark, n, size=9, ids=6, seed=1, splits=("train",)):
    rng = random.Random(seed)
    rows = [(rng.choice(splits), i, [rng.randrange(ids) for _ in range(size)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "split string, block_id long, tokens array<int>").repartition(3)


@pytest.mark.parametrize("accum, n", [(1, 17), (2, 17), (3, 23)])
def test_training_loss_against_a_loop(spark, accum, n):
    P = Params(vocab_size=6, batch_size=2, grad_accum_steps=accum, epochs=3, alpha=0.5)
    rows, blocks = _blocks(spark, n)
    tokens = {b: t for _, b, t in rows}
    plan = epoch_plan(blocks, P)
    order = {}
    for r in plan.collect():
        order.setdefault((r.epoch, r.step), []).append(r.block_id)
    pairs, totals, waiting, want = Counter(), Counter(), [], {}
    for epoch, step in sorted(order):
        own = [p for b in order[epoch, step] for p in zip(tokens[b], tokens[b][1:])]
        want[epoch, step] = sum(-math.log((pairs[p] + 0.5) / (totals[p[0]] + 0.5 * P.n_ids)) for p in own) / len(own)
        waiting += own
        if step % accum == 0:
            pairs.update(waiting)
            totals.update(p[0] for p in waiting)
            waiting = []
    steps = training_steps(blocks, plan, P)
    got = {(r.epoch, r.step): r.loss for r in steps.collect()}
    assert got == pytest.approx(want)
    for r in training_loss(steps).collect():
        mean = sum(v for (e, _), v in want.items() if e == r.epoch) / r.n_steps
        assert r.loss == pytest.approx(mean) and r.perplexity == pytest.approx(math.exp(mean))


def test_too_few_blocks_for_a_batch(spark):
    P = Params(vocab_size=6, batch_size=8, epochs=2)
    _, blocks = _blocks(spark, 3)
    assert training_loss(training_steps(blocks, epoch_plan(blocks, P), P)).count() == 0


@pytest.mark.parametrize("width", [1, 4, 1000])
def test_running_sums_do_not_depend_on_ranges(spark, width):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randrange(40), rng.randrange(5), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o int, v int, i int").repartition(5)
    got = {r.i: r.s for r in running_before(df, ["k"], "o", "v", width, "s").collect()}
    assert got == {i: sum(v2 for k2, o2, v2, _ in rows if k2 == k and o2 < o) for k, o, v, i in rows}


def test_no_task_holds_all_of_a_hot_pair(spark):
    """The window over a pair's updates is cut into ranges in the executed plan."""
    df = spark.createDataFrame([("a", i, 1) for i in range(50)], "k string, o int, v int")
    plan = running_before(df, ["k"], "o", "v", 7, "s")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Window \[.*RangeFrame.*\], \[k#\d+, _part#\d+L?\], \[o#", plan)


def _brute(rows, order, n_ids, rounds):
    def grams(tokens):
        for t in range(1, len(tokens)):
            yield tuple([None] * max(0, order - 1 - t) + list(tokens[max(0, t - order + 1):t])), tokens[t]
    counts, totals = {k: Counter() for k in range(1, order + 1)}, {k: Counter() for k in range(1, order + 1)}
    for split, _, tokens in rows:
        if split == "train":
            for h, x in grams(tokens):
                for k in range(1, order + 1):
                    c = h[len(h) - k + 1:] if k > 1 else ()
                    if None not in c:
                        counts[k][c, x] += 1
                        totals[k][c] += 1

    def levels(h, x, w):
        p = [1 / n_ids]
        for k in range(1, order + 1):
            c = h[len(h) - k + 1:] if k > 1 else ()
            p.append(w[k] * counts[k][c, x] / totals[k][c] + (1 - w[k]) * p[-1] if totals[k][c] else p[-1])
        return p

    w = {k: 0.5 for k in range(1, order + 1)}
    for _ in range(rounds):
        own, reached = Counter(), Counter()
        for split, _, tokens in rows:
            if split == "val":
                for h, x in grams(tokens):
                    p, left = levels(h, x, w), 1.0
                    for k in range(order, 0, -1):
                        c = h[len(h) - k + 1:] if k > 1 else ()
                        if totals[k][c]:
                            share = w[k] * counts[k][c, x] / totals[k][c] / p[k]
                            own[k] += left * share
                            reached[k] += left
                            left *= 1 - share
        w = {k: own[k] / reached[k] if reached[k] else w[k] for k in w}
    losses = {(s, b): sum(-math.log(levels(h, x, w)[-1]) for h, x in grams(t)) / (len(t) - 1) for s, b, t in rows if s != "train"}
    return w, losses


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_interpolation_against_a_loop(spark, order):
    P = Params(vocab_size=9)
    rows, blocks = _blocks(spark, 60, size=12, ids=8, seed=order, splits=("train", "train", "val", "test"))
    w, losses = _brute(rows, order, P.n_ids, 5)
    weights, per_block = evaluate_ngrams(blocks, P, order)
    assert weights == pytest.approx(w)
    assert {(r.split, r.block_id): r.loss for r in per_block.collect()} == pytest.approx(losses)


def test_trigram_beats_the_bigram_on_val(spark):
    from tessera.plans import catalog
    from tests.conftest import SF001
    tri = {r.split: r.perplexity for r in catalog.QUERIES["trigram_perplexity"](spark, SF001).collect()}
    bi = {r.split: r.perplexity for r in catalog.QUERIES["perplexity"](spark, SF001).collect()}
    assert all(tri[s] < bi[s] for s in tri)


def test_contexts_do_not_cross_blocks_and_short_blocks_are_left_out(spark):
    blocks = spark.createDataFrame([("train", 0, [1, 2, 3]), ("train", 1, [4]), ("train", 2, []), ("train", 3, [5, 6])],
                                   "split string, block_id long, tokens array<int>")
    assert history(3) == ["h2", "h1"]
    got = [(r.block_id, r.h2, r.h1, r.next) for r in shift_ngrams(blocks, 3).collect()]
    assert sorted(got, key=str) == sorted([(0, None, 1, 2), (0, 1, 2, 3), (3, None, 5, 6)], key=str)
    assert fit_ngrams(blocks, 3).total == 3


def test_hot_context_join_reads_scans(spark):
    """Both sides of the n-gram join are exchanges AQE may split: the model is stored."""
    from tessera.operators.interpolated import relative_frequencies
    _, blocks = _blocks(spark, 30)
    model = fit_ngrams(blocks, 3)
    plan = relative_frequencies(blocks, model)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") >= 5
