"""O4 over the whole distribution, and L4 below the minimum length and after
contexts that training never saw."""

import numpy as np
import pytest

from tessera.config import Params
from tessera.operators.generate import _sample_one
from tessera.operators.ngram import next_token_table

P = Params(vocab_size=11, top_k=4)     # ids 0..11, eos 11


def _table(spark, rows, params, k=None):
    b = spark.createDataFrame(rows, "prev long, next long, c long")
    c = b.groupBy("prev").agg({"c": "sum"}).withColumnRenamed("sum(c)", "c_total")
    out = {}
    for r in next_token_table(b, c, params, k).orderBy("prev", "rank").collect():
        out.setdefault(r.prev, []).append((r.rank, r.next, r.prob))
    return out


@pytest.mark.parametrize("k", [1, 4, 12, 20])
def test_topk_equals_brute_force(spark, k):
    rng = np.random.default_rng(k)
    rows = {(int(a), int(b)): int(c) for a, b, c in zip(rng.integers(0, 12, 60), rng.integers(0, 12, 60), rng.integers(1, 4, 60))}
    got = _table(spark, [(a, b, c) for (a, b), c in rows.items()], P, k)
    for prev in {a for a, _ in rows}:
        weight = sorted(((rows.get((prev, i), 0) + P.alpha, i) for i in range(P.n_ids)), key=lambda x: (-x[0], x[1]))[:k]
        total = sum(w for w, _ in weight)
        assert [(r, n) for r, n, _ in got[prev]] == [(j + 1, i) for j, (_, i) in enumerate(weight)]
        assert np.allclose([p for _, _, p in got[prev]], [w / total for w, _ in weight])


def test_one_seen_continuation_keeps_its_share(spark):
    got = _table(spark, [(7, 9, 1)], Params(), 100)
    assert len(got[7]) == 100
    assert got[7][0] == (1, 9, pytest.approx(2 / 101))


def test_generation_reaches_the_minimum_length():
    only_eos = {1: (np.array([11, 0, 1, 2, 3]), np.array([0.5, 0.1, 0.1, 0.1, 0.1]))}
    for sample in range(20):
        seq = _sample_one([1], only_eos, 4, 12, 11, 6, 9, 42, "k", sample)
        assert 6 <= len(seq) <= 9 and 11 not in seq[:5]


def test_unseen_context_draws_from_the_lowest_ids():
    seqs = [_sample_one(p, {}, 4, 12, 11, 3, 8, 42, "k", s) for s in range(40) for p in ([5], [])]
    assert all(len(s) == 8 for s in seqs)
    assert {i for s in seqs for i in s[1:]} == {0, 1, 2, 3}
