"""The cut by histograms equals a full sort, ties by name included."""

import random

import pytest

from tessera.config import Params
from tessera.operators.vocab import frequency_cut, word_vocab


@pytest.mark.parametrize("k", [0, 1, 7, 40, 199, 200, 500])
def test_cut_equals_a_full_sort(spark, k):
    rng = random.Random(k)
    rows = [(f"w{i:03d}", rng.choice([1, 2, 2, 2, 3, 3, 5, 8, 9, 1000, 2 ** 40])) for i in range(200)]
    counts = spark.createDataFrame(rows, "word string, n long").repartition(5)
    P = Params(vocab_size=5 + k, min_frequency=2)
    want = [w for w, n in sorted(rows, key=lambda r: (-r[1], r[0])) if n >= 2][:k]
    got = {r.token_id: r.token for r in word_vocab(counts, P).collect()}
    assert [got[i] for i in range(5, 5 + len(want))] == want and len(got) == 5 + len(want)
    c, m = frequency_cut(counts, k)
    assert sum(n > c for _, n in rows) + m == min(k, 200)


def test_no_words_at_all(spark):
    empty = spark.createDataFrame([], "word string, n long")
    assert word_vocab(empty, Params()).count() == 5
