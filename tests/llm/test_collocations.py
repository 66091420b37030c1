"""Operator 13 against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_operators import ROWS, SCHEMA

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _brute(rows, least, top=2000, percent=100, depth=5):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, depth + 1):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    often = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = []
    for (lang, g), a in often.items():
        inside = any(l == lang and len(h) > len(g) and 100 * b >= percent * a and any(h[i:i + len(g)] == g for i in range(len(h) - len(g) + 1))
                     for (l, h), b in often.items())
        if not inside:
            cuts = [(1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g))]
            s, _, l, r = min(cuts)
            out.append((lang, -s, -a, " ".join(g).encode(), l, r, n[lang]))
    got = []
    for lang in {x[0] for x in out}:
        for i, (_, s, a, p, l, r, m) in enumerate(sorted(x for x in out if x[0] == lang)[:top], 1):
            got.append((lang, i, p.decode(), -a, l, r, m, -s))
    return sorted(got)


def _rows(seed, n=120):
    rng = random.Random(seed)
    words = ["a", "B", "c", "é", "Ä", "x-y", "a", "a", "the", "of"]
    out = []
    for _ in range(n):
        t = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "", "! "]) for _ in range(rng.randint(0, 60)))
        out.append((rng.choice(["en", "en", "de", None, "x\ty"]), t + rng.choice(["", " the end of all things", " the end of it"])))
    return out


@pytest.mark.parametrize("shard_words", [1, 150, 10 ** 6])
def test_phrases_against_plain_counting(spark, shard_words):
    from tessera.llm.collocations import collocations
    rows = _rows(1)
    df = spark.createDataFrame([(t, l, i) for i, (l, t) in enumerate(rows)], "text string, lang string, a int").repartition(3)
    got = collocations(df, least=6, shard_words=shard_words).collect()
    assert sorted(tuple(r) for r in got) == _brute(rows, 6)
    assert got[0].asDict().keys() == {"lang", "rank", "phrase", "a", "l", "r", "n", "score"}


def test_top_depth_and_cover(spark):
    from tessera.llm.collocations import collocations
    rows = _rows(2, 60)
    df = spark.createDataFrame(rows, "lang string, text string")
    got = collocations(df, least=4, top=5, percent=60, depth=3).collect()
    assert sorted(tuple(r) for r in got) == _brute(rows, 4, 5, 60, 3)


def test_index_counts_every_phrase():
    from tessera.llm.collocations import FmIndex, bwt_of
    rng = np.random.default_rng(3)
    for n_words in (1, 2, 5, 40):
        seq = np.concatenate([np.append(rng.integers(0, n_words + 1, rng.integers(0, 50)), 0) for _ in range(20)]).astype(np.int32)
        fm = FmIndex(bwt_of(seq), n_words)
        for level in range(1, 6):
            want = Counter(t for i in range(len(seq) - level + 1) if all(t := tuple(seq[i:i + level].tolist())))
            got = {w: int(c) for w, c in zip(zip(*(p.tolist() for p in fm.phrases())), fm.size) if c}
            assert got == want
            fm.extend(np.ones(len(fm.lo), bool))


def test_products_past_64_bits(spark):
    from pyspark.sql import functions as F
    from tessera.llm.collocations import _cut
    rng = random.Random(4)
    rows = []
    for _ in range(500):
        heads = sorted((rng.randrange(100, 10 ** rng.randint(3, 13)) for _ in range(4)), reverse=True)
        tails = sorted((rng.randrange(100, 10 ** rng.randint(3, 13)) for _ in range(3)), reverse=True) + heads[-1:]
        rows.append((heads[-1], rng.randrange(10 ** 6, 10 ** 15), heads, tails))
    df = spark.createDataFrame(rows, "a long, n long, heads array<long>, tails array<long>")
    for r in df.withColumn("c", _cut(F.col("a"), F.col("n"), F.col("heads"), F.col("tails"), 4)).collect():
        want = min((1000 * r["a"] * r["n"] // (r["heads"][k - 1] * r["tails"][3 - k]), k) for k in (1, 2, 3))
        assert (r["c"]["score"], r["c"]["k"]) == want


def test_odd_rows(spark):
    from tessera.llm.collocations import collocations
    odd = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 AS w1", "'x' AS phrase", "2 AS rank", "3 AS words")
    rows = collocations(odd, least=2).collect()
    assert sorted(tuple(r) for r in rows) == _brute([(r[2], r[1]) for r in ROWS], 2)
    assert any(r["lang"] == "en" and r["phrase"] == "alpha beta gamma delta epsilon" for r in rows)
    assert collocations(odd.limit(0)).collect() == []
    assert collocations(odd.where("text = ''")).collect() == []


def test_a_hash_that_two_words_share(spark, monkeypatch):
    """Under a seed where words clash, another seed is taken."""
    from tessera.llm import collocations as m
    real = m.word_hashes

    def clashing(words, seed):
        return real(words, seed) if seed else np.zeros(len(words), np.uint64)

    def count(seed):
        def run(batches):
            import pyarrow as pa
            for words, bwt in m._stored(batches):
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(clashing(words, seed).view(np.int64)),
                                                  pa.array(np.bincount(bwt, minlength=len(words) + 1)[1:])], names=["word", "w1", "c"])
        return run

    monkeypatch.setattr(m, "_count_words", count)
    df = spark.createDataFrame([("en", "p q " * 30 + "r s " * 30)], "lang string, text string")
    got = m.collocations(df, least=10)
    assert sorted(tuple(r) for r in got.collect()) == _brute([("en", "p q " * 30 + "r s " * 30)], 10)


@pytest.mark.parametrize("least", [2, 4, 300])
def test_tasks_send_only_phrases_that_may_be_frequent(spark, least):
    """Two frequent pairs with a word in common make rare triples; these are no
    rows, frequent ones are one row a task with the whole count of its shards."""
    from tessera.llm import collocations as m
    texts = [f"a b x{i % 7}" for i in range(300)] + [f"y{i % 7} b x{(i * 3 + i // 7) % 7}" for i in range(300)] + ["a b c"] * 300
    df = spark.createDataFrame([("en", t) for t in texts], "lang string, text string").repartition(2)
    index = m.store(df.mapInArrow(m._index_texts(60), m.INDEX), "index")
    words, seed = m._frequent_words(index, 1)
    every = m._bitmap(words, 1, words.count())
    pairs = m.store(index.mapInArrow(m._count_phrases(2, seed, [every]), "w1 long, w2 long, c long").groupBy("w1", "w2").agg({"c": "sum"}), "pairs")
    bitmaps = [every, m._bitmap(pairs, 2, pairs.count())]
    sketch = m._sketch(index, seed, bitmaps, 900, least)
    stored = index.select("words", "bwt").repartition(2)
    got = stored.mapInArrow(m._count_phrases(3, seed, bitmaps, sketch), "w1 long, w2 long, w3 long, c long").collect()
    count = Counter(texts)
    often = [a for a in count.values() if a >= least]
    assert Counter(sorted(sum(r["c"] for r in got if r[:3] == k) for k in {r[:3] for r in got})) == Counter(often)
    assert len(got) <= 2 * len(often)


def test_full_and_tight_buckets_give_the_same_phrases(spark, monkeypatch):
    """However few buckets there are, and whatever a task holds, no phrase is lost."""
    from tessera.llm import collocations as m
    rows = _rows(6, 60)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    want = _brute(rows, 5)
    for buckets, held in ((8, 1), (1 << 20, 10 ** 6)):
        monkeypatch.setattr(m, "MAX_BUCKETS", buckets)
        monkeypatch.setattr(m, "HELD", held)
        assert sorted(tuple(r) for r in m.collocations(df, least=5, shard_words=100).collect()) == want
