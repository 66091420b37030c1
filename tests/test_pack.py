import pytest
from pyspark.sql import Window, functions as F

from tessera.config import Params
from tessera.operators.pack import (exclusive_prefix_sum, overflow_chunks, full_length_only, pack_blocks,
                                    shift_pairs)
from tessera.plans import corpus

B = 4


def _stream(spark, n):
    toks = spark.createDataFrame([("train", i, i % 7) for i in range(n)], "split string, pos long, token_id int")
    totals = spark.createDataFrame([("train", n)], "split string, n_total long")
    return toks, totals


@pytest.mark.parametrize("n,expected", [(B - 1, 0), (B, 0), (B + 1, 1), (2 * B, 1), (2 * B + 1, 2), (3 * B, 2)])
def test_reference_drop_rule(spark, n, expected):
    toks, totals = _stream(spark, n)
    blocks = pack_blocks(toks, totals, Params(block_size=B))
    assert blocks.count() == expected
    for r in blocks.collect():
        assert list(r.tokens) == [(r.block_id * B + k) % 7 for k in range(B)]


@pytest.mark.parametrize("n,expected", [(B - 1, 0), (B, 1), (2 * B + 1, 2), (3 * B, 3)])
def test_full_drop_rule(spark, n, expected):
    toks, totals = _stream(spark, n)
    assert pack_blocks(toks, totals, Params(block_size=B, drop_rule="full")).count() == expected


def test_shift_pairs_stay_in_block(spark):
    df = spark.createDataFrame([("s", 0, [1, 2, 3]), ("s", 1, [4]), ("s", 2, [])],
                               "split string, block_id long, tokens array<long>")
    got = sorted((r.block_id, r.t, r.prev, r.next) for r in shift_pairs(df).collect())
    assert got == [(0, 0, 1, 2), (0, 1, 2, 3)]


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_two_level_prefix_equals_naive_window(spark, parts):
    rows = [("a" if i % 3 else "b", i // 5, i % 5, (i * 7919) % 11) for i in range(400)]
    df = spark.createDataFrame(rows, "split string, doc_id long, line_no int, len int").repartition(parts)
    seg = (F.col("doc_id") / 6).cast("bigint")
    got, totals = exclusive_prefix_sum(df.withColumn("_seg", seg), "len", ["split"], ["doc_id", "line_no"], "_seg")
    w = Window.partitionBy("split").orderBy("doc_id", "line_no").rowsBetween(Window.unboundedPreceding, -1)
    naive = df.withColumn("start", F.coalesce(F.sum("len").over(w), F.lit(0)))
    a = sorted((r.split, r.doc_id, r.line_no, r.start) for r in got.collect())
    b = sorted((r.split, r.doc_id, r.line_no, r.start) for r in naive.collect())
    assert a == b
    tot = {r.split: r.n_total for r in totals.collect()}
    assert tot == {s: sum(x[3] for x in rows if x[0] == s) for s in ("a", "b")}


def test_offsets_sum_invariant(spark, docs):
    prep = corpus.prepare(docs, Params())
    last = prep.offsets.groupBy("split").agg(F.max(F.col("line_start") + F.col("len")).alias("end"))
    tot = {r.split: r.n_total for r in prep.totals.collect()}
    assert {r.split: r.end for r in last.collect()} == tot


def test_overflow_chunks(spark):
    df = spark.createDataFrame([(0, list(range(10))), (1, [])], "k int, ids array<int>")
    ch = overflow_chunks(df, "ids", 4, ["k"])
    got = sorted((r.k, r.chunk_no, list(r.input_ids)) for r in ch.collect())
    assert got == [(0, 0, [0, 1, 2, 3]), (0, 1, [4, 5, 6, 7]), (0, 2, [8, 9])]
    assert full_length_only(ch, 4).count() == 2


def test_drop_rule_formula_many_sizes(spark):
    """W2 reference rule: max(0, ceil(N/B) - 1) blocks, for many (N, B)."""
    from tessera.operators.pack import keep_block
    cases = [(n, b) for b in (1, 2, 3, 4, 7, 16) for n in range(0, 40)]
    df = spark.createDataFrame(cases, "n long, b long")
    got = (df.select("n", "b", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)))).alias("k"))
           .where(F.col("k") * F.col("b") < F.col("n"))
           .where(keep_block(F.col("k"), F.col("n"), F.col("b"), "reference"))
           .groupBy("n", "b").count().collect())
    counts = {(r.n, r.b): r["count"] for r in got}
    for n, b in cases:
        assert counts.get((n, b), 0) == max(0, -(-n // b) - 1), (n, b)
