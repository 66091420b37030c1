import math

from pyspark.sql import functions as F

from tessera.config import Params
from tessera.operators.batching import epoch_plan, eval_batches, sample_positions
from tessera.operators.evaluation import batch_losses, running_best, split_summary
from tessera.operators.ngram import fit_bigram, next_token_table, score_blocks
from tessera.plans import corpus

P = Params()


def test_topk_table_sums_to_one(spark, docs):
    prep = corpus.prepare(docs, P)
    bigrams, contexts = fit_bigram(prep.blocks.where("split = 'train'"))
    t = next_token_table(bigrams, contexts, P, k=5)
    sums = t.groupBy("prev").agg(F.sum("prob").alias("s"), F.max("rank").alias("mx")).collect()
    assert sums and all(abs(r.s - 1.0) < 1e-9 and r.mx <= 5 for r in sums)


def test_mean_of_means_equals_token_mean_when_full(spark):
    blocks = spark.createDataFrame([("val", i, [1, 2, 1, 3]) for i in range(8)] +
                                   [("train", i, [1, 2, 1, 2]) for i in range(4)],
                                   "split string, block_id long, tokens array<long>")
    bigrams, contexts = fit_bigram(blocks.where("split = 'train'"))
    pb = score_blocks(blocks.where("split = 'val'"), bigrams, contexts, P)
    s = split_summary(batch_losses(pb, 4)).first()
    assert abs(s.loss - s.token_loss) < 1e-12 and s.n_batches == 2
    assert abs(s.perplexity - math.exp(s.loss)) < 1e-9
    # by hand: train pairs c(1,2) = 8, c(2,1) = 4, so C(1) = 8, C(2) = 4;
    # p(2|1) = 9/(8+V), p(1|2) = 5/(4+V), p(3|1) = 1/(8+V)
    V = P.n_ids
    exp = -(math.log(9 / (8 + V)) + math.log(5 / (4 + V)) + math.log(1 / (8 + V))) / 3
    assert abs(s.loss - exp) < 1e-12


def test_epoch_plan_is_a_permutation(spark, docs):
    prep = corpus.prepare(docs, P)
    n = prep.blocks.where("split = 'train'").count()
    plan = epoch_plan(prep.blocks, P, epochs=3)
    per = plan.groupBy("epoch").agg(F.count(F.lit(1)).alias("c"), F.countDistinct("block_id").alias("d"),
                                   F.max("rn").alias("mx")).collect()
    full = (n // P.batch_size) * P.batch_size
    assert len(per) == 3 and all(r.c == full and r.d == full for r in per)
    orders = [[r.block_id for r in plan.where(f"epoch = {e}").orderBy("rn").collect()] for e in range(2)]
    assert orders[0] != orders[1]


def test_eval_batches_keep_short_last(spark):
    blocks = spark.createDataFrame([("val", i, [1]) for i in range(10)], "split string, block_id long, tokens array<long>")
    b = eval_batches(blocks, 8).groupBy("batch_id").count().orderBy("batch_id").collect()
    assert [r["count"] for r in b] == [8, 2]


def test_running_best(spark):
    m = spark.createDataFrame([(0, 0, 5.0), (0, 1, 6.0), (0, 2, 4.0), (0, 3, 4.0)], "run int, epoch int, perplexity double")
    got = [r.improved for r in running_best(m).orderBy("epoch").collect()]
    assert got == [True, False, True, False]


def test_sample_positions_with_replacement(spark, docs):
    prep = corpus.prepare(docs, P)
    s = sample_positions(prep.tokens, prep.totals, 1000, 1, "train")
    assert s.count() == 1000
    n = {r.split: r.n_total for r in prep.totals.collect()}["train"]
    assert s.agg(F.max("pos")).first()[0] < n
