"""Shuffled epochs, batch numbering, subsets.

Row numbers over a whole split never come from one global window: the order
key is an md5 value, so its top bits cut the rows into evenly filled
segments, and the two-level prefix sum of :mod:`tessera.operators.pack`
numbers rows inside each segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.config import Params
from tessera.functions.hashing import md5_int
from tessera.operators.pack import exclusive_prefix_sum

SHUFFLE_DIGITS = 15         # 60-bit md5 prefix: keys and draws reach any stream length
SEGMENT_BITS = 12           # top 12 bits of the key pick one of 4096 segments


def shuffle_key(seed: int, epoch, key) -> "F.Column":
    """O1: the permutation key of ``key`` in ``epoch`` (ties broken by ``key``)."""
    return md5_int(F.lit(seed), epoch, key, digits=SHUFFLE_DIGITS)


def number_rows(df: DataFrame, part_cols, order_cols, seg_col: str) -> tuple[DataFrame, DataFrame]:
    """0-based ``rn`` per ``part_cols`` in ``order_cols`` order, segmented by
    ``seg_col`` (which must be monotone in the order). Returns totals too."""
    x = df.withColumn("_one", F.lit(1))
    res, totals = exclusive_prefix_sum(x, "_one", part_cols, order_cols, seg_col, out="rn")
    return res.drop("_one"), totals


def assign_batches(numbered: DataFrame, totals: DataFrame, part_cols, batch_size: int,
                   drop_last: bool) -> DataFrame:
    """W4 + O2: ``batch_id = rn div batch``, ``row_in_batch = rn mod batch``;
    with ``drop_last`` the trailing short batch is removed (totals hold one row
    per partition key, a bounded broadcast)."""
    out = (numbered.withColumn("batch_id", F.floor(F.col("rn") / batch_size).cast("bigint"))
           .withColumn("row_in_batch", (F.col("rn") % batch_size).cast("int")))
    if drop_last:
        out = (out.join(F.broadcast(totals), list(part_cols))
               .where((F.col("batch_id") + 1) * batch_size <= F.col("n_total")).drop("n_total"))
    return out


def epoch_plan(blocks: DataFrame, params: Params = Params(), epochs: int | None = None,
               split: str = "train") -> DataFrame:
    """T5: for every epoch, a reproducible shuffle of the ``split`` blocks cut
    into full batches (``drop_last``): ``(epoch, block_id, rn, batch_id,
    row_in_batch, step, is_update, is_log)``. ``step`` is 1-based;
    an optimizer update happens every ``grad_accum_steps`` steps (P6) and a log
    line every ``log_every`` steps."""
    E = params.epochs if epochs is None else epochs
    b = blocks.where(F.col("split") == split).select("block_id")
    x = (b.select("block_id", F.explode(F.sequence(F.lit(0), F.lit(E - 1))).alias("epoch"))
         .withColumn("h", shuffle_key(params.seed, F.col("epoch"), F.col("block_id")))
         .withColumn("_seg", F.shiftright("h", SHUFFLE_DIGITS * 4 - SEGMENT_BITS)))
    numbered, totals = number_rows(x, ["epoch"], ["h", "block_id"], "_seg")
    plan = assign_batches(numbered, totals, ["epoch"], params.batch_size, drop_last=True)
    step = F.col("batch_id") + 1
    return plan.select("epoch", "block_id", "rn", "batch_id", "row_in_batch",
                       step.cast("bigint").alias("step"),
                       (step % params.grad_accum_steps == 0).alias("is_update"),
                       (step % params.log_every == 0).alias("is_log"))


def eval_batches(blocks: DataFrame, batch_size: int, splits=("val",)) -> DataFrame:
    """W4 in evaluation order (no shuffle, last short batch kept): blocks are
    numbered 0..n-1 per split already, so the batch is arithmetic."""
    return (blocks.where(F.col("split").isin(*splits))
            .select("split", "block_id",
                    F.floor(F.col("block_id") / batch_size).cast("bigint").alias("batch_id"),
                    (F.col("block_id") % batch_size).cast("int").alias("row_in_batch")))


def updates_per_epoch(plan: DataFrame, grad_accum_steps: int) -> DataFrame:
    """``len(dataloader) // accumulation`` per epoch."""
    return (plan.groupBy("epoch").agg(F.countDistinct("batch_id").cast("bigint").alias("n_batches"))
            .withColumn("n_updates", F.floor(F.col("n_batches") / grad_accum_steps).cast("bigint")))


def sample_positions(tokens: DataFrame, totals: DataFrame, subset_size: int, seed: int,
                     split: str) -> DataFrame:
    """``subset_size`` positions drawn with replacement, ``idx_i = md5(seed,
    i) mod N``, and the token at each. The sample has ``subset_size`` rows, the
    bound that licenses its broadcast; the token table is not shuffled."""
    spark = tokens.sparkSession
    draws = (spark.range(subset_size).select(F.col("id").alias("draw"), F.lit(split).alias("split"))
             .join(F.broadcast(totals), "split")  # one row per split
             .select("draw", (md5_int(F.lit(seed), F.col("draw"), digits=SHUFFLE_DIGITS) % F.col("n_total")).alias("pos")))
    t = tokens.where(F.col("split") == split).select("pos", "token_id")
    return t.join(F.broadcast(draws), "pos").select("draw", "pos", "token_id")
