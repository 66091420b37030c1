"""Prompt dataset and reward scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.config import Params, UNK_ID
from tessera.functions.hashing import random_length
from tessera.functions.text import char_length, pretokenize
from tessera.operators.encode import vocab_lookup


def reviews(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """P2 + P3: ``text`` renamed to ``review``; only reviews longer than
    ``review_min_chars`` characters (strict) remain. The predicate is a plain
    column expression, so it sits next to the scan."""
    return (docs.withColumnRenamed("text", "review")
            .where(char_length("review") > params.review_min_chars))


def build_prompts(docs: DataFrame, vocab: DataFrame, params: Params = Params(), key: str = "doc_id") -> DataFrame:
    """Per review, a reproducible prefix length in ``[min, max)`` (F6), the
    first ids of the encoded review (O5; whole review encoded, no eos) and their
    decoded text ``query`` (J2). Output ``(key, n_chars, input_size, input_ids,
    query)``. The lookup joins only the kept prefix tokens."""
    r = reviews(docs, params).select(
        key, char_length("review").alias("n_chars"),
        random_length(F.col(key), params.gen_seed, params.prompt_min_len, params.prompt_max_len)
        .cast("int").alias("input_size"),
        pretokenize("review").alias("words"))
    ex = r.select(key, "n_chars", "input_size",
                  F.posexplode(F.slice("words", F.lit(1), F.col("input_size"))).alias("i", "word"))
    j = ex.join(vocab_lookup(vocab), "word", "left")
    vid = F.coalesce(F.col("vid"), F.lit(UNK_ID)).cast("int")
    tok = F.when(F.col("vid").isNull(), F.lit(params.special_tokens[UNK_ID])).otherwise(F.col("word"))
    g = j.groupBy(key, "n_chars", "input_size").agg(
        F.array_sort(F.collect_list(F.struct("i", vid.alias("id"), tok.alias("t")))).alias("_s"))
    return g.select(key, "n_chars", "input_size",
                    F.col("_s.id").alias("input_ids"),
                    F.array_join(F.col("_s.t"), "").alias("query"))


def attach_rewards(responses: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """J4 + R2: raw (unnormalised) class scores per response and a reward:
    ``quality - toxic``; unlabeled responses keep null scores. ``labels`` has one
    row per key, so the join cannot multiply rows."""
    lab = labels.select(key, F.col("quality").alias("score_quality"), F.col("toxic").alias("score_toxic"))
    return (responses.join(lab, key, "left")
            .withColumn("reward", (F.col("score_quality") - F.col("score_toxic")).cast("double")))
