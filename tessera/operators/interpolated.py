"""L1, L2 for longer contexts: an interpolated n-gram model over packed blocks.

The probability of a token after a context is recursive: the context's own
relative frequency, weighted, and the rest from the context one token shorter,
down to the uniform distribution; a context that training never saw leaves all
to the shorter one. One weight per length, chosen on held-out blocks by
expectation maximisation: every round is one aggregate over the held-out rows,
whose relative frequencies are looked up once and stored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tessera.config import Params
from tessera.operators.ngram import counted_ngrams
from tessera.session import stored

ROUNDS = 5   # of expectation maximisation


def history(order: int) -> list[str]:
    """Columns of a context, the oldest token first: h2, h1 for order 3."""
    return [f"h{j}" for j in range(order - 1, 0, -1)]


def shift_ngrams(blocks: DataFrame, order: int, keys=("split", "block_id"), col: str = "tokens") -> DataFrame:
    """``(*keys, h.., next)`` for every position with a label; a context token
    before the block's begin is null."""
    n = F.size(col)
    past = [F.slice(F.concat(F.array_repeat(F.lit(None).cast("bigint"), j - 1), F.col(col).cast("array<bigint>")), F.lit(1), n - 1).alias(f"h{j}")
            for j in range(1, order)]
    z = F.arrays_zip(*past, F.slice(F.col(col).cast("array<bigint>"), F.lit(2), n - 1).alias("next"))
    return (blocks.where(n >= 2).select(*keys, F.explode(z).alias("x"))
            .select(*keys, *[F.col(f"x.{h}").alias(h) for h in history(order)], F.col("x.next").alias("next")))


@dataclass
class NgramModel:
    order: int
    grams: dict[int, DataFrame]      # length -> (h.., next, c), stored
    contexts: dict[int, DataFrame]   # length from 2 -> (h.., c_total), stored
    total: int                    # tokens with a label


def fit_ngrams(train_blocks: DataFrame, order: int = 3) -> NgramModel:
    """Counts of all n-grams up to ``order``, and their contexts' totals. The
    tables are stored: scoring reads them more than once, and joins that read a
    scan can be split where a key is hot. Only the longest are counted from the
    blocks; the next shorter ones are sums of those, and of the few at a block's
    begin whose context is short."""
    rows = counted_ngrams(train_blocks, [*history(order), "next"], "n")
    whole = stored(rows.groupBy(*history(order), "next").agg(F.sum("n").alias("c")), f"grams-{order}")
    grams, contexts = {}, {}
    for k in range(order, 0, -1):
        h = history(k)
        if k < order:
            whole = stored(whole.groupBy(*h, "next").agg(F.sum("c").alias("c")), f"grams-{k}")
        grams[k] = whole.where(F.col(h[0]).isNotNull()) if h else whole
        if h:
            contexts[k] = stored(grams[k].groupBy(*h).agg(F.sum("c").alias("c_total")), f"contexts-{k}")
    return NgramModel(order, grams, contexts, grams[1].agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])


def relative_frequencies(blocks: DataFrame, model: NgramModel) -> DataFrame:
    """``(split, block_id, m, f1, f2, ..)`` for the distinct n-grams of each
    block: their relative frequency after the last k - 1 tokens, null where
    that context is new. The single-token table has at most ``n_ids`` rows, the
    bound of its broadcast."""
    keys = history(model.order)
    rows = counted_ngrams(blocks, [*keys, "next"], "m", ("split", "block_id"))
    words = model.grams[1].select("next", (F.col("c") / F.lit(float(model.total))).alias("f1"))
    rows = rows.join(F.broadcast(words), "next", "left").withColumn("f1", F.coalesce("f1", F.lit(0.0)) if model.total else F.lit(None).cast("double"))
    for k in range(2, model.order + 1):
        h = history(k)
        # the contexts of one token are at most n_ids, the bound of their broadcast
        of = F.broadcast(model.contexts[k]) if k == 2 else model.contexts[k]
        rows = (rows.join(model.grams[k], [*h, "next"], "left").join(of, h, "left")
                .withColumn(f"f{k}", F.coalesce("c", F.lit(0)) / F.col("c_total")).drop("c", "c_total"))
    return rows.select("split", "block_id", "m", *[f"f{k}" for k in range(1, model.order + 1)])


def probabilities(weights: dict[int, float], n_ids: int) -> list[Column]:
    """The recursive probability at every length, from the uniform one up."""
    out = [F.lit(1.0 / n_ids)]
    for k in sorted(weights):
        f, w = F.col(f"f{k}"), weights[k]
        out.append(F.when(f.isNull(), out[-1]).otherwise(w * f + (1 - w) * out[-1]))
    return out


def held_out_weights(frequencies: DataFrame, order: int, n_ids: int, rounds: int = ROUNDS) -> dict[int, float]:
    """Weights of lengths 1 to ``order`` for held-out rows: in each round, of
    the tokens that reach a length, the share that it explains itself."""
    weights = {k: 0.5 for k in range(1, order + 1)}
    for _ in range(rounds):
        p = probabilities(weights, n_ids)
        reach, sums = F.col("m").cast("double"), []
        for k in range(order, 0, -1):
            f, w = F.col(f"f{k}"), weights[k]
            sums += [F.sum(F.when(f.isNotNull(), reach * (w * f / p[k]))).alias(f"own{k}"), F.sum(F.when(f.isNotNull(), reach)).alias(f"all{k}")]
            reach = F.when(f.isNull(), reach).otherwise(reach * ((1 - w) * p[k - 1] / p[k]))
        row = frequencies.agg(*sums).first()
        weights = {k: row[f"own{k}"] / row[f"all{k}"] if row[f"all{k}"] else weights[k] for k in weights}
    return weights


def score_ngrams(frequencies: DataFrame, weights: dict[int, float], n_ids: int) -> DataFrame:
    """L2 per block: ``(split, block_id, nll_sum, n_pred, loss)``."""
    nll = -F.log(probabilities(weights, n_ids)[-1])
    return (frequencies.groupBy("split", "block_id").agg(F.sum(F.col("m") * nll).alias("nll_sum"), F.sum("m").cast("bigint").alias("n_pred"))
            .withColumn("loss", F.col("nll_sum") / F.col("n_pred")))


def evaluate_ngrams(blocks: DataFrame, params: Params = Params(), order: int = 3, train_split: str = "train", held_out: str = "val",
                    eval_splits=("val", "test")) -> tuple[dict[int, float], DataFrame]:
    """Fit on ``train_split``, choose the weights on ``held_out``, score
    ``eval_splits``: ``(weights, per block)``."""
    model = fit_ngrams(blocks.where(F.col("split") == train_split), order)
    wanted = sorted({held_out, *eval_splits})
    f = stored(relative_frequencies(blocks.where(F.col("split").isin(*wanted)), model), "frequencies")
    weights = held_out_weights(f.where(F.col("split") == held_out), order, params.n_ids)
    return weights, score_ngrams(f.where(F.col("split").isin(*eval_splits)), weights, params.n_ids)
