"""E3 as a run: evaluate an untrained baseline, then each smoothing value in
order; log every evaluation (S8), keep the last model and, on a strict
improvement only, the best one (S9, W5). The loop runs over a handful of
settings on the driver; every evaluation inside it is a Spark job over the pairs
of the evaluation blocks, which are looked up in the model once and stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.config import Params
from tessera.operators.evaluation import batch_losses, split_summary
from tessera.operators.ngram import contexts_of, fit_bigram, pair_lookups, score_lookups
from tessera.session import stored
from tessera.sources.store import log_metrics, save_if_improved


def select_alpha(blocks: DataFrame, alphas, out_dir: str, params: Params = Params(),
                 train_split: str = "train", eval_split: str = "val", run: str = "run0") -> float | None:
    """The least perplexity; models under ``out_dir`` (pointers last and best),
    the metric log beside them."""
    spark = blocks.sparkSession
    bigrams = stored(fit_bigram(blocks.where(F.col("split") == train_split))[0], "bigrams")
    contexts = stored(contexts_of(bigrams), "contexts")
    best = float(params.n_ids)  # the untrained (uniform) model's perplexity seeds the running best
    ev = stored(pair_lookups(blocks.where(F.col("split") == eval_split), bigrams, contexts)
                .select("split", "block_id", "m", "c", "c_total"), "lookups")
    for epoch, alpha in enumerate(alphas):
        s = split_summary(batch_losses(score_lookups(ev, params, alpha),
                                       params.eval_batch_size)).first()
        row = {"run": run, "epoch": epoch, "alpha": float(alpha), "split": eval_split,
               "loss": float(s.loss), "perplexity": float(s.perplexity)}
        log_metrics(spark.createDataFrame([row]), f"{out_dir}/metrics")
        settings = spark.createDataFrame([(float(alpha), epoch)], "alpha double, epoch int")
        best = save_if_improved({"bigrams": bigrams, "contexts": contexts, "settings": settings}, row["perplexity"], best, out_dir)
    return best
