"""Top-k sampling from the n-gram model.

Sampling is sequential per sample (each step needs the previous token), so it
runs inside tasks: prompts x samples are ordinary rows spread over the
cluster, and each task draws its samples step by step. The only shared state is
the table of best continuations, ``k + 1`` entries for each of the ``n_ids``
contexts at most, a bound fixed by the parameters (not by the data); it is
checked and sent once as a broadcast variable. Draws are reproducible: the
uniform number of a step is an md5 of ``(seed, key, sample, step)``.

Rules (per step): while the sequence (prompt included) is shorter than
``min_length`` eos is barred; the next id is then drawn from the k best ids
left, by their renormalised probabilities (hence ``k + 1`` in the table). After
a context that never occurred in training all ids are equally likely, so the k
best are the lowest ones; an empty prompt counts as such a context. The
sequence stops at eos or at ``max_length`` ids."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tessera.config import Params
from tessera.operators.ngram import next_token_table


def _uniform(seed: int, key, sample: int, step: int) -> float:
    h = hashlib.md5(f"{seed}|{key}|{sample}|{step}".encode()).hexdigest()[:13]
    return int(h, 16) / float(1 << 52)


def _candidates(entry, k: int, eos: int, barred: bool):
    """The k best ids of a table entry, eos left out if barred, and their
    cumulated weights."""
    nxt, pr = entry
    if barred:
        keep = nxt != eos
        nxt, pr = nxt[keep], pr[keep]
    return nxt[:k], np.cumsum(pr[:k])


def _sample_one(prompt, table, k, n_ids, eos, min_len, max_len, seed, key, sample, memo=None):
    """``memo`` keeps the cumulated weights of the contexts met so far."""
    memo = {} if memo is None else memo
    seq = [int(x) for x in prompt]
    step = 0
    while len(seq) < max_len:
        last, barred = (seq[-1] if seq else None), len(seq) < min_len
        if last not in table:
            last = None
        if (last, barred) not in memo:
            low = np.arange(min(k + 1, n_ids))
            memo[last, barred] = _candidates(table.get(last, (low, np.ones(len(low)))), k, eos, barred)
        nxt, cdf = memo[last, barred]
        u = _uniform(seed, key, sample, step) * cdf[-1]
        i = int(np.searchsorted(cdf, u, side="right"))
        tok = int(nxt[min(i, len(nxt) - 1)])
        seq.append(tok)
        step += 1
        if tok == eos:
            break
    return seq


def topk_arrays(bigrams: DataFrame, contexts: DataFrame, params: Params = Params()) -> dict:
    """The ``top_k + 1`` best continuations as ``{prev: (next ids, probs)}``, after
    a check that the table respects its bound of ``n_ids * (top_k + 1)`` entries."""
    t = next_token_table(bigrams, contexts, params, k=params.top_k + 1)
    g = t.groupBy("prev").agg(F.array_sort(F.collect_list(F.struct("rank", "next", "prob"))).alias("s"))
    g = g.select("prev", F.col("s.next").alias("nx"), F.col("s.prob").alias("pr"))
    out = {}
    for r in g.toLocalIterator():
        if len(r.nx) > params.top_k + 1 or len(out) >= params.n_ids:
            raise ValueError("top-k table exceeds its bound of n_ids * (top_k + 1) entries")
        out[int(r.prev)] = (np.array(r.nx, dtype=np.int64), np.array(r.pr, dtype=np.float64))
    return out


def generate(prompts: DataFrame, bigrams: DataFrame, contexts: DataFrame, params: Params = Params(),
             key: str = "key", ids_col: str = "prompt_ids", n_samples: int | None = None) -> DataFrame:
    """L4: ``n_samples`` continuations per prompt:
    ``(key, sample_no, prompt_len, ids, len, attention_mask)``."""
    ns = params.gen_samples if n_samples is None else n_samples
    spark = prompts.sparkSession
    bc = spark.sparkContext.broadcast(topk_arrays(bigrams, contexts, params))
    k_best, n_ids = params.top_k, params.n_ids
    eos, lo, hi, seed = params.eos_id, params.gen_min_length, params.gen_max_length, params.gen_seed
    rows = prompts.select(F.col(key).cast("string").alias("key"), F.col(ids_col).alias("prompt_ids"),
                          F.explode(F.sequence(F.lit(0), F.lit(ns - 1))).alias("sample_no"))

    def run(it):
        table, memo = bc.value, {}
        for pdf in it:
            out = [_sample_one(p, table, k_best, n_ids, eos, lo, hi, seed, k, s, memo)
                   for k, s, p in zip(pdf["key"], pdf["sample_no"], pdf["prompt_ids"])]
            yield pd.DataFrame({"key": pdf["key"], "sample_no": pdf["sample_no"],
                                "prompt_len": [len(p) for p in pdf["prompt_ids"]], "ids": out})
    res = rows.mapInPandas(run, "key string, sample_no int, prompt_len int, ids array<bigint>")
    from tessera.functions.text import attention_mask
    return res.withColumn("len", F.size("ids")).withColumn("attention_mask", attention_mask("ids"))
