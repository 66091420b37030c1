"""The registered queries (Spark side) and their DuckDB twins (oracle side).

Every query reads the given tables in full. Array results are rendered as
space-joined strings (``ids_text``) so both engines hash them identically;
doubles are rounded to 6 places on both sides."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.config import Params
from tessera.plans import corpus
from tessera.plans.oracles import with_ctes
from tessera.session import cut_lineage, ensure_checkpoint_dir, read_table, table_path

P =Params()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def _r(c, n: int = 6):
    return F.round(c, n)


def _prep(spark: SparkSession, sf_dir: str) -> corpus.Prepared:
    return corpus.prepare(read_table(spark, sf_dir, "documents"), P)


# ---------------------------------------------------------------- minimum slice
@register("lines_per_split", with_ctes(
    "SELECT split, count(*)::BIGINT AS n_rows, count(DISTINCT doc_id)::BIGINT AS n_docs FROM lines GROUP BY split",
    ["lines"]))
def q_lines_per_split(spark, sf_dir):
    """S1 + U1/U2 + A2: line rows and documents per split."""
    from tessera.sources.corpus import document_lines
    lines = document_lines(read_table(spark, sf_dir, "documents"))
    return lines.groupBy("split").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                                      F.countDistinct("doc_id").cast("bigint").alias("n_docs"))


@register("word_counts", with_ctes("SELECT word, n FROM wc", ["wc"]))
def q_word_counts(spark, sf_dir):
    """F4 + A3: pre-token counts over the train split (from the stored
    pre-tokenized lines: the regex ran once)."""
    from tessera.operators.vocab import word_counts_of_words
    return word_counts_of_words(_prep(spark, sf_dir).words.where(F.col("split") == "train"))


@register("word_vocab", with_ctes("SELECT token_id, token FROM vocab", ["vocab"]))
def q_word_vocab(spark, sf_dir):
    """T3 + A5: frequency-ranked word vocabulary with the five specials first."""
    return _prep(spark, sf_dir).vocab


@register("vocab_size", with_ctes("SELECT count(*)::BIGINT AS vocab_size FROM vocab", ["vocab"]))
def q_vocab_size(spark, sf_dir):
    """A15."""
    from tessera.operators.vocab import vocab_size
    return vocab_size(_prep(spark, sf_dir).vocab)


@register("tokenized_lines", with_ctes(
    "SELECT split, doc_id, line_no, array_to_string(list(token_id ORDER BY i), ' ') AS ids_text, "
    "count(*)::INT AS len FROM tokens GROUP BY split, doc_id, line_no", ["tokens"]))
def q_tokenized_lines(spark, sf_dir):
    """J1 + O5 + F3 + F2 + P1: ids per line (truncated, eos appended), text dropped."""
    rows = _prep(spark, sf_dir).line_ids
    return rows.select("split", "doc_id", "line_no", F.array_join("ids", " ").alias("ids_text"), "len")


@register("line_offsets", with_ctes(
    "SELECT split, doc_id, line_no, len, line_start FROM offs", ["offs"]))
def q_line_offsets(spark, sf_dir):
    """Start offset of every line in its split's token stream (two-level prefix sum)."""
    return _prep(spark, sf_dir).offsets.select("split", "doc_id", "line_no", "len", "line_start")


@register("split_tokens", with_ctes("SELECT split, n_total AS n_tokens FROM totals", ["totals"]))
def q_split_tokens(spark, sf_dir):
    """A1: total tokens per split."""
    return _prep(spark, sf_dir).totals.select("split", F.col("n_total").alias("n_tokens"))


@register("packed_blocks", with_ctes(
    "SELECT split, block_id, len(tokens)::INT AS n, array_to_string(tokens, ' ') AS ids_text FROM blocks",
    ["blocks"]))
def q_packed_blocks(spark, sf_dir):
    """T4 + W2 + P4: fixed-size blocks of the concatenated stream (reference drop rule)."""
    b = _prep(spark, sf_dir).blocks
    return b.select("split", "block_id", F.size("tokens").cast("int").alias("n"),
                    F.array_join("tokens", " ").alias("ids_text"))


@register("shifted_pairs", with_ctes(
    "SELECT split, block_id, t::INT AS t, prev::BIGINT AS prev, next::BIGINT AS next FROM pairs", ["pairs"]))
def q_shifted_pairs(spark, sf_dir):
    """(token t, token t+1) inside each block."""
    from tessera.operators.pack import shift_pairs
    return shift_pairs(_prep(spark, sf_dir).blocks).select(
        "split", "block_id", F.col("t").cast("int").alias("t"), "prev", "next")


@register("bigram_counts", with_ctes("SELECT prev::BIGINT AS prev, next::BIGINT AS next, c FROM bigrams",
                                     ["bigrams"]))
def q_bigram_counts(spark, sf_dir):
    """L1: bigram counts over the train blocks."""
    prep = _prep(spark, sf_dir)
    return corpus.evaluate(prep, P)["bigrams"]


@register("block_loss", with_ctes(
    "SELECT split, block_id, n_pred, round(loss, 6) AS loss FROM per_block", ["per_block"]))
def q_block_loss(spark, sf_dir):
    """L2 + A6 + J3: mean next-token loss of every evaluation block."""
    r = corpus.evaluate(_prep(spark, sf_dir), P)["per_block"]
    return r.select("split", "block_id", "n_pred", _r(F.col("loss")).alias("loss"))


@register("batch_loss", with_ctes(
    "SELECT split, batch_id::BIGINT AS batch_id, n_blocks, round(batch_loss, 6) AS batch_loss FROM per_batch",
    ["per_batch"]))
def q_batch_loss(spark, sf_dir):
    """A7 + W4 (evaluation order): mean over the blocks of each batch of 8."""
    r = corpus.evaluate(_prep(spark, sf_dir), P)["per_batch"]
    return r.select("split", "batch_id", "n_blocks", _r(F.col("batch_loss")).alias("batch_loss"))


@register("perplexity", with_ctes(
    "SELECT split, n_batches, n_blocks, round(loss, 6) AS loss, round(token_loss, 6) AS token_loss, "
    "round(perplexity, 4) AS perplexity FROM summary", ["summary"]))
def q_perplexity(spark, sf_dir):
    """Flagship (L2 + A8 + A9): loss as the mean of batch means, token mean
    beside it, and perplexity, for the val and test splits."""
    s = corpus.evaluate(_prep(spark, sf_dir), P)["summary"]
    return s.select("split", "n_batches", "n_blocks", _r(F.col("loss")).alias("loss"),
                    _r(F.col("token_loss")).alias("token_loss"), _r(F.col("perplexity"), 4).alias("perplexity"))


# ---------------------------------------------------------------- corpus files, flat stream
def _folder(spark, name: str) -> str:
    """A new folder of the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"


def _file_lines(spark, sf_dir):
    """The documents' lines as text files of three splits, read back."""
    from tessera.sources.corpus import combine_splits, document_lines, file_lines, read_line_files, rename_split, write_line_files
    folder = _folder(spark, "line-files")
    write_line_files(document_lines(read_table(spark, sf_dir, "documents")), folder)
    parts = [rename_split(read_line_files(spark, f"{folder}/split={name}", "*.txt", "train"), name) for name in ("train", "val", "test")]
    return file_lines(combine_splits(*parts))


@register("file_packed_blocks", ORACLES["packed_blocks"])
def q_file_packed_blocks(spark, sf_dir):
    """S1 + S2 + U1 + U2 + W1 + W2 over line files: order by file, byte range and
    row; the same blocks as from the documents."""
    b = corpus.prepare_lines(_file_lines(spark, sf_dir), P).blocks
    return b.select("split", "block_id", F.size("tokens").cast("int").alias("n"), F.array_join("tokens", " ").alias("ids_text"))


@register("stream_blocks", ORACLES["packed_blocks"])
def q_stream_blocks(spark, sf_dir):
    """S5 + S4 + W2: the token stream written as flat 16-bit ids and scanned back
    by byte ranges, cut into the same blocks."""
    from tessera.operators.pack import pack_blocks
    from tessera.sources.token_stream import read_token_stream, write_line_stream
    prep = _prep(spark, sf_dir)
    folder = _folder(spark, "token-stream")
    write_line_stream(prep.stored_ids, folder)
    b = pack_blocks(read_token_stream(spark, folder), prep.totals, P)
    return b.select("split", "block_id", F.size("tokens").cast("int").alias("n"), F.array_join("tokens", " ").alias("ids_text"))


@register("stream_totals", with_ctes(
    "SELECT split, count(*)::BIGINT AS n, max(pos)::BIGINT AS last_pos, sum(token_id)::BIGINT AS id_sum, "
    "sum(token_id::BIGINT * (pos % 1009))::BIGINT AS placed_sum FROM tokens GROUP BY split", ["tokens"]))
def q_stream_totals(spark, sf_dir):
    """S5 + S4: count, last position and position-weighted sums of the scanned
    flat stream of every split."""
    from tessera.sources.token_stream import read_manifest, read_token_stream, write_line_stream
    folder = _folder(spark, "token-stream")
    write_line_stream(_prep(spark, sf_dir).stored_ids, folder)
    splits = sorted({s["split"] for s in read_manifest(folder)})
    parts = [read_token_stream(spark, folder, s) for s in splits]
    t = parts[0]
    for x in parts[1:]:
        t = t.unionByName(x)
    weighted = F.col("token_id").cast("bigint") * (F.col("pos") % 1009)
    return t.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last_pos"), F.sum(F.col("token_id").cast("bigint")).alias("id_sum"),
                                  F.sum(weighted).alias("placed_sum"))


# ---------------------------------------------------------------- batching
def _md5_sql(*parts: str, digits: int = 7) -> str:
    return "('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + f")), 1, {digits}))::BIGINT"


_EPOCH_SQL = with_ctes(
    f"SELECT epoch, block_id, rn, batch_id, row_in_batch, step, step % {P.grad_accum_steps} = 0 AS is_update, "
    f"step % {P.log_every} = 0 AS is_log FROM (SELECT *, rn // {P.batch_size} AS batch_id, "
    f"(rn % {P.batch_size})::INT AS row_in_batch, rn // {P.batch_size} + 1 AS step FROM ep_rn) "
    f"WHERE (rn // {P.batch_size} + 1) * {P.batch_size} <= n",
    ["blocks"], P, extra={
        "ep_x": (f"SELECT e.range::INT AS epoch, b.block_id, {_md5_sql(repr(str(P.seed)), 'CAST(e.range AS VARCHAR)', 'CAST(b.block_id AS VARCHAR)', digits=15)} AS h "
                 f"FROM blocks b CROSS JOIN range({P.epochs}) e WHERE b.split = 'train'"),
        "ep_rn": ("SELECT epoch, block_id, (row_number() OVER (PARTITION BY epoch ORDER BY h, block_id) - 1)::BIGINT AS rn, "
                  "count(*) OVER (PARTITION BY epoch) AS n FROM ep_x"),
    })


@register("epoch_plan", _EPOCH_SQL)
def q_epoch_plan(spark, sf_dir):
    """T5 + O1 + W4 + O2 + P6: per epoch, seeded shuffle of the train blocks,
    full batches only, 1-based step, update and log flags."""
    from tessera.operators.batching import epoch_plan
    return epoch_plan(_prep(spark, sf_dir).blocks, P)


@register("updates_per_epoch", "SELECT epoch, count(DISTINCT batch_id)::BIGINT AS n_batches, "
          f"(count(DISTINCT batch_id) // {P.grad_accum_steps})::BIGINT AS n_updates FROM ("
          + _EPOCH_SQL + ") GROUP BY epoch")
def q_updates_per_epoch(spark, sf_dir):
    """``len(train_dataloader) // accumulation`` per epoch."""
    from tessera.operators.batching import epoch_plan, updates_per_epoch
    return updates_per_epoch(epoch_plan(_prep(spark, sf_dir).blocks, P), P.grad_accum_steps)


@register("eval_batches", with_ctes(
    f"SELECT split, block_id, block_id // {P.eval_batch_size} AS batch_id, "
    f"(block_id % {P.eval_batch_size})::INT AS row_in_batch FROM blocks WHERE split IN ('val', 'test')", ["blocks"]))
def q_eval_batches(spark, sf_dir):
    """W4 without shuffle; the short last batch is kept (evaluation loader)."""
    from tessera.operators.batching import eval_batches
    return eval_batches(_prep(spark, sf_dir).blocks, P.eval_batch_size, ("val", "test"))


SUBSET_SIZE = 50000  # size of the sampled position subset (reference constant)


@register("sampled_positions", with_ctes(
    "SELECT d.draw, d.pos, t.token_id FROM (SELECT r.range AS draw, "
    f"{_md5_sql(repr(str(P.seed)), 'CAST(r.range AS VARCHAR)', digits=15)} % x.n_total AS pos "
    f"FROM range({SUBSET_SIZE}) r, totals x WHERE x.split = 'train') d "
    "JOIN tokens t ON t.split = 'train' AND t.pos = d.pos", ["tokens"]))
def q_sampled_positions(spark, sf_dir):
    """50,000 positions of the train stream drawn with replacement, and their ids."""
    from tessera.operators.batching import sample_positions
    prep = _prep(spark, sf_dir)
    return sample_positions(prep.tokens, prep.totals, SUBSET_SIZE, P.seed, "train")


# ---------------------------------------------------------------- training loss
_Q = f"(SELECT max(step) // {P.grad_accum_steps} FROM plan)"


@register("train_loss", with_ctes(
    "SELECT epoch::INT AS epoch, count(*)::BIGINT AS n_steps, round(avg(loss), 6) AS loss, round(exp(avg(loss)), 4) AS perplexity "
    "FROM steps GROUP BY epoch", ["blocks", "pairs"], P, extra={
        "plan": _EPOCH_SQL,
        "occ": (f"SELECT e.epoch, e.step, e.epoch * {_Q} + (e.step + {P.grad_accum_steps - 1}) // {P.grad_accum_steps} AS k, p.prev, p.next, "
                "count(*)::BIGINT AS m FROM pairs p JOIN plan e ON e.block_id = p.block_id WHERE p.split = 'train' GROUP BY ALL"),
        "ctx": ("SELECT DISTINCT prev, k, coalesce(sum(m) OVER (PARTITION BY prev ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) "
                "AS c_total FROM (SELECT prev, k, sum(m) AS m FROM occ GROUP BY prev, k)"),
        "counted": ("SELECT *, coalesce(sum(m) OVER (PARTITION BY prev, next ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c "
                 "FROM occ"),
        "steps": (f"SELECT a.epoch, a.step, sum(a.m * -ln((a.c + {float(P.alpha)}) / (x.c_total + {float(P.alpha) * P.n_ids}))) / sum(a.m) AS loss "
                  "FROM counted a JOIN ctx x ON x.prev = a.prev AND x.k = a.k GROUP BY a.epoch, a.step"),
    }))
def q_train_loss(spark, sf_dir):
    """A8 (main form) + A9 + T5: per epoch, the mean of the steps' losses, each
    step scored by the counts of the updates before it."""
    from tessera.operators.batching import epoch_plan
    from tessera.operators.training import training_loss, training_steps
    blocks = _prep(spark, sf_dir).blocks
    plan = cut_lineage(epoch_plan(blocks, P).select("epoch", "step", "block_id"))
    r = training_loss(training_steps(blocks, plan, P))
    return r.select("epoch", "n_steps", _r(F.col("loss")).alias("loss"), _r(F.col("perplexity"), 4).alias("perplexity"))


# ---------------------------------------------------------------- interpolated n-grams
def _ngram_ctes() -> dict[str, str]:
    from tessera.operators.interpolated import ROUNDS
    out = {
        "tri": ("SELECT split, block_id, lag(prev) OVER (PARTITION BY split, block_id ORDER BY t) AS h2, prev AS h1, next FROM pairs"),
        "g1": "SELECT next, count(*) AS c FROM tri WHERE split = 'train' GROUP BY next",
        "g2": "SELECT h1, next, count(*) AS c FROM tri WHERE split = 'train' GROUP BY h1, next",
        "g3": "SELECT h2, h1, next, count(*) AS c FROM tri WHERE split = 'train' AND h2 IS NOT NULL GROUP BY h2, h1, next",
        "x2": "SELECT h1, sum(c) AS n FROM g2 GROUP BY h1",
        "x3": "SELECT h2, h1, sum(c) AS n FROM g3 GROUP BY h2, h1",
        "f": ("SELECT e.split, e.block_id, e.m, coalesce(g1.c, 0)::DOUBLE / (SELECT sum(c) FROM g1) AS f1, coalesce(g2.c, 0)::DOUBLE / x2.n AS f2, "
              "coalesce(g3.c, 0)::DOUBLE / x3.n AS f3 FROM (SELECT split, block_id, h2, h1, next, count(*)::DOUBLE AS m FROM tri "
              "WHERE split <> 'train' GROUP BY ALL) e LEFT JOIN g1 ON g1.next = e.next LEFT JOIN g2 ON g2.h1 = e.h1 AND g2.next = e.next "
              "LEFT JOIN x2 ON x2.h1 = e.h1 LEFT JOIN g3 ON g3.h2 = e.h2 AND g3.h1 = e.h1 AND g3.next = e.next "
              "LEFT JOIN x3 ON x3.h2 = e.h2 AND x3.h1 = e.h1"),
        "l0": "SELECT 0.5::DOUBLE AS w1, 0.5::DOUBLE AS w2, 0.5::DOUBLE AS w3",
    }

    def p(source):
        return (f"SELECT *, CASE WHEN f3 IS NULL THEN p2 ELSE w3 * f3 + (1 - w3) * p2 END AS p3 FROM (SELECT *, CASE WHEN f2 IS NULL THEN p1 "
                f"ELSE w2 * f2 + (1 - w2) * p1 END AS p2 FROM (SELECT *, w1 * f1 + (1 - w1) / {P.n_ids} AS p1 FROM {source}))")

    for i in range(1, ROUNDS + 1):
        out[f"q{i}"] = p(f"f, l{i - 1} WHERE split = 'val'")
        out[f"r{i}"] = ("SELECT *, r2 * CASE WHEN f2 IS NULL THEN 1 ELSE (1 - w2) * p1 / p2 END AS r1 FROM "
                        f"(SELECT *, m * CASE WHEN f3 IS NULL THEN 1 ELSE (1 - w3) * p2 / p3 END AS r2 FROM q{i})")
        out[f"l{i}"] = ("SELECT sum(r1 * w1 * f1 / p1) / sum(r1) AS w1, sum(r2 * w2 * f2 / p2) / sum(r2) FILTER (WHERE f2 IS NOT NULL) AS w2, "
                        f"sum(m * w3 * f3 / p3) / sum(m) FILTER (WHERE f3 IS NOT NULL) AS w3 FROM r{i}")
    out["nb"] = f"SELECT split, block_id, sum(m * -ln(p3)) AS nll, sum(m) AS n FROM ({p(f'f, l{ROUNDS}')}) GROUP BY split, block_id"
    out["nbat"] = f"SELECT split, block_id // {P.eval_batch_size} AS b, avg(nll / n) AS loss, sum(nll) AS nll, sum(n) AS n FROM nb GROUP BY ALL"
    return out


@register("trigram_weights", with_ctes(
    "SELECT order_n, round(w, 6) AS weight FROM (SELECT 1 AS order_n, w1 AS w FROM l5 UNION ALL SELECT 2, w2 FROM l5 UNION ALL SELECT 3, w3 FROM l5)",
    ["pairs"], P, extra=_ngram_ctes()))
def q_trigram_weights(spark, sf_dir):
    """L1 (interpolated): weight of every context length, chosen on the val blocks."""
    from tessera.operators.interpolated import evaluate_ngrams
    weights, _ = evaluate_ngrams(_prep(spark, sf_dir).blocks, P)
    return spark.createDataFrame([(k, round(w, 6)) for k, w in weights.items()], "order_n int, weight double")


@register("trigram_perplexity", with_ctes(
    "SELECT split, round(avg(loss), 6) AS loss, round(sum(nll) / sum(n), 6) AS token_loss, round(exp(avg(loss)), 4) AS perplexity "
    "FROM nbat GROUP BY split", ["pairs"], P, extra=_ngram_ctes()))
def q_trigram_perplexity(spark, sf_dir):
    """L1 + L2 for three-token windows: loss and perplexity of val (where the
    weights were chosen) and test."""
    from tessera.operators.evaluation import batch_losses, split_summary
    from tessera.operators.interpolated import evaluate_ngrams
    _, per_block = evaluate_ngrams(_prep(spark, sf_dir).blocks, P)
    s = split_summary(batch_losses(per_block, P.eval_batch_size))
    return s.select("split", _r(F.col("loss")).alias("loss"), _r(F.col("token_loss")).alias("token_loss"), _r(F.col("perplexity"), 4).alias("perplexity"))


# ---------------------------------------------------------------- prompts and rewards
_PROMPT_EXTRA = {
    "r": (f"SELECT doc_id, length(text) AS n_chars, "
          f"({P.prompt_min_len} + {_md5_sql(repr(str(P.gen_seed)), 'CAST(doc_id AS VARCHAR)')} % "
          f"{P.prompt_max_len - P.prompt_min_len})::INT AS input_size, "
          "regexp_extract_all(text, " + "'" + __import__('tessera.plans.oracles', fromlist=['x']).RE2_PATTERN.replace("'", "''")
          + "') AS words FROM docs WHERE split = 'train' AND length(text) > " + str(P.review_min_chars)),
    "rw": ("SELECT doc_id, n_chars, input_size, unnest(generate_series(0, len(w) - 1)) AS i, unnest(w) AS word "
           "FROM (SELECT *, words[1:input_size] AS w FROM r)"),
    "prompts": ("SELECT rw.doc_id, n_chars, input_size, "
                "array_to_string(list(coalesce(v.token_id, 3) ORDER BY i), ' ') AS input_ids_text, "
                "string_agg(CASE WHEN v.token_id IS NULL THEN '<unk>' ELSE rw.word END, '' ORDER BY i) AS query "
                "FROM rw LEFT JOIN vocab v ON v.token = rw.word GROUP BY rw.doc_id, n_chars, input_size"),
}


def _prompts(spark, sf_dir):
    from tessera.operators.prompts import build_prompts
    from tessera.sources.corpus import tag_split
    prep = _prep(spark, sf_dir)
    docs = tag_split(read_table(spark, sf_dir, "documents")).where(F.col("split") == "train")
    return build_prompts(docs, prep.vocab, P)


@register("review_prompts", with_ctes("SELECT * FROM prompts", ["vocab"], P, extra=_PROMPT_EXTRA))
def q_review_prompts(spark, sf_dir):
    """R1 + S3 + P2 + P3 + F6 + O5 + J2: prompt per train review over 200 characters."""
    p = _prompts(spark, sf_dir)
    return p.select("doc_id", "n_chars", "input_size", F.array_join("input_ids", " ").alias("input_ids_text"), "query")


@register("review_rewards", with_ctes(
    "SELECT p.doc_id, p.query, l.quality AS score_quality, l.toxic AS score_toxic, "
    "(l.quality - l.toxic)::DOUBLE AS reward FROM prompts p LEFT JOIN labels l ON l.doc_id = p.doc_id",
    ["vocab"], P, extra=_PROMPT_EXTRA))
def q_review_rewards(spark, sf_dir):
    """J4 + R2: raw label scores and reward attached to every prompt."""
    from tessera.operators.prompts import attach_rewards
    r = attach_rewards(_prompts(spark, sf_dir).select("doc_id", "query"), read_table(spark, sf_dir, "labels"))
    return r.select("doc_id", "query", "score_quality", "score_toxic", "reward")


# ---------------------------------------------------------------- vectors
@register("label_mean_pool",
          "SELECT label, (d.i - 1)::INT AS dim, round(avg(e.embedding[d.i]::DOUBLE), 6) AS mean "
          "FROM embeddings e, (SELECT range AS i FROM range(1, 65)) d "
          "WHERE d.i <= len(e.embedding) GROUP BY label, d.i")
def q_label_mean_pool(spark, sf_dir):
    """Element-wise mean vector per label."""
    from tessera.operators.vectors import mean_pool
    m = mean_pool(read_table(spark, sf_dir, "embeddings"), "label")
    return m.select("label", F.col("dim").cast("int").alias("dim"), _r(F.col("mean")).alias("mean"))


@register("label_first_vector",
          "SELECT label, first_id, (i - 1)::INT AS dim, round(v[i]::DOUBLE, 6) AS x FROM "
          "(SELECT label, min(vec_id) AS first_id, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label), "
          "(SELECT range AS i FROM range(1, 65)) WHERE i <= len(v)")
def q_label_first_vector(spark, sf_dir):
    """First-row pooling per label."""
    from tessera.operators.vectors import first_pool
    f = first_pool(read_table(spark, sf_dir, "embeddings"), "label", "vec_id")
    return f.select("label", "first_id", F.col("dim").cast("int").alias("dim"),
                    _r(F.col("x").cast("double")).alias("x"))


@register("clipped_vectors",
          "WITH g AS (SELECT sqrt(sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))) AS n "
          "FROM embeddings), s AS (SELECT e.vec_id, g.n, least(1.0, 1.0 / (g.n + 1e-6)) AS scale, e.embedding "
          "FROM embeddings e, g) SELECT vec_id, round(n, 6) AS global_norm, round(scale, 9) AS scale, "
          "round(sqrt(list_sum(list_transform(embedding, lambda x: (x::DOUBLE * scale) * (x::DOUBLE * scale)))), 6) "
          "AS clipped_l2 FROM s")
def q_clipped_vectors(spark, sf_dir):
    """Global L2 norm over all vectors, clip to max norm 1.0."""
    from tessera.operators.vectors import clip_global_norm
    c = clip_global_norm(read_table(spark, sf_dir, "embeddings"), P.max_grad_norm)
    l2 = F.sqrt(F.aggregate("clipped", F.lit(0.0).cast("double"), lambda a, x: a + x * x))
    return c.select("vec_id", _r(F.col("global_norm")).alias("global_norm"), _r(F.col("scale"), 9).alias("scale"),
                    _r(l2).alias("clipped_l2"))


@register("logit_cross_entropy",
          "SELECT vec_id, label, round(ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - m)))) + m "
          "- embedding[label + 1]::DOUBLE, 6) AS ce FROM (SELECT *, list_max(embedding)::DOUBLE AS m FROM embeddings)")
def q_logit_cross_entropy(spark, sf_dir):
    """cross-entropy of each vector read as logits against its label."""
    from tessera.operators.vectors import logits_loss
    r = logits_loss(read_table(spark, sf_dir, "embeddings"))
    return r.select("vec_id", "label", _r(F.col("ce")).alias("ce"))


@register("classifier_head")
def q_classifier_head(spark, sf_dir):
    """Multinomial logistic head on the vectors, fit on md5-train rows,
    accuracy on both parts (iterative fit: rows-only check)."""
    from tessera.functions.hashing import split_of
    from tessera.operators.vectors import classifier_accuracy, fit_classifier
    v = read_table(spark, sf_dir, "embeddings").withColumn("split", split_of(F.col("vec_id")))
    model = fit_classifier(v.where(F.col("split") == "train"), reg=0.01, max_iter=30)
    return (classifier_accuracy(model, v.where(F.col("split") == "train")).withColumn("part", F.lit("train"))
            .unionByName(classifier_accuracy(model, v.where(F.col("split") != "train")).withColumn("part", F.lit("held_out"))))


HEAD_BATCH, HEAD_RATE, HEAD_STEPS = 32, 0.5, 2
_W = f"(('0x' || substr(md5(concat_ws('|', '{P.seed}', '0', CAST(vec_id AS VARCHAR))), 1, 15))::BIGINT)"
_HEAD_SQL = (
    "WITH t AS (SELECT vec_id, label, list_append(embedding::DOUBLE[], 1.0) AS x FROM embeddings "
    "WHERE ('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 7))::BIGINT % 10 < 8), "
    f"b AS (SELECT *, (row_number() OVER (ORDER BY {_W}, vec_id) - 1) // {HEAD_BATCH} AS batch FROM t), "
    "c AS (SELECT range AS c FROM range((SELECT max(label) + 1 FROM embeddings))), d AS (SELECT range AS d FROM range((SELECT len(x) FROM t LIMIT 1))), "
    "w0 AS (SELECT c, d, 0.0::DOUBLE AS w FROM c, d)")


def _head_sql() -> str:
    out = _HEAD_SQL
    for i in range(HEAD_STEPS):
        out += (f", z{i} AS (SELECT b.vec_id, b.label, b.x, w.c, sum(w.w * b.x[w.d + 1]) AS z FROM b, w{i} w WHERE b.batch = {i} GROUP BY ALL), "
                f"p{i} AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) / sum(exp(z)) OVER (PARTITION BY vec_id) * exp(max(z) OVER (PARTITION BY vec_id)) "
                f"- (c = label)::INT AS e FROM z{i}), "
                f"w{i + 1} AS (SELECT w.c, w.d, w.w - {HEAD_RATE} * g.g AS w FROM w{i} w JOIN (SELECT p.c, d.d, sum(p.e * p.x[d.d + 1]) / count(*) AS g "
                f"FROM p{i} p, d GROUP BY p.c, d.d) g ON g.c = w.c AND g.d = w.d)")
    return out + f" SELECT c::INT AS label, d::INT AS dim, round(w, 6) AS weight FROM w{HEAD_STEPS}"


@register("head_steps", _head_sql())
def q_head_steps(spark, sf_dir):
    """C1 + T5: the head's weights after two mini-batch steps of the cross-entropy
    over the train vectors, in the order of the epoch plan (bias as last dimension)."""
    from tessera.functions.hashing import split_of
    from tessera.operators.batching import epoch_plan
    from tessera.operators.head import plan_rows, train_head
    v = read_table(spark, sf_dir, "embeddings")
    rows = v.withColumn("split", split_of(F.col("vec_id"))).where(F.col("split") == "train")
    plan = epoch_plan(rows.select("split", F.col("vec_id").alias("block_id")), P.with_(batch_size=HEAD_BATCH), epochs=1)
    shape = v.agg(F.max("label") + 1, F.max(F.size("embedding"))).first()
    weights, _ = train_head(plan_rows(rows, plan), *shape, [(0, i + 1) for i in range(HEAD_STEPS)], HEAD_RATE)
    return spark.createDataFrame([(c, d, round(float(w), 6)) for c, row in enumerate(weights) for d, w in enumerate(row)], "label int, dim int, weight double")


# ---------------------------------------------------------------- checks
@register("decay_groups",
          f"SELECT CASE WHEN contains(p_name, 'bias') OR contains(p_name, 'LayerNorm.weight') THEN 0.0 "
          f"ELSE {P.weight_decay} END::DOUBLE AS weight_decay, count(*)::BIGINT AS n_params, "
          "sum(p_size)::BIGINT AS numel FROM part GROUP BY 1")
def q_decay_groups(spark, sf_dir):
    """P5 + A10: no-decay substring grouping of names, count and total size."""
    from tessera.operators.checks import decay_groups
    return decay_groups(read_table(spark, sf_dir, "part"), "p_name", "p_size", P.weight_decay)


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@register("priority_domain",
          "SELECT count(*)::BIGINT AS n_rows, sum(CASE WHEN o_orderpriority IN ("
          + ", ".join(f"'{p}'" for p in PRIORITIES) + ") THEN 0 ELSE 1 END)::BIGINT AS n_violations FROM orders")
def q_priority_domain(spark, sf_dir):
    """Values outside the allowed set."""
    from tessera.operators.checks import domain_violations
    return domain_violations(read_table(spark, sf_dir, "orders"), "o_orderpriority", PRIORITIES)


TYPE_PATTERNS = ("ECONOMY", "STAND")   # substrings of part types that stand for the no-decay names


@register("pattern_groups",
          "SELECT CASE WHEN " + " OR ".join(f"contains(p_type, '{p}')" for p in TYPE_PATTERNS) + f" THEN 0.0 ELSE {P.weight_decay} END::DOUBLE "
          "AS weight_decay, count(*)::BIGINT AS n_params, sum(p_size)::BIGINT AS numel FROM part GROUP BY 1")
def q_pattern_groups(spark, sf_dir):
    """P5 + A10 with patterns that names of this table contain: both groups."""
    from tessera.operators.checks import decay_groups
    return decay_groups(read_table(spark, sf_dir, "part"), "p_type", "p_size", P.weight_decay, TYPE_PATTERNS)


@register("status_domain",
          "SELECT count(*)::BIGINT AS n_rows, sum(CASE WHEN o_orderstatus IN ('F', 'O') THEN 0 ELSE 1 END)::BIGINT AS n_violations FROM orders")
def q_status_domain(spark, sf_dir):
    """P8 on a column that leaves its set: pending orders violate {F, O}."""
    from tessera.operators.checks import domain_violations
    return domain_violations(read_table(spark, sf_dir, "orders"), "o_orderstatus", ("F", "O"))


@register("token_range", with_ctes(
    "SELECT split, count(*)::BIGINT AS n, max(token_id)::BIGINT AS max_id, "
    "sum(CASE WHEN token_id < 0 OR token_id >= 65536 THEN 1 ELSE 0 END)::BIGINT AS n_out_of_range "
    "FROM tokens GROUP BY split", ["tokens"]))
def q_token_range(spark, sf_dir):
    """Ids fit the unsigned 16-bit stream format."""
    from tessera.operators.checks import u16_report
    return u16_report(_prep(spark, sf_dir).tokens)


# ---------------------------------------------------------------- overflow chunks
OVERFLOW_LEN = 128  # window length of the overflow-chunking variant


@register("overflow_chunks", with_ctes(
    f"SELECT split, doc_id, line_no, (i // {OVERFLOW_LEN})::INT AS chunk_no, count(*)::INT AS length, "
    "array_to_string(list(token_id ORDER BY i), ' ') AS ids_text FROM utok "
    f"GROUP BY split, doc_id, line_no, i // {OVERFLOW_LEN} HAVING count(*) = {OVERFLOW_LEN}",
    ["vocab"], P, extra={
        "utw": ("SELECT split, doc_id, line_no, unnest(generate_series(0, len(words) - 1)) AS i, "
                "unnest(words) AS word FROM lw"),
        "utok": "SELECT u.*, coalesce(v.token_id, 3) AS token_id FROM utw u LEFT JOIN vocab v ON v.token = u.word",
    }))
def q_overflow_chunks(spark, sf_dir):
    """W6 + P7: every encoded line (no truncation, no eos) cut into windows of
    128 ids; only full windows are kept."""
    from tessera.operators.encode import encode_tokens, tokenized_rows
    from tessera.operators.pack import full_length_only, overflow_chunks
    prep = _prep(spark, sf_dir)
    toks = encode_tokens(prep.words, prep.vocab, P, truncate=False, append_eos=False)
    ch = full_length_only(overflow_chunks(tokenized_rows(toks), "ids", OVERFLOW_LEN,
                                          ["split", "doc_id", "line_no"]), OVERFLOW_LEN)
    return ch.select("split", "doc_id", "line_no", F.col("chunk_no").cast("int").alias("chunk_no"),
                     F.col("length").cast("int").alias("length"), F.array_join("input_ids", " ").alias("ids_text"))


# ---------------------------------------------------------------- model selection, top-k
ALPHAS = (1.0, 0.5, 0.1, 0.05, 0.01)


def _grid_sql() -> str:
    grid = ", ".join(f"({i}, {a})" for i, a in enumerate(ALPHAS))
    return with_ctes(
        "SELECT grid_no, alpha, round(loss, 6) AS loss, round(exp(loss), 4) AS perplexity, "
        "exp(loss) < least(coalesce(min(exp(loss)) OVER (ORDER BY grid_no ROWS BETWEEN UNBOUNDED PRECEDING "
        f"AND 1 PRECEDING), 'infinity'::DOUBLE), {float(P.n_ids)}) AS improved FROM gsum",
        ["contexts"], P, extra={
            "grid": f"SELECT * FROM (VALUES {grid}) g(grid_no, alpha)",
            "gp": ("SELECT p.block_id, p.prev, p.next, b.c, x.c_total FROM pairs p "
                   "LEFT JOIN bigrams b ON b.prev = p.prev AND b.next = p.next "
                   "LEFT JOIN contexts x ON x.prev = p.prev WHERE p.split = 'val'"),
            "gb": ("SELECT g.grid_no, g.alpha::DOUBLE AS alpha, gp.block_id, avg(-ln((coalesce(gp.c, 0)::DOUBLE + g.alpha) / "
                   f"(coalesce(gp.c_total, 0)::DOUBLE + g.alpha * {P.n_ids}))) AS loss FROM gp, grid g "
                   "GROUP BY g.grid_no, g.alpha, gp.block_id"),
            "gbat": (f"SELECT grid_no, alpha, block_id // {P.eval_batch_size} AS b, avg(loss) AS loss FROM gb "
                     "GROUP BY 1, 2, 3"),
            "gsum": "SELECT grid_no, alpha, avg(loss) AS loss FROM gbat GROUP BY 1, 2",
        })


@register("alpha_selection", _grid_sql())
def q_alpha_selection(spark, sf_dir):
    """L3 + W5: validation loss/perplexity for each smoothing value of the grid,
    in grid order, flagged where it strictly beats every earlier value and the
    untrained (uniform) model."""
    from tessera.operators.evaluation import running_best
    from tessera.operators.ngram import score_grid
    prep = _prep(spark, sf_dir)
    ev = corpus.evaluate(prep, P)
    pb = score_grid(prep.blocks.where(F.col("split") == "val"), ev["bigrams"], ev["contexts"], ALPHAS, P)
    bat = (pb.withColumn("b", F.floor(F.col("block_id") / P.eval_batch_size))
           .groupBy("grid_no", "alpha", "b").agg(F.avg("loss").alias("loss")))
    s = bat.groupBy("grid_no", "alpha").agg(F.avg("loss").alias("loss")).withColumn("perplexity", F.exp("loss"))
    s = s.withColumn("run", F.lit(0)).withColumn("initial", F.lit(float(P.n_ids)))
    rb = running_best(s, "run", "grid_no", "perplexity", "initial")
    return rb.select("grid_no", "alpha", _r(F.col("loss")).alias("loss"),
                     _r(F.col("perplexity"), 4).alias("perplexity"), "improved")


@register("next_token_topk", with_ctes(
    "SELECT prev::BIGINT AS prev, count(*)::INT AS n_next, array_to_string(list(next ORDER BY rank), ' ') AS next_ids, "
    "array_to_string(list(ppm ORDER BY rank), ' ') AS probs_ppm FROM (SELECT prev, next, rank, "
    "round(w / sum(w) OVER (PARTITION BY prev) * 1000000)::BIGINT AS ppm FROM topk) GROUP BY prev",
    ["contexts"], P, extra={
        # every id that can rank among the top k: the seen ones, and the first 2k ids
        "cand": ("SELECT prev, next::BIGINT AS next FROM bigrams UNION "
                 f"SELECT x.prev, r.range AS next FROM contexts x, range({min(2 * P.top_k, P.n_ids)}) r"),
        "topk": (f"SELECT * FROM (SELECT d.prev, d.next, coalesce(b.c, 0)::DOUBLE + {float(P.alpha)} AS w, "
                 "row_number() OVER (PARTITION BY d.prev ORDER BY coalesce(b.c, 0) DESC, d.next) AS rank "
                 "FROM cand d LEFT JOIN bigrams b ON b.prev = d.prev AND b.next = d.next) "
                 f"WHERE rank <= {P.top_k}"),
    }))
def q_next_token_topk(spark, sf_dir):
    """Per context the top-100 next ids in rank order and their renormalised
    probabilities in millionths."""
    from tessera.operators.ngram import next_token_table
    ev = corpus.evaluate(_prep(spark, sf_dir), P)
    t = next_token_table(ev["bigrams"], ev["contexts"], P)
    row = F.struct("rank", "next", F.round(F.col("prob") * 1000000).cast("bigint").alias("ppm"))
    g = t.groupBy("prev").agg(F.array_sort(F.collect_list(row)).alias("e"))
    return g.select(F.col("prev").cast("bigint").alias("prev"), F.size("e").alias("n_next"),
                    F.array_join("e.next", " ").alias("next_ids"), F.array_join("e.ppm", " ").alias("probs_ppm"))


@register("published_best", _grid_sql().replace(
    "SELECT grid_no, alpha, round(loss, 6) AS loss, round(exp(loss), 4) AS perplexity, ",
    "SELECT grid_no, alpha, round(loss, 6) AS loss, round(exp(loss), 4) AS perplexity, grid_no = arg_min(grid_no, (loss, grid_no)) OVER () AS is_best, "
    "grid_no = max(grid_no) OVER () AS is_last, "))
def q_published_best(spark, sf_dir):
    """L3 + S8 + S9 + S10: the selection as a run, one evaluation after the
    other; read back are the metric log and the settings of the models that the
    pointers ``best`` and ``last`` name."""
    from tessera.plans.selection import select_alpha
    from tessera.sources.store import load_model
    folder = _folder(spark, "selection")
    select_alpha(_prep(spark, sf_dir).blocks, ALPHAS, folder, P)
    log = spark.read.parquet(f"{folder}/metrics").withColumn("grid_no", F.col("epoch").cast("int"))
    w = Window.orderBy("grid_no").rowsBetween(Window.unboundedPreceding, -1)      # one row per setting
    for pointer in ("best", "last"):
        of = load_model(spark, folder, ("settings",), pointer)["settings"].first()["epoch"]
        log = log.withColumn(f"is_{pointer}", F.col("grid_no") == of)
    before = F.least(F.coalesce(F.min("perplexity").over(w), F.lit(float(P.n_ids))), F.lit(float(P.n_ids)))
    return log.select("grid_no", "alpha", _r(F.col("loss")).alias("loss"), _r(F.col("perplexity"), 4).alias("perplexity"), "is_best", "is_last",
                      (F.col("perplexity") < before).alias("improved"))


# ---------------------------------------------------------------- byte-level BPE
def _bpe_model(prep: corpus.Prepared):
    """T1 on the train split's pre-tokens; the learned model is a small driver
    object (at most ``vocab_size`` entries)."""
    from tessera.operators.bpe import train_bpe
    from tessera.operators.vocab import word_counts_of_words
    return train_bpe(word_counts_of_words(prep.words.where(F.col("split") == "train")), P)


_SYM_SQL = ("5 + CASE WHEN b BETWEEN 33 AND 126 THEN b - 33 WHEN b BETWEEN 161 AND 172 THEN b - 161 + 94 "
            "WHEN b BETWEEN 174 AND 255 THEN b - 174 + 106 ELSE 188 + CASE WHEN b <= 32 THEN b "
            "WHEN b <= 160 THEN b - 94 ELSE 67 END END")


@register("bpe_pair_counts", with_ctes(
    "SELECT syms[i] AS left_id, syms[i + 1] AS right_id, sum(n)::BIGINT AS cnt FROM "
    "(SELECT n, syms, unnest(range(1, len(syms))) AS i FROM sy) GROUP BY 1, 2", ["wc"], P, extra={
        "bw": "SELECT word, n, hex(encode(word)) AS hx FROM wc",
        "sy": ("SELECT n, list_transform(list_transform(range(0, strlen(hx) // 2), "
               "lambda i: ('0x' || substr(hx, i * 2 + 1, 2))::INT), lambda b: " + _SYM_SQL + ") AS syms FROM bw"),
    }))
def q_bpe_pair_counts(spark, sf_dir):
    """F5 + A4: first-round adjacent byte-symbol pair counts, weighted by word counts."""
    from tessera.operators.bpe import pair_counts, type_table
    from tessera.operators.vocab import word_counts_of_words
    wc = word_counts_of_words(_prep(spark, sf_dir).words.where(F.col("split") == "train"))
    return pair_counts(type_table(wc))


@register("bpe_merges")
def q_bpe_merges(spark, sf_dir):
    """T1 + O3: the whole vocabulary's merges in order (thousands of exact merges
    per Spark round); checked against the tokenizers package in the tests
    (rows-only here)."""
    return _bpe_model(_prep(spark, sf_dir)).merge_table(spark)


@register("bpe_encode")
def q_bpe_encode(spark, sf_dir):
    """Every line encoded with the learned merges, truncated, eos appended."""
    from tessera.operators.bpe import encode_lines
    prep = _prep(spark, sf_dir)
    enc = encode_lines(prep.words, _bpe_model(prep), P)
    return enc.select("split", "doc_id", "line_no", F.array_join("ids", " ").alias("ids_text"), "len")


@register("bpe_roundtrip", with_ctes(
    "SELECT split, count(*)::BIGINT AS n_lines, count(*)::BIGINT AS n_equal FROM lines GROUP BY split", ["lines"]))
def q_bpe_roundtrip(spark, sf_dir):
    """S6 + S10 + J2 for BPE: with the tokenizer published and loaded again,
    decode(encode(line)) equals the line for every line (no truncation, no eos)."""
    from tessera.operators.bpe import decode_ids, encode_lines
    from tessera.sources.store import load_bpe, save_bpe
    prep = _prep(spark, sf_dir)
    folder = _folder(spark, "tokenizer")
    save_bpe(spark, _bpe_model(prep), folder)
    model = load_bpe(spark, folder)
    enc = encode_lines(prep.words, model, P, append_eos=False, truncate=False)
    keys = ["split", "doc_id", "line_no"]
    dec = decode_ids(enc, model, "ids", keys)
    j = dec.join(prep.lines.select(*keys, F.col("text").alias("orig")), keys)
    return j.groupBy("split").agg(F.count(F.lit(1)).cast("bigint").alias("n_lines"),
                                  F.sum((F.col("text") == F.col("orig")).cast("int")).cast("bigint").alias("n_equal"))


@register("bpe_perplexity")
def q_bpe_perplexity(spark, sf_dir):
    """T4 + L1 + L2 on BPE ids: the corpus encoded by the learned vocabulary,
    packed, fitted and scored (rows-only; the blocks are compared with the
    tokenizers package in the tests)."""
    prep = _prep(spark, sf_dir)
    s = corpus.evaluate_blocks(corpus.bpe_blocks(prep, _bpe_model(prep), P), P)["summary"]
    return s.select("split", "n_batches", "n_blocks", _r(F.col("loss")).alias("loss"),
                    _r(F.col("token_loss")).alias("token_loss"), _r(F.col("perplexity"), 4).alias("perplexity"))


# ---------------------------------------------------------------- generation
def _samples(spark, sf_dir):
    """The corpus job and the samples of every user turn; stored: decoding and the
    final join read the samples, they don't draw them again."""
    from tessera.operators.encode import encode_tokens, tokenized_rows, with_words
    from tessera.operators.generate import generate
    prep = _prep(spark, sf_dir)
    ev = corpus.evaluate(prep, P)
    conv = read_table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    conv = conv.select(F.concat_ws(":", "conv_id", "turn").alias("key"), "text")
    toks = encode_tokens(with_words(conv, P), prep.vocab, P, keys=("key",), truncate=False, append_eos=False)
    prompts = tokenized_rows(toks, keys=("key",)).select("key", F.col("ids").alias("prompt_ids"))
    return prep, cut_lineage(generate(prompts, ev["bigrams"], ev["contexts"], P, key="key", ids_col="prompt_ids"))


@register("generate_samples")
def q_generate_samples(spark, sf_dir):
    """L4 + F9 + J2: ten top-100 samples per user turn of ``conversations``
    (min length 30, max length 128 counting the prompt, seed 42), decoded with
    special ids skipped. Iterative per sample: rows-only check (its first draws
    have SQL, ``first_draws``)."""
    from tessera.operators.encode import decode
    prep, out = _samples(spark, sf_dir)
    dec = decode(out, prep.vocab, "ids", ["key", "sample_no"], P, skip_special=True)
    return (out.join(dec, ["key", "sample_no"])
            .select("key", "sample_no", "prompt_len", "len", F.size("attention_mask").alias("mask_len"), "text"))


_K1 = P.top_k + 1
_DRAW_EXTRA = {
    "pw": ("SELECT key, unnest(generate_series(0, len(w) - 1)) AS i, unnest(w) AS word FROM (SELECT concat_ws(':', conv_id, turn) AS key, "
           "regexp_extract_all(text, " + "'" + __import__('tessera.plans.oracles', fromlist=['x']).RE2_PATTERN.replace("'", "''")
           + "') AS w FROM conversations WHERE role = 'user')"),
    "pr": ("SELECT key, count(*) AS prompt_len, arg_max(coalesce(v.token_id, 3), i)::BIGINT AS last FROM pw LEFT JOIN vocab v ON v.token = pw.word "
           f"GROUP BY key HAVING count(*) < {P.gen_max_length}"),
    "known": "SELECT DISTINCT last AS prev FROM pr WHERE last IN (SELECT prev FROM contexts)",
    "cand": ("SELECT prev, next::BIGINT AS next FROM bigrams WHERE prev IN (SELECT prev FROM known) UNION "
             f"SELECT k.prev, r.range FROM known k, range({min(2 * _K1, P.n_ids)}) r"),
    "best": (f"SELECT d.prev, d.next, coalesce(b.c, 0) + {float(P.alpha)} AS w, row_number() OVER (PARTITION BY d.prev ORDER BY coalesce(b.c, 0) DESC, d.next) AS rank "
             f"FROM cand d LEFT JOIN bigrams b ON b.prev = d.prev AND b.next = d.next QUALIFY rank <= {_K1} "
             f"UNION ALL SELECT -1, range, 1.0, range + 1 FROM range({_K1})"),
    "open": (f"SELECT x.barred, b.*, row_number() OVER (PARTITION BY barred, prev ORDER BY rank) AS place FROM best b, (VALUES (true), (false)) x(barred) "
             f"WHERE NOT (x.barred AND b.next = {P.eos_id}) QUALIFY place <= {P.top_k}"),
    "cdf": "SELECT *, sum(w) OVER (PARTITION BY barred, prev ORDER BY place) AS upto, sum(w) OVER (PARTITION BY barred, prev) AS total FROM open",
    "draw": (f"SELECT pr.key, s.range::INT AS sample_no, prompt_len::INT AS prompt_len, prompt_len < {P.gen_min_length} AS barred, "
             "coalesce(k.prev, -1) AS prev, ('0x' || substr(md5(concat_ws('|', " + f"'{P.gen_seed}', pr.key, s.range::VARCHAR, '0')), 1, 13))::BIGINT / {float(1 << 52)} AS u "
             f"FROM pr LEFT JOIN known k ON k.prev = pr.last, range({P.gen_samples}) s"),
}


@register("first_draws", with_ctes(
    "SELECT d.key, d.sample_no, d.prompt_len, arg_min(c.next, c.place)::BIGINT AS next_id FROM draw d JOIN cdf c ON c.prev = d.prev AND c.barred = d.barred "
    "WHERE c.upto > d.u * c.total GROUP BY d.key, d.sample_no, d.prompt_len", ["contexts"], P, extra=_DRAW_EXTRA))
def q_first_draws(spark, sf_dir):
    """L4, one step of it: the first id that each sample draws after its prompt
    (best 100 ids of the last one's context, eos barred below the minimum length)."""
    out = _samples(spark, sf_dir)[1]
    return out.where(F.size("ids") > F.col("prompt_len")).select(
        "key", "sample_no", "prompt_len", F.element_at("ids", F.col("prompt_len") + 1).alias("next_id"))


# ---------------------------------------------------------------- streaming
@register("stream_tokenized_lines", ORACLES["tokenized_lines"])
def q_stream_tokenized_lines(spark, sf_dir):
    """The line encoder run as a Structured Streaming query over the
    ``documents`` files (foreachBatch, idempotent per batch); same result as
    ``tokenized_lines``."""
    from tessera.streaming.encode_stream import encode_documents_stream
    vocab = _prep(spark, sf_dir).vocab
    rows = encode_documents_stream(spark, table_path(sf_dir, "documents"), vocab, P)
    return rows.select("split", "doc_id", "line_no", F.array_join("ids", " ").alias("ids_text"), "len")


# ---------------------------------------------------------------- key-token weighting
KEY_TOKENS = (P.eos_id,)  # key ids of the weighted loss variant (eos marks line ends)


@register("keytoken_weighted_loss", with_ctes(
    "SELECT pb.split, round(avg(pb.loss * " + str(float(P.alpha)) + " * (1 + kb.n_key)), 6) AS weighted_loss, "
    "round(avg(pb.loss), 6) AS plain_loss FROM per_block pb JOIN "
    "(SELECT split, block_id, sum(CASE WHEN token_id IN (" + ", ".join(str(k) for k in KEY_TOKENS) + ") THEN 1 ELSE 0 END) "
    "AS n_key FROM btok GROUP BY split, block_id) kb ON kb.split = pb.split AND kb.block_id = pb.block_id "
    "GROUP BY pb.split", ["per_block"]))
def q_keytoken_weighted_loss(spark, sf_dir):
    """Per evaluation split, the mean of per-block loss weighted by
    ``alpha * (1 + key tokens in the block)`` beside the plain mean (the
    unweighted form is the live behaviour)."""
    from tessera.operators.evaluation import keytoken_weights
    prep = _prep(spark, sf_dir)
    pb = corpus.evaluate(prep, P)["per_block"]
    w = prep.blocks.select("split", "block_id", keytoken_weights("tokens", KEY_TOKENS, P.alpha).alias("w"))
    j = pb.join(w, ["split", "block_id"])
    return j.groupBy("split").agg(_r(F.avg(F.col("loss") * F.col("w"))).alias("weighted_loss"),
                                  _r(F.avg("loss")).alias("plain_loss"))
