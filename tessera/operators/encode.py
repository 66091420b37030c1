"""Word-level encode and decode as joins.

A line is pre-tokenized in place (narrow), its words are exploded with their
positions and joined to the vocabulary. The vocabulary has at most
``vocab_size`` rows by construction, so broadcasting it is size-bounded and the
token rows never shuffle for the lookup; a hot word costs nothing extra."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from tessera.config import Params, UNK_ID
from tessera.functions.pretokens import pretokens, shared_classes
from tessera.functions.text import pretokenize


def with_words(lines: DataFrame, params: Params = Params(), text_col: str = "text") -> DataFrame:
    """Adds ``words`` (pre-tokens) and ``len`` = ids after truncation plus eos."""
    return (lines.withColumn("words", pretokenize(text_col))
            .withColumn("len", (F.least(F.size("words"), F.lit(params.context_length)) + 1).cast("int")))


def vocab_lookup(vocab: DataFrame) -> DataFrame:
    """The vocabulary as a broadcast lookup side ``(word, vid)``. Its row count
    is bounded by ``vocab_size`` (it is built as a top-k), which is the size
    check that licenses the broadcast."""
    return F.broadcast(vocab.select(F.col("token").alias("word"), F.col("token_id").alias("vid")))


def encode_tokens(lines: DataFrame, vocab: DataFrame, params: Params = Params(),
                  keys=("split", "doc_id", "line_no"), start_col: str | None = None,
                  truncate: bool = True, append_eos: bool = True) -> DataFrame:
    """J1 + O5 + F3 on token rows: one row per id of every line,
    ``(*keys, i, token_id[, pos])``. Words past ``context_length`` are dropped,
    then eos is appended (the element with a null word). Out-of-vocabulary words
    map to ``<unk>``. ``lines`` must carry ``words`` (see :func:`with_words`);
    with ``start_col`` the global position ``pos = start + i`` is added."""
    carry = list(keys) + ([start_col] if start_col else [])
    kept = F.slice("words", 1, params.context_length) if truncate else F.col("words")
    marked = F.concat(kept, F.array(F.lit(None).cast("string"))) if append_eos else kept
    ex = lines.select(*carry, F.posexplode(marked).alias("i", "word"))
    j = ex.join(vocab_lookup(vocab), "word", "left")
    tok = (F.when(F.col("word").isNull(), F.lit(params.eos_id))
           .otherwise(F.coalesce(F.col("vid"), F.lit(UNK_ID))).cast("int"))
    out = [*keys, F.col("i").cast("int").alias("i"), tok.alias("token_id")]
    if start_col:
        out.append((F.col(start_col) + F.col("i")).cast("bigint").alias("pos"))
    return j.select(*out)


def _shared_vocab(vocab: DataFrame):
    """A broadcast of the vocabulary's entries, at most ``vocab_size``."""
    entries = vocab.select("token", F.col("token_id").cast("int")).toArrow().combine_chunks()
    return vocab.sparkSession.sparkContext.broadcast(entries)


def _looked_up(entries, words, size, eos: int):
    """The ids of each row's words (one after the other, ``size`` a row), then
    eos, as an Arrow list array."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    tokens = entries.column("token").combine_chunks().cast(words.type)
    token_id = np.append(entries.column("token_id").to_numpy(), UNK_ID).astype(np.int32)
    end = np.cumsum(size + 1)
    found = pc.index_in(words, value_set=tokens).fill_null(len(tokens)).to_numpy(zero_copy_only=False)
    ids = np.full(int(size.sum()) + len(size), eos, np.int32)
    inside = np.ones(len(ids), bool)
    inside[end - 1] = False
    ids[inside] = token_id[found]
    return pa.ListArray.from_arrays(pa.array(np.append(0, end).astype(np.int32)), pa.array(ids))


def encode_rows(lines: DataFrame, vocab: DataFrame, params: Params = Params(),
                keys=("split", "doc_id", "line_no")) -> DataFrame:
    """J1 + O5 + F3 line by line: ``(*keys, ids)`` from rows carrying ``words``,
    without token rows. The vocabulary (at most ``vocab_size`` rows) goes to the
    tasks, which look the words of a batch up in it; nothing is shuffled. The same
    ids as :func:`encode_tokens`."""
    shared = _shared_vocab(vocab)
    n_keys, eos = len(keys), params.eos_id

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            words = b.column(n_keys)
            size = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            lists = _looked_up(shared.value, words.flatten(), size, eos)
            yield pa.RecordBatch.from_arrays([*b.columns[:n_keys], lists], names=[*b.schema.names[:n_keys], "ids"])

    rows = lines.where(F.col("words").isNotNull()).select(*keys, F.slice("words", 1, params.context_length).alias("words"))
    schema = StructType([*rows.schema.fields[:n_keys], StructField("ids", ArrayType(IntegerType()))])
    return rows.mapInArrow(run, schema)


def encode_texts(lines: DataFrame, vocab: DataFrame, params: Params = Params(),
                 keys=("split", "doc_id", "line_no"), text_col: str = "text") -> DataFrame:
    """F4 + J1 + O5 + F3 straight from the texts, ``(*keys, ids, len)``: the same
    ids as :func:`encode_rows`, but no word leaves the task that reads its line."""
    shared, classes = _shared_vocab(vocab), shared_classes(lines.sparkSession)
    n_keys, eos, most = len(keys), params.eos_id, params.context_length

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            words, size = pretokens(b.column(n_keys), classes.value)
            if len(size) and size.max() > most:
                place = np.arange(len(words)) - np.repeat(np.cumsum(size) - size, size)
                words, size = words.filter(pa.array(place < most)), np.minimum(size, most)
            lists = _looked_up(shared.value, words, size, eos)
            yield pa.RecordBatch.from_arrays([*b.columns[:n_keys], lists, pa.array((size + 1).astype(np.int32))],
                                             names=[*b.schema.names[:n_keys], "ids", "len"])

    rows = lines.where(F.col(text_col).isNotNull()).select(*keys, F.col(text_col).cast("string").alias("text"))
    schema = StructType([*rows.schema.fields[:n_keys], StructField("ids", ArrayType(IntegerType())), StructField("len", IntegerType())])
    return rows.mapInArrow(run, schema)


def merged_rows(rows: DataFrame, keys) -> DataFrame:
    """One row per key, ``(*keys, ids, len)``. Where lines share a key, their ids
    are merged by place in the line, as :func:`tokenized_rows` does."""
    g = rows.groupBy(*keys).agg(F.collect_list("ids").alias("_l"))
    placed = F.flatten(F.transform("_l", lambda l: F.transform(l, lambda x, i: F.struct(i.alias("i"), x.alias("token_id")))))
    ids = F.when(F.size("_l") == 1, F.col("_l")[0]).otherwise(F.array_sort(placed)["token_id"])
    return g.select(*keys, ids.alias("ids")).withColumn("len", F.size("ids").cast("int"))


def tokenized_rows(tokens: DataFrame, keys=("split", "doc_id", "line_no")) -> DataFrame:
    """P1 + F2: ``(*keys, ids, len)``: the ids of each line in order. Shuffles
    token rows by line key; a line is one input row, so no group exceeds one."""
    g = tokens.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "token_id"))).alias("_s"))
    ids = F.col("_s.token_id")
    return g.select(*keys, ids.alias("ids"), F.size(ids).cast("int").alias("len"))


def oov_report(lines: DataFrame, vocab: DataFrame) -> DataFrame:
    """J1 left join with a null check: words missing from the vocabulary."""
    ex = lines.select(F.explode(pretokenize("text")).alias("word"))
    return (ex.join(vocab_lookup(vocab), "word", "left").where(F.col("vid").isNull())
            .groupBy("word").agg(F.count(F.lit(1)).cast("bigint").alias("n")))


def decode(rows: DataFrame, vocab: DataFrame, ids_col: str, keys, params: Params = Params(),
           skip_special: bool = False, out_col: str = "text") -> DataFrame:
    """Ids back to text: explode with position, broadcast-join id to token,
    ordered re-concatenation per row. ``skip_special`` drops the special ids and
    eos. Rows whose ids are all dropped give the empty string."""
    ex = rows.select(*keys, F.posexplode(ids_col).alias("i", "token_id"))
    if skip_special:
        ex = ex.where((F.col("token_id") >= len(params.special_tokens)) & (F.col("token_id") != params.eos_id))
    v = F.broadcast(vocab.select("token_id", "token"))
    j = ex.join(v, "token_id", "left")
    tok = F.coalesce(F.col("token"), F.lit(""))
    g = j.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("i"), tok.alias("t")))).alias("_s"))
    dec = g.select(*keys, F.array_join(F.col("_s.t"), "").alias(out_col))
    # rows with nothing left to decode still appear, with ""
    base = rows.select(*keys)
    return base.join(dec, list(keys), "left").select(*keys, F.coalesce(F.col(out_col), F.lit("")).alias(out_col))
