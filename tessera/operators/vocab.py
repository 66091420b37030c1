"""Word counts and the frequency-ranked word vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tessera.config import Params, SPECIAL_TOKENS
from tessera.functions.pretokens import pretokens, shared_classes
from tessera.functions.text import pretokenize
from tessera.session import stored


def word_counts(lines: DataFrame, text_col: str = "text") -> DataFrame:
    """A3: ``(word, n)`` over all pre-tokens. The hash aggregate is partial then
    final, so a hot word costs one row per map task in the shuffle."""
    return (lines.select(F.explode(pretokenize(text_col)).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).cast("bigint").alias("n")))


def word_counts_of_words(lines: DataFrame, words_col: str = "words") -> DataFrame:
    """A3 on already pre-tokenized rows."""
    return (lines.select(F.explode(words_col).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).cast("bigint").alias("n")))


HELD_WORDS = 1 << 22   # pre-tokens that a task counts before it sends their counts


def word_counts_of_lines(lines: DataFrame, text_col: str = "text") -> DataFrame:
    """A3 straight from the texts: tasks pre-tokenize Arrow batches and send each
    word once for ``HELD_WORDS`` pre-tokens, with its count."""
    classes = shared_classes(lines.sparkSession)

    def run(batches):
        import pyarrow as pa

        def counted(parts):
            found = pa.chunked_array(parts).value_counts()
            return pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"])

        held, size = [], 0
        for b in batches:
            words, _ = pretokens(b.column(0), classes.value)
            held.append(words)
            size += len(words)
            if size >= HELD_WORDS:
                yield counted(held)
                held, size = [], 0
        if size:
            yield counted(held)

    rows = lines.where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def min_frequency(counts: DataFrame, k: int, col: str = "n") -> DataFrame:
    """A5: keep entries seen at least ``k`` times."""
    return counts.where(F.col(col) >= k)


def special_rows(spark, specials=SPECIAL_TOKENS) -> DataFrame:
    return spark.createDataFrame([(i, t) for i, t in enumerate(specials)], "token_id int, token string")


def frequency_cut(counts: DataFrame, k: int) -> tuple[int, int]:
    """``(c, m)``: the ``k`` most frequent entries are those above count ``c``
    and ``m`` of those at ``c``. From a histogram in powers of two, then of the
    exact counts inside the one power where the cut lies."""
    powers = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("k")).collect()
    above = 0
    for p, found in sorted(((r["p"], r["k"]) for r in powers), reverse=True):
        if above + found > k:
            exact = counts.where(F.floor(F.log2("n")) == p).groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()
            for n, same in sorted(((r["n"], r["k"]) for r in exact), reverse=True):
                if above + same > k:
                    return n, k - above
                above += same
        above += found
    return 0, 0


def word_vocab(counts: DataFrame, params: Params = Params()) -> DataFrame:
    """``(token_id, token)``: the specials, then the most frequent words
    (count desc, word asc) with at least ``min_frequency`` occurrences, up to
    ``vocab_size`` entries in all.

    The cut is found from histograms of the stored counts, so only the at most
    ``vocab_size`` winners are sorted and numbered; of the words at the cut's
    count the first ones by name are taken."""
    n_spec = len(params.special_tokens)
    counts = stored(min_frequency(counts, params.min_frequency), "word-counts")
    c, m = frequency_cut(counts, params.vocab_size - n_spec)
    top = counts.where(F.col("n") > c)
    if m:
        top = top.unionByName(counts.where(F.col("n") == c).orderBy("word").limit(m))
    ranked = top.select(
        (F.row_number().over(Window.orderBy(F.col("n").desc(), F.col("word").asc())) + (n_spec - 1))
        .cast("int").alias("token_id"),
        F.col("word").alias("token"))
    return special_rows(counts.sparkSession, params.special_tokens).unionByName(ranked)


def vocab_size(vocab: DataFrame) -> DataFrame:
    """Number of entries."""
    return vocab.agg(F.count(F.lit(1)).cast("bigint").alias("vocab_size"))
