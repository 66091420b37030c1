"""Quality rules with an n-gram perplexity band per language.

The model is a byte n-gram model of order 4 with modified Kneser-Ney
discounts, one per language. Spark counts the n-grams of all texts (tasks
combine first), derives continuation counts, discounts and back-off weights by
joins on the count tables, and stores the interpolated probability of every
n-gram under the n-gram itself; nothing is hashed. All texts are counted, so
every n-gram that is scored has its entry. Up to ``HELD`` entries go to the
scoring tasks as sorted arrays of each language (8 bytes an entry); a larger
model stays in Spark, and the n-grams of each text meet it by a shuffle join.

A document passes if its word count and its share of repeated three-word
windows pass the base rule and its mean log-probability per byte lies inside
its language's band: quartiles -/+ ``SPREAD`` interquartile ranges over all
documents of that language. Too predictable and too surprising texts fail.

Defined results: null text has no words and fails the base rule; empty texts
have log-perplexity 0 and take no part in the bands; null languages are a
language of their own; long texts are read whole; repeated rows count each;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm.common import grouped_by_bytes, row_hash, small_batches, store, text_of

ORDER = 4
HELD = 1 << 24                    # entries that scoring tasks hold
SPREAD = 1.5                      # ordinary fences
BIN = 0.001                       # width of a log-perplexity bin of the quartiles
CHUNK_BYTES = 16 << 20
SYMBOLS = b"#*$%&|<>"             # fixed value of the contract
MIN_WORDS, MAX_REPEAT = 50, 50    # fixed values of the contract
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def ngram_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The last ORDER bytes before each position as one number (texts start
    after ORDER - 1 zero bytes), and the length of each text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    pad = b"\0" * (ORDER - 1)
    b = np.frombuffer(pad + pad.join(texts), np.uint8).astype(np.uint32)
    k = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:] if len(b) > 3 else np.zeros(0, np.uint32)
    # position i of text t ends at its own byte; the positions of the padding between texts go
    begin = np.cumsum(lengths + ORDER - 1) - lengths - (ORDER - 1)
    inside = np.ones(len(k), bool)
    for d in range(ORDER - 1):
        cut = (begin[1:] - 1 - d)
        inside[cut[cut >= 0]] = False
    return k[inside], lengths


def _count(batches):
    import pyarrow as pa
    for table in grouped_by_bytes(batches, "text", CHUNK_BYTES):
        texts, langs = table.column("text").to_pylist(), table.column("lang").to_pylist()
        for lang in sorted(set(langs)):
            keys, _ = ngram_keys([t.encode("utf-8", "replace") for t, x in zip(texts, langs) if x == lang])
            found, counts = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(counts.astype(np.int64))],
                                             names=["lang", "gram", "c"])


def fit(docs: DataFrame) -> DataFrame:
    """Stored model: lang, gram, value (natural log of the interpolated
    probability of the n-gram's last byte), one row per n-gram of any text."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), text_of().alias("text")).where(F.length("text") > 0)
    grams = {ORDER: store(texts.mapInArrow(_count, "lang string, gram long, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c")), "grams")}
    for o in range(ORDER - 1, 0, -1):     # how many different bytes stand before
        grams[o] = store(grams[o + 1].groupBy("lang", (F.col("gram") % (1 << 8 * o)).alias("gram")).agg(F.count("*").alias("c")), "grams")
    lower = None
    for o in range(1, ORDER + 1):
        ctx = F.floor(F.col("gram") / 256).cast("long").alias("ctx")
        n = [F.sum((F.col("c") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)]
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        disc = lambda k: F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), F.when(
            F.col(f"n{k}") > 0, k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")).otherwise(0.75)))
        discounts = grams[o].groupBy("lang").agg(*n).select("lang", *[F.coalesce(disc(k), F.lit(0.75)).alias(f"d{k}") for k in (1, 2, 3)])
        # one row per language: broadcast, so that the n-grams of a language stay spread
        part = grams[o].join(F.broadcast(discounts), "lang").withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        context = part.groupBy("lang", ctx).agg(F.sum("c").alias("total"), F.sum("d").alias("off"))
        context = context.select("lang", "ctx", "total", (F.col("off") / F.col("total")).alias("gamma"))
        p = part.withColumn("ctx", ctx).join(context, ["lang", "ctx"])
        own = (F.col("c") - F.col("d")) / F.col("total")
        if o == 1:
            p = p.withColumn("p", own + F.col("gamma") / 256)
        else:
            below = lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("q"))
            p = p.withColumn("suffix", F.col("gram") % (1 << 8 * (o - 1))).join(below, ["lang", "suffix"]).withColumn("p", own + F.col("gamma") * F.col("q"))
        lower = store(p.select("lang", "gram", "p"), "grams")
    return lower.select("lang", "gram", F.log("p").cast("float").alias("value"))


def arrays(model: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Of each language the sorted n-grams and their values."""
    langs = sorted(r["lang"] for r in model.select("lang").distinct().collect())
    number = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int") if langs else F.lit(0)
    t = model.select(number.alias("n"), "gram", "value").orderBy("n", "gram").toArrow()
    n, gram, value = (t.column(x).to_numpy() for x in ("n", "gram", "value"))
    ends = np.searchsorted(n, np.arange(len(langs) + 1), side="right")
    return {x: (gram[a:b].astype(np.uint32), value[a:b]) for x, a, b in zip(langs, ends, ends[1:])}


def log_probs(keys: np.ndarray, lang: str, held: dict) -> np.ndarray:
    """Natural log-probability of each n-gram's last byte."""
    grams, values = held[lang]
    at = np.searchsorted(grams, keys)
    if not np.array_equal(grams.take(at, mode="clip"), keys):
        raise ValueError(f"n-grams of language {lang!r} that the model has not counted")
    return values.take(at)


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def base_counts(texts: list[bytes], memo: _Ids) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of texts."""
    split = [t.split() for t in texts]
    n_words = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size) - size

    def per_text(mask):
        total = np.append(0, np.cumsum(mask, dtype=np.int64))
        return total[begin + size] - total[begin]

    chars = per_text((flat & 0xC0 != 0x80) & ~_SPACE[flat])
    symbols = per_text(_SYMBOL[flat])
    dup = []
    for t in texts:
        lines = [x for x in t.split(b"\n") if x.strip()]
        dup.append(len(lines) - len(set(lines)))
    words = np.fromiter((h for ws in split for h in map(memo.__getitem__, ws)), np.uint64, int(n_words.sum()))
    owner = np.repeat(np.arange(len(texts)), n_words)
    repeat = np.zeros(len(texts), np.int64)
    if len(words) > 2:
        with np.errstate(over="ignore"):
            m = np.uint64(0x9E3779B97F4A7C15)
            h = ((words[:-2] * m + words[1:-1]) * m + words[2:]) * m + owner[2:].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            h ^= h >> np.uint64(32)
        valid = owner[:-2] == owner[2:]
        s = np.sort(h[valid])
        twice = np.unique(s[1:][s[1:] == s[:-1]])
        if len(twice):
            at = np.searchsorted(twice, h)
            hit = valid & (twice[np.minimum(at, len(twice) - 1)] == h)
            covered = np.zeros(len(words), bool)
            for d in range(3):
                covered[d:len(words) - 2 + d] |= hit
            repeat = np.bincount(owner[covered], minlength=len(texts))
    return [n_words, chars, symbols, np.array(dup, np.int64), repeat]


def _score(held):
    """Base counts and log-perplexity of texts; without ``held`` the latter is 0."""
    def run(batches):
        import pyarrow as pa
        memo = _Ids()
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        with np.errstate(over="ignore"):
            for table in grouped_by_bytes(batches, "text", 4 << 20):
                texts = [t.encode("utf-8", "replace") for t in table.column("text").to_pylist()]
                langs = np.array(table.column("lang").to_pylist(), object)
                ppl = np.zeros(len(texts))
                for lang in sorted(set(langs)) if held else ():
                    at = np.array([i for i in np.flatnonzero(langs == lang) if texts[i]], np.int64)
                    if not len(at):
                        continue
                    keys, lengths = ngram_keys([texts[i] for i in at])
                    total = np.append(0, np.cumsum(log_probs(keys, lang, held.value), dtype=np.float64))
                    end = np.cumsum(lengths)
                    ppl[at] = -(total[end] - total[end - lengths]) / np.maximum(1, lengths)
                cols = [pa.array(c, pa.int64()) for c in base_counts(texts, memo)]
                size = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([*(table.column(x).combine_chunks() for x in ("doc_id", "rk", "lang")), *cols, size, pa.array(ppl)],
                                                 names=["doc_id", "rk", "lang", *names, "n_bytes", "log_perplexity"])
    return run


def _text_grams(batches):
    """The n-grams of each text and their counts."""
    import pyarrow as pa
    for b in batches:
        for rk, lang, text in zip(*(b.column(x).to_pylist() for x in ("rk", "lang", "text"))):
            grams, k = np.unique(ngram_keys([text.encode("utf-8", "replace")])[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), rk, np.int64)), pa.array([lang] * len(grams), pa.string()),
                                              pa.array(grams.astype(np.int64)), pa.array(k.astype(np.int64))], names=["rk", "lang", "gram", "k"])


def score(texts: DataFrame, model: DataFrame) -> DataFrame:
    """Stored: the base counts and the log-perplexity of every row of ``texts``
    (doc_id, rk, lang, text)."""
    spark = texts.sparkSession
    kind = texts.schema["doc_id"].dataType.simpleString()
    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    schema = f"doc_id {kind}, rk long, lang string, {counts}, n_bytes long, log_perplexity double"
    if model.count() <= HELD:
        return store(texts.mapInArrow(_score(spark.sparkContext.broadcast(arrays(model))), schema), "perplexity")
    grams = texts.dropDuplicates(["rk"]).select("rk", "lang", "text").mapInArrow(_text_grams, "rk long, lang string, gram long, k long")
    sums = grams.join(model.hint("shuffle_merge"), ["lang", "gram"]).groupBy("rk").agg(F.sum(F.col("k") * F.col("value")).alias("total"))
    each = F.coalesce(-F.col("total") / F.col("n_bytes"), F.lit(0.0))
    plain = texts.mapInArrow(_score(None), schema)
    return store(plain.join(sums, "rk", "left").withColumn("log_perplexity", each).drop("total"), "perplexity")


def bands(scored: DataFrame, spread: float = SPREAD) -> DataFrame:
    """lang, low, high: exact quartiles of the binned log-perplexities."""
    bins = scored.where("n_bytes > 0").groupBy("lang", F.floor(F.col("log_perplexity") / BIN).cast("long").alias("bin")).agg(F.count("*").alias("k"))
    up = Window.partitionBy("lang").orderBy("bin")
    share = bins.withColumn("part", F.sum("k").over(up) / F.sum("k").over(Window.partitionBy("lang")))
    q = share.groupBy("lang").agg(*[F.min(F.when(F.col("part") >= x, F.col("bin"))).alias(n) for x, n in ((0.25, "q1"), (0.75, "q3"))])
    room = (F.col("q3") + 1 - F.col("q1")) * BIN * spread              # bins are whole: up to the end of q3's
    return q.select("lang", (F.col("q1") * BIN - room).alias("low"), ((F.col("q3") + 1) * BIN + room).alias("high"))


def rejections(checked: DataFrame) -> DataFrame:
    """One row: documents, and those that pass the base rule but fail the band
    as too predictable or too surprising."""
    side = lambda c: F.sum((~F.col("base_failed") & c).cast("long"))
    return checked.agg(F.count("*").alias("documents"), side(F.col("log_perplexity") < F.col("low")).alias("too_predictable"),
                       side(F.col("log_perplexity") > F.col("high")).alias("too_surprising"))


def check_quality(docs: DataFrame) -> DataFrame:
    """The digest of op5, one row per document, with the log-perplexity per byte
    and the band it was held against."""
    model = fit(docs)
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    scored = score(docs.select("doc_id", row_hash(lang, "text", seed=5).alias("rk"), lang.alias("lang"), text_of().alias("text")), model)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    out = scored.join(bands(scored), "lang", "left").withColumn("base_failed", failed)
    inside = (F.col("log_perplexity") >= F.col("low")) & (F.col("log_perplexity") <= F.col("high"))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))) \
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity", "low", "high")
