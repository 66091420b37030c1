"""Operator 13: phrase collocations from FM-indexes over word ids.

Every task packs its texts into shards of about ``SHARD_WORDS`` words and keeps
of each shard an FM-index over local word ids (the Burrows-Wheeler transform of
the word sequence, in an order of suffixes by their first ``DEPTH`` words, which
is all that phrases of that depth need; a 0 ends every piece). The indexes are a
table in the shared folder. From them the phrases are enumerated level by level:

* an interval of rows is a phrase, its length the phrase's count in the shard;
* the extension to the left by a word is a backward step (psi is the inverse of
  the LF mapping), the extension to the right a part of the interval; all
  intervals of a level are extended together, so every longer phrase is known as
  a left extension of its tail and as a right extension of its head;
* only intervals whose phrase may be frequent are extended: a bitmap of the
  frequent phrases of the level before (a bound of ``MAX_BITS`` bits whatever
  the data; a false hit costs a row, never a result);
* of the levels in ``SKETCHED``, where most such phrases are rare, tasks first
  send the counts of hash buckets (at most ``MAX_BUCKETS``, cut off at the
  least count); a phrase in a bucket below it isn't frequent and makes no row
  (a bucket that others fill costs a row, never a result);
* tasks add up their shards' counts of a level; Spark sums the tasks' and keeps
  what is frequent in all.

No shard decides anything alone, so how rows fall into shards has no influence.
A phrase carries the counts of all its heads and tails, taken from the frequent
phrases one word shorter (all parts of a frequent phrase are frequent). A word
is a 64-bit hash of language and word inside the job; that no frequent word
shares its hash with another word is checked, and another seed taken if one
does, so counts are exact."""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.common import store, text_of

DEPTH = 5                # words of the longest phrase
SHARD_WORDS = 2_000_000  # words (and piece ends) of one index, about 100 MB while it is built
MAX_BITS = 1 << 28       # bits of a bitmap: 32 MB at most
SKETCHED = (3,)          # levels whose rare phrases are left out by bucket
MAX_BUCKETS = 1 << 24    # counts of a task's buckets: 64 MB at most
BLOCK = 1 << 16          # buckets in a row that a task sends
HELD = 1 << 21           # phrases of several shards that a task adds up at once
BREAKS = ".,;:!?\n\v\f\r"
TOKENS = re.compile(r"[^\x20\x09.,;:!?\x0A-\x0D]+|[.,;:!?\x0A-\x0D]").findall
LOWER = {c: c + 32 for c in range(65, 91)}   # A-Z alone
BUCKET = 15              # log2 of the positions in a row of a bitmap


class _Ids(dict):
    """Raw token -> local id of its lower-case form; breaks are 0."""

    def __init__(self, lang: str, words: list[str]):
        super().__init__({c: 0 for c in BREAKS})
        self.lang, self.words = lang, words

    def __missing__(self, raw):
        low = raw.translate(LOWER)
        if low != raw:
            got = self[low]
        else:
            self.words.append(f"{self.lang}\t{raw}")
            got = len(self.words)
        self[raw] = got
        return got


def bwt_of(seq: np.ndarray) -> np.ndarray:
    """The words before the suffixes of ``seq``, suffixes ordered by their first
    ``DEPTH`` words (prefix doubling, then one step to the odd length)."""
    n = len(seq)
    rank, order = seq.astype(np.int64), None
    length = 1
    while length < DEPTH:
        step = min(length, DEPTH - length)
        key = rank * (int(rank.max()) + 1)
        key[:n - step] += rank[step:]
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        length += step
    return seq[order - 1]


INDEX = "words binary, bwt binary, totals map<string,bigint>"


def _index_texts(shard_words: int):
    """Arrow batches of (lang, text) -> one row per shard: its words by local id
    (JSON) and its transform, both packed, and the words of each language."""
    def run(batches):
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        end = np.zeros(1, np.int32)
        words, ids, totals, parts, held = [], {}, {}, [], 0

        def index():
            bwt = bwt_of(np.concatenate(parts))
            return pa.RecordBatch.from_arrays(
                [pa.array([pack(json.dumps(words).encode())], pa.binary()), pa.array([pack(bwt.tobytes())], pa.binary()),
                 pa.array([list(totals.items())], pa.map_(pa.string(), pa.int64()))], names=["words", "bwt", "totals"])

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                of = ids.get(lang)
                if of is None:
                    of = ids[lang] = _Ids(lang, words)
                seq = np.fromiter(map(of.__getitem__, TOKENS(text)), np.int32)
                n = int(np.count_nonzero(seq))
                if not n:
                    continue
                totals[lang] = totals.get(lang, 0) + n
                parts += [seq, end]
                held += len(seq) + 1
                if held >= shard_words:
                    yield index()
                    words, ids, totals, parts, held = [], {}, {}, [], 0
        if held:
            yield index()
    return run


class FmIndex:
    """The intervals of one shard. ``row_node[j]`` is the phrase of row j at the
    present level, -1 where it isn't extended."""

    def __init__(self, bwt: np.ndarray, n_words: int):
        self.psi = np.argsort(bwt, kind="stable")       # row of the rest of row j's suffix
        self.first = bwt[self.psi]                      # first word of row j's suffix
        self.counts = np.bincount(bwt, minlength=n_words + 1)
        at = np.concatenate(([0], np.cumsum(self.counts)))
        self.lo, self.size = at[1:-1], self.counts[1:]  # words 1..n: the intervals of level 1
        self.row_node = np.where(self.first > 0, self.first - 1, -1)
        self.level = 1

    def extend(self, keep: np.ndarray) -> None:
        """Go to the next level from the phrases marked in ``keep``. A row's
        phrase becomes (first word, phrase of the rest); it stays if its head
        and its tail are both kept."""
        kept = np.append(keep, False)                   # node -1
        head, tail = self.row_node, self.row_node[self.psi]
        open_ = kept[head] & kept[tail]
        # rows of one phrase are neighbours: equal heads, equal tails
        new = np.ones(len(head), bool)
        new[1:] = (tail[1:] != tail[:-1]) | (head[1:] != head[:-1]) | (open_[1:] != open_[:-1])
        starts = np.flatnonzero(new & open_)
        ends = np.append(np.flatnonzero(new), len(head))
        self.lo = starts
        self.size = ends[np.searchsorted(ends, starts, "right")] - starts
        node = np.cumsum(new & open_) - 1
        self.row_node = np.where(open_, node, -1)
        self.level += 1

    def phrases(self) -> list[np.ndarray]:
        """The local word ids of the level's phrases, one array per place."""
        row, out = self.lo, []
        for _ in range(self.level):
            out.append(self.first[row])
            row = self.psi[row]
        return out


def word_hashes(words: list[str], seed: int) -> np.ndarray:
    import xxhash
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8"), seed) for w in words), np.uint64, len(words))


def _mixed(hashes: list[np.ndarray]) -> np.ndarray:
    out = hashes[0]
    for h in hashes[1:]:
        out = ((out << np.uint64(11)) | (out >> np.uint64(53))) ^ h
    return out


def _mixed_column(cols: list[str]) -> Column:
    """The same mix as a column expression."""
    out = F.col(cols[0])
    for c in cols[1:]:
        out = F.shiftleft(out, 11).bitwiseOR(F.shiftrightunsigned(out, 53)).bitwiseXOR(F.col(c))
    return out


def _holds(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes & np.uint64(len(bitmap) * 8 - 1)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _count_words(seed: int):
    def run(batches):
        import pyarrow as pa

        for words, bwt in _stored(batches):
            counts = np.bincount(bwt, minlength=len(words) + 1)[1:]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(word_hashes(words, seed).view(np.int64)), pa.array(counts)],
                                             names=["word", "w1", "c"])
    return run


def _phrases(batches, seed: int, bitmaps):
    """Of every stored shard: the level's phrases as hashes of their words, one
    array per place, and their counts."""
    for words, bwt in _stored(batches):
        hashes = np.append(np.uint64(0), word_hashes(words, seed))
        fm = FmIndex(bwt, len(words))
        for shared in bitmaps:
            fm.extend(_holds(np.frombuffer(shared.value, np.uint8), _mixed([hashes[p] for p in fm.phrases()])))
        yield [hashes[p] for p in fm.phrases()], fm.size


def _count_buckets(seed: int, bitmaps, buckets: int, least: int):
    """Per task: the level's phrases by bucket, cut off at ``least``, in blocks."""
    def run(batches):
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        total = None
        for phrases, size in _phrases(batches, seed, bitmaps):
            if total is None:
                total = np.zeros(buckets, np.int32)
            np.add.at(total, (_mixed(phrases) & np.uint64(buckets - 1)).astype(np.intp), size.astype(np.int32))
            np.minimum(total, least, out=total)
        for a in range(0, buckets if total is not None else 0, BLOCK):
            part = total[a:a + BLOCK].astype(np.min_scalar_type(least))
            if part.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([a // BLOCK], pa.int32()), "counts": pa.array([pack(part.tobytes())], pa.binary())})
    return run


def _full_buckets(least: int):
    """Bits of a block: the buckets that reach ``least`` over all tasks."""
    def run(key, table):
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        total = sum(np.frombuffer(unpack(c.as_py()), np.min_scalar_type(least)).astype(np.int64) for c in table.column("counts"))
        bits = np.packbits(total >= least, bitorder="little").tobytes()
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([bits], pa.binary())})
    return run


def _sketch(index: DataFrame, seed: int, bitmaps, occurrences: int, least: int):
    """Broadcast bits of the buckets that may hold a frequent phrase, about one
    for 8 ``occurrences`` of the shorter phrases; the driver gets the bits only."""
    buckets = min(MAX_BUCKETS, 1 << max(20, (occurrences // 8).bit_length()))
    rows = (index.select("words", "bwt").mapInArrow(_count_buckets(seed, bitmaps, buckets, least), "block int, counts binary")
            .groupBy("block").applyInArrow(_full_buckets(least), "block int, bits binary").collect())
    out = bytearray(buckets // 8)
    for r in rows:
        out[r["block"] * BLOCK // 8:(r["block"] + 1) * BLOCK // 8] = r["bits"]
    return index.sparkSession.sparkContext.broadcast(bytes(out))


def _count_phrases(level: int, seed: int, bitmaps, sketch=None):
    """Counts of a level's phrases in the stored shards of a task, without those
    that ``sketch`` rules out."""
    def run(batches):
        import pyarrow as pa

        def added():
            table = pa.concat_tables(held)
            return table.to_batches() if len(held) == 1 else \
                table.group_by(_keys(level), use_threads=False).aggregate([("c", "sum")]).rename_columns(_keys(level) + ["c"]).to_batches()

        held, n = [], 0
        for phrases, size in _phrases(batches, seed, bitmaps):
            if sketch is not None:
                kept = _holds(np.frombuffer(sketch.value, np.uint8), _mixed(phrases))
                phrases, size = [p[kept] for p in phrases], size[kept]
            held.append(pa.table([pa.array(p.view(np.int64)) for p in phrases] + [pa.array(size.astype(np.int64))], names=_keys(level) + ["c"]))
            n += len(size)
            if n >= HELD:
                yield from added()
                held, n = [], 0
        if held:
            yield from added()
    return run


def _stored(batches):
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for b in batches:
        for i in range(b.num_rows):
            yield json.loads(unpack(b.column("words")[i].as_py())), np.frombuffer(unpack(b.column("bwt")[i].as_py()), np.int32)


def _keys(level: int) -> list[str]:
    return [f"w{i}" for i in range(1, level + 1)]


def _bitmap(phrases: DataFrame, level: int, count: int):
    """Broadcast bits of the phrases' hashes: 16 a phrase as long as that is no
    more than ``MAX_BITS``. The driver gets the finished bytes only."""
    bits = min(MAX_BITS, 1 << max(20, (16 * count).bit_length()))
    place = _mixed_column(_keys(level)).bitwiseAND(F.lit(bits - 1))
    rows = (phrases.select(place.alias("at"))
            .groupBy(F.shiftright("at", BUCKET).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit((1 << BUCKET) - 1))).alias("bits")).collect())
    out = bytearray(bits // 8)
    for r in rows:
        at = r["bucket"] << (BUCKET - 3)
        out[at:at + (1 << (BUCKET - 3))] = r["bits"]
    return phrases.sparkSession.sparkContext.broadcast(bytes(out))


def _frequent_words(index: DataFrame, least: int) -> tuple[DataFrame, int]:
    """``(w1, lang, phrase, a, heads, tails)`` of the frequent words, and the
    seed under which none of them shares its hash with another word."""
    stored, seed = index.select("words", "bwt"), 0
    while True:
        counts = (stored.mapInArrow(_count_words(seed), "word string, w1 long, c long")
                  .groupBy("w1", "word").agg(F.sum("c").alias("a")))
        clash = counts.groupBy("w1").agg(F.count(F.lit(1)).alias("k"), F.max("a").alias("a")).where((F.col("k") > 1) & (F.col("a") >= least))
        if clash.isEmpty():
            break
        seed += 1
    # words hold no tab, so the last one ends the language
    found = counts.where(F.col("a") >= least).select(
        "w1", F.regexp_extract("word", r"(?s)^(.*)\t", 1).alias("lang"), F.substring_index("word", "\t", -1).alias("phrase"), "a",
        F.array("a").alias("heads"), F.array("a").alias("tails"))
    return store(found, "collocation-words"), seed


def _with_parts(counts: DataFrame, shorter: DataFrame, level: int) -> DataFrame:
    """Frequent phrases with what their head and tail carry."""
    keys = _keys(level)
    head = shorter.select(*[F.col(k) for k in keys[:-1]], "lang", F.col("phrase").alias("_front"), F.col("heads").alias("_heads"))
    tail = shorter.select(*[F.col(k).alias(f"w{i + 2}") for i, k in enumerate(keys[:-1])], F.col("tails").alias("_tails"),
                          F.substring_index("phrase", " ", -1).alias("_last"))
    return (counts.join(head, keys[:-1]).join(tail, keys[1:])
            .select(*keys, "lang", F.concat_ws(" ", "_front", "_last").alias("phrase"), "a",
                    F.array_append("_heads", F.col("a")).alias("heads"), F.array_append("_tails", F.col("a")).alias("tails")))


def frequent_phrases(docs: DataFrame, least: int = 100, depth: int = DEPTH, shard_words: int = SHARD_WORDS) -> tuple[list[DataFrame], DataFrame]:
    """The frequent phrases of every length, as ``(w1.., lang, phrase, a, heads,
    tails)`` (``heads[i]``: count of the first i + 1 words, ``tails[i]`` of the
    last i + 1), and the index table they came from."""
    if not 2 <= depth <= DEPTH:
        raise ValueError(f"depth must be 2 to {DEPTH}")
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text"))
    index = store(texts.mapInArrow(_index_texts(shard_words), INDEX), "collocation-index")
    words, seed = _frequent_words(index, least)
    levels, bitmaps = [words], []
    for level in range(2, depth + 1):
        known, occurrences = levels[-1].agg(F.count(F.lit(1)), F.sum("a")).first()
        if not known:
            break
        bitmaps.append(_bitmap(levels[-1], level - 1, known))
        keys = _keys(level)
        sketch = _sketch(index, seed, bitmaps, occurrences, least) if level in SKETCHED else None
        counts = (index.select("words", "bwt").mapInArrow(_count_phrases(level, seed, bitmaps, sketch), ", ".join(f"{k} long" for k in keys) + ", c long")
                  .groupBy(*keys).agg(F.sum("c").alias("a")).where(F.col("a") >= least))
        levels.append(store(_with_parts(counts, levels[-1], level), f"collocation-{level}"))
    return levels, index


def _not_covered(level: int, phrases: DataFrame, longer: DataFrame | None, percent: int) -> DataFrame:
    """Phrases without an extension by one word that has ``percent`` of their
    count. (A phrase that contains one at more words' distance counts no more
    than the extension between them.)"""
    if longer is None:
        return phrases
    keys = _keys(level)
    parts = longer.select(*keys, "a").unionByName(longer.select(*[F.col(f"w{i + 1}").alias(f"w{i}") for i in range(1, level + 1)], "a"))
    most = parts.groupBy(*keys).agg(F.max("a").alias("_most"))
    return (phrases.join(most, keys, "left")
            .where(100 * F.coalesce("_most", F.lit(0)) < percent * F.col("a")).drop("_most"))


def _cut(a: Column, n: Column, heads: Column, tails: Column, level: int) -> Column:
    """The lowest-scoring cut: struct(score, k, l, r), ties to the smallest k.
    Decimals of 38 digits hold the products; the quotient is exact."""
    def whole(c):
        return c.cast("decimal(18,0)")

    cuts = []
    for k in range(1, level):
        left, right = heads[k - 1], tails[level - k - 1]
        # l * r may pass 64 bits; so may 1000 * a * n
        score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * whole(a) * n.cast("decimal(16,0)"), whole(left) * whole(right))
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    return F.least(*cuts) if len(cuts) > 1 else cuts[0]


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, percent: int = 100, depth: int = DEPTH,
                 shard_words: int = SHARD_WORDS) -> DataFrame:
    """The best phrases of 2 to ``depth`` words of every language: ``(lang,
    rank, phrase, a, l, r, n, score)``.

    Null text counts as empty, null lang as ``und``; repeated rows count each
    time; other columns don't matter. Ties in the score go to the higher count,
    then to the phrase in byte order. A table without a frequent phrase gives
    no rows. Texts of any length are indexed whole."""
    levels, index = frequent_phrases(docs, least, depth, shard_words)
    n = index.select(F.explode("totals").alias("lang", "c")).groupBy("lang").agg(F.sum("c").alias("n"))
    scored = None
    for i, phrases in enumerate(levels[1:], 2):
        left = _not_covered(i, phrases, levels[i] if i < len(levels) else None, percent).join(n, "lang")
        cut = _cut(F.col("a"), F.col("n"), F.col("heads"), F.col("tails"), i)
        rows = left.select("lang", "phrase", "a", "n", cut.alias("cut")).select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"),
                                                                                "n", F.col("cut.score").alias("score"))
        scored = rows if scored is None else scored.unionByName(rows)
    if scored is None:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


def _oracle() -> str:
    """The same phrases by plain counting of every n-gram."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    grams = " UNION ALL ".join(
        f"SELECT lang, w[i:i + {k - 1}] AS g, count(*)::BIGINT AS f FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM pieces "
        f"WHERE len(w) >= {k}) GROUP BY lang, w[i:i + {k - 1}]" + (" HAVING count(*) >= 100" if k > 1 else "") for k in range(1, DEPTH + 1))
    return f"""
WITH cut AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({lower}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM cut),
grams AS ({grams}),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE len(g) = 1 GROUP BY lang),
longer AS (SELECT lang, part, max(f) AS most FROM (
  SELECT lang, g[1:len(g) - 1] AS part, f FROM grams WHERE len(g) > 2 UNION ALL SELECT lang, g[2:] AS part, f FROM grams WHERE len(g) > 2)
  GROUP BY lang, part),
kept AS (SELECT x.lang, x.g, x.f FROM grams x LEFT JOIN longer y ON y.lang = x.lang AND y.part = x.g
  WHERE len(x.g) > 1 AND (y.most IS NULL OR y.most < x.f)),
cuts AS (SELECT lang, g, f, unnest(range(1, len(g))) AS k FROM kept),
scored AS (SELECT c.lang, c.g, c.f, c.k, l.f AS l, r.f AS r, t.n, (1000::HUGEINT * c.f * t.n) // (l.f::HUGEINT * r.f) AS score
  FROM cuts c JOIN grams l ON l.lang = c.lang AND l.g = c.g[1:c.k] JOIN grams r ON r.lang = c.lang AND r.g = c.g[c.k + 1:] JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
ranked AS (SELECT *, array_to_string(g, ' ') AS phrase FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, phrase)::BIGINT AS rank, phrase, f AS a, l, r, n, score::BIGINT AS score FROM ranked)
WHERE rank <= 2000"""


ORACLE = _oracle()
