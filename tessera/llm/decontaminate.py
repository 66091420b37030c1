"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters tolerates k = floor(rate * m) edits. Cut into k + 1
pieces, any place in a document within k edits holds one piece unchanged. All
pieces go into one automaton; each exact hit names an item and a diagonal, and
Myers' bit-parallel distance decides on the window around it.

Both sides are compared after folding: A-Z to lower case, ASCII punctuation and
white space to single blanks. Items are a stated query set: they go to the
tasks in blocks of at most ``BLOCK_CHARS`` characters (one pass each), so the
broadcast is bounded however large the benchmark is. Documents don't move.

Defined results: null or empty texts and items match nothing; a very long text
is searched whole; repeated items and documents each report their own rows;
null ids are reported as null; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import row_hash, small_batches, text_of

RATE = 0.06                # edits per character of an item
BLOCK_CHARS = 4_000_000    # characters of the items in one broadcast
MATCHES = "doc_id {doc}, item_id {item}, distance int, first_char long, last_char long"

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def fold(text: str) -> str:
    return b" ".join(text.encode("utf-8", "replace").translate(_FOLD).split()).decode("utf-8", "replace")


def pieces(item: str, rate: float) -> list[tuple[int, str]]:
    """Offsets and texts of the budget + 1 pieces, lengths at most one apart."""
    n = int(rate * len(item)) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str, k: int) -> tuple[int, int] | None:
    """Least edit distance, at most k, of the pattern to any part of the text,
    and the end of the first such part; None if there is none."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = mask, 0, m, None
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & mask, mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
        if score <= k and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


def occurrences(text: str, hits, items, rate: float):
    """(item, distance, start, end) of the verified places in one folded text.
    ``hits`` yields (item, start the item would have); hits whose diagonals lie
    within the budget of each other share one verification."""
    by_item: dict[int, list[int]] = {}
    for i, at in hits:
        by_item.setdefault(i, []).append(at)
    for i, ats in by_item.items():
        item = items[i]
        k, m = int(rate * len(item)), len(item)
        ats.sort()
        groups = [[ats[0], ats[0]]]
        for a in ats[1:]:
            if a - groups[-1][1] <= k:
                groups[-1][1] = a
            else:
                groups.append([a, a])
        for lo, hi in groups:
            a, b = max(0, lo - k), min(len(text), hi + m + k)
            exact = text.find(item, a, b)
            if exact >= 0:
                yield i, 0, exact, exact + m
                continue
            if found := myers(item, text[a:b], k):
                yield i, found[0], max(0, a + found[1] - m), a + found[1]


def matcher(ids: list, items: list[str], rate: float, doc_type, item_type):
    """The mapInArrow function that finds the items of one block."""
    def run(batches):
        import ahocorasick
        import pyarrow as pa

        trie = ahocorasick.Automaton()
        for i, item in enumerate(items):
            for off, piece in pieces(item, rate):
                trie.get(piece, None) is None and trie.add_word(piece, [])
                trie.get(piece).append((i, off + len(piece) - 1))
        trie.make_automaton()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text = fold(text)
                hits = [(i, end - off) for end, found in trie.iter(text) for i, off in found]
                if hits:
                    for i, distance, a, b in occurrences(text, hits, items, rate):
                        for c, v in zip(out, (doc, ids[i], distance, a, b)):
                            c.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], batch.schema.field("doc_id").type), pa.array(out[1], item_type), pa.array(out[2], pa.int32()),
                 pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64())],
                names=["doc_id", "item_id", "distance", "first_char", "last_char"])
    return run


def find_items(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """One row per place: doc_id, item_id, distance, first_char, last_char (in
    the folded text). Overlapping places of one item are reported once."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    small_batches(spark)
    wide = benchmark.select("item_id", text_of().alias("text")).where(F.length("text") > 0)
    chars = wide.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = int(chars // BLOCK_CHARS) + 1
    wide = wide.withColumn("block", F.pmod(row_hash("item_id", "text", seed=10), F.lit(n_blocks)))
    schema = MATCHES.format(doc=docs.schema["doc_id"].dataType.simpleString(), item=wide.schema["item_id"].dataType.simpleString())
    item_type = to_arrow_type(wide.schema["item_id"].dataType)
    texts = docs.select("doc_id", text_of().alias("text"))
    out = None
    for b in range(n_blocks):
        rows = [(r["item_id"], f) for r in wide.where(F.col("block") == b).collect() if (f := fold(r["text"]))]
        if not rows:
            continue
        found = texts.mapInArrow(matcher([r[0] for r in rows], [r[1] for r in rows], rate, None, item_type), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """One row per (row of ``docs``, item): the least distance and the number of
    places. Repeated rows, and rows without a doc_id, each report their own."""
    row = F.struct("doc_id", F.monotonically_increasing_id().alias("rk")).alias("doc_id")
    return find_items(docs.select(row, "text"), benchmark, rate).groupBy("doc_id", "item_id").agg(
        F.min("distance").alias("distance"), F.count("*").alias("places"), F.min("first_char").alias("first_char")) \
        .select("doc_id.doc_id", "item_id", "distance", "places", "first_char")


def clean_documents(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` without any item; all columns as they were, whatever
    their names. Rows are told apart by doc_id and text, so equal ids with other
    texts stay."""
    key = row_hash("doc_id", "text", seed=10)
    marked = find_items(docs.select(key.alias("doc_id"), "text"), benchmark, rate).select(F.col("doc_id").alias("gone")).distinct()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"))
    return whole.join(marked, F.col("key") == F.col("gone"), "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
