"""Line dedup by deletion neighbourhoods (edit distance of at most 1), with
DataFrame functions only.

A line goes if an earlier line of the corpus, in order of (doc_id, line_no),
equals it or is one edited character away; the earliest such line is named.

Deleting any one character of a long line gives as many variants as it has
characters, so a gate comes first: for each quarter of a line, the rest of the
line is hashed (a pair one edit apart agrees outside one quarter). Rests that
only one line has are dropped, and only a quarter whose rest is shared emits
its deletion variants. Cut points come from a length class that two lines of
lengths at most one apart share. Then

* lines that agree after deleting the character at the same place (one is a
  substitution of the other), and
* a line and those that become it by deleting one character

meet under one hashed key, and the least position under the key is taken: no
pairs are listed. The chosen pair is verified with the edit distance itself.
Groups are bounded by the alphabet and the line length. Equal lines, however
many, are combined by partial aggregates, and the gate's join has one row per
rest hash on one side, so Spark can split a hot rest.

Defined results: null texts have no lines; lines without a word are neither
removed nor matched; null doc_ids come after all others; rows that repeat a
doc_id continue as copies of the same place (the rows of one (doc_id, line_no)
stay or go together); long lines are compared whole; other columns are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.common import WORD, store, text_of

PARTS = 4                    # parts of a line of which one may differ
SEND_ROWS = 2_000_000        # gate survivors up to this many are broadcast, else joined by shuffle


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line and its 128-bit hash (h1, h2)."""
    rows = docs.select("doc_id", F.posexplode(F.split(text_of(), "\n", -1)).alias("line_no", "line"))
    return rows.where(F.col("line").rlike(WORD)).select(
        "doc_id", "line_no", "line", F.length("line").alias("n"), F.xxhash64(F.lit(1), "line").alias("h1"), F.xxhash64(F.lit(2), "line").alias("h2"))


def place(doc_id: str = "doc_id", line_no: str = "line_no") -> Column:
    return F.struct(F.col(doc_id).isNull().alias("last"), F.col(doc_id).alias("doc_id"), F.col(line_no).alias("line_no"))


def _cuts(size: Column) -> list[tuple[int, int, Column, Column]]:
    """(class kind, part, characters before it, characters after it)."""
    out = []
    for kind in (0, 1):
        least = F.floor((size + kind) / 2) * 2 - kind          # the shorter length of the class
        for q in range(PARTS):
            before = F.floor(least * q / PARTS).cast("int")
            after = (least - F.floor(least * (q + 1) / PARTS)).cast("int")
            out.append((kind, q, before, after))
    return out


def rests(line: Column, n: Column) -> Column:
    """Array of (key, before, after, kind) of the rests of a line of length n."""
    items = []
    for kind, q, before, after in _cuts(n):
        least = F.floor((n + kind) / 2)
        key = F.xxhash64(F.lit(kind), F.lit(q), least, F.substring(line, F.lit(1), before), F.lit("|"), F.substring(line, n - after + 1, after))
        items.append(F.struct(key.alias("key"), before.alias("before"), after.alias("after"), F.lit(kind).alias("kind")))
    return F.array(*items)


def shared_rests(lines: DataFrame) -> DataFrame:
    """Stored: (h1, h2, key) of rests that different lines share."""
    # the keys are computed once; both sides below read them from the stored table
    keyed = store(lines.select("h1", "h2", F.col("line"), "n").select("h1", "h2", rests(F.col("line"), F.col("n")).getField("key").alias("keys")), "keys")
    each = keyed.select("h1", "h2", F.explode("keys").alias("key"))
    live = each.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("key")
    return store(each.join(live, "key").distinct(), "rests")


def neighbours(lines: DataFrame, first: DataFrame) -> DataFrame:
    """h1, h2, keeper: the least place of another line one edit away."""
    shared = shared_rests(lines)
    alive = shared.groupBy("h1", "h2").agg(F.collect_set("key").alias("keys"))        # at most 2 * PARTS keys
    few = alive.count() <= SEND_ROWS
    names = alive.select("h1", "h2")
    texts = lines.select("h1", "h2", "line", "n").join(F.broadcast(names) if few else names, ["h1", "h2"], "left_semi")
    texts = texts.groupBy("h1", "h2").agg(F.first("line").alias("line"), F.first("n").alias("n"))
    texts = store(texts.join(alive, ["h1", "h2"]).join(first, ["h1", "h2"]), "candidates")

    part = texts.select("h1", "h2", "first", "n", "line",
                        F.explode(F.filter(rests(F.col("line"), F.col("n")), lambda r: F.array_contains(F.col("keys"), r.getField("key")))).alias("r"))
    part = part.select("h1", "h2", "first", "n", "r.key", "r.kind", F.substring("line", F.col("r.before") + 1, F.col("n") - F.col("r.before") - F.col("r.after")).alias("mid"))
    size = F.length("mid")
    cut = part.select("h1", "h2", "first", "n", "key", "kind", "mid", F.explode(F.when(size > 0, F.sequence(F.lit(1), size))).alias("i"))
    variant = F.concat(F.substring("mid", F.lit(1), F.col("i") - 1), F.substring("mid", F.col("i") + 1, size))
    cut = cut.select("h1", "h2", "first", "n", "key", "kind", "i", F.xxhash64("key", variant).alias("v"))
    # lines of equal length without their i-th character; the class kind 0 has all such pairs
    same = cut.where("kind = 0").select("h1", "h2", "first", F.xxhash64("v", "n", "i").alias("v"))
    least = F.min("first").over(Window.partitionBy("v"))
    by_substitution = same.withColumn("keeper", least).where("keeper <> first").select("h1", "h2", "keeper")
    # a line itself (whole) and the lines that become it by one deletion
    whole = part.select("h1", "h2", "first", F.xxhash64(F.xxhash64("key", "mid"), "n").alias("v"), F.lit(True).alias("whole"))
    less = cut.select("h1", "h2", "first", F.xxhash64("v", F.col("n") - 1).alias("v"), F.lit(False).alias("whole")).distinct()
    w = Window.partitionBy("v")
    both = whole.unionByName(less).withColumns({
        "shorter": F.min(F.when(F.col("whole"), F.col("first"))).over(w), "longer": F.min(F.when(~F.col("whole"), F.col("first"))).over(w)})
    by_length = both.withColumn("keeper", F.when(F.col("whole"), F.col("longer")).otherwise(F.col("shorter"))) \
        .where(F.col("keeper").isNotNull() & (F.col("keeper") < F.col("first"))).select("h1", "h2", "keeper")
    found = by_substitution.unionByName(by_length).groupBy("h1", "h2").agg(F.min("keeper").alias("keeper"))
    # verify the chosen pair
    text = texts.select("h1", "h2", "line")
    kept = texts.select(F.col("first").alias("keeper"), F.col("line").alias("kept_line"))
    return found.join(text, ["h1", "h2"]).join(kept, "keeper").where(F.levenshtein("line", "kept_line", 1) >= 0).select("h1", "h2", "keeper")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """One row per removed line: doc_id, line_no, first_doc_id, first_line_no."""
    lines = lines_of(docs)
    narrow = lines.select("h1", "h2", "doc_id", "line_no", place().alias("at"))
    first = store(narrow.groupBy("h1", "h2").agg(F.min("at").alias("first")), "first-lines")
    near = neighbours(lines, first)
    keep = first.join(near, ["h1", "h2"], "left").select("h1", "h2", F.least("first", F.coalesce("keeper", "first")).alias("keep"))
    gone = narrow.join(keep, ["h1", "h2"]).where(F.col("at") > F.col("keep"))
    return gone.select("doc_id", F.col("line_no").cast("int").alias("line_no"), F.col("keep.doc_id").alias("first_doc_id"),
                       F.col("keep.line_no").cast("int").alias("first_line_no"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the removed lines taken out of the text; all other columns
    as they were, whatever their names."""
    gone = repeated_lines(docs).groupBy("doc_id").agg(F.collect_set("line_no").alias("lines")).select(F.col("doc_id").alias("gone"), "lines")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = whole.join(gone, F.col("row.doc_id").eqNullSafe(F.col("gone")), "left")
    kept = F.filter(F.split(F.col("row.text"), "\n", -1), lambda x, i: ~F.array_contains(F.col("lines"), i))
    text = F.when(F.col("lines").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[(text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


# the same in DuckDB: distinct lines of nearly equal length that share a half, and a place at which
# one character makes them equal (DuckDB's own edit distance counts bytes, not characters)
ORACLE = r"""
WITH l AS (SELECT doc_id, (i - 1)::INT AS line_no, line FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
d AS (SELECT line, length(line) AS n, min({'doc_id': doc_id, 'line_no': line_no}) AS first FROM l GROUP BY line),
p AS (SELECT a.line, b.first AS keeper FROM d a JOIN d b ON b.n BETWEEN a.n - 1 AND a.n + 1 AND b.first < a.first
    AND (left(a.line, (least(a.n, b.n) // 2)::INT) = left(b.line, (least(a.n, b.n) // 2)::INT)
         OR right(a.line, (least(a.n, b.n) // 2)::INT) = right(b.line, (least(a.n, b.n) // 2)::INT))
    WHERE len(list_filter(range(0, least(a.n, b.n) + 1), lambda i: left(a.line, i) = left(b.line, i)
        AND right(a.line, a.n - i - (a.n >= b.n)::INT) = right(b.line, b.n - i - (b.n >= a.n)::INT))) > 0),
k AS (SELECT d.line, least(d.first, coalesce(min(p.keeper), d.first)) AS keep FROM d LEFT JOIN p ON p.line = d.line GROUP BY d.line, d.first)
SELECT l.doc_id, l.line_no, k.keep.doc_id AS first_doc_id, k.keep.line_no AS first_line_no
FROM l JOIN k ON k.line = l.line WHERE {'doc_id': l.doc_id, 'line_no': l.line_no} > k.keep
"""
