"""Mixing sources to target weights by min-cost flow.

A document may belong to several sources. Documents are aggregated by their
membership pattern (the sorted set of their sources); the driver sees one
number per pattern. The flow routes each pattern's tokens to the quotas of its
sources; a first reading of a token costs nothing, each repetition costs more
than the one before (convex), so nothing is repeated that fresh text could
replace. Then each pattern's documents are laid out in a seeded order and taken
until the flow's amount is reached, once for each reading.

The order is two-level: ``BUCKETS`` hash buckets per pattern with summed sizes,
then the rows of a bucket, so a source with a third of all rows spreads over
many tasks. Text never moves unless the caller keeps it.

Defined results: null text counts 0 words and null sources are a source of
their own, last in order; documents without words are never taken; repeated
rows are separate documents that share an order position (ties by text hash);
an empty table gives no rows; other columns are carried untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm.common import row_hash, word_count
from tessera.llm.flow import Network

WEIGHTS = (5, 2, 1)       # fixed values of the contract, repeating over the sources in order
BUCKETS = 4096            # hash buckets of a pattern's order
MAX_PATTERNS = 200_000    # patterns the driver may hold (checked)


def target_shares(sizes: list[int], weights: list[float], total: float, cap: float = 2.0) -> list[float]:
    """Share ``total`` by weight; a share stops at cap * size, the excess is
    reshared by weight among the others until none is above."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while free:
        w = sum(weights[i] for i in free)
        full = {i for i in free if left * weights[i] / w >= cap * sizes[i]}
        if not full:
            for i in free:
                out[i] = left * weights[i] / w
            break
        for i in full:
            out[i] = float(cap * sizes[i])
        left -= sum(out[i] for i in full)
        free -= full
    return out


def route(patterns: dict[tuple, int], quotas: dict, repeats: int = 2) -> dict[tuple, list[dict]]:
    """Tokens of each pattern per reading and source: ``[{source: amount}]``,
    one dict per reading. Reading r costs r."""
    net, taps, arcs = Network(), {}, {}
    for p, size in patterns.items():
        for r in range(repeats):
            taps[p, r] = net.add("s", ("p", p), size, r)
        for q in p:
            arcs[p, q] = net.add(("p", p), ("q", q), size * repeats)
    for q, c in quotas.items():
        net.add(("q", q), "t", c)
    net.solve("s", "t")
    out = {}
    for p in patterns:
        owed = {q: net.flow_on(arcs[p, q]) for q in p}
        readings = []
        for r in range(repeats):
            left, got = net.flow_on(taps[p, r]), {}
            for q in p:
                if take := min(left, owed[q]):
                    got[q] = take
                    owed[q] -= take
                    left -= take
            readings.append(got)
        out[p] = readings
    return out


def mix(docs: DataFrame, sources: str, total_share: float = 1.5, cap: int = 2, weights=WEIGHTS,
        key: str = "doc_id", text: str = "text", seed: int = 6) -> DataFrame:
    """``docs`` with four columns more: ``mix_size``, ``mix_pattern`` (json of
    the sources), ``mix_taken`` (words taken, repeats counted) and
    ``mix_targets`` (target of each source of the pattern). ``sources`` names
    an array column of source names (null entries allowed)."""
    spark = docs.sparkSession
    # null sources become an entry that sorts last: ("1", ) after ("0", name)
    member = F.array_sort(F.array_distinct(F.transform(F.col(sources), lambda s: F.struct(
        s.isNull().alias("n"), F.coalesce(s.cast("string"), F.lit("")).alias("s")))))
    base = docs.withColumns({"mix_size": word_count(text), "mix_pattern": member,
                             "mix_h": row_hash(key, F.crc32(F.col(text).cast("binary")), seed=seed)})
    base = base.withColumn("mix_b", F.pmod("mix_h", F.lit(BUCKETS)).cast("int"))
    sums = base.groupBy("mix_pattern", "mix_b").agg(F.sum("mix_size").alias("mix_bucket"))
    per = sums.groupBy("mix_pattern").agg(F.sum("mix_bucket").alias("b")).limit(MAX_PATTERNS + 1).collect()
    if len(per) > MAX_PATTERNS:
        raise ValueError("more membership patterns than the driver may hold; coarsen the sources")
    patterns = {tuple((x["n"], x["s"]) for x in r["mix_pattern"] or []): r["b"] for r in per}
    names = sorted({q for p in patterns for q in p})
    size = {q: sum(b for p, b in patterns.items() if q in p) for q in names}
    shares = target_shares([size[q] for q in names], [weights[i % len(weights)] for i in range(len(names))],
                           total_share * sum(patterns.values()), cap)
    target = dict(zip(names, shares))
    readings = route(patterns, {q: round(target[q]) for q in names}, cap)

    kind = base.schema["mix_pattern"].dataType.simpleString()
    rows = [([list(q) for q in p], [sum(r.values()) for r in readings[p]], [target[q] for q in p],
             [size[q] for q in p]) for p in patterns]
    plan = spark.createDataFrame(rows, f"mix_pattern {kind}, mix_flow array<bigint>, mix_targets array<double>, mix_sizes array<bigint>")
    ahead = Window.partitionBy("mix_pattern").orderBy("mix_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("mix_before", F.coalesce(F.sum("mix_bucket").over(ahead), F.lit(0))) \
        .join(F.broadcast(plan), "mix_pattern").drop("mix_bucket")   # one row per pattern, checked above
    order = Window.partitionBy("mix_pattern", "mix_b").orderBy("mix_h", F.col(key).asc_nulls_last(), "mix_size") \
        .rowsBetween(Window.unboundedPreceding, -1)
    laid = base.withColumn("mix_in", F.coalesce(F.sum("mix_size").over(order), F.lit(0))) \
        .join(starts, ["mix_pattern", "mix_b"])
    begin = F.col("mix_before") + F.col("mix_in")
    laid = laid.withColumn("mix_taken", F.aggregate("mix_flow", F.lit(0).cast("bigint"), lambda a, f: a + F.greatest(
        F.lit(0).cast("bigint"), F.least(f - begin, F.col("mix_size")))))
    return laid.drop("mix_before", "mix_in", "mix_h", "mix_b", "mix_flow")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The digest of op6: doc_id, size, source_size, target, taken."""
    m = mix(docs.select("doc_id", "text", F.array(F.col("source")).alias("srcs")), "srcs")
    return m.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_sizes")[0].alias("source_size"),
                    F.col("mix_targets")[0].alias("target"), F.col("mix_taken").alias("taken"))


def repeated(docs: DataFrame) -> DataFrame:
    """The mix itself, in whole documents: each document as often as its taken
    words, rounded, fill it. Returns the columns of ``docs`` alone."""
    cols = docs.columns
    whole = F.struct(*[F.col(f"`{c}`") for c in cols]).alias("doc")
    m = mix(docs.select(F.col("doc_id").alias("k"), F.col("text").alias("t"), F.array(F.col("source")).alias("srcs"), whole),
            "srcs", key="k", text="t")
    times = F.when(F.col("mix_size") > 0, F.floor(F.col("mix_taken") / F.col("mix_size") + 0.5)).otherwise(0).cast("int")
    return m.select("doc", F.explode(F.array_repeat(F.lit(1), times))).select("doc.*")
