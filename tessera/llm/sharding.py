"""Minimum-cost-flow resharding.

From the bytes that each old shard holds and the capacities of the new ones, a
min-cost flow says how many bytes go from shard i to shard j so that the fewest
bytes move. Rows hash into blocks, blocks into files. Each donor gives away
whole files while they fit into what it owes, and breaks up as few further
files as needed into blocks. Only files that lose blocks, and shards that
receive them, are written; the rows of the other files stay where they are.

The driver sees one number per (old shard, block): at most
``n_old * BLOCKS`` rows, whatever the input's size. Rows move once.

Defined results: null text counts 0 bytes (size 1, crc 0); null doc_id is a
value like any other; repeated rows are kept, each with a slot of its own; an
empty table gives no rows; columns beyond those named are ignored here, and
are carried through untouched by ``reshard(keep_columns=...)``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.common import row_hash, shared_folder, text_of
from tessera.llm.flow import Network

BLOCKS = 1024          # blocks of an old shard
FILE_BLOCKS = 64       # blocks of a file


def even_capacities(total: int, n: int) -> list[int]:
    return [total // n + (i < total % n) for i in range(n)]


def transfers(old_bytes: list[int], capacities: list[int], cost=None) -> dict[tuple[int, int], int]:
    """Bytes from old shard i to new shard j, the moved bytes (or their cost)
    as few as possible. ``cost(i, j)`` defaults to 0 for i = j, else 1."""
    cost = cost or (lambda i, j: int(i != j))
    net, arcs = Network(), {}
    for i, b in enumerate(old_bytes):
        net.add("s", ("old", i), b)
        for j in range(len(capacities)):
            arcs[i, j] = net.add(("old", i), ("new", j), b, cost(i, j))
    for j, c in enumerate(capacities):
        net.add(("new", j), "t", c)
    flow, _ = net.solve("s", "t")
    if flow != sum(old_bytes):
        raise ValueError("the capacities hold fewer bytes than the old shards")
    return {k: net.flow_on(e) for k, e in arcs.items() if net.flow_on(e)}


def assign_blocks(blocks: dict[tuple[int, int], int], flows: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
    """New shard of each (old shard, block): whole files first, then the blocks
    of as few files as needed, largest first, each to where most is still owed."""
    out: dict[tuple[int, int], int] = {}
    for i in sorted({i for i, _ in blocks}):
        owed = {j: b for (a, j), b in flows.items() if a == i and j != i}
        files: dict[int, list[int]] = {}
        for (a, b) in sorted(k for k in blocks if k[0] == i):
            files.setdefault(b // FILE_BLOCKS, []).append(b)
        size = {f: sum(blocks[i, b] for b in bs) for f, bs in files.items()}
        left = []
        for f in sorted(files, reverse=True):
            j = max(owed, key=lambda j: (owed[j], -j), default=None)
            if j is not None and size[f] <= owed[j]:
                owed[j] -= size[f]
                out.update({(i, b): j for b in files[f]})
            else:
                left.append(f)
        need, broken = sum(owed.values()), []
        for f in left:
            if need > 0:
                need -= size[f]
                broken.append(f)
            else:
                out.update({(i, b): i for b in files[f]})
        owed[i] = sum(size[f] for f in broken) - sum(owed.values())
        for b in sorted((b for f in broken for b in files[f]), key=lambda b: (-blocks[i, b], b)):
            j = max(owed, key=lambda j: (owed[j], j == i, -j))
            owed[j] -= blocks[i, b]
            out[i, b] = j
    return out


def level(blocks: dict, placed: dict, capacities: list[int], rounds: int = 4096) -> dict:
    """Blocks can't be cut, so totals miss the capacities by parts of a block:
    move single blocks from the fullest to the emptiest shard while that helps."""
    held: dict[int, list] = {j: [] for j in range(len(capacities))}
    over = {j: -c for j, c in enumerate(capacities)}
    for k, j in placed.items():
        held[j].append(k)
        over[j] += blocks[k]
    for _ in range(rounds):
        a, b = max(over, key=lambda j: (over[j], -j)), min(over, key=lambda j: (over[j], j))
        half = (over[a] - over[b]) / 2
        k = min(held[a], key=lambda k: (abs(blocks[k] - half), k), default=None)
        if k is None or not 0 < blocks[k] < 2 * half:
            break
        held[a].remove(k)
        held[b].append(k)
        over[a] -= blocks[k]
        over[b] += blocks[k]
        placed[k] = b
    return placed


@dataclass
class Resharded:
    rows: DataFrame                # every row with its new place, from the files
    moved_bytes: int
    affected_files: int
    path: str | None               # the folder of rewritten files, by shard


def doc_size(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("bigint")


def reshard(docs: DataFrame, old_shard: Column, n_old: int, capacities=None, n_new: int | None = None,
            text: str = "text", key: str = "doc_id", keep_columns: tuple = (), cost=None) -> Resharded:
    """Place all rows into ``n_new`` shards. ``rows`` holds key, text columns
    named ``doc_id size text_crc32 old_shard shard slot`` and ``keep_columns``
    (as a struct ``kept``). Slots of a shard run from 0 without a gap, in order
    of (old shard, block, key, crc)."""
    spark = docs.sparkSession
    base = docs.select(
        F.col(key).alias("doc_id"), F.col(text).alias("body"), doc_size(text).alias("size"),
        F.crc32(text_of(text).cast("binary")).alias("text_crc32"), old_shard.cast("int").alias("old_shard"),
        F.pmod(row_hash(key, text, seed=11), F.lit(BLOCKS)).cast("int").alias("block"),
        F.struct(F.lit(0).alias("_"), *[F.col(c) for c in keep_columns]).alias("kept"))
    found = base.groupBy("old_shard", "block").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    blocks = {(r["old_shard"], r["block"]): r["b"] for r in found}
    counts = {(r["old_shard"], r["block"]): r["n"] for r in found}
    old_bytes = [sum(b for (i, _), b in blocks.items() if i == o) for o in range(n_old)]
    capacities = list(capacities) if capacities is not None else even_capacities(sum(old_bytes), n_new or n_old)
    flows = transfers(old_bytes, capacities, cost)
    placed = level(blocks, assign_blocks(blocks, flows), capacities)

    file_of = lambda k: (k[0], k[1] // FILE_BLOCKS)
    affected = {file_of(k) for k, j in placed.items() if j != k[0]}
    start, plan = {}, []
    for k in sorted(placed):
        j = placed[k]
        plan.append((k[0], k[1], j, start.get(j, 0), file_of(k) in affected))
        start[j] = start.get(j, 0) + counts[k]
    # one row per block: bounded by n_old * BLOCKS
    plan_df = spark.createDataFrame(plan, "old_shard int, block int, shard int, first long, rewrite boolean")
    dealt = base.join(F.broadcast(plan_df), ["old_shard", "block"])
    in_block = Window.partitionBy("old_shard", "block").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    slot = (F.col("first") + F.row_number().over(in_block) - 1).cast("bigint").alias("slot")
    cols = ["doc_id", "size", "text_crc32", "old_shard", "shard"]

    path = None
    stay = dealt.where(~F.col("rewrite")).select(*cols, slot, "kept")
    if affected:
        path = shared_folder(spark, "shards")
        dealt.where("rewrite").select("doc_id", "body", "old_shard", "shard", slot, "kept") \
            .write.partitionBy("shard").parquet(path)
        back = spark.read.schema("doc_id %s, body string, old_shard int, slot long, kept %s, shard int" % (
            base.schema["doc_id"].dataType.simpleString(), base.schema["kept"].dataType.simpleString())).parquet(path)
        back = back.select("doc_id", doc_size("body").alias("size"), F.crc32(text_of("body").cast("binary")).alias("text_crc32"),
                           "old_shard", "shard", "slot", "kept")
        rows = back.unionByName(stay)
    else:
        rows = stay
    moved = sum(blocks[k] for k, j in placed.items() if j != k[0])
    return Resharded(rows, moved, len(affected), path)


def shard_of_source(n_old: int, column: str = "source") -> Column:
    """The old layout of the documents table: its sources, dealt to shards."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n_old)).cast("int")


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """The digest of op1: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    r = reshard(docs, shard_of_source(n_shards), n_shards, n_new=n_shards).rows
    return r.select("doc_id", "size", F.col("text_crc32").cast("bigint").alias("text_crc32"), F.lit("bytes").alias("law"),
                    "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
