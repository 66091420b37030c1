"""Offsets, fixed-size blocks, shifted pairs, overflow chunks.

W1 (running start offset in order-key order) is a two-level prefix sum: rows
are cut into segments that are contiguous ranges of the order key; a
partial/final aggregate gives the segment totals (one row per segment), a small
window over them the segment starts, and one window per segment the
in-segment offsets. No window ever runs over a whole split in one task; for
lines the segments are sampled key ranges, so none holds more than its share
of rows whatever the document sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tessera.config import Params
from tessera.session import cut_lineage

UNB = Window.unboundedPreceding
UNF = Window.unboundedFollowing


def exclusive_prefix_sum(df: DataFrame, value: str, part_cols, order_cols, seg_col: str,
                         out: str = "start") -> tuple[DataFrame, DataFrame]:
    """Returns ``(df + out, totals)`` where ``out`` = sum of ``value`` over all
    earlier rows of the same ``part_cols`` in ``(seg_col, *order_cols)`` order and
    ``totals`` = ``(*part_cols, n_total)``."""
    part_cols, order_cols = list(part_cols), list(order_cols)
    # segment totals: a partial/final hash aggregate, one row per segment
    segs = df.groupBy(*part_cols, seg_col).agg(F.sum(value).alias("_segtot"))
    ws = Window.partitionBy(*part_cols).orderBy(seg_col).rowsBetween(UNB, -1)
    segs = segs.withColumn("_segstart", F.coalesce(F.sum("_segtot").over(ws), F.lit(0)))
    # in-segment running sum: one window per segment (never a whole split)
    w = Window.partitionBy(*part_cols, seg_col).orderBy(*order_cols).rowsBetween(UNB, -1)
    x = df.withColumn("_run", F.coalesce(F.sum(value).over(w), F.lit(0)))
    res = (x.join(segs.select(*part_cols, seg_col, "_segstart"), [*part_cols, seg_col])
           .withColumn(out, (F.col("_segstart") + F.col("_run")).cast("bigint"))
           .drop("_run", "_segstart"))
    totals = segs.groupBy(*part_cols).agg(F.sum("_segtot").cast("bigint").alias("n_total"))
    return res, totals


def line_starts(lines: DataFrame, ranges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """W1 on lines with a ``len`` column: ``(split, doc_id, line_no, line_start)``
    and the split totals ``(split, n_total)``.

    Segments come from range partitioning the narrow ``(split, doc_id,
    line_no, len)`` table: Spark samples the order key and cuts it into
    ``ranges`` contiguous, evenly filled ranges, splitting even a document that
    holds a third of all lines. The range id is pinned by a reliable checkpoint
    of the narrow table (a few bytes per line), then the two-level prefix sum
    runs per range."""
    spark = lines.sparkSession
    n = ranges or max(spark.sparkContext.defaultParallelism, lines.rdd.getNumPartitions())
    narrow = (lines.select("split", "doc_id", "line_no", "len")
              .repartitionByRange(n, "split", "doc_id", "line_no")
              .withColumn("_seg", F.spark_partition_id()))
    narrow = cut_lineage(narrow)
    offs, totals = exclusive_prefix_sum(narrow, "len", ["split"], ["doc_id", "line_no"], "_seg",
                                        out="line_start")
    return offs.select("split", "doc_id", "line_no", "line_start"), totals


def with_starts(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """The offsets joined back to line rows on their line key (no hot key). A
    shuffle (merge) join on purpose: it leaves the rows clustered by line, so
    per-line work downstream needs no further shuffle."""
    return lines.join(starts.hint("merge"), ["split", "doc_id", "line_no"])


def line_offsets(lines: DataFrame, params: Params = Params(),
                 ranges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """W1 on lines with a ``len`` column: the rows with ``line_start``, and the
    split totals ``(split, n_total)``."""
    starts, totals = line_starts(lines, ranges)
    return with_starts(lines, starts), totals


def keep_block(block_id, n_total, block_size: int, drop_rule: str = "reference"):
    """W2 rule. ``reference``: block starts 0, B, 2B, ... strictly below N - B
    (so max(0, ceil(N/B) - 1) blocks; an exact multiple of B loses its last full
    block). ``full``: every complete block."""
    start = block_id * block_size
    if drop_rule == "reference":
        return start < n_total - block_size
    if drop_rule == "full":
        return start + block_size <= n_total
    raise ValueError(drop_rule)


def pack_blocks(tokens: DataFrame, totals: DataFrame, params: Params = Params()) -> DataFrame:
    """W2 + P4: ``(split, block_id, tokens array<bigint>)`` from token rows
    ``(split, pos, token_id)``. Rows that follow one another in a batch are one
    piece of a block (numpy), so a scan in order sends a piece per block; the
    kept-block filter runs before the shuffle and no group exceeds ``block_size``
    ids. Where positions repeat, a block's ids are sorted singly. ``totals`` has
    one row per split (broadcast is bounded by the number of splits)."""
    B = params.block_size

    def pieces(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            code = b.column("split").dictionary_encode()
            number, pos = code.indices.to_numpy(), b.column("pos").to_numpy()
            cut = (np.diff(pos) != 1) | (np.diff(number) != 0) | (pos[1:] % B == 0)
            first = np.append(0, np.flatnonzero(cut) + 1)
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(pos)).astype(np.int32)), b.column("token_id"))
            yield pa.RecordBatch.from_arrays([code.take(pa.array(first)).dictionary_decode(), pa.array(pos[first]), lists],
                                             names=["split", "piece_start", "piece"])

    rows = tokens.where(F.col("split").isNotNull() & F.col("pos").isNotNull())
    t = (rows.select("split", F.col("pos").cast("bigint").alias("pos"), F.col("token_id").cast("bigint").alias("token_id"))
         .mapInArrow(pieces, "split string, piece_start long, piece array<long>")
         .withColumn("block_id", F.floor(F.col("piece_start") / B).cast("bigint"))
         .join(F.broadcast(totals), "split")
         .where(keep_block(F.col("block_id"), F.col("n_total"), B, params.drop_rule)))
    g = t.groupBy("split", "block_id").agg(F.array_sort(F.collect_list(F.struct("piece_start", "piece"))).alias("_s"))
    ends = F.transform("_s", lambda x: x["piece_start"] + F.size(x["piece"]))
    # every piece but the first begins at or after the end of the one before
    apart = F.forall(F.sequence(F.lit(1), F.size("_s")), lambda i: (i == 1) | (F.col("_s")[i - 1]["piece_start"] >= ends[F.greatest(i - 2, F.lit(0))]))
    singly = F.array_sort(F.flatten(F.transform("_s", lambda x: F.transform(
        x["piece"], lambda v, i: F.struct((x["piece_start"] + i).alias("pos"), v.alias("token_id"))))))["token_id"]
    return g.select("split", "block_id", F.when(apart, F.flatten(F.col("_s.piece"))).otherwise(singly).alias("tokens"))


def pack_line_blocks(line_ids: DataFrame, totals: DataFrame, params: Params = Params(),
                     start_col: str = "line_start", ids_col: str = "ids") -> DataFrame:
    """W2 + P4 from per-line id arrays that carry their stream offset. Each line
    is cut into the pieces that fall into each block it touches (array slices,
    no per-token rows); only the pieces cross the shuffle, partially
    aggregated, and a block gathers at most ``block_size`` ids from at most
    ``block_size`` pieces. Same result as :func:`pack_blocks`."""
    B = params.block_size
    start, n = F.col(start_col), F.size(ids_col)
    first = F.floor(start / B)
    last = F.floor((start + n - 1) / B)
    x = (line_ids.where(n > 0)
         .select("split", start.alias("_start"), F.col(ids_col).alias("_ids"),
                 F.explode(F.sequence(first, last)).alias("block_id"))
         .join(F.broadcast(totals), "split")
         .where(keep_block(F.col("block_id"), F.col("n_total"), B, params.drop_rule)))
    lo = F.greatest(F.col("block_id") * B - F.col("_start"), F.lit(0))
    hi = F.least((F.col("block_id") + 1) * B - F.col("_start"), F.size("_ids"))
    pieces = x.select("split", F.col("block_id").cast("bigint").alias("block_id"),
                      (F.col("_start") + lo).alias("piece_start"),
                      F.slice("_ids", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("piece"))
    g = pieces.groupBy("split", "block_id").agg(
        F.array_sort(F.collect_list(F.struct("piece_start", "piece"))).alias("_s"))
    return g.select("split", "block_id", F.flatten(F.col("_s.piece")).cast("array<bigint>").alias("tokens"))


def shift_pairs(blocks: DataFrame, keys=("split", "block_id"), col: str = "tokens") -> DataFrame:
    """``(*keys, t, prev, next)`` with next = token t+1 of the same block;
    the last position has no label and pairs never cross blocks."""
    n = F.size(col)
    a = F.slice(col, F.lit(1), n - 1)
    b = F.slice(col, F.lit(2), n - 1)
    z = F.arrays_zip(a.alias("prev"), b.alias("next"))  # codegen'd, unlike a lambda
    return (blocks.select(*keys, F.posexplode(F.when(n >= 2, z).otherwise(F.array())).alias("t", "pr"))
            .select(*keys, "t", F.col("pr.prev").alias("prev"), F.col("pr.next").alias("next")))


def overflow_chunks(rows: DataFrame, ids_col: str, length: int, keys) -> DataFrame:
    """Every row cut into consecutive windows of ``length`` ids, one row each
    ``(*keys, chunk_no, input_ids, length)``; the last window may be short."""
    n = F.size(ids_col)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(length))
    chunks = F.transform(F.when(n > 0, starts).otherwise(F.array()),
                         lambda s: F.slice(ids_col, s + 1, F.lit(length)))
    return (rows.select(*keys, F.posexplode(chunks).alias("chunk_no", "input_ids"))
            .withColumn("length", F.size("input_ids")))


def full_length_only(chunks: DataFrame, length: int, col: str = "input_ids") -> DataFrame:
    """Keep only windows of exactly ``length`` ids."""
    return chunks.where(F.size(col) == length)
