"""S4, S5 in native form: the token rows ``(split, pos, token_id)``, written as
Parquet partitioned by ``split`` (so reading one split prunes the others). The
flat 16-bit stream is :mod:`tessera.sources.token_stream`."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

TASK_TOKENS = 1 << 22    # rows of the token table that one task writes


def write_token_table(tokens: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S5 native: ``(split, pos, token_id)`` partitioned by split. Each task sorts
    and writes one range of positions, about ``TASK_TOKENS`` rows."""
    rows = tokens.select("split", "pos", "token_id")
    (rows.repartitionByRange(1 + rows.count() // TASK_TOKENS, "split", "pos")
     .sortWithinPartitions("split", "pos").write.mode(mode).partitionBy("split").parquet(path))


def blocks_from_stream(stream: DataFrame, block_size: int, n_total: int, drop_rule: str = "reference") -> DataFrame:
    """W2 over a scanned stream with a known length (a scanned flat stream)."""
    from tessera.operators.pack import keep_block
    t = stream.withColumn("block_id", F.floor(F.col("pos") / block_size).cast("bigint"))
    t = t.where(keep_block(F.col("block_id"), F.lit(n_total), block_size, drop_rule))
    g = t.groupBy("split", "block_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token_id"))).alias("_s"))
    return g.select("split", "block_id", F.col("_s.token_id").cast("array<bigint>").alias("tokens"))
