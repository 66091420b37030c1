"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.session import ensure_checkpoint_dir

# words of the contracts: everything but the six ASCII white-space characters
WORD = r"[^\x20\x09-\x0D]+"
# rows of one Arrow batch: a bound on what a Python worker holds at once
BATCH_ROWS = 512


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the checkpoint folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tessera-llm/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder; later readers
    scan only the columns they need."""
    path = shared_folder(df.sparkSession, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Long texts: keep Arrow batches to a few megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def text_of(col: str | Column = "text") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit(""))


def word_count(col: str | Column = "text") -> Column:
    """Words of the whole text; 0 for null."""
    return F.regexp_count(text_of(col), F.lit(WORD)).cast("bigint")


def row_hash(*cols: str | Column, seed: int = 0) -> Column:
    """64 bits from whole column values; nulls differ from empty strings."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    marks = [p.isNull() for p in parts]
    return F.xxhash64(F.lit(seed), *parts, *marks)


def doc_crc(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of doc_id as text (unsigned); null counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def grouped_by_bytes(batches, column: str, limit: int):
    """Join Arrow batches until ``column`` holds about ``limit`` bytes, so that
    numpy works on long arrays while memory stays bounded."""
    import pyarrow as pa

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(column).nbytes
        if size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def slices_by_bytes(batches, column: str, limit: int = 4 << 20):
    """Cut Arrow batches so that ``column`` (strings) of a slice holds about
    ``limit`` bytes; a row that is longer is a slice of its own."""
    import numpy as np
    import pyarrow.compute as pc

    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        at = 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield b.slice(at, to - at)
            at = to


def list_column(rows: list):
    """An Arrow ``list<int32>`` column from numpy arrays, one per row."""
    import numpy as np
    import pyarrow as pa

    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32, copy=False)))
