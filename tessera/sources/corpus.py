"""Line-text scans, split tagging and split collections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions.hashing import split_of
from tessera.functions.text import split_lines


def read_line_files(spark: SparkSession, directory: str, glob: str, split: str) -> DataFrame:
    """Every line of the files matching ``glob`` under ``directory``,
    tagged with ``split``. Blank lines are kept; CRLF endings are stripped.

    Order key: ``(file_name, file_block_start, row_in_block)``. The row number
    is ``monotonically_increasing_id`` which grows with the line order inside one
    scan partition, and a scan partition never spans two file blocks."""
    df = (spark.read.option("pathGlobFilter", glob).option("lineSep", "\n").text(directory)
          .select(F.col("value").alias("text"),
                  F.col("_metadata.file_name").alias("file_name"),
                  F.col("_metadata.file_block_start").alias("block_start"),
                  F.monotonically_increasing_id().alias("row_id")))
    return df.select(F.lit(split).alias("split"), "file_name", "block_start", "row_id",
                     F.regexp_replace("text", "\r$", "").alias("text"))


def file_lines(lines: DataFrame) -> DataFrame:
    """Lines of files as the corpus job takes them, ``(split, doc_id, line_no,
    text)``: the place of a line is its file and byte range, then its row there."""
    place = F.concat_ws("@", "file_name", F.lpad(F.col("block_start").cast("string"), 19, "0"))
    return lines.select("split", place.alias("doc_id"), F.col("row_id").alias("line_no"), "text")


def write_line_files(lines: DataFrame, directory: str) -> None:
    """The inverse of the scan: one folder ``split=<name>`` of text files per
    split, whose names and rows follow the order of (doc_id, line_no)."""
    n = max(1, lines.sparkSession.sparkContext.defaultParallelism)
    (lines.repartitionByRange(n, "split", "doc_id", "line_no").sortWithinPartitions("split", "doc_id", "line_no")
     .select("split", "text").write.partitionBy("split").option("lineSep", "\n").text(directory))


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """S3: a named split of a dataset partitioned by ``split`` (partition pruning)."""
    return spark.read.parquet(path).where(F.col("split") == split)


def tag_split(documents: DataFrame) -> DataFrame:
    """Split of each document by the md5 bucket of ``doc_id``."""
    return documents.withColumn("split", split_of(F.col("doc_id")))


def document_lines(documents: DataFrame) -> DataFrame:
    """S1 stand-in: one row per line of every document, order key
    ``(doc_id, line_no)``, with the document's split. Narrow: no shuffle."""
    return (tag_split(documents.select("doc_id", "text"))
            .select("split", "doc_id", F.posexplode(split_lines("text")).alias("line_no", "text")))


def combine_splits(*parts: DataFrame) -> DataFrame:
    """One collection of several split-tagged tables (union all)."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def rename_split(df: DataFrame, new_name: str) -> DataFrame:
    """Relabel a whole table as split ``new_name``."""
    return df.withColumn("split", F.lit(new_name))


def split_counts(lines: DataFrame) -> DataFrame:
    """A2: rows per split."""
    return lines.groupBy("split").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))
