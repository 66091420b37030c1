"""Line encoding under Structured Streaming.

The line operators (split tagging, pre-tokenize, vocabulary lookup, eos) are
stateless, so new corpus files can be encoded as they land. Each micro-batch
is handed to ``foreachBatch`` and runs the same batch operators; its output
goes to ``<out>/batch=<id>`` with overwrite, so a replayed batch rewrites the
same files (idempotent sink). Offsets and blocks need the whole split and stay
batch jobs."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.config import Params
from tessera.operators.encode import encode_tokens, tokenized_rows, with_words
from tessera.session import ensure_checkpoint_dir
from tessera.sources.corpus import document_lines


def _reader_of(reader, spark: SparkSession, source: str):
    """``reader`` with its path: a stream reads folders only, so that a single
    file is its folder under a filter of names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile():
        return reader.option("pathGlobFilter", path.getName()).parquet(path.getParent().toString())
    return reader.parquet(source)


def start_document_encoding(spark: SparkSession, source: str, vocab: DataFrame, out_path: str,
                            checkpoint: str, params: Params = Params(), available_now: bool = True,
                            max_files_per_trigger: int = 1):
    """Stream parquet document files (``doc_id, text``) from ``source``, one file
    or a folder of them, and append tokenized lines ``(split, doc_id, line_no,
    ids, len)``."""
    schema = spark.read.parquet(source).select("doc_id", "text").schema
    stream = _reader_of(spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger), spark, source)

    def per_batch(df: DataFrame, batch_id: int) -> None:
        lines = with_words(document_lines(df), params)
        rows = tokenized_rows(encode_tokens(lines, vocab, params))
        rows.write.mode("overwrite").parquet(os.path.join(out_path, f"batch={batch_id}"))

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def encode_documents_stream(spark: SparkSession, source: str, vocab: DataFrame,
                            params: Params = Params()) -> DataFrame:
    """Run the stream over what is there now and return the encoded lines.
    Output and stream checkpoint live in the shared checkpoint folder."""
    base = os.path.join(ensure_checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")
    q = start_document_encoding(spark, source, vocab.cache(), os.path.join(base, "out"),
                                os.path.join(base, "state"), params)
    q.awaitTermination()
    return spark.read.parquet(os.path.join(base, "out"))
