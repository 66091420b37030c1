"""Flat little-endian unsigned 16-bit token streams as a Spark data source.

A stream is a folder of shard files and one ``manifest.json`` that lists, for
every split, its shards in order. Tasks write shards under names of their own
and report them; only the commit, which checks that the shards of each split
follow one another without a gap, publishes the manifest, by a rename. A task or
job that fails leaves no trace in it, and an earlier stream stays readable.

The scan cuts every shard (or one plain file of ids) into byte ranges, a task
each, and reads its range alone. Files are reached through pyarrow's file
systems: local or mounted folders, and URIs of the stores it knows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tessera.operators.checks import narrow_u16

NAME, SCHEMA = "token_stream", "split string, pos long, token_id int"
MANIFEST = "manifest.json"
ID_BYTES = 2
RANGE_BYTES = 64 << 20     # bytes of a task's range
READ_IDS = 1 << 20         # ids of one Arrow batch
TASK_TOKENS = 1 << 24      # rows that one task writes
SPREAD_TOKENS = 1 << 20    # rows of a task from which on more cores take part


def _files(path: str):
    """(file system, path in it)."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def read_manifest(path: str) -> list[dict]:
    """Shards ``{split, start, n, file}`` of the published stream."""
    files, root = _files(path)
    with files.open_input_file(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())["shards"]


@dataclass
class ByteRange(InputPartition):
    file: str
    split: str
    start: int       # position of the first id
    offset: int      # byte of the first id
    n: int


@dataclass
class Shards(WriterCommitMessage):
    written: list


class StreamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], options.get("split")
        self.ids = max(1, int(options.get("rangeBytes", RANGE_BYTES)) // ID_BYTES)

    def partitions(self):
        files, root = _files(self.path)
        info = files.get_file_info(root)
        if info.is_file:                 # one plain file of ids
            shards = [{"split": self.split or "train", "start": 0, "n": info.size // ID_BYTES, "file": None}]
        else:
            shards = [s for s in read_manifest(self.path) if self.split in (None, s["split"])]
        return [ByteRange(root if s["file"] is None else f"{root}/{s['file']}", s["split"], s["start"] + at, at * ID_BYTES, min(self.ids, s["n"] - at))
                for s in shards for at in range(0, s["n"], self.ids)]

    def read(self, partition: ByteRange) -> Iterator:
        import pyarrow as pa

        if partition is None:            # an empty stream
            return
        files, _ = _files(self.path)
        with files.open_input_file(partition.file) as f:
            for at in range(0, partition.n, READ_IDS):
                n = min(READ_IDS, partition.n - at)
                ids = np.frombuffer(f.read_at(n * ID_BYTES, partition.offset + at * ID_BYTES), "<u2").astype(np.int32)
                if len(ids) != n:
                    raise OSError(f"{partition.file} ends before its manifest says")
                first = partition.start + at
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(partition.split, pa.string()), n), pa.array(np.arange(first, first + n)), pa.array(ids)],
                    names=["split", "pos", "token_id"])


class StreamWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator) -> Shards:
        """Rows of a task, token rows or lines ordered by (split, position): one
        file for each run of following positions."""
        files, root = _files(self.path)
        folder = f"shards/{uuid.uuid4().hex}"
        files.create_dir(f"{root}/{folder}", recursive=True)
        written, out = [], None
        try:
            for b in iterator:
                code = b.column("split").dictionary_encode()
                number = code.indices.to_numpy(zero_copy_only=False)
                if "ids" in b.schema.names:
                    lists = b.column("ids")
                    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                    ids = lists.flatten().to_numpy(zero_copy_only=False)
                    if len(ids) and not (0 <= ids.min() and ids.max() < 1 << 8 * ID_BYTES):
                        raise ValueError(f"an id of {ids.min()} to {ids.max()} does not fit into {8 * ID_BYTES} bits")
                    first = b.column("line_start").to_numpy(zero_copy_only=False) - (np.cumsum(size) - size)
                    pos, number = np.repeat(first, size) + np.arange(len(ids)), np.repeat(number, size)
                else:
                    pos, ids = b.column("pos").to_numpy(zero_copy_only=False), b.column("token_id").to_numpy(zero_copy_only=False)
                if not len(pos):
                    continue
                ids = ids.astype("<u2")
                cuts = np.flatnonzero((np.diff(pos) != 1) | (np.diff(number) != 0)) + 1
                for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(pos)]):
                    split, start = code.dictionary[int(number[a])].as_py(), int(pos[a])
                    last = written[-1] if written else None
                    if not (last and last["split"] == split and last["start"] + last["n"] == start):
                        if out:
                            out.close()
                        written.append({"split": split, "start": start, "n": 0, "file": f"{folder}/{len(written):05d}.bin"})
                        out = files.open_output_stream(f"{root}/{written[-1]['file']}")
                    out.write(ids[a:z].tobytes())
                    written[-1]["n"] += z - a
        finally:
            if out:
                out.close()
        return Shards(written)

    def commit(self, messages) -> None:
        files, root = _files(self.path)
        shards = sorted((s for m in messages if m for s in m.written), key=lambda s: (s["split"], s["start"]))
        at: dict[str, int] = {}
        for s in shards:
            if s["start"] != at.get(s["split"], 0):
                raise ValueError(f"split {s['split']}: a shard starts at {s['start']}, not at {at.get(s['split'], 0)}")
            at[s["split"]] = s["start"] + s["n"]
        if not self.overwrite and files.get_file_info(f"{root}/{MANIFEST}").is_file:
            raise FileExistsError(f"{self.path} holds a stream already")
        files.create_dir(root, recursive=True)
        new = f"{root}/{MANIFEST}.{uuid.uuid4().hex}"
        with files.open_output_stream(new) as f:
            f.write(json.dumps({"dtype": "<u2", "shards": shards}).encode())
        files.move(new, f"{root}/{MANIFEST}")

    def abort(self, messages) -> None:
        files, root = _files(self.path)
        for m in messages:
            for s in m.written if m else []:
                files.delete_file(f"{root}/{s['file']}")


class TokenStream(DataSource):
    """``spark.read.format("token_stream")``, options ``path``, ``split``,
    ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> StreamReader:
        return StreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options, overwrite)


def write_token_stream(tokens: DataFrame, path: str, mode: str = "overwrite", task_tokens: int = TASK_TOKENS) -> None:
    """The token rows ``(split, pos, token_id)`` as a flat stream of each
    split. A task writes one range of positions; ids are checked to fit."""
    spark = tokens.sparkSession
    spark.dataSource.register(TokenStream)
    rows = tokens.select("split", "pos", narrow_u16("token_id").cast("int").alias("token_id"))
    (rows.repartitionByRange(1 + rows.count() // task_tokens, "split", "pos").sortWithinPartitions("split", "pos")
     .write.format(NAME).mode(mode).option("path", path).save())


def write_line_stream(lines: DataFrame, path: str, mode: str = "overwrite", task_tokens: int = TASK_TOKENS,
                      spread_tokens: int = SPREAD_TOKENS) -> None:
    """S5 from lines ``(split, line_start, ids)``: the same stream as that of their
    token rows. Lines, not tokens, are dealt to ranges of positions and sorted
    there; the writer takes the ids out of them and checks that they fit."""
    spark = lines.sparkSession
    spark.dataSource.register(TokenStream)
    n = lines.agg(F.sum(F.size("ids"))).first()[0] or 0
    tasks = max(1 + n // task_tokens, min(spark.sparkContext.defaultParallelism, 1 + n // spread_tokens))
    (lines.select("split", F.col("line_start").cast("bigint").alias("line_start"), "ids")
     .repartitionByRange(tasks, "split", "line_start").sortWithinPartitions("split", "line_start")
     .write.format(NAME).mode(mode).option("path", path).save())


def read_token_stream(spark: SparkSession, path: str, split: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A published stream (or one plain file of ids) by byte ranges."""
    spark.dataSource.register(TokenStream)
    reader = spark.read.format(NAME).option("path", path).option("rangeBytes", range_bytes)
    return (reader.option("split", split) if split else reader).load()
