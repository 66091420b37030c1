"""The flat stream as a data source."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources.token_stream import MANIFEST, StreamWriter, read_manifest, read_token_stream, write_line_stream, write_token_stream


def _rows(spark, n=5000, k=1200):
    return (spark.range(n).select(F.when(F.col("id") < n - k, "train").otherwise("val").alias("split"),
                                  F.when(F.col("id") < n - k, F.col("id")).otherwise(F.col("id") - (n - k)).alias("pos"),
                                  (F.col("id") * 37 % 65536).cast("int").alias("token_id")).orderBy(F.xxhash64("id")))


def _sorted(df):
    return sorted(map(tuple, df.select("split", "pos", "token_id").collect()))


def test_round_trip_in_many_shards_and_ranges(spark, tmp_path):
    rows, path = _rows(spark), str(tmp_path / "s")
    write_token_stream(rows, path, task_tokens=700)
    assert len(read_manifest(path)) > 5
    back = read_token_stream(spark, path, range_bytes=400)
    assert back.rdd.getNumPartitions() > 20
    assert _sorted(back) == _sorted(rows)
    val = read_token_stream(spark, path, "val")
    assert val.where("split <> 'val'").count() == 0 and val.count() == 1200


def test_shards_in_order_are_the_flat_stream(spark, tmp_path):
    path = str(tmp_path / "s")
    write_token_stream(_rows(spark), path, task_tokens=900)
    flat = b"".join(open(f"{path}/{s['file']}", "rb").read() for s in read_manifest(path) if s["split"] == "train")
    assert np.frombuffer(flat, "<u2").tolist() == [i * 37 % 65536 for i in range(3800)]


def test_one_plain_file_is_read_by_ranges(spark, tmp_path):
    ids = (np.arange(1 << 20) * 7 % 50257).astype("<u2")
    file = str(tmp_path / "train.bin")
    ids.tofile(file)
    df = read_token_stream(spark, file, range_bytes=1 << 17)
    assert df.rdd.getNumPartitions() == 16
    got = df.agg(F.count("*"), F.max("pos"), F.sum(F.col("token_id").cast("long") * (F.col("pos") % 1009))).first()
    assert tuple(got) == (1 << 20, (1 << 20) - 1, int((ids.astype(np.int64) * (np.arange(1 << 20) % 1009)).sum()))


def test_a_failing_task_leaves_the_old_stream(spark, tmp_path):
    path = str(tmp_path / "s")
    write_token_stream(_rows(spark, 300, 100), path)
    before = open(f"{path}/{MANIFEST}").read()
    bad = _rows(spark, 5000, 100).withColumn("token_id", F.when(F.col("pos") == 4000, F.raise_error(F.lit("killed")).cast("int")).otherwise(F.col("token_id")))
    with pytest.raises(Exception, match="killed"):
        write_token_stream(bad, path, task_tokens=500)
    assert open(f"{path}/{MANIFEST}").read() == before
    assert read_token_stream(spark, path).count() == 300


def test_attempts_that_are_not_committed_are_not_read(spark, tmp_path):
    """Two attempts of a task write; the job commits one of them."""
    import pyarrow as pa
    path = str(tmp_path / "s")
    b = pa.RecordBatch.from_pydict({"split": ["a"] * 3 + ["b"] * 2, "pos": [0, 1, 2, 0, 1], "token_id": [1, 2, 3, 4, 65535]})
    w = StreamWriter({"path": path}, True)
    lost, kept = w.write(iter([b.slice(0, 2)])), w.write(iter([b]))
    w.commit([kept])
    assert _sorted(read_token_stream(spark, path)) == [("a", 0, 1), ("a", 1, 2), ("a", 2, 3), ("b", 0, 4), ("b", 1, 65535)]
    w.abort([lost])
    assert not os.path.exists(f"{path}/{lost.written[0]['file']}")


def test_gaps_and_second_streams_are_refused(spark, tmp_path):
    path = str(tmp_path / "s")
    with pytest.raises(Exception, match="starts at 5"):
        write_token_stream(_rows(spark, 100, 0).where("pos >= 5"), path)
    assert not os.path.exists(f"{path}/{MANIFEST}")
    write_token_stream(_rows(spark, 100, 0), path)
    with pytest.raises(Exception, match="already"):
        write_token_stream(_rows(spark, 100, 0), path, mode="append")
    write_token_stream(_rows(spark, 100, 0).limit(0), path)
    assert json.load(open(f"{path}/{MANIFEST}"))["shards"] == [] and read_token_stream(spark, path).count() == 0


def test_ids_that_do_not_fit_are_refused(spark, tmp_path):
    with pytest.raises(Exception):
        write_token_stream(spark.createDataFrame([("a", 0, 65536)], "split string, pos long, token_id int"), str(tmp_path / "s"))


def test_lines_give_the_stream_of_their_token_rows(spark, tmp_path):
    lines = [("train" if k % 3 else "val", k // 3 * 40 + (20 if k % 3 == 2 else 0), [(k * 31 + i) % 65536 for i in range(40 if k % 3 == 0 else 20)]) for k in range(90)]
    df = spark.createDataFrame(lines[::-1], "split string, line_start long, ids array<int>").repartition(5)
    rows = df.select("split", F.posexplode("ids").alias("i", "token_id"), "line_start").selectExpr("split", "line_start + i as pos", "token_id")
    for k, sizes in enumerate(({"task_tokens": 300}, {"spread_tokens": 100}, {})):
        write_line_stream(df, str(tmp_path / f"s{k}"), **sizes)
        assert _sorted(read_token_stream(spark, str(tmp_path / f"s{k}"))) == _sorted(rows)
    assert len(read_manifest(str(tmp_path / "s0"))) > 5
    write_line_stream(df.limit(0), str(tmp_path / "none"))
    assert read_manifest(str(tmp_path / "none")) == []
    with pytest.raises(Exception, match="starts at"):
        write_line_stream(df.where("line_start > 0"), str(tmp_path / "gap"))
    with pytest.raises(Exception):
        write_line_stream(spark.createDataFrame([("a", 0, [1, 65536])], "split string, line_start long, ids array<int>"), str(tmp_path / "big"))
