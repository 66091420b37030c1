"""Draws and shuffle keys reach the whole of a very long stream."""

from pyspark.sql import functions as F

from tessera.operators.batching import sample_positions, shuffle_key


def test_draws_reach_the_last_quarter_of_a_long_stream(spark):
    n = 10 ** 12
    totals = spark.createDataFrame([("train", n)], "split string, n_total bigint")
    draws = spark.range(2000).select(shuffle_key(1, F.lit(0), F.col("id")).alias("h")).select((F.col("h") % n).alias("pos"))
    assert draws.where(F.col("pos") >= 3 * n // 4).count() > 300
    wanted = draws.selectExpr("pos", "1 AS token_id", "'train' AS split")
    assert sample_positions(wanted, totals, 10, 1, "train").columns == ["draw", "pos", "token_id"]


def test_checkpoint_folder_is_kept(spark):
    from tessera.session import ensure_checkpoint_dir
    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)
