"""Results do not depend on how rows are partitioned (order keys are explicit)."""

from pyspark.sql import functions as F

from tessera.config import Params
from tessera.plans import corpus

P = Params(block_size=64)


def _blocks(spark, docs, parts, scan_parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        prep = corpus.prepare(docs.repartition(scan_parts), P)
        rows = prep.blocks.select("split", "block_id", F.array_join("tokens", " ").alias("t")).collect()
        ppl = corpus.evaluate(prep, P)["summary"].select("split", "loss").collect()
        return sorted(map(tuple, rows)), sorted((r.split, round(r.loss, 9)) for r in ppl)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_blocks_and_loss_same_for_any_partitioning(spark, docs):
    a = _blocks(spark, docs, 3, 1)
    b = _blocks(spark, docs, 17, 7)
    assert a[0] == b[0] and a[0]
    assert a[1] == b[1]
