"""Connected components of an edge table by alternating large and small stars:
each round replaces edges by edges to smaller ids, so components turn into
stars around their smallest id in a logarithmic number of rounds. All rounds
are joins and partial aggregates; the edge table is stored between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import store


def _smallest(edges: DataFrame) -> DataFrame:
    """Per node u the least of its neighbours and itself."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    to_min = down.join(_smallest(down), "u")
    return to_min.select(F.col("v").alias("u"), F.col("m").alias("v")) \
        .unionByName(to_min.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str, rounds: int = 100) -> DataFrame:
    """(node, root): root is the smallest node of the component. Nodes without
    edges don't appear."""
    now = store(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    print_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = print_of(now)
    for _ in range(rounds):
        now = store(_small_star(_large_star(now)), "edges")
        mark = print_of(now)
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")) \
                .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        seen = mark
    raise RuntimeError(f"components did not settle in {rounds} rounds")
