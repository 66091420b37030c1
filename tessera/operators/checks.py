"""Casts with range checks, pattern grouping, domain checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.config import NO_DECAY_PATTERNS


def widen(col: str):
    """uint16-range id widened to int64."""
    return F.col(col).cast("bigint")


def narrow_u16(col: str):
    """Inverse of P4: fails the query on an id outside ``[0, 65536)``."""
    c = F.col(col)
    return F.when((c >= 0) & (c < 65536), c.cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("id outside unsigned 16-bit range: "), c.cast("string"))))


def u16_report(tokens: DataFrame, col: str = "token_id", by: str = "split") -> DataFrame:
    """Range report of the narrowing check (count of violations, no failure)."""
    c = F.col(col)
    return tokens.groupBy(by).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"), F.max(c).cast("bigint").alias("max_id"),
        F.sum(((c < 0) | (c >= 65536)).cast("int")).cast("bigint").alias("n_out_of_range"))


def decay_groups(params: DataFrame, name_col: str, size_col: str, weight_decay: float,
                 no_decay=NO_DECAY_PATTERNS) -> DataFrame:
    """P5 + A10: names containing any no-decay substring get weight decay 0,
    the rest ``weight_decay``; per group the count and total size."""
    pats = F.array(*[F.lit(p) for p in no_decay])
    hit = F.exists(pats, lambda p: F.col(name_col).contains(p))
    g = params.withColumn("weight_decay", F.when(hit, F.lit(0.0)).otherwise(F.lit(float(weight_decay))))
    return g.groupBy("weight_decay").agg(F.count(F.lit(1)).cast("bigint").alias("n_params"),
                                         F.sum(size_col).cast("bigint").alias("numel"))


def domain_violations(df: DataFrame, col: str, allowed) -> DataFrame:
    """P8 as a report: rows whose value is outside ``allowed`` (null counts as outside)."""
    ok = F.col(col).isin(*allowed)
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                  F.sum(F.when(ok, 0).otherwise(1)).cast("bigint").alias("n_violations"))


def assert_domain(df: DataFrame, col: str, allowed) -> DataFrame:
    """P8 as a guard: the query fails on the first value outside ``allowed``."""
    ok = F.col(col).isin(*allowed)
    return df.withColumn(col, F.when(ok, F.col(col)).otherwise(
        F.raise_error(F.concat(F.lit(f"{col} outside domain: "), F.coalesce(F.col(col).cast("string"), F.lit("null"))))))
