"""Deterministic md5-based hashing, chosen so DuckDB can repeat it exactly.

Spark's ``hash``/``xxhash64`` have no DuckDB twin; an md5 hex prefix does."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tessera.config import SPLIT_BUCKETS, TEST_BUCKET, VAL_BUCKET


def md5_int(*parts, digits: int = 7) -> Column:
    """Integer from the first ``digits`` hex digits of md5 of the parts joined by '|'.

    7 digits (28 bits) keep the value inside a DuckDB/Spark BIGINT exactly."""
    s = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(s), 1, digits), 16, 10).cast("bigint")


def md5_bucket_of(key: Column, n: int) -> Column:
    """``md5(key) prefix % n`` for a single key (no separator)."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 7), 16, 10).cast("bigint") % n


def split_of(doc_id: Column) -> Column:
    """Split rule: md5 bucket 0-7 train, 8 val, 9 test."""
    b = md5_bucket_of(doc_id, SPLIT_BUCKETS)
    return F.when(b == VAL_BUCKET, "val").when(b == TEST_BUCKET, "test").otherwise("train")


def random_length(key: Column, seed: int, lo: int, hi: int) -> Column:
    """a reproducible length in ``[lo, hi)`` per key."""
    return F.lit(lo) + md5_int(F.lit(seed), key) % (hi - lo)
