"""Spark queries against their DuckDB twins on the sf0.001 tables."""

import duckdb
import pytest

from tessera.plans.catalog import ORACLES, QUERIES
from tests.conftest import SF001
from tools.compare_oracle import TABLES, digest


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(ORACLES[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows) == digest(ocols, orows)


# iterative: compared with a library or brute force in the other tests
ITERATIVE = {"classifier_head", "bpe_merges", "bpe_encode", "bpe_perplexity", "generate_samples"}


def test_every_query_has_oracle_or_is_iterative():
    assert set(QUERIES) - set(ORACLES) == ITERATIVE


def test_entry_without_the_training_data_operators(monkeypatch):
    """A package that is missing or can't be imported costs its own queries only."""
    import sys

    import __spark_entry__ as e
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(ORACLES)


def test_entry_smoke(spark):
    import __spark_entry__ as e
    rows = e.entry(spark).collect()
    assert {r.split for r in rows} <= {"val", "test"} and rows


def test_entry_loads_by_path(spark):
    """The driver may load the entry file by path from another folder."""
    import importlib.util
    import os
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("entry_by_path", path)
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    assert set(mod.oracle_sql()) <= set(mod.queries())
    assert mod.entry(spark).columns == ["split", "n_batches", "n_blocks", "loss", "token_loss", "perplexity"]
