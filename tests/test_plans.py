"""Plan properties the design relies on, read from the physical plans."""

import re

from tessera.config import Params
from tessera.plans import corpus
from tests.conftest import SF001


def _plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_needed_columns(spark):
    import __spark_entry__ as e
    df = e.queries()["lines_per_split"](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString() + df._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_vocab_lookup_is_broadcast_and_line_regroup_does_not_shuffle(spark, docs):
    prep = corpus.prepare(docs, Params())
    plan = _plan(prep.line_ids)
    assert re.search(r"BroadcastHashJoin \[word#\d+\], \[word#\d+\], LeftOuter", plan)  # vocabulary lookup
    assert "SortMergeJoin" in plan                         # offsets joined back by line key
    # the per-line collect_list sits directly on the join output: no exchange between
    top = plan.split("SortMergeJoin")[0]
    assert "Exchange" not in top.split("ObjectHashAggregate")[-1]


def test_flagship_has_no_single_partition_exchange(spark):
    import __spark_entry__ as e
    plan = _plan(e.queries()["perplexity"](spark, SF001))
    assert "SinglePartition" not in plan


def test_word_counts_aggregate_partially(spark, docs):
    from tessera.operators.vocab import word_counts
    plan = _plan(word_counts(corpus.prepare(docs, Params()).lines))
    assert len(re.findall(r"HashAggregate\(keys=\[word", plan)) >= 2  # partial + final
