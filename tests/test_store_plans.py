"""The stored corpus: readers scan their split and their columns only."""

import re

import pytest

from tessera.config import Params
from tessera.operators.vocab import word_counts_of_words
from tessera.plans import corpus


def _plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def prep(spark, docs):
    return corpus.prepare(docs, Params())


def test_word_counts_scan_the_train_partition(prep):
    plan = _plan(word_counts_of_words(prep.words.where("split = 'train'")))
    assert re.search(r"PartitionFilters: \[isnotnull\(split#\d+\), \(split#\d+ = train\)\]", plan)
    assert "ReadSchema: struct<words:array<string>>" in plan


def test_offsets_scan_the_lengths(prep):
    plan = _plan(prep.words.select("split", "doc_id", "line_no", "len"))
    assert "ReadSchema: struct<doc_id:bigint,line_no:int,len:int>" in plan


def test_scoring_scans_the_evaluation_partitions(prep):
    plan = _plan(corpus.evaluate(prep)["per_block"])
    assert re.search(r"PartitionFilters: \[split#\d+ IN \(val,test\)\]", plan)
    assert len(re.findall(r"FileScan parquet \[prev#", plan)) >= 2     # the stored counts, not their derivation
