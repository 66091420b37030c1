"""Clashing column names and rows without an id in the operators that return documents."""

import pytest

PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards boil quaint potions near the frozen harbour of gold"


@pytest.mark.parametrize("name", ["gone_key", "gone", "row", "key", "gone_lines", "gone_doc", "lines", "a.b", "doc_id2"])
def test_any_extra_column_comes_back(spark, name):
    from tessera.llm.decontaminate import clean_documents
    from tessera.llm.lines import dedup_lines
    docs = spark.createDataFrame([(1, f"x {PASSAGE} y", "p"), (2, "clean words\nclean words\nother", "q"), (None, None, None), (3, "", "r")],
                                 ["doc_id", "text", name])
    bench = spark.createDataFrame([(7, PASSAGE)], "item_id long, text string")
    clean = clean_documents(docs, bench)
    assert clean.columns == docs.columns and sorted((r[0], r[2]) for r in clean.collect() if r[0]) == [(2, "q"), (3, "r")] and clean.count() == 3
    lines = dedup_lines(docs)
    assert lines.columns == docs.columns
    assert {r[0]: (r[1], r[2]) for r in lines.collect()} == {1: (f"x {PASSAGE} y", "p"), 2: ("clean words\nother", "q"), None: (None, None), 3: ("", "r")}


def test_rows_without_an_id_report_their_own(spark):
    from tessera.llm.decontaminate import contaminated
    docs = spark.createDataFrame([(None, f"a {PASSAGE}"), (None, f"b {PASSAGE} and {PASSAGE}"), (4, PASSAGE), (4, PASSAGE)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, PASSAGE)], "item_id long, text string")
    rows = contaminated(docs.repartition(3), bench).collect()
    assert sorted((r["doc_id"] or 0, r["places"]) for r in rows) == [(0, 1), (0, 2), (4, 1), (4, 1)]


def test_no_language_is_dealt_to_one_task(spark):
    """The discounts, a row per language, are broadcast to the n-grams."""
    from tessera.llm import perplexity
    docs = spark.createDataFrame([(i, f"some words {i} here", "en") for i in range(20)], "doc_id long, text string, lang string")
    seen = []
    real = perplexity.store

    def spy(df, name, *by):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, name, *by)
    perplexity.store = spy
    try:
        perplexity.fit(docs)
    finally:
        perplexity.store = real
    assert sum("strategy=broadcast" in p for p in seen) >= perplexity.ORDER
