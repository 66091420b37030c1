def test_every_operator_is_registered_with_sql_or_without():
    import corpus_pipeline

    import __spark_entry__ as e
    from tessera.llm.queries import NO_SQL, ORACLES, QUERIES
    assert set(QUERIES) | {"pipeline"} <= set(e.queries())
    assert set(QUERIES) - set(ORACLES) == NO_SQL and corpus_pipeline.ORACLE_SQL is None
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 14))
