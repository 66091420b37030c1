from tests.conftest import SF001


def test_stream_equals_batch(spark):
    import __spark_entry__ as e
    q = e.queries()
    a = q["stream_tokenized_lines"](spark, SF001).collect()
    b = q["tokenized_lines"](spark, SF001).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_a_table_of_several_files_is_streamed_whole(spark, tmp_path):
    import __spark_entry__ as e
    docs = [(i, f"the cat {i}\nthe dog and the cat\n" * 3) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    q = e.queries()
    a = q["stream_tokenized_lines"](spark, str(tmp_path)).collect()
    b = q["tokenized_lines"](spark, str(tmp_path)).collect()
    assert len(a) == 280 and sorted(map(tuple, a)) == sorted(map(tuple, b))
