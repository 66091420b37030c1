import glob

from pyspark.sql import functions as F


def test_registered_bpe_learns_to_the_end(spark, docs):
    """Every merge down to the minimum frequency, equal to the tokenizers package."""
    import json

    from tokenizers import ByteLevelBPETokenizer

    from tessera.config import Params
    from tessera.plans import catalog
    from tests.conftest import SF001
    merges = [tuple(r) for r in catalog.QUERIES["bpe_merges"](spark, SF001).orderBy("rank").select("left_id", "right_id", "new_id").collect()]
    lines = catalog._prep(spark, SF001).lines.where("split = 'train'").orderBy("doc_id", "line_no").collect()
    P = Params()
    tok = ByteLevelBPETokenizer()
    tok.train_from_iterator([r.text for r in lines], vocab_size=P.vocab_size, min_frequency=P.min_frequency,
                            special_tokens=list(P.special_tokens), show_progress=False)
    model = json.loads(tok._tokenizer.to_str())["model"]
    ids = model["vocab"]
    want = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    assert len(want) > 10_000
    assert merges == [(ids[a], ids[b], ids[a + b]) for a, b in want]


def test_token_table_is_written_by_ranges(spark, tmp_path, monkeypatch):
    from tessera.sources import tokens
    monkeypatch.setattr(tokens, "TASK_TOKENS", 1000)
    rows = spark.range(9000).select(F.when(F.col("id") < 8000, "train").otherwise("val").alias("split"), (F.col("id") % 8000).alias("pos"),
                                    (F.col("id") * 37 % 65536).cast("int").alias("token_id"))
    path = f"{tmp_path}/tokens"
    tokens.write_token_table(rows.orderBy(F.xxhash64("pos")), path)
    back = spark.read.parquet(path)
    assert sorted(map(tuple, back.select("split", "pos", "token_id").collect())) == sorted(map(tuple, rows.collect()))
    files = sorted(glob.glob(f"{path}/split=train/*.parquet"))
    assert len(files) > 4
    spans = []
    for f in files:
        pos = [r["pos"] for r in spark.read.parquet(f).collect()]
        assert pos == sorted(pos)
        spans.append((pos[0], pos[-1]))
    assert all(a[1] < b[0] for a, b in zip(sorted(spans), sorted(spans)[1:]))
