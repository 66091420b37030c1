"""The selection looks the evaluation pairs up once, whatever the settings."""

from tessera.config import Params
from tessera.operators import ngram
from tessera.operators.evaluation import batch_losses, split_summary
from tessera.plans import selection


def test_pairs_are_looked_up_once_for_all_settings(spark, tmp_path, monkeypatch):
    blocks = spark.createDataFrame([(s, b, [(b * 7 + i * i) % 11 for i in range(20)]) for s, k in (("train", 6), ("val", 3)) for b in range(k)],
                                   "split string, block_id long, tokens array<long>")
    p, alphas, calls = Params(vocab_size=12), (0.5, 1.0, 2.0), []
    monkeypatch.setattr(selection, "pair_lookups", lambda *a: calls.append(1) or ngram.pair_lookups(*a))
    best = selection.select_alpha(blocks, alphas, str(tmp_path / "m"), p)
    assert calls == [1]
    bigrams, contexts = ngram.fit_bigram(blocks.where("split = 'train'"))
    want = [split_summary(batch_losses(ngram.score_blocks(blocks.where("split = 'val'"), bigrams, contexts, p, alpha=a), p.eval_batch_size)).first() for a in alphas]
    got = spark.read.parquet(str(tmp_path / "m/metrics")).orderBy("epoch").collect()
    assert [round(r.loss, 9) for r in got] == [round(w.loss, 9) for w in want]
    assert round(best, 6) == round(min(w.perplexity for w in want), 6)
