from pyspark.sql import functions as F

from tessera.config import Params, UNK_ID
from tessera.operators.encode import decode, encode_tokens, tokenized_rows, with_words
from tessera.operators.vocab import word_counts, word_vocab

P = Params()


def _lines(spark, texts):
    return spark.createDataFrame([("train", 0, i, t) for i, t in enumerate(texts)],
                                 "split string, doc_id long, line_no int, text string")


def test_edge_lines(spark):
    texts = ["", "w " * 2000, "a <s> b", "a  b\tc "]
    lines = _lines(spark, texts)
    vocab = word_vocab(word_counts(lines), P.with_(min_frequency=1))
    rows = {r.line_no: r for r in tokenized_rows(encode_tokens(with_words(lines, P), vocab, P)).collect()}
    assert list(rows[0].ids) == [P.eos_id] and rows[0].len == 1
    assert rows[1].len == P.context_length + 1 and rows[1].ids[-1] == P.eos_id
    v = {r.token: r.token_id for r in vocab.collect()}
    assert list(rows[2].ids) == [v["a"], v[" <"], v["s"], v[">"], v[" b"], P.eos_id]
    assert [t for t in ["a", " ", " b", "\t", "c", " "]] and rows[3].len == 7


def test_oov_maps_to_unk_and_decode(spark):
    train = _lines(spark, ["the cat the cat", "the dog"])
    vocab = word_vocab(word_counts(train), P)  # min_frequency 2 keeps "the" and " cat" only
    test = _lines(spark, ["the cow"])
    rows = tokenized_rows(encode_tokens(with_words(test, P), vocab, P)).first()
    assert rows.ids[1] == UNK_ID
    dec = decode(tokenized_rows(encode_tokens(with_words(train, P), vocab, P)), vocab, "ids",
                 ["split", "doc_id", "line_no"], P, skip_special=True).orderBy("line_no").collect()
    assert dec[0].text == "the cat cat"  # " the" (seen once) is unknown and skipped
    assert dec[1].text == "the"  # " dog" seen once: unknown, dropped as special


def test_vocab_ranked_by_count_then_word(spark):
    lines = _lines(spark, ["b a b a c c c"])
    vocab = {r.token_id: r.token for r in word_vocab(word_counts(lines), P.with_(min_frequency=1)).collect()}
    assert [vocab[i] for i in range(5, 9)] == [" c", " a", " b", "b"]
