"""Words stay in the task that reads their line; equal to the plain forms."""

import random

from tessera.config import Params
from tessera.functions.pretokens import pretokens, shared_classes
from tessera.functions.text import pretokenize
from tessera.operators.encode import encode_texts, encode_tokens, tokenized_rows, with_words
from tessera.operators.vocab import word_counts, word_counts_of_lines
from tessera.plans import corpus

ODD = ["'", "s", "t", "r", "e", "v", "l", "d", " ", " ", "\t", " ", " ", "\x85", "é", "漢", "1", "²", "!", "😀", "́", "\r", "\x1c", "᠎"]


def _texts():
    random.seed(5)
    out = ["".join(random.choice(ODD) for _ in range(random.randint(0, 12))) for _ in range(4000)] + ["", " ", "  ", "'s", "it's've 'll", "a  b\tc "]
    random.shuffle(out)
    return out


def test_array_pretokens_equal_the_pattern(spark):
    import pyarrow as pa
    texts = _texts()
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", pretokenize("text").alias("w")).collect()
    want = {r["i"]: r["w"] for r in rows}
    classes, whole = shared_classes(spark).value, pa.array(texts)
    for size in (len(texts), 997):
        for a in range(0, len(texts), size):
            words, sizes = pretokens(whole.slice(a, size), classes)
            words, k = words.to_pylist(), 0
            for i, n in enumerate(sizes, a):
                assert words[k:k + n] == want[i], texts[i]
                k += n
            assert k == len(words)


def test_counts_and_ids_straight_from_the_texts(spark):
    lines = spark.createDataFrame([("train", i // 7, i % 7, t) for i, t in enumerate([*_texts(), "w " * 2000])],
                                  "split string, doc_id long, line_no int, text string")
    counts = word_counts_of_lines(lines)
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, word_counts(lines).collect()))
    vocab = spark.createDataFrame([(5, "w"), (6, " w"), (7, "'s"), (8, "é")], "token_id int, token string")
    keys = ("split", "doc_id", "line_no")
    got = encode_texts(lines, vocab).select(*keys, "ids", "len").collect()
    want = tokenized_rows(encode_tokens(with_words(lines), vocab)).select(*keys, "ids", "len").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and max(r["len"] for r in got) == 1025


def test_blocks_store_no_words(spark, docs):
    prep = corpus.prepare(docs, Params())
    assert prep.blocks.count() and "words" not in vars(prep)
