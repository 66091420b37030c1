import random

import regex
from pyspark.sql import functions as F

from tessera.config import PRETOKENIZE_PATTERN
from tessera.functions.text import append_eos, pretokenize, utf8_bytes
from tessera.operators.bpe import byte_symbols, initial_vocab

PY_PATTERN = PRETOKENIZE_PATTERN.replace("(?U)", "")
ALPHABET = list("ab cdXYZ019'\t\n.,!?-_") + [" ", " ", "é", "漢", "😀", "ß", "́", "’", "s", "t", "re", "ll"]


def _cases(n=400, seed=7):
    rnd = random.Random(seed)
    out = ["", "a  b\tc ", "x y", "é 漢 😀", "a <s> b", "I'm here's 123abc", "   ", "end  "]
    for _ in range(n):
        out.append("".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 30))))
    return out


def test_pretokenize_matches_python_regex(spark):
    cases = _cases()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    got = {r.i: list(r.w) for r in df.select("i", pretokenize("t").alias("w")).collect()}
    for i, t in enumerate(cases):
        assert got[i] == regex.findall(PY_PATTERN, t), repr(t)


def test_utf8_bytes_and_symbols(spark):
    df = spark.createDataFrame([("é😀a",)], "t string")
    r = df.select(utf8_bytes("t").alias("b"), byte_symbols("t").alias("s")).first()
    assert list(r.b) == list("é😀a".encode())
    vocab = initial_vocab()
    assert [vocab[i] for i in r.s] == [bytes([b]) for b in "é😀a".encode()]


def test_append_eos_truncates_first(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],), ([],)], "ids array<int>")
    got = [list(r.x) for r in df.select(append_eos("ids", 3, 99).alias("x")).collect()]
    assert got == [[1, 2, 3, 99], [99]]
