"""Operator 11 against a plain walk over the byte offsets of both libraries' tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.test_operators import ROWS, SCHEMA

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = ["a", "b", " ", "  ", "▁", "\n", "é", "漢", "😀", "the", "<s>", "<|endoftext|>", "\0", "\t", "\xa0", "-", "1", "22", "'s", " of", " ing",
            "\x1c", "\x85", " \n", "\r\n", "​", "."]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def aligner():
    from tessera.llm.alignment import Aligner
    from tessera.llm.pieces import load_model
    with open(BYTES, encoding="utf-8") as f:
        return Aligner(f.read(), load_model(PIECES))


def _plain(text, libraries):
    """(n_a, n_b, groups, linked id pairs) of one text."""
    from tessera.llm.alignment import byte_level_bytes
    lib_a, lib_b = libraries
    if not text:
        return 0, 0, "", []
    a, b = lib_a.encode(" " + text, add_special_tokens=False).ids, lib_b.encode(text)
    bytes_a = [byte_level_bytes(lib_a.id_to_token(i)) for i in a]
    bytes_b = [bytes([int(p[3:5], 16)]) if lib_b.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [lib_b.id_to_piece(i)]]
    raw = (" " + text).encode()
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return 0, 0, "", []
    end_a, end_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    groups, links, i, j = [], [], 0, 0
    for end in sorted(set(end_a) & set(end_b)):
        to_i, to_j = end_a.index(end, i) + 1, end_b.index(end, j) + 1
        groups.append(",".join(map(str, a[i:to_i])) + "|" + ",".join(map(str, b[j:to_j])))
        links.append((a[to_i - 1], b[to_j - 1]))
        i, j = to_i, to_j
    return len(a), len(b), ";".join(groups), links


def _texts(n, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def _same(got, texts, libraries):
    for (n_a, n_b, groups, links), text in zip(got, texts):
        w_a, w_b, w_groups, w_links = _plain(text, libraries)
        assert (n_a, n_b, ";".join(groups), links.tolist()) == (w_a, w_b, w_groups, [x * 32000 + y for x, y in w_links]), repr(text)


def test_random_texts(aligner, libraries):
    texts = _texts(3000) + [None, "", " ", "a ", "a  b", "x" * 4000 + " y", "▁", "a▁ b", "\n", " \n x"]
    _same(aligner.align(texts), texts, libraries)
    _same(aligner.align(texts[::-1]), texts[::-1], libraries)      # from memory


def test_windows_whose_hashes_clash(aligner, libraries, monkeypatch):
    from tessera.llm import alignment
    monkeypatch.setattr(alignment, "_window_hashes", lambda ids, cuts, side: np.zeros(len(cuts) - 1, np.uint64))
    texts = _texts(300, 8)
    _same(aligner.align(texts), texts, libraries)


def test_memory_that_starts_anew(libraries, monkeypatch):
    from tessera.llm import alignment
    from tessera.llm.pieces import load_model
    monkeypatch.setattr(alignment, "MEMO", 5)
    with open(BYTES, encoding="utf-8") as f:
        own = alignment.Aligner(f.read(), load_model(PIECES))
    for seed in range(5):
        texts = _texts(50, seed)
        _same(own.align(texts), texts, libraries)


def _expected(rows, libraries):
    plain = [(i, *_plain(t, libraries)) for i, t in rows]
    count = Counter(p for *_, links in plain for p in links)
    most = {}
    for (_, y), c in count.items():
        most[y] = max(c, most.get(y, 0))
    return sorted(((i, n_a, n_b, len(links), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(g.encode()).hexdigest() if links else "") for i, n_a, n_b, g, links in plain), key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query_on_whole_table(spark, libraries):
    from tessera.llm.queries import op11_alignment
    got = op11_alignment(spark, "/root/testdata/sf0.001").select(COLUMNS).collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert sorted((tuple(r) for r in got), key=str) == _expected([tuple(r) for r in docs], libraries)


@pytest.mark.parametrize("hot_pairs", [0, 3, 40])
def test_pairs_beyond_the_broadcast(spark, libraries, hot_pairs):
    from tessera.llm.alignment import link_strength
    rows = [(i % 50, t) for i, t in enumerate(_texts(200, 9))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = link_strength(df, BYTES, PIECES, hot_pairs).select(COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=str) == _expected(rows, libraries)


def test_odd_rows_and_groups(spark, libraries):
    from tessera.llm.alignment import align_documents, link_strength
    odd = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 AS rk", "2 AS pairs", "3 AS n_best")
    got = link_strength(odd, BYTES, PIECES).select(COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=str) == _expected([(r[0], r[1]) for r in ROWS], libraries)
    assert link_strength(odd.limit(0), BYTES, PIECES).collect() == []
    for r in align_documents(odd, BYTES, PIECES, with_groups=True).collect():
        assert (hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") == r["groups_sha256"]
