"""Operators 11 and 12 against the tokenizer libraries themselves."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from tests.llm.test_operators import ROWS, SCHEMA

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = ["a", "b", " ", "  ", "▁", "\n", "é", "漢", "😀", "the", "<s>", "<unk>", "<0x0A>", "\0", "\t", "\xa0", "-", "--", "====", "1", "22",
            "�", "‍", " of", "ing", ".", "'s"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def coder():
    from tessera.llm.pieces import Coder, load_model
    return Coder(load_model(MODEL))


def _texts(n=3000):
    rng = random.Random(5)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_agenda_equals_the_library(coder, library):
    for t in _texts() + ["x" * 5000, "ab" * 700 + " " * 300, "=" * 999]:
        ids = library.encode(t)
        assert coder.encode(t) == ids, t
        assert coder.decode(ids) == library.decode(ids)


def test_short_and_long_agendas_agree(coder):
    for t in _texts(500):
        part = "▁" + t.replace(" ", "▁")
        assert coder.merge(part) == coder.merge_long(part)


def test_equal_scores_join_from_the_left():
    from tessera.llm.pieces import Coder, PieceModel
    kinds = (2, 3, 3) + (6,) * 256 + (1,) * 4
    pieces = ("<unk>", "<s>", "</s>", *(f"<0x{b:02X}>" for b in range(256)), "a", "aa", "▁", "▁a")
    c = Coder(PieceModel(pieces, (0.0,) * 260 + (-1.0, 0.0, -5.0), kinds, b""))
    assert [pieces[i] for i in c.encode("aaa")] == ["▁", "aa", "a"]


def test_decoding_of_any_ids(coder, library):
    rng = random.Random(6)
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, 3 + rng.randrange(256), rng.randrange(32000), 28705, 259]) for _ in range(rng.randint(0, 8))]
        assert coder.decode(ids) == library.decode(ids), ids


def test_memory_that_starts_anew(library, monkeypatch):
    from tessera.llm import pieces
    monkeypatch.setattr(pieces, "MEMO", 3)
    c = pieces.Coder(pieces.load_model(MODEL))
    for t in _texts(300):
        assert c.encode(t) == library.encode(t)


def test_query_on_whole_table(spark, library):
    from tessera.llm.queries import op12_pieces
    want = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = library.encode(r["text"])
        want[r["doc_id"]] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                             hashlib.sha256(library.decode(ids).encode()).hexdigest(), True)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["agrees"])
           for r in op12_pieces(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_pieces_of_odd_rows(spark):
    from tessera.llm.pieces import digests, encode_pieces
    odd = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 AS ids", "2 AS decoded", "3 AS agrees")
    rows = digests(encode_pieces(odd, MODEL)).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert len(rows) == len(ROWS) and all(r["agrees"] for r in rows)
    for r in rows:
        if r["doc_id"] in (2, 3):
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (0, nothing, nothing)
    assert len({(r["n_tokens"], r["ids_sha256"]) for r in rows if r["doc_id"] == 4}) == 1
    assert encode_pieces(odd.limit(0), MODEL).count() == 0


def test_slices_hold_every_row():
    import pyarrow as pa
    from tessera.llm.common import slices_by_bytes
    texts = ["x" * 10, None, "", "y" * 100, "z", None]
    b = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string()), "k": list(range(6))})
    got = list(slices_by_bytes([b], "text", 12))
    assert [t for s in got for t in s.column("text").to_pylist()] == texts
    assert all(s.num_rows == 1 or sum(len(t or "") for t in s.column("text").to_pylist()) <= 12 for s in got)
