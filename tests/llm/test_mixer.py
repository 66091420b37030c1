"""Operator 9: base score against plain counting, leave-one-out inputs, tables."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest


def _tokens(text):
    return text.translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")


def _texts(n, seed=1):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "gamma", "É", "x", "zeta", "eta"]
    return [" ".join(rng.choice(words) if rng.random() < 0.9 else "w%d" % rng.randrange(500) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("top", [200_000, 3])
def test_base_score_against_plain_counting(spark, monkeypatch, top):
    from tessera.llm import mixer
    monkeypatch.setattr(mixer, "TOP", top)              # words beyond the table come back by a join
    rows = [(i, t) for i, t in enumerate(_texts(150))] + [(None, "alpha"), (900, None), (901, ""), (900, None)]
    got = mixer.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    count, kinds = Counter(), 0
    for i, t in rows:
        if zlib.crc32((str(i) if i is not None else "").encode()) % 7 != 2:
            count.update([w for w in _tokens(t or "") if w] + [""])
    total = sum(count.values())
    want = []
    for i, t in rows:
        ws = [w for w in _tokens(t or "") if w] + [""]
        held = zlib.crc32((str(i) if i is not None else "").encode()) % 7 == 2
        want.append((str(i), held, len(ws), sum(count[w] > 0 for w in ws), total, round(sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in ws), 6)))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == sorted(want)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def _model(texts, slots=1 << 12):
    from tessera.llm.mixer import Coder, Mixer, Numbers
    words = [b"alpha", b"beta", b"gamma", b"x", b"zeta", b"eta"]
    coder = Coder(words, np.array([1] * 257 + [50] * 6), slots)
    numbers = Numbers(words)

    def counts(some):
        with np.errstate(over="ignore"):
            s, bits, _, _, _ = coder.expand(*coder.encode(*numbers(some)))
        out = [np.zeros(2 * n, np.float32) for n in (coder.n, slots, slots)]
        for k in range(3):
            np.add.at(out[k], s[k] * 2 + bits, 1)
        return out
    return coder, numbers, counts, Mixer


def test_a_sample_is_read_without_its_own_counts():
    texts = [t for t in _texts(12, 3) if t]
    coder, numbers, counts, Mixer = _model(texts)
    everything = counts(texts)
    with np.errstate(over="ignore"):
        got = Mixer(coder, everything).inputs(*numbers(texts), everything)
        for i, t in enumerate(texts):
            alone = Mixer(coder, counts(texts[:i] + texts[i + 1:])).inputs(*numbers([t]))
            a, n = got[4][i] // 16, -(-got[3][i] // 16)
            for k in range(3):
                assert (got[0][k][a:a + n] == alone[0][k]).all()


def test_two_words_before_are_a_context():
    """With the same word before, another word before that gives other slots."""
    coder, numbers, _, _ = _model([])
    with np.errstate(over="ignore"):
        slots, _, _, per_text, first = coder.expand(*coder.encode(*numbers(["alpha beta gamma", "zeta beta gamma"])))
    ends = [int(f + n) for f, n in zip(first, per_text)]
    n_end, n_gamma = int(coder.length[256]), int(coder.length[257 + 2])
    last = [slice(e - n_end - n_gamma, e - n_end) for e in ends]
    assert (slots[1][last[0]] == slots[1][last[1]]).all() and (slots[2][last[0]] != slots[2][last[1]]).all()


def test_learned_text_is_cheaper_than_unlearned():
    texts = ["alpha beta gamma x zeta eta " * 5] * 40
    coder, numbers, counts, Mixer = _model(texts)
    seen = counts(texts)
    with np.errstate(over="ignore"):
        known = Mixer(coder, seen).fit(*numbers(texts[:10]), seen).score(*numbers(texts[:1]))[0]
        blank = Mixer(coder, [np.zeros_like(c) for c in seen]).score(*numbers(texts[:1]))[0]
    assert known < 0.2 * blank


def test_weights_and_refinement_cover_all_training_rows(spark):
    """Over all texts, long ones too, whatever their dealing: as in one place."""
    from tessera.llm.mixer import learn
    texts = [t for t in _texts(300, 5) if t] + ["alpha beta w7 " * 3000]
    coder, numbers, counts, Mixer = _model(texts)
    seen = counts(texts)
    words = [b"alpha", b"beta", b"gamma", b"x", b"zeta", b"eta"]
    with np.errstate(over="ignore"):
        want = Mixer(coder, seen).fit(*numbers(texts), seen)
    for parts in (1, 5):
        got = learn(Mixer(coder, seen), seen, words, spark.createDataFrame([(t,) for t in texts], "text string").repartition(parts))
        assert (got.weights == want.weights).all() and (got.cost == want.cost).all()


def test_own_counts_are_taken_from_the_whole_chunk_at_once(monkeypatch):
    """Texts of any length, empty ones too, in pieces of any size: as read one
    by one, and the places between texts are no sightings."""
    from tessera.llm import mixer
    monkeypatch.setattr(mixer, "PIECE", 37)
    texts = _texts(20, 7) + ["", "beta " * 400, "w1"]
    coder, numbers, counts, Mixer = _model(texts)
    seen = counts(texts)
    with np.errstate(over="ignore"):
        model = Mixer(coder, seen)
        x, bits, state, per_text, first = model.inputs(*numbers(texts), seen)
        slots = coder.expand(*coder.encode(*numbers(texts)), align=16)[0]
        for a, n in zip(first.tolist(), per_text.tolist()):
            for k in range(3):
                at, bit = slots[k][a:a + n], bits.ravel()[a:a + n]
                own = Counter(zip(at.tolist(), bit.tolist()))
                left = [np.array([max(seen[k][2 * s + j] - own[s, j], 0) for s in at.tolist()], np.float32) for j in (0, 1)]
                assert (x[k].ravel()[a:a + n] == mixer._odds(*left)).all()
        assert not model.own.any()
        assert model.sightings(*numbers(texts), seen).sum() == per_text.sum()
