"""Operator 4: the swept windows against a plain recurrent network, the gradient
against differences, and the sample against its definition."""

import zlib

import numpy as np
import pytest

from tests.llm.test_operators import ROWS, SCHEMA


def _net(seed=1):
    from tessera.llm.toxicity import Net
    net, rng = Net(seed), np.random.default_rng(seed)
    for k in net.p:
        if k != "E":
            net.p[k] = (net.p[k] + rng.standard_normal(net.p[k].shape) * 0.2).astype(np.float32)
    return net


def _plain_logit(net, vectors):
    """One window, word by word, in doubles: states, attention, output."""
    from tessera.llm.toxicity import HIDDEN as H, WINDOW
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    states = []
    for d in "fb":
        h, out = np.zeros(H), [None] * WINDOW
        for t in (range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1)):
            if vectors[t] is not None:
                x, u = vectors[t] @ p[f"W{d}"] + p[f"c{d}"], h @ p[f"U{d}"]
                z, r = np.clip(0.25 * (x + u) + 0.5, 0, 1)[:H], np.clip(0.25 * (x + u) + 0.5, 0, 1)[H:2 * H]
                c = np.clip(x[2 * H:] + r * u[2 * H:], -1, 1)
                h = c + z * (h - c)
            out[t] = h
        states.append(out)
    both = [np.concatenate(x) for x in zip(*states)]
    there = [t for t in range(WINDOW) if vectors[t] is not None] or list(range(WINDOW))
    a = np.exp([both[t] @ p["v"] for t in there])
    return float(sum(w * (both[t] @ p["w"]) for w, t in zip(a / a.sum(), there)) + p["b"][0])


def test_swept_windows_equal_a_plain_network():
    from tessera.llm import toxicity as T
    net = _net()
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "délta", "x", "badword"], n)) for n in (0, 1, 5, 31, 32, 33, 70)]
    got = T.score_texts(net, T.Vocabulary(net), texts)
    for text, best in zip(texts, got):
        words = T.words_of(text)
        v = list(T.embed(net.p["E"], T.word_features(words)).astype(np.float64)) if words else []
        starts = range(max(1, len(v) - T.WINDOW + 1))
        want = max(_plain_logit(net, (v[s:s + T.WINDOW] + [None] * T.WINDOW)[:T.WINDOW]) for s in starts)
        assert abs(want - best) < 1e-3
    row, begin = T.laid_out(np.arange(100) % 7, np.array([40, 0, 60]), 7)
    g = net.gates(T.embed(net.p["E"], T.word_features([b"w%d" % i for i in range(7)])).astype(np.float32))
    whole = net.sweep(g, row)
    assert np.allclose(whole, net.sweep(g, row, 5), atol=1e-5)
    ids = row[T.starts_of(begin)[0][:, None] + np.arange(T.WINDOW)]
    assert np.allclose(whole[T.starts_of(begin)[0]], net.forward(g, ids), atol=1e-4)


def test_gradient_against_differences(monkeypatch):
    from tessera.llm import toxicity as T
    words = [b"one", b"two", b"three", b"four"]
    feats, rng = T.word_features(words), np.random.default_rng(3)
    ids, y = rng.integers(0, 5, (6, T.WINDOW)), np.array([0, 1, 0, 1, 1, 0], np.float32)     # 4 is the padding
    net = _net(5)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)

    def loss(p):
        own = T.Net.__new__(T.Net)
        own.p = p
        logit = own.forward(own.gates(T.embed(p["E"], feats)), ids).astype(np.float64)
        return float(np.mean(np.logaddexp(0, logit) - y * logit))

    before = {k: v.copy() for k, v in net.p.items()}
    state = {}
    net.step(T.embed(net.p["E"], feats), feats, ids, y, state, 1)
    for name in ("Uf", "Ub", "Wf", "cb", "v", "w", "b"):
        grad = state[name][0] / 0.1                       # the first moment after one step
        at = tuple(rng.integers(0, n) for n in grad.shape)
        moved = []
        for sign in (1, -1):
            p = {k: v.copy() for k, v in before.items()}
            p[name][at] += sign * 1e-3
            moved.append(loss(p))
        assert abs((moved[0] - moved[1]) / 2e-3 - grad[at]) < 2e-3, name


def test_toxic_passages_at_every_offset_of_a_window():
    from tessera.llm import toxicity as T
    rng = np.random.default_rng(6)
    calm, bad = [f"calm{i}" for i in range(200)], ["vile", "scum", "filth"]
    clean = lambda n: [str(w) for w in rng.choice(calm, n)]
    texts = [" ".join(clean(80)) for _ in range(150)]
    texts += [" ".join(clean(k := int(rng.integers(0, 60))) + list(rng.permutation(bad)) + clean(77 - k)) for _ in range(150)]
    net = T.train(texts, np.array([0] * 150 + [1] * 150))
    a, b = net.scale
    score = lambda t: T.sigmoid(a * T.score_texts(net, T.Vocabulary(net), t).astype(float) + b)
    planted = [" ".join(clean(k) + bad + clean(97 - k)) for k in range(98)]
    assert (score(planted) >= T.THRESHOLD).all()
    assert (score([" ".join(clean(100)) for _ in range(98)]) < T.THRESHOLD).all()


@pytest.mark.parametrize("limit", [5, 1000])
def test_sample_is_the_first_by_hash_outside_the_held_out_third(spark, limit):
    from tessera.llm.toxicity import TRAIN_CHARS, training_sample
    rows = [(i, f"text {i}", i % 2) for i in range(200)] + [(500, "x" * (TRAIN_CHARS + 1), 1), (7, "text 7", 1)]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t, _ in rows], "doc_id long, text string, toxic string, h string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:200]] + [(3, None), (500, 1)], "doc_id long, toxic int")
    texts, y = training_sample(docs, labels, limit)
    again, _ = training_sample(docs.repartition(2), labels, limit)
    assert texts == again and len(set(texts)) == len(texts)
    open_rows = {f"text {i}": i % 2 for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert all(open_rows[t] == v for t, v in zip(texts, y))
    for c in (0, 1):
        assert (y == c).sum() == min(limit, sum(v == c for v in open_rows.values()))


def test_stage_and_scores_on_odd_rows(spark):
    from tessera.llm.toxicity import clean_documents, score_documents
    odd = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 AS toxicity", "2 AS doc", "3 AS score", "4 AS h")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = score_documents(odd, none).collect()
    assert len(rows) == len(ROWS) and all(r["score"] == 0.0 and r["predicted"] == 0 for r in rows)
    kept = clean_documents(odd, none)
    assert kept.columns == odd.columns and kept.count() == len(ROWS)
    labels = spark.createDataFrame([(i, int(i == 5)) for i in range(1, 7)], "doc_id long, toxic int")
    rows = score_documents(odd, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 4}) == 1
    assert score_documents(odd.limit(0), labels).count() == 0 and clean_documents(odd.limit(0), labels).count() == 0
