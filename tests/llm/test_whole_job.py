"""What the second advice found missing: whole results, against brute force."""

SENTENCES = ["{}", "distributed under the terms of the {}", "released under {}", "the {} license", "licence type {}", "spdx license identifier {}", "covered in part by {} and more"]
NAMES = ["mit", "x11", "mit 0", "apache 2 0", "apache software license version 1 1", "new bsd", "freebsd bsd", "bsd 4 clause", "0bsd", "gnu agpl v3", "agpl", "lgpl v2 1",
         "lgpl3", "gnu lesser general public license", "gnu gpl v3", "gpl2", "gpl", "gfdl", "mpl 2 0", "mpl", "epl 2 0", "epl", "cddl", "cpl 1 0", "cc0 1 0", "creative commons zero",
         "cc by nc sa 4 0", "cc by nc nd", "creative commons attribution noncommercial", "cc by sa 4 0", "cc by nd", "cc by", "isc", "zlib libpng", "bsl 1 0", "boost software license",
         "artistic license 2", "unlicense", "wtfpl", "do what the fudge you want to public license", "psf", "osl 3 0", "afl 3 0", "eupl", "odbl", "open data commons", "ofl 1 1",
         "ms pl", "busl", "sspl", "elastic license", "commons clause", "beerware", "vim license", "public domain"]


def test_license_prefilter_drops_nothing():
    from tessera.llm.licenses import compiled, scan
    table = compiled()
    unfiltered = [(pattern, label, (b"",), priority, confidence) for pattern, label, _, priority, confidence in table]
    for text in (s.format(n).encode() for s in SENTENCES for n in NAMES):
        assert scan(text, table) == scan(text, unfiltered), text


def test_licenses_without_the_word_license(spark):
    from tessera.llm.licenses import scan_licenses
    texts = {"Distributed under the terms of the GNU GPL v3.": "gpl-3", "Released under CC BY SA 4.0": "cc-by-sa", "CC0 1.0": "cc0", "WTFPL": "wtfpl", "released under X11": "x11"}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = scan_licenses(docs).collect()
    assert {r["doc_id"]: r["labels"] for r in rows} == dict(enumerate(texts.values())) and all(r["score"] > 0 for r in rows)


def test_jaccard_counts_each_link_once(spark, monkeypatch):
    from tessera.llm import jaccard
    monkeypatch.setattr(jaccard, "REGION", 4)          # rings of own rows and guests, cut into several blocks
    words = [f"w{i}" for i in range(180)]
    texts = [" ".join(words[k:k + 100]) for k in range(70)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard.near_duplicates(docs).collect()}
    # texts k and k + d share 96 - d of 96 + d shingles
    assert got == {k: (96, 0, sum(j != k and 100 * (96 - abs(j - k)) >= 80 * (96 + abs(j - k)) for j in range(70))) for k in range(70)}


def _kneser_ney(texts):
    """Log-probabilities of the last byte of all byte 4-grams, in plain Python."""
    import math
    from collections import Counter
    grams = {4: Counter(b"\0\0\0"[:3 - min(i, 3)] + t[max(0, i - 3):i + 1] for t in texts for i in range(len(t)))}
    for o in (3, 2, 1):
        grams[o] = Counter(g[1:] for g in grams[o + 1])
    p = {b"": 1 / 256}
    for o in (1, 2, 3, 4):
        n = Counter(grams[o].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + n[2] else None
        d = [max(0.05, min(k - 0.05, k - (k + 1) * y * n[k + 1] / n[k] if n[k] and y is not None else 0.75)) for k in (1, 2, 3)]
        total, off = Counter(), Counter()
        for g, c in grams[o].items():
            total[g[:-1]] += c
            off[g[:-1]] += d[min(c, 3) - 1]
        p |= {g: (c - d[min(c, 3) - 1]) / total[g[:-1]] + off[g[:-1]] / total[g[:-1]] * p[g[1:]] for g, c in grams[o].items()}
    return {g: math.log(p[g]) for g in grams[4]}


def test_perplexity_of_every_ngram_is_its_own(spark, monkeypatch):
    import random
    import pytest
    from tessera.llm import perplexity
    rng = random.Random(4)
    letters = "".join(map(chr, range(0x4E00, 0x9000, 3))) + "абвгдежз abcdefgh"       # mixed scripts: many n-grams
    rows = [(i, "".join(rng.choice(letters) for _ in range(2000)), "xy"[i % 2]) for i in range(300)] + [(300, "", "x"), (301, None, "z"), (302, "ab", None), (302, "ab", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    want = {}
    for lang in ("x", "y", None):
        mine = [(i, t.encode()) for i, t, x in rows if x == lang and t]
        logs = _kneser_ney([t for _, t in mine])
        for i, t in mine:
            want[i] = -sum(logs[b"\0\0\0"[:3 - min(k, 3)] + t[max(0, k - 3):k + 1]] for k in range(len(t))) / len(t)
    for held in (1 << 24, 1000):                      # as arrays, and by shuffle join
        monkeypatch.setattr(perplexity, "HELD", held)
        got = perplexity.check_quality(docs).collect()
        assert len(got) == len(rows)
        assert {r["doc_id"]: r["log_perplexity"] for r in got if r["doc_id"] not in (300, 301)} == pytest.approx(want, abs=1e-5)
        assert all(r["log_perplexity"] == 0 for r in got if r["doc_id"] in (300, 301))


def test_toxicity_reads_a_passage_whole_at_every_offset():
    import random

    from tessera.llm import toxicity
    rng = random.Random(7)
    net = toxicity.Net()
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    filler = [word() for _ in range(3 * toxicity.WINDOW)]
    for size in (5, 20, toxicity.WINDOW):
        passage = [word() for _ in range(size)]
        for offset in range(2 * toxicity.WINDOW):
            words = filler[:offset] + passage + filler[offset:]
            _, begin = toxicity.laid_out(toxicity.np.arange(len(words)), toxicity.np.array([len(words), 0]), len(words))
            start, owner = toxicity.starts_of(begin)
            assert any(a <= offset and offset + size <= a + toxicity.WINDOW for a, o in zip(start, owner) if o == 0)
    alone, *placed = toxicity.score_texts(net, toxicity.Vocabulary(net), [" ".join(passage)] + [" ".join(filler[:k] + passage + filler[k:]) for k in range(64)])
    assert min(placed) >= alone - 1e-5


def test_band_rejects_a_too_predictable_text(spark):
    import random

    from tessera.llm.perplexity import check_quality, rejections
    rng = random.Random(9)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    weight = [1 / (k + 1) for k in range(len(words))]
    texts = [" ".join(rng.choices(words, weight, k=120)) for _ in range(400)]
    texts.append(" ".join(rng.choice(words[:8]) for _ in range(70)))                                       # the commonest words only
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    checked = check_quality(docs)
    rows = {r["doc_id"]: r for r in checked.collect()}
    assert not rows[400]["base_failed"] and rows[400]["log_perplexity"] < rows[400]["low"] and not rows[400]["kept"]
    assert sum(rows[i]["kept"] for i in range(400)) >= 390
    r = rejections(checked).first()
    assert r["documents"] == 401 and 1 <= r["too_predictable"] <= 8 and r["too_surprising"] <= 8
