"""Edge rows for every operator, and brute force on small inputs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, kept string"
LONG = "alpha beta gamma delta epsilon zeta eta theta " * 400
ROWS = [(1, "one two three four five six", "en", "a", 1, "x", "y"), (2, None, None, None, None, None, None), (3, "", "en", "a", 0, "x", "y"),
        (None, "one two three four five six", "en", "b", 1, "x", "y"), (4, LONG, "en", "a", 1, "x", "y"), (4, LONG, "en", "a", 1, "x", "y"),
        (5, "Released under the MIT License.\nreleased under the MIT License.", "de", None, 1, "x", "y"), (6, "tiny", "en", "b", 1, "x", "y")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_flow_moves_the_fewest_bytes():
    from tessera.llm.sharding import transfers
    flows = transfers([10, 0, 5], [5, 5, 5])
    assert sum(b for (i, j), b in flows.items() if i != j) == 5
    with pytest.raises(ValueError):
        transfers([10], [5])


def test_shards(odd, empty):
    from tessera.llm.sharding import shard_documents
    rows = shard_documents(odd).collect()
    assert len(rows) == len(ROWS)
    assert next(r for r in rows if r["doc_id"] == 2)["size"] == 1
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert shard_documents(empty).count() == 0


def test_targets_and_mix(odd, empty):
    from tessera.llm.mixing import mix_documents, repeated, route, target_shares
    assert target_shares([10, 10], [5, 1], 30) == [20.0, 10.0]
    # the pattern (a, b) fills b's quota before anything of a is repeated
    got = route({("a",): 10, ("a", "b"): 10}, {"a": 10, "b": 10})
    assert all(not r[1] for r in got.values())
    rows = mix_documents(odd).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    for t in {(r["target"], r["source_size"]) for r in rows}:
        assert abs(sum(r["taken"] for r in rows if (r["target"], r["source_size"]) == t) - t[0]) <= 1
    assert repeated(odd).columns == odd.columns
    assert mix_documents(empty).count() == 0


def _jaccard_brute(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = root[i], root[j]
            root = [min(a, b) if x in (a, b) else x for x in root]
    return [len(s) for s in sets], root


def test_jaccard_against_brute_force(spark, monkeypatch):
    from tessera.llm import jaccard
    monkeypatch.setattr(jaccard, "REGION", 4)          # rings and block pairs too
    rng = random.Random(3)
    base = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(60)] for _ in range(6)]
    texts = []
    for b in base:
        for _ in range(9):
            w = list(b)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = str(rng.randrange(99))
            texts.append(" ".join(w))
    texts += ["", None, "a b", "A b", "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs).collect()}
    sizes, root = _jaccard_brute(texts)
    assert got == {i: (sizes[i], root[i]) for i in range(len(texts))}
    assert jaccard.one_of_each(docs).count() == len(set(root))


def test_jaccard_odd_rows(odd, empty):
    from tessera.llm import jaccard
    got = jaccard.near_duplicates(odd).collect()
    assert len(got) == len(ROWS) and next(r for r in got if r["doc_id"] is None)["component_id"] == 1
    assert jaccard.one_of_each(odd).columns == odd.columns
    assert jaccard.near_duplicates(empty).count() == 0


def test_region_cells_are_exact():
    from tessera.llm.jaccard import Region
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(20, 40))) for _ in range(120)] + [np.arange(k, k + 30) for k in range(60)]
    found = {tuple(sorted(p)) for p in Region(sets).pairs(np.arange(len(sets)), small=8).tolist()}
    want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2)
            if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert found == want


def _distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_against_dynamic_programming():
    from tessera.llm.decontaminate import myers
    rng = random.Random(5)
    for _ in range(200):
        p, t = ("".join(rng.choice("ab") for _ in range(rng.randint(1, n))) for n in (12, 25))
        assert myers(p, t, len(p))[0] == _distance(p, t)


def test_benchmark_passages(spark, odd, empty):
    from tessera.llm.decontaminate import clean_documents, contaminated
    item = "the quick brown fox jumps over the lazy dog near the old mill by the river bank at noon"
    near = item.replace("quick", "quack").replace("river", "rivers").upper()
    docs = spark.createDataFrame([(1, f"start {item} end"), (2, f"start, {near}! end"), (3, item[:40]), (4, None)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in contaminated(docs, bench).collect()} == {(1, 7, 0), (2, 7, 2)}
    assert {r["doc_id"] for r in clean_documents(docs, bench).collect()} == {3, 4}
    assert contaminated(odd, bench).count() == 0 and contaminated(empty, bench).count() == 0


def test_lines_against_brute_force(spark, odd, empty):
    from tessera.llm.lines import dedup_lines, repeated_lines
    rng = random.Random(2)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(150)]
    docs = spark.createDataFrame([(i, "\n".join(words[i * 10:i * 10 + 10])) for i in range(15)], "doc_id bigint, text string")
    want = set()
    for n, w in enumerate(words):
        first = next(m for m, v in enumerate(words) if abs(len(v) - len(w)) <= 1 and _whole(v, w) <= 1)
        if first < n:
            want.add((n // 10, n % 10, first // 10, first % 10))
    assert {tuple(r) for r in repeated_lines(docs).collect()} == want
    assert repeated_lines(odd).where("doc_id = 5").count() == 1
    assert dedup_lines(odd).columns == odd.columns and repeated_lines(empty).count() == 0


def _whole(p, t):
    row = list(range(len(t) + 1))
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def test_licenses(odd, empty):
    from tessera.llm.licenses import scan_licenses
    rows = {r["doc_id"]: r for r in scan_licenses(odd).collect()}
    assert (rows[5]["n_words"], rows[5]["n_base"], rows[5]["first_word"], rows[5]["last_word"], rows[5]["labels"]) == (10, 2, 1, 6, "mit")
    assert rows[2]["n_words"] == 0 and rows[2]["labels"] == "" and rows[2]["score"] == 0
    assert scan_licenses(empty).count() == 0


def test_license_containment():
    from tessera.llm.licenses import compiled, scan
    assert [x[2] for x in scan(b"licensed under the gnu general public license version 3", compiled())] == ["gpl-3"]


def test_warc_round_trip(spark):
    from tessera.llm.common import shared_folder
    from tessera.llm.warc import archive_pages, fetch, write_archives
    rows = [(3, "u\r\nX: 1", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "v", None), (None, "w", "zz"), (9, "x", "q" * 3_000_000), (3, "u", "<p>é</p>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted(((r["page_id"] or -1, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in archive_pages(pages).collect()), key=str)
    assert got == sorted([(3, 9, "revisit", 1), (3, 9, "revisit", 1), (1, 9, "response", None), (2, 0, "response", None),
                          (-1, 2, "response", None), (9, 3_000_000, "response", None)], key=str)
    folder = shared_folder(spark, "warc-test")
    index = write_archives(pages, folder)
    body = fetch(index, folder, spark.createDataFrame([(1,)], "page_id bigint")).collect()
    assert [bytes(r["payload"]).decode() for r in body] == ["<p>é</p>"]
    assert archive_pages(pages.limit(0)).count() == 0


def test_toxicity_learns_words_and_stems(spark, odd, empty):
    from tessera.llm import toxicity
    rng = random.Random(1)
    clean = ["".join(rng.choice(["la", "mo", "ti", "re"]) for _ in range(rng.randint(1, 3))) for _ in range(200)]
    def text(bad):
        w = [rng.choice(clean) for _ in range(rng.randint(5, 90))]
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["idiot", "grok" + rng.choice(clean)])
        return " ".join(w)
    docs = [(i, text(i % 4 == 0)) for i in range(900)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(900)], "doc_id bigint, toxic int")
    rows = toxicity.score_documents(spark.createDataFrame(docs, "doc_id bigint, text string"), labels).where("held_out").collect()
    assert np.mean([(r["predicted"] == 1) == (r["doc_id"] % 4 == 0) for r in rows]) > 0.93
    none = toxicity.score_documents(odd, labels.limit(0)).collect()
    assert len(none) == len(ROWS) and all(r["score"] == 0 for r in none)
    assert toxicity.score_documents(empty, labels.limit(0)).count() == 0


def test_quality_rules(odd, empty):
    from tessera.llm.perplexity import check_quality
    rows = {r["doc_id"]: r for r in check_quality(odd).collect()}
    assert rows[2]["n_words"] == 0 and rows[2]["base_failed"] and not rows[2]["kept"]
    assert rows[4]["n_words"] == 3200 and rows[4]["n_repeat_words"] == 3200 and rows[4]["base_failed"]
    assert check_quality(empty).count() == 0


def test_mixing_model(spark, odd, empty):
    from tessera.llm.mixer import Coder, Mixer, Numbers, score_documents
    words = [b"aa", b"bb"]
    coder = Coder(words, np.array([1] * 257 + [50, 30]))
    assert abs(sum(2.0 ** -coder.length.astype(float)) - 1) < 1e-9       # a whole code
    with np.errstate(over="ignore"):
        symbols, sizes = coder.encode(*Numbers(words)(["aa xyz bb", "", "aa"]))
        assert symbols.tolist() == [257, 120, 121, 122, 32, 258, 256, 256, 257, 256] and sizes.tolist() == [7, 1, 2]
        flat = Mixer(coder, [np.zeros(2 * n, np.float32) for n in (coder.n, coder.slots, coder.slots)])
        # without any knowledge each bit costs one bit
        assert np.allclose(flat.score(*Numbers(words)(["aa xyz bb", "", "aa"])), [coder.length[s].sum() for s in np.split(symbols, [7, 8])], atol=1e-3)
    rows = score_documents(odd).collect()
    assert len(rows) == len(ROWS) and all(r["score"] < 0 and r["base_score"] <= 0 for r in rows)
    assert score_documents(empty).count() == 0


def test_pipeline_stages_return_documents(spark):
    import corpus_pipeline
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
