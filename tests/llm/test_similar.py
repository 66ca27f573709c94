import random

import numpy as np
import pytest

import corpus_pipeline as pipeline
from keelstone.llm import quality_model, similar
from tests.llm.test_licenses_warc_decontaminate import brute_hits
from tests.llm.test_simhash import brute_fingerprint

WORDS = [f"w{i}" for i in range(500)]


def brute_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_kept(rows):
    """The least id of each component over all pairs of J >= 0.8; rows: (doc_id, text), ids distinct."""
    sets = {i: brute_set(t) for i, t in rows}
    near = {i: [] for i in sets}
    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if 4 * max(len(a), len(b)) <= 5 * min(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                near[i].append(j)
                near[j].append(i)
    kept, seen = set(), set()
    for i in ids:
        if i not in seen:
            kept.add(i)
            todo = [i]
            while todo:
                if (a := todo.pop()) not in seen:
                    seen.add(a)
                    todo += near[a]
    return kept


def edited(g, words, n):
    out = list(words)
    for at in g.sample(range(len(out)), n):
        out[at] = g.choice(WORDS)
    return " ".join(out)


def test_stage_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {r.doc_id for r in pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == brute_kept(rows)


def test_run_keeps_what_brute_force_keeps(spark, sf, docs):
    """Classifier, similarity and decontamination over the whole run."""
    rows = {r.doc_id: r.text for r in docs.collect()}
    table = quality_model.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = [(i, t) for i, t in rows.items() if quality_model.score(table, [t])[0] >= 0.5]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {i for i in brute_kept(good) if not brute_hits(rows[i], items)[1]}
    assert {r.doc_id for r in pipeline.run(spark, sf).select("doc_id").collect()} == clean


def test_edited_copies_beyond_the_radius_go(spark):
    """Scattered edits: J of 0.8 or more, fingerprints more than two bits apart."""
    g = random.Random(2)
    rows, far = [], 0
    for i in range(60):
        a = g.choices(WORDS, k=200)
        b = edited(g, a, 1 + i % 4)
        rows += [(2 * i, " ".join(a)), (2 * i + 1, b)]
        far += (brute_fingerprint(" ".join(a)) ^ brute_fingerprint(b)).bit_count() > 2
    kept = {r.doc_id for r in pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()}
    assert far > 40 and kept == brute_kept(rows) == {2 * i for i in range(60)}


@pytest.mark.parametrize("chunk", [512, 8])
def test_large_groups_on_both_sides_of_the_limit(spark, chunk, monkeypatch):
    """Groups whose pairs lie at J of 0.5 to 1: members that only some others link."""
    links = similar.links
    monkeypatch.setattr(similar, "links", lambda distinct, texts: links(distinct, texts, chunk))
    g = random.Random(4)
    rows = []
    for c in range(3):
        base = g.choices(WORDS, k=150)
        rows += [(1000 * c + i, edited(g, base, g.randrange(9))) for i in range(80)]
    kept = {r.doc_id for r in similar.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = brute_kept(rows)
    assert 3 < len(want) < len(rows) and kept == want


def test_a_large_group_gives_links_in_proportion(spark, monkeypatch):
    """200 near copies that all link, which the first round is kept from connecting: 19,900 pairs."""
    links, components, counted, rounds = similar.links, similar.components, [], []

    def unconnected(edges):
        rounds.append(1)
        return components(edges).filter(str(len(rounds) > 1))

    def count(distinct, texts):
        counted.append((found := links(distinct, texts)).count())
        return found

    monkeypatch.setattr(similar, "components", unconnected)
    monkeypatch.setattr(similar, "links", count)
    rows = [(i, " ".join(f"x{i}" if k == i % 140 + 5 else f"b{k}" for k in range(150))) for i in range(200)]
    kept = {r.doc_id for r in similar.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept == brute_kept(rows) == {0} and counted[0] <= 10 * len(rows)


def test_groups_connect_what_brute_force_connects():
    """Bound and whole sets over groups of one chunk and of two, each member with a label of its own or a shared one."""
    g = np.random.default_rng(3)
    for first, m in ((12, 12), (5, 12), (40, 40), (17, 40)):
        base = g.integers(0, 1 << 63, 90, np.uint64)
        sets = [np.unique(np.concatenate([base[g.random(90) > g.choice([0.02, 0.08])], g.integers(0, 1 << 63, g.integers(1, 9), np.uint64)])) for _ in range(m)]
        label = [int(x) for x in g.integers(0, m, m)]
        pairs = [(a, b) for a in range(first) for b in range(first if first < m else a + 1, m) if label[a] != label[b] and similar.alike(sets[a], sets[b])]

        def connected(edges):
            at = {x: x for x in label}
            for a, b in edges:
                old, new = at[label[a]], at[label[b]]
                at = {x: new if y == old else y for x, y in at.items()}
            return {frozenset(x for x in at if at[x] == y) for y in at.values()}

        ids = list(range(m))
        u, v = similar._joined(first, ids, label, [x.tobytes() for x in sets])
        assert all(similar.alike(sets[a], sets[b]) for a, b in zip(u, v))
        assert connected(zip(u, v)) == connected(pairs) and pairs and len(u) < len(set(label))
        found = similar._across(first, ids, label, [len(x) for x in sets], [similar._parities(x) for x in sets])
        assert {x for p in pairs for x in p} <= set(found[0]) and len(set(found[0])) == len(found[0])
        to = dict(zip(found[0], found[3]))
        assert all(to[a] == to[b] for a, b in pairs)


def test_the_limit_itself(spark):
    """9 of 11 shingles link, as do 8 of 10; 7 of 9 do not."""
    w = [f"x{i}" for i in range(15)]
    for n, linked in ((15, True), (14, True), (13, False)):
        a, b = w[: n - 1], w[1:n]
        sets = brute_set(" ".join(a)), brute_set(" ".join(b))
        assert similar.alike(*(similar.shingles(" ".join(x)) for x in (a, b))) == linked == (5 * len(sets[0] & sets[1]) >= 4 * len(sets[0] | sets[1]))


def test_edges(spark, edge, none):
    kept = similar.keep_one(edge)
    assert kept.columns == edge.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 4, 5, 7, None]
    assert similar.keep_one(none).count() == 0
    alike = spark.createDataFrame([(3, "A b\tc"), (2, "a  B c"), (9, "a b d")], "doc_id bigint, text string")
    assert {r.doc_id for r in similar.keep_one(alike).collect()} == {2, 9}


def test_recall_of_the_keys():
    """Sets at the limit share a key, whatever their size."""
    g = random.Random(6)
    factors = similar._factors()
    for size in (9, 90, 900):
        for _ in range(200):
            h = [g.getrandbits(64) for _ in range(size * 10 // 9)]
            cut = size // 9
            a, b = (np.array(sorted(x), np.uint64) for x in (h[cut:], h[: len(h) - cut]))
            assert set(similar._keys(a, factors)) & set(similar._keys(b, factors))
