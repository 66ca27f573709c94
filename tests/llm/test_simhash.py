import random

from xxhash import xxh64_intdigest

from keelstone.llm import queries, simhash
from keelstone.llm.components import components


def brute_fingerprint(text, k=3):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    h = [xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=2):
    label = {}
    for i in ids:
        if i in label:
            continue
        group, todo = {i}, [i]
        while todo:
            a = todo.pop()
            for b in ids:
                if b not in group and (fps[a] ^ fps[b]).bit_count() <= radius:
                    group.add(b)
                    todo.append(b)
        label |= dict.fromkeys(group, min(group))
    return label


def test_query_equals_brute_force(spark, sf, docs):
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    want = brute_components(sorted(fps), fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op5_simhash_near_dedup(spark, sf).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_every_pair_within_the_radius_meets_in_a_table():
    g = random.Random(3)
    for radius in (1, 2, 3, 4):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(2000):
            flip = sum(1 << b for b in g.sample(range(64), radius))
            assert any(not flip & m & (2**64 - 1) for m in masks)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_connect_dense_buckets(spark):
    g = random.Random(5)
    for radius, small in ((2, 32), (2, 2), (3, 2)):
        centres = [g.getrandbits(64) for _ in range(4)]
        fps = sorted({c ^ sum(1 << b for b in g.sample(range(64), g.randrange(6))) for c in centres for _ in range(60)})
        df = spark.createDataFrame([(signed(f),) for f in fps], "fp bigint")
        got = {r.node: r.label for r in components(simhash.links(df, radius, small)).collect()}
        want = brute_components(list(range(len(fps))), fps, radius)
        sets = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
        assert sets({i: got.get(signed(f), signed(f)) for i, f in enumerate(fps)}) == sets({i: f for i, f in want.items()})


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    df = spark.createDataFrame([*chain, *star, (5, 5), (7, None), (1001, 1000)], "u bigint, v bigint")
    got = {r.node: r.label for r in components(df).collect()}
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1300)}
    assert components(df.limit(0)).count() == 0


def test_edges(edge, none):
    rows = simhash.near_duplicates(edge).collect()
    assert len(rows) == edge.count()
    by = {r.doc_id: (r.fp, r.component_id) for r in rows}
    assert by[1] == by[2] == by[3] == (0, 1)
    assert by[5][1] == by[6][1] == 5 and by[None][1] is None
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 4, 5, 7, None]
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0
