import gzip
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelstone.llm import decontaminate, licenses, queries, warc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_hits(text, items):
    w = WORD.findall((text or "").translate(UPPER))
    hit, found = set(), set()
    for item, t in items:
        iw = WORD.findall((t or "").translate(UPPER))
        k = min(10, len(iw))
        grams = {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)} if k else ()
        for i in range(len(w) - k + 1):
            if grams and tuple(w[i : i + k]) in grams:
                hit |= set(range(i, i + k))
                found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_query_equals_brute_force(spark, sf, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.op8_decontaminate(spark, sf).collect()}
    assert rows == {i: brute_hits(t, items) for i, t in texts.items()}
    assert any(r[-1] for r in rows.values())


def test_large_benchmarks_give_the_same(spark, sf, docs):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").unionByName(spark.createDataFrame([(-1, "of the"), (-2, None), (-3, "..."), (-1, "of the")], "item_id bigint, text string"))
    key = lambda r: (r.doc_id, r.n_words, r.n_hit, r["items"], r.hit_spans)
    small = sorted(map(key, decontaminate.find_contamination(docs, bench).collect()))
    large = sorted(map(key, decontaminate.find_contamination(docs, bench, max_broadcast_bytes=0).collect()))
    assert small == large
    kept = decontaminate.remove_documents(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _, n, *_ in small if not n]
    assert sorted(r.doc_id for r in decontaminate.remove_documents(docs, bench, max_broadcast_bytes=0).collect()) == [i for i, _, n, *_ in small if not n]


def test_decontaminate_edges(spark, edge, none):
    bench = spark.createDataFrame([(1, "The SAME short"), (None, "word word"), (2, None), (3, "")], "item_id bigint, text string")
    rows = decontaminate.find_contamination(edge, bench).collect()
    assert len(rows) == edge.count()
    by = {r.doc_id: (r.n_hit, r["items"]) for r in rows}
    assert by[5] == (3, ["1"]) and by[4] == (30_000, [""]) and by[1] == (0, []) and by[7] == (0, [])
    assert decontaminate.find_contamination(none, bench).count() == 0
    assert {r.n_hit for r in decontaminate.find_contamination(edge, bench.limit(0)).collect()} == {0}
    assert decontaminate.remove_documents(edge, bench).columns == edge.columns


def brute_licenses(text):
    w = licenses.template_words(text or "")
    joined = " " + " ".join(w) + " "
    return {name for name, t in licenses.TEMPLATES if " " + " ".join(licenses.template_words(t)) + " " in joined}


def test_verbatim_notices_are_found(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r.doc_id: set(r.licenses.split(",")) - {""} for r in queries.op2_license_scan(spark, sf).collect()}
    assert len(rows) == len(texts)
    want = {i: brute_licenses(t) for i, t in texts.items()}
    assert rows == want and sum(map(bool, want.values())) > 20


def test_license_variants_and_edges(spark, edge, none):
    pad = " ".join(f"w{i}" for i in range(40))
    texts = [f"{' '.join(f'x{j}' for j in range(k))} {t} {pad}" for k in range(6) for _, t in licenses.TEMPLATES]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: {m.template for m in r.matches} for r in licenses.scan(df).collect()}
    assert all(i % len(licenses.TEMPLATES) in got[i] for i in got)
    near = "Permission is granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    one = licenses.scan(spark.createDataFrame([(1, near), (2, "Released under the terms of the MIT license")], "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [m.license for m in one[0].matches] == ["MIT"] and one[0].matches[0].containment >= 0.8 and one[1].matches == []
    assert licenses.scan(edge).count() == edge.count() and licenses.scan(none).count() == 0
    assert {r.n_matches for r in licenses.digest_rows(licenses.scan(edge)).collect()} == {0}


@pytest.mark.parametrize("n_files", [1, 3])
def test_audit_finds_every_damage(spark, n_files):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://x/"), F.col("id").cast("string")).alias("url"), F.repeat(F.lit("é<p>"), (F.col("id") % 9).cast("int")).alias("html"))
    a = warc.archive(pages, n_files)
    hurt = pages.withColumn("html", F.when(F.col("page_id") == 1234, "ruined").otherwise(F.col("html")))
    b = warc.archive(hurt, n_files).filter("not (file = 0 and seq < 1)")
    assert warc.audit(a, a).count() == 0
    first = {(r.kind, r.key_a) for r in warc.audit(a, b).collect()}
    assert ("corrupt", 1234) in first and ("missing", 0) in first
    rows = a.filter("file = 0").orderBy("seq").collect()
    assert all(x.offset + x.length == y.offset for x, y in zip(rows, rows[1:]))


def test_records_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a", "é\r\n\r\nWARC/1.0"), (2, None, None), (None, "http://c", "x"), (1, "http://a", "again")], "page_id bigint, url string, html string")
    rows = [r[0] for r in df.select(warc.record_bytes(F.col("url"), F.col("html"))).collect()]
    data = "".join(rows).encode()
    (tmp_path / "a.warc").write_bytes(data)
    parsed = warc.parse(data)
    assert [p.decode() for _, _, _, p in parsed] == ["é\r\n\r\nWARC/1.0", "", "x", "again"] and sum(n for _, n, _, _ in parsed) == len(data)
    read = warc.read_files(spark, str(tmp_path))
    assert read.count() == 4 and warc.audit(read, read).count() == 0
    assert warc.archive(df, 2).count() == 4 and warc.audit(warc.archive(df.limit(0), 1), warc.archive(df, 1)).filter("kind = 'extra'").count() == 4


def test_one_damaged_header_is_one_corrupt_record(spark, tmp_path):
    """Damage in a header or its length: later records keep their places."""
    record = lambda i: b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://e.org/%d\r\nContent-Length: 120\r\n\r\n%s\r\n\r\n" % (i, (b"page %d " % i * 20)[:120])
    whole = [record(i) for i in range(9)]
    damages = {
        "magic": lambda r: r.replace(b"WARC/1.0", b"WAXC/1.0"),
        "longer": lambda r: r.replace(b"Length: 120", b"Length: 920"),
        "shorter": lambda r: r.replace(b"Length: 120", b"Length: 020"),
        "nonsense": lambda r: r.replace(b"Length: 120", b"Length: 1?0"),
        "end": lambda r: r.replace(b"120\r\n\r\n", b"120\r\n\r "),
    }
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir()
    b.mkdir()
    want = set()
    for name, damage in damages.items():
        for at in (0, 4, 8):
            bad = [damage(r) if i == at else r for i, r in enumerate(whole)]
            assert bad[at] != whole[at]
            (a / f"{name}{at}.warc").write_bytes(b"".join(whole))
            (b / f"{name}{at}.warc").write_bytes(b"".join(bad))
            got = warc.parse(b"".join(bad))
            assert [(x, n) for x, n, _, _ in got] == [(len(b"".join(bad[:i])), len(r)) for i, r in enumerate(bad)]
            want.add((f"{name}{at}.warc", at, "corrupt"))
    rows = warc.audit(*[warc.read_files(spark, str(p)) for p in (a, b)]).collect()
    assert {(r.file, r.seq, r.kind) for r in rows} == want
    assert sum(n for _, n, _, _ in warc.parse(b"".join(whole)[:-70])) == len(b"".join(whole)) - 70 and warc.parse(b"") == []


def records(n, seed=1):
    g = random.Random(seed)
    return [b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: http://x/%d\r\nContent-Length: %d\r\n\r\n" % (i, k) + bytes(g.randrange(32, 127) for _ in range(k)) + b"\r\n\r\n" for i, k in enumerate(g.randrange(40) for _ in range(n))]


@pytest.mark.parametrize("pack", [bytes, gzip.compress])
def test_a_damaged_byte_costs_one_record_at_most(pack):
    parts = [pack(r) for r in records(9)]
    data = b"".join(parts)
    whole = [(o, n, u) for o, n, u, _ in warc.parse(data)]
    assert len(whole) == 9 and [u for _, _, u in whole] == [f"http://x/{i}" for i in range(9)] and [n for _, n, _ in whole] == [len(p) for p in parts]
    for at in range(len(data)):
        for flip in (1, 0xFF):
            got = warc.parse(data[:at] + bytes([data[at] ^ flip]) + data[at + 1 :])
            assert len({(o, n, u) for o, n, u, _ in got} & set(whole)) >= 8, (at, flip)
            assert [o for o, *_ in got[1:]] == [o + n for o, n, *_ in got[:-1]]


def test_audit_of_files_equals_brute_force(spark, tmp_path):
    """Lost, added, exchanged and damaged records: one row each, wherever the rest has moved."""
    good = records(300)
    bad = list(good)
    bad[250] = good[250].replace(b"http", b"ftp")
    bad[200] = good[200][:-5] + b"?" + good[200][-4:]
    bad.insert(100, records(1, 9)[0].replace(b"x/0", b"new"))
    del bad[40]
    for side, rows, pack in (("a", good, bytes), ("b", bad, bytes), ("c", good, gzip.compress), ("d", bad, gzip.compress)):
        (tmp_path / side).mkdir()
        (tmp_path / side / ("f.warc" + ".gz" * (pack is not bytes))).write_bytes(b"".join(map(pack, rows)))
    for x, y in ("ab", "cd"):
        found = warc.audit(*(warc.read_files(spark, str(tmp_path / s)) for s in (x, y)))
        want = [(40, "missing"), (99, "extra"), (250, "corrupt")] + ([(200, "corrupt")] if len(good[200]) else [])
        assert sorted((r.seq, r.kind) for r in found.collect()) == sorted(want)
    moved = warc.audit(*(warc.read_files(spark, str(tmp_path / s)) for s in "ab"), moved=True).filter("kind = 'moved'")
    assert moved.count() == 257  # all that is whole behind the lost record


def test_files_are_bounded_whatever_the_keys(spark):
    rows = [(None, "u", f"t{i % 700}") for i in range(2000)] + [(5, "u", "same")] * 1500 + [(i, f"u{i}", "z") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)
    a = warc.archive(pages, 3, most=256)
    n = {r.file: (r["count"], r.s) for r in a.groupBy("file").agg(F.count("*").alias("count"), (F.max("seq") + 1).alias("s")).collect()}
    assert sum(c for c, _ in n.values()) == 3800 and all(c == s <= 256 for c, s in n.values())
    assert warc.audit(a, warc.archive(pages, 3, most=256)).count() == 0
    lost = warc.audit(a, warc.archive(pages.filter("page_id is null or page_id <> 290"), 3, most=256)).collect()
    assert [(r.kind, r.key_a) for r in lost] == [("missing", 290)]


def test_windows_of_one_hash_are_told_apart(monkeypatch, spark, sf, docs):
    """The index is exact whatever the hashes: here all but a few bits of them are cut off."""
    items = [(str(i), decontaminate.words(f"one two w{i % 4} four five six seven eight nine ten w{i} end")) for i in range(30)] + [("short", decontaminate.words("two w1"))]
    texts = [f"x one two w{i} four five six seven eight nine ten w{3 * i} end two w1" for i in range(12)] + ["", "one two", "two W1"]
    tokens, bounds = decontaminate._tokens(texts)
    plain = decontaminate.WindowIndex(items).scan(tokens, bounds)
    real = decontaminate.window_hashes
    monkeypatch.setattr(decontaminate, "window_hashes", lambda h, n: real(h, n) & np.uint64(3))
    cut = decontaminate.WindowIndex(items).scan(tokens, bounds)
    assert cut[0].tolist() == plain[0].tolist() and cut[1] == plain[1] and len(plain[1]) == 13
    assert plain[1][1] == {"short"} | {str(i) for i in range(30) if i % 4 == 1}


def test_notices_with_a_word_replaced_are_found(spark):
    """Every notice of 14 words or more, each word replaced in turn, at five offsets: containment
    is 0.8 or more wherever a replaced word is in few enough shingles, and all of those are found."""
    rows, want = [], {}
    for t, (_, text) in enumerate(licenses.TEMPLATES):
        w = licenses.template_words(text)
        whole = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
        for at in range(len(w)) if len(w) >= 14 else ():
            for off in range(5):
                v = [f"x{j}" for j in range(off)] + w[:at] + ["replaced"] + w[at + 1 :] + [f"y{j}" for j in range(30)]
                share = len(whole & {tuple(v[i : i + 3]) for i in range(len(v) - 2)}) / len(whole)
                if share >= licenses.CONTAINED:
                    want[len(rows)] = (t, share)
                    rows.append((len(rows), " ".join(v)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: {m.template: m.containment for m in r.matches} for r in licenses.scan(df).collect()}
    missed = [i for i, (t, share) in want.items() if abs(got[i].get(t, 0) - share) > 1e-9]
    assert len(want) > 500 and len(missed) <= 0.005 * len(want), (len(missed), len(want))


def test_large_template_lists_give_the_same(spark, edge, none):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    key = lambda r: (r.doc_id, [tuple(m) for m in r.matches])
    joined = licenses.scan(docs, literal_words=0)
    assert sorted(map(key, joined.collect())) == sorted(map(key, licenses.scan(docs).collect()))
    assert sum(bool(r.matches) for r in joined.collect()) > 20
    assert licenses.scan(edge, literal_words=0).count() == edge.count() and licenses.scan(none, literal_words=0).count() == 0
    many = [(f"L{t}", " ".join(f"v{t}w{i * i % 997}" for i in range(400))) for t in range(250)]
    rows = [(t, f"before {text} after") for t, (_, text) in enumerate(many)] + [(-1, "v1w0 v1w1 v1w4 nothing else")]
    got = {r.doc_id: [(m.license, m.containment) for m in r.matches] for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), many).collect()}
    assert got == {t: [(f"L{t}", 1.0)] for t in range(250)} | {-1: []}
