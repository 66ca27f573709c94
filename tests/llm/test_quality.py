import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from keelstone.llm import quality_model, quality_rules, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    text = text or ""
    w = WORD.findall(text)
    lines, dup = set(), 0
    for x in text.split("\n"):
        if WORD.search(x):
            dup += x in lines
            lines.add(x)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed


CLASS = {"upper": re.compile("[A-Z]"), "digit": re.compile("[0-9]"), "space": re.compile("[ \t\n\x0b\x0c\r]"), "stop": re.compile("[.,;:!?'\"()-]"), "lower": re.compile("[a-z]|[^\x00-\x7f]"), "other": re.compile("[\x00-\x08\x0e-\x1f\x7f]")}


def brute_distance(p, q):
    """Square root of the Jensen-Shannon divergence of two count dictionaries, base 2."""
    a, b = sum(p.values()), sum(q.values())
    if not a or not b:
        return 0.0
    total = 0.0
    for k in p.keys() | q.keys():
        x, y = p.get(k, 0) / a, q.get(k, 0) / b
        total += sum(z * math.log2(z / ((x + y) / 2)) for z in (x, y) if z) / 2
    return math.sqrt(max(total, 0))


def brute_kept(text, failed, class_counts, top, counts):
    """The verdict, from dictionaries of the text's characters and words."""
    w = WORD.findall(text or "")
    if failed or counts.sum() < quality_rules.MIN_REFERENCE:
        return not failed
    mine = Counter()
    for c in text:
        mine[next((k for k, p in CLASS.items() if p.match(c)), "symbol")] += 1
    if len(w) >= 40 and brute_distance(mine, dict(zip(quality_rules.CLASSES, class_counts))) > 0.14 + 1 / math.sqrt(len(w)):
        return False
    common = Counter(x if x in set(top) else None for x in quality_rules.common_keys([x.encode() for x in w]))
    return not (len(w) >= 60 and brute_distance(common, dict(zip([*top, None], counts))) > 0.16 + 3.4 / math.sqrt(len(w)))


def test_rules_equal_brute_force(spark, sf, docs):
    rows = docs.collect()
    texts = {r.doc_id: r.text for r in rows}
    refs = {}
    for lang in {r.lang for r in rows}:
        c, k = Counter(), np.zeros(7)
        for r in rows:
            if r.lang == lang:
                c.update(quality_rules.common_keys([w.encode() for w in WORD.findall(r.text)]))
                k += quality_rules.class_histogram(r.text.encode())
        top = sorted(c.items(), key=lambda x: (-x[1], x[0]))[: quality_rules.COMMON]
        refs[lang] = (k, [w for w, _ in top], np.array([n for _, n in top] + [sum(c.values()) - sum(n for _, n in top)], float))
    got = {lang[1:]: (k, sorted(p, key=p.get), n) for lang, (k, p, n) in quality_rules.references(docs).items()}
    for lang, (k, words, n) in refs.items():
        if n.sum() >= quality_rules.MIN_REFERENCE:
            assert (got[lang][0] == k).all() and got[lang][1] == words and (got[lang][2] == n).all()
    n_rejected = 0
    langs = {r.doc_id: r.lang for r in rows}
    for r in queries.op4_quality_rules(spark, sf).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_base(texts[r.doc_id])
        k, top, n = refs[langs[r.doc_id]]
        assert r.kept == brute_kept(texts[r.doc_id], r.base_failed, k, top, n)
        n_rejected += not r.base_failed and not r.kept
    assert n_rejected


def test_many_languages_are_judged_in_turns(spark, docs, monkeypatch):
    whole = sorted(quality_rules.judge(docs).collect())
    monkeypatch.setattr(quality_rules, "MAX_LANGUAGES", 2)
    assert sorted(quality_rules.judge(docs).collect()) == whole


def test_distance():
    p, q = np.array([1.0, 0, 3]), np.array([0, 2.0, 0])
    assert quality_rules.js_distance(p, q) == pytest.approx(1) and quality_rules.js_distance(p, 5 * p) == 0
    assert quality_rules.js_distance(p, np.zeros(3)) == 0


def test_most_labelled_junk_goes_and_good_text_stays(spark):
    sf = "/root/testdata/sf0.01"
    y = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(y[r.doc_id], r.kept) for r in queries.op4_quality_rules(spark, sf).collect() if r.doc_id in y and not r.base_failed]
    good = [k for q, k in rows if q == 1]
    junk = [k for q, k in rows if q == 0]
    assert sum(good) >= 0.98 * len(good) and sum(junk) <= 0.2 * len(junk)


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    y = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op6_quality_classifier(spark, sf).collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(y[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in y]
    good, bad = [s for q, s in held if q], [s for q, s in held if not q]
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) >= 0.97
    assert sum((s >= 0.5) == q for q, s in held) >= 0.95 * len(held)


def test_features_do_not_depend_on_the_slice():
    texts = ["One two  three", None, "", "é" * 50, "a b\nc", "word " * 500]
    table = np.random.default_rng(1).normal(size=quality_model.BUCKETS).astype(np.float32)
    assert np.allclose(quality_model.score(table, texts), [quality_model.score(table, [t])[0] for t in texts])


M64 = (1 << 64) - 1


def brute_bucket(h, kind):
    """A feature's bucket, in Python integers."""
    mix = 0x9E3779B97F4A7C15
    h = ((h ^ kind * 0xD6E8FEB86659FD93 & M64) * mix) & M64
    h = ((h ^ h >> 29) * mix) & M64
    return h >> 46


def brute_score(table, text):
    """The mean of the looked-up logits of every feature, word by word, through the logistic function."""
    words = (text or "").encode("utf-8", "replace").split()
    whole = [sum((c + 1) * pow(0x100000001B3, k, 1 << 64) for k, c in enumerate(w)) & M64 for w in words]
    seen = [brute_bucket(0, 9)] + [brute_bucket(h, 1) for h in whole] + [brute_bucket((a * 31 + b) & M64, 2) for a, b in zip(whole, whole[1:])]
    for w in words:
        bound = b" " + w + b" "
        for n in (3, 4, 5):
            for i in range(len(bound) - n + 1):
                h = 0
                for c in bound[i : i + n]:
                    h = (h * 257 + c) & M64
                seen.append(brute_bucket(h, 2 + n))
    return 1 / (1 + math.exp(-sum(float(table[k]) for k in seen) / len(seen)))


def test_classifier_equals_a_scorer_of_dictionaries(spark, sf, docs):
    table = quality_model.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r.doc_id: r.score for r in quality_model.classify(docs, table).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.doc_id] == pytest.approx(brute_score(table, r.text), abs=1e-6)


@pytest.mark.parametrize("block", [5, 64, 1000])
def test_long_texts_score_as_short_ones(monkeypatch, block):
    """Cuts at white space lose no feature, word pairs across them included."""
    table = np.random.default_rng(2).normal(size=quality_model.BUCKETS).astype(np.float32)
    texts = ["one  two\nthree " * 40, "", "x" * 300, None, " " * 200 + "a b" + " " * 200 + "c", "é " * 90]
    want = quality_model.score(table, texts)
    assert want == pytest.approx([brute_score(table, t) for t in texts], abs=1e-6)
    monkeypatch.setattr(quality_model, "BLOCK_CHARS", block)
    assert quality_model.score(table, texts) == pytest.approx(want, abs=1e-9)


def test_bytes_learnt_from_are_bounded(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert not np.array_equal(quality_model.fit(docs, labels), quality_model.fit(docs, labels, train_bytes=20_000))
    assert quality_model.fit(docs, labels, train_bytes=0).any() == quality_model.fit(docs, labels.limit(0)).any()


def test_edges(spark, edge, none):
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 1), (None, 1), (99, 0), (7, None)], "doc_id bigint, quality int")
    table = quality_model.fit(edge, labels)
    assert quality_model.classify(edge, table).count() == edge.count()
    assert quality_model.classify(none, quality_model.fit(none, labels.limit(0))).count() == 0
    assert {r.score for r in quality_model.classify(edge, quality_model.fit(edge, labels.limit(0))).collect()} == {0.5}
    kept = quality_model.keep_good(edge, np.ones(quality_model.BUCKETS, np.float32))
    assert kept.columns == edge.columns and kept.count() == edge.count()
    assert quality_rules.judge(edge).count() == edge.count() and quality_rules.judge(none).count() == 0
