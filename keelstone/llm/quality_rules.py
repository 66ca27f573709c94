"""Quality rules: distribution divergence from language references.

A first pass counts, over all documents, the character classes and the words of
each language; the references are the language's character-class shares and its
`COMMON` most frequent words. A second pass measures every whole text: the base
rules, and the Jensen-Shannon distance of its two histograms from those of its
language. A document is rejected when it fails the base rules, or when it is
long enough for a histogram and lies beyond that histogram's distance.

Words are runs of anything but ASCII white space; for the word histogram they
are lower-cased and stripped of ASCII punctuation at both ends.

Defined results: null and empty texts have no words and fail the base rules; a
null language is a language of its own; a language with fewer than
`MIN_REFERENCE` words has no reference, and the method then rejects nothing;
repeated rows are judged alike; null ids are kept.
"""

from __future__ import annotations

import string
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from keelstone.llm.common import map_slices, slices
from keelstone.session import drop_stored, prepare, stored

#: Fewest words of a text for each histogram to be compared.
MIN_CLASS_WORDS = 40
MIN_COMMON_WORDS = 60
#: Jensen-Shannon distances (base 2, 0 to 1) beyond which a text is rejected; a
#: sample's distance from its own source falls with the root of its size, so each
#: limit has a share divided by the root of the text's words.
MAX_CLASS_DISTANCE, CLASS_SLACK = 0.14, 1.0
MAX_COMMON_DISTANCE, COMMON_SLACK = 0.16, 3.4
#: Words in a language's common-word histogram.
COMMON = 100
#: Fewest words that make a reference.
MIN_REFERENCE = 200
#: Languages whose references are held at a time; more are judged in turns.
MAX_LANGUAGES = 10_000
#: Distinct words a worker holds before it hands its counts on.
FLUSH_WORDS = 200_000
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other")
_SYMBOLS = b"#*$%&|<>"
_STRIP = string.punctuation.encode()


def _class_table() -> np.ndarray:
    """The character class of each UTF-8 byte; continuation bytes are 7 and not counted."""
    t = np.full(256, CLASSES.index("other"), np.int64)
    for b in range(256):
        c = chr(b)
        if 0x80 <= b < 0xC0:
            t[b] = 7
        elif b >= 0xC0 or c.islower() and b < 128:
            t[b] = 0
        elif c.isupper():
            t[b] = 1
        elif c.isdigit():
            t[b] = 2
        elif c in " \t\n\x0b\x0c\r":
            t[b] = 3
        elif c in ".,;:!?'\"-()":
            t[b] = 4
        elif 32 < b < 127:
            t[b] = 5
    return t


_CLASS = _class_table()


def class_histogram(raw: bytes) -> np.ndarray:
    """Characters by class. Letters beyond ASCII count as lower case."""
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    return np.bincount(_CLASS, weights=by_byte, minlength=8)[:7]


def common_keys(tokens: list[bytes]) -> list[bytes]:
    """The words as the histogram counts them; those of punctuation alone are left out."""
    return [k for t in tokens if (k := t.strip(_STRIP).lower())]


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """The square root of the Jensen-Shannon divergence to base 2; 0 if either is empty."""
    if p.sum() <= 0 or q.sum() <= 0:
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, d / 2)))


def repeated_words(tokens: list[bytes], n: int = 5) -> int:
    """Words inside n-word windows that occur twice or more, the first included."""
    if len(tokens) <= n:
        return 0
    ids: dict[bytes, int] = {}
    w = np.array([ids.setdefault(t, len(ids)) for t in tokens], np.int64)
    if len(ids) == len(tokens):
        return 0
    two = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)[1]
    four = np.unique(two[:-2] * (two.max() + 1) + two[2:], return_inverse=True)[1]
    _, five, count = np.unique(four[:-1] * len(ids) + w[4:], return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[five] > 1)
    if not len(at):
        return 0
    edge = np.zeros(len(w) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def base_measures(raw: bytes) -> tuple[list[bytes], int, int, int, int]:
    """words, word_chars, n_symbols, n_dup_lines, n_repeat_words"""
    tokens = raw.split()
    chars = len(b"".join(tokens).decode("utf-8", "replace"))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return tokens, chars, symbols, len(lines) - len(set(lines)), repeated_words(tokens)


def _lang(v) -> str:
    return "" if v is None else "=" + v


def references(docs: DataFrame, lang: str = "lang", text: str = "text", common: int = COMMON) -> dict[str, tuple[np.ndarray, dict[bytes, int], np.ndarray]]:
    """Per language: class counts, the common words' places, their counts and the rest's.

    Exact over all documents: workers count words in bounded maps, Spark adds the
    counts up, and only each language's `common` top words and totals come back.
    """
    prepare(docs.sparkSession)

    def count(batches):
        words: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}
        held = 0

        def rows(out):
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.binary(), pa.int64()))], names=["l", "class", "word", "n"])

        for langs, texts in slices(batches):
            for v, t in zip(langs, texts):
                raw = (t or "").encode("utf-8", "replace")
                key = _lang(v)
                by = words.setdefault(key, Counter())
                before = len(by)
                by.update(common_keys(raw.split()))
                held += len(by) - before
                classes[key] = classes.get(key, 0) + class_histogram(raw)
            if held > FLUSH_WORDS:
                for k, by in words.items():
                    yield rows([(k, -1, w, n) for w, n in by.items()])
                words, held = {}, 0
        for k, by in words.items():
            yield rows([(k, -1, w, n) for w, n in by.items()])
        for k, c in classes.items():
            yield rows([(k, i, b"", int(n)) for i, n in enumerate(c)])

    counts = docs.select(F.col(lang).cast("string"), F.col(text)).mapInArrow(count, "l string, class int, word binary, n bigint")
    total = stored(counts.groupBy("l", "class", "word").agg(F.sum("n").alias("n")), "word-counts")
    only = total.filter("class < 0")
    ranked = only.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "word"))).filter(F.col("r") <= common)
    top: dict[str, list] = {}
    for r in ranked.collect():  # at most `common` rows a language
        top.setdefault(r.l, []).append((r.r, bytes(r.word), r.n))
    classes = {(r.l, r["class"]): r.n for r in total.filter("class >= 0").collect()}
    refs = {}
    for r in only.groupBy("l").agg(F.sum("n").alias("all")).collect():
        if r["all"] >= MIN_REFERENCE:
            best = [t[1:] for t in sorted(top[r.l])]
            n = np.array([x for _, x in best], float)
            refs[r.l] = (np.array([classes.get((r.l, i), 0) for i in range(len(CLASSES))], float), {w: i for i, (w, _) in enumerate(best)}, np.append(n, r["all"] - n.sum()))
    drop_stored(total)
    return refs


def common_histogram(tokens: list[bytes], place: dict[bytes, int]) -> np.ndarray:
    """Words by place among the common ones; the last cell holds all others."""
    at = [place.get(k, -1) for k in common_keys(tokens)]
    n = np.bincount(np.array(at, np.int64) + 1, minlength=len(place) + 1)
    return np.append(n[1:], n[0]).astype(float)


SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, class_distance double, common_distance double, kept boolean"


def judge(docs: DataFrame, refs: dict | None = None, doc_id: str = "doc_id", lang: str = "lang", text: str = "text", max_class: float = MAX_CLASS_DISTANCE, max_common: float = MAX_COMMON_DISTANCE) -> DataFrame:
    """One row a document: base measures, both distances (null where the guard or
    a missing reference leaves one out) and the verdict."""
    spark = prepare(docs.sparkSession)
    if refs is None:
        n_langs = docs.select(F.col(lang).cast("string").alias("l")).distinct().count()
        turns = max(1, -(-n_langs // MAX_LANGUAGES))
        turn = F.pmod(F.xxhash64(F.col(lang).cast("string")), F.lit(turns))
        some = [docs if turns == 1 else docs.filter(turn == k) for k in range(turns)]
        judged = [judge(part, references(part, lang, text), doc_id, lang, text, max_class, max_common) for part in some]
        return reduce(DataFrame.union, judged)
    shipped = spark.sparkContext.broadcast(refs)

    def work():
        known = shipped.value

        def fn(ids, langs, texts):
            out = []
            for i, v, t in zip(ids, langs, texts):
                raw = (t or "").encode("utf-8", "replace")
                tokens, chars, symbols, dup, rep = base_measures(raw)
                n = len(tokens)
                failed = n < 10 or 100 * rep > 20 * n
                ref = known.get(_lang(v))
                a = js_distance(class_histogram(raw), ref[0]) if ref and n >= MIN_CLASS_WORDS else None
                b = js_distance(common_histogram(tokens, ref[1]), ref[2]) if ref and n >= MIN_COMMON_WORDS else None
                out.append((i, n, chars, symbols, dup, rep, failed, a, b, not (failed or a is not None and a > max_class + CLASS_SLACK / n**0.5 or b is not None and b > max_common + COMMON_SLACK / n**0.5)))
            kinds = [pa.int64()] * 6 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
            return [pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)]

        return fn

    return map_slices(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")), work, SCHEMA)
