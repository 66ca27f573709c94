"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its features: its words, its word
pairs, the character n-grams of each word with its bounds, and one feature that
every document has. All are hashed into `BUCKETS` rows. A softmax layer over that
mean gives the score. Vectors and layer are trained together by stochastic
gradient descent in numpy, on at most `TRAIN_ROWS` labelled rows and `TRAIN_BYTES`
of text, those of the least hashed ids; scoring has no such bounds.

With two labels the output depends on a feature only through the difference of
its two logits, so workers get one number a bucket, and a score is a mean of
look-ups over the whole text.

Defined results: null and empty texts have the common feature alone and get a
score; rows that repeat are scored alike; labels that are null, or whose id has no
document, teach nothing; contradictory labels of an id count as 1; with no labels
every score is 0.5; a null id is scored and never held out.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelstone.llm.common import longs, map_slices, parts
from keelstone.session import prepare

BUCKETS = 1 << 18
DIM = 16
NGRAMS = (3, 4, 5)
#: Labelled rows that the model learns from, and bytes of their texts, at most.
TRAIN_ROWS = 3000
TRAIN_BYTES = 64 << 20
EPOCHS = 8
RATE = 0.5
_P = 0x100000001B3
_P_INVERSE = pow(_P, -1, 1 << 64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    """Spread 64-bit hashes over the buckets, apart for each kind of feature."""
    h = (h ^ np.uint64(kind * 0xD6E8FEB86659FD93 & (1 << 64) - 1)) * _MIX
    h ^= h >> np.uint64(29)
    h *= _MIX
    return (h >> np.uint64(64 - 18)).astype(np.int32)


#: Characters that are hashed at a time. A longer text is read in pieces cut at white
#: space; the last word of a piece is carried over, so its features are those of one piece.
BLOCK_CHARS = 1 << 18
_BLANK = re.compile(r"[ \t\n\r\x0b\x0c]")


def blocks(texts: list[str | None]):
    """Yield (texts, their places) of BLOCK_CHARS characters or little more."""
    held, places, size = [], [], 0
    for i, t in enumerate(texts):
        t, at = t or "", 0
        while len(t) - at > BLOCK_CHARS and (cut := _BLANK.search(t, at + BLOCK_CHARS)):
            yield [t[at : cut.start()]], [i]
            at = cut.end()
        held.append(t[at:] if at else t)
        places.append(i)
        size += len(t) - at
        if size > BLOCK_CHARS:
            yield held, places
            held, places, size = [], [], 0
    if held:
        yield held, places


def features(texts: list[str | None]):
    """Yield (buckets, owners) for each kind of feature; owners are places in texts, ascending."""
    yield _bucket(np.zeros(len(texts), np.uint64), 9), np.arange(len(texts))
    last: dict[int, np.ndarray] = {}  # the last word's hash of a text that goes on in the next block
    for held, places in blocks(texts):
        at = np.array(places)
        before = [last.pop(i, None) for i in places]
        for buckets, owner in _features(held, before):
            yield buckets, at[owner]
        if before[-1] is not None:
            last[places[-1]] = before[-1]


def _features(texts: list[str], before: list[np.ndarray | None]):
    """The features of a block's words. `before` has the hash of the word that precedes each
    text, where it is the rest of a longer one; its last entry becomes the last word's."""
    buffer, starts, stops, owner, at = [b" "], [], [], [], 1
    for i, t in enumerate(texts):
        for w in t.encode("utf-8", "replace").split():
            starts.append(at)
            at += len(w)
            stops.append(at)
            owner.append(i)
            buffer += (w, b" ")
            at += 1
        buffer.append(b" ")
        at += 1
    if not starts:
        return
    raw = np.frombuffer(b"".join(buffer), np.uint8)
    starts, stops, owner = np.array(starts), np.array(stops), np.array(owner)
    with np.errstate(over="ignore"):
        one, none = np.ones(1, np.uint64), np.zeros(1, np.uint64)
        powers = np.cumprod(np.concatenate([one, np.full(len(raw), _P, np.uint64)]))
        unpowers = np.cumprod(np.concatenate([one, np.full(len(raw), _P_INVERSE, np.uint64)]))
        total = np.concatenate([none, np.cumsum((raw.astype(np.uint64) + one) * powers[:-1])])
        word = (total[stops] - total[starts]) * unpowers[starts]
        yield _bucket(word, 1), owner
        same = owner[1:] == owner[:-1]
        yield _bucket(word[:-1] * np.uint64(31) + word[1:], 2)[same], owner[1:][same]
        for i, h in enumerate(before):
            first = int(np.searchsorted(owner, i))
            if h is not None and first < len(owner) and owner[first] == i:
                yield _bucket(h * np.uint64(31) + word[first : first + 1], 2), np.array([i])
        if owner[-1] == len(texts) - 1:
            before[-1] = word[-1:]
        blanks = np.concatenate([[0], np.cumsum(raw == 32)])
        of = np.searchsorted(starts, np.arange(len(raw)), "right") - 1
        of_byte = owner[np.maximum(of, 0)]
        codes = raw.astype(np.uint64)
        for n in NGRAMS:
            if len(raw) >= n:
                h = codes[: len(raw) - n + 1].copy()
                for k in range(1, n):
                    h = h * np.uint64(257) + codes[k : len(raw) - n + 1 + k]
                i = np.flatnonzero(blanks[n - 1 : len(raw)] - blanks[1 : len(raw) - n + 2] == 0)  # no blank inside
                yield _bucket(h[i], 2 + n), of_byte[i + 1]


def score(table: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """The chance of label 1 of each text."""
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for buckets, owner in features(texts):
        total += np.bincount(owner, weights=table[buckets], minlength=len(texts))
        n += np.bincount(owner, minlength=len(texts))
    return 1 / (1 + np.exp(-total / np.maximum(n, 1)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 13) -> np.ndarray:
    """Train on (buckets, counts, label); returns each bucket's logit of label 1 less that of 0."""
    g = np.random.default_rng(seed)
    E = g.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    W = np.zeros((DIM, 2), np.float32)
    steps, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for i in g.permutation(len(rows)):
            ids, counts, label = rows[i]
            share = (counts / counts.sum()).astype(np.float32)
            v = share @ E[ids]
            z = v @ W
            p = np.exp(z - z.max())
            d = p / p.sum()
            d[label] -= 1
            lr = np.float32(rate * (1 - done / steps))
            back = W @ d
            W -= lr * np.outer(v, d)
            E[ids] -= lr * share[:, None] * back * np.float32(len(ids) ** 0.5)  # a mean over thousands of features moves each too little
            done += 1
    return (E @ (W[:, 1] - W[:, 0])).astype(np.float32)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES, doc_id: str = "doc_id", text: str = "text") -> np.ndarray:
    """The table of bucket logits, learnt from labelled rows that are not held out. Rows are
    chosen by id and size alone, so no text moves but those that are learnt from."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    few = F.broadcast(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows))  # at most train_rows rows of two numbers
    sized = docs.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("size")).join(few, "doc_id").groupBy("doc_id", "h", "size", "y").agg(F.count(F.lit(1)).alias("copies")).orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(train_rows)
    so_far = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "h").rowsBetween(Window.unboundedPreceding, 0)  # of train_rows rows of numbers
    fit_in = sized.withColumn("sum", F.sum(F.col("size") * F.col("copies")).over(so_far)).filter(F.col("sum") <= train_bytes).select("doc_id", "h", "y")
    chosen = docs.withColumn("h", F.xxhash64("text")).join(F.broadcast(fit_in), ["doc_id", "h"]).select("doc_id", "text", "y")

    def work():
        def fn(ids, texts, y):
            by = [[] for _ in texts]
            for buckets, owner in features(texts):
                for i, part in enumerate(np.split(buckets, np.searchsorted(owner, np.arange(1, len(texts))))):
                    by[i].append(part)
            unique = [np.unique(np.concatenate(b), return_counts=True) for b in by]
            return [longs(ids), pa.array(y, pa.int32()), pa.array([u for u, _ in unique], pa.list_(pa.int32())), pa.array([c.astype(np.int32) for _, c in unique], pa.list_(pa.int32()))]

        return fn

    got = map_slices(chosen.repartition(8, "doc_id"), work, "doc_id bigint, y int, buckets array<int>, counts array<int>").toArrow()
    rows = sorted(((r.as_py(), y.as_py(), b.values.to_numpy(), c.values.to_numpy()) for r, y, b, c in zip(*(got.column(k) for k in range(4)))), key=lambda r: (r[0], len(r[2]), int(r[2].sum())))
    return train([(b, c, y) for _, y, b, c in rows])


def classify(docs: DataFrame, table: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    shipped = prepare(docs.sparkSession).sparkContext.broadcast(table)  # one float a bucket, 1 MB

    def work():
        return lambda ids, texts: [longs(ids), pa.array(score(shipped.value, texts), pa.float64())]

    out = map_slices(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), work, "doc_id bigint, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, table: np.ndarray, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows whose texts score `least` or more, with all their columns."""
    shipped = prepare(docs.sparkSession).sparkContext.broadcast(table)
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            for part in parts(b):
                yield part.filter(pa.array(score(shipped.value, part.column(at).to_pylist()) >= least))

    return docs.mapInArrow(run, docs.schema)
