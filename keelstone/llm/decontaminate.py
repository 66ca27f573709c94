"""Benchmark decontamination: a broadcast hash set of normalised item n-grams.

Texts are lower-cased in A-Z and cut into words of digits, a-z and every
character beyond ASCII. A window is `n` consecutive words of a benchmark item;
an item of fewer words, but not none, is one window. Workers hash the windows of
every whole document with a rolling hash, look the hashes up in a bit table and
then in the exact set of window texts, and mark each word inside an occurrence. The set is
built once, as sorted hashes with places in one buffer of the items' words, and a
worker loads it once.

An index of more than `MAX_BROADCAST_BYTES` is not broadcast: workers then
keep only the document windows that a Bloom filter of fixed size admits, and an
equi-join with the table of item windows verifies them.

Defined results: null or empty texts have no words and are clean; null or empty
items have no windows; repeated items count once; repeated documents are each
reported; null ids are kept (a null item id is reported as an empty string).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelstone.llm.common import longs, map_slices, parts, strings
from keelstone.session import prepare, stored

WINDOW = 10
#: An index up to this many bytes is sent to every worker; _index_bytes() bounds it beforehand.
MAX_BROADCAST_BYTES = 64 << 20
#: Bits of the Bloom filter for larger benchmarks, as a power of two (32 MB).
BLOOM_BITS = 28
_FOLD = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_M = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """The normalised words of a text, as UTF-8."""
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A rolling polynomial hash of each run of n word hashes."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= _M
        out += h[k : len(h) - n + 1 + k]
    return out


class WindowIndex:
    """The distinct windows of all items, by length: sorted hashes behind a bit table, each with
    its place in one buffer of words and the range of its items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], n: int = WINDOW):
        self.names = [item for item, _ in items]
        self.buffer = b"".join(b" ".join(w) + b" " for _, w in items)
        rows: dict[int, list[list[np.ndarray]]] = {}
        at = 0
        for item, (_, w) in enumerate(items):
            if k := min(n, len(w)):
                ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1 + at
                starts = np.concatenate([[at], ends[:-1] + 1])
                m = len(w) - k + 1
                rows.setdefault(k, []).append([window_hashes(word_hashes(w), k), starts[:m], ends[k - 1 :], np.full(m, item, np.int32)])
            at += sum(map(len, w)) + max(1, len(w))
        self.parts = {k: self._sorted(*(np.concatenate([r[i] for r in of]) for i in range(4))) for k, of in rows.items()}

    def _sorted(self, h, start, end, item):
        """Windows of one text as one entry: (bit table, hashes, starts, ends, bounds of items, items)."""
        order = np.lexsort((item, h))
        h, start, end, item = h[order], start[order], end[order], item[order]
        new = np.ones(len(h), bool)
        clash = np.flatnonzero(h[1:] == h[:-1]) + 1  # equal hashes: nearly always equal texts
        for i in clash.tolist():
            new[i] = self.buffer[start[i] : end[i]] != self.buffer[start[i - 1] : end[i - 1]]
        for i in clash[new[clash]].tolist():  # two texts of one hash: put those of each together
            lo, hi = np.searchsorted(h, h[i], "left"), np.searchsorted(h, h[i], "right")
            by = sorted(range(lo, hi), key=lambda x: (self.buffer[start[x] : end[x]], item[x]))
            start[lo:hi], end[lo:hi], item[lo:hi] = start[by], end[by], item[by]
            new[lo:hi] = [x == lo or self.buffer[start[x] : end[x]] != self.buffer[start[x - 1] : end[x - 1]] for x in range(lo, hi)]
        first = np.flatnonzero(new)
        table = np.zeros(1 << 20, bool)
        table[(h >> np.uint64(44)).astype(np.int64)] = True
        return table, h[first], start[first], end[first], np.append(first, len(h)), item

    def scan(self, tokens: list[bytes], bounds: np.ndarray) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Hit words of concatenated documents that end at `bounds`, and the items by document."""
        hit = np.zeros(len(tokens), bool)
        met: dict[int, set[tuple[int, int]]] = {}
        h = word_hashes(tokens)
        for k, (table, known, start, end, _, _) in self.parts.items():
            g = window_hashes(h, k)
            at = np.flatnonzero(table[(g >> np.uint64(44)).astype(np.int64)])
            place = np.searchsorted(known, g[at])
            ok = known[np.minimum(place, len(known) - 1)] == g[at]
            at, place = at[ok], place[ok]
            doc = np.searchsorted(bounds, at, side="right")
            for p, d, e in zip(at.tolist(), doc.tolist(), place.tolist()):
                if p + k > bounds[d]:
                    continue
                text = b" ".join(tokens[p : p + k])
                while e < len(known) and known[e] == g[p]:
                    if self.buffer[start[e] : end[e]] == text:
                        hit[p : p + k] = True
                        met.setdefault(d, set()).add((k, e))
                        break
                    e += 1
        found = {d: {self.names[i] for k, e in windows for i in self.parts[k][5][self.parts[k][4][e] : self.parts[k][4][e + 1]]} for d, windows in met.items()}
        return hit, found


def _index_bytes(items: DataFrame) -> int:
    """A bound of the index's bytes: its words with a blank each, and hash, places and item of a window a word."""
    n_words = F.regexp_count(F.lower("text"), F.lit("[0-9a-z\\x{80}-\\x{10ffff}]+"))
    return items.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item") + 100 + 40 * n_words), F.lit(0))).first()[0]


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _tokens(texts: list) -> tuple[list[bytes], np.ndarray]:
    tokens: list[bytes] = []
    bounds = []
    for t in texts:
        tokens += words(t)
        bounds.append(len(tokens))
    return tokens, np.array(bounds, np.int64)


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])[np.concatenate([[0], bounds])]
    return np.diff(total)


def _spans(hit: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """Per document the flat list start, end, start, end, ... of hit word runs."""
    out = []
    start = 0
    for end in bounds.tolist():
        part = hit[start:end]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], part.view(np.int8), [0]]))) if part.any() else []
        out.append([int(x) for x in edges])
        start = end
    return out


SCHEMA = "doc_id bigint, n_words bigint, n_hit bigint, items array<string>, hit_spans array<int>"


def find_contamination(docs: DataFrame, bench: DataFrame, n: int = WINDOW, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, items (sorted) and hit_spans
    (word positions: start, end, start, end, ...)."""
    spark = prepare(docs.sparkSession)
    src = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    items = bench.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text")).filter("text is not null")
    if _index_bytes(items) > max_broadcast_bytes:
        return _by_join(src, items, n)
    shipped = spark.sparkContext.broadcast(WindowIndex([(r.item, words(r.text)) for r in items.toLocalIterator()], n))

    def work():
        index = shipped.value

        def fn(ids, texts):
            tokens, bounds = _tokens(texts)
            hit, found = index.scan(tokens, bounds)
            n_words = np.diff(np.concatenate([[0], bounds]))
            return [longs(ids), longs(n_words), longs(_sums(hit, bounds)), pa.array([sorted(found.get(i, ())) for i in range(len(ids))], pa.list_(pa.string())), pa.array(_spans(hit, bounds), pa.list_(pa.int32()))]

        return fn

    return map_slices(src, work, SCHEMA)


def _by_join(src: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """The same rows where the benchmark is too large to broadcast."""
    spark = src.sparkSession

    def windows():
        def fn(ids, texts):
            out = []
            for item, t in zip(ids, texts):
                w = words(t)
                k = min(n, len(w))
                if k:
                    h = window_hashes(word_hashes(w), k)
                    out += [(item, k, int(x), b" ".join(w[i : i + k]).decode("utf-8", "replace")) for i, x in enumerate(h.view(np.int64))]
            return [strings([o[0] for o in out]), pa.array([o[1] for o in out], pa.int32()), longs([o[2] for o in out]), strings([o[3] for o in out])]

        return fn

    grams = stored(map_slices(items, windows, "item string, k int, h bigint, gram string").distinct(), "item-windows")
    mask = np.uint64((1 << BLOOM_BITS) - 1)
    lengths = [r.k for r in grams.select("k").distinct().collect()]

    def fold(batches):
        bloom = np.zeros(1 << (BLOOM_BITS - 3), np.uint8)
        for b in batches:
            at = b.column(0).to_numpy().view(np.uint64) & mask
            np.bitwise_or.at(bloom, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        used = np.flatnonzero(bloom)
        for i in range(0, len(used), 100_000):
            part = used[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(bloom[part], pa.int16())], names=["byte", "bits"])

    bits = grams.select("h").mapInArrow(fold, "byte bigint, bits smallint").groupBy("byte").agg(F.bit_or("bits").alias("bits"))
    bloom = np.zeros(1 << (BLOOM_BITS - 3), np.uint8)
    for r in bits.toLocalIterator():
        bloom[r.byte] = r.bits
    shipped = spark.sparkContext.broadcast(bloom)
    keyed = stored(src.withColumn("uid", F.monotonically_increasing_id()), "decontaminate-docs")

    def probe():
        filled = shipped.value

        def fn(uids, texts):
            tokens, bounds = _tokens(texts)
            h = word_hashes(tokens)
            out_uid, out_at, out_k, out_h, out_gram = [], [], [], [], []
            for k in lengths:
                g = window_hashes(h, k)
                b = g & mask
                at = np.flatnonzero(filled[(b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8) & 1)
                doc = np.searchsorted(bounds, at, side="right")
                keep = at + k <= bounds[doc]
                for p, d in zip(at[keep].tolist(), doc[keep].tolist()):
                    out_uid.append(uids[d])
                    out_at.append(p - (int(bounds[d - 1]) if d else 0))
                    out_k.append(k)
                    out_h.append(int(g[p : p + 1].view(np.int64)[0]))
                    out_gram.append(b" ".join(tokens[p : p + k]).decode("utf-8", "replace"))
            return [longs(out_uid), pa.array(out_at, pa.int32()), pa.array(out_k, pa.int32()), longs(out_h), strings(out_gram)]

        return fn

    cand = map_slices(keyed.select("uid", "text"), probe, "uid bigint, at int, k int, h bigint, gram string")
    # a document's occurrences are checked against distinct windows, and meet the items of a window once
    window = ["k", "h", "gram"]
    hits = stored(cand.join(grams.select(*window).distinct(), window, "left_semi"), "verified-windows")
    runs = hits.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("at", F.expr("at + k").alias("end")))).alias("runs"))
    of = hits.select("uid", *window).distinct().join(grams, window).select("uid", "item").distinct().groupBy("uid").agg(F.sort_array(F.collect_list("item")).alias("items"))
    hits = runs.join(of, "uid")

    def finish():
        def fn(ids, texts, items_of, runs):
            n_words, n_hit, spans = [], [], []
            for t, rs in zip(texts, runs):
                w = len(words(t))
                hit = np.zeros(w, bool)
                for r in rs or ():
                    hit[r["at"] : r["end"]] = True
                n_words.append(w)
                n_hit.append(int(hit.sum()))
                spans += _spans(hit, np.array([w]))
            return [longs(ids), longs(n_words), longs(n_hit), pa.array([x or [] for x in items_of], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int32()))]

        return fn

    return map_slices(keyed.join(hits, "uid", "left").select("doc_id", "text", "items", "runs"), finish, SCHEMA)


def remove_documents(docs: DataFrame, bench: DataFrame, n: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text", max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """The documents without any hit, each with all of its columns.

    The scan carries the row itself through one narrow map, so rows with null or
    repeated ids are judged by their own text. Beyond the broadcast, rows get a number and
    those with hits are dropped by it.
    """
    spark = prepare(docs.sparkSession)
    items = bench.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text")).filter("text is not null")
    if _index_bytes(items) > max_broadcast_bytes:
        row = next(c for c in ("__row", "__row_number", "__decontaminate_row_number") if c not in docs.columns)
        keyed = stored(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate-rows")
        hit = _by_join(keyed.select(F.col(row).alias("doc_id"), F.col(text).alias("text")), items, n).filter("n_hit > 0").select(F.col("doc_id").alias(row))
        return keyed.join(stored(hit, "contaminated-rows"), row, "left_anti").drop(row)
    shipped = spark.sparkContext.broadcast(WindowIndex([(r.item, words(r.text)) for r in items.toLocalIterator()], n))
    at = docs.columns.index(text)

    def run(batches):
        index = shipped.value
        for batch in batches:
            for part in parts(batch):
                tokens, bounds = _tokens(part.column(at).to_pylist())
                yield part.filter(pa.array(_sums(index.scan(tokens, bounds)[0], bounds) == 0))

    return docs.mapInArrow(run, docs.schema)


def digest_rows(found: DataFrame) -> DataFrame:
    """The contract's columns from find_contamination()'s rows."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
