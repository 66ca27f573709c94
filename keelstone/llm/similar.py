"""Near-duplicates by similarity: documents link when the sets of their 5-word shingles
have a Jaccard similarity of 0.8 or more.

Words are those of simhash.fingerprint; a text of fewer words is one shingle, and
texts without words are alike. Shingles stand as XXH64 hashes.

Candidates come from two searches. simhash.links: covering tables over the fingerprints
of the 5-word shingles meet every pair within its radius. SimHash bits of texts at
the least similarity differ in 10 of 64 on average, so covering tables for all of
them would be thousands; the rest is found by `BANDS` keys of `ROWS` minimum hashes
each: two texts at the least similarity share a key with a chance of 1 - (1 - 0.8^4)^24,
all but 4 of a million, nearer ones with a greater one. Every pair of such a bucket is a
candidate, and no pair of either search links without the exact check.

No step writes the pairs of a large group of near copies. First each member of a
bucket is checked against the bucket's least. Where a bucket still has members of
different components, those that may have the least similarity are found by a
bound (the parities of the hashes in `WORDS` 64-bit words differ in at most as many
bits as the sets do in members), one row a member with the components that such pairs
join. Then the whole sets of these members meet, once for all their buckets, and each
group gives only the pairs that connect it, fewer than its members. Large buckets
are read in pairs of chunks, the chunks of their largest component not with each other.

Only distinct shingle sets are searched, each standing for all its documents.

Defined results: null, empty and blank texts have no shingles and are one group;
repeated rows and ties leave the row of the least id, null ids last; empty tables
give none; other columns, whatever their names, stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelstone.llm import simhash
from keelstone.llm.common import longs, map_slices
from keelstone.llm.components import components
from keelstone.session import prepare, stored

SHINGLE = 5
#: Least similarity, as a fraction: OF / IN.
OF, IN = 4, 5
ROWS, BANDS = 4, 24
#: 64-bit words of the parities.
WORDS = 32
#: Members of a bucket that are compared at a time, by parities; whole sets: so many times EACH shingles.
CHUNK, EACH = 2048, 256
#: Shingles of a text that are permuted at a time.
BLOCK = 1 << 10


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the text's shingles, in order."""
    return np.unique(simhash.shingle_hashes(text, shingle))


def _factors() -> np.ndarray:
    return np.random.default_rng(5).integers(0, 1 << 63, ROWS * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)


def _keys(hashes: np.ndarray, factors: np.ndarray) -> list[int]:
    """The set's band keys as signed 64-bit integers."""
    from xxhash import xxh64_digest as xxh

    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        np.minimum(least, (hashes[at : at + BLOCK, None] * factors).min(0), out=least)
    row = least.tobytes()
    size = 8 * ROWS
    return [int.from_bytes(xxh(row[i : i + size], 42), "big", signed=True) for i in range(0, len(row), size)]


def _parities(hashes: np.ndarray) -> bytes:
    bits = np.bincount((hashes & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(bits.astype(bool)).tobytes()


def sketches(rows: DataFrame) -> DataFrame:
    """(row, set, n, fp, keys, parities) for every row of (row, text); `set` names the shingle set."""

    def work():
        from xxhash import xxh64_digest as xxh

        factors = _factors()

        def one(text):
            every = simhash.shingle_hashes(text, SHINGLE)
            h = np.unique(every)
            return int.from_bytes(xxh(h.tobytes(), 42), "big", signed=True), len(h), simhash.majority(every), _keys(h, factors), _parities(h)

        def run(ids, texts):
            found = [one(t) for t in texts]
            return [longs(ids), longs([f[0] for f in found]), longs([f[1] for f in found]), longs([f[2] for f in found]), pa.array([f[3] for f in found], pa.list_(pa.int64())), pa.array([f[4] for f in found], pa.binary())]

        return run

    return map_slices(rows, work, "row bigint, set bigint, n bigint, fp bigint, keys array<bigint>, parities binary")


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of hashes have the least similarity."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return IN * both >= OF * (len(a) + len(b) - both)


def shingle_sets(texts: DataFrame, ends: DataFrame) -> DataFrame:
    """(set, hashes) of the sets in ends (set); texts: (set, text)."""

    def hashed():
        return lambda ids, values: [longs(ids), pa.array([shingles(t).tobytes() for t in values], pa.binary())]

    return stored(map_slices(texts.join(ends, "set", "left_semi").select("set", "text"), hashed, "set bigint, hashes binary"), "shingle-sets")


def check(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) of sets with the least similarity, by their whole shingle sets; texts: (set, text)."""
    of = stored(pairs, "near-pairs")
    sets = shingle_sets(texts, of.select(F.col("u").alias("set")).union(of.select(F.col("v").alias("set"))).distinct())
    side = lambda name, col: sets.select(F.col("set").alias(name), F.col("hashes").alias(col))

    def work():
        def run(u, v, a, b):
            ok = [alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b)]
            return [longs([x for x, k in zip(u, ok) if k]), longs([x for x, k in zip(v, ok) if k])]

        return run

    return stored(map_slices(of.join(side("u", "a"), "u").join(side("v", "b"), "v").select("u", "v", "a", "b"), work, "u bigint, v bigint"), "near-links")


def dealt(members: DataFrame, by: list[str], room: int) -> DataFrame:
    """The members of buckets of several labels, each once for every group (by, i, j) of two chunks in which
    it meets members of other labels; `second` tells the chunks apart. members: (by, set, label, cost).

    A chunk costs about `room`. The label that costs most has chunks of its own, which do not meet each
    other: with r chunks of other labels, a member of that one stands in r groups."""
    of = members.groupBy(*by, "label").agg(F.sum("cost").alias("cost"))
    mixed = of.groupBy(*by).agg(F.sum("cost").alias("all"), F.max(F.struct("cost", "label")).alias("top")).filter("all > top.cost")
    whole = F.col("all") <= room
    # written, so that the join has a plain exchange on both sides and Spark can split a hot bucket's rows
    planned = mixed.select(
        *by,
        F.when(whole, F.lit(None)).otherwise(F.col("top.label")).alias("top"),
        F.when(whole, 0).otherwise(F.ceil(F.col("top.cost") / room)).cast("int").alias("g"),
        F.when(whole, 1).otherwise(F.ceil((F.col("all") - F.col("top.cost")) / room)).cast("int").alias("r"),
    )
    chunks = stored(planned, "chunks")
    own = F.coalesce(F.col("label") == F.col("top"), F.lit(False))
    place = F.xxhash64("set", *by)
    at = members.join(chunks, by).withColumn(
        "c", F.when(own, F.pmod(place, F.greatest("g", F.lit(1)))).otherwise(F.col("g") + F.pmod(place, F.col("r"))).cast("int")
    )
    met = at.withColumn("o", F.explode(F.sequence(F.when(own, F.col("g")).otherwise(0), F.col("g") + F.col("r") - 1)))
    return met.withColumns({"i": F.least("c", "o"), "j": F.greatest("c", "o"), "second": F.col("c") > F.col("o")}).drop("c", "o", "g", "r", "top", "cost")


def _groups(placed: DataFrame, by: list[str], fields: list[str], run, schema: str) -> DataFrame:
    """run(first, *fields) of every group of dealt(), which gives columns: the first `first` members meet
    the others where there are others, else each other."""
    names = [f.split()[0] for f in schema.split(", ")]
    groups = placed.groupBy(*by, "i", "j").agg(F.collect_list(F.struct("second", *fields)).alias("m")).select("i", "j", "m")

    def each(batches):
        for b in batches:
            for x in range(b.num_rows):
                m = b.column(2)[x].values
                second = m.field("second").to_numpy(zero_copy_only=False)
                m = m.take(pa.array(np.argsort(second, kind="stable")))
                first = len(m) - int(second.sum())
                if b.column(0)[x].as_py() == b.column(1)[x].as_py() or 0 < first < len(m):
                    out = run(first, *[m.field(f).to_pylist() for f in fields])
                    yield pa.RecordBatch.from_arrays([longs(c) for c in out], names=names)

    return groups.mapInArrow(each, schema)


def _across(first: int, sets: list, labels: list, sizes: list, parities: list) -> list[list]:
    """(set, label, n, to) of the members that the bound lets pair with one of another label; `to` is the
    least label that such pairs reach."""
    label, n = np.array(labels, np.int64), np.array(sizes, np.int64)
    bits = np.frombuffer(b"".join(parities), np.uint64).reshape(-1, WORDS)
    to, paired = label.copy(), np.zeros(len(label), bool)
    for i in range(first):
        at = first if first < len(label) else i + 1
        rest = at + np.flatnonzero(label[at:] != label[i])
        # |A ^ B| <= (|A| + |B|) (IN - OF) / (IN + OF) at the least similarity
        differ = np.bitwise_count(bits[rest] ^ bits[i]).sum(1, dtype=np.int64)
        rest = rest[(IN + OF) * differ <= (IN - OF) * (n[rest] + n[i])]
        if len(rest):
            paired[i] = paired[rest] = True
            _unite(to, np.append(to[rest], to[i]))
    return [np.array(sets, np.int64)[paired].tolist(), label[paired].tolist(), n[paired].tolist(), to[paired].tolist()]


def _unite(label: np.ndarray, found: np.ndarray) -> None:
    ends = np.unique(found)
    if len(ends) > 1:
        label[np.isin(label, ends)] = ends[0]


def _joined(first: int, sets: list, labels: list, hashes: list) -> list[list]:
    """(u, v) pairs with the least similarity that connect all such pairs of different labels: fewer than labels."""
    label, values = np.array(labels, np.int64), [np.frombuffer(h, np.uint64) for h in hashes]
    n = np.array([len(x) for x in values], np.int64)
    start = np.concatenate([[0], np.cumsum(n)])
    known, ids = np.unique(np.concatenate(values), return_inverse=True)
    owner = np.repeat(np.arange(len(n)), n)
    u, v = [], []
    for i in range(first):
        at = first if first < len(label) else i + 1
        rest = at + np.flatnonzero(label[at:] != label[i])
        rest = rest[OF * np.maximum(n[rest], n[i]) <= IN * np.minimum(n[rest], n[i])]
        if len(rest):
            held = np.zeros(len(known), bool)
            held[ids[start[i] : start[i + 1]]] = True
            both = np.bincount(owner[start[at] :][held[ids[start[at] :]]], minlength=len(n))[rest]
            rest = rest[IN * both >= OF * (n[rest] + n[i] - both)]
            new, where = np.unique(label[rest], return_index=True)
            u += [max(sets[i], sets[x]) for x in rest[where]]
            v += [min(sets[i], sets[x]) for x in rest[where]]
            _unite(label, np.append(new, label[i]))
    return [u, v]


def across(members: DataFrame, distinct: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(set, label, n, to) of the members of buckets that the bound lets pair with one of another label, at most
    one row a member and group; members: (t, key, set, label), distinct: (set, n, parities)."""
    prepare(members.sparkSession)
    placed = dealt(members.select("t", "key", "set", "label", F.lit(1).alias("cost")), ["t", "key"], chunk)
    return _groups(placed.join(distinct.select("set", "n", "parities"), "set"), ["t", "key"], ["set", "label", "n", "parities"], _across, "set bigint, label bigint, n bigint, to bigint").distinct()


def joined(paired: DataFrame, texts: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(u, v) pairs with the least similarity that connect all such pairs among the labels that paired (set, label,
    n, to) joins, fewer than labels in each group. Each set meets the others of its labels once, whatever the number of its buckets."""
    found = stored(paired, "paired-sets")
    under = components(found.select(F.col("label").alias("u"), F.col("to").alias("v"))).select(F.col("node").alias("label"), F.col("label").alias("under"))
    placed = dealt(found.select("set", "label", (F.col("n") + EACH).alias("cost")).distinct().join(under, "label"), ["under"], chunk * EACH)
    sets = shingle_sets(texts, found.select("set").distinct())
    return stored(_groups(placed.join(sets, "set"), ["under"], ["set", "label", "hashes"], _joined, "u bigint, v bigint"), "near-links")


def covered(distinct: DataFrame) -> DataFrame:
    """(u, v) candidates whose fingerprints the covering tables link, each fingerprint standing for its
    least set, and the other sets of a fingerprint with that one."""
    least = stored(distinct.groupBy("fp").agg(F.min("set").alias("least")), "least-sets")
    same = distinct.select("set", "fp").join(least, "fp").filter("set <> least").select(F.col("set").alias("u"), F.col("least").alias("v"))
    end = lambda name, to: least.select(F.col("fp").alias(name), F.col("least").alias(to))
    near = simhash.links(least.select("fp")).join(end("u", "a"), "u").join(end("v", "b"), "v")
    return same.union(near.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))


def links(distinct: DataFrame, texts: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(u, v) links that connect all pairs of sets with the least similarity that share a key;
    distinct: (set, n, fp, keys, parities), texts: (set, text), one row a set."""
    spread = distinct.select("set", F.posexplode("keys").alias("t", "key"))
    sized = stored(spread.groupBy("t", "key").agg(F.count(F.lit(1)).alias("size"), F.min("set").alias("least")).filter("size > 1"), "bucket-sizes")
    met = stored(spread.join(sized, ["t", "key"]).select("t", "key", "size", "set", "least"), "buckets")
    starred = met.filter("set <> least").select(F.col("set").alias("u"), F.col("least").alias("v"))
    near = check(starred.union(covered(distinct)).distinct(), texts)
    label = components(near).withColumnRenamed("node", "set")
    named = stored(met.filter("size > 2").join(label, "set", "left").select("t", "key", "set", F.coalesce("label", "set").alias("label")), "labelled-buckets")
    return near.union(joined(across(named, distinct, chunk), texts, chunk))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: the least
    (doc_id, text) of the component; documents without near-duplicates all stay.
    Rows of null ids come after all others."""
    keyed = simhash.with_rows(docs)
    rows = stored(sketches(keyed.select(F.col(simhash.ROW).alias("row"), "text")), "sketches")
    reps = rows.groupBy("set").agg(F.min("row").alias("row"))
    distinct = stored(rows.join(reps.select("row"), "row", "left_semi"), "distinct-sets")
    texts = keyed.select(F.col(simhash.ROW).alias("row"), "text").join(distinct.select("row", "set"), "row").select("set", "text")
    label = components(links(distinct, texts))
    to = rows.select("row", "set").join(label, F.col("set") == F.col("node"), "left").select("row", F.coalesce("label", "set").alias("group"))
    return simhash.drop_losers(keyed, to)
