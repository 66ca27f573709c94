"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: texts are lower-cased in A-Z and cut at ASCII white space; each
`shingle`-word run is hashed by XXH64 (seed 42); a bit is 1 if it is set in over
half of the hashes. Documents link when fingerprints differ in `radius` bits or
fewer.

Candidates: bit i of the fingerprint carries a non-zero vector m(i) of radius+1
bits. For each non-zero v, table v keeps the bits with odd <m(i), v>. The
differing bits of a pair within the radius span at most `radius` dimensions, so
some v is orthogonal to all of them, and in that table the pair's keys agree:
every link is found, by construction.

Only distinct fingerprints are searched, each standing for all its documents. A
bucket of up to `SMALL` fingerprints is compared inside its bounded array. The
fingerprints of a larger bucket are not paired: each is entered under all its
variants with at most `radius`/2 of the bits outside the mask flipped. Two
fingerprints within the radius meet in a variant half way, and all that meet
there are within the radius of each other, so one link each to the variant's
least fingerprint keeps them connected. Odd radii check those links and fall
back on the bounded variant group's pairs.

Defined results: null and empty texts have fingerprint zero and are linked like
any other; repeated ids take the least component id over their rows' own
fingerprints, row by row; null ids get a component but never name one (it is
null where a component has no other id).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelstone.llm.common import longs, map_slices
from keelstone.llm.components import components
from keelstone.session import stored

SHINGLE = 3
RADIUS = 2
#: Largest bucket whose fingerprints are compared with each other.
SMALL = 32
#: Shingles of a text that are turned into bits at a time.
BLOCK = 1 << 14


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of the text's shingles in order, repeats included; 8 bytes a word."""
    from xxhash import xxh64_intdigest as xxh

    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return np.empty(0, "<u8")
    line = b" ".join(tokens)
    n = max(1, len(tokens) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n]
    stops = ends[min(shingle, len(tokens)) - 1 :]
    out = np.empty(n, "<u8")
    for at in range(0, n, BLOCK):
        spans = zip(starts[at : at + BLOCK].tolist(), stops[at : at + BLOCK].tolist())
        out[at : at + BLOCK] = [xxh(line[a:b], 42) for a, b in spans]
    return out


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes, as a signed 64-bit integer; zero for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        counts += np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The text's fingerprint as a signed 64-bit integer."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) for every row."""

    def work():
        return lambda ids, texts: [longs(ids), longs([fingerprint(t, shingle) for t in texts])]

    return map_slices(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), work, "doc_id bigint, fp bigint")


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """One mask a table, as signed 64-bit integers."""
    top = (1 << (radius + 1)) - 1
    m = [1 + i % top for i in range(bits)]
    out = []
    for v in range(1, top + 1):
        mask = sum(1 << i for i in range(bits) if (m[i] & v).bit_count() & 1)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, radius: int = RADIUS, small: int = SMALL) -> DataFrame:
    """(u, v) links between distinct fingerprints (fps: fp) that connect all pairs within the radius."""
    masks = covering_masks(radius)
    spread = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"))
    sized = spread.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = stored(spread.join(sized, ["t", "key"]).select("t", "key", "fp", "n"), "buckets")
    few = met.filter(F.col("n") <= small).groupBy("t", "key").agg(F.sort_array(F.collect_list("fp")).alias("m"))
    pairs = (
        few.select(F.explode(F.expr("flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, size(m)), y -> bit_count(x ^ y) <= %d), y -> struct(y as u, x as v))))" % radius)).alias("p")).select("p.u", "p.v")
    )
    if radius == 0:
        return pairs
    half = (radius + 1) // 2
    flips = []
    for m in masks:
        free = [1 << i for i in range(64) if not (m & ((1 << 64) - 1)) >> i & 1]
        flips.append([_signed(sum(c)) for k in range(half + 1) for c in combinations(free, k)])
    many = met.filter(F.col("n") > small)
    table = F.array(*[F.array(*[F.lit(x) for x in f]) for f in flips])
    variant = many.select("t", "fp", F.explode(F.element_at(table, F.col("t") + 1)).alias("flip")).select("t", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    groups = variant.groupBy("t", "mid").agg(F.collect_set("fp").alias("m")).filter(F.size("m") > 1)
    if radius % 2 == 0:
        star = groups.select(F.explode("m").alias("u"), F.array_min("m").alias("v")).filter("u <> v")
    else:
        star = groups.select(F.explode(F.expr("flatten(transform(m, x -> transform(filter(m, y -> y > x and bit_count(x ^ y) <= %d), y -> struct(y as u, x as v))))" % radius)).alias("p")).select("p.u", "p.v")
    return pairs.union(star).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the least id reachable over links."""
    rows = stored(fingerprints(docs, shingle, doc_id, text), "fingerprints")
    reps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    label = components(links(reps.select("fp"), radius))
    named = label.join(reps, label.node == reps.fp).select("label", "fp", "rep")
    least = named.groupBy("label").agg(F.min("rep").alias("least"))
    moved = named.join(least, "label").select("fp", "least")
    # written, so that the last join has a plain exchange on both sides and Spark can split a hot fingerprint's rows
    to = stored(reps.join(moved, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id")), "component-ids")
    return rows.join(to, "fp").select("doc_id", "fp", "component_id")


def digest_rows(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: the least
    (doc_id, text) of the component; documents without near-duplicates all stay.
    Rows of null ids come after all others."""
    keyed = with_rows(docs)
    rows = stored(fingerprints(keyed, shingle, ROW), "fingerprints")
    reps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    label = components(links(reps.select("fp"), radius))
    to = rows.join(label, rows.fp == label.node, "left").select(F.col("doc_id").alias("row"), F.coalesce("label", "fp").alias("group"))
    return drop_losers(keyed, to)


#: Name of the row number; longer than any column's of the table at hand.
ROW = "__row"


def with_rows(docs: DataFrame) -> DataFrame:
    """The documents, written with a number for each row; a column of that name keeps its values under another."""
    if ROW in docs.columns:
        docs = docs.withColumnRenamed(ROW, ROW + "_given")
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "near-duplicate-rows")


def drop_losers(keyed: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of with_rows() but all of each group (groups: row, group) except the best. Only
    ids meet; the losing ones are few, and while Spark's size limit lets them be broadcast no text is shuffled."""
    ranked = keyed.select(F.col(ROW).alias("row"), "doc_id", F.xxhash64("text").alias("h")).join(groups, "row")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "row")
    best = ranked.groupBy("group").agg(F.min(order).alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("group", F.col("b.row").alias("best"))
    # written, so that the join has a plain exchange on both sides and Spark can split a large group's rows
    best = stored(best, "best-rows")
    losers = stored(groups.join(best, "group").filter("row <> best").select(F.col("row").alias(ROW)), "losing-rows")
    out = keyed.join(losers, ROW, "left_anti").drop(ROW)
    return out.withColumnRenamed(ROW + "_given", ROW) if ROW + "_given" in out.columns else out
