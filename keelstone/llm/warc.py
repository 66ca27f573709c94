"""WARC archives and their Merkle fixity audit.

Records lie in archive files in order of their offsets. A file's tree has the
SHA-256 of each record, with its offset and length, at the leaves, and nodes over
`FANOUT` consecutive children each, up to a root. An audit compares the roots of
two replicas file by file and descends only below nodes that differ, level by
level, until it reaches the records: levels above the leaves are FANOUT times
smaller than those below them, and matching branches are never read further.
The records of differing leaves are then aligned by key, so that a lost record is one
finding and not one for each record that has moved up.

All steps are DataFrame operations; records' digests and places, not the records, are
written for them. Files that archive() makes hold at most `FILE_RECORDS` records, however
keys repeat, so no node's children and no file's order grow with the archive.

Defined results: null payloads are empty records; empty tables give no rows; a
record on one side only is `missing` or `extra`; repeated records lie at offsets of
their own and are matched in order; a null key is a key like any other.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelstone.functions.ranking import ranks
from keelstone.session import prepare, stored

FANOUT = 16
FILE_RECORDS = 4096
LEVELS = 3


def record_bytes(uri: Column, body: Column) -> Column:
    """A WARC/1.0 resource record as one string."""
    text = F.coalesce(body, F.lit(""))
    size = F.octet_length(text).cast("string")
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce(uri, F.lit("")), r"[\r\n]", " "), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), size, F.lit("\r\n\r\n"), text, F.lit("\r\n\r\n"))


def archive(pages: DataFrame, n_files: int, key: str = "page_id", uri: str = "url", body: str = "html", most: int = FILE_RECORDS) -> DataFrame:
    """(file, seq, offset, length, key, digest): pages as records of n_files archives, by key.

    Files take keys in turn, by the rest of the key (null keys go to file 0); within a file
    records follow one another without gaps. A file of more than `most` records, as hot or
    null keys make them, goes on in files f + n_files, f + 2 n_files, ...; its records are
    ranked over many tasks. Only digests and lengths are shuffled, not the records.
    """
    rec = record_bytes(F.col(uri), F.col(body))
    file = F.coalesce(F.pmod(F.col(key).cast("bigint"), F.lit(n_files)), F.lit(0)).cast("int")
    rows = pages.select(F.col(key).cast("bigint").alias("key"), file.alias("file"), F.octet_length(rec).cast("bigint").alias("length"), F.sha2(rec.cast("binary"), 256).alias("digest"))
    full = stored(pages.groupBy(file.alias("file")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("file"), "full-files")
    if full.isEmpty():
        return _placed(rows)
    ranked = ranks(rows.join(full, "file", "left_semi"), ["file"], [F.col("key"), F.col("digest")], "rank")
    part = F.floor((F.col("rank") - 1) / most).cast("int")
    return _placed(rows.join(full, "file", "left_anti")).unionByName(_placed(ranked.withColumn("file", F.col("file") + part * n_files).drop("rank")))


def _placed(rows: DataFrame) -> DataFrame:
    """Each file's records with their numbers and offsets."""
    w = Window.partitionBy("file").orderBy("key", "digest")
    return rows.select("file", (F.row_number().over(w) - 1).cast("bigint").alias("seq"), (F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("offset"), "length", "key", "digest")


def leaves(records: DataFrame) -> DataFrame:
    """(side, file, node, hash): a record's digest with its range; node is its place."""
    return records.select("side", "file", F.col("seq").alias("node"), F.sha2(F.concat_ws("|", "digest", F.col("offset").cast("string"), F.col("length").cast("string")).cast("binary"), 256).alias("hash"))


def parents(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The level above: each node hashes its children in order."""
    up = nodes.groupBy("side", "file", F.floor(F.col("node") / fanout).cast("bigint").alias("up")).agg(F.sort_array(F.collect_list(F.struct("node", "hash"))).alias("c"))
    return up.select("side", "file", F.col("up").alias("node"), F.sha2(F.array_join(F.transform("c", lambda c: F.concat_ws(":", c["node"].cast("string"), c["hash"])), ",").cast("binary"), 256).alias("hash"))


def tree(records: DataFrame, levels: int = LEVELS, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels from the leaves to the root (node 0 of the last), of all sides at once.
    Each level above the leaves is written: the next is built, and the audit descends,
    from its files."""
    out = [leaves(records)]
    for _ in range(levels):
        out.append(stored(parents(out[-1], fanout), "tree-level"))
    return out


def differing(nodes: DataFrame) -> DataFrame:
    """(file, node) where the two sides' hashes differ or one is absent."""
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("hash")))
    return nodes.groupBy("file", "node").agg(of(0).alias("ha"), of(1).alias("hb")).filter(~F.col("ha").eqNullSafe(F.col("hb"))).select("file", "node")


def audit(a: DataFrame, b: DataFrame, levels: int = LEVELS, fanout: int = FANOUT, moved: bool = False) -> DataFrame:
    """(file, seq, kind, key, offset, length of a, key, offset, length of b) of each record
    in which the replicas differ: corrupt, missing (from b) or extra (in b). Records that are
    whole but lie elsewhere, behind a lost or longer one, are `moved` and left out unless asked for."""
    both = stored(a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1))), "archives")
    built = tree(both, levels, fanout)
    bad = stored(differing(built[-1]), "differing")
    for level in built[-2::-1]:
        above = bad.withColumnRenamed("node", "up")
        below = level.withColumn("up", F.floor(F.col("node") / fanout).cast("bigint")).join(above, ["file", "up"], "left_semi")
        bad = stored(differing(below), "differing")
    out = align(both.join(bad.withColumnRenamed("node", "seq"), ["file", "seq"], "left_semi"))
    return out if moved else out.filter("kind <> 'moved'")


def align(rows: DataFrame) -> DataFrame:
    """Pairs of the two sides' records of each file: first those of one key and digest in their
    order, then of the rest those of one key, then those of one place; what is left has no partner."""
    entry = F.struct("seq", "key", "offset", "length")
    left = stored(rows.select("side", "file", "key", "digest", "seq", "offset", "length"), "differing-records")
    found = []
    for kind, by in (("moved", ["file", "key", "digest"]), ("corrupt", ["file", "key"]), ("corrupt", ["file", "seq"])):
        turn = left.withColumn("turn", F.row_number().over(Window.partitionBy("side", *by).orderBy("seq")))
        side = lambda n: F.max(F.when(F.col("side") == n, entry))
        met = stored(turn.groupBy(*[F.col(c).alias(f"by_{c}") for c in by], "turn").agg(F.max("file").alias("in_file"), side(0).alias("x"), side(1).alias("y")).select(F.col("in_file").alias("file"), "x", "y"), "aligned")
        found.append(met.filter("x is not null and y is not null").withColumn("kind", F.lit(kind)))
        alone = lambda n, c: met.filter(f"{c} is not null and {'y' if c == 'x' else 'x'} is null").select(F.lit(n).alias("side"), "file", F.col(f"{c}.seq").alias("seq"))
        left = stored(left.join(alone(0, "x").unionByName(alone(1, "y")), ["side", "file", "seq"], "left_semi"), "differing-records")
    alone = left.select("file", F.when(F.col("side") == 0, entry).alias("x"), F.when(F.col("side") == 1, entry).alias("y"), F.when(F.col("side") == 0, "missing").otherwise("extra").alias("kind"))
    every = alone
    for f in found:
        every = every.unionByName(f)
    every = every.filter("kind <> 'moved' or x.seq <> y.seq or x.offset <> y.offset")
    return every.select("file", F.coalesce("x.seq", "y.seq").alias("seq"), "kind", *[F.col(f"{s}.{c}").alias(f"{c}_{n}") for s, n in (("x", "a"), ("y", "b")) for c in ("key", "offset", "length")])


_HEAD = re.compile(rb"WARC/[0-9.]+\r\n(.*?)\r\n\r\n", re.S)
#: Where reading goes on after a damaged record.
_NEXT = re.compile(rb"WARC/[0-9.]+\r\n[A-Za-z-]+:")
_TAIL = b"\r\n\r\n"
_MEMBER = b"\x1f\x8b\x08"


def parse(data: bytes) -> list[tuple[int, int, str, bytes]]:
    """(offset, length, uri, payload) of each record of a WARC file, plain or of gzip members.

    A record whose header is damaged, or whose length leads neither to an end mark,
    another header nor the end of the file, reaches to the next header: it is given
    as one record, so later ones keep their numbers."""
    if data[:3] == _MEMBER or _MEMBER in data and not _NEXT.search(data):
        return _members(data)
    out, at = [], 0
    while at < len(data):
        m = _HEAD.match(data, at)
        fields = {k.strip().lower(): v.strip() for k, _, v in (h.partition(b":") for h in m[1].split(b"\r\n"))} if m else {}
        size = fields.get(b"content-length", b"0")
        end = m.end() + int(size) if m and size.isdigit() else len(data) + 1
        marked = data[end : end + 4] == _TAIL
        stop = end + 4 if marked else end
        if not (marked or stop == len(data) or _NEXT.match(data, stop)):
            following = _NEXT.search(data, at + 1)
            stop = following.start() if following else len(data)
            whole = m and m.end() <= stop
            fields = fields if whole else {}
            start = m.end() if whole else at
            end = max(start, stop - 4) if data[max(start, stop - 4) : stop] == _TAIL else stop
        else:
            start = m.end()
        out.append((at, stop - at, fields.get(b"warc-target-uri", b"").decode("utf-8", "replace"), data[start:end]))
        at = stop
    return out


def _member(data: bytes, at: int) -> tuple[int, bytes] | None:
    """Where the gzip member at `at` ends and what it holds; None if it is damaged."""
    unzip = zlib.decompressobj(31)
    try:
        held = unzip.decompress(memoryview(data)[at:])
    except zlib.error:
        return None
    return (len(data) - len(unzip.unused_data), held) if unzip.eof else None


def _members(data: bytes) -> list[tuple[int, int, str, bytes]]:
    """As parse(), of a file of gzip members: offsets and lengths are those of the member in the
    file. Several records of one member share its place. A damaged member reaches to the
    next whole one and is one record without a URI."""
    out, at = [], 0
    while at < len(data):
        got = _member(data, at) if data[at : at + 3] == _MEMBER else None
        if got:
            stop, held = got
            out += [(at, stop - at, uri, body) for _, _, uri, body in parse(held) or [(0, 0, "", b"")]]
        else:
            stop = data.find(_MEMBER, at + 1)
            while stop >= 0 and not ((got := _member(data, stop)) and got[1][:5] == b"WARC/"):
                stop = data.find(_MEMBER, stop + 1)
            stop = len(data) if stop < 0 else stop
            out.append((at, stop - at, "", data[at:stop]))
        at = stop
    return out


def read_files(spark, path: str, pattern: str = "*.warc{,.gz}") -> DataFrame:
    """(file, seq, offset, length, key, digest) of the WARC files below a path, in the
    form that audit() takes; key is the hash of the record's URI. One file a task at
    a time, whole in memory: archives are written in bounded files, 2 GB at most."""
    prepare(spark)
    src = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def run(batches):
        import hashlib

        import xxhash

        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1)):
                data = data.as_py()
                rows = [(file, i, off, n, xxhash.xxh64_intdigest(uri.encode(), 42) >> 1, hashlib.sha256(data[off : off + n]).hexdigest()) for i, (off, n, uri, _) in enumerate(parse(data))]
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["file", "seq", "offset", "length", "key", "digest"])

    return src.mapInArrow(run, "file string, seq bigint, offset bigint, length bigint, key bigint, digest string")
