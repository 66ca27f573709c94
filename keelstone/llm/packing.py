"""Best-fit packing: best-fit decreasing with a segment tree over remaining capacities.

Documents are tokenised and end in id 0; longer ones than `CAPACITY` are cut into
full pieces from the end, so that the first may be shorter. Only lengths matter to
the packing, and there are at most `CAPACITY` of them: the driver gets the number
of pieces of each length, never a piece. It takes lengths in decreasing order and,
for each, the tightest open capacity that fits, found by descending a segment tree
in logarithmic time; all bins of that capacity and all pieces of that length move
in one step. The result is the packing that best-fit decreasing makes piece by
piece, as runs of ranks: pieces of length l with ranks lo.. go to bins from s on,
q in a bin, from an offset on. The runs are a function of at most `CAPACITY`
numbers; their count does not follow the documents.

Each piece's rank within its length is its place in its own Parquet part plus the
pieces of that length in parts before. While the table of counts, at most a row a length and part,
is under Spark's limit for broadcasts, no piece is shuffled to be packed; beyond it pieces
meet their counts by a sort-merge join on (length, part), of which no key is hot.

Defined results: null and empty texts are one token, id 0; repeated rows are packed
each; null ids are kept.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelstone.llm.common import slices
from keelstone.llm.tokens import Encoder
from keelstone.session import prepare, stored

CAPACITY = 2048
END = 0


class Capacities:
    """Bins by remaining capacity: ranges of bin numbers at the leaves, and a
    segment tree that knows where any are."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = np.zeros(2 * self.size, bool)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, room: int) -> None:
        at = room + self.size
        self.any[at] = bool(self.ranges[room])
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def add(self, room: int, lo: int, hi: int) -> None:
        """Bins lo.. to hi have this room left."""
        if room:
            self.ranges[room].append((lo, hi))
            self._mark(room)

    def take(self, room: int, most: int) -> tuple[int, int]:
        """Up to `most` bins in sequence that have this room."""
        lo, hi = self.ranges[room].pop()
        if hi - lo > most:
            self.ranges[room].append((lo + most, hi))
            hi = lo + most
        self._mark(room)
        return lo, hi

    def tightest(self, need: int) -> int | None:
        """The least room of `need` or more that any bin has."""
        at = need + self.size
        if self.any[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def pack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first bin, pieces a bin, offset in the bin) of best-fit decreasing."""
    bins = Capacities(capacity)
    opened = 0
    runs = []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = bins.tightest(length)
            if room is None:
                room, fresh = capacity, True
            else:
                fresh = False
            per = min(room // length, left)
            whole = left // per
            if fresh:
                lo, hi = opened, opened + whole
                opened = hi
            else:
                lo, hi = bins.take(room, whole)
            n = (hi - lo) * per
            runs.append((length, rank, n, lo, per, capacity - room))
            bins.add(room - per * length, lo, hi)
            rank += n
            left -= n
    return runs


def pieces(docs: DataFrame, path: str, ranks_path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, place, part[, ids]): `place` counts the
    pieces of a length within its part."""
    prepare(docs.sparkSession)
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, place bigint, part bigint" + ", ids array<int>" * with_ids
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        encode = Encoder(path, ranks_path)
        seen = np.zeros(capacity + 1, np.int64)
        part = TaskContext.get().partitionId()
        for ids, texts in slices(batches, 128):
            out = []
            for i, t in zip(ids, texts):
                tokens = np.append(encode(t or ""), np.uint32(END)).astype("<u4")
                first = len(tokens) % capacity or capacity
                for k, a in enumerate([0, *range(first, len(tokens), capacity)]):
                    cut = tokens[a : first if k == 0 else a + capacity]
                    out.append((i, k, a, len(cut), zlib.crc32(cut.tobytes()), int(seen[len(cut)]), part, *([cut.astype(np.int32)] if with_ids else [])))
                    seen[len(cut)] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kinds[k]) for k in range(len(names))], names=names)

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The stored pieces with sequence_id and offset."""
    spark = cut.sparkSession
    tally = stored(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r.length: r.n for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    by: dict[int, list] = {}
    for r in pack(counts, capacity):
        by.setdefault(r[0], []).append(r[1:])
    shipped = spark.sparkContext.broadcast({k: np.array(v, np.int64).T for k, v in by.items()})
    before = tally.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    ranked = cut.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("place")).drop("before", "place", "part")
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in ranked.schema if f.name != 'rank')}, sequence_id bigint, offset bigint"
    at_length, at_rank = ranked.columns.index("length"), ranked.columns.index("rank")

    def run(batches):
        runs = shipped.value
        for b in batches:
            lengths, ranks = b.column(at_length).to_numpy(), b.column(at_rank).to_numpy()
            seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                lo, _, first, per, start = runs[length]
                k = np.searchsorted(lo, ranks[rows], "right") - 1
                within = ranks[rows] - lo[k]
                seq[rows] = first[k] + within // per[k]
                off[rows] = start[k] + within % per[k] * length
            keep = [i for i in range(b.num_columns) if i != at_rank]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(seq), pa.array(off)], names=[*(b.schema.names[i] for i in keep), "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, ranks_path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset
    and, with_ids, the ids themselves. Tokenises once: the pieces are written to the
    shared folder, where the ranks are counted and from where they are placed."""
    cut = stored(pieces(docs, path, ranks_path, capacity, with_ids, doc_id, text), "pieces")
    out = place(cut, capacity)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, input_ids, doc_starts) from pack_documents(..., with_ids=True):
    each sequence's ids in order, at most `capacity` of them."""
    by = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return by.select("sequence_id", F.flatten("p.ids").alias("input_ids"), F.col("p.offset").alias("doc_starts"))
