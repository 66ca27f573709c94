"""Checksummed binary snapshots of all seven value types, as source and sink.

A file is a header, optional notes, a database number, counts, entries and the CRC-64
of all before it. Entries come in as long-form rows: one for a string, one an element of
every other type, in the order of idx. An empty collection has no rows; it is written
by nobody, and read as nothing.

Files are read one a task, whole in memory (2 GB at most, as Spark reads binary files), and
handed on in batches of bounded rows. Written files hold the keys of one hash bucket each.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelstone.session import prepare
from keelstone.sources.snapshot import MAGIC, crc64

#: Fixed values of the format: marks, and each type's number.
NOTE, COUNTS, EXPIRY_MS, EXPIRY_S, DATABASE, END = 0xFA, 0xFB, 0xFC, 0xFD, 0xFE, 0xFF
TYPES = {"string": 0, "list": 1, "set": 2, "zset": 3, "hash": 4, "stream": 6, "vector": 240}

#: A long-form row: key, type, expiry and place; then what the type has of field (a hash's field, a
#: stream entry's id, a vector's id), value, score, pairs (a stream entry's fields in order) and vec.
SCHEMA = "key string, type string, expires_at_ms bigint, idx bigint, field string, value string, score double, pairs array<struct<name:string,value:string>>, vec array<float>"
_ARROW = pa.schema([("key", pa.string()), ("type", pa.string()), ("expires_at_ms", pa.int64()), ("idx", pa.int64()), ("field", pa.string()), ("value", pa.string()), ("score", pa.float64()), ("pairs", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("vec", pa.list_(pa.float32()))])
BATCH_ROWS = 10_000


class Reader:
    """A place in a file, and what can be read there."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def raw(self, n: int) -> bytes:
        self.at += n
        if self.at > len(self.data):
            raise ValueError("the file ends within an entry")
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.raw(1)[0]

    def number(self) -> int:
        """Seven bits a byte, the least first."""
        total, place = 0, 0
        while True:
            b = self.byte()
            total |= (b & 127) << place
            place += 7
            if b < 128:
                return total

    def text(self) -> str:
        return self.raw(self.number()).decode("utf-8", "replace")

    def packed(self, form: str):
        return struct.unpack(form, self.raw(struct.calcsize(form)))


def _elements(r: Reader, kind: str) -> Iterator[dict]:
    """The elements of the value at hand, as what their rows have besides key and type."""
    if kind == "string":
        yield {"value": r.text()}
        return
    width = r.number() if kind == "vector" else 0
    for _ in range(r.number()):
        if kind in ("list", "set"):
            yield {"value": r.text()}
        elif kind == "hash":
            yield {"field": r.text(), "value": r.text()}
        elif kind == "zset":
            yield {"score": r.packed("<d")[0], "value": r.text()}
        elif kind == "stream":
            yield {"field": r.text(), "pairs": [{"name": r.text(), "value": r.text()} for _ in range(r.number())]}
        else:
            yield {"field": r.text(), "vec": list(r.packed(f"<{width}f"))}


def unpack(data: bytes) -> Iterator[dict]:
    """The rows of a file. The sum is checked first; a sum of zero stands for none."""
    if len(data) < len(MAGIC) + 9 or data[:5] != MAGIC[:5]:
        raise ValueError("no snapshot file")
    (want,) = struct.unpack("<Q", data[-8:])
    if want and crc64(data[:-8]) != want:
        raise ValueError("bad checksum")
    names = {n: t for t, n in TYPES.items()}
    r, expires = Reader(data[:-8], len(MAGIC)), 0
    while (mark := r.byte()) != END:
        if mark == NOTE:
            r.text(), r.text()
        elif mark == DATABASE:
            r.number()
        elif mark == COUNTS:
            r.number(), r.number()
        elif mark == EXPIRY_MS:
            (expires,) = r.packed("<q")
        elif mark == EXPIRY_S:
            expires = r.packed("<I")[0] * 1000
        elif mark in names:
            key, kind = r.text(), names[mark]
            for i, element in enumerate(_elements(r, kind)):
                yield {"key": key, "type": kind, "expires_at_ms": expires, "idx": i, **element}
            expires = 0
        else:
            raise ValueError(f"unknown type {mark}")


def notes(data: bytes) -> dict[str, str]:
    """The notes at the head of a file."""
    r, out = Reader(data, len(MAGIC)), {}
    while r.byte() == NOTE:
        name = r.text()
        out[name] = r.text()
    return out


def _number(n: int) -> bytes:
    out = []
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _text(s: str | None) -> bytes:
    raw = (s or "").encode("utf-8", "replace")
    return _number(len(raw)) + raw


def _entry(rows: list[dict]) -> bytes:
    """One key's rows, in order, as an entry."""
    first, kind = rows[0], rows[0]["type"]
    head = (bytes([EXPIRY_MS]) + struct.pack("<q", first["expires_at_ms"]) if first.get("expires_at_ms") else b"") + bytes([TYPES[kind]]) + _text(first["key"])
    if kind == "string":
        return head + _text(first["value"])
    if kind == "vector":
        head += _number(len(rows[0]["vec"]))
    form = {
        "list": lambda r: _text(r["value"]),
        "set": lambda r: _text(r["value"]),
        "hash": lambda r: _text(r["field"]) + _text(r["value"]),
        "zset": lambda r: struct.pack("<d", math.nan if r["score"] is None else r["score"]) + _text(r["value"]),
        "stream": lambda r: _text(r["field"]) + _number(len(r["pairs"])) + b"".join(_text(p["name"]) + _text(p["value"]) for p in r["pairs"]),
        "vector": lambda r: _text(r["field"]) + struct.pack(f"<{len(r['vec'])}f", *r["vec"]),
    }[kind]
    return head + _number(len(rows)) + b"".join(map(form, rows))


def pack(entries: list[list[dict]], aux: dict[str, str] | None = None) -> bytes:
    """A file of entries, each the rows of one key in order."""
    out = bytearray(MAGIC)
    for name, value in (aux or {}).items():
        out += bytes([NOTE]) + _text(name) + _text(value)
    out += bytes([DATABASE, 0, COUNTS]) + _number(len(entries)) + _number(sum(bool(e[0].get("expires_at_ms")) for e in entries))
    for e in entries:
        out += _entry(e)
    out.append(END)
    return bytes(out) + struct.pack("<Q", crc64(bytes(out)))


def read(spark: SparkSession, path: str, pattern: str = "*", now_ms: int | None = None) -> DataFrame:
    """The long-form rows of the files below a path, without keys expired at now_ms."""
    prepare(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("content")

    def run(batches):
        for b in batches:
            for data in b.column(0):
                held = []
                for row in unpack(data.as_py()):
                    held.append(row)
                    if len(held) == BATCH_ROWS:
                        yield pa.RecordBatch.from_pylist(held, _ARROW)
                        held = []
                yield pa.RecordBatch.from_pylist(held, _ARROW)

    rows = files.mapInArrow(run, SCHEMA)
    return rows if now_ms is None else rows.filter((F.col("expires_at_ms") == 0) | (F.col("expires_at_ms") > now_ms))


def rows_of(kind: str, table: DataFrame, idx: Column | None = None, **columns: str) -> DataFrame:
    """A state table (key, ...) as long-form rows; columns say which of its columns are field, value,
    score, pairs and vec. expires_at_ms is taken where the table has it."""
    types = {"field": "string", "value": "string", "score": "double", "pairs": "array<struct<name:string,value:string>>", "vec": "array<float>"}
    expires = F.coalesce("expires_at_ms", F.lit(0)).cast("bigint") if "expires_at_ms" in table.columns else F.lit(0).cast("bigint")
    rest = [(F.col(columns[c]) if c in columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()]
    return table.select(F.col("key").cast("string").alias("key"), F.lit(kind).alias("type"), expires.alias("expires_at_ms"), (F.lit(0) if idx is None else idx).cast("bigint").alias("idx"), *rest)


def packed(rows: DataFrame, n_files: int, now_ms: int | None = None, aux: dict[str, str] | None = None) -> DataFrame:
    """(file, content): files of whole keys, by the hash of the key; expired keys are left out. A key's
    elements meet in one file, as the format has it."""
    prepare(rows.sparkSession)
    live = rows if now_ms is None else rows.filter((F.col("expires_at_ms") == 0) | (F.col("expires_at_ms") > now_ms))
    dealt = live.filter("key is not null").withColumn("file", F.pmod(F.xxhash64("key"), F.lit(n_files)).cast("int")).select("file", *[c.split()[0] for c in ("key", "type", "expires_at_ms", "idx", "field", "value", "score", "pairs", "vec")])
    ordered = dealt.repartition("file").sortWithinPartitions("file", "key", "type", "idx", "field", "value")

    def run(batches):
        at, entries = None, []
        for b in batches:
            for row in b.to_pylist():
                file = row.pop("file")
                if file != at and at is not None:
                    yield batch(at, entries)
                    entries = []
                at = file
                if entries and (entries[-1][0]["key"], entries[-1][0]["type"]) == (row["key"], row["type"]):
                    entries[-1].append(row)
                else:
                    entries.append([row])
        if at is not None:
            yield batch(at, entries)

    def batch(file, entries):
        return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([pack(entries, aux)], pa.binary())], names=["file", "content"])

    return ordered.mapInArrow(run, "file int, content binary")


def write(rows: DataFrame, folder: str, n_files: int = 1, now_ms: int | None = None, aux: dict[str, str] | None = None) -> int:
    """Write packed() files through the file system of the folder; how many. The executors make the
    contents; the driver passes them on, one in memory at a time, under a name that is
    changed once a file is whole."""
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    n = 0
    for r in packed(rows, n_files, now_ms, aux).toLocalIterator():
        to = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/dump-{r.file:05d}.rdb")
        part = to.suffix(".part")
        fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        out = fs.create(part, True)
        out.write(bytearray(r.content))
        out.close()
        fs.delete(to, False)
        fs.rename(part, to)
        n += 1
    return n
