"""Append-only command logs: a RESP decoder and encoder, and tables of operations.

A log file is a sequence of commands, each an array of byte strings. Files are
read as whole binary objects, one command a row in file order; the directory,
not a file, is the unit of parallelism, and writers roll files over at a size.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelstone.functions.ranking import ranks
from keelstone.session import prepare

#: Elements that a command of a dump holds, at most or, where they are dealt by hash, about.
ELEMENTS = 1024


def encode(args: list[bytes]) -> bytes:
    return b"*%d\r\n" % len(args) + b"".join(b"$%d\r\n%s\r\n" % (len(a), a) for a in args)


def decode(data: bytes) -> list[list[bytes]]:
    """The commands of a log; a broken tail is left out, inline commands are split at blanks."""
    out, at = [], 0
    while at < len(data):
        end = data.find(b"\r\n", at)
        if end < 0:
            break
        line, at = data[at:end], end + 2
        if line[:1] != b"*":
            if words := tokenize(line.decode("utf-8", "replace")):
                out.append([w.encode() for w in words])
            continue
        args = []
        try:
            for _ in range(int(line[1:])):
                end = data.index(b"\r\n", at)
                if data[at : at + 1] != b"$":
                    raise ValueError("bulk string expected")
                n = int(data[at + 1 : end])
                if end + 2 + n + 2 > len(data):
                    raise ValueError("cut off")
                args.append(data[end + 2 : end + 2 + n])
                at = end + 2 + n + 2
        except ValueError:
            break
        if args:
            out.append(args)
    return out


def tokenize(line: str) -> list[str]:
    """Words of an inline command: blanks part them, quotes hold them together, a backslash
    in double quotes escapes the next character."""
    out, word, quote, i = [], None, "", 0
    while i < len(line):
        c = line[i]
        if quote:
            if c == "\\" and quote == '"' and i + 1 < len(line):
                i += 1
                word += {"n": "\n", "r": "\r", "t": "\t"}.get(line[i], line[i])
            elif c == quote:
                quote = ""
            else:
                word += c
        elif c in "\"'":
            quote, word = c, word or ""
        elif c.isspace():
            if word is not None:
                out.append(word)
            word = None
        else:
            word = (word or "") + c
        i += 1
    return [*out, word] if word is not None else out


def read(spark: SparkSession, path: str, pattern: str = "*.aof") -> DataFrame:
    """(file, seq, cmd, args) of all commands below a path."""
    prepare(spark)
    src = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches):
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1)):
                commands = decode(data.as_py())
                for i in range(0, len(commands), 10_000):
                    part = commands[i : i + 10_000]
                    text = [[a.decode("utf-8", "replace") for a in c] for c in part]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(range(i, i + len(part)), pa.int64()), pa.array([t[0].upper() for t in text]), pa.array([t[1:] for t in text], pa.list_(pa.string()))], names=["file", "seq", "cmd", "args"])

    return src.mapInArrow(run, "file string, seq bigint, cmd string, args array<string>")


def encoded(commands: DataFrame) -> DataFrame:
    """(seq, line): each command (seq, cmd, args) as RESP text."""
    bulk = lambda a: F.concat(F.lit("$"), F.octet_length(a).cast("string"), F.lit("\r\n"), a, F.lit("\r\n"))
    all_args = F.concat(F.array("cmd"), F.col("args"))
    return commands.select("seq", F.concat(F.lit("*"), F.size(all_args).cast("string"), F.lit("\r\n"), F.array_join(F.transform(all_args, bulk), "")).alias("line"))


def write(commands: DataFrame, path: str) -> None:
    """One log file a partition, in the order of seq across and within files."""
    lines = encoded(commands).repartitionByRange("seq").sortWithinPartitions("seq")
    lines.select(F.expr("left(line, length(line) - 2)")).write.option("lineSep", "\r\n").text(path)


def dump(strings: DataFrame | None = None, hashes: DataFrame | None = None, lists: DataFrame | None = None, sets: DataFrame | None = None, zsets: DataFrame | None = None, streams: DataFrame | None = None, vectors: DataFrame | None = None, expiring: DataFrame | None = None) -> DataFrame:
    """State as commands (step, cmd, args) that make it again: SET a string; HSET, RPUSH, SADD and ZADD
    in commands of at most ELEMENTS elements, so no key is gathered in one row; XADD an entry (streams: key, ms,
    seq, pairs); VADD a vector (vectors: key, id, vec); and, step 1, PEXPIREAT a key that expires
    (expiring: key, expires_at_ms). Commands of a step may run in any order but lists' and
    streams', whose `at` counts up within the key."""
    at0 = F.lit(0).cast("bigint")
    one = lambda df, cmd, args, at=at0, step=0: df.select(F.lit(step).alias("step"), F.lit(cmd).alias("cmd"), at.cast("bigint").alias("at"), args.alias("args"))
    text = lambda c: F.col(c).cast("string")

    def some(df, cmd, order, *cols):
        """Elements dealt by place, or by hash where there is none, into commands of bounded size."""
        if order is None:
            sized = df.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / ELEMENTS).alias("parts"))
            df = df.join(sized, "key").withColumn("part", F.pmod(F.xxhash64(*cols), F.col("parts")))
            order = cols[0]
        else:
            df = df.withColumn("part", F.floor(F.col(order) / ELEMENTS))
        items = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.array(*map(text, cols)).alias("a"))))
        many = df.groupBy("key", "part").agg(items.alias("i"))
        return one(many, cmd, F.concat(F.array("key"), F.flatten(F.transform("i", lambda x: x["a"]))), F.col("part"))

    made = []
    if strings is not None:
        made.append(one(strings, "SET", F.array("key", "value")))
    for table, cmd, order, cols in ((hashes, "HSET", None, ("field", "value")), (lists, "RPUSH", "idx", ("value",)), (sets, "SADD", None, ("member",)), (zsets, "ZADD", None, ("score", "member"))):
        if table is not None:
            made.append(some(table, cmd, order, *cols))
    if streams is not None:
        place = ranks(streams, ["key"], [F.col("ms"), F.col("seq")], "at")
        made.append(one(place, "XADD", F.concat(F.array("key", F.concat_ws("-", text("ms"), text("seq"))), F.flatten(F.transform("pairs", lambda p: F.array(p["name"], p["value"])))), F.col("at")))
    if vectors is not None:
        made.append(one(vectors, "VADD", F.concat(F.array("key", text("id")), F.transform("vec", lambda x: x.cast("string")))))
    if expiring is not None:
        made.append(one(expiring.filter("expires_at_ms > 0"), "PEXPIREAT", F.array("key", text("expires_at_ms")), step=1))
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out
