"""Hash, list, set and sorted-set operators over long-form state tables.

hashes(key, field, value), lists(key, idx, value), sets(key, member) and
zsets(key, member, score). Order of a sorted set: score, then member bytewise.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelstone.functions.ranking import ranks, top
from keelstone.session import prepare


def cardinality(state: DataFrame, name: str = "n") -> DataFrame:
    """HLEN, LLEN, SCARD, ZCARD, XLEN."""
    return state.groupBy("key").agg(F.count(F.lit(1)).alias(name))


# hashes


def hset(ops: DataFrame) -> DataFrame:
    """(key, field, value): last writer wins."""
    return ops.groupBy("key", "field").agg(F.max_by("value", "seq").alias("value"))


def hget(requests: DataFrame, state: DataFrame) -> DataFrame:
    """HGET and HMGET: requests (pos, key, field) with values, null for misses."""
    return requests.join(state, ["key", "field"], "left").select("pos", "key", "field", "value")


def hgetall(state: DataFrame) -> DataFrame:
    """Each hash as a map; fields are unique in state."""
    return state.groupBy("key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("fields"))


def hkeys(state: DataFrame) -> DataFrame:
    """HKEYS: the field names of every hash."""
    return state.select("key", "field")


def hvals(state: DataFrame) -> DataFrame:
    """HVALS: the values of every hash, repeats included."""
    return state.select("key", "value")


def members(sets: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """SMEMBERS: each set's distinct members, of the given keys only where there are some."""
    out = sets.select("key", "member").distinct()
    return out if keys is None else out.join(keys.select("key").distinct(), "key", "left_semi")


def zscore(requests: DataFrame, zsets: DataFrame) -> DataFrame:
    """ZSCORE: requests (key, member) with scores, null for members that are not there."""
    return requests.join(zsets.select("key", "member", "score"), ["key", "member"], "left").select("key", "member", "score")


def remove(state: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """HDEL, SREM, ZREM, XDEL, XACK: the rest of the state."""
    return state.join(gone.select(*on), on, "left_anti")


def removed(state: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """Per key how many elements a removal takes."""
    return state.join(gone.select(*on), on, "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("removed"))


def present(requests: DataFrame, state: DataFrame, on: list[str]) -> DataFrame:
    """HEXISTS, SISMEMBER: requests with found 1 or 0."""
    return requests.join(state.select(*on).distinct().withColumn("__hit", F.lit(1)), on, "left").withColumn("found", F.coalesce("__hit", F.lit(0)).cast("bigint")).drop("__hit")


def hincrby(state: DataFrame, ops: DataFrame) -> DataFrame:
    """(key, field, value): integer fields after all increments (ops: key, field, delta)."""
    sums = ops.groupBy("key", "field").agg(F.sum("delta").alias("delta"))
    base = F.when(F.col("value").isNull(), F.lit(0)).when(F.col("value").rlike("^[+-]?[0-9]+$"), F.col("value").try_cast("bigint"))
    out = sums.join(state, ["key", "field"], "left").withColumn("now", F.try_add(base, F.col("delta")))
    return out.select("key", "field", F.col("now").cast("bigint").alias("value"), F.when(F.col("now").isNull(), F.lit("ERR hash value is not an integer")).alias("error"))


# lists


def pushed(ops: DataFrame) -> DataFrame:
    """Lists from pushes alone (ops: key, seq, pos, cmd, value): left pushes take falling
    places before the right ones, so places need no replay. idx counts from 0."""
    left = F.col("cmd") == "LPUSH"
    order = [F.when(left, F.lit(0)).otherwise(F.lit(1)), F.when(left, -F.col("seq")).otherwise(F.col("seq")), F.when(left, -F.col("pos")).otherwise(F.col("pos"))]
    side = ops.withColumns({"__side": order[0], "__seq": order[1], "__pos": order[2]})
    ranked = ranks(side.select("key", "value", "__side", "__seq", "__pos"), ["key"], [F.col("__side"), F.col("__seq"), F.col("__pos")], "idx")
    return ranked.select("key", (F.col("idx") - 1).alias("idx"), "value")


def replay_lists(ops: DataFrame) -> DataFrame:
    """Lists from pushes and pops in order: (key, idx, value).

    Pops depend on the state before them. Each task streams its keys' operations in
    order through one deque, so memory holds one list, not a key's operations.
    """
    prepare(ops.sparkSession)
    dealt = ops.select("key", F.col("seq").cast("bigint").alias("seq"), F.col("pos").cast("bigint").alias("pos"), "cmd", "value", F.col("count").cast("bigint").alias("count")).repartition("key").sortWithinPartitions("key", "seq", "pos")

    def rows(key, items):
        items = list(items)
        return pa.RecordBatch.from_arrays([pa.array([key] * len(items), pa.string()), pa.array(range(len(items)), pa.int64()), pa.array(items, pa.string())], names=["key", "idx", "value"])

    def run(batches):
        at, held, begun = None, deque(), False
        for b in batches:
            for key, _, _, cmd, value, count in zip(*(c.to_pylist() for c in b.columns)):
                if begun and key != at:
                    yield rows(at, held)
                    held = deque()
                at, begun = key, True
                if cmd == "LPUSH":
                    held.appendleft(value)
                elif cmd == "RPUSH":
                    held.append(value)
                else:
                    for _ in range(min(len(held), max(0, 1 if count is None else count))):
                        held.popleft() if cmd == "LPOP" else held.pop()
        if begun:
            yield rows(at, held)

    return dealt.mapInArrow(run, "key string, idx bigint, value string")


def _clamped(start: int, stop: int, size: Column) -> Column:
    a = F.greatest(F.when(F.lit(start) < 0, size + start).otherwise(F.lit(start)), F.lit(0))
    b = F.when(F.lit(stop) < 0, size + stop).otherwise(F.lit(stop))
    return (F.col("idx") >= a) & (F.col("idx") <= b)


def lrange(lists: DataFrame, start: int, stop: int) -> DataFrame:
    """Elements start to stop of every list, both inclusive, negatives from the tail.
    A list's size is an aggregate; no list is gathered."""
    if start >= 0 and stop >= 0:
        return lists.filter(F.col("idx").between(start, stop))
    size = lists.groupBy("key").agg(F.count(F.lit(1)).alias("__n"))
    return lists.join(size, "key").filter(_clamped(start, stop, F.col("__n"))).drop("__n")


def lindex(lists: DataFrame, i: int) -> DataFrame:
    return lrange(lists, i, i)


# sorted sets


def zadd(state: DataFrame, ops: DataFrame) -> DataFrame:
    """Upserts (ops: key, member, score, seq); a score that is no number refuses its operation."""
    good = ops.filter(F.col("score").isNotNull() & ~F.isnan("score"))
    both = state.select("key", "member", "score", F.lit(-1).cast("bigint").alias("seq")).union(good.select("key", "member", "score", "seq"))
    return both.groupBy("key", "member").agg(F.max_by("score", "seq").alias("score"))


def zrank(zsets: DataFrame) -> DataFrame:
    """Every member's rank from 0."""
    return ranks(zsets, ["key"], [F.col("score"), F.col("member")]).withColumn("rank", F.col("rank") - 1)


def zrange(zsets: DataFrame, start: int, stop: int, reverse: bool = False) -> DataFrame:
    """Members by rank, inclusive, negatives from the end; reverse is the exact mirror."""
    order = [F.col("score").desc(), F.col("member").desc()] if reverse else [F.col("score"), F.col("member")]
    if start >= 0 and stop >= 0:
        out = top(zsets, ["key"], order, stop + 1).withColumn("rank", (F.col("rn") - 1).cast("bigint"))
        return out.filter(F.col("rank") >= start).drop("rn")
    if start < 0 and stop < 0:
        back = [F.col("score"), F.col("member")] if reverse else [F.col("score").desc(), F.col("member").desc()]
        size = zsets.groupBy("key").agg(F.count(F.lit(1)).alias("__n"))
        out = top(zsets, ["key"], back, -start).filter(F.col("rn") >= -stop).join(size, "key")
        return out.withColumn("rank", (F.col("__n") - F.col("rn")).cast("bigint")).drop("rn", "__n")
    ranked = ranks(zsets, ["key"], order).withColumn("idx", F.col("rank") - 1)
    return lrange(ranked.drop("rank"), start, stop).withColumnRenamed("idx", "rank")
