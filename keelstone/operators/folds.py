"""Folds of a mixed operation log: ops(seq, ts_ms, cmd, key, ...) in the order of seq.

string_fold takes every command of string keys, with expiry inside the log; hash_fold,
set_fold and zset_fold take writes, removals and resets of elements. A log's rows of a null
key are those of the commands that have none (FLUSHALL, FLUSHDB); other such rows do nothing.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelstone.session import prepare

FLUSHES = ("FLUSHALL", "FLUSHDB")
_INTEGER = re.compile(r"[+-]?[0-9]+")
_SIGN = {"INCR": 1, "INCRBY": 1, "DECR": -1, "DECRBY": -1}


def _flushed(ops: DataFrame) -> DataFrame:
    """(__flush): the seq of the last flush, one row."""
    return ops.filter(F.col("cmd").isin(*FLUSHES)).agg(F.max("seq").alias("__flush"))


def since_reset(ops: DataFrame, reset: Column) -> DataFrame:
    """Each key's operations from its last one for which `reset` holds on, that one included, and after
    the last flush. Last resets are aggregates that combine before the shuffle."""
    last = ops.filter(reset & F.col("key").isNotNull()).groupBy("key").agg(F.max("seq").alias("__reset"))
    kept = ops.filter(~F.col("cmd").isin(*FLUSHES) & F.col("key").isNotNull()).crossJoin(F.broadcast(_flushed(ops)))  # one row
    return kept.join(last, "key", "left").filter((F.col("seq") >= F.coalesce("__reset", F.lit(-1))) & (F.col("seq") > F.coalesce("__flush", F.lit(-1)))).drop("__flush", "__reset")


class Cell:
    """One string key's state, moved on by operations in order."""

    __slots__ = ("value", "expires")

    def __init__(self):
        self.value, self.expires = None, 0

    def apply(self, ts: int, cmd: str, value: str | None, delta: int | None, ttl: int | None, cond: str | None) -> None:
        if self.value is not None and 0 < self.expires <= ts:
            self.value, self.expires = None, 0
        there = self.value is not None
        if cmd in ("SET", "SETEX", "PSETEX", "MSET", "SETNX"):
            held = {"NX": there, "XX": not there}.get("NX" if cmd == "SETNX" else cond or "", False)
            if held or (cmd in ("SETEX", "PSETEX") or ttl is not None) and (ttl or 0) <= 0:
                return
            self.value, self.expires = value or "", ts + ttl if ttl else 0
        elif cmd == "APPEND":
            self.value = (self.value or "") + (value or "")
        elif cmd in _SIGN:
            now = self.value if there else "0"
            if _INTEGER.fullmatch(now) and -(1 << 63) <= int(now) < 1 << 63:
                by = int(now) + _SIGN[cmd] * (1 if delta is None else delta)
                if -(1 << 63) <= by < 1 << 63:
                    self.value = str(by)
        elif cmd == "DEL":
            self.value, self.expires = None, 0
        elif cmd in ("EXPIRE", "PEXPIRE") and there:
            self.expires = max(ts + (ttl or 0), 1)
        elif cmd == "PERSIST" and there:
            self.expires = 0


def string_fold(ops: DataFrame, now_ms: int | None = None) -> DataFrame:
    """(key, value, expires_at_ms) of the string keys that a log leaves, those expired by now_ms left out.

    ops: seq, ts_ms, cmd, key, value, delta, ttl_ms and cond (NX, XX or null). SET, SETNX, SETEX,
    PSETEX, MSET, APPEND, INCR, INCRBY, DECR, DECRBY, DEL, EXPIRE, PEXPIRE, PERSIST and the flushes;
    ttl_ms is in milliseconds whatever the command, and one that is not above zero refuses a write.
    A key is gone from its expiry on. Counting refuses values that are no 64-bit
    integers and sums beyond them, and leaves them as they are; it and APPEND keep the expiry.

    What stands before a key's last unconditional write or DEL is dropped by an aggregate first.
    The rest is read in order, one key's value in memory at a time; counters that only count
    are summed before that, so that a hot one is no long stream.
    """
    prepare(ops.sparkSession)
    o = ops.select("seq", "ts_ms", "cmd", "key", "value", F.col("delta").cast("bigint").alias("delta"), F.col("ttl_ms").cast("bigint").alias("ttl_ms"), F.upper("cond").alias("cond"))
    plain = F.col("cmd").isin("SET", "MSET") & F.col("cond").isNull() & (F.col("ttl_ms").isNull() | (F.col("ttl_ms") > 0))
    timed = F.col("cmd").isin("SETEX", "PSETEX") & (F.col("ttl_ms") > 0)
    tail = since_reset(o, F.coalesce(plain | timed, F.lit(False)) | (F.col("cmd") == "DEL"))
    counting = F.col("cmd").isin(*_SIGN)
    by = F.when(F.col("cmd").isin("DECR", "DECRBY"), F.lit(-1)).otherwise(F.lit(1)) * F.coalesce("delta", F.lit(1)).cast("decimal(38,0)")
    # a counter's head (its reset, or none) and its sum; any other command, expiry or sum near the limit makes a stream of it
    head = F.coalesce((plain & F.col("ttl_ms").isNull()) | (F.col("cmd") == "DEL"), F.lit(False))
    facts = tail.groupBy("key").agg(F.bool_and(counting | head).alias("counts"), F.sum(F.when(counting, by)).alias("sum"), F.sum(F.when(counting, F.abs(by))).alias("reach"), F.max(F.when(head, F.struct("seq", "cmd", "value"))).alias("head"), F.count(F.lit(1)).alias("n"))
    number = F.when(F.col("head.cmd").isin("SET", "MSET"), F.when(F.col("head.value").rlike("^[+-]?[0-9]+$"), F.col("head.value").try_cast("bigint"))).otherwise(F.lit(0))
    safe = F.coalesce(F.col("counts") & F.col("reach").isNotNull() & (F.abs(number.cast("decimal(38,0)")) + F.col("reach") < F.lit(2**63 - 1).cast("decimal(38,0)")), F.lit(False))
    alone = F.coalesce((F.col("n") == 1) & F.col("head").isNotNull(), F.lit(False))
    facts = facts.withColumns({"safe": safe & ~alone, "number": number, "alone": alone})
    set_once = facts.filter("alone and head.cmd <> 'DEL'").select("key", F.coalesce("head.value", F.lit("")).alias("value"), F.lit(0).cast("bigint").alias("expires_at_ms"))
    summed = facts.filter("safe").select("key", (F.col("number").cast("decimal(38,0)") + F.col("sum")).cast("bigint").cast("string").alias("value"), F.lit(0).cast("bigint").alias("expires_at_ms"))
    rest = tail.join(facts.filter("not safe and not alone").select("key"), "key", "left_semi")
    dealt = rest.select("key", F.col("seq").cast("bigint").alias("seq"), F.col("ts_ms").cast("bigint").alias("ts_ms"), "cmd", "value", "delta", "ttl_ms", "cond").repartition("key").sortWithinPartitions("key", "seq")

    def run(batches):
        at, cell, out = None, Cell(), []
        for b in batches:
            for key, _, ts, cmd, value, delta, ttl, cond in zip(*(c.to_pylist() for c in b.columns)):
                if key != at:
                    if cell.value is not None:
                        out.append((at, cell.value, cell.expires))
                    at, cell = key, Cell()
                cell.apply(ts, cmd, value, delta, ttl, cond)
            yield batch(out)
            out = []
        if cell.value is not None:
            yield batch([(at, cell.value, cell.expires)])

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["key", "value", "expires_at_ms"])

    left = summed.unionByName(set_once).unionByName(dealt.mapInArrow(run, "key string, value string, expires_at_ms bigint"))
    return left if now_ms is None else left.filter((F.col("expires_at_ms") == 0) | (F.col("expires_at_ms") > now_ms))


def _elements(ops: DataFrame, element: str, writes: tuple[str, ...], removals: tuple[str, ...], keep: list[str]) -> DataFrame:
    """Each element's last write or removal after its key's last DEL and the last flush, removals dropped.
    A key of any size is spread by its elements."""
    live = since_reset(ops, F.col("cmd") == "DEL").filter(F.col("cmd").isin(*writes, *removals) & F.col(element).isNotNull())
    last = live.groupBy("key", element).agg(F.max(F.struct("seq", "cmd", *keep)).alias("l"))
    return last.filter(F.col("l.cmd").isin(*writes)).select("key", element, *[F.col(f"l.{c}").alias(c) for c in keep])


def set_fold(ops: DataFrame) -> DataFrame:
    """(key, member) after SADD, SREM, DEL and flushes; ops: seq, cmd, key, member."""
    return _elements(ops, "member", ("SADD",), ("SREM",), [])


def zset_fold(ops: DataFrame) -> DataFrame:
    """(key, member, score) after ZADD, ZREM, DEL and flushes; ops: seq, cmd, key, member, score. A
    ZADD without a number is refused."""
    good = (F.col("cmd") != "ZADD") | (F.col("score").isNotNull() & ~F.isnan(F.col("score").cast("double")))
    return _elements(ops.filter(good), "member", ("ZADD",), ("ZREM",), ["score"])


def hash_fold(ops: DataFrame) -> DataFrame:
    """(key, field, value, error) after HSET, HMSET, HDEL, HINCRBY, DEL and flushes; ops: seq, cmd, key,
    field, value, delta. HINCRBY adds to the field's last write, or to 0; where that is no integer, or
    the sum is beyond 64 bits, the written value stays and error says so."""
    live = since_reset(ops, F.col("cmd") == "DEL").filter(F.col("cmd").isin("HSET", "HMSET", "HDEL", "HINCRBY") & F.col("field").isNotNull())
    adds = F.col("cmd") == "HINCRBY"
    base = live.filter(~adds).groupBy("key", "field").agg(F.max(F.struct("seq", "cmd", "value")).alias("b"))
    rest = live.filter(adds).join(base.select("key", "field", F.col("b.seq").alias("base_seq")), ["key", "field"], "left").filter(F.col("seq") > F.coalesce("base_seq", F.lit(-1)))
    sums = rest.groupBy("key", "field").agg(F.sum(F.col("delta").cast("decimal(38,0)")).alias("sum"))
    both = base.join(sums, ["key", "field"], "full_outer")
    text = F.when(F.col("b.cmd") != "HDEL", F.col("b.value"))
    number = F.when(text.isNull(), F.lit(0)).when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint")).cast("decimal(38,0)")
    total = F.try_add(number, F.col("sum")).try_cast("bigint")
    out = both.select("key", "field", text.alias("text"), F.col("sum").isNotNull().alias("counted"), total.alias("total")).filter("text is not null or counted")
    return out.select("key", "field", F.when(F.col("counted") & F.col("total").isNotNull(), F.col("total").cast("string")).otherwise(F.col("text")).alias("value"), F.when(F.col("counted") & F.col("total").isNull(), F.lit("ERR hash value is not an integer")).alias("error"))
