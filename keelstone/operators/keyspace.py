"""Keyspace operators over keys(key, type, expires_at_ms, ...) and typed state tables.

Lookups are joins of a request table with state; writes are folds of an ordered
operation log; expiry is a predicate at a given time.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelstone.functions import expr
from keelstone.functions.ranking import running
from keelstone.session import prepare, stored

#: Commands that write, and commands for administrators. The first list also has the
#: writes that a replica has to refuse and the reference's list leaves out (decision 17 of the survey); the
#: second adds the commands that change users, storage or the cluster, which are no user's business.
WRITES = ("SET", "SETNX", "SETEX", "PSETEX", "MSET", "APPEND", "INCR", "DECR", "INCRBY", "DECRBY", "DEL", "EXPIRE", "PEXPIRE", "PERSIST", "FLUSHDB", "FLUSHALL", "HSET", "HMSET", "HDEL", "HINCRBY", "LPUSH", "RPUSH", "LPOP", "RPOP", "SADD", "SREM", "ZADD", "ZREM", "XADD", "XDEL", "XTRIM", "XGROUP", "XREADGROUP", "XACK", "VADD", "VDEL")
ADMIN = ("ACL", "CONFIG", "FLUSHALL", "FLUSHDB", "SAVE", "BGSAVE", "BGREWRITEAOF", "CLUSTER", "REPLICAOF", "SLAVEOF", "SHUTDOWN")


def live(keys: DataFrame, now_ms: int) -> DataFrame:
    return keys.filter(expr.is_live(F.col("expires_at_ms"), now_ms))


def mget(requests: DataFrame, strings: DataFrame) -> DataFrame:
    """requests (pos, key) with each key's value, null for misses; order by pos to read."""
    return requests.join(strings.select("key", "value"), "key", "left").select("pos", "key", "value")


def exists(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """One row: how many requested keys there are; a key asked for twice counts twice."""
    return requests.join(keys.select("key"), "key", "left_semi").agg(F.count(F.lit(1)).alias("n"))


def type_of(requests: DataFrame, keys: DataFrame) -> DataFrame:
    return requests.join(keys.select("key", "type"), "key", "left").select("key", F.coalesce("type", F.lit("none")).alias("type"))


def scan(keys: DataFrame, pattern: str, prefix_fallback: bool = True, now_ms: int | None = None) -> DataFrame:
    """KEYS: the keys that a pattern selects, without those expired at now_ms where that is given."""
    found = keys.filter(expr.glob(F.col("key"), pattern, prefix_fallback))
    return found if now_ms is None else live(found, now_ms)


def sizes_by_type(keys: DataFrame) -> DataFrame:
    """DBSIZE: how many keys of each type there are."""
    return keys.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def strlen(strings: DataFrame) -> DataFrame:
    """STRLEN: each value's length in bytes; a missing value has none."""
    return strings.withColumn("bytes", F.coalesce(F.octet_length("value"), F.lit(0)).cast("bigint")).drop("value")


def metas(keys: DataFrame, sizes: DataFrame, now_ms: int, pattern: str = "*", limit: int | None = None) -> DataFrame:
    """key, type, ttl, size, updated_at_ms; the first `limit` by key where one is asked for (a report's feature)."""
    out = scan(keys, pattern, False).join(sizes, "key", "left").select("key", "type", expr.ttl(F.col("expires_at_ms"), now_ms).alias("ttl"), F.coalesce("size", F.lit(0)).cast("bigint").alias("size"), "updated_at_ms")
    return out if limit is None else out.orderBy("key").limit(limit)


def evict(keys: DataFrame, n: int) -> DataFrame:
    """What stays when the n least recently used keys go; ties by key."""
    return keys.join(victims(keys, n).select("key"), "key", "left_anti")


def victims(keys: DataFrame, n: int) -> DataFrame:
    return keys.orderBy("last_accessed_ms", "key").limit(n)


# ---- folds of an operation log: ops(seq, ts_ms, cmd, key, value, delta, ttl_ms) ----


def after_reset(ops: DataFrame, resets: tuple[str, ...] = ("DEL",)) -> DataFrame:
    """The operations after each key's last reset and after the last flush. Both are
    aggregates that combine before the shuffle, and one joins back."""
    flush = ops.filter(F.col("cmd").isin("FLUSHALL", "FLUSHDB")).agg(F.max("seq").alias("__flush"))
    last = ops.filter(F.col("cmd").isin(*resets)).groupBy("key").agg(F.max("seq").alias("__reset"))
    kept = ops.filter(~F.col("cmd").isin("FLUSHALL", "FLUSHDB", *resets)).crossJoin(F.broadcast(flush))  # one row
    return kept.join(last, "key", "left").filter((F.col("seq") > F.coalesce("__reset", F.lit(-1))) & (F.col("seq") > F.coalesce("__flush", F.lit(-1)))).drop("__flush", "__reset")


def fold_set(ops: DataFrame) -> DataFrame:
    """SET: the last writer wins."""
    return after_reset(ops).filter("cmd = 'SET'").groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def fold_setnx(ops: DataFrame) -> DataFrame:
    """SETNX and SET: the first writer since the last reset wins, until a SET; the last SET wins then."""
    kept = after_reset(ops).filter(F.col("cmd").isin("SET", "SETNX"))
    plain = F.col("cmd") == "SET"
    both = kept.groupBy("key").agg(F.max(F.when(plain, F.struct("seq", "value"))).alias("s"), F.min(F.when(~plain, F.struct("seq", "value"))).alias("n"))
    return both.select("key", F.when(F.col("s").isNotNull(), F.col("s.value")).otherwise(F.col("n.value")).alias("value"))


def _based(ops: DataFrame, cmd: str) -> DataFrame:
    """The operations `cmd` after each key's last reset, with its last SET's seq and value where that
    comes first (nulls else), and of keys that were only set that SET alone."""
    kept = after_reset(ops)
    base = kept.filter("cmd = 'SET'").groupBy("key").agg(F.max(F.struct("seq", "value")).alias("b"))
    rest = kept.filter(F.col("cmd") == cmd).join(base, "key", "left").filter(F.col("seq") > F.coalesce("b.seq", F.lit(-1)))
    return rest.drop("b"), base.select("key", F.col("b.value").alias("base"))


def fold_counter(ops: DataFrame) -> DataFrame:
    """SET, INCRBY and DEL: the sum since the last SET or DEL on top of its value. Where that is no
    integer, or the sum is beyond 64 bits, the base stays and the error says so."""
    rest, base = _based(ops, "INCRBY")
    sums = rest.groupBy("key").agg(F.sum(F.col("delta").cast("decimal(38,0)")).alias("sum"))
    both = base.withColumn("set", F.lit(True)).join(sums, "key", "full_outer")
    number = F.when(F.col("set").isNull(), F.lit(0)).when(F.col("base").rlike("^[+-]?[0-9]+$"), F.col("base").try_cast("bigint"))
    total = (number.cast("decimal(38,0)") + F.col("sum")).try_cast("bigint")
    out = both.select("key", "base", F.col("sum").isNotNull().alias("counted"), total.alias("total"))
    return out.select("key", F.coalesce(F.col("total").cast("string"), "base").alias("value"), F.when(F.col("counted") & F.col("total").isNull(), F.lit("ERR value is not an integer or out of range")).alias("error"))


def fold_append(ops: DataFrame) -> DataFrame:
    """APPEND in order on top of the last SET: the value, and its length in bytes. A key's value is one
    string, so its pieces meet in one row: as long as the value itself, no longer."""
    rest, base = _based(ops, "APPEND")
    parts = rest.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("seq", "value"))).alias("p")).join(base, "key", "full_outer")
    value = F.concat(F.coalesce("base", F.lit("")), F.coalesce(F.array_join(F.col("p.value"), ""), F.lit("")))
    return parts.select("key", value.alias("value"), F.octet_length(value).cast("bigint").alias("bytes"))


def fold_expiry(ops: DataFrame) -> DataFrame:
    """EXPIRE, PEXPIRE, SETEX, PERSIST and SET as writes to the expiry column; the last wins.
    Expiries that are not after zero are kept as 1: long past, not `none`."""
    at = F.when(F.col("cmd").isin("PERSIST", "SET"), F.lit(0)).otherwise(F.greatest(F.col("ts_ms") + F.col("ttl_ms"), F.lit(1)))
    return after_reset(ops).filter(F.col("cmd").isin("EXPIRE", "PEXPIRE", "SETEX", "PSETEX", "PERSIST", "SET")).groupBy("key").agg(F.max_by(at, "seq").cast("bigint").alias("expires_at_ms"))


def mset_ops(commands: DataFrame) -> DataFrame:
    """MSET rows (seq, args) as SET operations; within a command the later pair wins."""
    pairs = commands.select("seq", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor(F.size("args") / 2).cast("int") - 1), lambda i: F.struct(F.get("args", 2 * i).alias("key"), F.get("args", 2 * i + 1).alias("value")))).alias("pos", "p"))
    return pairs.select(F.struct("seq", "pos").alias("seq"), F.col("p.key").alias("key"), F.col("p.value").alias("value"))


# ---- predicates over commands ----


def command_keys(cmd: Column, args: Column) -> Column:
    """The keys that a command touches: all, every second, those behind STREAMS, or the first argument."""
    lead = F.when(cmd == "XREADGROUP", F.lit(3)).otherwise(F.lit(0))  # GROUP, its name and the consumer's may be any words
    options = F.slice(args, lead + 1, F.size(args))
    rest = F.slice(options, F.array_position(F.transform(options, F.upper), "STREAMS").cast("int") + 1, F.size(options))
    return (
        F.when(cmd.isin("MGET", "DEL", "EXISTS"), args)
        .when(cmd == "MSET", F.filter(args, lambda _, i: i % 2 == 0))
        .when(cmd.isin("EVAL", "EVALSHA"), F.slice(args, 3, F.greatest(F.coalesce(F.get(args, F.lit(1)).try_cast("int"), F.lit(0)), F.lit(0))))
        .when(cmd.isin("PING", "INFO", "DBSIZE", "KEYS", "TIME", "FLUSHALL", "FLUSHDB", "PUBLISH", "SUBSCRIBE"), F.array().cast("array<string>"))
        .when(cmd.isin("XREAD", "XREADGROUP"), F.when(F.array_contains(F.transform(options, F.upper), "STREAMS"), F.slice(rest, 1, F.floor(F.size(rest) / 2).cast("int"))).otherwise(F.array().cast("array<string>")))
        .when(cmd.isin("XGROUP", "XINFO"), F.slice(args, 2, 1))
        .otherwise(F.slice(args, 1, 1))
    )


def is_write(cmd: Column) -> Column:
    return F.upper(cmd).isin(*WRITES)


def _rules(users: DataFrame) -> DataFrame:
    """The users with each key pattern as a path glob's regex and, where it ends in a star, its prefix."""
    prepare(users.sparkSession)

    def run(batches):
        for b in batches:
            rules = [None if ps is None else [{"regex": expr.glob_regex(q), "prefix": q.removesuffix("*") if q.endswith("*") else None} for q in (p.removeprefix("~") for p in ps if p is not None)] for ps in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(rules, pa.list_(pa.struct([("regex", pa.string()), ("prefix", pa.string())])))], names=["user", "enabled", "is_admin", "read_only", "rules"])

    u = users.select(F.col("user").cast("string").alias("user"), "enabled", "is_admin", "read_only", "patterns")
    return u.mapInArrow(run, "user string, enabled boolean, is_admin boolean, read_only boolean, rules array<struct<regex:string,prefix:string>>")


def deny_reason(commands: DataFrame, users: DataFrame) -> DataFrame:
    """commands (user, cmd, keys) with deny_reason, null where allowed.
    users: user, enabled, is_admin, read_only, patterns. A pattern is a path glob (a star stops
    at a slash, ? is one character, [..] a class); one that ends in a star also takes all keys that
    begin as it does; `*` and `~*` take every key."""
    reached = lambda k: F.exists("rules", lambda r: F.coalesce(r["prefix"] == "", F.lit(False)) | F.rlike(k, r["regex"]) | F.coalesce(F.startswith(k, r["prefix"]), F.lit(False)))
    reason = (
        F.when(F.col("enabled").isNull() | ~F.col("enabled"), F.lit("disabled"))
        .when(F.upper("cmd").isin(*ADMIN) & ~F.col("is_admin"), F.lit("admin"))
        .when(F.col("read_only") & is_write(F.col("cmd")), F.lit("readonly"))
        .when(~F.forall("keys", reached), F.lit("key"))
    )
    return commands.join(_rules(users), "user", "left").withColumn("deny_reason", reason).drop("enabled", "is_admin", "read_only", "rules")


# ---- transactions: ops(seq, conn, cmd, key, ...) ----


def transactions(ops: DataFrame, writes: DataFrame | None = None) -> DataFrame:
    """Each operation with its transaction and outcome.

    Operations between a connection's first MULTI and the EXEC or DISCARD after it belong to
    one transaction (tx = that MULTI's seq; a MULTI inside is refused and changes nothing).
    `exec_seq` is where they take effect; discarded and unfinished ones have none, nor,
    where writes (key, seq) are given, have those whose connection watched a key,
    between the transaction before and the EXEC, that was written in between; UNWATCH forgets.
    A connection may hold any share of all operations.
    """
    fences = F.col("cmd").isin("EXEC", "DISCARD")
    own = [c for c in ops.columns]
    held = stored(running(ops, ["conn"], ["seq"], {"__from": ("last", F.when(fences, F.col("seq")))}).withColumn("__from", F.coalesce("__from", F.lit(-1))), "transactions")
    facts = held.groupBy("conn", "__from").agg(F.min(F.when(F.col("cmd") == "MULTI", F.col("seq"))).alias("__multi"), F.max(F.when(fences, F.struct("seq", "cmd"))).alias("__end"), F.max(F.when(F.col("cmd") == "UNWATCH", F.col("seq"))).alias("__unwatch"))
    runs = F.when(F.col("__end.cmd") == "EXEC", F.col("__end.seq"))
    if writes is not None:
        watched = held.filter("cmd = 'WATCH'").select("conn", "__from", "key", "seq").join(facts, ["conn", "__from"]).filter(F.col("__multi").isNotNull() & runs.isNotNull() & (F.col("seq") > F.coalesce("__unwatch", F.lit(-1))))
        gone = aborted(watched.select(F.col("__multi").alias("tx"), "key", F.col("seq").alias("watch_seq"), runs.alias("exec_seq")), writes)
        facts = facts.join(gone.select(F.col("tx").alias("__multi"), F.lit(True).alias("__gone")), "__multi", "left")
    else:
        facts = facts.withColumn("__gone", F.lit(None).cast("boolean"))
    facts = facts.withColumnsRenamed({"conn": "__conn", "__from": "__segment"})
    both = held.join(facts, F.col("conn").eqNullSafe(F.col("__conn")) & (F.col("__from") == F.col("__segment"))).select(*own, "__multi", "__end", "__gone")
    inside = (F.col("__multi") < F.col("seq")) & ~F.col("cmd").isin("MULTI", "EXEC", "DISCARD", "WATCH", "UNWATCH")
    both = both.withColumn("tx", F.when(inside, F.col("__multi")))
    return both.withColumn("exec_seq", F.when(F.col("tx").isNull(), F.col("seq")).when(F.col("__gone").isNull(), runs)).drop("__multi", "__end", "__gone")


def aborted(watches: DataFrame, writes: DataFrame) -> DataFrame:
    """The transactions whose watched keys were written meanwhile. watches: tx, key,
    watch_seq, exec_seq; writes: key, seq. Each watch is compared with the last write of its key
    before its EXEC alone, whatever the number of writes."""
    asked = watches.select("key", F.col("exec_seq").alias("at"), "tx", "watch_seq", F.lit(None).cast("bigint").alias("wrote"))
    given = writes.select("key", F.col("seq").alias("at"), F.lit(None).cast("bigint").alias("tx"), F.lit(None).cast("bigint").alias("watch_seq"), F.col("seq").cast("bigint").alias("wrote"))
    both = asked.unionByName(given).withColumn("order", F.when(F.col("wrote").isNull(), F.lit(0)).otherwise(F.lit(1)))  # a write in the place of the EXEC is after it
    seen = running(both, ["key"], ["at", "order"], {"before": ("last", F.col("wrote"))})
    return seen.filter("tx is not null and before > watch_seq").select("tx").distinct()
