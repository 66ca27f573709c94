import random

import pytest
from pyspark.sql import functions as F

from keelstone.functions import expr
from keelstone.functions.ranking import running
from keelstone.operators import folds, groups, keyspace, streams
from keelstone.operators import collections as coll

COMMANDS = ["SET", "SET", "SETNX", "SETEX", "PSETEX", "MSET", "APPEND", "INCR", "INCRBY", "DECR", "DECRBY", "DEL", "EXPIRE", "PEXPIRE", "PERSIST", "FLUSHALL"]
SCHEMA = "seq bigint, ts_ms bigint, cmd string, key string, value string, delta bigint, ttl_ms bigint, cond string"


def dictionary(rows, now):
    """The same log through a dictionary key -> [value, deadline or None]."""
    held = {}
    for _, ts, cmd, key, value, delta, ttl, cond in sorted(rows):
        for k in [k for k, (_, d) in held.items() if d is not None and d <= ts]:
            del held[k]
        if cmd in ("FLUSHALL", "FLUSHDB"):
            held.clear()
        elif cmd == "DEL":
            held.pop(key, None)
        elif cmd in ("SET", "MSET", "SETEX", "PSETEX", "SETNX"):
            if ttl is not None and ttl <= 0 or ttl is None and cmd in ("SETEX", "PSETEX"):
                continue
            if not ((cmd == "SETNX" or cond == "NX") and key in held or cond == "XX" and key not in held):
                held[key] = [value, None if ttl is None else ts + ttl]
        elif cmd == "APPEND":
            held.setdefault(key, ["", None])[0] += value
        elif cmd in ("EXPIRE", "PEXPIRE"):
            if key in held:
                held[key][1] = max(ts + ttl, 1)
        elif cmd == "PERSIST":
            if key in held:
                held[key][1] = None
        else:
            by = (1 if delta is None else delta) * (-1 if cmd[:4] == "DECR" else 1)
            old = held.get(key, ["0", None])[0]
            try:
                new = int(old) + by if old.strip() == old and "_" not in old else None
            except ValueError:
                new = None
            if new is not None and abs(new) < 2**63:
                held.setdefault(key, ["", None])[0] = str(new)
    return {k: (v, d or 0) for k, (v, d) in held.items() if d is None or d > now}


@pytest.mark.parametrize("seed", range(3))
def test_mixed_logs_equal_a_dictionary(spark, seed):
    g = random.Random(seed)
    rows, ts = [], 1000
    for seq in range(3000):
        ts += g.randrange(3)
        cmd = g.choice(COMMANDS[:-1]) if g.random() < 0.999 else "FLUSHALL"
        key = None if cmd == "FLUSHALL" else f"k{int(g.random() ** 2 * 120)}"
        if key and int(key[1:]) >= 60:  # keys that are only counted, or only written
            cmd = g.choice(("INCR", "INCRBY", "DECRBY", "SET")) if int(key[1:]) % 2 else "SET"
        cond = g.choice((None, "NX", "XX")) if cmd == "SET" and key and int(key[1:]) < 60 else None
        ttl = {"SET": g.choice((None, None, 40, 0)), "SETEX": g.choice((30, 0, None)), "PSETEX": 25, "EXPIRE": g.choice((50, -5)), "PEXPIRE": 20}.get(cmd)
        ttl = None if key and int(key[1:]) >= 60 else ttl
        value = g.choice((str(g.randrange(50)), "x", "+7", str(2**63 - 5), "", "é")) if cmd in ("SET", "SETNX", "SETEX", "PSETEX", "MSET", "APPEND") else None
        rows.append((seq, ts, cmd, key, value, g.choice((None, 3, -4)) if cmd in ("INCRBY", "DECRBY") else None, ttl, cond))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.key: (r.value, r.expires_at_ms) for r in folds.string_fold(df, ts).collect()}
    want = dictionary(rows, ts)
    assert got == want and len(want) > 30
    assert folds.string_fold(df.limit(0)).count() == 0


def test_elements_equal_sets(spark):
    g = random.Random(5)
    rows, s, z, h = [], {}, {}, {}
    for seq in range(4000):
        key, el = f"k{int(g.random() ** 3 * 9)}", f"m{g.randrange(30)}"
        cmd = g.choices(("ADD", "REM", "BY", "DEL", "FLUSHDB"), (50, 20, 20, 0.5, 0.1))[0]
        score = g.choice((1.5, 2.0, float("nan"), None))
        rows.append((seq, cmd, key, el, score, str(g.randrange(9)) if g.random() < 0.9 else "x", g.randrange(-3, 9)))
        value, delta = rows[-1][5], rows[-1][6]
        for d in (s, z, h):
            if cmd == "FLUSHDB":
                d.clear()
            elif cmd == "DEL":
                d.pop(key, None)
            elif cmd == "REM":
                d.get(key, {}).pop(el, None)
        if cmd == "ADD":
            s.setdefault(key, {})[el] = None
            if score is not None and score == score:
                z.setdefault(key, {})[el] = score
            h.setdefault(key, {})[el] = value
        elif cmd == "BY" and (old := h.get(key, {}).get(el, "0")) != "x":
            h.setdefault(key, {})[el] = str(int(old) + delta)
    df = spark.createDataFrame(rows, "seq bigint, cmd string, key string, member string, score double, value string, delta bigint")

    def log(add, rem, by=None):
        names = F.create_map(*[F.lit(x) for pair in {"ADD": add, "REM": rem, "BY": by or "OTHER", "DEL": "DEL", "FLUSHDB": "FLUSHDB"}.items() for x in pair])
        return df.withColumn("cmd", names[F.col("cmd")]).withColumn("key", F.when(F.col("cmd") != "FLUSHDB", F.col("key")))

    flat = lambda d: {(k, m, *([v] if v is not None else [])) for k, ms in d.items() for m, v in ms.items()}
    assert {tuple(r) for r in folds.set_fold(log("SADD", "SREM")).collect()} == flat(s)
    assert {tuple(r) for r in folds.zset_fold(log("ZADD", "ZREM")).collect()} == flat(z)
    got = folds.hash_fold(log("HSET", "HDEL", "HINCRBY").withColumnRenamed("member", "field")).collect()
    assert {(r.key, r.field, r.value) for r in got} == flat(h)


def test_single_folds_take_what_stands_before(spark):
    rows = [(1, "SET", "a", "x", None), (2, "APPEND", "a", "y", None), (3, "SET", "b", "s", None), (4, "SETNX", "b", "n", None), (5, "INCRBY", "c", None, 5), (6, "DEL", "c", None, None), (7, "INCRBY", "c", None, 1), (8, "SET", "d", "x", None), (9, "INCRBY", "d", None, 1), (10, "SETNX", "e", "n", None), (11, "SETNX", "e", "m", None)]
    df = spark.createDataFrame(rows, "seq bigint, cmd string, key string, value string, delta bigint")
    assert {r.key: r.value for r in keyspace.fold_append(df).collect()}["a"] == "xy"
    assert {r.key: r.value for r in keyspace.fold_setnx(df).collect()} == {"a": "x", "b": "s", "d": "x", "e": "n"}
    got = {r.key: (r.value, r.error is None) for r in keyspace.fold_counter(df).collect()}
    assert got["c"] == ("1", True) and got["d"] == ("x", False) and got["a"] == ("x", True)


def test_running_values_of_a_hot_key(spark):
    g = random.Random(3)
    rows = [("hot", i, i * 7 % 11 if g.random() < 0.3 else None) for i in range(4000)] + [(f"k{i % 40}", i, i) for i in range(200)] + [(None, i, i) for i in range(3)]
    df = spark.createDataFrame(rows, "key string, at bigint, v bigint").repartition(6)
    got = running(df, ["key"], ["at"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v"))}).collect()
    want, state = {}, {}
    for key, at, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        s, m, last = state.get(key, (0, None, None))
        want[key, at] = (s + (v or 0), m, last)
        state[key] = (s + (v or 0), v if m is None else m if v is None else max(m, v), last if v is None else v)
    assert {(r.key, r.at): (r.s, r.m, r.l) for r in got} == want


def test_group_reads_from_cursors(spark):
    stream = spark.createDataFrame([(k, ms, 0) for k, n in (("a", 30), ("b", 3)) for ms in range(1, n + 1)], "key string, ms bigint, seq bigint")
    table = spark.createDataFrame([("a", "g", 10, 0), ("b", "g", 3, 0), ("a", "h", 0, 0), ("none", "g", 0, 0)], "key string, grp string, last_ms bigint, last_seq bigint")
    calls = spark.createDataFrame([(1, "g", "x", 4, 100, False), (2, "g", "y", 3, 200, True), (3, "g", "x", None, 300, False), (4, "g", "y", 5, 400, False), (1, "h", "z", 2, 100, False), (9, "nogroup", "z", 2, 100, False)], "call_seq bigint, grp string, consumer string, cnt bigint, ts_ms bigint, noack boolean")
    got = streams.deliver(stream, calls, table)
    by = {}
    for r in got.collect():
        by.setdefault((r.key, r.grp, r.call_seq), []).append(r.ms)
    assert {k: sorted(v) for k, v in by.items()} == {("a", "g", 1): [11, 12, 13, 14], ("a", "g", 2): [15, 16, 17], ("a", "g", 3): list(range(18, 31)), ("a", "h", 1): [1, 2]}
    moved = {(r.key, r.grp): r.last_ms for r in streams.moved_cursors(table, got).collect()}
    assert moved == {("a", "g"): 30, ("b", "g"): 3, ("a", "h"): 2, ("none", "g"): 0}
    pel = streams.pending_after(got, calls.filter("grp = 'g'"))
    assert sorted(r.ms for r in pel.filter("grp = 'g'").collect()) == [11, 12, 13, 14, *range(18, 31)]
    assert {(r.consumer, r.pending) for r in streams.pending_by_consumer(pel.filter("grp = 'g'")).collect()} == {("x", 17)}
    seen = calls.withColumn("key", F.lit("a")).withColumnRenamed("ts_ms", "seen_ms")
    info = {(r.grp, r.consumer): (r.pending, r.idle_ms) for r in streams.consumers(pel, 1000, seen).collect()}
    assert info["g", "y"] == (0, 600) and info["g", "x"] == (17, 700)
    assert streams.deliver(stream, calls.filter("call_seq = 3"), groups.create(table.limit(0), stream.select("key").distinct().selectExpr("key", "'g' AS grp", "CAST(NULL AS BIGINT) AS ms", "CAST(NULL AS BIGINT) AS seq"), stream)[0]).count() == 0


def test_transactions(spark):
    rows = [(1, "a", "WATCH", "k"), (2, "a", "MULTI", None), (3, "a", "SET", "x"), (4, "a", "MULTI", None), (5, "b", "SET", "k"), (6, "a", "SET", "y"), (7, "a", "EXEC", None), (8, "a", "WATCH", "k"), (9, "a", "MULTI", None), (10, "a", "SET", "z"), (11, "a", "EXEC", None), (12, "a", "SET", "w"), (13, "c", "MULTI", None), (14, "c", "SET", "v"), (15, "c", "DISCARD", None), (16, "d", "MULTI", None), (17, "d", "SET", "u")]
    ops = spark.createDataFrame(rows, "seq bigint, conn string, cmd string, key string")
    writes = ops.filter("seq = 5").select("key", "seq")
    got = {r.seq: (r.tx, r.exec_seq) for r in keyspace.transactions(ops, writes).filter("cmd = 'SET'").collect()}
    assert got == {3: (2, None), 5: (None, 5), 6: (2, None), 10: (9, 11), 12: (None, 12), 14: (13, None), 17: (16, None)}
    assert {r.seq: r.exec_seq for r in keyspace.transactions(ops).filter("seq in (3, 6)").collect()} == {3: 7, 6: 7}


def test_path_globs_guard_keys(spark):
    users = spark.createDataFrame([("u", True, False, False, ["user:?", "a*b", "~c[0-9]", "pre/*", "open[", "tail\\"])], "user string, enabled boolean, is_admin boolean, read_only boolean, patterns array<string>")
    keys = {"user:1": True, "user:12": False, "axb": True, "a/b": False, "c5": True, "cx": False, "pre/x": True, "pre/x/y": True, "open[": False, "tail": False}
    df = spark.createDataFrame([("u", "GET", [k]) for k in keys], "user string, cmd string, keys array<string>")
    assert {r["keys"][0]: r.deny_reason is None for r in keyspace.deny_reason(df, users).collect()} == keys


def test_small_reads(spark):
    h = spark.createDataFrame([("a", "f", "1"), ("a", "g", "1")], "key string, field string, value string")
    assert sorted(map(tuple, coll.hkeys(h).collect())) == [("a", "f"), ("a", "g")] and coll.hvals(h).count() == 2
    z = spark.createDataFrame([("z", "m", 1.0)], "key string, member string, score double")
    ask = spark.createDataFrame([("z", "m"), ("z", "n")], "key string, member string")
    assert {r.member: r.score for r in coll.zscore(ask, z).collect()} == {"m": 1.0, "n": None}
    assert spark.range(1).select(expr.fnv1a(F.lit("a")).alias("x"), expr.fnv1a(F.lit("foobar")).alias("y")).first() == (0xE40C292C, 0xBF9CF968)
    live = spark.createDataFrame([("a", 5), ("ab", 0), ("b", 0)], "key string, expires_at_ms bigint")
    assert {r.key for r in keyspace.scan(live, "a*", now_ms=9).collect()} == {"ab"}
    assert keyspace.evict(live.withColumn("last_accessed_ms", F.length("key")), 1).count() == 2


@pytest.mark.parametrize("seed", range(2))
def test_added_ids_equal_a_walk(spark, seed):
    g = random.Random(seed)
    rows, now = [], 0
    for i in range(1500):
        now += g.random() < 0.1
        kind = g.random()
        ms = None if kind < 0.5 else max(0, now + g.randrange(-1, 2))
        rows.append((f"k{int(g.random() ** 4 * 4)}", i, now, ms, g.randrange(12) if ms is not None and kind > 0.75 else None))
    ends = {"k0": (3, 7), "k9": (1, 1)}
    want, at = {}, dict(ends)
    for key, i, now, ms, seq in rows:
        lm, ls = at.get(key, (-1, -1))
        if ms is None:
            new = (now, 0) if now > lm else (lm, ls + 1)
        else:
            new = (ms, seq) if seq is not None else (ms, 0) if ms > lm else (ms, ls + 1)
            new = new if new > (lm, ls) and ms >= lm else None
        want[i] = new
        at[key] = new or at.get(key, (-1, -1))
    df = spark.createDataFrame(rows, "key string, arrival bigint, now_ms bigint, ms bigint, seq bigint").repartition(3)
    last = spark.createDataFrame([(k, *v) for k, v in ends.items()], "key string, last_ms bigint, last_seq bigint")
    got = {r.arrival: None if r.id_seq is None else (r.id_ms, r.id_seq) for r in streams.xadd(df, last).collect()}
    assert got == want and sum(v is None for v in want.values()) > 50


def test_maxlen_keeps_the_newest_of_its_time(spark):
    g = random.Random(1)
    rows = [("s", i, 0, g.choice((None, None, 5, 9, 0))) for i in range(40)] + [("t", 1, 0, None)]
    held = []
    for _, ms, _, n in rows[:-1]:
        held = [*held, ms]
        held = held if n is None else held[len(held) - min(n, len(held)) :]
    got = streams.trimmed(spark.createDataFrame(rows, "key string, ms bigint, seq bigint, maxlen bigint")).collect()
    assert sorted(r.ms for r in got if r.key == "s") == held and sum(r.key == "t" for r in got) == 1
