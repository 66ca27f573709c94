"""The registered queries of the key-value, stream and vector operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelstone.functions import expr
from keelstone.operators import cluster, folds, groups, keyspace, streams, vectors
from keelstone.operators import collections as coll
from keelstone.plans import state

NOW = 1_710_000_000_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# SQL fragments
_KEYS = """keys AS (SELECT 'customer:' || c_custkey AS key, 'string' AS type FROM customer
  UNION ALL SELECT 'nation/' || n_nationkey, 'set' FROM nation
  UNION ALL SELECT 'part:{' || p_brand || '}:' || p_partkey, 'hash' FROM part)"""
_EXP = """exp AS (SELECT 'order:' || o_orderkey AS key, CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE epoch_us(o_orderdate) // 1000 + 90 * CAST(86400000 AS BIGINT) END AS expires_at_ms FROM orders)"""
_OPS = """ops AS (SELECT event_id AS seq, epoch_us(ts) // 1000 AS ts_ms, 'user:' || user_id AS key, event_type AS value, event_id % 7 AS delta, event_id % 5 AS kind FROM events)"""
_HASHES = """hashes AS (SELECT 'customer:' || c_custkey AS key, unnest(['name', 'segment', 'nation']) AS field, unnest([c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR)]) AS value, c_custkey FROM customer)"""
_SETS = """sets AS (SELECT DISTINCT 'nation:' || c_nationkey AS key, c_mktsegment AS member FROM customer)"""
_ZSETS = """zsets AS (SELECT c_mktsegment AS key, c_name AS member, c_acctbal AS score FROM customer)"""
_LISTS = """lists AS (SELECT l_orderkey AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS idx, l_partkey AS value FROM lineitem)"""
_STREAM = """stream AS (SELECT event_type AS key, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY event_type, epoch_us(ts) // 1000 ORDER BY event_id) - 1 AS seq, event_id, user_id FROM events)"""
_CALLS = f"""calls AS (SELECT id AS call_seq, 'g' || (id % 2) AS grp, 'c' || (id % 3) AS consumer, id % 7 + 1 AS cnt, id * 1000 + 1704067200000 AS ts_ms FROM (SELECT DISTINCT user_id AS id FROM events)),
  grps AS (SELECT DISTINCT key, 'g0' AS grp, CAST(0 AS BIGINT) AS last_ms, CAST(0 AS BIGINT) AS last_seq FROM stream UNION ALL SELECT DISTINCT key, 'g1', {state.GROUP_START}, 0 FROM stream),
  spans AS (SELECT *, CAST(sum(cnt) OVER (PARTITION BY grp ORDER BY call_seq) AS BIGINT) AS hi FROM calls),
  ranked AS (SELECT s.*, grp, row_number() OVER (PARTITION BY s.key, grp ORDER BY ms, seq) AS rn FROM stream s JOIN grps USING (key) WHERE ms > last_ms OR ms = last_ms AND seq > last_seq),
  pel AS (SELECT key, ms, seq, ranked.grp, consumer, call_seq, ts_ms AS delivery_ms, CAST(1 AS BIGINT) AS delivery_count FROM ranked JOIN spans ON ranked.grp = spans.grp AND rn > hi - cnt AND rn <= hi)"""


def _mod(c: str, n: int, r: int = 0):
    return F.col(c) % n == r


# ---- strings and keys ----


@query("SELECT pos, 'customer:' || want AS key, c_name AS value FROM (SELECT c_custkey AS pos, c_custkey * 2 AS want FROM customer) LEFT JOIN customer ON c_custkey = want")
def get_mget(spark, d):
    s = state.strings(spark, d)
    req = s.select(F.col("c_custkey").alias("pos"), F.concat(F.lit("customer:"), (F.col("c_custkey") * 2).cast("string")).alias("key"))
    return keyspace.mget(req, s)


@query("SELECT count(*) AS n FROM (SELECT c_custkey * 3 AS want FROM customer) WHERE want IN (SELECT c_custkey FROM customer)")
def exists(spark, d):
    s = state.strings(spark, d)
    return keyspace.exists(s.select(F.concat(F.lit("customer:"), (F.col("c_custkey") * 3).cast("string")).alias("key")), s)


@query(f"WITH {_KEYS}, req AS (SELECT DISTINCT key FROM keys UNION SELECT 'absent:' || n_nationkey FROM nation) SELECT req.key, coalesce(type, 'none') AS type FROM req LEFT JOIN keys USING (key)")
def type_of(spark, d):
    k = state.keys(spark, d)
    absent = state.table(spark, d, "nation").select(F.concat(F.lit("absent:"), F.col("n_nationkey").cast("string")).alias("key"))
    return keyspace.type_of(k.select("key").union(absent).distinct(), k)


@query("SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes FROM documents")
def strlen(spark, d):
    return keyspace.strlen(state.table(spark, d, "documents").select("doc_id", F.col("text").alias("value")))


@query(f"WITH {_KEYS} SELECT * FROM keys WHERE regexp_matches(key, '^customer:1[^/]$') OR starts_with(key, 'nation/')")
def keys_glob(spark, d):
    k = state.keys(spark, d)
    return keyspace.scan(k, "customer:1?", False).union(keyspace.scan(k, "nation*"))


@query(f"WITH {_EXP} SELECT key, 'string' AS type, CASE WHEN expires_at_ms = 0 THEN -1 WHEN expires_at_ms <= {NOW} THEN -2 ELSE (expires_at_ms - {NOW}) // 1000 END AS ttl, CAST(1 AS BIGINT) AS size, CAST(0 AS BIGINT) AS updated_at_ms FROM exp WHERE regexp_matches(key, '^order:[^/]*5$') ORDER BY key LIMIT 50")
def key_metas(spark, d):
    e = state.expiring(spark, d).withColumns({"type": F.lit("string"), "updated_at_ms": F.lit(0).cast("bigint")})
    return keyspace.metas(e, e.select("key", F.lit(1).alias("size")), NOW, "order:*5", 50)


@query(f"WITH {_KEYS} SELECT type, count(*) AS n FROM keys GROUP BY type")
def dbsize(spark, d):
    return keyspace.sizes_by_type(state.keys(spark, d))


@query(f"WITH {_OPS} SELECT key, arg_max(value, seq) AS value FROM ops GROUP BY key")
def set_lww(spark, d):
    return keyspace.fold_set(state.ops(spark, d).withColumn("cmd", F.lit("SET")))


@query(f"""WITH {_OPS}, half AS (SELECT * FROM ops WHERE seq > (SELECT max(seq) FROM ops) // 2)
SELECT key, coalesce(arg_max(value, seq) FILTER (WHERE seq % 29 = 0), arg_min(value, seq)) AS value FROM half GROUP BY key""")
def setnx_fold(spark, d):
    """Every event a SETNX but for some SETs; a flush half way."""
    o = state.ops(spark, d)
    half = o.agg(F.floor(F.max("seq") / 2).alias("seq")).select("seq", F.lit("FLUSHALL").alias("cmd"))
    return keyspace.fold_setnx(o.withColumn("cmd", F.when(_mod("seq", 29), "SET").otherwise("SETNX")).unionByName(half, allowMissingColumns=True))


_MIXED = "CASE WHEN seq % 23 = 0 THEN 'DEL' WHEN seq % 13 = 0 THEN 'SET' ELSE 'ADD' END"
_BEGUN = f"""o AS (SELECT *, {_MIXED} AS cmd FROM ops), b AS (SELECT key, coalesce(max(seq) FILTER (WHERE cmd <> 'ADD'), -1) AS start FROM o GROUP BY key),
  live AS (SELECT o.* FROM o JOIN b USING (key) WHERE seq >= start AND cmd <> 'DEL')"""


def _mixed(o, add: str):
    """Every event as a DEL, a SET or an addition."""
    return o.withColumn("cmd", F.when(_mod("seq", 23), "DEL").when(_mod("seq", 13), "SET").otherwise(add))


@query(f"WITH {_OPS}, {_BEGUN} SELECT key, CAST(sum(delta) AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS error FROM live GROUP BY key")
def incr_fold(spark, d):
    return keyspace.fold_counter(_mixed(state.ops(spark, d), "INCRBY").withColumn("value", F.col("delta").cast("string")))


@query(f"WITH {_OPS}, {_BEGUN} SELECT key, string_agg(value, '' ORDER BY seq) AS value, CAST(strlen(string_agg(value, '' ORDER BY seq)) AS BIGINT) AS bytes FROM live GROUP BY key")
def append_fold(spark, d):
    return keyspace.fold_append(_mixed(state.ops(spark, d), "APPEND"))


def _log(spark, d):
    """Every event as one of the string commands, the whole mix of them."""
    o, k = state.ops(spark, d), F.col("seq") % 16
    cmd = F.element_at(F.array(*[F.lit(c) for c in _COMMANDS]), (k + 1).cast("int"))
    ttl = F.when(k == 1, (F.col("seq") % 5 - 1) * 86_400_000).when(k.isin(5, 6, 9, 10), (F.col("seq") % 9) * 43_200_000)
    text = F.when(F.col("seq") % 3 == 0, F.col("value")).otherwise(F.col("delta").cast("string"))
    return o.select("seq", "ts_ms", cmd.alias("cmd"), "key", text.alias("value"), F.when(k.isin(8, 12), F.col("delta") * 3).alias("delta"), ttl.alias("ttl_ms"), F.when(k == 2, "NX").when(k == 3, "XX").alias("cond"))


_COMMANDS = ("SET", "SET", "SET", "SET", "SETNX", "SETEX", "PSETEX", "INCR", "INCRBY", "EXPIRE", "PEXPIRE", "DECR", "DECRBY", "APPEND", "PERSIST", "DEL")
# one step a row over each key's operations, by a recursive table: here (is there a value), v and e (its expiry) after the row
_FOLD = f"""WITH RECURSIVE {_OPS}, log AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY seq) AS i, count(*) OVER (PARTITION BY key) AS n, ts_ms AS t, seq % 16 AS k,
    CASE WHEN seq % 3 = 0 THEN value ELSE CAST(delta AS VARCHAR) END AS x, delta * 3 AS d,
    CASE WHEN seq % 16 = 1 THEN (seq % 5 - 1) * CAST(86400000 AS BIGINT) WHEN seq % 16 IN (5, 6, 9, 10) THEN (seq % 9) * CAST(43200000 AS BIGINT) END AS ttl FROM ops),
walk(key, i, v, e) AS (
  SELECT DISTINCT key, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT) FROM log
  UNION ALL
  SELECT key, i,
    CASE WHEN k = 15 THEN NULL
      WHEN k IN (0, 1, 5, 6) AND coalesce(ttl, 1) > 0 OR k IN (2, 4) AND v IS NULL OR k = 3 AND v IS NOT NULL THEN x
      WHEN k IN (7, 8, 11, 12) AND (v IS NULL OR regexp_full_match(v, '[+-]?[0-9]+') AND TRY_CAST(v AS BIGINT) IS NOT NULL) THEN CAST(coalesce(TRY_CAST(v AS BIGINT), 0) + CASE k WHEN 7 THEN 1 WHEN 8 THEN d WHEN 11 THEN -1 ELSE -d END AS VARCHAR)
      WHEN k = 13 THEN coalesce(v, '') || x ELSE v END,
    CASE WHEN k = 15 THEN 0
      WHEN k IN (0, 1, 5, 6) AND coalesce(ttl, 1) > 0 OR k IN (2, 4) AND v IS NULL OR k = 3 AND v IS NOT NULL THEN CASE WHEN ttl IS NULL THEN 0 ELSE t + ttl END
      WHEN k IN (9, 10) AND v IS NOT NULL THEN greatest(t + ttl, 1) WHEN k = 14 THEN 0 ELSE e END
  FROM (SELECT l.*, CASE WHEN w.e > 0 AND w.e <= l.t THEN NULL ELSE w.v END AS v, CASE WHEN w.e > 0 AND w.e <= l.t THEN 0 ELSE w.e END AS e FROM walk w JOIN log l ON l.key = w.key AND l.i = w.i + 1))
SELECT key, v AS value, e AS expires_at_ms FROM walk JOIN (SELECT key, max(i) AS i FROM log GROUP BY key) USING (key, i) WHERE v IS NOT NULL AND (e = 0 OR e > {{now}})"""


@query(_FOLD.format(now=1_706_000_000_000))
def string_fold(spark, d):
    return folds.string_fold(_log(spark, d), 1_706_000_000_000)


_ELEMENTS = "o AS (SELECT event_id AS seq, 'type:' || event_type AS key, user_id % 40 AS el, event_id % 7 AS k, value, event_id % 11 AS delta FROM events), live AS (SELECT * FROM o WHERE seq > coalesce((SELECT max(r.seq) FROM o r WHERE r.key = o.key AND r.seq % 331 = 0), -1))"


def _element_log(spark, d, write: str, remove: str, name: str):
    """Every event as a write, a removal or a DEL of its type's key."""
    e, k = state.table(spark, d, "events"), F.col("event_id") % 7
    cmd = F.when(F.col("event_id") % 331 == 0, "DEL").when(k < 2, remove).otherwise(write)
    return e.select(F.col("event_id").alias("seq"), cmd.alias("cmd"), F.concat(F.lit("type:"), F.col("event_type")).alias("key"), (F.col("user_id") % 40).cast("string").alias(name), "value", (F.col("event_id") % 11).alias("delta"))


@query(f"WITH {_ELEMENTS} SELECT key, CAST(el AS VARCHAR) AS member FROM live GROUP BY ALL HAVING arg_max(k, seq) >= 2")
def set_fold(spark, d):
    return folds.set_fold(_element_log(spark, d, "SADD", "SREM", "member"))


@query(f"WITH {_ELEMENTS} SELECT key, CAST(el AS VARCHAR) AS member, arg_max(value, seq) AS score FROM live WHERE k < 2 OR value IS NOT NULL GROUP BY key, el HAVING arg_max(k, seq) >= 2")
def zset_fold(spark, d):
    return folds.zset_fold(_element_log(spark, d, "ZADD", "ZREM", "member").withColumnRenamed("value", "score"))


@query(f"""WITH {_ELEMENTS}, b AS (SELECT key, el, max(seq) FILTER (WHERE k < 4) AS base FROM live GROUP BY ALL)
SELECT key, CAST(el AS VARCHAR) AS field, CASE WHEN count(*) FILTER (WHERE k >= 4) > 0 THEN CAST(coalesce(sum(delta) FILTER (WHERE seq > coalesce(base, -1) OR k >= 2), 0) AS VARCHAR) ELSE CAST(any_value(delta) AS VARCHAR) END AS value, CAST(NULL AS VARCHAR) AS error
FROM live JOIN b USING (key, el) WHERE seq >= coalesce(base, -1) GROUP BY key, el HAVING count(*) FILTER (WHERE k >= 2) > 0""")
def hash_fold(spark, d):
    log = _element_log(spark, d, "HSET", "HDEL", "field")
    cmd = F.when((F.col("cmd") == "HSET") & (F.col("seq") % 7 >= 4), "HINCRBY").otherwise(F.col("cmd"))
    return folds.hash_fold(log.withColumn("cmd", cmd).withColumn("value", F.col("delta").cast("string")))


@query(f"""WITH {_OPS}, last AS (SELECT key, max(seq) FILTER (WHERE kind = 4) AS gone FROM ops GROUP BY key)
SELECT key, arg_max(value, seq) AS value FROM ops JOIN last USING (key) WHERE kind <> 4 AND seq > coalesce(gone, -1) GROUP BY key""")
def del_fold(spark, d):
    return keyspace.fold_set(state.ops(spark, d).withColumn("cmd", F.when(F.col("kind") == 4, "DEL").otherwise("SET")))


@query("""SELECT key, value FROM (SELECT 'c:' || (c_custkey % 100) AS key, 'a' || c_custkey AS value, c_custkey * 2 AS s FROM customer
UNION ALL SELECT 'n:' || c_nationkey, 'b' || c_custkey, c_custkey * 2 + 1 FROM customer) QUALIFY row_number() OVER (PARTITION BY key ORDER BY s DESC) = 1""")
def mset_fold(spark, d):
    s = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in c])
    c = F.col("c_custkey")
    cmds = state.table(spark, d, "customer").select(c.alias("seq"), F.array(s("c:", c % 100), s("a", c), s("n:", F.col("c_nationkey")), s("b", c)).alias("args"))
    return keyspace.mset_ops(cmds).groupBy("key").agg(F.max_by("value", "seq").alias("value"))


@query(f"WITH {_EXP} SELECT key, CASE WHEN expires_at_ms = 0 THEN -1 WHEN expires_at_ms <= {NOW} THEN -2 ELSE (expires_at_ms - {NOW}) // 1000 END AS ttl, CASE WHEN expires_at_ms = 0 THEN -1 WHEN expires_at_ms <= {NOW} THEN -2 ELSE expires_at_ms - {NOW} END AS pttl FROM exp")
def ttl_at(spark, d):
    e = F.col("expires_at_ms")
    return state.expiring(spark, d).select("key", expr.ttl(e, NOW).alias("ttl"), expr.pttl(e, NOW).alias("pttl"))


@query(f"WITH {_EXP} SELECT key, expires_at_ms FROM exp WHERE expires_at_ms = 0 OR expires_at_ms > {NOW}")
def live_filter(spark, d):
    return keyspace.live(state.expiring(spark, d), NOW)


@query(f"WITH {_OPS} SELECT key, arg_max(CASE WHEN kind = 2 THEN greatest(ts_ms + delta * 1000, 1) ELSE 0 END, seq) AS expires_at_ms FROM ops GROUP BY key")
def persist_fold(spark, d):
    o = state.ops(spark, d)
    return keyspace.fold_expiry(o.withColumn("cmd", F.when(F.col("kind") == 2, "PEXPIRE").when(F.col("kind") == 3, "PERSIST").otherwise("SET")).withColumn("ttl_ms", F.col("delta") * 1000))


@query("SELECT user_id, last FROM (SELECT user_id, max(epoch_us(ts) // 1000) AS last FROM events GROUP BY user_id) ORDER BY last, 'user:' || user_id LIMIT 20")
def evict_lru(spark, d):
    used = state.table(spark, d, "events").groupBy("user_id").agg(F.max(expr.epoch_ms(F.col("ts"))).alias("last_accessed_ms")).withColumn("key", F.concat(F.lit("user:"), F.col("user_id").cast("string")))
    return keyspace.victims(used, 20).select("user_id", F.col("last_accessed_ms").alias("last"))


# ---- hashes ----


@query(f"WITH {_HASHES} SELECT key, max(value) FILTER (WHERE field = 'name') AS name, max(value) FILTER (WHERE field = 'nation') AS nation, max(value) FILTER (WHERE field = 'segment') AS segment FROM hashes GROUP BY key")
def hgetall(spark, d):
    f = F.col("fields")
    return coll.hgetall(state.hashes(spark, d).drop("c_custkey")).select("key", f["name"].alias("name"), f["nation"].alias("nation"), f["segment"].alias("segment"))


@query(f"WITH {_HASHES}, req AS (SELECT c_custkey AS pos, 'customer:' || c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN 'segment' ELSE 'absent' END AS field FROM customer) SELECT req.pos, req.key, req.field, value FROM req LEFT JOIN hashes USING (key, field)")
def hget_join(spark, d):
    h = state.hashes(spark, d)
    req = state.strings(spark, d).select(F.col("c_custkey").alias("pos"), "key", F.when(_mod("c_custkey", 2), "segment").otherwise("absent").alias("field"))
    return coll.hget(req, h.select("key", "field", "value"))


@query(f"WITH {_HASHES}, req AS (SELECT 'customer:' || c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN 'name' ELSE 'absent' END AS field FROM customer) SELECT req.key, req.field, CAST(CASE WHEN value IS NULL THEN 0 ELSE 1 END AS BIGINT) AS found FROM req LEFT JOIN hashes USING (key, field)")
def hexists(spark, d):
    req = state.strings(spark, d).select("key", F.when(_mod("c_custkey", 3), "name").otherwise("absent").alias("field"))
    return coll.present(req, state.hashes(spark, d), ["key", "field"])


@query("SELECT 'user:' || user_id AS key, event_type AS field, CAST(sum(event_id % 7) AS BIGINT) + CASE WHEN event_type = 'click' THEN 100 ELSE 0 END AS value, CAST(NULL AS VARCHAR) AS error FROM events GROUP BY user_id, event_type")
def hincrby(spark, d):
    o = state.ops(spark, d)
    base = o.filter("event_type = 'click'").select("key", F.col("event_type").alias("field"), F.lit("100").alias("value")).distinct()
    return coll.hincrby(base, o.select("key", F.col("event_type").alias("field"), "delta"))


@query(f"WITH {_HASHES} SELECT key, count(*) AS n FROM hashes WHERE NOT (field = 'nation' AND c_custkey % 2 = 0) GROUP BY key")
def hlen(spark, d):
    h = state.hashes(spark, d)
    return coll.cardinality(coll.remove(h, h.filter("field = 'nation' and c_custkey % 2 = 0"), ["key", "field"]))


@query(f"WITH {_HASHES} SELECT key, count(*) AS removed FROM hashes WHERE field = 'nation' AND c_custkey % 2 = 0 GROUP BY key")
def hdel(spark, d):
    h = state.hashes(spark, d)
    return coll.removed(h, h.filter("field = 'nation' and c_custkey % 2 = 0"), ["key", "field"])


@query("SELECT 'user:' || user_id AS key, event_type AS field, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def hset_fold(spark, d):
    e = state.table(spark, d, "events")
    return coll.hset(e.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), F.col("event_type").alias("field"), "value", F.col("event_id").alias("seq")))


# ---- lists ----


def _lists(spark, d):
    li = state.table(spark, d, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return li.select(F.col("l_orderkey").alias("key"), (F.row_number().over(w) - 1).cast("bigint").alias("idx"), F.col("l_partkey").alias("value"))


@query(f"WITH {_LISTS} SELECT key, idx, value FROM lists QUALIFY idx >= greatest(count(*) OVER (PARTITION BY key) - 2, 0)")
def lrange(spark, d):
    return coll.lrange(_lists(spark, d), -2, -1)


@query(f"WITH {_LISTS} SELECT key, idx, value FROM lists WHERE idx = 1")
def lindex(spark, d):
    return coll.lindex(_lists(spark, d), 1)


@query(f"WITH {_LISTS} SELECT key, count(*) AS n FROM lists GROUP BY key")
def llen(spark, d):
    return coll.cardinality(_lists(spark, d))


@query("""SELECT 'user:' || user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3 <> 0, CASE WHEN event_id % 3 = 0 THEN -event_id ELSE event_id END) - 1 AS idx, event_type AS value FROM events""")
def lpush_order(spark, d):
    o = state.ops(spark, d)
    return coll.pushed(o.select("key", "seq", F.lit(0).alias("pos"), F.when(_mod("seq", 3), "LPUSH").otherwise("RPUSH").alias("cmd"), "value"))


@query("""WITH r AS (SELECT 'user:' || user_id AS key, event_type AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT key, p - 2 AS idx, value FROM r WHERE p >= 2 AND p < n - 1""")
def lpop_rpop(spark, d):
    o = state.ops(spark, d)
    none = F.lit(None)
    push = o.select("key", "seq", F.lit(0).alias("pos"), F.lit("RPUSH").alias("cmd"), "value", none.cast("bigint").alias("count"))
    far = 1 << 60
    pops = o.select("key").distinct().select("key", F.explode(F.array(F.struct(F.lit(far).alias("seq"), F.lit("LPOP").alias("cmd"), F.lit(2).cast("bigint").alias("count")), F.struct(F.lit(far + 1).alias("seq"), F.lit("RPOP").alias("cmd"), none.cast("bigint").alias("count")))).alias("c"))
    return coll.replay_lists(push.union(pops.select("key", "c.seq", F.lit(0).alias("pos"), "c.cmd", none.cast("string").alias("value"), "c.count")))


# ---- sets ----


@query(f"WITH {_SETS} SELECT key, member FROM sets")
def smembers(spark, d):
    c = state.table(spark, d, "customer")
    return coll.members(c.select(F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("key"), F.col("c_mktsegment").alias("member")))


@query(f"WITH {_SETS}, req AS (SELECT 'nation:' || n_nationkey AS key, 'BUILDING' AS member FROM nation) SELECT req.key, req.member, CAST(CASE WHEN s.key IS NULL THEN 0 ELSE 1 END AS BIGINT) AS found FROM req LEFT JOIN sets s USING (key, member)")
def sismember(spark, d):
    req = state.table(spark, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("key"), F.lit("BUILDING").alias("member"))
    return coll.present(req, state.sets(spark, d), ["key", "member"])


@query(f"WITH {_SETS} SELECT key, count(*) AS n FROM sets GROUP BY key")
def scard(spark, d):
    return coll.cardinality(state.sets(spark, d))


@query(f"WITH {_SETS} SELECT key, member FROM sets WHERE member <> 'BUILDING'")
def srem(spark, d):
    s = state.sets(spark, d)
    return coll.remove(s, s.filter("member = 'BUILDING'"), ["key", "member"])


# ---- sorted sets ----


@query(f"WITH {_ZSETS} SELECT key, member, score, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank FROM zsets")
def zrank(spark, d):
    return coll.zrank(state.zsets(spark, d))


@query(f"WITH {_ZSETS} SELECT key, member, score, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank FROM zsets QUALIFY rank BETWEEN 2 AND 11")
def zrange(spark, d):
    return coll.zrange(state.zsets(spark, d), 2, 11)


@query(f"WITH {_ZSETS} SELECT key, member, score, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rank FROM zsets QUALIFY rank >= count(*) OVER (PARTITION BY key) - 5")
def zrevrange(spark, d):
    return coll.zrange(state.zsets(spark, d), -5, -1, reverse=True)


@query(f"WITH {_ZSETS}, req AS (SELECT c_mktsegment AS key, c_name AS member FROM customer UNION ALL SELECT 'BUILDING', 'absent:' || c_custkey FROM customer) SELECT req.key, req.member, score FROM req LEFT JOIN zsets USING (key, member)")
def zscore(spark, d):
    """Every customer is asked for, and as many members that are not there."""
    c = state.table(spark, d, "customer")
    req = c.select(F.col("c_mktsegment").alias("key"), F.col("c_name").alias("member")).union(c.select(F.lit("BUILDING"), F.concat(F.lit("absent:"), F.col("c_custkey").cast("string"))))
    return coll.zscore(req, state.zsets(spark, d))


@query(f"WITH {_ZSETS} SELECT key, count(*) AS n FROM zsets GROUP BY key")
def zcard(spark, d):
    return coll.cardinality(state.zsets(spark, d))


@query("SELECT c_mktsegment AS key, c_name AS member, c_acctbal AS score FROM customer WHERE c_custkey % 4 <> 0")
def zrem(spark, d):
    gone = state.table(spark, d, "customer").filter("c_custkey % 4 = 0").select(F.col("c_mktsegment").alias("key"), F.col("c_name").alias("member"))
    return coll.remove(state.zsets(spark, d), gone, ["key", "member"])


@query("SELECT event_type AS key, 'user:' || user_id AS member, arg_max(value, event_id) AS score FROM events WHERE value IS NOT NULL GROUP BY event_type, user_id")
def zadd_upsert(spark, d):
    e = state.table(spark, d, "events").select(F.col("event_type").alias("key"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("member"), F.col("value").alias("score"), F.col("event_id").alias("seq"))
    return coll.zadd(e.select("key", "member", "score").limit(0), e)


# ---- streams ----

LO, HI = (1_704_500_000_000, 0), (1_705_500_000_000, 0)


@query(f"WITH {_STREAM} SELECT key, ms, seq, event_id FROM stream")
def xadd_ids(spark, d):
    return state.stream(spark, d).select("key", "ms", "seq", "event_id")


# one step a row again: the last id after each add
_XADD = """WITH RECURSIVE a AS (SELECT event_type AS key, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, epoch_us(ts) // 3600000000 AS now,
    CASE WHEN event_id % 5 < 3 THEN NULL WHEN event_id % 5 = 3 THEN epoch_us(ts) // 3600000000 - event_id % 2 ELSE epoch_us(ts) // 3600000000 END AS ms, CASE WHEN event_id % 5 = 4 THEN event_id % 9 END AS seq FROM events),
w(key, i, lm, ls, im, iq, event_id) AS (
  SELECT DISTINCT key, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM a
  UNION ALL
  SELECT key, i, coalesce(im, lm), CASE WHEN im IS NULL THEN ls ELSE iq END, im, iq, event_id FROM (
    SELECT a.key, a.i, lm, ls, a.event_id, CASE WHEN a.ms IS NULL THEN greatest(a.now, lm) WHEN a.ms > lm OR a.ms = lm AND (a.seq IS NULL OR a.seq > ls) THEN a.ms END AS im,
      CASE WHEN a.ms IS NULL THEN CASE WHEN a.now > lm THEN 0 ELSE ls + 1 END WHEN a.seq IS NOT NULL THEN a.seq WHEN a.ms > lm THEN 0 ELSE ls + 1 END AS iq FROM w JOIN a ON a.key = w.key AND a.i = w.i + 1))
"""


def _adds(spark, d):
    """Every event as an add: of `*`, of `ms-*` an hour early or not, or of a whole id; in hours, so that many share one."""
    k, hour = F.col("event_id") % 5, F.floor(expr.epoch_ms(F.col("ts")) / 3_600_000).cast("bigint")
    ms = F.when(k == 3, hour - F.col("event_id") % 2).when(k == 4, hour)
    return state.table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("arrival"), hour.alias("now_ms"), ms.alias("ms"), F.when(k == 4, F.col("event_id") % 9).alias("seq"))


@query(_XADD + "SELECT event_id, key, im AS id_ms, CASE WHEN im IS NOT NULL THEN iq END AS id_seq FROM w WHERE i > 0")
def xadd(spark, d):
    return streams.xadd(_adds(spark, d)).select(F.col("arrival").alias("event_id"), "key", "id_ms", "id_seq")


@query(_XADD + """, e AS (SELECT key, event_id, im, iq, row_number() OVER (PARTITION BY key ORDER BY im, iq) AS rn FROM w WHERE i > 0 AND im IS NOT NULL),
c AS (SELECT key, max(rn - 50 - event_id % 20) AS cut FROM e WHERE event_id % 4 = 0 GROUP BY key)
SELECT key, event_id, im AS ms, iq AS seq FROM e LEFT JOIN c USING (key) WHERE rn > coalesce(cut, 0)""")
def xadd_maxlen(spark, d):
    """As xadd, where every fourth add keeps 50 to 69 entries."""
    got = streams.xadd(_adds(spark, d)).filter("id_seq is not null")
    entries = got.select("key", F.col("arrival").alias("event_id"), F.col("id_ms").alias("ms"), F.col("id_seq").alias("seq"), F.when(_mod("arrival", 4), 50 + F.col("arrival") % 20).alias("maxlen"))
    return streams.trimmed(entries).drop("maxlen")


@query(f"WITH {_STREAM} SELECT key, count(*) AS n FROM stream GROUP BY key")
def xlen(spark, d):
    return coll.cardinality(state.stream(spark, d))


@query(f"WITH {_STREAM} SELECT key, ms, seq, event_id, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS rn FROM stream WHERE ms >= {LO[0]} AND (ms < {HI[0]} OR ms = {HI[0]} AND seq <= 0) QUALIFY rn <= 25")
def xrange(spark, d):
    return streams.xrange(state.stream(spark, d).drop("user_id"), LO, HI, 25)


@query(f"WITH {_STREAM} SELECT key, ms, seq, event_id, row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) AS rn FROM stream WHERE ms >= {LO[0]} QUALIFY rn <= 10")
def xrevrange(spark, d):
    return streams.xrange(state.stream(spark, d).drop("user_id"), LO, None, 10, reverse=True)


@query(f"WITH {_STREAM} SELECT key, ms, seq, event_id, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS rn FROM stream WHERE ms > {LO[0]} OR ms = {LO[0]} AND seq > 0 QUALIFY rn <= 5")
def xread(spark, d):
    s = state.stream(spark, d).drop("user_id")
    cursors = s.select("key").distinct().withColumns({"after_ms": F.lit(LO[0]), "after_seq": F.lit(LO[1])})
    return streams.xread(s, cursors, 5)


@query(f"WITH {_STREAM} SELECT key, ms, seq, event_id FROM stream WHERE event_id % 3 <> 0")
def xdel(spark, d):
    s = state.stream(spark, d).drop("user_id")
    return streams.xdel(s, s.filter("event_id % 3 = 0").select("key", "ms", "seq"))


@query(f"WITH {_STREAM} SELECT key, ms, seq, event_id FROM stream QUALIFY row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) <= 100")
def xtrim(spark, d):
    return streams.xtrim(state.stream(spark, d).drop("user_id"), 100)


@query(f"WITH {_STREAM} SELECT key, count(*) AS length, min((ms, seq))[1] AS first_ms, min((ms, seq))[2] AS first_seq, max((ms, seq))[1] AS last_ms, max((ms, seq))[2] AS last_seq FROM stream GROUP BY key")
def xinfo_stream(spark, d):
    return streams.xinfo(state.stream(spark, d))


@query(f"WITH {_STREAM}, {_CALLS} SELECT * FROM pel")
def xreadgroup(spark, d):
    return state.pending(spark, d)


@query(f"WITH {_STREAM}, {_CALLS} SELECT key, grp, count(*) AS pending, min((ms, seq))[1] AS min_ms, min((ms, seq))[2] AS min_seq, max((ms, seq))[1] AS max_ms, max((ms, seq))[2] AS max_seq, count(DISTINCT consumer) AS consumers FROM pel GROUP BY key, grp")
def xpending_summary(spark, d):
    return streams.pending_summary(state.pending(spark, d))


@query(f"WITH {_STREAM}, {_CALLS} SELECT key, grp, ms, seq, consumer, {NOW} - delivery_ms AS idle_ms, delivery_count FROM pel WHERE consumer = 'c1' QUALIFY row_number() OVER (PARTITION BY key, grp ORDER BY ms, seq) <= 10")
def xpending_detail(spark, d):
    return streams.pending_detail(state.pending(spark, d), NOW, 0, 10, "c1")


@query(f"WITH {_STREAM}, {_CALLS} SELECT * FROM pel WHERE ms % 2 = 0")
def xack(spark, d):
    p = state.pending(spark, d)
    return streams.ack(p, p.filter("ms % 2 = 1").select("key", "grp", "ms", "seq"))


@query(f"WITH {_STREAM}, {_CALLS} SELECT key, ms, seq, grp, consumer, call_seq, {NOW} AS delivery_ms, CAST(2 AS BIGINT) AS delivery_count FROM pel WHERE grp = 'g0' AND consumer = 'c2' AND ms % 3 <> 0")
def xreadgroup_replay(spark, d):
    s = state.stream(spark, d)
    return streams.replay(state.pending(spark, d), s.filter("ms % 3 <> 0"), "g0", "c2", (0, 0), NOW)


@query(f"WITH {_STREAM}, {_CALLS} SELECT key, grp, consumer, count(*) AS pending, {NOW} - max(delivery_ms) AS idle_ms FROM pel GROUP BY key, grp, consumer")
def xinfo_consumers(spark, d):
    return streams.consumers(state.pending(spark, d), NOW)


def _groups(spark, d):
    return state.stream(spark, d).select("key").distinct().select("key", F.lit("g0").alias("grp"), F.lit(0).cast("bigint").alias("last_ms"), F.lit(0).cast("bigint").alias("last_seq"))


@query(f"WITH {_STREAM}, last AS (SELECT key, max((ms, seq)) AS b FROM stream GROUP BY key) SELECT key, 'g0' AS grp, CAST(0 AS BIGINT) AS last_ms, CAST(0 AS BIGINT) AS last_seq FROM last UNION ALL SELECT key, 'g1', b[1], b[2] FROM last")
def xgroup_create(spark, d):
    s = state.stream(spark, d)
    ask = s.select("key").distinct().select("key", F.explode(F.array(F.lit("g0"), F.lit("g1"))).alias("grp"), F.lit(None).cast("bigint").alias("ms"), F.lit(None).cast("bigint").alias("seq"))
    return groups.create(_groups(spark, d), ask, s)[0]


@query(f"WITH {_STREAM} SELECT DISTINCT key, 'g0' AS grp, CAST(CASE WHEN key = 'click' THEN 77 ELSE 0 END AS BIGINT) AS last_ms, CAST(CASE WHEN key = 'click' THEN 5 ELSE 0 END AS BIGINT) AS last_seq FROM stream")
def xgroup_setid(spark, d):
    g = _groups(spark, d)
    return groups.set_id(g, g.filter("key = 'click'").select("key", "grp", F.lit(77).cast("bigint").alias("ms"), F.lit(5).cast("bigint").alias("seq")), state.stream(spark, d))


@query(f"WITH {_STREAM}, {_CALLS} SELECT key, grp, consumer, count(*) AS pending FROM pel WHERE consumer = 'c1' GROUP BY ALL")
def xgroup_delconsumer(spark, d):
    p = state.pending(spark, d)
    return groups.delete_consumer(p, p.filter("consumer = 'c1'"))[1]


@query(f"WITH {_STREAM} SELECT key, count(*) AS length, min((ms, seq))[1] AS first_ms, min((ms, seq))[2] AS first_seq, max((ms, seq))[1] AS last_ms, max((ms, seq))[2] AS last_seq, CAST(1 AS BIGINT) AS groups FROM stream GROUP BY key")
def stream_directory(spark, d):
    return groups.directory(state.stream(spark, d), _groups(spark, d))


@query(f"""WITH {_STREAM}, {_CALLS}, n AS (SELECT key, grp, count(DISTINCT consumer) AS consumers, count(*) AS pending, max((ms, seq)) AS b FROM pel GROUP BY ALL)
SELECT key, grp, coalesce(consumers, 0) AS consumers, coalesce(pending, 0) AS pending, CASE WHEN b IS NULL THEN last_ms ELSE b[1] END AS last_ms, CASE WHEN b IS NULL THEN last_seq ELSE b[2] END AS last_seq FROM grps LEFT JOIN n USING (key, grp)""")
def xinfo_groups(spark, d):
    """Every group with the cursor that the schedule has moved."""
    p = state.pending(spark, d)
    return groups.info(streams.moved_cursors(state.groups(spark, d), p), p)


@query(f"WITH {_STREAM}, {_CALLS} SELECT key, grp, consumer, count(*) AS pending FROM pel WHERE call_seq % 5 <> 0 GROUP BY ALL")
def xpending_consumers(spark, d):
    """Pending entries by consumer where every fifth call reads without acknowledgement."""
    p = state.pending(spark, d)
    return streams.pending_by_consumer(streams.pending_after(p, state.calls(spark, d).select("call_seq", (F.col("call_seq") % 5 == 0).alias("noack"))))


_SUBS = "subs AS (SELECT n_name AS subscriber, (['click', 'view', 'purchase'])[n_nationkey % 3 + 1] AS channel FROM nation)"


def _subs(spark, d):
    return state.table(spark, d, "nation").select(F.col("n_name").alias("subscriber"), F.get(F.array(F.lit("click"), F.lit("view"), F.lit("purchase")), F.col("n_nationkey") % 3).alias("channel"))


@query(f"WITH {_SUBS} SELECT event_id, event_type AS channel, (SELECT count(DISTINCT subscriber) FROM subs WHERE channel = event_type) AS delivered FROM events")
def publish_fanout(spark, d):
    return streams.publish(state.table(spark, d, "events").select("event_id", F.col("event_type").alias("channel")), _subs(spark, d))


@query(f"WITH {_SUBS} SELECT channel, count(DISTINCT subscriber) AS subscribers FROM subs GROUP BY channel")
def active_channels(spark, d):
    return streams.channels(_subs(spark, d))


# ---- vectors ----


def _search(spark, d, metric):
    v = state.vectors(spark, d)
    q = v.filter("id % 50 = 0").select(F.col("id").alias("qid"), "vec")
    return vectors.search(v, q, 10, metric).select("qid", "id", F.round("score", 6).alias("score"), "rank")


def _search_sql(score: str, order: str) -> str:
    return f"WITH s AS (SELECT q.vec_id AS qid, v.vec_id AS id, {score} AS raw FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0) SELECT qid, id, round(raw, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY raw {order}, id) AS rank FROM s QUALIFY rank <= 10"


_A, _B = "CAST(q.embedding AS DOUBLE[])", "CAST(v.embedding AS DOUBLE[])"


@query(_search_sql(f"list_cosine_similarity({_A}, {_B})", "DESC"))
def vsearch_cosine(spark, d):
    return _search(spark, d, "cosine")


@query(_search_sql(f"list_distance({_A}, {_B})", "ASC"))
def vsearch_l2(spark, d):
    return _search(spark, d, "l2")


@query(_search_sql(f"list_inner_product({_A}, {_B})", "DESC"))
def vsearch_dot(spark, d):
    return _search(spark, d, "dot")


@query(f"SELECT 'embeddings' AS key, q.vec_id AS id1, v.vec_id AS id2, round(list_cosine_similarity({_A}, {_B}), 6) AS cosine, round(list_distance({_A}, {_B}), 6) AS l2 FROM embeddings q JOIN embeddings v ON v.vec_id = q.vec_id + 1")
def vsim_pairs(spark, d):
    v = state.vectors(spark, d).select("key", "id", "vec")
    w = v.select("key", F.col("id").alias("id1"), (F.col("id") + 1).alias("id2"))
    both = vectors.pairs(v, w, "cosine").withColumnRenamed("score", "cosine").join(vectors.pairs(v, w, "l2").withColumnRenamed("score", "l2"), ["key", "id1", "id2"])
    return both.select("key", "id1", "id2", F.round("cosine", 6).alias("cosine"), F.round("l2", 6).alias("l2"))


@query("SELECT 'label:' || label AS key, max(len(embedding)) AS dimension, count(*) AS count FROM embeddings GROUP BY label")
def vinfo(spark, d):
    return vectors.facts(state.vectors(spark, d).withColumn("key", F.concat(F.lit("label:"), F.col("label").cast("string"))))


@query("SELECT vec_id AS id, round(CAST(embedding[1] AS DOUBLE) + CASE WHEN vec_id % 4 = 0 THEN 1 ELSE 0 END, 5) AS head FROM embeddings WHERE vec_id % 9 <> 0")
def vadd_vdel(spark, d):
    v = state.vectors(spark, d).select("key", "id", "vec")
    bump = F.transform("vec", lambda x, i: F.when(i == 0, x + 1).otherwise(x).cast("float"))
    changes = v.filter("id % 4 = 0").select("key", "id", bump.alias("vec"), F.lit(1).cast("bigint").alias("seq")).union(v.filter("id % 6 = 0").select("key", "id", F.slice("vec", 1, 3), F.lit(2).cast("bigint")))
    return vectors.delete(vectors.upsert(v, changes), v.filter("id % 9 = 0").select("key", "id")).select("id", F.round(F.get("vec", F.lit(0)).cast("double"), 5).alias("head"))


@query()
def vsearch_approximate(spark, d):
    v = state.vectors(spark, d)
    return vectors.search_cells(v, v.filter("id % 50 = 0").select(F.col("id").alias("qid"), "vec"), 10, vectors.fit_cells(v))


# ---- slots, access, telemetry, transactions ----

_CRC = "list_reduce(list_prepend(0, list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, CAST(i AS INTEGER), 1)))), lambda c, b: list_reduce(list_prepend(xor(c, b << 8), range(8)), lambda r, i: CASE WHEN r & 32768 > 0 THEN xor(r << 1, 4129) & 65535 ELSE (r << 1) & 65535 END))"
_SLOTS = f"{_KEYS}, tagged AS (SELECT key, coalesce(nullif(regexp_extract(key, '^[^{{]*\\{{([^}}]+)\\}}', 1), ''), key) AS k FROM keys), slots AS (SELECT key, CAST({_CRC} & 16383 AS INTEGER) AS slot FROM tagged)"


@query(f"WITH {_SLOTS} SELECT key, slot FROM slots")
def keyslot(spark, d):
    return cluster.slotted(state.keys(spark, d).select("key"))


@query(f"WITH {_SLOTS} SELECT slot, count(*) AS n FROM slots GROUP BY slot")
def slot_counts(spark, d):
    return cluster.count_by_slot(state.keys(spark, d))


@query("""WITH own AS (SELECT slot, slot * 7 // 16384 AS o FROM range(16384) t(slot) WHERE slot % 1000 <> 3),
isl AS (SELECT o, slot, slot - row_number() OVER (PARTITION BY o ORDER BY slot) AS g FROM own),
r AS (SELECT o, min(slot) AS a, max(slot) AS b FROM isl GROUP BY o, g)
SELECT 'n' || o AS owner, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ' ' ORDER BY a) AS slots, CAST(sum(b - a + 1) AS BIGINT) AS n FROM r GROUP BY o""")
def slot_ranges(spark, d):
    own = spark.range(16384).filter("id % 1000 <> 3").select(F.col("id").cast("int").alias("slot"), F.concat(F.lit("n"), F.floor(F.col("id") * 7 / 16384).cast("string")).alias("owner"))
    return cluster.slot_text(own)


@query("SELECT CAST(slot AS INTEGER) AS slot, CAST(CASE WHEN slot < 4 * 3277 THEN slot // 3277 ELSE 4 + (slot - 4 * 3277) // 3276 END AS INTEGER) AS owner FROM range(16384) t(slot)")
def slot_partition(spark, d):
    return cluster.partition_slots(spark, 5)


@query("""WITH own AS (SELECT slot, 'n' || CASE WHEN slot < 5462 THEN 0 WHEN slot < 10923 THEN 1 ELSE 2 END AS source FROM range(16384) t(slot)),
give AS (SELECT slot, source, row_number() OVER (PARTITION BY source ORDER BY slot DESC) AS r FROM own),
spare AS (SELECT slot, source, row_number() OVER (ORDER BY source, slot) AS i FROM give WHERE r <= CASE source WHEN 'n0' THEN 1366 ELSE 1365 END)
SELECT CAST(slot AS INTEGER) AS slot, source, 'n3' AS target FROM spare""")
def rebalance_plan(spark, d):
    own = spark.range(16384).select(F.col("id").cast("int").alias("slot"), F.when(F.col("id") < 5462, "n0").when(F.col("id") < 10923, "n1").otherwise("n2").alias("owner"))
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(4)], "owner string")
    return cluster.rebalance(own, nodes)


@query(f"WITH {_SLOTS} SELECT key AS id, slot, CASE WHEN slot >= 16000 THEN 'CLUSTERDOWN' WHEN slot >= 8192 THEN 'MOVED ' || slot || ' b' END AS error FROM slots")
def routing_guard(spark, d):
    own = spark.range(16000).select(F.col("id").cast("int").alias("slot"), F.when(F.col("id") < 8192, "a").otherwise("b").alias("owner"))
    return cluster.route(state.keys(spark, d).select(F.col("key").alias("id"), F.array("key").alias("keys")), own, "a")


@query("""SELECT event_id AS id, CASE WHEN user_id % 4 = 3 THEN 'disabled' WHEN event_type = 'purchase' AND user_id % 4 = 1 THEN 'readonly' WHEN user_id % 4 = 2 AND NOT (user_id BETWEEN 20 AND 29 OR user_id % 10 = 2 AND user_id BETWEEN 10 AND 99 OR user_id BETWEEN 100 AND 199) THEN 'key' END AS deny_reason FROM events""")
def acl_filter(spark, d):
    users = spark.createDataFrame([("0", True, False, False, ["*"]), ("1", True, False, True, ["~*"]), ("2", True, False, False, ["user:?2", "~user:2[0-9]", "user:1??", "user:*/x", "other/*"]), ("3", False, True, False, ["*"])], "user string, enabled boolean, is_admin boolean, read_only boolean, patterns array<string>")
    e = state.table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 4).cast("string").alias("user"), F.when(F.col("event_type") == "purchase", "SET").otherwise("GET").alias("cmd"), F.array(F.concat(F.lit("user:"), F.col("user_id").cast("string"))).alias("keys"))
    return keyspace.deny_reason(e, users).select("id", "deny_reason")


@query("SELECT event_id AS id, CASE WHEN event_type = 'purchase' THEN 'READONLY' END AS error FROM events")
def readonly_guard(spark, d):
    e = state.table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "purchase", "setex").otherwise("get").alias("cmd"))
    return e.select("id", F.when(keyspace.is_write(F.col("cmd")), "READONLY").alias("error"))


@query("SELECT event_id AS id, unnest(CASE event_id % 5 WHEN 0 THEN ['a' || event_id, 'b' || event_id] WHEN 1 THEN ['a' || event_id] WHEN 2 THEN ['k' || event_id] WHEN 3 THEN ['s' || event_id, 't'] ELSE ['s' || event_id] END) AS key FROM events")
def command_keys(spark, d):
    i = F.col("event_id").cast("string")
    of = lambda *xs: F.array(*[F.concat(F.lit(x[:-1]), i) if x.endswith("#") else F.lit(x) for x in xs])
    forms = (("MGET", of("a#", "b#")), ("MSET", of("a#", "b#")), ("EVAL", of("script", "1", "k#", "arg")), ("XREAD", of("COUNT", "2", "streams", "s#", "t", "0", "0-1")), ("XREADGROUP", of("GROUP", "STREAMS", "c", "NOACK", "STREAMS", "s#", ">")))
    k = (F.col("event_id") % 5 + 1).cast("int")
    cmd, args = F.element_at(F.array(*[F.lit(c) for c, _ in forms]), k), F.element_at(F.array(*[a for _, a in forms]), k)
    return state.table(spark, d, "events").select(F.col("event_id").alias("id"), F.explode(keyspace.command_keys(cmd, args)).alias("key"))


@query("SELECT event_type AS cmd, count(*) AS calls, round(avg(value), 6) AS avg_dur FROM events GROUP BY event_type")
def cmd_stats(spark, d):
    return streams.command_stats(state.commands(spark, d)).withColumn("avg_dur", F.round("avg_dur", 6))


@query("SELECT cmd, min(dur) AS p99 FROM (SELECT event_type AS cmd, value AS dur, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE r >= floor((n - 1) * 0.99) GROUP BY cmd")
def latency_p99(spark, d):
    return streams.p99(state.commands(spark, d))


@query("SELECT date_trunc('second', ts) AS second, count(*) AS ops FROM events GROUP BY 1")
def ops_per_sec(spark, d):
    return streams.per_second(state.commands(spark, d))


@query("SELECT event_id AS id, event_type AS cmd, value AS dur FROM events WHERE value >= 50 ORDER BY ts DESC, event_id DESC LIMIT 128")
def slowlog(spark, d):
    return streams.slowlog(state.commands(spark, d), 50).select("id", "cmd", "dur")


_TX = """e AS (SELECT event_id AS seq, user_id AS conn, event_type AS key, event_id % 11 AS k FROM events),
m AS (SELECT *, CASE k WHEN 0 THEN 'MULTI' WHEN 3 THEN 'WATCH' WHEN 5 THEN 'EXEC' WHEN 8 THEN 'DISCARD' ELSE 'SET' END AS cmd FROM e),
g AS (SELECT *, coalesce(max(CASE WHEN cmd IN ('EXEC', 'DISCARD') THEN seq END) OVER (PARTITION BY conn ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS seg FROM m),
f AS (SELECT conn, seg, min(seq) FILTER (WHERE cmd = 'MULTI') AS multi, max(seq) FILTER (WHERE cmd = 'EXEC') AS ex FROM g GROUP BY ALL)"""


def _connections(spark, d):
    """Every event as one connection's command on its type's key."""
    k = F.col("event_id") % 11
    return state.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("conn"), F.col("event_type").alias("key"), F.when(k == 0, "MULTI").when(k == 3, "WATCH").when(k == 5, "EXEC").when(k == 8, "DISCARD").otherwise("SET").alias("cmd"))


@query(f"""WITH {_TX} SELECT seq, conn, CASE WHEN multi < seq THEN multi END AS tx, CASE WHEN multi IS NULL OR multi >= seq THEN seq ELSE ex END AS exec_seq FROM g JOIN f USING (conn, seg) WHERE cmd = 'SET'""")
def multi_exec(spark, d):
    return keyspace.transactions(_connections(spark, d).drop("key")).filter("cmd = 'SET'").select("seq", "conn", "tx", "exec_seq")


@query(f"""WITH {_TX}, w AS (SELECT multi AS tx, g.key, g.seq AS ws, ex FROM g JOIN f USING (conn, seg) WHERE g.cmd = 'WATCH' AND multi IS NOT NULL AND ex IS NOT NULL),
gone AS (SELECT DISTINCT w.tx FROM w JOIN m ON m.key = w.key AND m.cmd = 'SET' AND m.seq % 13 = 0 AND m.seq > ws AND m.seq < w.ex)
SELECT seq, multi AS tx, CASE WHEN multi IN (SELECT tx FROM gone) THEN NULL ELSE ex END AS exec_seq FROM g JOIN f USING (conn, seg) WHERE cmd = 'SET' AND multi < seq""")
def multi_watch(spark, d):
    """Transactions and whether watched keys, that some of the SETs write, stop them."""
    o = _connections(spark, d)
    writes = o.filter("cmd = 'SET' and seq % 13 = 0").select("key", "seq")
    return keyspace.transactions(o, writes).filter("cmd = 'SET' and tx is not null").select("seq", "tx", "exec_seq")


@query("""WITH w AS (SELECT event_id AS tx, user_id AS key, event_id AS ws, event_id + 50 AS es FROM events)
SELECT DISTINCT tx FROM w JOIN events e ON e.user_id = w.key AND e.event_id > ws AND e.event_id < es WHERE e.event_type = 'purchase'""")
def watch_aborts(spark, d):
    """Every event watches its user's key and executes 50 events later; purchases write."""
    e = state.table(spark, d, "events")
    watches = e.select(F.col("event_id").alias("tx"), F.col("user_id").alias("key"), F.col("event_id").alias("watch_seq"), (F.col("event_id") + 50).alias("exec_seq"))
    return keyspace.aborted(watches, e.filter("event_type = 'purchase'").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq")))


@query(f"WITH {_HASHES} SELECT key, field FROM hashes")
def hkeys(spark, d):
    return coll.hkeys(state.hashes(spark, d))


@query(f"WITH {_HASHES} SELECT key, value FROM hashes")
def hvals(spark, d):
    return coll.hvals(state.hashes(spark, d))


@query(f"WITH {_SLOTS} SELECT key FROM slots WHERE slot = 12182 ORDER BY key LIMIT 20")
def keys_in_slot(spark, d):
    return cluster.keys_in_slot(state.keys(spark, d), 12182, 20)


@query()
def vsearch_approximate_l2(spark, d):
    v = state.vectors(spark, d)
    return vectors.search_cells(v, v.filter("id % 50 = 0").select(F.col("id").alias("qid"), "vec"), 10, vectors.fit_cells(v, metric="l2"))


@query()
def vsearch_approximate_dot(spark, d):
    v = state.vectors(spark, d)
    return vectors.search_cells(v, v.filter("id % 50 = 0").select(F.col("id").alias("qid"), "vec"), 10, vectors.fit_cells(v, metric="dot"))
