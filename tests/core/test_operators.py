import random
import struct

import pytest
from pyspark.sql import functions as F

from keelstone.functions import expr, scripts
from keelstone.functions.ranking import ranks
from keelstone.operators import cluster, keyspace, streams, vectors
from keelstone.operators import collections as coll
from keelstone.plans import state
from keelstone.sources import aof, dump, snapshot
from keelstone.streaming import live


def test_slots_and_tags(spark):
    tags = {"user1000": "user1000", "{user1000}": "user1000", "{user1000}:profile": "user1000", "user1000:{profile}": "profile", "{user1000}:foo:{bar}": "user1000", "user:{}1000": "user:{}1000", "foo{{bar}}": "{bar"}
    df = spark.createDataFrame(list(tags.items()), "key string, tag string")
    assert df.filter(expr.hash_tag(F.col("key")) != F.col("tag")).count() == 0
    one = spark.range(1).select(expr.crc16(F.lit("123456789")).alias("a"), expr.crc16(F.lit("")).alias("b"), expr.key_slot(F.lit("foo")).alias("c")).first()
    assert (one.a, one.b, one.c) == (0x31C3, 0, 12182)
    assert snapshot.crc64(b"123456789") == 0xCF228CF2176E85ED


@pytest.mark.parametrize(("pattern", "fallback", "want"), [("*", True, ["a/b", "ab", "abc", "b"]), ("a*", False, ["ab", "abc"]), ("a*", True, ["a/b", "ab", "abc"]), ("a?", True, ["ab"]), ("[^a]*", False, ["b"]), ("[a-b]b", True, ["ab"]), ("a\\b", True, ["ab"])])
def test_globs(spark, pattern, fallback, want):
    df = spark.createDataFrame([("ab",), ("abc",), ("a/b",), ("b",)], "key string")
    assert sorted(r.key for r in keyspace.scan(df, pattern, fallback).collect()) == want


def test_ttl(spark):
    df = spark.createDataFrame([(None,), (0,), (5,), (12_999,), (10_000,)], "e bigint")
    assert [tuple(r) for r in df.select(expr.ttl(F.col("e"), 10_000), expr.pttl(F.col("e"), 10_000)).collect()] == [(-2, -2), (-1, -1), (-2, -2), (2, 2999), (-2, -2)]


def test_stream_ids(spark):
    df = spark.createDataFrame([("5",), ("18446744073709551615-3",), ("x-1",), (None,)], "t string")
    got = [r[0] for r in df.select(expr.stream_id(F.col("t"))).collect()]
    assert (int(got[0].ms), int(got[0].seq)) == (5, 0) and int(got[1].ms) == 2**64 - 1 and got[2] is None and got[3] is None


def test_ranks_of_a_hot_key(spark):
    rows = [("hot", i * 7919 % 3000) for i in range(3000)] + [(f"k{i}", i) for i in range(50)] + [(None, 3), (None, 1)]
    got = ranks(spark.createDataFrame(rows, "key string, v bigint").repartition(7), ["key"], [F.col("v")]).collect()
    assert all(r["rank"] == r.v + 1 for r in got if r.key == "hot") and sorted(r["rank"] for r in got if r.key is None) == [1, 2] and len(got) == len(rows)


def test_stored_tables_are_cleaned(spark):
    import os

    from keelstone.session import clean, shared_dir, stored

    clean(spark)
    df = stored(spark.range(5), "five")
    here = shared_dir(spark).removeprefix("file:")
    assert df.count() == 5 and any(x.startswith("five-") for x in os.listdir(here))
    assert clean(spark) == 1 and not any(x.startswith("five-") for x in os.listdir(here))


def test_counter_errors(spark):
    rows = [(1, "SET", "a", "x", None), (2, "INCRBY", "a", None, 1), (1, "SET", "b", str(2**63 - 1), None), (2, "INCRBY", "b", None, 1), (1, "SET", "c", "x", None), (1, "INCRBY", "d", None, 41), (2, "INCRBY", "d", None, 1)]
    got = {r.key: (r.value, r.error is None) for r in keyspace.fold_counter(spark.createDataFrame(rows, "seq bigint, cmd string, key string, value string, delta bigint")).collect()}
    assert got == {"a": ("x", False), "b": (str(2**63 - 1), False), "c": ("x", True), "d": ("42", True)}


def test_list_replay_equals_a_deque(spark):
    g = random.Random(4)
    rows, want = [], {}
    for seq in range(600):
        key, cmd = f"k{g.randrange(5)}", g.choice(["LPUSH", "RPUSH", "RPUSH", "LPOP", "RPOP"])
        n = g.choice([None, 0, 2]) if "POP" in cmd else None
        rows.append((key, seq, 0, cmd, f"v{seq}", n))
        held = want.setdefault(key, [])
        if cmd == "LPUSH":
            held.insert(0, f"v{seq}")
        elif cmd == "RPUSH":
            held.append(f"v{seq}")
        else:
            for _ in range(1 if n is None else n):
                if held:
                    held.pop(0 if cmd == "LPOP" else -1)
    df = spark.createDataFrame(rows, "key string, seq bigint, pos bigint, cmd string, value string, count bigint")
    got: dict[str, list] = {}
    for r in coll.replay_lists(df).orderBy("key", "idx").collect():
        got.setdefault(r.key, []).append(r.value)
    assert got == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize(("start", "stop"), [(0, -1), (1, 2), (-2, -1), (2, -2), (5, 9), (-9, 0)])
def test_ranges_equal_slices(spark, start, stop):
    sizes = {"a": 1, "b": 4, "c": 6}
    rows = [(k, i, f"{k}{i}") for k, n in sizes.items() for i in range(n)]
    want = sorted(v for k, n in sizes.items() for v in [f"{k}{i}" for i in range(n)][max(0, start + n if start < 0 else start) : (stop + n if stop < 0 else stop) + 1])
    lists = spark.createDataFrame(rows, "key string, idx bigint, value string")
    assert sorted(r.value for r in coll.lrange(lists, start, stop).collect()) == want
    z = lists.select("key", F.col("value").alias("member"), F.col("idx").cast("double").alias("score"))
    assert sorted(r.member for r in coll.zrange(z, start, stop).collect()) == want


def test_refused_stream_ids(spark):
    df = spark.createDataFrame([("s", 1, 5, 0), ("s", 2, 5, 1), ("s", 3, 4, 9), ("s", 4, 5, 1), ("s", 5, 6, 0)], "key string, arrival bigint, ms bigint, seq bigint")
    assert sorted(r.arrival for r in streams.refused(df).collect()) == [3, 4]


def test_vector_kernels(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.9, 0.1, 0.0]), (4, [0.0, 0.0, 0.0]), (5, [1.0]), (6, None)]
    v = spark.createDataFrame(rows, "id bigint, vec array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.0])], "qid bigint, vec array<float>")
    assert [r.id for r in vectors.search(v, q, 2).orderBy("rank").collect()] == [1, 3]
    assert [r.id for r in vectors.search(v, q, 9, "l2").orderBy("rank").collect()] == [1, 3, 4, 2]
    assert vectors.search(v, q.limit(0), 2).count() == 0 and vectors.search(v.limit(0), q, 2).count() == 0
    assert {r.id: r.score for r in vectors.search(v, q, 9).collect()}[4] == 0.0


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_approximate_search_recalls(spark, metric):
    """Recall of 0.9 or more against exact search over all rows, for vectors of one length and of many."""
    v = state.vectors(spark, "/root/testdata/sf0.1")
    for rows in (v, v.withColumn("vec", F.transform("vec", lambda x: (x * (1 + F.col("id") % 5)).cast("float")))):
        q = rows.filter("id % 50 = 0").select(F.col("id").alias("qid"), "vec")
        found = vectors.search_cells(rows, q, 10, vectors.fit_cells(rows, metric=metric), probes=16)
        assert vectors.recall(found, vectors.search(rows, q, 10, metric)).first().recall >= 0.9


def test_searches_take_any_vectors(spark):
    """Ragged, null and empty tables: each query meets the vectors of its dimension."""
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.5, 0.5]), (4, [1.0]), (5, None), (6, []), (7, [None, 1.0])]
    v = spark.createDataFrame(rows, "id bigint, vec array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0]), (2, [1.0, 2.0, 3.0]), (3, None)], "qid bigint, vec array<float>")
    assert {(r.qid, r.id) for r in vectors.search(v, q, 2).collect()} == {(0, 1), (0, 3), (1, 4)}
    for metric in ("cosine", "l2", "dot"):
        index = vectors.fit_cells(v, 2, metric=metric)
        assert {(r.qid, r.id) for r in vectors.search_cells(v, q, 2, index).collect()} == {(0, 1), (0, 3)}
        none = vectors.fit_cells(v.limit(0), metric=metric)
        assert vectors.search_cells(v.limit(0), q, 2, none).count() == 0 and vectors.search_cells(v, q, 2, none).count() == 0


def test_rebalance_and_ranges(spark):
    own = spark.range(16384).select(F.col("id").cast("int").alias("slot"), F.when(F.col("id") < 5462, "a").when(F.col("id") < 10923, "b").otherwise("c").alias("owner"))
    moves = cluster.rebalance(own, spark.createDataFrame([(x,) for x in "abcd"], "owner string"))
    assert moves.count() == 4096 and {r.target for r in moves.collect()} == {"d"}
    some = spark.createDataFrame([(s, "n") for s in [*range(5461), 6000, 7000, 7001, 7002]], "slot int, owner string")
    assert cluster.slot_text(some).first().slots == "0-5460 6000 7000-7002"


def test_scripts(spark):
    s = scripts.Scripts()
    sha = s.load(lambda spark, keys, args: [keys[0], 2.9, True, None, "after"], "src")
    assert s.run(spark, sha, ["k"]) == ["k", 2, 1] and s.exists(sha, "0" * 40) == [1, 0]
    with pytest.raises(KeyError, match="NOSCRIPT"):
        s.run(spark, "0" * 40)
    s.load_function(spark, "add_two", lambda a, b: a + b)
    assert s.call(spark, "add_two", 100, 250) == 350 and s.list_functions(spark).count() == 1 and s.delete_function(spark, "add_two") == 1
    assert scripts.parse_memory("512mb") == 512 << 20


def test_log_round_trip(spark, tmp_path):
    rows = [(i, "SET", [f"k{i}", 'v "é"\r\n']) for i in range(200)]
    df = spark.createDataFrame(rows, "seq bigint, cmd string, args array<string>")
    aof.write(df, str(tmp_path / "log"))
    got = aof.read(spark, str(tmp_path / "log"), "part-*").collect()
    assert sorted(tuple(r.args) for r in got) == sorted(tuple(a) for _, _, a in rows)
    assert aof.decode(aof.encode([b"A", b"b"]) + b"*1\r\n$5\r\nab") == [[b"A", b"b"]] and aof.tokenize("SET 'a b' \"c\\\"d\"") == ["SET", "a b", 'c"d']


def test_dump_as_commands(spark):
    """A dump's commands make the state again; large keys come in several commands."""
    f = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = aof.dump(
        strings=f([("s", "v")], "key string, value string"),
        hashes=f([("h", f"f{i}", f"v{i}") for i in range(3000)], "key string, field string, value string"),
        lists=f([("l", i, f"e{i}") for i in range(2500)], "key string, idx bigint, value string"),
        sets=f([("m", "x"), ("m", "y")], "key string, member string"),
        zsets=f([("z", "a", 1.5)], "key string, member string, score double"),
        streams=f([("t", 5, 1, [("f", "1"), ("g", "2")]), ("t", 5, 0, [("f", "0")])], "key string, ms bigint, seq bigint, pairs array<struct<name:string,value:string>>"),
        vectors=f([("v", 7, [0.5, 1.0])], "key string, id bigint, vec array<float>"),
        expiring=f([("s", 99), ("h", 0)], "key string, expires_at_ms bigint"),
    ).orderBy("step", "cmd", "at").collect()
    by = {}
    for r in got:
        by.setdefault(r.cmd, []).append(list(r.args))
    assert by["SET"] == [["s", "v"]] and by["PEXPIREAT"] == [["s", "99"]] and got[-1].cmd == "PEXPIREAT" and by["ZADD"] == [["z", "1.5", "a"]] and by["VADD"] == [["v", "7", "0.5", "1.0"]]
    assert by["XADD"] == [["t", "5-0", "f", "0"], ["t", "5-1", "f", "1", "g", "2"]] and sorted(by["SADD"][0][1:]) == ["x", "y"]
    assert len(by["HSET"]) == 3 and {a[i]: a[i + 1] for a in by["HSET"] for i in range(1, len(a), 2)} == {f"f{i}": f"v{i}" for i in range(3000)}
    assert [x for a in by["RPUSH"] for x in a[1:]] == [f"e{i}" for i in range(2500)] and len(by["RPUSH"]) == 3


def test_snapshot_round_trip(spark, tmp_path):
    strings = spark.createDataFrame([("a", "1", 0), ("b", "2", 5)], "key string, value string, expires_at_ms bigint")
    snapshot.save({"strings": strings}, str(tmp_path), 1000, now_ms=10)
    snapshot.save({"strings": strings}, str(tmp_path), 2000)
    assert snapshot.last_save(spark, str(tmp_path)) == 2000
    assert snapshot.load(spark, str(tmp_path), now_ms=10)["strings"].count() == 1


def test_dump_of_all_types(spark, tmp_path):
    """A file laid out by hand is read; what is read is written and read again, damage is refused."""
    t = lambda x: bytes([len(x.encode())]) + x.encode()
    body = b"REDIS0009\xfa" + t("ver") + t("1.0") + b"\xfa" + t("os") + t("x") + b"\xfe\x00\xfb\x08\x02"
    body += b"\xfc" + struct.pack("<Q", 5000) + b"\x00" + t("s") + b"\xc8\x01" + b"v" * 200
    body += b"\x01" + t("l") + b"\x02" + t("a") + t("b") + b"\x02" + t("e") + b"\x01" + t("m") + b"\x04" + t("h") + b"\x01" + t("f") + t("é")
    body += b"\x03" + t("z") + b"\x01" + struct.pack("<d", -1.5) + t("m") + b"\x06" + t("st") + b"\x01" + t("5-0") + b"\x02" + t("f") + t("1") + t("g") + t("2")
    body += b"\xf0" + t("vx") + b"\x02\x01" + t("id") + struct.pack("<2f", 0.5, 2.0) + b"\xfd" + struct.pack("<I", 9) + b"\x00" + t("old") + t("") + b"\xff"
    data = body + struct.pack("<Q", snapshot.crc64(body))
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.rdb").write_bytes(data)
    got = dump.read(spark, str(tmp_path / "a"))
    by = {r.key: r for r in got.collect() if r.key != "l"}
    assert by["s"].value == "v" * 200 and by["s"].expires_at_ms == 5000 and by["old"].expires_at_ms == 9000 and by["z"].score == -1.5 and by["vx"].vec == [0.5, 2.0]
    assert by["h"].value == "é" and [tuple(p) for p in by["st"].pairs] == [("f", "1"), ("g", "2")] and by["st"].field == "5-0" and dump.notes(data) == {"ver": "1.0", "os": "x"}
    assert dump.read(spark, str(tmp_path / "a"), now_ms=6000).filter("key = 's'").count() == 0
    assert dump.write(got, str(tmp_path / "b"), 3, aux={"made": "here"}) >= 1
    again = dump.read(spark, str(tmp_path / "b"), "*.rdb")
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))
    for bad in (data[:40] + b"?" + data[41:], b"NOPE" + data[4:], data[:-9] + data[-8:]):
        with pytest.raises(ValueError):
            list(dump.unpack(bad))
    table = spark.createDataFrame([("k", "f", "v"), ("k", "g", "w"), (None, "f", "v")], "key string, field string, value string")
    assert dump.write(dump.rows_of("hash", table, field="field", value="value"), str(tmp_path / "c")) == 1
    assert sorted((r.key, r.field, r.value) for r in dump.read(spark, str(tmp_path / "c")).collect()) == [("k", "f", "v"), ("k", "g", "w")]


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, i, "SET" if i % 2 else "INCRBY", f"k{i % 3}", str(i)) for i in range(60)]
    df = spark.createDataFrame(rows, live.OPS)
    df.repartition(6).write.parquet(str(tmp_path / "ops"))
    for name, plan in (("sets", live.last_writes), ("sums", live.counters)):
        q = plan(live.tail(spark, str(tmp_path / "ops"), files_a_trigger=2)).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, plan(df).collect()))


def test_live_consumer_groups(spark, tmp_path):
    schema = "key string, grp string, kind string, id bigint, consumer string, cnt int, seq bigint"
    far = 2**53 + 1
    rows = [("s", "g", "add", i, None, None, i) for i in (1, 2, 3, 2)] + [("s", "g", "read", None, "w1", 2, 10), ("s", "g", "read", None, "w2", None, 11), ("s", "g", "ack", 1, None, None, 12), ("s", "g", "ack", 3, None, None, 13), ("s", "g", "replay", 0, "w1", None, 14), ("s", "g", "replay", 0, "w1", None, 15), ("s", "g", "del", 2, None, None, 16), ("s", "g", "replay", 0, "w1", None, 17), ("s", "g", "add", far, None, None, 18), ("s", "g", "read", None, "w2", 5, 19)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "e"))
    q = live.consumer_groups(spark.readStream.schema(schema).parquet(str(tmp_path / "e"))).writeStream.format("memory").queryName("groups").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.id, r.consumer, r.delivery_count) for r in spark.table("groups").collect()) == [(1, "w1", 1), (2, "w1", 1), (2, "w1", 2), (2, "w1", 3), (3, "w2", 1), (far, "w2", 1)]
