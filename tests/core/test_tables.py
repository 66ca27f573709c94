import pytest

from keelstone.functions.acl import Users
from keelstone.operators import groups, keyspace
from keelstone.sources import topology


def test_group_tables(spark):
    stream = spark.createDataFrame([("s", 5, 0), ("s", 5, 1)], "key string, ms bigint, seq bigint")
    none = spark.createDataFrame([], "key string, grp string, last_ms bigint, last_seq bigint")
    ask = spark.createDataFrame([("s", "a", None, None), ("s", "b", 1, 2), ("t", "a", 0, 0)], "key string, grp string, ms bigint, seq bigint")
    table, answers = groups.create(none, ask, stream)
    assert sorted(map(tuple, table.collect())) == [("s", "a", 5, 1), ("s", "b", 1, 2)]
    assert {(r.key, r.grp): r.error for r in answers.collect()}["t", "a"] == "ERR no such key"
    again = groups.create(table, ask, stream, make_stream=True)[1]
    assert {(r.key, r.grp): (r.error or "")[:9] for r in again.collect()} == {("s", "a"): "BUSYGROUP", ("s", "b"): "BUSYGROUP", ("t", "a"): ""}
    pel = spark.createDataFrame([("s", "a", 5, 0, "c"), ("s", "b", 5, 0, "c")], "key string, grp string, ms bigint, seq bigint, consumer string")
    left, pending = groups.destroy(table, pel, table.filter("grp = 'a'"))
    assert left.count() == 1 and pending.count() == 1
    rest, n = groups.delete_consumer(pel, pel.filter("grp = 'b'"))
    assert rest.count() == 1 and n.first().pending == 1


def test_access_rules(spark):
    u = Users()
    u.set_user("alice", "on", ">secret", "+@read", "~cache:*")
    assert u.authenticate("alice", "secret") and not u.authenticate("alice", "no") and u.names() == ["alice", "default"]
    asked = spark.createDataFrame([(1, "alice", "SET", ["cache:test"]), (2, "alice", "GET", ["secret:users"]), (3, "alice", "GET", ["cache:item"]), (4, "nobody", "GET", ["x"]), (5, "default", "FLUSHALL", [])], "id int, user string, cmd string, keys array<string>")
    got = {r.id: r.deny_reason for r in keyspace.deny_reason(asked, u.table(spark)).collect()}
    assert got == {1: "readonly", 2: "key", 3: None, 4: "disabled", 5: None}
    assert u.describe("alice") == "user alice on readonly ~cache:*" and u.delete_user("default", "alice", "x") == 1
    with pytest.raises(ValueError, match="unknown rule"):
        u.set_user("bob", "what")


def test_topology_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "h:1", ["master"], None), ("b", "h:2", ["slave"], "a")], "id string, address string, flags array<string>, master string")
    owners = spark.createDataFrame([(s, "a") for s in (0, 1, 2, 7)], "slot int, owner string")
    topology.write(nodes, owners, str(tmp_path / "t"), 3)
    got_nodes, got_owners = topology.read(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, got_nodes.collect()), key=str) == sorted(map(tuple, nodes.collect()), key=str)
    assert sorted(map(tuple, got_owners.collect())) == sorted(map(tuple, owners.collect()))
    moved = topology.move(owners, spark.createDataFrame([(7, "b"), (9, "b")], "slot int, target string"))
    assert {r.slot: r.owner for r in moved.collect()} == {0: "a", 1: "a", 2: "a", 7: "b", 9: "b"} and topology.info(moved).first().state == "fail"
    assert topology.drop(moved, owners.filter("slot < 2")).count() == 3
