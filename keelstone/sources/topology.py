"""Cluster topology as text lines: a source and a sink of slot ownership.

A line holds a node's id, address, flags, master id and its slots (`0-5460 6000`); a
line `vars currentEpoch N ...` holds the epoch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelstone.operators.cluster import slot_text


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (id, address, flags, master) and owners (slot, owner)."""
    lines = spark.read.text(path).filter("value not like 'vars %' and trim(value) <> ''").select(F.split(F.trim("value"), r"\s+").alias("p"))
    nodes = lines.select(F.get("p", F.lit(0)).alias("id"), F.get("p", F.lit(1)).alias("address"), F.split(F.get("p", F.lit(2)), ",").alias("flags"), F.nullif(F.get("p", F.lit(3)), F.lit("-")).alias("master"))
    runs = lines.select(F.get("p", F.lit(0)).alias("owner"), F.explode(F.filter("p", lambda x: x.rlike("^[0-9]+(-[0-9]+)?$"))).alias("r"))
    ends = runs.select("owner", F.split("r", "-").alias("e"))
    last = F.element_at("e", -1).cast("int")
    return nodes, ends.select(F.explode(F.sequence(F.get("e", F.lit(0)).cast("int"), last)).alias("slot"), "owner")


def lines(nodes: DataFrame, owners: DataFrame, epoch: int = 0) -> DataFrame:
    """(value): a line a node, and the epoch's."""
    s = slot_text(owners).select(F.col("owner").alias("id"), "slots")
    text = F.concat_ws(" ", "id", "address", F.array_join("flags", ","), F.coalesce("master", F.lit("-")), "slots")
    return nodes.join(s, "id", "left").select(text.alias("value")).union(nodes.sparkSession.createDataFrame([(f"vars currentEpoch {epoch}",)], "value string"))


def write(nodes: DataFrame, owners: DataFrame, path: str, epoch: int = 0) -> None:
    """A topology is a few lines: one file."""
    lines(nodes, owners, epoch).coalesce(1).write.text(path)


def move(owners: DataFrame, moves: DataFrame) -> DataFrame:
    """SETSLOT and ADDSLOTS: owners after moves (slot, target); new slots are added."""
    return owners.join(moves.select("slot", "target"), "slot", "full_outer").select("slot", F.coalesce("target", "owner").alias("owner"))


def drop(owners: DataFrame, slots: DataFrame) -> DataFrame:
    """DELSLOTS."""
    return owners.join(slots.select("slot"), "slot", "left_anti")


def info(owners: DataFrame) -> DataFrame:
    """CLUSTER INFO: assigned slots, nodes that own any, and the state."""
    one = owners.agg(F.count(F.lit(1)).alias("slots_assigned"), F.count_distinct("owner").alias("size"))
    return one.withColumn("state", F.when(F.col("slots_assigned") == 16384, "ok").otherwise("fail"))
