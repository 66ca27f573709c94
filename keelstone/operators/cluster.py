"""Hash-slot operators: counts, range compaction, routing, partitioning, rebalance plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelstone.functions.expr import SLOTS, key_slot


def slotted(keys: DataFrame) -> DataFrame:
    return keys.withColumn("slot", key_slot(F.col("key")))


def count_by_slot(keys: DataFrame) -> DataFrame:
    return slotted(keys).groupBy("slot").agg(F.count(F.lit(1)).alias("n"))


def keys_in_slot(keys: DataFrame, slot: int, n: int) -> DataFrame:
    """GETKEYSINSLOT: the first n keys of a slot; n is the command's argument."""
    return slotted(keys).filter(F.col("slot") == slot).select("key").orderBy("key").limit(n)


def slot_ranges(owners: DataFrame) -> DataFrame:
    """(owner, first, last) of each run of consecutive slots; at most SLOTS rows come in."""
    w = Window.partitionBy("owner").orderBy("slot")
    island = owners.withColumn("g", F.col("slot") - F.row_number().over(w))
    return island.groupBy("owner", "g").agg(F.min("slot").alias("first"), F.max("slot").alias("last")).drop("g")


def slot_text(owners: DataFrame) -> DataFrame:
    """Each owner's slots as `0-5460 6000 7000-7002`, with their count."""
    r = slot_ranges(owners)
    text = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", F.col("first").cast("string"), F.col("last").cast("string")))
    return r.groupBy("owner").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", text.alias("t")))), lambda x: x["t"]), " ").alias("slots"), F.sum(F.col("last") - F.col("first") + 1).cast("bigint").alias("n"))


def partition_slots(spark: SparkSession, n: int) -> DataFrame:
    """(slot, owner): SLOTS dealt to n owners in ranges, the first ones one longer."""
    base, extra = divmod(SLOTS, n)
    edge = extra * (base + 1)
    owner = F.when(F.col("id") < edge, F.floor(F.col("id") / (base + 1))).otherwise(F.lit(extra) + F.floor((F.col("id") - edge) / max(base, 1)))
    return spark.range(SLOTS).select(F.col("id").cast("int").alias("slot"), owner.cast("int").alias("owner"))


def route(requests: DataFrame, owners: DataFrame, me: str) -> DataFrame:
    """requests (id, keys) with the error that node `me` gives: CROSSSLOT, CLUSTERDOWN, MOVED or null."""
    slots = requests.withColumn("s", F.array_distinct(F.transform("keys", key_slot))).withColumn("slot", F.get("s", F.lit(0)))
    found = slots.join(F.broadcast(owners.select("slot", "owner")), "slot", "left")  # SLOTS rows
    error = F.when(F.size("s") > 1, F.lit("CROSSSLOT")).when(F.size("s") == 0, F.lit(None)).when(F.col("owner").isNull(), F.lit("CLUSTERDOWN")).when(F.col("owner") != me, F.concat_ws(" ", F.lit("MOVED"), F.col("slot").cast("string"), "owner"))
    return found.select("id", "slot", error.alias("error"))


def rebalance(owners: DataFrame, nodes: DataFrame) -> DataFrame:
    """(slot, source, target): the moves that even out slots over nodes (owner).

    Targets are SLOTS / n, one more for the first by name. Donors give their last
    slots; receivers fill up in order of name. Both sides are numbered by running
    sums and meet in a join; at most SLOTS rows take part.
    """
    held = nodes.join(owners.groupBy("owner").agg(F.count(F.lit(1)).alias("have")), "owner", "left").fillna(0, ["have"])
    one = Window.partitionBy(F.lit(1)).orderBy("owner")
    total = owners.agg(F.count(F.lit(1)).alias("total"))
    goal = held.crossJoin(total).withColumn("k", F.row_number().over(one)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    goal = goal.withColumn("want", F.floor(F.col("total") / F.col("n")) + F.when(F.col("k") <= F.col("total") % F.col("n"), 1).otherwise(0))
    spare = owners.join(goal.select("owner", (F.col("have") - F.col("want")).alias("give")), "owner").withColumn("r", F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("slot")))).filter("r <= give")
    given = spare.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("owner", "slot"))).select("i", "slot", F.col("owner").alias("source"))
    taken = goal.filter("want > have").select(F.col("owner").alias("target"), F.explode(F.sequence(F.lit(1), (F.col("want") - F.col("have")).cast("int"))).alias("j")).withColumn("i", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("target", "j")))
    return given.join(taken, "i").select("slot", "source", "target")
