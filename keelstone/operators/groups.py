"""Consumer-group tables: groups(key, grp, last_ms, last_seq) and pending lists.

Each operation takes a batch of requests and gives the new table, or the answer to each request.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_ids(stream: DataFrame) -> DataFrame:
    """(key, ms, seq) of each stream's last entry."""
    one = stream.groupBy("key").agg(F.max(F.struct("ms", "seq")).alias("b"))
    return one.select("key", F.col("b.ms").alias("ms"), F.col("b.seq").alias("seq"))


def _cursors(requests: DataFrame, stream: DataFrame) -> DataFrame:
    """requests (key, grp, ms, seq) with null ids (`$`) set to the stream's last one, 0-0 where it is empty."""
    last = last_ids(stream).select("key", F.col("ms").alias("__ms"), F.col("seq").alias("__seq"))
    end = F.col("ms").isNull()
    out = requests.join(last, "key", "left")
    return out.select("key", "grp", F.when(end, F.coalesce("__ms", F.lit(0))).otherwise(F.col("ms")).cast("bigint").alias("last_ms"), F.when(end, F.coalesce("__seq", F.lit(0))).otherwise(F.coalesce("seq", F.lit(0))).cast("bigint").alias("last_seq"))


def create(groups: DataFrame, requests: DataFrame, stream: DataFrame, make_stream: bool = False) -> tuple[DataFrame, DataFrame]:
    """XGROUP CREATE: (the new table, the answers). A group that exists is BUSYGROUP; a
    stream that does not, an error unless it is to be made."""
    keys = stream.select("key").distinct().withColumn("__there", F.lit(True))
    old = groups.select("key", "grp").withColumn("__busy", F.lit(True))
    asked = _cursors(requests, stream).dropDuplicates(["key", "grp"]).join(keys, "key", "left").join(old, ["key", "grp"], "left")
    error = F.when(F.col("__busy"), F.lit("BUSYGROUP Consumer Group name already exists"))
    if not make_stream:
        error = F.when(F.col("__there").isNull(), F.lit("ERR no such key")).otherwise(error)
    answers = asked.withColumn("error", error)
    return groups.unionByName(answers.filter("error is null").select("key", "grp", "last_ms", "last_seq")), answers.select("key", "grp", "error")


def set_id(groups: DataFrame, requests: DataFrame, stream: DataFrame) -> DataFrame:
    """XGROUP SETID: the table with the requested cursors moved."""
    to = _cursors(requests, stream).withColumnsRenamed({"last_ms": "__ms", "last_seq": "__seq"})
    return groups.join(to, ["key", "grp"], "left").select("key", "grp", F.coalesce("__ms", "last_ms").alias("last_ms"), F.coalesce("__seq", "last_seq").alias("last_seq"))


def destroy(groups: DataFrame, pel: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """XGROUP DESTROY: both tables without the requested groups."""
    gone = requests.select("key", "grp").distinct()
    return groups.join(gone, ["key", "grp"], "left_anti"), pel.join(gone, ["key", "grp"], "left_anti")


def delete_consumer(pel: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """XGROUP DELCONSUMER: the pending list without the consumers, and how many entries each had."""
    gone = requests.select("key", "grp", "consumer").distinct()
    n = pel.groupBy("key", "grp", "consumer").agg(F.count(F.lit(1)).alias("pending"))
    return pel.join(gone, ["key", "grp", "consumer"], "left_anti"), gone.join(n, ["key", "grp", "consumer"], "left").withColumn("pending", F.coalesce("pending", F.lit(0)))


def directory(stream: DataFrame, groups: DataFrame) -> DataFrame:
    """Every stream with its length, first and last id and number of groups."""
    from keelstone.operators.streams import xinfo

    n = groups.groupBy("key").agg(F.count(F.lit(1)).alias("groups"))
    return xinfo(stream).join(n, "key", "left").withColumn("groups", F.coalesce("groups", F.lit(0)))


def info(groups: DataFrame, pel: DataFrame) -> DataFrame:
    """XINFO GROUPS: consumers with pending entries, pending entries and the cursor."""
    n = pel.groupBy("key", "grp").agg(F.count_distinct("consumer").alias("consumers"), F.count(F.lit(1)).alias("pending"))
    return groups.join(n, ["key", "grp"], "left").select("key", "grp", F.coalesce("consumers", F.lit(0)).alias("consumers"), F.coalesce("pending", F.lit(0)).alias("pending"), "last_ms", "last_seq")
