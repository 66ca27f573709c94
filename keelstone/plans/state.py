"""State tables derived from the relational tables: the inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelstone.functions.expr import epoch_ms


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_name").alias("value"), "c_custkey")


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed keys: customers as strings, nations as sets, parts as hashes."""
    row = lambda t, key, kind: t.select(key.alias("key"), F.lit(kind).alias("type"))
    return (
        row(table(spark, sf_dir, "customer"), F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")), "string")
        .union(row(table(spark, sf_dir, "nation"), F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")), "set"))
        .union(row(table(spark, sf_dir, "part"), F.concat(F.lit("part:{"), F.col("p_brand"), F.lit("}:"), F.col("p_partkey").cast("string")), "hash"))
    )


def expiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as keys that live 90 days; urgent ones never expire."""
    ms = epoch_ms(F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("key"), F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(0)).otherwise(ms + 90 * 86_400_000).cast("bigint").alias("expires_at_ms"))


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an operation log: seq is the event, key the user."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), epoch_ms(F.col("ts")).alias("ts_ms"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), F.col("event_type").alias("value"), (F.col("event_id") % 7).alias("delta"), (F.col("event_id") % 5).alias("kind"), "event_type", "user_id")


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    fields = F.array(F.struct(F.lit("name").alias("field"), F.col("c_name").alias("value")), F.struct(F.lit("segment").alias("field"), F.col("c_mktsegment").alias("value")), F.struct(F.lit("nation").alias("field"), F.col("c_nationkey").cast("string").alias("value")))
    return c.select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("key"), "c_custkey", F.explode(fields).alias("f")).select("key", "f.field", "f.value", "c_custkey")


def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("key"), F.col("c_mktsegment").alias("member")).distinct()


def zsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("key"), F.col("c_name").alias("member"), F.col("c_acctbal").alias("score"))


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as streams by type, with the ids that XADD would give them."""
    from keelstone.operators.streams import auto_ids

    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), epoch_ms(F.col("ts")).alias("ms"), "event_id", "user_id")
    return auto_ids(e, "event_id")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schedule of group reads: a call of each user in the events, so it grows with them."""
    i = F.col("id")
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct()
    return users.select(i.alias("call_seq"), F.concat(F.lit("g"), (i % 2).cast("string")).alias("grp"), F.concat(F.lit("c"), (i % 3).cast("string")).alias("consumer"), (i % 7 + 1).alias("cnt"), (i * 1000 + 1_704_067_200_000).alias("ts_ms"))


#: Where the second group of each stream begins.
GROUP_START = 1_704_500_000_000


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two groups a stream: one from its begin, one from an id on."""
    both = F.array(F.struct(F.lit("g0").alias("grp"), F.lit(0).cast("bigint").alias("last_ms")), F.struct(F.lit("g1").alias("grp"), F.lit(GROUP_START).cast("bigint").alias("last_ms")))
    return stream(spark, sf_dir).select("key").distinct().select("key", F.explode(both).alias("g")).select("key", "g.grp", "g.last_ms", F.lit(0).cast("bigint").alias("last_seq"))


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the schedule delivered and nobody has acknowledged."""
    from keelstone.operators.streams import deliver

    return deliver(stream(spark, sf_dir), calls(spark, sf_dir), groups(spark, sf_dir))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.lit("embeddings").alias("key"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("cmd"), "ts", F.col("value").alias("dur"), "user_id")
