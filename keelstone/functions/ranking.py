"""Ranks and running values within keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelstone.session import stored


def top(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rn") -> DataFrame:
    """The first n rows of each key, numbered from 1. Spark limits each partition's
    groups before the shuffle, so a hot key sends at most n rows a task."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n).withColumn(name, F.col(name).cast("bigint"))


#: Running values: what a part of a key's rows comes to, how parts are put together, and
#: whether a row's own value counts.
_KINDS = {
    "sum": (F.sum, True),  # up to and with the row
    "max": (F.max, False),  # before the row
    "last": (lambda c: F.last(c, ignorenulls=True), False),  # the nearest that is not null before the row
}


def running(df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, Column]]) -> DataFrame:
    """df with running values of each key in the given order: name -> (sum, max or last; column).

    A key may hold any share of all rows: rows are range-partitioned by key and order, each
    task runs over its own rows, and what the parts before come to, one row a key and part, is
    joined on. Null keys are a key.
    """
    dealt = stored(df.withColumns({f"__{n}": c for n, (_, c) in values.items()}).repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()), "running")
    w = Window.partitionBy("__part", *keys).orderBy(*order)
    upto = {True: w.rowsBetween(Window.unboundedPreceding, 0), False: w.rowsBetween(Window.unboundedPreceding, -1)}
    own = dealt.withColumns({f"__own_{n}": _KINDS[kind][0](F.col(f"__{n}")).over(upto[_KINDS[kind][1]]) for n, (kind, _) in values.items()})
    at = F.struct(*order)
    whole = {"sum": F.sum, "max": F.max, "last": lambda c: F.max_by(c, F.when(c.isNotNull(), at))}
    size = dealt.groupBy(*keys, "__part").agg(*[whole[kind](F.col(f"__{n}")).alias(f"__all_{n}") for n, (kind, _) in values.items()])
    parts = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = size.select(*keys, "__part", *[_KINDS[kind][0](F.col(f"__all_{n}")).over(parts).alias(f"__before_{n}") for n, (kind, _) in values.items()])
    same = [own[k].eqNullSafe(before[k]) for k in keys] + [own["__part"] == before["__part"]]
    join = {"sum": lambda b, o: F.coalesce(b, F.lit(0)) + F.coalesce(o, F.lit(0)), "max": lambda b, o: F.greatest(b, o), "last": lambda b, o: F.coalesce(o, b)}
    cols = [own[c] for c in df.columns if c not in values]
    return own.join(before, same).select(*cols, *[join[kind](before[f"__before_{n}"], own[f"__own_{n}"]).alias(n) for n, (kind, _) in values.items()])


def ranks(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Every row with its place in its key, from 1, where a key may hold any share of all rows.

    Rows are range-partitioned by key and order, so a hot key spans many tasks;
    each task numbers its own rows, and the counts of the parts before are added.
    """
    dealt = stored(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("__part", F.spark_partition_id()), "ranks")
    own = dealt.withColumn("__own", F.row_number().over(Window.partitionBy("__part", *keys).orderBy(*order)))
    size = dealt.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = size.withColumn("__before", F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part")) - F.col("__n")).drop("__n")
    same = [own[k].eqNullSafe(before[k]) for k in keys] + [own["__part"] == before["__part"]]
    cols = [own[c] for c in df.columns]
    return own.join(before, same).select(*cols, (own["__own"] + before["__before"]).cast("bigint").alias(name))
