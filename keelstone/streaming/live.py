"""Live forms: operation-log tails folded into state, consumer groups, channels, rate meters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OPS = "seq bigint, ts_ms bigint, cmd string, key string, value string"


def tail(spark: SparkSession, path: str, schema: str = OPS, files_a_trigger: int = 64) -> DataFrame:
    """An operation log as a stream of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def last_writes(ops: DataFrame) -> DataFrame:
    """(key, seq, value) of the latest SET of each key: a streaming aggregate whose state
    is one row a key."""
    return ops.filter("cmd = 'SET'").groupBy("key").agg(F.max(F.struct("seq", "value")).alias("w")).select("key", "w.seq", "w.value")


def counters(ops: DataFrame) -> DataFrame:
    """(key, total) of INCRBY operations."""
    return ops.filter("cmd = 'INCRBY'").groupBy("key").agg(F.sum(F.expr("try_cast(value AS bigint)")).alias("total"))


def subscribe(messages: DataFrame, *channels: str) -> DataFrame:
    return messages.filter(F.col("channel").isin(*channels))


def per_second(commands: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    """Operations a second, final once the watermark has passed."""
    return commands.withWatermark("ts", lateness).groupBy(F.window("ts", "1 second").alias("w")).agg(F.count(F.lit(1)).alias("ops")).select(F.col("w.start").alias("second"), "ops")


DELIVERED = "key string, grp string, id bigint, consumer string, delivery_count int"
_STATE = "waiting array<bigint>, pending_id array<bigint>, pending_consumer array<string>, pending_count array<int>, last bigint"


def consumer_groups(events: DataFrame) -> DataFrame:
    """Consumer groups over one stream of events (key, grp, kind, id, consumer, cnt, seq).

    `add` enters an entry, `del` takes one out, `read` delivers the next cnt entries to a
    consumer (all that wait, where cnt is null or not above zero), `ack` takes an entry off
    the pending list, `replay` delivers a consumer's pending entries from id on again,
    but for deleted ones, and counts each delivery. State holds what is undelivered or unacknowledged, in
    order of id (deleted pending entries with a count below zero); ids that do not exceed
    all before are refused. A group's waiting and pending entries are one state row.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, ids, owners, counts, last = state.get if state.exists else ([], [], [], [], -1)
        waiting, pending, out = list(waiting), {i: [c, n] for i, c, n in zip(ids, owners, counts)}, []
        for e in pd.concat(list(frames)).sort_values("seq", kind="stable").itertuples():
            number = None if pd.isna(e.id) else int(e.id)
            if e.kind == "add" and number is not None and number > last:
                last = number
                waiting.append(last)
            elif e.kind == "del":
                waiting = [i for i in waiting if i != number]
                if number in pending and pending[number][1] > 0:
                    pending[number][1] *= -1
            elif e.kind == "read":
                n = len(waiting) if pd.isna(e.cnt) or int(e.cnt) <= 0 else int(e.cnt)
                given, waiting = waiting[:n], waiting[n:]
                for i in given:
                    pending[i] = [e.consumer, 1]
                    out.append((*key, i, e.consumer, 1))
            elif e.kind == "ack":
                pending.pop(number, None)
            elif e.kind == "replay":
                for i, p in sorted(pending.items()):
                    if p[0] == e.consumer and p[1] > 0 and i >= (number or 0):
                        p[1] += 1
                        out.append((*key, i, p[0], p[1]))
        state.update((waiting, list(pending), [c for c, _ in pending.values()], [n for _, n in pending.values()], last))
        yield pd.DataFrame(out, columns=["key", "grp", "id", "consumer", "delivery_count"])

    # ids as text on the way in: a frame column of numbers with nulls would be of doubles, which lose digits beyond 2^53
    return events.withColumn("id", F.col("id").cast("string")).groupBy("key", "grp").applyInPandasWithState(step, DELIVERED, _STATE, "append", GroupStateTimeout.NoTimeout)
