"""Stream operators: ids, ranges, trims, consumer groups, pub/sub, telemetry.

stream(key, ms, seq, ...) in the order of (ms, seq); groups deliver in that order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelstone.functions.ranking import ranks, running, top
from keelstone.session import stored

ORDER = ("ms", "seq")


def auto_ids(events: DataFrame, order: str) -> DataFrame:
    """XADD with automatic ids: seq counts the events of a key's millisecond in their order."""
    return events.withColumn("seq", (F.row_number().over(Window.partitionBy("key", "ms").orderBy(order)) - 1).cast("bigint"))


def xadd(adds: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """XADD of a batch: adds (key, arrival, now_ms, ms, seq, ...) with the ids they get, id_ms and id_seq, null
    where they are refused. ms and seq are null for `*`, seq alone for `ms-*`. last (key, last_ms,
    last_seq) has the ids that streams end in before the batch.

    An id has to exceed all before; `*` takes the time, or the last id's ms where that is not
    behind it. The last ms is a running maximum. While it stays the same, numbers taken in
    turn add one and given ones that are higher set the count, so the last seq is a count
    of turns plus a running maximum of given numbers less their counts: no entry
    waits for the one before, and a stream may hold any share of all rows.
    """
    own = [F.col(c) for c in adds.columns]
    given = adds.withColumn("__at", F.coalesce("ms", "now_ms").cast("bigint"))
    given = running(given, ["key"], ["arrival"], {"__top": ("max", F.col("__at"))})
    ends = None if last is None else last.select("key", F.col("last_ms").alias("__last_ms"), F.col("last_seq").alias("__last_seq"))
    given = given.withColumns({"__last_ms": F.lit(None).cast("bigint"), "__last_seq": F.lit(None).cast("bigint")}) if ends is None else given.join(ends, "key", "left")
    before = F.greatest("__top", "__last_ms")
    given = given.withColumn("__first", F.coalesce(F.col("__at") > before, F.lit(True))).withColumn("__ms", F.greatest("__at", before))
    turn = ~F.col("__first") & F.col("seq").isNull() & (F.col("ms").isNull() | (F.col("ms") == F.col("__ms")))
    given = running(given.withColumn("__turn", turn.cast("bigint")), ["key", "__ms"], ["arrival"], {"__turns": ("sum", F.col("__turn"))})
    sets = F.col("__first") | (F.col("seq").isNotNull() & (F.col("ms") == F.col("__ms")))
    number = F.coalesce("seq", F.lit(0)).cast("bigint")
    given = running(given, ["key", "__ms"], ["arrival"], {"__set": ("max", F.when(sets, number - F.col("__turns")))})
    base = F.when(F.col("__ms") == F.col("__last_ms"), F.col("__last_seq"))
    held = F.col("__turns") - F.col("__turn") + F.greatest("__set", base)
    got = F.when(F.col("__first"), number).when(F.col("__turn") == 1, held + 1).when(sets & (number > held), number)
    return given.withColumn("__seq", got).select(*own, F.when(F.col("__seq").isNotNull(), F.col("__ms")).alias("id_ms"), F.col("__seq").alias("id_seq"))


def trimmed(entries: DataFrame) -> DataFrame:
    """What MAXLEN leaves (entries: key, ms, seq, maxlen, ...): every add with a maxlen keeps the newest so
    many entries of that time, itself included. An entry stays if it is not before the
    furthest cut of its stream, which is an aggregate over ranks."""
    ranked = stored(ranks(entries, ["key"], [F.col("ms"), F.col("seq")], "__rn"), "ranked-entries")
    cut = ranked.filter("maxlen is not null").groupBy("key").agg(F.max(F.col("__rn") - F.greatest("maxlen", F.lit(0))).alias("__cut"))
    return ranked.join(cut, "key", "left").filter(F.col("__rn") > F.coalesce("__cut", F.lit(0))).drop("__rn", "__cut")


def refused(adds: DataFrame) -> DataFrame:
    """XADD with given ids (key, arrival, ms, seq): the ones that do not exceed all before. A
    stream may hold any share of all rows."""
    seen = running(adds, ["key"], ["arrival"], {"before": ("max", F.struct("ms", "seq"))})
    return seen.filter(F.col("before").isNotNull() & (F.struct("ms", "seq") <= F.col("before"))).drop("before")


def _between(lo: tuple[int, int] | None, hi: tuple[int, int] | None):
    cond = F.lit(True)
    if lo is not None:
        cond = cond & ((F.col("ms") > lo[0]) | (F.col("ms") == lo[0]) & (F.col("seq") >= lo[1]))
    if hi is not None:
        cond = cond & ((F.col("ms") < hi[0]) | (F.col("ms") == hi[0]) & (F.col("seq") <= hi[1]))
    return cond


def xrange(stream: DataFrame, lo: tuple[int, int] | None = None, hi: tuple[int, int] | None = None, count: int = 0, reverse: bool = False) -> DataFrame:
    """Entries with lo <= id <= hi, the first `count` of each key where that is over 0."""
    out = stream.filter(_between(lo, hi))
    order = [F.col(c).desc() if reverse else F.col(c).asc() for c in ORDER]
    return top(out, ["key"], order, count) if count > 0 else out


def xread(stream: DataFrame, cursors: DataFrame, count: int = 0) -> DataFrame:
    """Entries after each key's cursor (key, after_ms, after_seq)."""
    out = stream.join(cursors, "key").filter("ms > after_ms or ms = after_ms and seq > after_seq").drop("after_ms", "after_seq")
    return top(out, ["key"], [F.col("ms"), F.col("seq")], count) if count > 0 else out


def xtrim(stream: DataFrame, newest: int) -> DataFrame:
    """The newest entries of each key; a negative number trims nothing."""
    return stream if newest < 0 else top(stream, ["key"], [F.desc("ms"), F.desc("seq")], newest).drop("rn")


def xdel(stream: DataFrame, ids: DataFrame) -> DataFrame:
    return stream.join(ids, ["key", "ms", "seq"], "left_anti")


def xinfo(stream: DataFrame) -> DataFrame:
    """Per key: length, first and last id."""
    one = stream.groupBy("key").agg(F.count(F.lit(1)).alias("length"), F.min(F.struct("ms", "seq")).alias("a"), F.max(F.struct("ms", "seq")).alias("b"))
    return one.select("key", "length", F.col("a.ms").alias("first_ms"), F.col("a.seq").alias("first_seq"), F.col("b.ms").alias("last_ms"), F.col("b.seq").alias("last_seq"))


#: Ranks of a stream that one row of a call's span stands for.
SPAN = 1024


def deliver(stream: DataFrame, calls: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """XREADGROUP `>` for a schedule of calls (call_seq, grp, consumer, cnt, ts_ms) on each key:
    (key, ms, seq, grp, consumer, call_seq, delivery_ms, delivery_count).

    groups (key, grp, last_ms, last_seq) are the groups there are and their cursors; without them
    every group of the schedule begins before the first entry. A call takes the next cnt
    entries after its group's cursor, all that are left where cnt is null or not above zero,
    so each call owns a range of ranks. Entries are ranked once by key, whatever a key's share
    and whatever the number of groups; a cursor is a rank too. Spans are cut into
    pieces of SPAN ranks, which makes the range join an equi-join.
    """
    ranked = stored(ranks(stream.select("key", "ms", "seq"), ["key"], [F.col("ms"), F.col("seq")], "rn"), "ranked-entries")
    size = ranked.groupBy("key").agg(F.max("rn").alias("n"))
    if groups is None:
        at = size.crossJoin(calls.select("grp").distinct()).withColumn("after", F.lit(0).cast("bigint"))  # a row a stream and group
    else:
        passed = ranked.join(groups.select("key", "grp", "last_ms", "last_seq"), "key").filter("ms < last_ms or ms = last_ms and seq <= last_seq").groupBy("key", "grp").agg(F.max("rn").alias("after"))
        at = groups.select("key", "grp").join(size, "key").join(passed, ["key", "grp"], "left").withColumn("after", F.coalesce("after", F.lit(0)))
    all_left = F.coalesce(F.col("cnt") <= 0, F.lit(True))
    far = F.lit(1 << 60)
    spans = running(calls.withColumn("take", F.when(all_left, F.lit(0)).otherwise(F.col("cnt")).cast("bigint")), ["grp"], ["call_seq"], {"hi": ("sum", F.col("take")), "over": ("max", F.when(all_left, F.lit(1)))})
    spans = spans.filter("over is null").select("grp", "consumer", "call_seq", "ts_ms", (F.col("hi") - F.col("take")).alias("lo"), F.when(all_left, far).otherwise(F.col("hi")).alias("hi"))
    mine = spans.join(at, "grp").select("key", "grp", "consumer", "call_seq", "ts_ms", (F.col("lo") + F.col("after")).alias("lo"), F.least(F.col("hi") + F.col("after"), "n").alias("hi")).filter("lo < hi")
    pieces = mine.withColumn("piece", F.explode(F.sequence(F.floor(F.col("lo") / SPAN), F.floor((F.col("hi") - 1) / SPAN))))
    met = ranked.withColumn("piece", F.floor((F.col("rn") - 1) / SPAN)).join(pieces, ["key", "piece"]).filter("rn > lo and rn <= hi")
    return met.select("key", "ms", "seq", "grp", "consumer", "call_seq", F.col("ts_ms").alias("delivery_ms"), F.lit(1).cast("bigint").alias("delivery_count"))


def moved_cursors(groups: DataFrame, delivered: DataFrame) -> DataFrame:
    """The groups with their cursors at the last entry delivered to each."""
    last = delivered.groupBy("key", "grp").agg(F.max(F.struct("ms", "seq")).alias("b"))
    there = F.struct(F.col("last_ms").alias("ms"), F.col("last_seq").alias("seq"))
    to = F.greatest(F.col("b"), there)
    return groups.join(last, ["key", "grp"], "left").select("key", "grp", to["ms"].alias("last_ms"), to["seq"].alias("last_seq"))


def pending_after(delivered: DataFrame, calls: DataFrame) -> DataFrame:
    """What a schedule leaves pending: what it delivered but for its NOACK calls (calls: call_seq, noack)."""
    return delivered.join(calls.filter("noack").select("call_seq"), "call_seq", "left_anti").select(*delivered.columns)


def replay(pel: DataFrame, stream: DataFrame, grp: str, consumer: str, start: tuple[int, int], now_ms: int, count: int = 0) -> DataFrame:
    """XREADGROUP with an id: a consumer's pending entries from that id on, once more; deleted
    entries are left out, counts go up and times are renewed."""
    mine = pel.filter((F.col("grp") == grp) & (F.col("consumer") == consumer)).filter(_between(start, None))
    found = mine.join(stream.select("key", "ms", "seq"), ["key", "ms", "seq"], "left_semi")
    found = found.withColumn("delivery_count", F.col("delivery_count") + 1).withColumn("delivery_ms", F.lit(now_ms).cast("bigint"))
    return top(found, ["key"], [F.col("ms"), F.col("seq")], count).drop("rn") if count > 0 else found


def ack(pel: DataFrame, ids: DataFrame) -> DataFrame:
    """The pending list without the acknowledged (key, grp, ms, seq)."""
    return pel.join(ids, ["key", "grp", "ms", "seq"], "left_anti")


def pending_summary(pel: DataFrame) -> DataFrame:
    one = pel.groupBy("key", "grp").agg(F.count(F.lit(1)).alias("pending"), F.min(F.struct("ms", "seq")).alias("a"), F.max(F.struct("ms", "seq")).alias("b"), F.count_distinct("consumer").alias("consumers"))
    return one.select("key", "grp", "pending", F.col("a.ms").alias("min_ms"), F.col("a.seq").alias("min_seq"), F.col("b.ms").alias("max_ms"), F.col("b.seq").alias("max_seq"), "consumers")


def pending_detail(pel: DataFrame, now_ms: int, idle_ms: int = 0, count: int = 0, consumer: str | None = None, lo: tuple[int, int] | None = None, hi: tuple[int, int] | None = None) -> DataFrame:
    """Pending entries at least idle_ms idle with lo <= id <= hi, the first `count` of each key and group by id."""
    out = pel.filter(_between(lo, hi)).withColumn("idle_ms", F.lit(now_ms) - F.col("delivery_ms")).filter(F.col("idle_ms") >= idle_ms)
    if consumer is not None:
        out = out.filter(F.col("consumer") == consumer)
    out = top(out, ["key", "grp"], [F.col("ms"), F.col("seq")], count).drop("rn") if count > 0 else out
    return out.select("key", "grp", "ms", "seq", "consumer", "idle_ms", "delivery_count")


def pending_by_consumer(pel: DataFrame) -> DataFrame:
    """XPENDING's list of a group's consumers with their pending entries."""
    return pel.groupBy("key", "grp", "consumer").agg(F.count(F.lit(1)).alias("pending"))


def consumers(pel: DataFrame, now_ms: int, seen: DataFrame | None = None) -> DataFrame:
    """XINFO CONSUMERS: pending entries and idle time. With seen (key, grp, consumer, seen_ms), the
    consumers that have called at all, those without pending entries too, idle since they called."""
    if seen is not None:
        last = seen.groupBy("key", "grp", "consumer").agg(F.max("seen_ms").alias("at"))
        out = last.join(pending_by_consumer(pel), ["key", "grp", "consumer"], "left")
        return out.select("key", "grp", "consumer", F.coalesce("pending", F.lit(0)).alias("pending"), (F.lit(now_ms) - F.col("at")).alias("idle_ms"))
    return pel.groupBy("key", "grp", "consumer").agg(F.count(F.lit(1)).alias("pending"), (F.lit(now_ms) - F.max("delivery_ms")).alias("idle_ms"))


def publish(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Each message with how many subscribers get it. Subscriptions are counted by channel
    first, so a hot channel's messages are not multiplied."""
    n = subscriptions.groupBy("channel").agg(F.count_distinct("subscriber").alias("delivered"))
    return messages.join(n, "channel", "left").withColumn("delivered", F.coalesce("delivered", F.lit(0)))


def channels(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.groupBy("channel").agg(F.count_distinct("subscriber").alias("subscribers"))


# telemetry over commands(cmd, ts, dur)


def command_stats(commands: DataFrame) -> DataFrame:
    return commands.groupBy("cmd").agg(F.count(F.lit(1)).alias("calls"), F.avg("dur").alias("avg_dur"))


def p99(commands: DataFrame, by: str = "cmd", share: float = 0.99) -> DataFrame:
    """The value of floor rank (n - 1) * share of each group, exact for groups of any size:
    equal values are counted before anything is sorted, and running counts are taken over
    range partitions, so a group's values spread over many tasks."""
    counted = commands.filter("dur is not null").groupBy(by, "dur").agg(F.count(F.lit(1)).alias("n"))
    upto = stored(running(counted, [by], ["dur"], {"upto": ("sum", F.col("n"))}), "running-counts")
    size = upto.groupBy(by).agg(F.max("upto").alias("total"))
    at = F.floor((F.col("total") - 1) * share) + 1
    return upto.join(size, by).filter(F.col("upto") >= at).groupBy(by).agg(F.min("dur").alias("p99"))


def per_second(commands: DataFrame) -> DataFrame:
    """Operations in each second."""
    return commands.groupBy(F.window("ts", "1 second").alias("w")).agg(F.count(F.lit(1)).alias("ops")).select(F.col("w.start").alias("second"), "ops")


def slowlog(commands: DataFrame, least: float, n: int = 128) -> DataFrame:
    """The n latest slow commands; n is the feature."""
    return commands.filter(F.col("dur") >= least).orderBy(F.desc("ts"), F.desc("id")).limit(n)
