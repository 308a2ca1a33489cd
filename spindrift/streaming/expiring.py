"""Keyed state that expires: counters and cached values over event time, by transformWithState.

Events of a key may arrive out of order within the watermark's delay.  Each waits in the key's list until the watermark has passed it;
then all that are due are applied in order, so the outcome is that of the sorted table up to the watermark.  Another timer drops what
wasn't touched for its lifetime.  Events later than the watermark are dropped.  As every call of the state is a message to the executor, a
key's events wait as one row a batch, with a timer for the first of them alone, and counters of a user share a state where keys are many.
State is kept by the RocksDB provider (``PROVIDER``) and can be read back by the state data source under the names ``held`` and ``waiting``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
MICROS = 1000
#: How many events a message to the state holds at most.
MESSAGE = 10_000


class InOrder(StatefulProcessor):
    """Applies the events of a key in order of (at, event_id) once the watermark has passed them."""

    #: Schemas of what is kept of a key and of an event that waits; the latter begins with at (microseconds) and event_id, and no two events share the first three values.
    HELD, WAITING = "", ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.HELD)
        parts = [f.split() for f in self.WAITING.split(", ")]
        self.waiting = handle.getListState("waiting", ", ".join(f"{name} array<{kind}>" for name, kind in parts))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names = [f.split()[0] for f in self.WAITING.split(", ")]
        self.wait([tuple(row[n] for n in names) for row in rows])
        return iter(())

    def wait(self, events: list[tuple]) -> None:
        """Keeps the events, and has a timer tell when the watermark has passed the first."""
        if events:
            self.waiting.appendList([tuple(map(list, zip(*events[i : i + MESSAGE]))) for i in range(0, len(events), MESSAGE)])
            self.handle.registerTimer(-(-min(e[0] for e in events) // MICROS))

    def due(self, now: int) -> list[tuple]:
        """The events that wait no longer, in order."""
        events = [e for lists in self.waiting.get() for e in zip(*lists)]
        found = sorted((e for e in events if e[0] <= now * MICROS), key=lambda e: e[:3])
        if found:
            self.waiting.clear()
            self.wait([e for e in events if e[0] > now * MICROS])
        return found

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        due = self.due(now)
        was = self.held.get()
        held = was = None if was is None else tuple(was)
        for event in due:
            if held is not None and self.ends(held) < event[0]:
                held = None
            held, told = self.apply(held, event)
            if told is not None:
                yield self.row(key, told)
        if held is not None and self.ends(held) < now * MICROS:
            held = None
        if held == was:
            return
        if held is None:
            self.held.clear()
        else:
            self.held.update(held)
            self.handle.registerTimer(self.ends(held) // MICROS + 1)
        yield from self.changed(key, held)

    def ends(self, held: tuple) -> int:
        """The last microsecond at which what is held still lives."""
        raise NotImplementedError

    def apply(self, held: tuple | None, event: tuple) -> tuple[tuple | None, tuple | None]:
        """What is held after an event, and an answer if the event asks for one."""
        raise NotImplementedError

    def row(self, key: tuple, told: tuple) -> Row:
        raise NotImplementedError

    def changed(self, key: tuple, held: tuple | None) -> Iterator[Row]:
        """Rows that tell what is held now."""
        return iter(())

    def close(self) -> None:
        pass


class Counter(InOrder):
    """Counts up and down, never below 0; forgotten a lifetime after its last event."""

    HELD, WAITING = "n long, at long", "at long, event_id long, step int"

    def __init__(self, lifetime_seconds: int):
        self.lifetime = lifetime_seconds * 1_000_000

    def ends(self, held):
        return held[1] + self.lifetime

    def apply(self, held, event):
        return (max(0, (held[0] if held else 0) + event[2]), event[0]), None

    def changed(self, key, held):
        yield Row(user_id=key[0], category=key[1], n=held[0] if held else 0)


class UserCounters(Counter):
    """The counters of a user by category in one state; each counts and is forgotten as a ``Counter`` is."""

    HELD, WAITING = "category array<string>, n array<long>, at array<long>", "at long, event_id long, step int, category string"

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        due = self.due(now)
        was = {c: (n, at) for c, n, at in zip(*(self.held.get() or ()))}
        held = dict(was)
        for event in due:
            one = held.get(event[3])
            held[event[3]], _ = self.apply(one if one and self.ends(one) >= event[0] else None, event)
        held = {c: one for c, one in held.items() if self.ends(one) >= now * MICROS}
        if held == was:
            return
        if held:
            self.held.update((list(held), [n for n, _ in held.values()], [at for _, at in held.values()]))
            self.handle.registerTimer(min(map(self.ends, held.values())) // MICROS + 1)
        else:
            self.held.clear()
        for c in {**was, **held}:
            if held.get(c) != was.get(c):
                yield Row(user_id=key[0], category=c, n=held[c][0] if c in held else 0)


class Cache(InOrder):
    """Puts, gets and deletes of a value that lives as long as its put says; a get tells the value, null if there is none alive."""

    HELD, WAITING = "value string, until long", "at long, event_id long, op string, value string, seconds long"

    def ends(self, held):
        return held[1]

    def apply(self, held, event):
        at, number, op, value, seconds = event
        if op == "put":
            return (value, at + max(1, seconds) * 1_000_000), None
        if op == "delete":
            return None, None
        return held, (number, held[0] if held else None)

    def row(self, key, told):
        return Row(key=key[0], event_id=told[0], value=told[1])


def session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep their state in RocksDB; the caller's settings stay."""
    own = spark.newSession()
    for name, value in PROVIDER.items():
        own.conf.set(name, value)
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    return own


def timed(events: DataFrame, delay: str) -> DataFrame:
    return events.withColumn("at", F.unix_micros("ts")).withWatermark("ts", delay)


def steps(events: DataFrame, step: Column, delay: str) -> DataFrame:
    rows = timed(events, delay).withColumn("step", step.cast("int")).where("step IS NOT NULL")
    return rows.select("user_id", "category", "ts", "at", "event_id", "step")


def counters(events: DataFrame, step: Column, lifetime_seconds: int, delay: str = "1 hour") -> DataFrame:
    """user_id, category, n whenever a counter changes (0: gone).  events: a stream of user_id, category, ts, event_id; step: +1, -1 or null for events that don't count."""
    held = steps(events, step, delay).groupBy("user_id", "category")
    return held.transformWithState(Counter(lifetime_seconds), "user_id long, category string, n long", "Update", "eventTime")


def user_counters(events: DataFrame, step: Column, lifetime_seconds: int, delay: str = "1 hour") -> DataFrame:
    """The same with a state a user, for many users of a few live categories each."""
    held = steps(events, step, delay).groupBy("user_id")
    return held.transformWithState(UserCounters(lifetime_seconds), "user_id long, category string, n long", "Update", "eventTime")


def cache_reads(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """key, event_id, value of every get.  events: a stream of key, ts, event_id, op (put, get or delete), value, seconds."""
    rows = timed(events, delay).select("key", "ts", "at", "event_id", "op", "value", F.coalesce("seconds", F.lit(0)).cast("long").alias("seconds"))
    return rows.groupBy("key").transformWithState(Cache(), "key string, event_id long, value string", "Append", "eventTime")


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str) -> None:
    """Runs a stream over what its source has and writes each batch's rows, with the batch's number, below path; a repeated batch replaces its rows."""

    def put(rows: DataFrame, number: int) -> None:
        rows.withColumn("batch", F.lit(number)).write.partitionBy("batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start().awaitTermination()


def last_of_each(rows: DataFrame, *keys: str) -> DataFrame:
    """The row of the latest batch of each key; a key changes at most once a batch and timer, of which the latest counts."""
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")
