"""Session state from click streams: the ordered fold, cart and skip counters, boosts and penalties."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.functions import numbers as N

KEPT = 20
SKIP_MS, BOUNCE_MS = 2000, 3000
SESSION_HOURS, CART_DAYS, SKIP_HOURS = 24, 7, 4
CLICKS = ("search_result_click", "item_open", "item_click")

STATE = "user_id bigint, version bigint, clicked array<string>, cart array<string>, recent array<string>, bounced array<string>, counts string, last_kind string, updated timestamp"


def recently(value: str, held: list[str], most: int = KEPT) -> list[str]:
    """The value first, then the others, without repeats; empty values change nothing."""
    return [value, *(x for x in held if x != value)][:most] if value else held


class Session:
    """One user's state; it forgets everything after so many hours without an event."""

    def __init__(self):
        self.version, self.clicked, self.cart, self.recent, self.bounced, self.counts, self.last_kind, self.updated = 0, [], [], [], [], {}, "", None

    def apply(self, ts, kind: str, item: str, category: str, duration: float | None) -> None:
        if self.updated is not None and ts - self.updated > pd.Timedelta(hours=SESSION_HOURS):
            self.__init__()
        self.version, self.updated, self.last_kind = self.version + 1, ts, kind
        self.counts[kind] = self.counts.get(kind, 0) + 1
        if kind in CLICKS:
            self.clicked = recently(item, self.clicked)
        if kind in (*CLICKS, "cart_add", "purchase"):
            self.recent = recently(category, self.recent)
        if kind == "cart_add":
            self.cart = recently(item, self.cart)
        elif kind == "cart_remove":
            self.cart = [x for x in self.cart if x != item]
        elif kind == "purchase":
            self.bounced = [x for x in self.bounced if x != category]
        elif kind == "bounce" or (kind == "item_close" and duration is not None and 0 < duration < BOUNCE_MS):
            self.bounced = recently(category, self.bounced)

    def row(self, user: int) -> tuple:
        counts = ",".join(f"{k}:{n}" for k, n in sorted(self.counts.items()))
        return (user, self.version, self.clicked, self.cart, self.recent, self.bounced, counts, self.last_kind, self.updated)


def events_of(raw: DataFrame) -> DataFrame:
    """event_id, user_id, ts, kind, item, category, duration_ms of the clickstream table."""
    k = F.get_json_object("props", "$.k")
    return raw.select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), F.coalesce(k, F.lit("")).alias("item"),
        F.concat(F.lit("c"), F.pmod(F.coalesce(k.try_cast("long"), F.lit(0)), F.lit(7)).cast("string")).alias("category"), (F.col("value") * 100).alias("duration_ms"),
    )


def fold_sessions(events: DataFrame, partitions: int | None = None) -> DataFrame:
    """The state of every user after all its events in order.

    Users stand together in sorted partitions and are folded as a stream, so a user of any number of events needs the memory of one state.
    """
    n = partitions or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = events.select("user_id", "ts", "event_id", "kind", "item", "category", "duration_ms").repartition(n, "user_id").sortWithinPartitions("user_id", "ts", "event_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in STATE.split(", ")]
        user, session = None, None
        for frame in frames:
            done = []
            for who, ts, _, kind, item, category, duration in frame.itertuples(index=False, name=None):
                if session is None or who != user:
                    if session is not None:
                        done.append(session.row(user))
                    user, session = who, Session()
                session.apply(ts, kind, item, category, duration)
            if done:
                yield pd.DataFrame(done, columns=names)
        if session is not None:
            yield pd.DataFrame([session.row(user)], columns=names)

    return rows.mapInPandas(run, STATE)


def event_counts(events: DataFrame) -> DataFrame:
    """user_id and how often each kind of event occurred."""
    kinds = ("view", "click", "purchase", "error", "signup")
    return events.groupBy("user_id").agg(F.count("*").alias("events"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds], F.min("ts").cast("date").alias("first_day"), F.max("ts").cast("date").alias("last_day"))


def last_stretch(events: DataFrame, keys: list[str], lifetime: str) -> DataFrame:
    """Of each key the events since the last gap longer than the lifetime: what a counter that expires still remembers."""
    order = W.partitionBy(*keys).orderBy("ts", "event_id")
    fresh = F.when(F.col("ts") - F.lag("ts").over(order) > F.expr(f"INTERVAL {lifetime}"), 1).otherwise(0)
    held = events.withColumn("__fresh", fresh).withColumn("__stretch", F.sum("__fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return held.withColumn("__last", F.max("__stretch").over(W.partitionBy(*keys))).where("__stretch = __last").drop("__fresh", "__stretch", "__last")


def cart_counts(events: DataFrame, add: str = "click", remove: str = "purchase") -> DataFrame:
    """user_id, category, n: the counter that adds and takes but never falls below 0, forgotten after ``CART_DAYS`` without a change.

    Such a walk ends at its total less the least prefix sum (or 0), so two window sums replace the fold.
    """
    changes = last_stretch(events.where(F.col("kind").isin(add, remove)), ["user_id", "category"], f"{CART_DAYS} DAYS")
    step = F.when(F.col("kind") == add, 1).otherwise(-1)
    order = W.partitionBy("user_id", "category").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    walked = changes.withColumn("sum", F.sum(step).over(order)).withColumn("step", step)
    return walked.groupBy("user_id", "category").agg((F.sum("step") - F.least(F.lit(0), F.min("sum"))).alias("n")).where("n > 0")


def skip_counts(events: DataFrame, kind: str = "view") -> DataFrame:
    """user_id, category, n: views given up within two seconds, forgotten after ``SKIP_HOURS`` without another."""
    quick = (F.col("kind") == kind) & (F.coalesce("duration_ms", F.lit(0.0)) < SKIP_MS)
    return last_stretch(events.where(quick), ["user_id", "category"], f"{SKIP_HOURS} HOURS").groupBy("user_id", "category").agg(F.count("*").alias("n"))


def boosted(scored: DataFrame, cart: DataFrame, skips: DataFrame) -> DataFrame:
    """scored (user_id, item, category, score) after cart boost (six digits) and then skip penalty (four)."""
    held = scored.join(cart.withColumnRenamed("n", "cart_n"), ["user_id", "category"], "left").join(skips.withColumnRenamed("n", "skip_n"), ["user_id", "category"], "left")
    lifted = F.round(F.col("score") * N.cart_multiplier(F.coalesce("cart_n", F.lit(0))), 6)
    return held.select("user_id", "item", "category", "score", lifted.alias("boosted"), F.round(lifted * N.skip_multiplier(F.coalesce("skip_n", F.lit(0))), 4).alias("final"))
