"""Point-in-time features of purchases: what was known strictly before each event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.functions import numbers as N
from spindrift.operators.purchases import few
from spindrift.operators.shared import spread, stored

#: Events are taken in this order.
ORDER = ("day", "contract_id", "customer_id", "item_id", "line", "supplier_id", "amount")


def before(*keys: str):
    """All earlier events of the same keys."""
    return W.partitionBy(*keys).orderBy(*ORDER).rowsBetween(W.unboundedPreceding, -1)


def user_history(events: DataFrame) -> DataFrame:
    """Counts and last days of the customer, in all, by category, item and supplier, before each event."""
    days = lambda last: N.recency_days(last, F.col("day"))
    return events.withColumns({
        "user_total": F.count("*").over(before("customer_id")),
        "user_category": F.count("*").over(before("customer_id", "category")),
        "user_item": F.count("*").over(before("customer_id", "item_id")),
        "user_supplier": F.count("*").over(before("customer_id", "supplier_id")),
        "category_recency": days(F.max("day").over(before("customer_id", "category"))),
        "item_recency": days(F.max("day").over(before("customer_id", "item_id"))),
    })


def trailing_counts(events: DataFrame, days: tuple[int, ...] = (30, 90)) -> DataFrame:
    """Earlier events of the customer within so many days, both ends included.

    A range of days counts the whole last day; what comes at or after the event on its own day is taken off.
    """
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    out = events.withColumn("__day", number)
    same = W.partitionBy("customer_id", "__day").orderBy(*ORDER)
    later = F.count("*").over(W.partitionBy("customer_id", "__day")) - F.row_number().over(same) + 1
    for d in days:
        span = W.partitionBy("customer_id").orderBy("__day").rangeBetween(-d, 0)
        out = out.withColumn(f"recent_{d}", F.count("*").over(span) - later)
    return out.drop("__day")


def rolling_amounts(events: DataFrame, key: str, rows: int = 200) -> DataFrame:
    """Median and quartiles of the last rows amounts of the key, and the mean of all, before each event."""
    last = W.partitionBy(key).orderBy(*ORDER).rowsBetween(-rows, -1)
    return events.withColumns({
        "p25": F.coalesce(F.percentile("amount", 0.25).over(last), F.lit(0.0)),
        "median": F.coalesce(F.percentile("amount", 0.5).over(last), F.lit(0.0)),
        "p75": F.coalesce(F.percentile("amount", 0.75).over(last), F.lit(0.0)),
        "mean": F.coalesce(F.sum(F.col("amount").cast("decimal(18,2)")).over(before(key)).cast("double") / F.count("*").over(before(key)), F.lit(0.0)),
    })


def earlier(events: DataFrame, totals: DataFrame, name: str, *keys: str) -> DataFrame:
    """events with the number of earlier events of the same keys, for keys of many events: day totals first, so only one day's events of a key share a sort.

    totals: counts n by day and at least the keys.
    """
    running = W.partitionBy(*keys).orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.groupBy(*keys, "day").agg(F.sum("n").alias("n")).select(*keys, "day", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("__before"))
    placed = events.join(few(totals), [*keys, "day"])
    return placed.withColumn(name, F.col("__before") + F.row_number().over(W.partitionBy(*keys, "day").orderBy(*ORDER)) - 1).drop("__before")


def global_priors(events: DataFrame, rows: int = 0) -> DataFrame:
    """Popularity of item and category before each event: overall, in the customer's region, in the month of the year.

    Categories are few and their events many, so those counts go by day.  Events are dealt twice, by item and by category and day, which
    serves the other keys too.  rows: how many events there are at most.
    """
    events = events.withColumn("month", F.month("day"))
    totals = stored(events.groupBy("region", "month", "category", "day").agg(F.count("*").alias("n")))
    held = spread(events, rows, "item_id").withColumns({
        "item_popularity": F.count("*").over(before("item_id")),
        "region_item_popularity": F.count("*").over(before("region", "item_id")),
    })
    held = spread(held, rows, "category", "day")
    held = earlier(held, totals, "category_popularity", "category")
    held = earlier(held, totals, "region_category_popularity", "region", "category")
    return earlier(held, totals, "seasonal_popularity", "month", "category").drop("month")


def dominant_supplier(events: DataFrame) -> DataFrame:
    """The item's most frequent supplier before each event and its share.

    A supplier's count only grows, so the running maximum of (count, -supplier) over the item's events is the leader.
    """
    own = W.partitionBy("item_id", "supplier_id").orderBy(*ORDER)
    held = events.withColumn("__n", F.row_number().over(own))
    best = F.max(F.struct(F.col("__n").alias("n"), (-F.col("supplier_id")).alias("s"))).over(before("item_id"))
    total = F.count("*").over(before("item_id"))
    return held.withColumns({"__best": best, "__total": total}).select(
        *events.columns, (-F.col("__best.s")).alias("leading_supplier"), F.coalesce(F.col("__best.n") / F.nullif(F.col("__total"), F.lit(0)), F.lit(0.0)).alias("supplier_share")
    )


def emission_caps(events: DataFrame, per_user: int, total: int) -> DataFrame:
    """The events that per-customer and total caps let through in order: first each customer's first ones, then the first of those.

    The total rank is over the survivors alone.  Day totals first, so only one day's rows share a sort.
    """
    mine = events.withColumn("__place", F.row_number().over(W.partitionBy("customer_id").orderBy(*ORDER))).where(F.col("__place") <= per_user).drop("__place")
    by_day = mine.groupBy("day").agg(F.count("*").alias("n")).withColumn("__before", F.coalesce(F.sum("n").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    placed = mine.join(by_day, "day").withColumn("emitted", F.col("__before") + F.row_number().over(W.partitionBy("day").orderBy(*ORDER)))
    return placed.where(F.col("emitted") <= total).drop("__before")


# The weights of the rule score.
LEXICAL = {"query_name": 4.0, "query_category": 1.5, "query_attribute": 1.25, "query_coverage": 1.0, "exact_name": 0.75, "attribute_matches": 0.2}


def rule_score(c: dict[str, Column]) -> Column:
    """Lexical fit, affinity, price, popularity and structure of a candidate, from its features by name; those not given count as 0."""
    f = lambda name, default=0.0: c.get(name, F.lit(default))
    parts = [w * f(n) for n, w in LEXICAL.items()]
    parts += [1.8 * F.log1p(f("user_category")), 2.2 * f("category_share"), 2.8 * f("repeat")]
    parts += [1.4 * N.recency_boost(f("category_recency", 3650.0), 90.0), 1.2 * N.recency_boost(f("item_recency", 3650.0), 180.0)]
    parts += [0.9 * f("price_in_range"), 0.4 * F.greatest(F.lit(0.0), 1 - F.least(f("price_ratio"), F.lit(3.0)) / 3)]
    parts += [0.35 * F.log1p(f("item_popularity")), 0.25 * F.log1p(f("region_item_popularity")), 0.35 * F.log1p(f("similar_popularity")), 0.15 * F.log1p(f("recent_popularity"))]
    parts += [0.8 * f("supplier_affinity"), 0.35 * f("supplier_region"), 0.45 * f("kind_affinity")]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


# What explains a recommendation (code, feature, threshold, at most instead of at least).
REASONS = (
    ("QUERY_NAME_MATCH", "query_name", 0.6, False), ("USER_CATEGORY_AFFINITY", "category_share", 0.2, False), ("USER_REPEAT_BUY", "repeat", 0.5, False),
    ("RECENT_SIMILAR_PURCHASE", "category_recency", 45.0, True), ("SUPPLIER_AFFINITY", "supplier_affinity", 0.1, False), ("PRICE_IN_RANGE", "price_in_range", 0.5, False),
    ("REGIONAL_POPULARITY", "region_item_popularity", 1.0, False), ("SIMILAR_CUSTOMER_POPULARITY", "similar_popularity", 1.0, False),
)


def reasons(c: dict[str, Column], most: int = 3) -> Column:
    """Codes of the rules that hold, the largest feature first."""
    held = [F.when((c[n] <= t) if low else (c[n] >= t), F.struct((-c[n].cast("double")).alias("s"), F.lit(i).alias("i"), F.lit(code).alias("code"))) for i, (code, n, t, low) in enumerate(REASONS) if n in c]
    return F.transform(F.slice(F.array_sort(F.filter(F.array(*held), lambda x: x.isNotNull())), 1, most), lambda x: x["code"])
