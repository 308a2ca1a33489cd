"""As-of joins, and ledgers: running totals of many facts, one version a key and day that changed it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def asof_join(left: DataFrame, right: DataFrame, on: list[str], at: str, since: str) -> DataFrame:
    """left with the other columns of right's latest row of the same key that is valid since ``at`` or earlier; nulls if there is none.

    The answer depends on key and time alone, so each distinct pair is asked once: a key with many rows of left has no more
    questions than times.  Questions and versions meet in one window a key; the answers go back by an equi-join.
    Null keys and times match nothing.  right: at most one row a key and time.
    """
    values = [c for c in right.columns if c not in (*on, since)]
    asked = left.select(*on, at).dropna().distinct()
    held = F.struct(*values)
    versions = right.select(*on, F.col(since).alias(at), F.lit(0).alias("__asked"), held.alias("__held"))
    both = versions.unionByName(asked.withColumn("__asked", F.lit(1)), allowMissingColumns=True)
    order = W.partitionBy(*on).orderBy(at, "__asked").rowsBetween(W.unboundedPreceding, W.currentRow)
    told = both.withColumn("__held", F.last("__held", ignorenulls=True).over(order)).where("__asked = 1 AND __held IS NOT NULL").select(*on, at, "__held.*")
    return left.join(told, [*on, at], "left")


def key(*columns: str) -> Column:
    """The columns as one string; null if any is."""
    held = [F.col(c).cast("string") for c in columns]
    return F.when(~F.greatest(*[h.isNull() for h in held], F.lit(False)), F.concat_ws(SEPARATOR, *held))


def day_totals(lines: DataFrame, facts: dict[str, tuple[str, ...]]) -> DataFrame:
    """fact, key, day, n, total, low: purchases of each key of each fact by day; partial sums leave the map side, so a key's rows never meet.

    facts: the columns that make a fact's key.  low: the least amount and its supplier.  Lines without a day or part of the key are left out.
    """
    each = F.array(*[F.struct(F.lit(name).alias("fact"), key(*columns).alias("key")) for name, columns in facts.items()])
    cents = F.col("amount").cast("decimal(18,2)").alias("cents")
    rows = lines.where("day IS NOT NULL").select(F.inline(each), "day", cents, F.struct("amount", "supplier_id").alias("offer")).where("key IS NOT NULL")
    return rows.groupBy("fact", "key", "day").agg(F.count("*").alias("n"), F.sum("cents").alias("total"), F.min("offer").alias("low"))


def ledger(totals: DataFrame) -> DataFrame:
    """fact, key, since, n, total, last_day, low: what is known of a key from the day after each of its days on."""
    order = W.partitionBy("fact", "key").orderBy("day").rowsBetween(W.unboundedPreceding, W.currentRow)
    return totals.select(
        "fact", "key", F.date_add("day", 1).alias("since"), F.sum("n").over(order).alias("n"), F.sum("total").over(order).cast("decimal(28,2)").alias("total"),
        F.col("day").alias("last_day"), F.min("low").over(order).alias("low"),
    )


def extended(old: DataFrame, totals: DataFrame) -> DataFrame:
    """The versions that the totals of later days add to a ledger: its own running totals on top of each key's last version."""
    last = old.groupBy("fact", "key").agg(F.max_by(F.struct("n", "total", "low"), "since").alias("__old"))
    new = ledger(totals).join(last, ["fact", "key"], "left")
    more = lambda c: F.col(c) + F.coalesce(F.col(f"__old.{c}"), F.lit(0))
    return new.select("fact", "key", "since", more("n").alias("n"), more("total").cast("decimal(28,2)").alias("total"), "last_day", F.least("low", "__old.low").alias("low"))


def save(versions: DataFrame, path: str, mode: str = "append") -> None:
    """Adds versions to a stored ledger, a folder a fact, so that readers of one fact open its files alone."""
    versions.write.partitionBy("fact").mode(mode).parquet(path)


def known(rows: DataFrame, ident: list[str], at: str, questions: dict[str, tuple[str, tuple[str, ...], int]], versions: DataFrame) -> DataFrame:
    """rows with a struct (n, total, last_day, low) a question, from a ledger as of their day.

    questions: name -> (fact, columns of rows that make its key, days to go back).  All questions are put as rows of one
    as-of join, whatever the facts; ident: what makes rows unique.
    """
    each = F.array(*[F.struct(F.lit(name).alias("question"), F.lit(fact).alias("fact"), key(*columns).alias("key"), F.date_sub(at, back).alias("on")) for name, (fact, columns, back) in questions.items()])
    asked = rows.select(*ident, F.inline(each))
    told = asof_join(asked, versions, ["fact", "key"], "on", "since")
    held = F.struct("n", F.col("total").cast("double").alias("total"), "last_day", "low")
    wide = told.where("n IS NOT NULL").groupBy(*ident).agg(*[F.max(F.when(F.col("question") == name, held)).alias(name) for name in questions])
    return rows.join(wide, ident, "left")
