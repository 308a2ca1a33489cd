"""How filters act on each other in every order, by a trie of permutations.

Each path of the trie from its root is an order in which filters are applied.  What stands
after a prefix depends on the filters in it, not on their order, so the states are the sets
of filters.  ``walk`` goes depth first: it applies a filter to the survivors of a state,
persists the new survivors, counts at each edge onwards how many of them the next filter
removes, and remembers the state; a prefix that leads to a state which is remembered shares
its counts.  Survivors are given up on the way back, so at most as many states are persisted
as there are filters.  Five filters have 325 prefixes, 32 states and 80 edges.

Filters are judged once, on whole texts; the trie works on the verdicts, which are written
as a table.  Counts are kept by part and stay distributed; only the orders, of which the
filters alone decide the number, are made on the driver.

A filter is a column that is true where a row fails; null counts as passing.  A null text is
empty, a null part is the empty string.  "Identical to an earlier text" holds
for rows whose doc_id is greater than the least one with the same text in the whole table;
a row without an id neither fails it nor counts as earlier.  Rows that repeat count each.
A document is good (toxic) if any label of its id says so.  An empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import UPPER, left_join, materialise, scratch_path

WORD = r"[^\x20\x09-\x0D]+"
MOST_FILTERS = 7  # 5040 orders a part


def text_filters(text: Column) -> dict[str, Column]:
    """The filters A to D; a column is true where the text fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def judged(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, good, toxic and a boolean for each of the filters A to E of every row of docs; written as a table."""
    own = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    given = docs.select(F.col(f"`{ident}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), own.alias("text"))
    verdicts = given.select("id", "part", F.sha2("text", 256).alias("same"), *[c.alias(f) for f, c in text_filters(F.col("text")).items()])
    verdicts = materialise(verdicts, "verdicts")
    earliest = verdicts.where("id IS NOT NULL").groupBy("same").agg(F.min("id").alias("first"), F.count("*").alias("m")).where("m > 1").select("same", "first")
    verdicts = left_join(verdicts, materialise(earliest, "earliest"), "same")
    told = labels.select(F.col("doc_id").cast("long").alias("id"), "quality", "toxic").where("id IS NOT NULL")
    told = told.groupBy("id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    verdicts = left_join(verdicts, materialise(told, "told"), "id")
    known = lambda c: F.coalesce(c, F.lit(False))
    return materialise(verdicts.select("part", known(F.col("good")).alias("good"), known(F.col("toxic")).alias("toxic"), *"ABCD", known(F.col("id") > F.col("first")).alias("E")), "judged")


def walk(rows: DataFrame, filters: str, path: str) -> None:
    """Depth first through the trie; appends to path, for each state and part, the survivors and, for each filter not yet applied, what it removes.

    Columns: part, state (filters applied, in the order of ``filters``), n, and edges (filter, removed, good_lost, toxic_lost).
    """
    known: set[str] = set()

    def visit(state: str, survivors: DataFrame) -> None:
        known.add(state)
        left = [f for f in filters if f not in state]
        if not left:
            return
        survivors = survivors.persist()
        try:
            fails = {f: F.col(f"`{f}`") for f in left}
            counts = [F.count("*").alias("n")]
            for f, c in fails.items():
                counts += [F.count_if(c).alias(f"{f}r"), F.count_if(c & F.col("good")).alias(f"{f}g"), F.count_if(c & F.col("toxic")).alias(f"{f}t")]
            edges = F.array(*[F.struct(F.lit(f).alias("filter"), F.col(f"{f}r").alias("removed"), F.col(f"{f}g").alias("good_lost"), F.col(f"{f}t").alias("toxic_lost")) for f in left])
            survivors.groupBy("part").agg(*counts).select("part", F.lit(state).alias("state"), "n", edges.alias("edges")).write.mode("append").parquet(path)
            for f in left:
                after = "".join(g for g in filters if g in state or g == f)
                if after not in known:
                    visit(after, survivors.where(~fails[f]))
        finally:
            survivors.unpersist()

    visit("", rows)


COUNTS = "part string, state string, n bigint, edges array<struct<filter: string, removed: bigint, good_lost: bigint, toxic_lost: bigint>>"


def audit(rows: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """A row a part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    rows: part, good, toxic and a boolean column for each filter, true where the row fails.  redundant: fails the
    filter but was removed earlier.  unique_fails: fails this filter alone.  shapley: what the filter removes, over all orders.
    """
    if not 0 < len(filters) <= MOST_FILTERS or len(set(filters)) < len(filters):
        raise ValueError(f"1 to {MOST_FILTERS} filters, each named by a letter of its own")
    spark, k = rows.sparkSession, len(filters)
    rows = rows.select("part", "good", "toxic", *[F.coalesce(F.col(f"`{f}`"), F.lit(False)).alias(f) for f in filters])
    path = scratch_path(spark, "trie")
    walk(rows, filters, path)
    counts = spark.read.schema(COUNTS).parquet(path)
    edges = counts.select("part", "state", "n", F.inline("edges"))
    # what holds for a part and filter whatever the order
    ways = F.element_at(F.array(*[F.lit(factorial(i) * factorial(k - 1 - i)) for i in range(k)]), F.length("state") + 1)
    whole = edges.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("state") == "", F.col("removed"))).alias("fails"),
        F.coalesce(F.sum(F.when(F.length("state") == k - 1, F.col("removed"))), F.lit(0)).alias("unique_fails"),
        F.sum(F.col("removed") * ways).alias("shapley"),
    )
    steps = [(o, i + 1, f, "".join(g for g in filters if g in o[:i])) for o in map("".join, permutations(filters)) for i, f in enumerate(o)]
    steps = spark.createDataFrame(steps, "filter_order string, step int, filter string, state string")
    due = whole.join(F.broadcast(steps), "filter")
    # a part without survivors has no row in a state
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return due.join(edges, ["part", "state", "filter"], "left").select(
        "part", "filter_order", "step", (zero("n") - zero("removed")).alias("kept"), zero("removed").alias("removed"), (zero("fails") - zero("removed")).alias("redundant"),
        zero("unique_fails").alias("unique_fails"), zero("good_lost").alias("good_lost"), zero("toxic_lost").alias("toxic_lost"), zero("shapley").alias("shapley"),
    )
