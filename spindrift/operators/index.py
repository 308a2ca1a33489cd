"""A stored inverted index of products that grows by segments, and the best rows of each query by BM25.

Below its path lie

* ``rows``: each product with its tokens and stems, cut once, and its length in tokens,
* ``postings``: term, product, weighted frequency and length, in folders by block (a hash of the term's first two
  characters) and sorted by term, so a search opens the blocks of its prefixes and of those the row groups of its terms,
* ``terms``: the distinct terms, by block,
* ``segments``: one row a finished update.

An update writes the changed rows as a segment of their own and, last, its row in ``segments``; one that broke off is not
listed and so not read.  Of a product the row of the latest segment counts, and none if that segment removes it.  What older
segments say of it is left out when they are read, by a join with the few products that were written twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators.corpus import BROADCAST_ROWS
from spindrift.operators.shared import stored

# Weight of a token of each field, and how often the field's tokens count in a row's length (names and categories stand there twice, raw and normalised).
FIELDS = {"name": (3.7, 2), "category": (2.1, 2), "key_tokens": (0.7, 1)}
COLUMNS = ("name", "category", "attributes", "key_tokens")
BLOCKS = 256
K1, B, LEAST_RATE = 1.2, 0.75, 1e-6


def block(term: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(term, 1, 2)), F.lit(BLOCKS)).cast("int")


def prepared(rows: DataFrame) -> DataFrame:
    """Products with the tokens and stems of each field, all distinct tokens (said) and their length."""
    out = rows.select("item_id", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in COLUMNS])
    out = out.withColumns({f"{c}_words": T.tokenize(F.col(c)) for c in FIELDS})
    out = out.withColumns({f"{c}_stems": T.stem_tokens(F.col(f"{c}_words")) for c in FIELDS})
    length = sum((F.size(f"{c}_words") * times for c, (_, times) in FIELDS.items()), F.lit(0))
    return out.withColumns({"said": F.array_distinct(F.concat(*[f"{c}_words" for c in FIELDS])), "length": length})


def postings_of(rows: DataFrame) -> DataFrame:
    """term, item_id, tf (weights of its fields summed), length, block; made row by row, without a shuffle."""
    tf = lambda t: sum((F.size(F.filter(f"{c}_words", lambda w: w == t)) * F.lit(weight) for c, (weight, _) in FIELDS.items()), F.lit(0.0))
    held = rows.select("item_id", "length", F.inline(F.transform("said", lambda t: F.struct(t.alias("term"), tf(t).alias("tf")))))
    return held.select("term", "item_id", "tf", "length", block(F.col("term")).alias("block"))


def union_of(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.unionByName(b)


@dataclass
class Catalog:
    """A stored index as of its segments when it was opened."""

    spark: SparkSession
    path: str
    segments: list[int]

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Catalog:
        return cls(spark, path, sorted(r[0] for r in spark.read.parquet(f"{path}/segments").select("segment").distinct().collect()))

    @classmethod
    def create(cls, rows: DataFrame, path: str) -> Catalog:
        """A new index of rows (item_id, name, category, attributes, key_tokens; item_id unique, without nulls)."""
        return cls(rows.sparkSession, path, []).update(rows)

    def update(self, rows: DataFrame, removed: DataFrame | None = None) -> Catalog:
        """The index with these rows in place of what it held of them, and without the removed ones (item_id)."""
        segment = max(self.segments, default=-1) + 1
        put = lambda df, name, *by: df.withColumn("segment", F.lit(segment)).write.partitionBy("segment", *by).mode("append").parquet(f"{self.path}/{name}")
        live = prepared(rows.where("item_id IS NOT NULL")).withColumn("gone", F.lit(False))
        if removed is not None:
            live = live.unionByName(removed.select("item_id", F.lit(True).alias("gone")).where("item_id IS NOT NULL").join(rows.select("item_id"), "item_id", "left_anti"), allowMissingColumns=True)
        put(live, "rows")
        written = self.spark.read.parquet(f"{self.path}/rows").where(F.col("segment") == segment)
        live = written.where("NOT gone")
        put(postings_of(live).repartitionByRange("block", "term").sortWithinPartitions("block", "term"), "postings", "block")
        put(live.select(F.explode("said").alias("term")).distinct().withColumn("block", block(F.col("term"))).repartition("block"), "terms", "block")
        self.spark.createDataFrame([(segment,)], "segment int").coalesce(1).write.mode("append").parquet(f"{self.path}/segments")
        return Catalog(self.spark, self.path, [*self.segments, segment])

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}").where(F.col("segment").isin(self.segments))

    def stale(self) -> DataFrame | None:
        """item_id, segment: rows that a later segment replaces or removes, and removals themselves."""
        if len(self.segments) < 2:
            return None
        order = W.partitionBy("item_id").orderBy(F.desc("segment"))
        return self.read("rows").select("item_id", "segment", "gone").withColumn("place", F.row_number().over(order)).where("place > 1 OR gone").select("item_id", "segment")

    def current(self, held: DataFrame) -> DataFrame:
        old = self.stale()
        if old is None:
            return held
        return held.join(F.broadcast(old) if old.count() <= BROADCAST_ROWS else old, ["item_id", "segment"], "left_anti")

    def rows(self) -> DataFrame:
        """The products as they are now."""
        return self.current(self.read("rows")).drop("segment", "gone")

    def postings(self, blocks: list[int] | None = None) -> DataFrame:
        """term, item_id, tf, length of the blocks asked for (all by default): other folders aren't opened."""
        held = self.read("postings")
        return self.current(held if blocks is None else held.where(F.col("block").isin(blocks))).select("term", "item_id", "tf", "length")

    def compact(self, path: str) -> Catalog:
        """The same products as a new index of one segment."""
        return Catalog.create(self.rows().select("item_id", *COLUMNS), path)

    def size(self) -> tuple[int, float]:
        """Number of products and their mean length."""
        n, mean = self.rows().agg(F.count("*"), F.avg("length")).first()
        return n, mean or 0.0

    def hits(self, prefixes: DataFrame) -> DataFrame:
        """prefix, item_id, tf, length: products that hold terms which begin with a prefix, the frequencies of its terms summed.  prefixes: prefix, distinct."""
        sizes = [r[0] for r in prefixes.select(F.length("prefix").alias("n")).where("n > 0").distinct().orderBy("n").collect()]  # a few dozen
        if not sizes:
            return self.postings([]).groupBy(F.col("term").alias("prefix"), "item_id").agg(F.sum("tf").alias("tf"), F.max("length").alias("length"))
        blocks = None if sizes[0] < 2 else [r[0] for r in prefixes.select(block(F.col("prefix"))).distinct().collect()]  # at most BLOCKS
        terms = self.read("terms") if blocks is None else self.read("terms").where(F.col("block").isin(blocks))
        starts = terms.select("term").distinct().select("term", F.explode(F.array_distinct(F.transform(F.array(*[F.lit(n) for n in sizes]), lambda n: F.substr("term", F.lit(1), n)))).alias("prefix"))
        known = starts.join(prefixes, "prefix", "left_semi")
        held = self.postings(blocks).join(known, "term")
        return held.groupBy("prefix", "item_id").agg(F.sum("tf").alias("tf"), F.max("length").alias("length"))


def best_rows(hits: DataFrame, asked: DataFrame, total: int, mean: float, top: int) -> DataFrame:
    """query_id, item_id, score, rank of the best rows of each query by BM25.  hits: see ``Catalog.hits``.  asked: query_id, prefix, distinct.

    The rate of a prefix is ln((N - n + .5) / (n + .5)), at least a tiny number, n being the rows that hold it.  A query's common prefixes
    only add to rows that a rarer one brings in, as soon as all of them together stay below the score of the top-th row
    of a single prefix; so frequent words meet the rows of rare ones, not all of theirs.  Queries of the same prefixes are one question, and
    rows that hold the same prefixes equally often at the same length are one until the page is made, of which top rows at most stand in it.
    """
    sets = stored(asked.groupBy("query_id").agg(F.array_sort(F.collect_set("prefix")).alias("set")))
    first = sets.groupBy("set").agg(F.min("query_id").alias("first"))
    askers = sets.join(first, "set").select("query_id", "first")
    asked = first.select(F.col("first").alias("query_id"), F.explode("set").alias("prefix"))
    alike = stored(hits.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("prefix", "tf"))).alias("held"), F.max("length").alias("length")))
    kinds = stored(alike.groupBy("held", "length").agg(F.min("item_id").alias("kind"), F.count("*").alias("rows")))
    same = W.partitionBy("held", "length").orderBy("item_id")
    members = alike.withColumn("place", F.row_number().over(same)).where(F.col("place") <= top).join(kinds, ["held", "length"]).select("kind", "item_id")
    norm = (1 - B + B * F.col("length") / mean) if mean else F.lit(1.0)
    scored = kinds.select(F.inline("held"), "length", "kind", "rows").select("prefix", "kind", "rows", (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * norm)).alias("part"))
    order = W.partitionBy("prefix").orderBy(F.desc("part"))
    most = scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    floors = most.withColumn("so_far", F.sum("rows").over(order)).where(F.col("so_far") >= top).groupBy("prefix").agg(F.max("part").alias("least"))
    seen = scored.groupBy("prefix").agg(F.sum("rows").alias("n"), F.max("part").alias("most"))
    rate = F.greatest(F.log((total - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(LEAST_RATE))
    words = seen.join(floors, "prefix", "left").withColumn("rate", rate)
    words = asked.join(words, "prefix").select("query_id", "prefix", "rate", (F.col("rate") * F.col("most")).alias("most"), (F.col("rate") * F.coalesce("least", F.lit(0.0))).alias("least"))
    own = W.partitionBy("query_id")
    below = F.sum("most").over(own.orderBy("most", "prefix"))
    # a small margin, as sums differ in their last digits
    words = words.withColumn("brings", below >= F.max("least").over(own) * (1 - 1e-9)).select("query_id", "prefix", "rate", "brings")
    bring = scored.join(words.where("brings"), "prefix").select("query_id", "kind", "prefix", (F.col("rate") * F.col("part")).alias("score"))
    rows = bring.select("query_id", "kind").distinct()
    add = rows.join(words.where("NOT brings"), "query_id").join(scored, ["prefix", "kind"]).select("query_id", "kind", "prefix", (F.col("rate") * F.col("part")).alias("score"))
    sums = bring.unionByName(add).groupBy("query_id", "kind").agg(F.round(F.sum("score"), 6).alias("score"))
    # each kind before another has a row before all of the other's
    best = sums.withColumn("place", F.row_number().over(own.orderBy(F.desc("score"), "kind"))).where(F.col("place") <= top).join(kinds.select("kind", "rows"), "kind")
    better = F.sum("rows").over(own.orderBy(F.desc("score")).rangeBetween(W.unboundedPreceding, W.currentRow)) - F.sum("rows").over(W.partitionBy("query_id", "score"))
    shown = best.withColumn("better", better).where(F.col("better") < top).join(members, "kind")
    place = F.row_number().over(own.orderBy(F.desc("score"), "item_id"))
    page = shown.select("query_id", "item_id", "score").withColumn("rank", place).where(F.col("rank") <= top)
    return page.withColumnRenamed("query_id", "first").join(askers, "first").select("query_id", "item_id", "score", "rank")
