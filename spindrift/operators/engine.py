"""Queries analysed against a product index, and how alike texts are when related words count.

All queries of a batch run together; every step is a join or an aggregation by query.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import numbers as N
from spindrift.functions import text as T
from spindrift.operators import corpus as C
from spindrift.operators import rewrite as R
from spindrift.operators.dense import Dense
from spindrift.operators.index import Catalog
from spindrift.operators.shared import shared_path, stored


def none() -> Column:
    return F.array().cast("array<string>")


@dataclass
class Index:
    """What a search needs: the stored products, words, related words, synonyms, how many products there are and how long they are."""

    store: Catalog
    catalog: DataFrame
    vocabulary: DataFrame
    edges: DataFrame
    dictionary: DataFrame
    total: int
    mean: float
    dense: Dense | None = None


def stored_words() -> Column:
    """All tokens of a stored product, with repeats, as they were cut when it was written."""
    return F.concat(*[f"{c}_words" for c in ("name", "category", "key_tokens")])


def rebuild_words(store: Catalog) -> None:
    """Writes the frequencies of the products' words anew, and nothing else."""
    C.word_frequency(store.rows(), stored_words()).write.mode("overwrite").parquet(f"{store.path}/vocabulary")


def rebuild_edges(store: Catalog, least_frequency: int = 10) -> None:
    """Writes the graph of related words anew, and nothing else."""
    C.word_cooccurrence(store.rows(), "item_id", stored_words(), least_frequency).write.mode("overwrite").parquet(f"{store.path}/edges")


def rebuild_dictionary(store: Catalog, dictionary: DataFrame) -> None:
    """Writes the synonyms (source, target) anew, and nothing else."""
    dictionary.select("source", "target").write.mode("overwrite").parquet(f"{store.path}/dictionary")


def opened(spark, path: str) -> Index:
    """The index that ``built`` stored; dense vectors serve if they fit it."""
    store = Catalog.open(spark, path)
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return Index(store, store.rows(), read("vocabulary"), read("edges"), read("dictionary"), *store.size(), dense=Dense.open(spark, path))


def built(catalog: DataFrame, dictionary: DataFrame, least_frequency: int = 10, path: str | None = None) -> Index:
    """The index of products with name, category, attributes (keys between bars) and key_tokens, stored below path (a fresh one by default)."""
    path = path or shared_path(catalog.sparkSession, "index")
    store = Catalog.create(catalog, path)
    rebuild_words(store)
    rebuild_edges(store, least_frequency)
    rebuild_dictionary(store, dictionary)
    return opened(catalog.sparkSession, path)


def inflection_only(a: Column, b: Column) -> Column:
    """Two Russian words of over four letters that differ in their ending alone."""
    russian = lambda c: c.rlike("^[а-я]{5,}$")
    return (a != b) & russian(a) & russian(b) & (T.stem(a) == T.stem(b))


def gathered(rows: DataFrame, value: str, *order: str) -> DataFrame:
    """query_id, value: the distinct values of each query in order."""
    listed = F.array_sort(F.collect_list(F.struct(*order, value)))
    return rows.groupBy("query_id").agg(F.array_distinct(F.transform(listed, lambda x: x[value])).alias(value))


def analyze(queries: DataFrame, index: Index) -> DataFrame:
    """Of each query (query_id, query): its tokens, the corrected ones, completions, synonyms and related tokens, stems of all, value and unit pairs.

    Equal queries are one until the end.
    """
    askers = queries.select("query_id", "query")
    asked = askers.groupBy("query").agg(F.min("query_id").alias("query_id"))
    asked = asked.select("query_id", "query", T.normalize_text(F.col("query")).alias("normalized"), T.normalize_tokens(T.tokenize(F.col("query"))).alias("tokens"))
    words = asked.select("query_id", F.posexplode("tokens").alias("at", "token"))
    known = index.dictionary.select(F.col("source").alias("token")).where(~F.contains("token", F.lit(" "))).distinct()
    better = R.corrections(R.correction_candidates(words.join(known, "token", "left_anti"), index.vocabulary)).where(~inflection_only(F.col("token"), F.col("candidate")))
    fixed = words.join(better.select("token", "candidate"), "token", "left").select("query_id", "at", F.coalesce("candidate", "token").alias("corrected"))
    corrected = stored(gathered(fixed, "corrected", "at"))
    each = corrected.select("query_id", F.posexplode("corrected").alias("at", "token"))
    ends = R.completions(each.select(F.col("token").alias("prefix")), index.vocabulary).select(F.col("prefix").alias("token"), F.col("token").alias("value"), "rank")
    said = R.synonyms(corrected.select("query_id", F.col("corrected").alias("tokens")), index.dictionary)
    said = said.select("query_id", "source", F.posexplode(T.tokenize(F.col("target"))).alias("at", "value"))
    near = R.related(each.select("query_id", "token"), index.edges, index.vocabulary, index.total)
    # the parts as rows of one kind each, so that they meet in one aggregation
    part = lambda rows, kind, *order: rows.select("query_id", F.lit(kind).alias("kind"), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col("value")).alias("held"))
    zero, no = F.lit(0.0), F.lit("")
    parts = part(each.join(ends, "token"), "completions", no, F.col("at").cast("double"), F.col("rank").cast("double"))
    parts = parts.unionByName(part(said, "synonyms", F.col("source"), F.col("at").cast("double"), zero))
    parts = parts.unionByName(part(near.withColumnRenamed("neighbor", "value"), "related", no, -F.col("score"), zero))
    kinds = ("completions", "synonyms", "related")
    lists = [F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("held")))), lambda x: x["value"])).alias(k) for k in kinds]
    out = asked.join(corrected, "query_id", "left").join(parts.groupBy("query_id").agg(*lists), "query_id", "left")
    out = out.withColumns({c: F.coalesce(c, none()) for c in ("corrected", "completions", "synonyms", "related")})
    lexical = F.array_distinct(F.concat("corrected", "synonyms", "completions"))
    out = out.withColumns({
        "corrected_query": F.array_join("corrected", " "), "stems": T.stem_tokens(F.col("corrected")), "lexical_stems": T.stem_tokens(lexical),
        "expanded_stems": T.stem_tokens(F.array_distinct(F.concat(lexical, "related"))), "related_stems": T.stem_tokens(F.col("related")), "spans": T.attribute_spans(F.col("query")),
        "broad": T.needs_broad_retrieval(F.col("corrected"), F.size("completions") > 0),
    })
    return askers.withColumnRenamed("query", "said").join(out.drop("query_id"), F.col("said").eqNullSafe(F.col("query"))).drop("said")


def likeness(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """l, r, like of token pairs (l, r) that are alike at all: of one stem, of nearly the same n-grams, or related by an edge."""
    there = edges.select(F.col("token").alias("l"), F.col("neighbor").alias("r"), F.col("score").alias("there"))
    back = edges.select(F.col("neighbor").alias("l"), F.col("token").alias("r"), F.col("score").alias("back"))
    held = pairs.join(there, ["l", "r"], "left").join(back, ["l", "r"], "left")
    surface = T.jaccard(T.char_ngrams(F.col("l")), T.char_ngrams(F.col("r")))
    edge = F.greatest(F.coalesce("there", F.lit(0.0)), F.coalesce("back", F.lit(0.0)))
    like = F.greatest(F.when(surface >= 0.82, F.least(F.lit(0.96), 0.55 + 0.45 * surface)).otherwise(0.0), F.when(edge > 0, F.least(F.lit(0.88), 0.22 + 1.8 * edge)).otherwise(0.0))
    return held.select("l", "r", F.when(T.stem(F.col("l")) == T.stem(F.col("r")), 1.0).otherwise(like).alias("like")).where("like > 0")


def soft_overlaps(pairs: DataFrame, edges: DataFrame, vocabulary: DataFrame, total: int) -> DataFrame:
    """query_id, item_id, overlap: the mean of both ways' share of tokens (by inverse frequency) that the other text has something like.

    pairs: query_id, item_id, left, right (arrays of distinct tokens).  Each pair of tokens is compared once.  What a text's tokens are like and
    weigh goes to the text, one row a distinct text; the overlap is then a matter of one row.
    """
    words = pairs.select(F.explode("left").alias("l"), "right").select("l", F.explode("right").alias("r")).distinct()
    like = likeness(words, edges).groupBy("l").agg(F.map_from_entries(F.collect_list(F.struct("r", "like"))).alias("like"))
    weight = vocabulary.select("token", "frequency")

    def weighed(side: str) -> DataFrame:
        each = pairs.select(side).distinct().withColumn("text", F.xxhash64(side)).select("text", side, F.explode(side).alias("token")).join(weight, "token", "left")
        return each.withColumn("w", N.idf(F.coalesce("frequency", F.lit(0)), F.lit(float(total))))

    # the map of a token that is like nothing is null, and so is what is looked up in it
    left = weighed("left").join(like.withColumnRenamed("l", "token"), "token", "left").groupBy("left").agg(F.collect_list(F.struct("w", "like")).alias("held"))
    right = weighed("right").groupBy("right").agg(F.collect_list(F.struct("token", "w")).alias("words"))
    full = pairs.join(left, "left").join(right, "right")
    found = lambda e, r: F.coalesce(F.try_element_at(e["like"], r["token"]), F.lit(0.0))
    best_right = lambda e: F.array_max(F.transform("words", lambda r: found(e, r)))
    best_left = lambda r: F.array_max(F.transform("held", lambda e: found(e, r)))
    mean = lambda items, best: F.aggregate(items, F.lit(0.0), lambda s, e: s + e["w"] * best(e)) / F.aggregate(items, F.lit(0.0), lambda s, e: s + e["w"])
    return full.select("query_id", "item_id", ((mean("held", best_right) + mean("words", best_left)) / 2).alias("overlap"))
