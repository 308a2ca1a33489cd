"""Token statistics, the co-occurrence graph, the inverted index and BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators.shared import written
from spindrift.operators.tiles import neighbors_by_tiles

#: A side of a join is broadcast only if its counted rows are at most this many.
BROADCAST_ROWS = 1_000_000
#: Prefixes meet terms by so many first characters, then as wholes.
BLOCK = 3
#: Of so many words all pairs are kept by each task that counts them.
FEW_WORDS = 1_000


def token_frequency(rows: DataFrame, *columns: str, least: int = 2) -> DataFrame:
    """token, first_char, token_length, frequency, counted with repeats over the text columns."""
    return word_frequency(rows, F.concat(*[T.tokenize(F.col(c)) for c in columns]), least)


def word_frequency(rows: DataFrame, tokens: Column, least: int = 2) -> DataFrame:
    """The same of texts that are cut into tokens already."""
    counts = rows.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("frequency"))
    return counts.where(F.length("token") >= least).select("token", F.substring("token", 1, 1).alias("first_char"), F.length("token").cast("long").alias("token_length"), "frequency")


def words_once(rows: DataFrame, ident: str, *columns: str) -> DataFrame:
    """row, part, tokens: the tokens of text columns with repeats, cut once and stored; part: the task that cut them."""
    tokens = F.array_join(F.concat(*[T.tokenize(F.col(c)) for c in columns]), " ")
    held = written(rows.select(F.col(ident).alias("row"), F.spark_partition_id().alias("part"), tokens.alias("words")), "words")
    return held.select("row", "part", F.when(F.col("words") == "", F.array().cast("array<string>")).otherwise(F.split("words", " ")).alias("tokens"))


def cooccurrence(rows: DataFrame, ident: str, columns: list[str], least_frequency: int = 10, neighbors: int = 8) -> DataFrame:
    """token, neighbor, score, cooccurrence of the tokens of text columns, see ``word_cooccurrence``."""
    return word_cooccurrence(words_once(rows, ident, *columns), "row", F.col("tokens"), least_frequency, neighbors)


def word_cooccurrence(rows: DataFrame, ident: str, tokens: Column, least_frequency: int = 10, neighbors: int = 8, words: DataFrame | None = None) -> DataFrame:
    """token, neighbor, score, cooccurrence: each token's best neighbours, computed once.  words: token and frequency of all of three characters and more, if known.

    All distinct vocabulary tokens of a row are paired.  The score relates joint to single
    frequencies and adds a share of the tokens' n-gram similarity.  Pairs of few words are
    counted where the rows stand, those of many by ``tiles``.
    """
    words = word_frequency(rows, tokens, 3) if words is None else words
    vocabulary = words.where(~F.col("token").rlike(r"^\d+$") & (F.col("frequency") >= least_frequency)).select("token", "frequency")
    vocabulary = vocabulary.cache()  # of words, not of rows; counted before it is broadcast
    known, total = vocabulary.agg(F.count("*"), F.coalesce(F.sum("frequency"), F.lit(0))).first()
    near = F.broadcast if known <= BROADCAST_ROWS else lambda df: df
    least = max(1, min(2, least_frequency))
    held = rows.select(F.col(ident).alias("row"), F.explode(F.array_distinct(tokens)).alias("token"))
    if known <= FEW_WORDS:
        whole = held.join(near(vocabulary), "token").groupBy("row").agg(F.collect_set(F.struct("frequency", "token")).alias("held"))
        pairs = whole.select(F.explode("held").alias("a"), "held").select("a", F.explode("held").alias("b")).where("a.token <> b.token")
        counts = pairs.groupBy(F.col("a.token").alias("token"), F.col("b.token").alias("neighbor"), F.col("a.frequency").alias("f"), F.col("b.frequency").alias("g")).agg(F.count("*").alias("cooccurrence"))
        score = F.col("cooccurrence") / F.sqrt(F.col("f").cast("double") * F.col("g")) + 0.2 * T.jaccard(T.char_ngrams(F.col("token")), T.char_ngrams(F.col("neighbor")))
        scored = counts.where(F.col("cooccurrence") >= least).withColumn("score", score).where(F.col("score") > 0.05)
    else:
        scored = neighbors_by_tiles(vocabulary, held, total, neighbors, least, near)
    order = W.partitionBy("token").orderBy(F.desc("score"), F.desc("cooccurrence"), F.desc("g"), F.desc("neighbor"))
    return written(scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= neighbors).select("token", "neighbor", "score", "cooccurrence"), "edges")


def postings(rows: DataFrame, ident: str, fields: list[str], prefixes: DataFrame | None = None) -> DataFrame:
    """term, field, row, tf, length: the inverted index with the field's length in tokens.

    With prefixes (a column prefix, few, counted), only of terms that start with one: others are dropped before anything is shuffled.
    """
    parts = []
    wanted = prefixes and prefixes.select("prefix", F.substring("prefix", 1, BLOCK).alias("block")).distinct()
    if prefixes and prefixes.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    for f in fields:
        cut = rows.select(F.col(ident).alias("row"), T.tokenize(F.col(f)).alias("tokens"))
        held = cut.select("row", F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
        if wanted:
            held = held.join(wanted, (F.substring("term", 1, BLOCK) == F.col("block")) & F.startswith("term", F.col("prefix")), "left_semi")
        parts.append(held.groupBy("term", "row", "length").agg(F.count("*").alias("tf")).withColumn("field", F.lit(f)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("term", "field", "row", "tf", "length")


def field_stats(rows: DataFrame, fields: list[str]) -> DataFrame:
    """field, n, average length: one row a field."""
    sizes = [F.struct(F.lit(f).alias("field"), F.size(T.tokenize(F.col(f))).alias("length")) for f in fields]
    held = rows.select(F.explode(F.array(*sizes)).alias("s")).select("s.*")
    return held.groupBy("field").agg(F.count("*").alias("n"), F.avg("length").alias("average"))


def bm25(index: DataFrame, stats: DataFrame, queries: DataFrame, weights: dict[str, float], top: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, row, score, rank of the best rows of each query.

    queries: query_id, prefix.  A term that starts with a prefix is a hit; document
    frequencies are those of the prefix over all fields.  Prefixes meet terms by their
    first three characters, then as wholes.
    """
    asked = queries.select("query_id", "prefix").distinct().withColumn("block", F.substring("prefix", 1, BLOCK))
    wanted = index.withColumn("block", F.substring("term", 1, BLOCK))
    hits = wanted.join(asked, "block").where(F.startswith("term", F.col("prefix")))
    whole = hits.groupBy("query_id", "prefix", "row", "field", "length").agg(F.sum("tf").alias("tf"))
    seen = whole.groupBy("query_id", "prefix").agg(F.count_distinct("row").alias("df"))
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    held = whole.join(F.broadcast(stats), "field").join(seen, ["query_id", "prefix"])  # stats has a row a field
    tf = F.col("tf") / (1 - b + b * F.col("length") / F.col("average")) * weight[F.col("field")]
    merged = held.groupBy("query_id", "prefix", "row", "df", "n").agg(F.sum(tf).alias("tf"))
    rate = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    scored = merged.withColumn("part", rate * F.col("tf") * (k1 + 1) / (F.col("tf") + k1)).groupBy("query_id", "row").agg(F.sum("part").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "row")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
