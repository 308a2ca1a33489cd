"""Dense vectors of products stored with a manifest, and searched next to the words.

Below the index's path, ``dense/tokens`` holds a vector of each word, ``dense/vectors`` one of each product and
``dense/manifest`` one row: version, dimensions, number of vectors and a digest of them.  ``open`` gives none where
the manifest is missing or differs from what the code expects or the vectors hold, so a search then goes by words alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import numbers as N
from spindrift.operators import vectors as V

VERSION, DIMENSIONS = 2, 48
# What a word of each field weighs in a product's vector.
FIELD_WEIGHTS = {"name": 1.0, "category": 0.8, "key_tokens": 0.6}


def digest(vectors: DataFrame) -> tuple[int, str]:
    """The number of vectors and a digest that doesn't depend on their order."""
    n, mixed = vectors.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("item_id", "vector")), F.lit(0))).first()
    return n, str(mixed)


@dataclass
class Dense:
    tokens: DataFrame
    vectors: DataFrame

    @classmethod
    def build(cls, rows: DataFrame, vocabulary: DataFrame, edges: DataFrame, total: int, path: str, version: int = VERSION, dimensions: int = DIMENSIONS) -> None:
        """Writes the vectors of words (their surface and that of related words) and products (words by field weight and inverse frequency), the manifest last.

        rows: item_id and the words of each field, as a stored index has them.
        """
        spark = rows.sparkSession
        words = V.token_vectors(vocabulary.select("token"), edges, dimensions).join(vocabulary.select("token", N.idf(F.col("frequency"), F.lit(float(total))).alias("w")), "token")
        words.select("token", "v", "w").write.mode("overwrite").parquet(f"{path}/dense/tokens")
        each = F.array(*[F.struct(F.lit(weight).alias("field"), F.array_distinct(f"{c}_words").alias("words")) for c, weight in FIELD_WEIGHTS.items()])
        held = rows.select("item_id", F.inline(each)).select("item_id", "field", F.explode("words").alias("token")).groupBy("item_id", "token").agg(F.sum("field").alias("field"))
        tokens = spark.read.parquet(f"{path}/dense/tokens")
        vectors = V.summed(held.join(tokens, "token"), "item_id", "v", F.col("w") * F.col("field"), dimensions)
        vectors.select("item_id", F.transform("v", lambda x: x.cast("float")).alias("vector")).write.mode("overwrite").parquet(f"{path}/dense/vectors")
        n, mixed = digest(spark.read.parquet(f"{path}/dense/vectors"))
        spark.createDataFrame([(version, dimensions, n, mixed)], "version int, dimensions int, n long, digest string").coalesce(1).write.mode("overwrite").parquet(f"{path}/dense/manifest")

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int = VERSION, dimensions: int = DIMENSIONS) -> Dense | None:
        try:
            held = spark.read.parquet(f"{path}/dense/manifest").collect()  # one row
            vectors = spark.read.parquet(f"{path}/dense/vectors")
            tokens = spark.read.parquet(f"{path}/dense/tokens")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        if len(held) != 1 or (held[0]["version"], held[0]["dimensions"]) != (version, dimensions) or (held[0]["n"], held[0]["digest"]) != digest(vectors):
            return None
        return cls(tokens, vectors)

    def query_vectors(self, queries: DataFrame, words: str) -> DataFrame:
        """query_id, asked: unit vectors of the queries' distinct words (query_id and an array of words); queries without known words have none."""
        each = queries.select("query_id", F.explode(F.array_distinct(words)).alias("token")).join(self.tokens, "token")
        return V.summed(each, "query_id", "v", F.col("w"), DIMENSIONS).withColumnRenamed("v", "asked")

    def search(self, asked: DataFrame, k: int) -> DataFrame:
        """query_id, item_id, score, rank: the k products of largest positive cosine of each query."""
        return V.exact_topk(self.vectors, asked, k, "item_id", "vector", same=False).withColumnRenamed("vec_id", "item_id")

    def scores(self, pairs: DataFrame, asked: DataFrame) -> DataFrame:
        """query_id, item_id, dense_similarity of the pairs whose cosine is positive."""
        held = pairs.join(asked, "query_id").join(self.vectors, "item_id")
        return held.select("query_id", "item_id", N.cosine(F.col("asked"), F.col("vector")).alias("dense_similarity")).where("dense_similarity > 0")
