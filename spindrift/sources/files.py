"""Readers and writers of catalog, purchase and ranking files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.functions import numbers as N
from spindrift.functions import text as X

CATALOG_FIELDS = ("ste_id", "raw_name", "raw_category", "raw_attributes")
CONTRACT_FIELDS = (
    "contract_item_name", "contract_id", "ste_id", "contract_datetime", "contract_amount", "customer_inn",
    "customer_name", "customer_region", "supplier_inn", "supplier_name", "supplier_region",
)
CORRUPT = "_corrupt"


def strings(fields: tuple[str, ...], corrupt: bool = True) -> T.StructType:
    """Every field a string, and a column for rows of another arity."""
    return T.StructType([T.StructField(f, T.StringType()) for f in (*fields, *([CORRUPT] if corrupt else []))])


def first_text(spark: SparkSession, path: str, most: int = 4096) -> str:
    """The head of a file, read by Spark so that any store will do."""
    row = spark.read.text(path).limit(1).first()
    return (row[0] if row else "").lstrip("﻿")[:most]


def delimiter(head: str) -> str:
    """; unless commas are more frequent."""
    return ";" if head.count(";") >= head.count(",") else ","


def header_name(name: str) -> str:
    return " ".join(name.strip().strip('"').lower().split())


def has_header(head: str, names: tuple[str, ...], sep: str) -> bool:
    """Whether the first line holds the wanted names."""
    return set(names) <= {header_name(x) for x in head.split(sep)}


def read_positional(spark: SparkSession, path: str, fields: tuple[str, ...], sep: str = ";", header: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows of the right arity, the others as text)."""
    rows = spark.read.csv(path, schema=strings(fields), sep=sep, quote='"', escape='"', header=header, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, enforceSchema=True)
    clean = [F.translate(F.col(f), "\0", "").alias(f) for f in fields]
    # Spark wants a query to use another column beside the one for odd rows
    odd = F.length(F.concat(F.coalesce(F.col(fields[0]), F.lit("")), F.col(CORRUPT))) >= 0
    return rows.where(F.col(CORRUPT).isNull()).select(*clean), rows.where(odd).select(F.col(CORRUPT).alias("line"))


def read_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Products with cleaned names, keys and keywords; rows of another arity apart."""
    rows, odd = read_positional(spark, path, CATALOG_FIELDS)
    pairs = X.parse_attributes(F.col("raw_attributes"))
    keys = F.transform(pairs, lambda p: p["key"])
    out = rows.select(
        X.clean_text(F.col("ste_id")).alias("ste_id"), X.clean_text(F.col("raw_name")).alias("clean_name"), X.normalize_text(F.col("raw_name")).alias("normalized_name"),
        X.clean_text(F.col("raw_category")).alias("category"), X.normalize_text(F.col("raw_category")).alias("normalized_category"),
        F.array_join(keys, " | ").alias("attribute_keys"), F.size(keys).alias("attribute_count"),
        X.extract_keywords([F.col("raw_name"), F.col("raw_category"), F.array_join(keys, " ")]).alias("key_tokens"),
    )
    return out.where("ste_id <> ''"), odd


def read_contracts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Purchase lines, with or without a header, typed leniently; empty customers and regions are UNKNOWN."""
    head = first_text(spark, path)
    sep = delimiter(head)
    rows, odd = read_positional(spark, path, CONTRACT_FIELDS, sep, has_header(head, CONTRACT_FIELDS, sep))
    unknown = lambda c: F.coalesce(F.nullif(X.clean_text(F.col(c)), F.lit("")), F.lit("UNKNOWN")).alias(c)
    out = rows.select(
        X.clean_text(F.col("contract_item_name")).alias("contract_item_name"), "contract_id", X.clean_text(F.col("ste_id")).alias("ste_id"),
        N.lenient_date(F.col("contract_datetime")).alias("day"), N.lenient_double(F.col("contract_amount")).alias("amount"),
        unknown("customer_inn"), unknown("customer_region"), F.col("supplier_inn"), unknown("supplier_region"),
    )
    return out, odd


def read_headered(spark: SparkSession, path: str, required: tuple[str, ...]) -> DataFrame:
    """All columns as strings; a missing required one is an error."""
    rows = spark.read.csv(path, header=True, inferSchema=False, sep=delimiter(first_text(spark, path)), quote='"', escape='"', multiLine=True)
    missing = sorted(set(required) - set(rows.columns))
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return rows


def first_present(rows: DataFrame, names: tuple[str, ...]):
    """The first non-empty of the columns that exist among the names."""
    here = [F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")) for n in names if n in rows.columns]
    return F.coalesce(*here, F.lit("")) if here else F.lit("")


def read_ranking(spark: SparkSession, path: str, keys: tuple[str, ...], label: str = "label") -> tuple[DataFrame, list[str]]:
    """(rows with label and features as numbers, the feature names: all columns but keys and label)."""
    rows = read_headered(spark, path, (*keys, label))
    features = [c for c in rows.columns if c not in (*keys, label)]
    return rows.select(*keys, N.lenient_double(F.col(label)).alias(label), *[N.lenient_double(F.col(c)).alias(c) for c in features]), features


def quality_counts(rows: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """One row: how many rows, and how many lack each required column."""
    lacks = [F.count_if(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "").alias(f"missing_{c}") for c in required]
    return rows.agg(F.count("*").alias("rows"), *lacks)


def read_json_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def read_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """source, target of a dictionary file with token_synonyms and phrase_synonyms."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one small file
    held = json.loads(text)
    rows = [(s, t) for part in ("phrase_synonyms", "token_synonyms") for s, ts in held.get(part, {}).items() for t in ts]
    return spark.createDataFrame(rows, "source string, target string")


def write_csv(df: DataFrame, path: str, order: list | None = None, sep: str = ",") -> None:
    """With a header; ordered exports go through a range partitioning, so the parts are in order."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").csv(path, header=True, sep=sep, quote='"', escape='"')


def write_table(df: DataFrame, path: str, sort: str | None = None) -> None:
    """Parquet, sorted within files so that a reader can skip."""
    (df.sortWithinPartitions(sort) if sort else df).write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_corpus(rows: DataFrame, path: str, columns: dict[str, int]) -> None:
    """A line a row: the columns' normalised texts, each so many times."""
    parts = [X.normalize_text(F.col(c)) for c, n in columns.items() for _ in range(n)]
    rows.select(F.concat_ws(" ", *parts).alias("value")).where("value <> ''").write.mode("overwrite").text(path)


def metadata(values: dict[str, object], spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in sorted(values.items())], "key string, value string")
