"""Queries of the text, alias and number rules over the columns of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import numbers as N
from spindrift.functions import text as T
from spindrift.operators import aliases as A
from spindrift.operators.shared import dealt
from spindrift.plans.base import query, table
from spindrift.plans.search import NOISE, TOKENS

ENDINGS = "[" + ", ".join(f"'{e}'" for e in T.ENDINGS) + "]"
WORDS = TOKENS.format("coalesce(text, '')")
STEM = f"CASE WHEN length(x) <= 4 OR regexp_full_match(x, '[0-9]+') THEN x ELSE left(x, length(x) - coalesce(length(list_filter({ENDINGS}, lambda e: ends_with(x, e) AND length(x) - length(e) >= 3)[1]), 0)) END"


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents), s AS (SELECT *, list_distinct(list_filter(list_transform(w, lambda x: {STEM}), lambda x: NOT ({NOISE}))) AS stems FROM d)
SELECT doc_id, sha256(array_to_string(w, ' ')) AS normalized, CAST(len(list_distinct(list_filter(w, lambda x: NOT ({NOISE})))) AS INTEGER) AS telling, sha256(array_to_string(list_sort(stems), ' ')) AS stems,
sha256(regexp_replace(trim(regexp_replace(trim(translate(text, chr(65279) || chr(9) || chr(10) || chr(13), '    ')), '^"+|"+$', '', 'g')), '[ \t\n\f\r]+', ' ', 'g')) AS cleaned,
array_to_string(list_sort(list_distinct(list_filter(w, lambda x: regexp_full_match(x, '[a-zа-я][0-9]{{2}}[a-zа-я]{{0,2}}')))), ',') AS codes FROM s""")
def text_shapes(spark, sf_dir):
    """Every document's text normalised, reduced to telling tokens and stems, cleaned, and the codes in it."""
    text, tokens = F.col("text"), F.col("tokens")
    rows = dealt(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("tokens", T.tokenize(text))
    digest = lambda tokens: F.sha2(F.array_join(tokens, " "), 256)
    return rows.select(
        "doc_id", digest(tokens).alias("normalized"), F.size(T.normalize_tokens(tokens)).alias("telling"), digest(F.array_sort(T.stem_tokens(tokens))).alias("stems"),
        F.sha2(T.clean_text(text), 256).alias("cleaned"), F.array_join(F.array_sort(T.category_codes(text)), ",").alias("codes"),
    )


@query("""WITH o AS (SELECT *, CAST(o_orderdate AS DATE) AS day, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS said, o_orderkey % 4 AS form FROM orders),
r AS (SELECT *, CASE WHEN form = 3 THEN NULL ELSE day END AS read, CASE WHEN form = 3 THEN 3650e0 ELSE CAST(greatest(0, date_diff('day', day, DATE '2001-01-01')) AS DOUBLE) END AS days FROM o)
SELECT o_orderkey AS order_id, CAST(said AS DOUBLE) AS amount, 0e0 AS priority, false AS priority_is_number, rtrim(rtrim(said, '0'), '.') AS shown, read AS day, days,
CASE WHEN days >= 3650 THEN 0e0 ELSE round(greatest(0e0, 1 - days / 90e0), 6) END AS boost, (o_orderkey % 60 BETWEEN 1 AND 50) AND (o_orderkey % 13 / 10.0 BETWEEN 0 AND 1) AND o_totalprice >= 100000 AND o_orderstatus IN ('O', 'F') AS valid FROM r""")
def number_shapes(spark, sf_dir):
    """Amounts and days of every order read back from text in several forms, their recency, and whether a request made of them is valid."""
    rows, day = table(spark, sf_dir, "orders"), F.col("o_orderdate")
    said = F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    form = F.col("o_orderkey") % 4
    written = F.when(form == 0, F.date_format(day, "dd.MM.yyyy")).when(form == 1, F.date_format(day, "yyyy-MM-dd HH:mm:ss")).when(form == 2, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.lit("someday"))
    read = N.lenient_date(written)
    days = N.recency_days(read, F.lit("2001-01-01").cast("date"))
    valid = N.in_bounds(F.col("o_orderkey") % 60, (F.col("o_orderkey") % 13) / 10, F.col("o_totalprice") - 100000, F.col("o_orderstatus"), ("O", "F"))
    return rows.select(
        F.col("o_orderkey").alias("order_id"), N.lenient_double(F.concat(F.lit(" "), F.translate(said, ".", ","))).alias("amount"), N.lenient_double("o_orderpriority").alias("priority"),
        N.is_number(F.col("o_orderpriority")).alias("priority_is_number"), T.humanize_number(said).alias("shown"), read.alias("day"), days.alias("days"), F.round(N.recency_boost(days, 90.0), 6).alias("boost"), valid.alias("valid"),
    )


@query("""WITH p AS (SELECT *, str_split(p_name, ' ')[-1] AS last, lower(p_type) AS kind, 'n' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS code, p_name || ' ' || p_type AS named FROM part)
SELECT p_partkey AS item_id, CASE p_partkey % 3 WHEN 0 THEN 'works' WHEN 1 THEN 'services' ELSE 'goods' END AS item_kind, CASE WHEN code = 'n11' THEN 1e0 WHEN p_size = 12 THEN 0.8e0 ELSE 0e0 END AS code_match,
CASE WHEN length(named) <= 12 THEN named ELSE regexp_replace(left(named, 11), ' [^ ]*$', '') || '…' END AS cut, p_brand || ';' || p_type AS listed, p_type NOT IN ('MIXED') AS acronym, regexp_full_match(replace(p_name, ' ', ''), '[A-Za-z0-9]{2,16}') AND NOT regexp_full_match(replace(lower(p_name), ' ', ''), '[ivxlcdm]+') AS acronym_of_words, length(last) <= 2 AND length(split_part(p_name, ' ', 1)) <= 2 AS bad,
length(last) <= 5 AND length(regexp_replace(last, '[aeiouy]', '', 'g')) >= length(last) - (CASE WHEN contains(last, 'y') THEN 1 ELSE 0 END) - 1 + (CASE WHEN contains(last, 'y') THEN 1 ELSE 0 END) AS abbreviation, true AS phrase, split_part(p_name, ' ', 1) IN ('red', 'blue') AS expected,
p_name || ' ' || p_name || ' ' || p_type || ' size' AS document, p_name || ' ' || kind AS pseudo, 'stripped:' || p_name || ' ' || kind AS chosen, CASE WHEN p_size BETWEEN 10 AND 99 THEN 'c' || CAST(p_size AS VARCHAR) ELSE '' END AS codes FROM p""")
def product_shapes(spark, sf_dir):
    """Kind, codes, cut and listed texts, alias tests, phrases and queries made of every product's name, brand and type."""
    name, kind, size = F.col("p_name"), F.col("p_type"), F.col("p_size")
    last = F.element_at(F.split(name, " "), -1)
    work = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Ремонт: "), name)).when(F.col("p_partkey") % 3 == 1, F.concat(name, F.lit(" (услуги)"))).otherwise(name)
    code = F.concat(F.lit("Тип N"), F.lpad(size.cast("string"), 2, "0"))
    asked = F.array(F.lit("n11"), F.lit("n12bg"))
    chosen = T.chosen_query(F.concat(F.lit("Поставка "), name, F.lit(", "), kind))
    return dealt(table(spark, sf_dir, "part")).select(
        F.col("p_partkey").alias("item_id"), T.item_kind(work, kind).alias("item_kind"), T.code_match(T.category_codes(code), asked).alias("code_match"), T.truncate_words(F.concat_ws(" ", name, kind), 12).alias("cut"),
        F.array_join(T.pipe_list(F.concat_ws("|", F.concat(F.lit(" "), "p_brand"), F.lit(" "), kind)), ";").alias("listed"), A.acronym_like(kind).alias("acronym"), A.acronym_like(name).alias("acronym_of_words"), A.bad_alias(name).alias("bad"),
        A.abbreviation_like(last).alias("abbreviation"), T.contains_phrase(T.tokenize(name), last).alias("phrase"), T.meets_expectation(name, F.array(last), F.array(F.lit("Red"), F.lit("blue"))).alias("expected"),
        T.document_text(name, kind, F.lit("size")).alias("document"), T.pseudo_queries(F.lit(""), name, kind, F.lit(None).cast("string"))["name_category"].alias("pseudo"), F.concat_ws(":", chosen["name"], chosen["text"]).alias("chosen"),
        F.array_join(T.category_codes(F.concat(F.lit("c"), size.cast("string"))), ",").alias("codes"),
    )
