"""Queries over text: statistics, retrieval, rewriting and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import numbers as N
from spindrift.functions import text as T
from spindrift.operators import corpus as C
from spindrift.operators import engine as E
from spindrift.operators import retrieval as RT
from spindrift.operators import rewrite as R
from spindrift.operators import scoring as S
from spindrift.operators import vectors as V
from spindrift.operators.dense import Dense
from spindrift.operators.index import Catalog, best_rows
from spindrift.operators.shared import dealt, shared_path, stored, written
from spindrift.plans.base import CATALOG, catalog, query, table

TOKENS = "regexp_extract_all(lower(translate({0}, 'ё', 'е')), '[0-9A-Za-zА-Яа-яЁё]+')"
STOP = "(" + ", ".join(f"'{w}'" for w in T.SEARCH_STOPWORDS) + ")"
NOISE = f"x IN {STOP} OR (length(x) = 1 AND NOT regexp_matches(x, '^[0-9]$'))"


def ngrams(token: str) -> str:
    s = f"('<' || {token} || '>')"
    return "list_distinct(" + " || ".join(f"list_transform(range(1, greatest(length({s}) - {n} + 2, 1)), lambda i: substring({s}, i, {n}))" for n in (3, 4, 5)) + ")"


def jaccard(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b})) * 1e0 / greatest(1, len(list_distinct({a} || {b}))))"


def texts(spark, sf_dir):
    """Ids and texts of the documents, dealt to several tasks, as they may stand in few files."""
    return dealt(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(f"""WITH t AS (SELECT unnest({TOKENS.format('text')}) AS token FROM documents)
SELECT token, substring(token, 1, 1) AS first_char, length(token) AS token_length, count(*) AS frequency FROM t WHERE length(token) >= 2 GROUP BY token""")
def token_frequency(spark, sf_dir):
    return C.token_frequency(table(spark, sf_dir, "documents"), "text")


@query(f"""WITH t AS (SELECT doc_id, {TOKENS.format('text')} AS w FROM documents),
k AS (SELECT doc_id, list_filter(w, lambda x: NOT (x IN ('и', 'в', 'во', 'на', 'по', 'под', 'над', 'для', 'с', 'со', 'к', 'ко', 'из', 'от', 'до', 'без', 'при', 'или', 'а', 'но', 'не', 'ни', 'о', 'об', 'у', 'же', 'ли', 'бы', 'the', 'and', 'for', 'of', 'to', 'n') OR (length(x) = 1 AND NOT regexp_matches(x, '^[0-9]$')))) AS w FROM t),
p AS (SELECT doc_id, x, min(i) AS i FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM k) GROUP BY ALL),
f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 24)
SELECT doc_id, coalesce(string_agg(x, ' ' ORDER BY i), '') AS keywords FROM documents LEFT JOIN f USING (doc_id) GROUP BY doc_id""")
def extract_keywords(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.extract_keywords([F.col("text")]).alias("keywords"))


@query(f"""WITH {CATALOG}, n AS (SELECT DISTINCT name, {TOKENS.format('name')} AS w FROM catalog WHERE len({TOKENS.format('name')}) >= 2)
SELECT name, {jaccard(ngrams('w[1]'), ngrams('w[2]'))} AS similarity FROM n""")
def char_ngram_jaccard(spark, sf_dir):
    """The similarity of a name's first two tokens."""
    names = catalog(spark, sf_dir).select("name", T.tokenize(F.col("name")).alias("w")).distinct().where(F.size("w") >= 2)
    return names.select("name", T.jaccard(T.char_ngrams(F.col("w")[0]), T.char_ngrams(F.col("w")[1])).alias("similarity"))


@query("""SELECT p_partkey AS item_id, CASE WHEN p_size IS NULL THEN '' ELSE CAST(p_size AS VARCHAR) || ':hz,' || CAST(p_size AS VARCHAR) || ':gb' END AS spans FROM part""")
def attribute_spans(spark, sf_dir):
    """Value and unit pairs of a text about each product."""
    size = F.col("p_size").cast("string")
    said = F.concat_ws(" ", F.lit("rod"), size, F.lit("hz usb"), size, F.lit("gb and"), size, F.lit("hz"))
    spans = T.attribute_spans(said)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["value"], s["unit"])), ",").alias("spans"))


FREQUENCY = f"""t AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS token FROM documents),
v AS (SELECT token, count(*) AS frequency FROM t GROUP BY token)"""


@query(f"""WITH {FREQUENCY}, voc AS (SELECT * FROM v WHERE length(token) >= 3 AND NOT regexp_matches(token, '^[0-9]+$') AND frequency >= 10),
d AS (SELECT DISTINCT doc_id, token, frequency FROM t JOIN voc USING (token)),
p AS (SELECT a.token, b.token AS neighbor, any_value(a.frequency) AS f, any_value(b.frequency) AS g, count(*) AS cooccurrence FROM d a JOIN d b ON a.doc_id = b.doc_id AND a.token <> b.token GROUP BY ALL),
s AS (SELECT token, neighbor, g, cooccurrence, cooccurrence / sqrt(CAST(f AS DOUBLE) * g) + 0.2e0 * {jaccard(ngrams('token'), ngrams('neighbor'))} AS score FROM p),
r AS (SELECT * FROM s WHERE score > 0.05 AND cooccurrence >= 2)
SELECT token, neighbor, round(score, 6) AS score, cooccurrence FROM r QUALIFY row_number() OVER (PARTITION BY token ORDER BY score DESC, cooccurrence DESC, g DESC, neighbor DESC) <= 8""")
def cooccurrence_graph(spark, sf_dir):
    return C.cooccurrence(texts(spark, sf_dir), "doc_id", ["text"]).withColumn("score", F.round("score", 6))


ASKED = [(1, "the"), (1, "restor"), (2, "ciónes"), (2, "para"), (3, "thatly")]
ASKED_SQL = "q(query_id, prefix) AS (VALUES " + ", ".join(f"({a}, '{b}')" for a, b in ASKED) + ")"


@query(f"""WITH {ASKED_SQL}, w AS (SELECT doc_id AS doc, {TOKENS.format('text')} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS average FROM w),
t AS (SELECT doc, len(w) AS length, unnest(w) AS term FROM w),
h AS (SELECT query_id, prefix, doc, length, count(*) AS tf FROM t JOIN q ON starts_with(term, prefix) GROUP BY ALL),
df AS (SELECT query_id, prefix, count(DISTINCT doc) AS df FROM h GROUP BY ALL),
x AS (SELECT query_id, prefix, doc, df, n, tf / (1 - 0.75e0 + 0.75e0 * length / average) AS tf FROM h JOIN df USING (query_id, prefix), s),
y AS (SELECT query_id, doc, sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0)) AS score FROM x GROUP BY ALL)
SELECT CAST(query_id AS BIGINT) AS query_id, doc AS row, round(score, 4) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc) AS INTEGER) AS rank FROM y
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc) <= 20""")
def bm25_search(spark, sf_dir):
    """Twenty documents a query: the limit is the feature."""
    docs = table(spark, sf_dir, "documents")
    asked = spark.createDataFrame(ASKED, "query_id bigint, prefix string")
    return C.bm25(C.postings(docs, "doc_id", ["text"], asked), C.field_stats(docs, ["text"]), asked, {"text": 1.0}).withColumn("score", F.round("score", 4))


@query(f"""WITH {FREQUENCY}, q(token) AS (VALUES ('teh'), ('thta'), ('fromm'), ('vequqa'), ('12'), ('the'), ('zzzzqqq'), ('paar')),
voc AS (SELECT * FROM v WHERE length(token) >= 2),
u AS (SELECT token FROM q WHERE length(token) > 2 AND NOT regexp_matches(token, '^[0-9]+$') AND token NOT IN (SELECT token FROM voc) AND NOT EXISTS (SELECT 1 FROM voc WHERE starts_with(voc.token, q.token))),
c AS (SELECT u.token, voc.token AS candidate, frequency, CAST(damerau_levenshtein(u.token, voc.token) AS INTEGER) AS distance FROM u JOIN voc ON substring(u.token, 1, 1) = substring(voc.token, 1, 1) AND abs(length(u.token) - length(voc.token)) <= 2)
SELECT token, candidate, frequency, distance FROM c WHERE distance <= 2 QUALIFY row_number() OVER (PARTITION BY token ORDER BY distance, frequency DESC, candidate) = 1""")
def typo_corrections(spark, sf_dir):
    words = C.token_frequency(table(spark, sf_dir, "documents"), "text")
    asked = spark.createDataFrame([(w,) for w in ("teh", "thta", "fromm", "vequqa", "12", "the", "zzzzqqq", "paar")], "token string")
    return R.corrections(R.correction_candidates(asked, words))


@query(f"""WITH {FREQUENCY}, q(prefix) AS (VALUES ('the'), ('ció'), ('rest'), ('th'), ('123')), voc AS (SELECT * FROM v WHERE length(token) >= 2),
a AS (SELECT prefix FROM q WHERE length(prefix) >= 3 AND NOT regexp_matches(prefix, '^[0-9]+$') AND prefix NOT IN (SELECT token FROM voc WHERE length(token) > 4)),
c AS (SELECT prefix, token, frequency, row_number() OVER (PARTITION BY prefix ORDER BY frequency DESC, length(token), token) AS rk FROM a JOIN voc ON starts_with(token, prefix) AND token <> prefix)
SELECT prefix, token, frequency, CAST(rk AS INTEGER) AS rank FROM c WHERE rk <= 6""")
def prefix_completion(spark, sf_dir):
    """Six completions a prefix: the limit is the feature."""
    words = C.token_frequency(table(spark, sf_dir, "documents"), "text")
    asked = spark.createDataFrame([(w,) for w in ("the", "ció", "rest", "th", "123")], "prefix string")
    return R.completions(asked, words)


@query(f"""WITH d(source, target) AS (VALUES ('large brass', 'big metal'), ('ring', 'band'), ('small', 'little')), {CATALOG},
n AS (SELECT item_id, ' ' || array_to_string({TOKENS.format('name')}, ' ') || ' ' AS w FROM catalog)
SELECT DISTINCT item_id AS query_id, source, target FROM n JOIN d ON contains(w, ' ' || source || ' ')""")
def synonym_expansion(spark, sf_dir):
    words = spark.createDataFrame([("large brass", "big metal"), ("ring", "band"), ("small", "little")], "source string, target string")
    return R.synonyms(catalog(spark, sf_dir).select(F.col("item_id").alias("query_id"), T.tokenize(F.col("name")).alias("tokens")), words)


@query()
def semantic_expansion(spark, sf_dir):
    """Related tokens of every benchmark item's most telling tokens, by the documents' co-occurrence graph."""
    docs = C.words_once(texts(spark, sf_dir), "doc_id", "text")
    words = written(C.word_frequency(docs, F.col("tokens"), 3), "frequencies")
    edges = C.word_cooccurrence(docs, "row", F.col("tokens"), words=words)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(T.tokenize(F.col("text")))).alias("token"))
    return R.related(asked, edges, words, docs.count())


@query(f"""WITH {CATALOG}, p AS (SELECT item_id, {TOKENS.format('name')} AS n, {TOKENS.format('category')} AS c, {TOKENS.format('attributes')} AS k, ['large', 'ring', 'brass'] AS q FROM catalog),
f AS (SELECT item_id, len(list_intersect(q, n)) / 3e0 AS name_overlap, len(list_intersect(q, c)) / 3e0 AS category_overlap, len(list_intersect(q, k)) / 3e0 AS key_overlap,
CASE WHEN contains(array_to_string(n, ' '), 'large ring brass') THEN 1e0 ELSE 0e0 END AS exact_phrase, CASE WHEN len(list_intersect(q, n)) = 3 THEN 1e0 ELSE 0e0 END AS full_name_cover FROM p)
SELECT item_id, exact_phrase, full_name_cover, name_overlap, category_overlap, key_overlap,
round(12e0 * exact_phrase + 4e0 * full_name_cover + 6e0 * name_overlap + 4e0 * name_overlap + 3e0 * category_overlap + 2e0 * key_overlap, 6) AS score,
exact_phrase >= 1 OR full_name_cover >= 1 OR name_overlap >= 1 OR greatest(exact_phrase, full_name_cover, name_overlap, 0.45e0 * name_overlap + 0.25e0 * name_overlap + 0.15e0 * category_overlap + 0.15e0 * key_overlap) >= 0.5225e0 AS passes FROM f""")
def lexical_feature_score(spark, sf_dir):
    """Lexical features of every product for one query, their score and whether it passes the least score."""
    q = F.array(*[F.lit(x) for x in ("large", "ring", "brass")])
    rows = S.lexical_features(catalog(spark, sf_dir), q)
    out = rows.withColumn("score", F.round(S.lexical_score(), 6)).withColumn("passes", S.passes(F.lit(0.0), F.lit(0.55)))
    return out.select("item_id", "exact_phrase", "full_name_cover", "name_overlap", "category_overlap", "key_overlap", "score", "passes")


@query("""SELECT p_partkey AS item_id, CASE WHEN p_size = 10 THEN 5e0 ELSE -3e0 END AS score FROM part""")
def attribute_score(spark, sf_dir):
    """How the products' sizes meet the asked 10 hz."""
    spans = T.attribute_spans(F.concat(F.col("p_size").cast("string"), F.lit(" hz")))
    asked = T.attribute_spans(F.lit("10 hz"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), S.attribute_score(asked, spans, F.array().cast("array<string>")).alias("score"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""")
def vector_topk(spark, sf_dir):
    """Exact nearest vectors of every twentieth vector among all: ten a query, the limit is the feature."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"))
    return V.exact_topk(rows, asked, 10).withColumn("score", F.round("score", 6))


@query()
def graph_embedding(spark, sf_dir):
    """Unit vectors of every document from hashed token surfaces."""
    return V.graph_vectors(texts(spark, sf_dir), "doc_id", "text")


@query("""SELECT doc_id, 'documents:' || sha256('{"id":' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ',"lang":' || coalesce('"' || lang || '"', 'null') || ',"source":' || coalesce('"' || source || '"', 'null') || '}') AS key FROM documents""")
def cache_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", N.cache_key("documents", {"source": F.col("source"), "lang": F.col("lang"), "id": F.col("doc_id")}).alias("key"))


@query("""WITH d AS (SELECT doc_id, n_chars FROM documents), r AS (SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place, count(*) OVER () AS total FROM d)
SELECT doc_id, n_chars, total AS total_found, total > 30 AS has_more FROM r WHERE place > 20 AND place <= 30""")
def pagination(spark, sf_dir):
    """The third page of ten: offset and limit are the feature."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    total = rows.agg(F.count("*").alias("total_found"))
    page = rows.orderBy(F.desc("n_chars"), "doc_id").offset(20).limit(10)
    return page.withColumn("one", F.lit(1)).join(F.broadcast(total.withColumn("one", F.lit(1))), "one").select("doc_id", "n_chars", "total_found", (F.col("total_found") > 30).alias("has_more"))


SYNONYMS = [("large brass", "big metal"), ("ring", "band"), ("small", "little")]


def products(spark, sf_dir):
    """Products with attribute keys between bars and key tokens, dealt to several tasks, as they may stand in few files and are cut into words as they are stored."""
    size = F.concat(F.lit("size "), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, F.lit(" gb")).otherwise(F.lit(" hz")))
    rows = dealt(table(spark, sf_dir, "part")).select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.concat_ws(" | ", "p_brand", size).alias("attributes"))
    return rows.withColumn("key_tokens", T.extract_keywords([F.col("name"), F.col("category")]))


def engine(spark, sf_dir):
    """The products' index, and a few synonyms."""
    return E.built(products(spark, sf_dir), spark.createDataFrame(SYNONYMS, "source string, target string"))


def asked_names(spark, sf_dir):
    """Queries of every twentieth product: its name as it is, with a letter dropped, its start, its synonyms' sources, or its name and size."""
    rows = table(spark, sf_dir, "part").where(F.col("p_partkey") % 20 == 0)
    words, kind = F.split("p_name", " "), F.pmod(F.floor(F.col("p_partkey") / 20), F.lit(5))
    dropped = F.array_join(F.transform(words, lambda w: F.concat(F.substring(w, 1, 2), F.substring(w, 4, 50))), " ")
    size = F.concat_ws(" ", "p_name", F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, F.lit("gb")).otherwise(F.lit("hz")))
    query = F.when(kind == 0, F.col("p_name")).when(kind == 1, dropped).when(kind == 2, F.substring(words[1], 1, 3)).when(kind == 3, F.concat_ws(" ", F.lit("large brass"), words[1])).otherwise(size)
    return rows.select(F.col("p_partkey").alias("query_id"), query.alias("query"))


ASKED_NAMES = """asked AS (SELECT p_partkey AS query_id, CASE p_partkey // 20 % 5 WHEN 0 THEN p_name
  WHEN 1 THEN array_to_string(list_transform(str_split(p_name, ' '), lambda w: substring(w, 1, 2) || substring(w, 4)), ' ')
  WHEN 2 THEN substring(str_split(p_name, ' ')[2], 1, 3) WHEN 3 THEN 'large brass ' || str_split(p_name, ' ')[2] ELSE p_name || ' ' || p_size || CASE p_size % 2 WHEN 0 THEN ' gb' ELSE ' hz' END END AS query
  FROM part WHERE p_partkey % 20 = 0)"""
#: Words of names, categories and key tokens, which are the distinct words of the other two.
VOCABULARY = f"""pw AS (SELECT p_partkey AS item_id, {TOKENS.format('p_name')} AS n, {TOKENS.format('p_type')} AS c FROM part),
prod AS (SELECT *, list_distinct(n || c) AS k FROM pw),
voc AS (SELECT token, count(*) AS frequency FROM (SELECT unnest(n || c || k) AS token FROM prod) WHERE length(token) >= 2 GROUP BY token)"""
#: Of each query its words with the best correction of those that are neither known, begin a known word, nor are a synonym's source.
CORRECTED = f"""{VOCABULARY}, {ASKED_NAMES}, d(source, target) AS (VALUES ('large brass', 'big metal'), ('ring', 'band'), ('small', 'little')),
qw AS (SELECT query_id, array_to_string({TOKENS.format('query')}, ' ') AS normalized, list_distinct({TOKENS.format('query')}) AS ws FROM asked),
w AS (SELECT query_id, x AS token, list_position({TOKENS.format('query')}, x) AS pos FROM (SELECT query_id, query, unnest(list_distinct({TOKENS.format('query')})) AS x FROM asked)),
u AS (SELECT DISTINCT token FROM w WHERE length(token) > 2 AND NOT regexp_matches(token, '^[0-9]+$') AND token NOT IN ('ring', 'small') AND NOT EXISTS (SELECT 1 FROM voc WHERE starts_with(voc.token, w.token))),
near1 AS (SELECT u.token, v.token AS candidate, frequency FROM u JOIN voc AS v ON left(u.token, 1) = left(v.token, 1) AND abs(length(u.token) - length(v.token)) <= 2),
near2 AS (SELECT u.token, v.token AS candidate, frequency FROM u JOIN voc AS v ON abs(length(u.token) - length(v.token)) <= 1 WHERE u.token NOT IN (SELECT token FROM near1)),
fix AS (SELECT token, candidate FROM (SELECT * FROM near1 UNION ALL SELECT * FROM near2) WHERE damerau_levenshtein(token, candidate) <= 2 QUALIFY row_number() OVER (PARTITION BY token ORDER BY damerau_levenshtein(token, candidate), frequency DESC, candidate) = 1),
cw AS (SELECT query_id, coalesce(candidate, token) AS token, min(pos) AS pos FROM w LEFT JOIN fix USING (token) GROUP BY ALL),
cq AS (SELECT query_id, string_agg(token, ' ' ORDER BY pos) AS corrected_query FROM cw GROUP BY query_id),
ends AS (SELECT p.token AS prefix, v.token, row_number() OVER (PARTITION BY p.token ORDER BY frequency DESC, length(v.token), v.token) AS rk FROM (SELECT DISTINCT token FROM cw) AS p JOIN voc AS v ON starts_with(v.token, p.token) AND v.token <> p.token
  WHERE length(p.token) >= 3 AND NOT regexp_matches(p.token, '^[0-9]+$') AND p.token NOT IN (SELECT token FROM voc WHERE length(token) > 4)),
comp AS (SELECT query_id, string_agg(token, ' ' ORDER BY pos, rk) AS completions FROM (SELECT cw.query_id, ends.token, min(pos) AS pos, min(rk) AS rk FROM cw JOIN ends ON ends.prefix = cw.token AND rk <= 6 GROUP BY ALL) GROUP BY query_id),
syn AS (SELECT query_id, string_agg(x, ' ' ORDER BY source, i) AS synonyms FROM (SELECT query_id, source, unnest(str_split(target, ' ')) AS x, generate_subscripts(str_split(target, ' '), 1) AS i FROM cq JOIN d ON contains(' ' || corrected_query || ' ', ' ' || source || ' ')) GROUP BY query_id)"""


@query(f"""WITH {CORRECTED}
SELECT query_id, normalized, coalesce(corrected_query, '') AS corrected_query, coalesce(completions, '') AS completions, coalesce(synonyms, '') AS synonyms FROM qw LEFT JOIN cq USING (query_id) LEFT JOIN comp USING (query_id) LEFT JOIN syn USING (query_id)""")
def analyze_query(spark, sf_dir):
    """What the engine makes of queries with mistakes, beginnings of words, synonyms and sizes."""
    out = E.analyze(asked_names(spark, sf_dir), engine(spark, sf_dir))
    return out.select("query_id", "normalized", "corrected_query", *[F.array_join(c, " ").alias(c) for c in ("completions", "synonyms")])


@query(f"""WITH {VOCABULARY}, q AS (SELECT DISTINCT item_id AS query_id, substring(x, 1, 4) AS prefix FROM (SELECT item_id, unnest(n) AS x FROM prod UNION ALL SELECT item_id, unnest(c) FROM prod) WHERE item_id % 20 = 0),
rows AS (SELECT item_id, n, c, k, 2 * len(n) + 2 * len(c) + len(k) AS length FROM prod), size AS (SELECT count(*) AS total, avg(length) AS mean FROM rows),
begins(p) AS (SELECT DISTINCT prefix FROM q), hits AS (SELECT p AS prefix, item_id, length, 3.7e0 * len(list_filter(n, lambda x: starts_with(x, p))) + 2.1e0 * len(list_filter(c, lambda x: starts_with(x, p))) + 0.7e0 * len(list_filter(k, lambda x: starts_with(x, p))) AS tf FROM rows, begins),
held AS (SELECT *, count(*) OVER (PARTITION BY prefix) AS df FROM hits WHERE tf > 0),
score AS (SELECT query_id, item_id, round(sum(greatest(ln((total - df + 0.5e0) / (df + 0.5e0)), 1e-6) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * length / mean))), 6) AS score FROM q JOIN held USING (prefix), size GROUP BY ALL)
SELECT query_id, item_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM score QUALIFY rank <= 20""")
def index_search(spark, sf_dir):
    """Twenty products a query (every twentieth product's words, cut to four letters) from an index that was built of others' names and then updated: the limit is the feature."""
    rows = products(spark, sf_dir)
    changed = F.col("item_id") % 3 == 0
    old = rows.withColumn("name", F.when(changed, F.concat_ws(" ", "category", F.lit("old"))).otherwise(F.col("name")))
    gone = rows.where("item_id % 7 = 0").select((-F.col("item_id") - 1).alias("item_id"), *[c for c in rows.columns if c != "item_id"])
    store = Catalog.create(old.unionByName(gone), shared_path(spark, "index")).update(rows.where(changed), removed=gone)
    words = F.array_distinct(F.transform(F.concat(T.tokenize(F.col("name")), T.tokenize(F.col("category"))), lambda w: F.substring(w, 1, 4)))
    asked = rows.where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.explode(words).alias("prefix"))
    return best_rows(stored(store.hits(asked.select("prefix").distinct())), asked, *store.size(), 20)


@query()
def search_results(spark, sf_dir):
    """Products found for the queries of every twentieth among all: twenty a query, the limit is the feature."""
    return RT.search(asked_names(spark, sf_dir), engine(spark, sf_dir))


@query()
def dense_search(spark, sf_dir):
    """The same queries with the products' vectors beside the words."""
    index = engine(spark, sf_dir)
    Dense.build(index.catalog, index.vocabulary, index.edges, index.total, index.store.path)
    return RT.search(asked_names(spark, sf_dir), E.opened(spark, index.store.path))
