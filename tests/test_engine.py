import pytest
from pyspark.sql import functions as F

from spindrift.operators import engine as E
from spindrift.operators import retrieval as RT
from spindrift.operators import scoring as S

ROWS = [
    (1, "Ручка канцелярская синяя", "Ручки канцелярские", "цвет | материал", "ручка канцелярская синяя цвет"),
    (2, "Флеш накопитель 16 ГБ USB 3.0", "USB накопители твердотельные (флеш-драйвы)", "объем накопителя | интерфейс", "флеш накопитель usb объем"),
    (3, "Парацетамол таблетки 500 мг №10", "Анальгетики и антипиретики N02BG", "дозировка | форма", "парацетамол таблетки дозировка"),
    (4, "Многофункциональное устройство МФУ лазерное", "Печатающее оборудование", "тип печати", "мфу устройство печати"),
    (5, "Сифон бутылочный с горлышком", "Сифоны сантехнические", "материал", "сифон бутылочный"),
    (6, "Автоматический наружный дефибриллятор A15", "Медицинское оборудование", "тип", "дефибриллятор наружный"),
    (7, "Defi B наружный автоматический", "Медицинское оборудование", "тип", "наружный автоматический"),
    (8, "Парацетамол таблетки 250 мг №10", "Анальгетики и антипиретики N02BG", "дозировка | форма", "парацетамол таблетки дозировка"),
]


@pytest.fixture(scope="module")
def index(spark):
    rows = spark.createDataFrame(ROWS, "item_id long, name string, category string, attributes string, key_tokens string")
    words = spark.createDataFrame([("флешка", "флеш накопитель"), ("флешка", "usb накопитель")], "source string, target string")
    return E.built(rows, words, least_frequency=1)


QUERIES = ["парацетамол 500 мг", "парацетомол 500 мг", "флешка 16 гб", "мног", "бутылочное горлышко", "суперфлешка", "ручка", "", None, "зззззз", "дефибриллятор наружный"]


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string")


def test_analysis(asked, index):
    got = {r["query"]: r for r in E.analyze(asked, index).collect()}
    assert len(got) == len(QUERIES)
    assert got["парацетомол 500 мг"]["corrected_query"] == "парацетамол 500 мг" and got["парацетамол 500 мг"]["corrected_query"] == "парацетамол 500 мг"
    assert set(got["флешка 16 гб"]["synonyms"]) == {"флеш", "накопитель", "usb"} and got["флешка 16 гб"]["corrected_query"] == "флешка 16 гб"
    assert [(s["value"], s["unit"]) for s in got["флешка 16 гб"]["spans"]] == [("16", "гб")]
    assert got["мног"]["corrected_query"] == "мног" and got["мног"]["completions"] == ["многофункциональное"] and got["мног"]["broad"]
    assert got["бутылочное горлышко"]["corrected_query"] == "бутылочное горлышко"
    assert got["суперфлешка"]["synonyms"] == [] and got[None]["tokens"] == [] and got[""]["corrected"] == []


def test_least_score(spark):
    names = ("exact_phrase", "full_name_cover", "full_category_cover", "corrected_overlap", "name_overlap", "category_overlap", "key_overlap", "semantic_score")
    rows = [(0.0, 0.0, 0.0, 0.4, 0.4, 0.0, 0.0, 0.18), (1.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.18), (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.55)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    assert [r[0] for r in df.select(S.passes(F.col("semantic_score"), F.lit(0.55))).collect()] == [False, True, True]


def test_soft_overlap(spark):
    pairs = spark.createDataFrame([(1, 1, ["ручка", "насос"], ["ручки", "труба"]), (1, 2, ["насос"], ["стол"])], "query_id long, item_id long, left array<string>, right array<string>")
    edges = spark.createDataFrame([("труба", "насос", 0.2, 3)], "token string, neighbor string, score double, cooccurrence long")
    words = spark.createDataFrame([("ручка", 1)], "token string, frequency long")
    got = {r["item_id"]: r["overlap"] for r in E.soft_overlaps(pairs, edges, words, 0).collect()}
    assert abs(got[1] - (1 + 0.58) / 2) < 1e-9 and got[2] == 0.0


def test_search(asked, index):
    rows = RT.search(asked, index, least=0.55).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(QUERIES[r["query_id"]], []).append(r)
    assert [r["item_id"] for r in got["парацетамол 500 мг"]][0] == 3 and [r["item_id"] for r in got["парацетомол 500 мг"]][0] == 3
    assert got["флешка 16 гб"][0]["item_id"] == 2 and got["флешка 16 гб"][0]["synonym_bonus"] == 1.0 and got["мног"][0]["item_id"] == 4
    assert got["бутылочное горлышко"][0]["item_id"] == 5 and {r["item_id"] for r in got["дефибриллятор наружный"]} >= {6}
    assert "" not in got and None not in got and "зззззз" not in got
    for found in got.values():
        assert [r["rank"] for r in found] == list(range(1, len(found) + 1)) and {r["total_found"] for r in found} == {len(found)} and not found[0]["has_more"]
        assert [r["score"] for r in found] == sorted((r["score"] for r in found), reverse=True)


def test_search_pages(asked, index):
    one = asked.where("query = 'парацетамол 500 мг'")
    whole = [r["item_id"] for r in RT.search(one, index, least=0.0).orderBy("rank").collect()]
    first, second = (RT.search(one, index, limit=1, offset=i, least=0.0).collect() for i in (0, 1))
    assert [r["item_id"] for r in first + second] == whole[:2] and first[0]["has_more"]
