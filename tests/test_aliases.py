from pyspark.sql import functions as F

from spindrift.functions import phrases as H
from spindrift.operators import aliases as A


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_dictionary(spark):
    rows = spark.createDataFrame([("Многофункциональное устройство (МФУ)",), ("Многофункциональное устройство (МФУ)",), ("Сталь (III)",), ("Стол (столы)",)], "name string")
    words = spark.createDataFrame([(w, 3) for w in ("многофункциональное", "устройство", "мфу", "телефон", "мобильный", "стол", "столы")], "token string, frequency long")
    manual = spark.createDataFrame([("мобильник", "мобильный телефон"), ("x", "неизвестное")], "source string, target string")
    got = {(r["source"], r["target"]) for r in A.dictionary(rows, "name", manual, words).collect()}
    assert ("мфу", "многофункциональное устройство") in got and ("мобильник", "мобильный телефон") in got
    assert not {s for s, _ in got} & {"iii", "x", "столы"}


def test_preview(spark):
    text = F.lit("Вес:1.50;Цвет:-;Назначение:для письма;Объем:16.00000")
    assert one(spark, H.preview(text)) == "Назначение: для письма Цвет: - Вес: 1.5 Объем: 16"


def test_prefix(spark):
    tokens = F.array(F.lit("ручка"), F.lit("синяя"))
    assert one(spark, H.prefix_match(F.lit("руч"), tokens)) == 180.0
    assert one(spark, H.prefix_match(F.lit("син"), tokens)) == 26.0
    assert one(spark, H.prefix_match(F.lit("стол"), tokens)) == 0.0
    assert one(spark, A.abbreviation_like(F.lit("мфу"))) and not one(spark, A.abbreviation_like(F.lit("ручка")))
