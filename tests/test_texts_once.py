"""Rules of texts stand in a plan once and are asked once for each different text: plans stay small enough for the driver, work follows the texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.functions import stamp
from docspark.operators import legend, title_block


def planned(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rules_of_titles_stand_in_the_plan_once(spark):
    text = ["Таблица 1 Схема труб", "Разрезы первого участка", "Экспликация зданий", "и сооружений", "Наименование | Кол.", "1 Труба"]
    lines = spark.createDataFrame([(k, n, line) for k in range(3) for n, line in enumerate(text)], "doc_id long, line_no int, line string")
    blocks = spark.range(3).select(F.col("id").alias("doc_id"), F.lit(1).alias("block_no"), F.col("id").cast("int").alias("start_line"), F.lit(6).alias("end_line"), F.lit("table").alias("kind"))
    found = legend.block_titles(lines, blocks)
    # the titles over several lines and those between label and heads are made here, all others with the lines
    assert planned(found).count("координат") <= 6 and len(planned(found)) < 60_000
    assert [tuple(r)[2:] for r in found.orderBy("doc_id").collect()] == [
        ("between", "Схема труб Схема труб Разрезы первого участка Экспликация зданий и"), ("between", "Экспликация зданий и сооружений"), ("between", "Сооружений"),
    ]


def test_lines_of_legends_are_told_once(spark):
    text = "Условные обозначения\nТаблица 3\n— Граница участка работ\n1 | | Ось трассы водопровода\nОсь трассы водопровода\nСпецификация\nТруба"
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    found = legend.notes(docs)
    # no rule is left for the lines of each document, and the told lines are sent to them
    assert "координат" not in planned(legend.bodies(docs)) + planned(found) and "rightHint=(strategy=broadcast)" in planned(found)
    assert {tuple(r)[1:] for r in found.collect()} == {(1, "Граница участка работ"), (2, "Ось трассы водопровода")} and found.count() == 100
    parts = legend.separate_notes(found)
    assert "координат" not in planned(parts) and parts.count() == 100


def test_titles_of_equal_lines_are_told_once(spark):
    text = "г. Гомель Беларусь\nСтадия П Лист 5\nГенеральный план благоустройства участка\nПлан сетей связи участка | Схема Электрических Соединений"
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    found = title_block.titles(docs)
    # what makes a text a title, and what cleans it, is asked before, once for each different text
    assert "электродвигател" not in planned(found)
    assert [tuple(r)[1:] for r in found.where("doc_id = 7").orderBy("place").collect()] == [
        (0, "Генеральный план благоустройства участка"), (1, "План сетей связи участка"), (2, "Схема Электрических Соединений"),
    ]
    # the values of a text are found once, not again to tell whether there are any
    assert planned(title_block.fields(docs)).count("Popmam") == 1


def test_places_are_sought_near_their_country(spark):
    texts = ["слово " * 30 + "г. Нижний Новый Старый Гомель, Беларусь и Минск Россия", "ГомельБеларусь", "Беларусь", "без страны", "", "а б в г д е ж з и Брест-Южный РБ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    places = lambda c: F.array(*(stamp._in(c, stamp.CITIES[1], k) for k in (0, 1, 2)))
    got = df.select(places(stamp.near_country(F.col("t"))), places(F.col("t"))).collect()
    assert all(a == b for a, b in got) and got[0][0][1] == "Нижний Новый Старый Гомель"
