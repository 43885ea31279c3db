"""Title blocks: each field's rules, what is garbage, and titles of two sources against a loop over the rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docspark.functions import stamp
from docspark.operators import title_block

TEXTS = {
    1: ('РУП "Белнипиэнергопром" г. Минск Беларусь\nСтадия С Лист 5 Листов 12\nМасштаб 1:500\nФормат А4 х 3\n1118-0-ГП9\nКопировал Петрова\nI очередь строительства\nРабочая документация',
        {"Обозначение / шифр": "1118-0-ГП9", "Организация": 'РУП "БелнипиЭНЕРГОПРОМ"', "Город / адрес": "Минск Беларусь", "Масштаб": "1:500", "Формат": "Формат A4x3", "Стадия (обозначение)": "С", "Стадия": "Рабочая документация", "Очередь строительства": "I очередь строительства", "Лист": "5 / 12", "Копировал": "Петрова"}),
    2: ("Стадия\nС 14\nУВ-12 34-GT-08; BNP 1760-228-ЭМ1\nООО по месту защиты\nл. 7\nминск белорусская", {"Обозначение документа": "BNP1760-228-ЭМ1", "Обозначение / шифр": "1760-228-ЭМ1", "Организация": "ООО по месту защиты л", "Город / адрес": "Минск Беларусь", "Стадия (обозначение)": "С", "Лист": "7"}),
    3: ("С 14", {"Стадия (обозначение)": "С", "Лист": "14"}),
    4: ("С-14", {"Стадия (обозначение)": "С"}),
    5: ("Лист 0 л. 3 Копировал лист", {"Лист": "3"}),
    6: ("Копировал\nКопировал Петрова; очередь строительства", {}),
    7: (None, {}),
    8: ("", {}),
    9: ("ТУ 34-43-12515-78; Масштаб 1-500", {}),
}


def test_fields(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in TEXTS.items()], "doc_id long, text string")
    got: dict = {k: {} for k in TEXTS}
    for r in title_block.fields(df).collect():
        assert stamp.FIELDS[r["place"] - 1] == r["field"] and r["field"] not in got[r["doc_id"]]
        got[r["doc_id"]][r["field"]] = r["value"]
    assert got == {k: want for k, (_, want) in TEXTS.items()}


@pytest.mark.parametrize(
    ("field", "value", "bad"),
    [
        ("Лист", "Лист", True), ("Лист", "5", False), ("Масштаб", "500", True), ("Формат", "1:500", True), ("Формат", "Формат A4", False), ("Стадия", "П", True), ("Стадия", "очередь", True),
        ("Очередь строительства", "очередь строительства", True), ("Очередь строительства", "1 очередь", False), ("Город / адрес", "по месту защиты", True), ("Организация", "ООО 1760-0-ЭМ", True),
        ("Организация", 'ООО "Xy zz qq"', False), ("Организация", "ООО на по до от стройка", True), ("Организация", "ООО Стройпроект", False), ("Стадия (обозначение)", "Ф", True), ("Организация", "—", True),
    ],
)
def test_garbage_of_fields(spark, field, value, bad):
    assert spark.createDataFrame([(field, value)], "f string, v string").select(stamp.garbage_value(F.col("f"), F.col("v"))).first()[0] is bad


GOOD = ["Генеральный план благоустройства территории", "План сетей связи", "Схема электрических соединений", "Реконструкция, план участка", "Шкаф управления, схема соединений"]
BAD = [
    "", "Разраб. Иванов план", 'РУ "Проект"', "ООО план ООО", "Стадия проекта", "очередь строительства первая", "1760-0-ЭМ план", "11.25. план участка", "Рабочая документация", "Минск Беларусь", '"Стройпроект"',
    "Реконструкция участка", "Шкаф управления насосом", "План (1,2) участка", "ПлАнУч участка", "ПЛАНУЧАСТКА сети", "План | сети", "план", "aaaaa план участка", "по на до план сети из", "бвгд жзкл мнпр план",
]


def test_titles_by_line(spark):
    df = spark.createDataFrame([(t,) for t in GOOD + BAD], "t string")
    assert [r[0] for r in df.select(stamp.section_title(F.col("t"))).collect()] == [True] * len(GOOD) + [False] * len(BAD)


def test_titles_once_and_apart_from_fields(spark):
    text = 'ООО "Стройпроект"\nГенеральный план благоустройства участка\nгенеральный план благоустройства участка.\n11.25. План сетей связи участка\nПлан участка Стройпроект | Схема Электрических Соединений\nсхема теплоснабжения'
    got = title_block.titles(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"))
    assert [(r["place"], r["title"]) for r in got.orderBy("place").collect()] == [(0, "Генеральный план благоустройства участка"), (1, "Схема теплоснабжения"), (2, "Схема Электрических Соединений")]


def test_titles_of_two_sources(spark):
    """The first source wins and is added to; without it like titles of the second become the most readable one."""
    rows = [
        (1, 0, 1, "План сетей связи участка"), (1, 1, 1, "план сетей связи"), (1, 1, 2, "Схема теплоснабжения квартала"), (1, 0, 2, "План сетей связи участка"), (1, 1, 3, "Ситуационный план местности"),
        (2, 1, 1, "План сетей связи мнптк"), (2, 1, 2, "План сетей связи"), (2, 1, 3, "Схема теплоснабжения квартала"), (3, 0, 1, "лист"), (3, 1, 1, "План сетей связи"),
    ]
    maps = spark.createDataFrame([(1, {"Лист": "Ситуационный план местности города"})], "doc_id long, fields map<string, string>")
    got = title_block.merged_titles(spark.createDataFrame(rows, "doc_id long, source int, ord long, title string"), maps).collect()
    assert sorted((r["doc_id"], r["place"], r["title"]) for r in got) == [
        (1, 0, "План сетей связи участка"), (1, 1, "Схема теплоснабжения квартала"), (2, 0, "План сетей связи"), (2, 1, "Схема теплоснабжения квартала"), (3, 0, "План сетей связи"),
    ]


def test_the_most_titles(spark):
    text = "\n".join(f"План сетей номер {n:02d} участка" for n in range(40))
    assert title_block.titles(spark.createDataFrame([(1, text)], "doc_id long, text string")).count() == 20
