"""Legends of single documents, notes that ran together, titles near blocks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docspark.functions import legend as lg
from docspark.operators import legend

TEXTS = {
    1: ("Условные обозначения\nТаблица 3\nОбозначение Примечание\n— Граница проектируемого участка\n1 | | Ось трассы водопровода\nОсь трассы водопровода\nбвгджз кровля\nСпецификация\nТруба стальная", ["Граница проектируемого участка", "Ось трассы водопровода"]),
    2: ("граница участка работ\nкоординаты\nГраница участка работ", ["Граница участка работ"]),
    3: ("Легенда\nНаименование\nЗдание существующее; Здание проектируемое; Здание сносимое; покрытие тротуара\nэкспликация зданий\nКабель подземный", ["Здание существующее", "Здание проектируемое", "Здание сносимое", "покрытие тротуара"]),
    4: ("Условные знаки\n12 Граница участка строительства 13 Ограждение территории площадки 14 Опора", ["12 Граница участка строительства", "13 Ограждение территории площадки", "14 Опора"]),
    5: ("Условные обозначения\nспецификация\nОсь трассы\nэкспликация", []),
    6: ("Легенда\n" + "\n".join(f"Опора номер {n} подземной трассы" for n in range(80)), [f"Опора номер {n} подземной трассы" for n in range(60)]),
    7: (None, []),
    8: ("", []),
}


def test_legends(spark):
    docs = spark.createDataFrame([(k, t) for k, (t, _) in TEXTS.items()], "doc_id long, text string")
    got: dict = {k: [] for k in TEXTS}
    for r in legend.separate_notes(legend.notes(docs)).orderBy("doc_id", "place").collect():
        got[r["doc_id"]].append(r["note"])
        assert r["place"] == len(got[r["doc_id"]])
    assert got == {k: want for k, (_, want) in TEXTS.items()}


@pytest.mark.parametrize(
    ("raw", "clean"),
    [("а) граница", "Граница"), ("(ВК) колодец", "Колодец"), ("=+ ось трассы", "Ось трассы"), ("а Опора", "Опора"), (")]. опора", "Опора"), ("повелительная насосная станция", "Повысительная насосная станция"), ("", ""), (None, "")],
)
def test_clean_notes(spark, raw, clean):
    assert spark.createDataFrame([(raw,)], "n string").select(lg.clean_note(F.col("n"))).first()[0] == clean


@pytest.mark.parametrize(
    ("note", "parts"),
    [
        ("Граница участка", ["Граница участка"]), ("", []), ("Граница участка работ. Ограждение площадки завода", ["Граница участка работ.", "Ограждение площадки завода"]),
        ("Граница участка работ, Ограждение площадки завода, Опора", ["Граница участка работ", "Ограждение площадки завода"]), ("Граница проектируемого участка строительства дороги", ["Граница проектируемого участка строительства дороги"]),
        ("12 Граница участка работ 13 бвгджз кровля дома склада", ["12 Граница участка работ"]),
    ],
)
def test_notes_that_ran_together(spark, note, parts):
    assert spark.createDataFrame([(note,)], "n string").select(lg.notes_within(F.col("n"))).first()[0] == parts


BLOCKS = {
    1: (["Таблица 1 Ведомость трубопроводов участка", "Поз. Наименование", "1 Труба"], 0, "table", ("label", "Ведомость трубопроводов участка")),
    2: (["шум", "Таблица 2", "Разрезы по участку", "разные работы на объекте", "Наименование Кол.", "1 Труба"], 1, "table", ("between", "Разрезы по участку разные работы на объекте")),
    3: (["Схема расположения опор", "а", "Таблица 3", "Наименование", "1 Труба"], 2, "table", ("near", "Схема расположения опор")),
    4: (["б", "1 Труба", "2 Опора"], 1, "table", (None, "")),
    5: (["Экспликация зданий", "и сооружений на участке", "Наименование", "1 Дом"], 0, "explication", ("between", "Сооружений на участке")),
    6: (["а", "Легенда", "1 Труба"], 1, "legend", ("anchor", "Легенда")),
    7: (["а", "Таблица 1", "Ведомость опор участка дороги", "Ведомость труб участка", "Наименование"], 1, "table", ("above", "Ведомость труб участка")),
    8: (["Схема один участка", *["а"] * 11, "Таблица 3", "1 Труба"], 12, "table", (None, "")),
    9: (["Схема один участка", *["а"] * 10, "Таблица 3", "1 Труба"], 11, "table", ("near", "Схема один участка")),
    10: (["Схема над участком", "Таблица 3", "б"], 1, "table", ("near", "Схема над участком")),
}


def test_titles_tier_by_tier(spark):
    lines = spark.createDataFrame([(d, n, x) for d, (ls, *_) in BLOCKS.items() for n, x in enumerate(ls)], "doc_id long, line_no int, line string")
    blocks = spark.createDataFrame([(d, 1, start, len(ls), kind) for d, (ls, start, kind, _) in BLOCKS.items()], "doc_id long, block_no int, start_line int, end_line int, kind string")
    got = {r["doc_id"]: (r["tier"], r["title"]) for r in legend.block_titles(lines, blocks).collect()}
    assert got == {d: want for d, (*_, want) in BLOCKS.items()}


@pytest.mark.parametrize(
    ("lines", "title"),
    [
        (["Экспликация зданий", "и сооружений", "на участке"], "Экспликация зданий и сооружений на участке"), (["Экспликация зданий", "Наименование", "и сооружений"], "Экспликация зданий"),
        (["Экспликация зданий", "Таблица 3", "и сооружений"], "Экспликация зданий"), (["Экспликация зданий номер на плане", "1 дом"], ""), (["Экспликация зданий", "12 домов"], "Экспликация зданий"),
        (["Опора"], ""), (["Экспликация", "Экспликация сооружений", "цеха"], "Экспликация Экспликация сооружений цеха"),
    ],
)
def test_titles_over_lines(spark, lines, title):
    df = spark.createDataFrame([(lines,)], "l array<string>")
    assert df.select(lg.title_of_lines(F.slice("l", 1, 4), "explication")).first()[0] == title
