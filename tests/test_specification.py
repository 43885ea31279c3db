"""Specifications of single blocks, and the rewriting of single texts: what each rule does."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.functions import rows
from docspark.operators import blocks, extract, rewriting, specification, tables

HEAD = "Поз. | Обозначение | Наименование | Кол."
BLOCKS = {
    1: ("columns", "Поз. | Наименование | Обозначение | Кол. | Примечание\n1 | Опора неподвижная | ОСТ 34-10-615-93 | 2 | у стены\n2* | Труба стальная | ГОСТ 8732-78 | много |", [("1", "ОСТ 34-10-615-93", "Опора неподвижная", "2", "у стены"), ("2*", "ГОСТ 8732-78", "Труба стальная", "—", "—")]),
    2: ("columns", "Обозначение | Наименование\nКол.\nГОСТ 8732-78 | Труба стальная 108х4 | 7\nОПУ, релейный зал № 2, панель 5\nТМ-12-3 | Опора неподвижная | 4", [("—", "ГОСТ 8732-78", "Труба стальная 108х4", "—", "—"), ("—", "—", "ОПУ, релейный зал № 2, панель 5", "—", "—")]),
    3: ("columns", HEAD + "\n1 | ТМ-1 | Реле времени | 2\n1 | ТМ-2 | Реле времени выдержки | 3\nИзм. | Лист\n4 | ТМ-4 | Реле тока | 1", [("1", "ТМ-2", "Реле времени выдержки", "3", "—")]),
    4: ("columns", HEAD + "\n3 Швы сварные ровные\n1 | ТМ-1 | Реле времени | 2\n4 Швы сварные ровные\n5 | ТМ-5 | Реле тока | 1", [("1", "ТМ-1", "Реле времени", "2", "—")]),
    5: ("loose", "Спецификация оборудования\n17 Реле времени 4\n18 ТМ-5 Опора неподвижная\n161 ТМ-7 Блок питания БП стабилизированный 162 Реле промежуточное\nУсловные обозначения\n19 Реле тока", [("17", "—", "Реле времени", "4", "—"), ("18", "ТМ-5", "Опора неподвижная", "—", "—"), ("161", "ТМ-7", "Блок питания БП стабилизированный", "—", "—")]),
    6: ("loose", "Перечень аппаратуры\n12 ТМ-9 Реле л. 5", [("12", "ТМ-9", "Реле л. 5", "—", "—")]),
    7: ("materials", HEAD + "\nизм. лист\n4x40 ГОСТ 103-76 полоса\n12 | 3,5\n25x4 ГОСТ 103-76\nсталь угловая\n8 1,7\nТУ 14-3-190 Тяга верхняя", [("1", "4x40 ГОСТ 103-76", "полоса 12 | 3,5", "12", "—"), ("2", "25x4 ГОСТ 103-76", "сталь угловая 8 1,7", "8", "—"), ("3", "ТУ 14-3-190", "Тяга верхняя", "—", "—")]),
    8: ("designations", HEAD + "\nИзм. | № док\nОПУ, релейный зал № 2, панель 5\nQF1 Выключатель автоматический", [("—", "—", "ОПУ, релейный зал № 2, панель 5", "—", "—")]),
    9: ("standards", HEAD + "\nИзм. | № док\nпо ГОСТ 8731-74\nОпора\nи лист", [("—", "ГОСТ 8731-74", "Опора", "—", "—")]),
    10: (None, "просто текст\nи ещё", []),
    11: (None, "", []),
    12: (None, None, []),
}


def test_specifications_of_blocks(spark):
    docs = spark.createDataFrame([(k, text) for k, (_, text, _) in BLOCKS.items()], "doc_id long, text string")
    got: dict = {k: [] for k in BLOCKS}
    how: dict = {}
    for r in specification.specification(tables.lines_of(docs)).orderBy("doc_id", "row_no").collect():
        got[r["doc_id"]].append((r["pos"], r["designation"], r["name"], r["qty"], r["note"]))
        how[r["doc_id"]] = r["reading"]
    assert got == {k: want for k, (_, _, want) in BLOCKS.items()}
    assert how == {k: reading for k, (reading, _, want) in BLOCKS.items() if want}


def test_mass_and_the_most_rows(spark):
    lines = "\n".join(f"{n} | ТМ-{n} | Реле времени | 1" for n in range(1, 100))
    docs = spark.createDataFrame([(1, HEAD + "\n" + lines), (2, HEAD + "\nизм. лист\n4x40 ГОСТ 103-76 полоса 12 3,5\n5x40 ГОСТ 103-76 полоса 7 0,5")], "doc_id long, text string")
    got = specification.specification(tables.lines_of(docs)).collect()
    assert sum(r["doc_id"] == 1 for r in got) == 80
    assert [(r["qty"], r["mass"]) for r in got if r["doc_id"] == 2] == [("12", "3.5"), ("7", "0.5")]


@pytest.mark.parametrize(
    ("test", "yes", "no"),
    [
        (rows.column_header, ["Обозначение Примечание", "№ на плане", "Кол. Масса ед.", "Номер на раме", "ед кол"], ["Таблица 3", "", "Поз. 5 у стены", "Опора стальная"]),
        (rows.section_title, ["Экспликация зданий", "Таблица 3.1", "Условные обозначения", "Кол. масса"], ["", "Опора стальная", "Экспликация зданий и сооружений на участке номер двенадцать в городе"]),
        (rows.group_line, ["ОПУ, релейный зал № 2, панель 5", "Камера, коридор и тамбур входа"], ["12 панель управления", "QF1 панель ввода", "панель 5"]),
        (rows.unreadable, ["", "аб", "бвгджзкл мн", "Oпора стальная", "аааааа опора"], ["Опора стальная", "ГОСТ 8732-78"]),
    ],
)
def test_predicates_of_lines(spark, test, yes, no):
    df = spark.createDataFrame([(t,) for t in yes + no], "line string")
    assert [r[0] for r in df.select(test(F.col("line"))).collect()] == [True] * len(yes) + [False] * len(no)


# ---------------------------------------------------------------- rewriting

NOISY = {
    "Г0СТ 8731-74": ("ГОСТ 8731-74", "Г0СТ 8731-74"),
    "г о с т 8731-74": ("ГОСТ 8731-74", "г о с т 8731-74"),
    "по ГОСТ8731-74": ("ГОСТ 8731-74", "ГОСТ8731-74"),
    "трубы ГОСТ 10704 - 91 и": ("ГОСТ 10704-91", "ГОСТ 10704 - 91"),
    "0СТ 34 10.699-97": ("ОСТ 34 10.699-97", "0СТ 34 10.699-97"),
    "TKP +5-1.03-01-2018": ("ТКП 45-1.03-01-2018", "TKP +5-1.03-01-2018"),
    "10 (ТУ\n6-21-51-90).": ("ТУ 6-21-51-90", "ТУ\n6-21-51-90"),
    "согласно 3.05.06-85 и": ("СНиП 3.05.06-85", "3.05.06-85"),
    "СНиП 3,05.06-85": ("СНиП 3.05.06-85", "СНиП 3,05.06-85"),
    "а; - 10704-91 и": ("ГОСТ 10704-91", "; - 10704-91"),
    "х-9501ОСТ 34-10-615-93": ("ОСТ 34-10-615-93", "ОСТ 34-10-615-93"),
    "ограждения FOCT 23407-78": ("ГОСТ 23407-78", "FOCT 23407-78"),
    "( приложение РД 34.03.304-87).": ("РД 34.03.304-87", "РД 34.03.304-87"),
}


def test_noisy_references_and_their_places(spark):
    df = spark.createDataFrame([(k, 1, t) for k, t in enumerate(NOISY)], "doc_id long, source_ord long, text string")
    got = {r["doc_id"]: (r["ref"], list(NOISY)[r["doc_id"]][r["raw_start"] : r["raw_stop"]]) for r in extract.spans(df).collect()}
    assert got == dict(enumerate(NOISY.values()))


def test_several_in_one_text(spark):
    text = "ГОСТ 19903-74 / Ст3сп3 ГОСТ 14637-89\nпо ГОСТ 9467-75ГОСТ 5264-80"
    got = extract.references(spark.createDataFrame([(1, 1, text), (1, 2, None), (2, 1, "")], "doc_id long, source_ord long, text string"))
    assert [r["ref"] for r in got.orderBy("ord").collect()] == ["ГОСТ 19903-74", "ГОСТ 14637-89", "ГОСТ 9467-75", "ГОСТ 5264-80"]


def test_the_map_of_places():
    text, origin = rewriting.rewrite("городской\nпо FOCT 8731-74 и CTB 2270-2012")
    assert text == "городской\nпо ГОСТ 8731-74 и СТБ 2270-2012"
    # the letters put for others stand where the first of those did
    assert origin.tolist() == [*range(13), *[13] * 4, *range(17, 28), *[28] * 3, *range(31, len(text) + 1)]
    text, origin = rewriting.edited("abcdef", np.arange(7), [(1, 4, "bXXd"), (5, 6, "")])
    assert text == "abXXde" and origin.tolist() == [0, 1, 2, 2, 3, 4, 6]
    for raw in ("ТНПА: СТБ 1033-2016; СТБ 2235-20 ; СТБ 1111-20", "", "а", "ГОСТ\n\n 8731-9120| x"):
        text, origin = rewriting.rewrite(raw)
        assert len(origin) == len(text) + 1 and (np.diff(origin) >= 0).all() and origin[-1] == len(raw)
    assert "СТБ 2235-2017" in rewriting.rewrite("ТНПА: СТБ 1033-2016; СТБ 2235-20 ;")[0]


def test_zones_at_the_limits(spark):
    pages = spark.createDataFrame([(1, 1, 945.0, 700.0, 5), (2, 1, 944.0, 700.0, 5), (3, 1, 100.0, 120.0, 1), (4, 1, 50.0, 50.0, 1)], "doc_id long, page_no long, width double, height double, n_pages int")
    got = {(r["doc_id"], r["zone"]) for r in blocks.supplement_zones(pages).collect()}
    assert got == {(1, "spec_right"), (3, "supp_notes")}
