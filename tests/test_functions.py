"""Column functions on chosen values, sources on small files, streams, and the tree without the subpackage."""

from __future__ import annotations

import datetime
import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from docspark.functions import grammar as g
from docspark.functions import scalar as s
from docspark.operators import extract, history, layout, registry, resolve, tables
from docspark.sources import readers
from docspark.streaming import messages


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(str(n)) for n, c in enumerate(columns))).first())


L = F.lit


def test_formats(spark):
    assert one(spark, g.format_gost(L("94.67-75")), g.format_gost(L("5264 80-11")), g.format_gost(L("9467-75"))) == ("9467-75", "5264-80", "9467-75")
    assert one(spark, g.format_stb(L("2073 2010")), g.format_stb(L("097-2012")), g.format_stb(L("1097 - 2012"))) == ("2073-2010", "1097-2012", "1097-2012")
    assert one(spark, g.format_ost(L("34 10 757-97")), g.format_ost(L("10834501-80"))) == ("34 10.757-97", "108.345.01-80")
    assert one(spark, g.format_stp(L("34 17 101")), g.format_tkp(L("+5 - 3.02 - 7 - 2005"))) == ("34.17.101", "45-3.02-7-2005")


def test_completeness(spark):
    cases = [("ГОСТ", "481-80", True), ("ГОСТ", "481", False), ("ГОСТ", "481-1899", False), ("ОСТ", "34 10.757-97", True), ("ОСТ", "5915-70", False), ("СТБ", "2235-20", False), ("СТБ", "2235-2011", True), ("СП", "63.13330.2018", True), ("СП", "1202-", False), ("ТУ", "14-3-190-82", True), ("ТУ", "14-3", False), ("СО", "153-34.21.122-2003", True)]
    df = spark.createDataFrame(cases, "kind string, num string, want boolean")
    assert df.where(g.number_complete(F.col("num"), F.col("kind")) != F.col("want")).count() == 0


def test_kinds_and_keys(spark):
    assert one(spark, g.kind_label(L(" GOST")), g.kind_label(L("Сн и П")), g.kind_label(L("oct")), g.kind_label(L("x")), g.kind_label(L(None).cast("string"))) == ("ГОСТ", "СНиП", "ОСТ", "x", "")
    assert one(spark, g.canonical_key(L("ГОСТ"), L("ГОСТ 19903-2015")), g.base_key(L("ГОСТ"), L("ГОСТ 19903-2015")), g.canonical_key(L("РД"), L("РД 34.17.101"))) == ("гост:199032015", "гост:19903", "рд:3417101")
    assert one(spark, g.clip_number(L("5264-80 сварка 12"), L("ГОСТ")), g.clip_number(L("34 10.757-97 лист"), L("ОСТ"))) == ("5264-80", "34 10.757-97")
    assert one(spark, g.digits_compatible(L("896275"), L("896975")), g.digits_compatible(L("896275"), L("896276")), g.digits_compatible(L(""), L("1")), g.digits_compatible(L("12345"), L("54321"))) == (True, False, False, False)
    assert one(spark, g.query_variants(L("ГОСТ"), L("ГОСТ 8962-75")))[0][:4] == ["ГОСТ 8962-75", "8962-75", "8962.75"]


def test_golden_text(spark):
    text = "01 ОСТ 34 10.757-97\nЛист 5x250x250 GOST 19903–2015, СТП 34.17.101 (РД 34.17.101)\nГОСТ 481-80 и снова ГОСТ 481-80; FOCT 5264-80 25х2 ГОСТ"
    got = extract.references(spark.createDataFrame([(1, 1, text), (2, 1, None), (3, 1, "")], "doc_id long, source_ord long, text string")).orderBy("ord").collect()
    assert [(r["kind"], r["ref"]) for r in got] == [("ОСТ", "ОСТ 34 10.757-97"), ("ГОСТ", "ГОСТ 19903-2015"), ("СТП", "СТП 34.17.101"), ("РД", "РД 34.17.101"), ("ГОСТ", "ГОСТ 481-80"), ("ГОСТ", "ГОСТ 5264-80")]


def test_votes_and_variants(spark):
    readings = [(1, 1, "ГОСТ", "ГОСТ 5264-80"), (1, 2, "ГОСТ", "ГОСТ 5264-80"), (1, 3, "ГОСТ", "ГОСТ 5266-80"), (1, 1, "ГОСТ", "ГОСТ 7798-70"), (1, 2, "ГОСТ", "ГОСТ 7798-70"), (1, 3, "ГОСТ", "ГОСТ 7798-71")]
    votes = resolve.source_votes(spark.createDataFrame(readings, "doc_id long, source_ord long, kind string, ref string"))
    assert {r["ref"] for r in resolve.without_conflicts(resolve.year_variants(votes)).collect()} == {"ГОСТ 5264-80", "ГОСТ 7798-70"}


def test_amendment_is_found_without_its_base(spark):
    refs = spark.createDataFrame([("СТБ", "СТБ 2235-2011")], "kind string, ref string")
    rows = spark.createDataFrame([(1, "Изменение №1 СТБ 2235-2011", "Трубы"), (2, "СТБ 2235-2012", "Другое")], "row_ord long, code string, name string")
    assert [tuple(r) for r in registry.match_a(refs, rows).select("row_ord", "score").collect()] == [(1, 65)]


def test_dates_and_status(spark):
    day = L("2024-01-01").cast("date")
    assert one(spark, s.dotted_date(L("с 01.04.2021 г.")), s.dotted_date(L("31.02.2021")), s.dotted_date(L("нет")), s.registry_date(L("2021-04-01 00:00:00.000"))) == (datetime.date(2021, 4, 1), None, None, datetime.date(2021, 4, 1))
    none = L(None).cast("date")
    assert one(spark, s.validity(none, none, day), s.validity(L("2025-01-01").cast("date"), none, day), s.validity(none, day, day), s.validity_b(L("2020-01-01").cast("date"), none, L("0"), day)) == ("неизвестно", "не введён", "отменён", "отменён")
    assert one(spark, s.consensus(L(True), L("актуален"), L(True), L("актуален")), s.consensus(L(True), L("актуален"), L(None).cast("boolean"), L("актуален"))) == ("актуален", "проверка вручную")


def test_text_functions(spark):
    assert one(spark, s.token_estimate(L("абвг" + "x" * 9)), s.token_estimate(L(""))) == (5, 1)
    assert one(spark, s.mixed_script(L("Нaсос")), s.mixed_script(L("Насос abc")), s.mixed_script(L("Насос"))) == (True, True, False)
    assert one(spark, s.homoglyphs(L("HAСОC 12\n\n abc")), s.mask(L("secret")), s.login_name(L("DOM\\Ann@x"))) == ("НАСОС 12\nabc", "se••••", "ann")
    assert one(spark, s.row_cells(L("| a | b ||c |")), s.row_cells(L("a  b c   d")), s.column_name(L("Кол-во")))[:3] == (["a", "b", "c"], ["a", "b c", "d"], "Кол.")
    assert one(spark, s.readability(L("ab")), s.readability(L("Опора скользящая")) > 7.5) == (-100.0, True)


def test_spans_and_layout(spark):
    spans = spark.createDataFrame([(1, 1, 0, 10), (1, 1, 2, 5), (1, 1, 0, 10), (1, 1, 5, 12), (1, 1, 2, 10)], "doc_id long, source_ord long, start long, stop long")
    assert sorted((r["start"], r["stop"]) for r in extract.outermost(spans).collect()) == [(0, 10), (0, 10), (5, 12)]
    page = spark.createDataFrame([(1, 1, 1200.0, 800.0, 4, 2)], "doc_id long, page_no long, width double, height double, cols int, rows int")
    tiles = layout.tile_grid(page).collect()
    assert len(tiles) == 8 and min(t["x0"] for t in tiles) == 0 and max(t["x1"] for t in tiles) == 1200


def test_sections_and_notes(spark):
    text = "Спецификация\nПоз. 1\nСпецификация\nУсловные обозначения\nx\n1 Держать сухим и чистым\n2 ГОСТ 481-80 прокладка плоская"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = [(r["kind"], r["start_line"], r["n_lines"]) for r in tables.sections(docs, {"specification": "(?iu)^специф", "legend": "(?iu)^условные"}).orderBy("section_no").collect()]
    assert got == [("specification", 0, 3), ("legend", 3, 4)]
    assert [r["note"] for r in tables.numbered_notes(docs).collect()] == ["1 Держать сухим и чистым"]


def test_pack(spark):
    assert one(spark, history.pack(F.array(*(L(x).cast("long") for x in (5, 5, 1, 20, 3))), 10))[0] == [0, 0, 1, 2, 3]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("имя,n\nОпора,1\n".encode("cp1251"))
    assert [tuple(r) for r in readers.delimited(spark, str(tmp_path / "a.csv"), encoding="cp1251").collect()] == [("Опора", "1")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t/x.txt").write_text("one\ntwo")
    assert readers.text_files(spark, str(tmp_path / "t")).first()["text"] == "one\ntwo"
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x.bin").write_bytes(b"p1|p2| ")
    (tmp_path / "d/y.bin").write_bytes(b"!")

    def parse(data):
        if data == b"!":
            raise ValueError("empty")
        return data.decode().split("|")

    pages = readers.documents(spark, str(tmp_path / "d"), parse)
    assert sorted((r["page_no"], r["text"]) for r in pages.collect() if r["text"] is not None) == [(1, "p1"), (2, "p2"), (3, " ")] and pages.where("page_no = 0").count() == 1
    assert readers.with_headers(pages).count() == 2 and readers.scanned(pages).where("scanned").count() == 2
    body = spark.createDataFrame([(1, '[0,[{"docid":"7","code":"A"},{"docid":"8","code":"B"}],1,2]'), (2, '[0,[{"docid":"7","code":"C"}],1,2]')], "page_no long, body string")
    assert sorted((r["docid"], r["code"]) for r in readers.registry_rows(body).collect()) == [("7", "C"), ("8", "B")]
    assert one(spark, readers.response_text(L('{"text":"","markdown":"m"}')), readers.response_text(L("plain"))) == ("m", "plain")
    readers.write_train_list(spark.createDataFrame([("i.png", "a\nb")], "image string, text string"), str(tmp_path / "list"))
    assert spark.read.text(str(tmp_path / "list")).first()[0] == "i.png\ta\\nb"


def test_streams(spark, sf, tmp_path):
    (tmp_path / "in").mkdir()
    shutil.copy(f"{sf}/conversations.parquet", tmp_path / "in/a.parquet")
    stream = messages.running_tokens(messages.message_stream(spark, str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("tokens").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = spark.read.parquet(f"{sf}/conversations.parquet")
    assert sorted(map(tuple, spark.table("tokens").collect())) == sorted(map(tuple, messages.running_tokens(batch).collect()))
    spark.createDataFrame([(1, 1, "по ГОСТ 481-80")], "doc_id long, source_ord long, text string").write.parquet(str(tmp_path / "pages"))
    seen = []
    pages = spark.readStream.schema("doc_id long, source_ord long, text string").parquet(str(tmp_path / "pages"))
    messages.extract_stream(pages, lambda df, n: seen.extend(r["ref"] for r in df.collect()), str(tmp_path / "check")).awaitTermination()
    assert seen == ["ГОСТ 481-80"]


def test_tree_without_the_subpackage(tmp_path):
    """The entry imports and keeps its other queries when llm and the pipeline are gone."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env=env).returncode == 0


@pytest.mark.parametrize("name", ["docspark"])
def test_nothing_imports_the_subpackage(name):
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), name)
    for folder, _, files in os.walk(root):
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as text:
                    assert "import llm" not in (body := text.read()) and "from llm" not in body


def test_reconciled(spark):
    from docspark.plans import pipelines

    rows = [(1, 1, "по ГОСТ 5264-80 и ГОСТ 7798-70"), (1, 2, "по ГОСТ 5264-80, ГОСТ 7798-70"), (1, 3, "по ГОСТ 5266-80 и ГОСТ 7798-71"), (1, 4, "по ГОСТ 5264-80, ГОСТ 7798-70"), (2, 1, None), (2, 2, "СТБ 2235-2011")]
    got = pipelines.reconciled(spark.createDataFrame(rows, "doc_id long, source_ord long, text string")).collect()
    assert sorted((r["doc_id"], r["ref"]) for r in got) == [(1, "ГОСТ 5264-80"), (1, "ГОСТ 7798-70"), (2, "СТБ 2235-2011")]
