"""Steps whose work must grow with their input: keys that many rows share, tables of one row group, and keys beyond the smallest tables."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from docspark.functions import grammar as g
from docspark.functions import lines as ln
from docspark.functions import rows
from docspark.functions import scalar as sc
from docspark.functions import sheet
from docspark.operators import blocks, extract, layout, legend, parsers, resolve, rewriting, sections, specification, title_block
from docspark.plans import inputs as i
from docspark.plans import queries, sheet_queries  # noqa: F401


def made(df) -> int:
    """Rows that the joins of a plan put out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    todo, rows = [plan], 0
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if "Join" in name:
            rows += p.metrics().apply("numOutputRows").value()
        if name == "AdaptiveSparkPlan":
            todo.append(p.executedPlan())
        elif "QueryStage" in name:
            todo.append(p.plan())
        children = p.children()
        todo += [children.apply(k) for k in range(children.size())]
    return rows


def test_a_query_asked_often_brings_one_row(spark):
    asked = spark.range(300).select(F.lit("k").alias("kind"), F.col("id").cast("string").alias("ref"), F.lit(1).alias("step"), F.lit("q").alias("query"))
    hits = spark.range(300).select(F.lit("q").alias("query"), (F.col("id") % 2 == 0).alias("full"), F.col("id").alias("row_ord"), (F.col("id") % 50).cast("int").alias("score"))
    found = blocks.escalated(asked, hits)
    assert {tuple(r)[2:] for r in found.collect()} == {(1, False, 49, 49)} and found.count() == 300
    assert made(found) <= 300


def test_notes_in_rows_meet_on_rare_grams(spark):
    notes = spark.range(200).select((F.col("id") % 2).alias("doc_id"), F.concat(F.lit("Опора неподвижная № "), F.col("id") + 1000).alias("note"))
    rows = spark.range(200).where("id % 4 = 0").select((F.col("id") % 2).alias("doc_id"), F.concat(F.lit("1 НеОпора неподвижная № "), F.col("id") + 1000, F.lit(" шт")).alias("name"))
    left = sections.new_notes(notes.unionByName(notes), rows.unionByName(rows))
    assert sorted(r["note"] for r in left.distinct().collect()) == [f"Опора неподвижная № {k + 1000}" for k in range(200) if k % 4]
    assert left.count() == 300
    # a note is cut out of a word of the row
    within = spark.createDataFrame([(1, "пора неподвижная хомутовая"), (1, "короткая запись")], "doc_id long, note string")
    row = spark.createDataFrame([(1, "Опора неподвижная хомутовая; короткая запись")], "doc_id long, name string")
    assert [r["note"] for r in sections.new_notes(within, row).collect()] == ["короткая запись"]
    assert made(left) < 6000


def test_swaps_of_a_digit_make_no_pairs(spark):
    refs = spark.range(600).select(F.lit(1).cast("long").alias("doc_id"), F.lit("ОСТ").alias("kind"), F.concat(F.lit("ОСТ 34 10."), 700 + F.col("id") % 2 * 100, F.lit("-"), 70 + F.col("id") % 3).alias("ref"))
    more = refs.where("ref like '%700%'").unionByName(refs)
    kept = resolve.one_digit_swaps(more)
    assert {r["ref"][:10] for r in kept.collect()} == {"ОСТ 34 10."} and all("700" in r["ref"] for r in kept.collect())
    assert made(kept) < 2000


def test_designations_with_large_keys_are_no_ciphers(spark):
    df = spark.createDataFrame([(1, 1, "34-43-1000000-78"), (1, 2, "1000 - 0 - ЭМ1"), (2, 1, "34-43-12345678-78")], "doc_id long, ord long, raw string")
    best = sections.best_ciphers(df).select("doc_id", "cipher", sheet.cipher_rank(F.col("cipher"))["bonus"].alias("bonus"))
    assert {r["doc_id"]: r["cipher"] for r in best.collect()} == {1: "1000-0-ЭМ1", 2: "34-43-12345678-78"}
    assert best.where("doc_id = 2").first()["bonus"] == -100


def test_rows_of_one_file_are_dealt_to_tasks(spark, tmp_path):
    spark.range(20_000).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    df = i.frame(spark, str(tmp_path), "SELECT p_partkey FROM {part}")
    assert df.rdd.getNumPartitions() >= 8 and df.count() == 20_000
    assert i.frame(spark, str(tmp_path), "SELECT p_partkey FROM {part} WHERE p_partkey < 0").count() == 0


def test_fields_read_a_text_once(spark, tmp_path):
    spark.createDataFrame([(1, "Стадия П\nМасштаб 1:500")], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    found = title_block.fields(spark.read.parquet(str(tmp_path / "docs")))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert {(r["field"], r["value"]) for r in found.collect()} == {("Стадия (обозначение)", "П"), ("Масштаб", "1:500")}


def test_readability_is_what_it_was(spark):
    texts = ["", "ab", "Опора скользящая", "ОПОРА  bcd |©[]_`", "бвгджз ссссс Ёлка", None, "12345 — аеё", "план План ПЛАН ыыы"]
    want = []
    for t in texts:
        s = " ".join((t or "").split())
        n = sum(c in "ёЁ" or "А" <= c <= "я" for c in s)
        share = sum(c in "аеёиоуыэюя" for c in s.lower()) / max(n, 1)
        score = share * 40 + min(n, 80) * 0.15 - (18 if share < 0.18 or share > 0.62 else 0)
        score -= sum("a" <= c.lower() <= "z" for c in s) * 4 + sum(c in "|©[]_`" for c in s) * 6
        runs = lambda k, ok: any(all(ok(s.lower()[a], c) for c in s.lower()[a : a + k]) and len(s[a : a + k]) == k for a in range(len(s)))  # noqa: E731, B023
        score -= (12 if runs(5, lambda _, c: c in "бвгджзклмнпрстфхцчшщ") else 0) + (8 if runs(4, lambda f, c: c == f) else 0)
        want.append(-100.0 if len(s) < 3 else -50.0 if n < 3 else score)
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k").select(sc.readability(F.col("t"))).collect()]
    assert [round(x, 9) for x in got] == [round(x, 9) for x in want]


def test_equal_texts_are_read_once(spark):
    rows = spark.range(60).select(F.col("id"), F.concat(F.lit("строка "), F.col("id") % 4).alias("line"))
    got = legend.read_once(rows, "line", F.uuid(), "v").collect()
    assert sorted(r["id"] for r in got) == list(range(60))
    assert len({(r["line"], r["v"]) for r in got}) == 4


def planned(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_runs_of_words_meet_whole_numbers(spark):
    refs = spark.range(400).select(F.lit(1).cast("long").alias("doc_id"), F.lit("ГОСТ").alias("kind"), F.concat(F.lit("ГОСТ "), 10000 + F.col("id"), F.lit("-80")).alias("ref"))
    words = refs.select("doc_id", F.lit(1).cast("long").alias("page_no"), F.posexplode(F.split("ref", " ")).alias("pos", "text"), F.regexp_extract("ref", r"(\d+)-", 1).cast("long").alias("n"))
    found = blocks.spans_of_words(words.select("doc_id", "page_no", (F.col("n") * 2 + F.col("pos")).alias("ord"), "text"), refs)
    assert sorted(r["ref"] for r in found.collect()) == [f"ГОСТ {10000 + k}-80" for k in range(400)]
    # texts are read before the join, not for each pair of numbers that begin alike
    assert not any("regexp" in x for x in planned(found).splitlines() if "Join" in x)


def test_texts_are_rewritten_once(spark):
    sources = spark.range(3).select(F.col("id").alias("doc_id"), F.lit(1).alias("source_ord"), F.lit("по Г0СТ 1234-75 и ОСТ 34 10.567-83").alias("text"))
    found = extract.outermost(extract.spans(sources))
    assert planned(found).count("read_text(") == 1
    assert {r["ref"] for r in found.collect()} == {"ГОСТ 1234-75", "ОСТ 34 10.567-83"} and found.count() == 6


def test_rules_left_out_find_nothing():
    """Texts of pieces that the rules look for read the same with all rules tried."""
    bits = ["г о с т", "Г0СТ", "goct", "ост", "0СТ", "сб", "ct5", "с т п", "TKP +5", "с н и п", "chip", "СН", "hrr", "ту", "(ту\n", "PA", "с о", "с СО 34", "npb", "34 10.567-97", "1234-75", "3,05.44-85", "2073-2010", "1234-19 75", "-8512ОСТ 34", "-80ГОСТ 5", "согласно ", "ТНПА", ";", "\n", "|", " - ", "\t–\t", "25х2", "\n12 1234-5678", "ſt", "К", " ", "12", "+5"]
    draw = random.Random(3)
    for _ in range(1500):
        text = draw.choice(("", " ")).join(draw.choices(bits, k=draw.randint(1, 9)))
        want, rules = text, rewriting._RULES
        for pattern, new in rules:
            want = pattern.sub(new, want)
        edits = rewriting.whole_years(want)
        assert rewriting.rewrite(text)[0] == (rewriting.edited(want, np.arange(len(want) + 1), edits)[0] if edits else want)


def test_votes_are_counted_once(spark):
    readings = spark.range(40).select(F.lit(1).alias("doc_id"), (F.col("id") % 3).alias("source_ord"), F.lit("ГОСТ").alias("kind"), F.concat(F.lit("ГОСТ "), 1230 + F.col("id") % 4, F.lit("-80")).alias("ref"))
    pairs, kept = resolve.number_conflicts(resolve.source_votes(readings)), resolve.without_conflicts(resolve.source_votes(readings))
    assert planned(pairs).count("Range (") == 0 and planned(kept).count("Range (") == 0
    assert pairs.count() == 6 and kept.count() == 4


def test_parts_of_a_query_are_computed_once(spark):
    refs = spark.createDataFrame([("ОСТ", "ОСТ 34 10.567-83"), ("ТУ", "ТУ 14-3-123-80"), ("СН", ""), ("СП", None)], "kind string, ref string")
    read = refs.select(g.query_variants(F.col("kind"), F.col("ref")).alias("v"))
    assert planned(read).count("regexp_") < 60
    got = [r["v"] for r in read.collect()]
    assert got[0][:2] == ["ОСТ 34 10.567-83", "34 10.567-83"] and "14-3-123" in got[1] and got[2:] == [["СП"], ["СН"]]


def test_lines_are_read_once(spark):
    lines = spark.range(30).select(F.col("id").alias("doc_id"), F.lit(1).alias("line_no"), F.when(F.col("id") % 2 == 0, "| Разраб. | Иванов | | 11.25 |").otherwise("ГИП | 123 | -").alias("line"))
    signed = parsers.signatures(lines)
    assert planned(signed).count("гип") == 1
    assert {tuple(r)[2:5] for r in signed.collect()} == {("Разраб.", "Иванов", "11.25")} and signed.count() == 15
    read = lines.select(ln.loose_row(F.concat(F.lit("12 ТМ-7 Опора стальная "), F.col("doc_id"))).alias("row"))
    assert planned(read).count("наименован") < 12
    assert read.where("row.qty = '7'").first()["row"].asDict() == {"pos": "12", "designation": "ТМ-7", "name": "Опора стальная", "qty": "7"}


def test_words_of_a_line_are_dealt_once(spark):
    words = spark.range(60).select((F.col("id") % 2).alias("doc_id"), F.lit(1).alias("page_no"), F.floor(F.col("id") / 2).alias("ord"), F.lit(0.0).alias("y0"), F.lit(5.0).alias("y1"))
    pairs = layout.same_line(words)
    assert "Join" not in planned(pairs)
    assert sorted(map(tuple, pairs.select("doc_id", "first", "second").collect())) == [(d, a, b) for d in (0, 1) for a in range(30) for b in range(a + 1, min(a + 14, 30))]


def test_predicates_of_one_file_are_dealt(spark, tmp_path):
    spark.range(20_000).select(F.col("id").alias("p_partkey"), F.lit("a b").alias("p_name")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    assert sheet_queries.sheet_predicates(spark, str(tmp_path)).rdd.getNumPartitions() >= 8


def test_lines_around_blocks_are_read_once(spark):
    lines = spark.range(40).select((F.col("id") / 4).cast("long").alias("doc_id"), (F.col("id") % 4).cast("int").alias("line_no"), F.element_at(F.array(F.lit("Таблица 1"), F.lit("Разрезы первого участка"), F.lit("Наименование | Кол."), F.lit("1 Труба")), (F.col("id") % 4 + 1).cast("int")).alias("line"))
    found = legend.block_titles(lines, spark.range(10).select(F.col("id").alias("doc_id"), F.lit(1).alias("block_no"), F.lit(0).alias("start_line"), F.lit(4).alias("end_line"), F.lit("table").alias("kind")))
    assert any("Join Inner, (line#" in x for x in planned(found).splitlines())
    assert {tuple(r)[2:] for r in found.collect()} == {("between", "Разрезы первого участка")} and found.count() == 10


def test_lines_of_specifications_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(rows):
        for row in rows:
            read.add(1)
            yield row

    text = ["Поз. | Обозначение | Наименование | Кол.", "1 | ТМ-1 | Реле времени | 2", "по ГОСТ 8731-74", "Опора"]
    rows = [(k, n, line) for k in range(6) for n, line in enumerate(text if k % 2 else [text[0], *text[2:]])]
    lines = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).mapPartitions(counted), "doc_id long, line_no int, line string")
    got = specification.specification(lines).collect()
    assert sorted((r["doc_id"], r["reading"], r["name"]) for r in got) == [(k, "columns", "Реле времени") if k % 2 else (k, "standards", "Опора") for k in range(6)]
    assert read.value == len(rows)


def test_mergeable_sections_meet_once(spark):
    draw = random.Random(5)
    rows = [(draw.randint(1, 3), k, draw.choice(("a", "b", None)), draw.choice(("", None, "1", "2.1")), draw.choice((None, [], draw.choices("abcdefg", k=draw.randint(1, 6)), ["a", None]))) for k in range(90)]
    want = set()
    for d, a, kind, no, keys in rows:
        for e, b, other, no_b, keys_b in rows:
            shared = set(keys or ()) & set(keys_b or ()) - {None}
            if d == e and a < b and ((no and no == no_b) or (kind and kind == other and shared and len(shared) >= 0.5 * max(len(keys), len(keys_b)))):
                want.add((d, a, b))
    df = spark.createDataFrame(rows, "doc_id long, ord long, kind string, table_number string, keys array<string>")
    pairs = sections.mergeable(df)
    assert sorted(map(tuple, pairs.collect())) == sorted(want)
    # neither side is sent whole to the tasks, and pairs are not gathered again
    assert "BroadcastHashJoin" not in planned(pairs) and "Aggregate" not in planned(pairs)
    assert made(pairs) <= 2 * len(want)
    many = df.crossJoin(spark.range(300)).select((F.col("id") * 10 + F.col("doc_id")).alias("doc_id"), "ord", "kind", "table_number", "keys")
    assert sections.mergeable(many).rdd.getNumPartitions() >= 10


def test_openings_are_sought_at_their_letters(spark):
    texts = ["Спецификация оборудования", "СПЕЦИФИКАЦИИ зданий", "продолжение таблицы 2", "Поз. обозначение", "лист эксплуатационных зданий", "Экспликация", "перечень аппаратуры", "условные знаки", "ЛЕГЕНДА", "сведения об условных обозначениях", "Реле времени", "", "12"]
    lines = spark.createDataFrame([(t,) for t in texts], "line string")
    for kinds in (("specification",), ("legend", "explication")):
        asked = rows.opens(F.col("line"), *kinds)
        plain = rows.matches(F.col("line"), *(p for k in kinds for p in rows.ANCHORS[k]))
        assert [tuple(r) for r in lines.select(asked, plain).collect()] == [(v, v) for (v,) in lines.select(plain).collect()]
        assert "(?=[" in planned(lines.select(asked))
