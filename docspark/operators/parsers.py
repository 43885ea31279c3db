"""Parsers of whole sheets as plans over lines: sections with their fallbacks, specifications, titles, signatures, spelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import grammar as g
from docspark.functions import lines as ln
from docspark.functions import sheet
from docspark.operators import blocks, tables
from docspark.operators.extract import first_of


def discovered(docs: DataFrame, anchors: dict[str, str]) -> DataFrame:
    """doc_id, found_by, section_no, kind, start_line, n_lines: a document's anchored sections; where it has none its blocks of
    "Таблица N"; else the whole text as one table."""
    lines = tables.lines_of(docs)
    of = lambda df, how: df.select("doc_id", F.lit(how).alias("found_by"), "section_no", "kind", "start_line", "n_lines")
    by_anchor = of(tables.sections(docs, anchors), "anchor")
    labelled = blocks.table_blocks(lines).select("doc_id", F.col("block_no").alias("section_no"), F.lit("table").alias("kind"), "start_line", (F.col("end_line") - F.col("start_line") + 1).alias("n_lines"))
    by_label = of(labelled.join(by_anchor.select("doc_id").distinct(), "doc_id", "left_anti"), "label")
    rest = docs.join(by_anchor.select("doc_id").unionByName(by_label.select("doc_id")).distinct(), "doc_id", "left_anti")
    whole = rest.select("doc_id", F.lit(1).alias("section_no"), F.lit("table").alias("kind"), F.lit(0).alias("start_line"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n_lines"))
    return by_anchor.unionByName(by_label).unionByName(of(whole, "whole"))


def specification(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, pos, designation, name, qty: the rows below a document's first head, also those glued into one line, as far
    as they have a position and a name."""
    head = blocks.merged_headers(lines).groupBy("doc_id").agg(F.min(F.struct("line_no", "n_lines")).alias("h")).select("doc_id", (F.col("h.line_no") + F.col("h.n_lines")).alias("begin"))
    below = lines.join(head, "doc_id").where("line_no >= begin")
    rows = below.select("doc_id", "line_no", F.posexplode(sheet.spec_position(F.col("line"))).alias("piece", "text"))
    return rows.select("doc_id", "line_no", "piece", g.once(ln.loose_row(F.col("text"))).alias("row")).where("row.pos <> '—'").select("doc_id", "line_no", "piece", "row.*")


def titles_of_blocks(lines: DataFrame) -> DataFrame:
    """doc_id, block_no, number, title: of each "Таблица N" block the title-like lines before its first head, joined."""
    marks = blocks.table_blocks(lines)
    inside = lines.join(marks.select("doc_id", "block_no", "start_line", "end_line"), "doc_id").where("line_no > start_line and line_no <= end_line")
    w = Window.partitionBy("doc_id", "block_no").orderBy("line_no")
    before = inside.withColumn("heads", F.count_if(ln.column_header(F.col("line"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("heads = 0")
    found = before.where(ln.title_like(F.col("line"))).groupBy("doc_id", "block_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.trim("line").alias("line")))), lambda x: x["line"]), " ").alias("title"))
    return marks.join(found, ["doc_id", "block_no"], "left").select("doc_id", "block_no", "number", F.coalesce("title", F.lit("")).alias("title"))


def signatures(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, role, name, date: the first row of each role in a document."""
    found = lines.select("doc_id", "line_no", g.once(ln.signature(F.col("line"))).alias("s")).where("s is not null").select("doc_id", "line_no", "s.*")
    return first_of(found, ["doc_id", "role"], ["line_no"])


def usable_blocks(fields: DataFrame, signed: DataFrame, titles: DataFrame) -> DataFrame:
    """doc_id, usable of title blocks: two good fields, a signature by a person, and up to three titles. ``fields(doc_id, field,
    value)``, ``signed(doc_id, name)``, ``titles(doc_id, title)``; a reference cipher is no good field."""
    good = fields.where(F.coalesce("value", F.lit("")).isin("", "—") == F.lit(False)).where(~(F.contains(F.lower("field"), F.lit("шифр")) & sheet.reference_cipher(F.col("value"))))
    n = good.groupBy("doc_id").agg(F.count("*").alias("n_fields"))
    s = signed.where(ln.person_name(F.col("name"))).groupBy("doc_id").agg(F.count("*").alias("n_signed"))
    t = titles.groupBy("doc_id").agg(F.count("*").alias("n_titles"))
    every = fields.select("doc_id").distinct().join(n, "doc_id", "left").join(s, "doc_id", "left").join(t, "doc_id", "left")
    return every.select("doc_id", ((F.coalesce("n_fields", F.lit(0)) >= 2) & (F.coalesce("n_signed", F.lit(0)) >= 1) & (F.coalesce("n_titles", F.lit(0)) <= 3)).alias("usable"))


def first_sections(sections: DataFrame) -> DataFrame:
    """The first explication and the first legend of each document, by ``ord``."""
    return first_of(sections.where("kind in ('explication', 'legend')"), ["doc_id", "kind"], ["ord"])


def tile_texts(tiles: DataFrame, enough: int = 120) -> DataFrame:
    """doc_id, tile_no, text: the text layer of ``tiles(doc_id, tile_no, layer, ocr)``, with what was recognised below it where the
    layer is shorter than ``enough``."""
    layer, ocr = (F.trim(F.coalesce(c, F.lit(""))) for c in ("layer", "ocr"))
    both = F.array_join(F.filter(F.array(layer, F.when(F.length(layer) < enough, ocr)), lambda x: F.coalesce(x, F.lit("")) != ""), "\n\n")
    return tiles.select("doc_id", "tile_no", both.alias("text"))


def ordered_words(words: DataFrame) -> DataFrame:
    """``place`` of each word on its page: by rounded top, then by left edge."""
    w = Window.partitionBy("doc_id", "page_no").orderBy(F.round("y0"), "x0", "ord")
    return words.withColumn("place", F.row_number().over(w))


def suggestions(words: DataFrame, dictionary: DataFrame, most: int = 1) -> DataFrame:
    """word, suggestion, distance: of the dictionary words within ``most`` (1) edits of each word that is none itself, the nearest, most
    frequent, first one. ``words(word)``, ``dictionary(word, n)``; words meet on what is left of them without one letter."""
    keys = lambda c: F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.overlay(c, F.lit(""), i, F.lit(1)))))
    unknown = words.select("word").distinct().join(dictionary, "word", "left_anti")
    met = unknown.withColumn("key", F.explode(keys(F.col("word")))).join(dictionary.select(F.col("word").alias("known"), "n", F.explode(keys(F.col("word"))).alias("key")), "key").drop("key").distinct()
    near = met.withColumn("distance", F.levenshtein("word", "known")).where(F.col("distance") <= most)
    return near.groupBy("word").agg(F.min_by(F.struct("known", "distance"), F.struct("distance", -F.col("n"), "known")).alias("best")).select("word", F.col("best.known").alias("suggestion"), "best.distance")
