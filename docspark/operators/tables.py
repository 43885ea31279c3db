"""Lines, notes, sections and rows of tables in page text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import scalar as s
from docspark.operators.extract import first_of


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line."""
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))


def line_votes(views: DataFrame) -> DataFrame:
    """Lines of several views of a document: score = distinct views, and 0.35 more if view 0 has it; the longest raw text
    stands for a key. ``views(doc_id, angle, text)``."""
    lines = views.select("doc_id", "angle", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("raw")).withColumn("raw", F.trim("raw"))
    lines = lines.withColumn("key", F.lower(F.regexp_replace("raw", r"\s+", " "))).where(F.length("key") >= 2)
    # 0.35 is added to an integer count, so the score is exact
    score = F.count_distinct("angle") + F.max(F.when(F.col("angle") == 0, 0.35).otherwise(0.0))
    return lines.groupBy("doc_id", "key").agg(F.max_by("raw", F.struct(F.length("raw"), "raw")).alias("line"), score.alias("score"))


def blocks_once(docs: DataFrame, least: int = 8, head: int = 120) -> DataFrame:
    """Blocks between blank lines, the first of each folded head."""
    blocks = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\n\s*\n")).alias("block_no", "block")).withColumn("block", F.trim("block")).where(F.length("block") >= least)
    key = F.left(F.lower(F.regexp_replace("block", r"\s+", " ")), F.lit(head))
    return first_of(blocks.withColumn("key", key), ["doc_id", "key"], ["block_no"])


def numbered_notes(docs: DataFrame, most: int = 40) -> DataFrame:
    """Lines "1 …" with at least twelve further characters, the first ``most`` of a document; designations and sizes are none."""
    lines = lines_of(docs).withColumn("line", F.trim("line"))
    number, tail = F.regexp_extract("line", r"^(\d{1,2})\s+(.{12,})$", 1), F.trim(F.regexp_extract("line", r"^(\d{1,2})\s+(.{12,})$", 2))
    noise = F.col("line").rlike(r"(?iu)(?<![\p{L}\p{N}_])(?:гост|ту\s*[\d-]|\d+[xх×]\d+)(?![\p{L}\p{N}_])") | tail.rlike(r"(?iu)^таблица\s")
    notes = lines.where((number != "") & ~noise).select("doc_id", "line_no", F.concat_ws(" ", number, tail).alias("note"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    return notes.withColumn("note_no", F.row_number().over(w)).where(F.col("note_no") <= most)


def sections(docs: DataFrame, anchors: dict[str, str]) -> DataFrame:
    """Blocks of lines from an anchor to the next one of another kind: doc_id, section_no, kind, start_line, lines.

    ``anchors``: pattern of each kind; of several on one line the first counts.
    """
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(list(anchors.items())):
        kind = F.when(F.col("line").rlike(pattern), name).otherwise(kind)
    marked = lines_of(docs).withColumn("kind", kind)
    anchored = marked.where("kind is not null")
    w = Window.partitionBy("doc_id").orderBy("line_no")
    starts = anchored.withColumn("before", F.lag("kind").over(w)).where("before is null or before <> kind")
    starts = starts.select("doc_id", "kind", F.col("line_no").alias("start_line"), F.row_number().over(w).alias("section_no"), F.lead("line_no").over(w).alias("end_line"))
    size = docs.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n"))
    return starts.join(size, "doc_id").select("doc_id", "section_no", "kind", "start_line", (F.coalesce("end_line", "n") - F.col("start_line")).alias("n_lines"))


def cells_of(docs: DataFrame) -> DataFrame:
    """Cells of the lines with at least two: doc_id, line_no, cell_no, cell."""
    rows = lines_of(docs).withColumn("cells", s.row_cells(F.col("line"))).where(F.size("cells") >= 2)
    return rows.select("doc_id", "line_no", F.posexplode("cells").alias("cell_no", "cell"))


def rows_once(rows: DataFrame) -> DataFrame:
    """Rows of one position once: the longest name in the place of the first. ``rows(doc_id, ord, pos, name)``."""
    key = F.coalesce(F.nullif(F.col("pos"), F.lit("")), F.concat(F.lit("~"), F.lower(F.col("name"))))
    return rows.groupBy("doc_id", key.alias("key")).agg(F.min("ord").alias("ord"), F.max_by("name", F.struct(F.length("name"), -F.col("ord"))).alias("name"))


def auto_numbers(rows: DataFrame) -> DataFrame:
    """Rows without a position get the running count of such rows."""
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    empty = F.coalesce(F.col("pos"), F.lit("")) == ""
    return rows.withColumn("pos", F.when(empty, F.sum(empty.cast("int")).over(w).cast("string")).otherwise(F.col("pos")))


def name_nearby(lines: DataFrame, test: Column, reach: int = 3) -> DataFrame:
    """For each line the first line that passes ``test`` among it and the next ``reach``; ``lines(doc_id, line_no, line)``."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    marked = lines.withColumn("ok", F.when(test, F.col("line")))
    return marked.withColumn("name", F.coalesce(*(F.lead("ok", i).over(w) if i else F.col("ok") for i in range(reach + 1)))).drop("ok")


def plan_rows(lines: DataFrame) -> DataFrame:
    """Lines "7 Name": plan number and name, each pair once in a document."""
    number, name = F.regexp_extract(F.trim("line"), r"^(\d{1,3}(?:\.\d+)?)[.\s]+(\p{L}.*)$", 1), F.trim(F.regexp_extract(F.trim("line"), r"^(\d{1,3}(?:\.\d+)?)[.\s]+(\p{L}.*)$", 2))
    found = lines.select("doc_id", "line_no", number.alias("plan_number"), name.alias("name")).where("plan_number <> ''")
    return first_of(found, ["doc_id", "plan_number", F.lower("name")], ["line_no"])
