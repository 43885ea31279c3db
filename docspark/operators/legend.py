"""Legends of sheets as notes, and titles of blocks found near them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import legend as lg
from docspark.functions import rows as r
from docspark.functions.grammar import let, once
from docspark.operators.extract import first_of
from docspark.plans.settle import sent, settled

#: Notes of a document at most, and lines around a block among which its title is sought.
MOST_NOTES, REACH = 60, 11


def _any(kind: str) -> str:
    # as in ``rows.opens``: places that begin with no first letter of a pattern are passed at once
    return "(?iU)" + f"(?=[{''.join(sorted({p[0] for p in r.ANCHORS[kind]}))}])(?:" + "|".join(f"(?:{p})" for p in r.ANCHORS[kind]) + ")"


def bodies(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line: the lines of a document's legend, without the heads above the first note; all lines where none is named.

    A legend goes from its name to a specification; where nothing is left of it, to an explication. A line that opens either ends it.
    """
    return _bodies(docs).select("doc_id", "line_no", "line")


def _bodies(docs: DataFrame) -> DataFrame:
    """``bodies`` with what their lines say by themselves: the ``note`` of each and its ``clean`` form."""
    def body(text: Column) -> Column:
        # from the first name of a legend on; without one no part of the text is its body
        return let(F.regexp_instr(text, F.lit(_any("legend"))), lambda at: F.when(at > 0, let(F.substr(text, at), lambda rest: F.coalesce(until(rest, "specification"), until(rest, "explication")))))

    def until(rest: Column, kind: str) -> Column:
        block = let(F.regexp_instr(F.substr(rest, F.lit(2)), F.lit(_any(kind))), lambda stop: F.trim(F.when(stop > 0, F.left(rest, stop)).otherwise(rest)))
        return F.nullif(F.trim(F.regexp_replace(block, "(?iU)^(?:" + _any("legend").removeprefix("(?iU)") + ")", "")), F.lit(""))

    texts = docs.select("doc_id", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n")).alias("text"))
    chosen = texts.select("doc_id", "text", once(body(F.col("text"))).alias("body")).select("doc_id", F.coalesce("body", "text").alias("text"), F.col("body").isNotNull().alias("named"))
    lines = chosen.select("doc_id", "named", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    lines = settled(lines)
    w = Window.partitionBy("doc_id").orderBy("line_no")
    lines = lines.join(_notes_told(lines), "line").withColumn("ends", F.col("named") & F.col("ends"))
    lines = lines.withColumns({"ended": F.max(F.col("ends").cast("int")).over(w), "begun": F.max(F.col("opens").cast("int")).over(w), "before": F.coalesce(F.max(F.col("opens").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    skipped = (F.col("begun") == 0) | ((F.col("before") == 0) & F.col("columns"))
    return lines.where(~F.col("named") | ((F.col("ended") == 0) & ~skipped)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line", "note", "clean")


def _notes_told(lines: DataFrame) -> DataFrame:
    """What a line of a legend says by itself, once for each different line: whether it ends or opens one or names its columns, the note
    it holds, and that note clean, null where it is none."""
    line = F.col("line")
    cols, label = r.matches(line, r"обозначение\s+примечан"), r.matches(line, r"^таблица\s*\d")
    opens = F.when(cols & ~label, F.lit(True)).otherwise(~(label | r.matches(line, *r.NO_DATA)))
    told = lines.select("line").distinct().select("line", r.opens(line, "specification", "explication").alias("ends"), cols.alias("columns"), opens.alias("opens"))
    told = settled(told.withColumn("note", lg.note_of(line)))
    good = F.when(F.col("note").isNotNull(), ~lg.garbage_note(F.col("note")))
    return sent(settled(told.withColumn("good", good).withColumn("clean", F.when(F.col("good"), lg.clean_note(F.col("note"))))), "line")


def read_once(rows: DataFrame, text: str, value: Column, name: str) -> DataFrame:
    """``rows`` with ``value``, which depends on nothing but the column ``text`` (never null), computed once for each different text."""
    return rows.join(sent(settled(rows.select(text).distinct().withColumn(name, value)), text), text)


def notes(docs: DataFrame, most: int = MOST_NOTES) -> DataFrame:
    """doc_id, place, note: the first ``most`` different notes of each document's legend, clean, without those that are none."""
    found = _bodies(docs).where("note is not null").select("doc_id", "line_no", "note", "clean")
    first = first_of(found.withColumn("key", F.lower("note")), ["doc_id", "key"], ["line_no"])
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    kept = first.withColumn("place", place).where(F.col("place") <= most)
    return kept.where("clean is not null").select("doc_id", "place", F.col("clean").alias("note"))


def separate_notes(found: DataFrame, most: int = MOST_NOTES) -> DataFrame:
    """doc_id, place, note: notes that ran together, apart, and each once."""
    # dealt by document once, for both windows
    parts = read_once(settled(found), "note", lg.notes_within(F.col("note")), "parts").repartition("doc_id").select("doc_id", "place", F.posexplode("parts").alias("part", "note"))
    first = first_of(parts.withColumn("key", F.lower("note")), ["doc_id", "key"], ["place", "part"])
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("place", "part"))
    return first.withColumn("new", place).where(F.col("new") <= most).select("doc_id", F.col("new").alias("place"), "note")


#: Kinds of sections whose name can be the title of a block.
KINDS = ("explication", "legend")


def _told(lines: DataFrame) -> DataFrame:
    """What a line says by itself, once for each different line: the head of columns, a line like a title, titles by its label and its
    anchors, and what it adds to a title between label and heads, as the first line of a block and as a later one. In steps, so that each
    rule stands in one plan once."""
    line, s = F.col("line"), F.col("s")
    behind = F.trim(F.regexp_extract(s, rf"(?iU){r.TABLE_LABEL}(.*)$", 1))
    rest = r.squeezed(F.regexp_replace(F.trim(line), rf"(?iU)^{r.TABLE_LABEL}\s*", ""))
    own = lines.select("line").distinct().withColumn("s", r.squeezed(line))
    own = own.select("line", "s", r.column_header(s).alias("head"), r.matches(line, r.TABLE_LABEL).alias("label"), *(r.opens(line, k).alias(f"opens_{k}") for k in KINDS), F.array(line, behind, rest).alias("texts"))
    own = settled(own.withColumn("likes", F.transform("texts", lg.title_line)))
    inline = F.when((F.length(F.col("texts")[1]) >= 5) & F.col("likes")[1], F.col("texts")[1]).otherwise("")
    firsts = F.filter(F.array(inline, F.when(F.col("label") & F.col("likes")[2], F.col("texts")[2]).otherwise("")), lambda t: t != "")
    own = own.withColumn("firsts", firsts)
    titles = F.array(s, inline, F.array_join("firsts", " "), *(F.when(F.col(f"opens_{k}"), lg.anchored_text(s, k)).otherwise("") for k in KINDS))
    own = settled(own.withColumn("titles", F.transform(titles, lg.clean_title)))
    like, by_kind = F.col("likes")[0], {k: F.col("titles")[3 + n] for n, k in enumerate(KINDS)}
    later = F.when(~F.col("head") & ~line.rlike(r"^\s*\d{1,2}\s+[А-ЯA-Z]"), F.when(like, s).when(by_kind["explication"] != "", by_kind["explication"]).otherwise(by_kind["legend"])).otherwise("")
    own = own.withColumn("later", later)
    parts = lambda texts, clean: F.struct(texts.alias("parts"), clean.alias("clean"))
    own = own.select(
        "line", "head", like.alias("like"), F.col("titles")[0].alias("clean"), F.col("titles")[1].alias("inline"), parts(F.col("firsts"), F.col("titles")[2]).alias("firsts"),
        parts(F.filter(F.array("later"), lambda t: t != ""), F.when(F.col("later") == "", "").otherwise(lg.clean_title(F.col("later")))).alias("next"),
        lg.told_line(s, F.col("head"), {k: F.col(f"opens_{k}") for k in KINDS}, by_kind).alias("of"),
    )
    return sent(settled(own), "line")


def block_titles(lines: DataFrame, blocks: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, block_no, tier, title over ``lines(doc_id, line_no, line)`` and ``blocks(doc_id, block_no, start_line, end_line, kind)``
    (end_line is the first line behind the block).

    1 between: the title on the label's line and the title-like lines down to the columns' heads; 2 label: the title on the label's line;
    3 above: the title-like line nearest to the heads (or the block's beginning), of equal ones the longest; 4 near: the title-like
    line nearest to the block's beginning, above before below, up to ``reach`` lines away; 5 anchor: the longest title over one to four
    lines that begins with an explication or a legend. Without any of them the title is empty.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no")
    line, told = F.col("line"), lines.select("doc_id", "line_no", "line").join(_told(lines), "line")
    ahead = told.select("*", F.array("of", *(F.lead("of", k).over(w) for k in range(1, 4))).alias("ahead"))
    over = F.transform(F.array(*(F.when(F.col(f"of.opens_{k}"), lg.joined_title(F.col("ahead"), k)) for k in KINDS)), lambda t: F.when(t.isNull(), "").otherwise(lg.clean_title(t)))
    told = ahead.withColumn("over", over).select(
        "doc_id", "line_no", F.col("of.s").alias("s"), "head", "like", "clean", "inline", "firsts", "next", *(F.col("over")[n].alias(k) for n, k in enumerate(KINDS)),
    )
    around = blocks.withColumn("line_no", F.explode(F.sequence(F.greatest(F.col("start_line") - reach, F.lit(0)), F.greatest(F.col("end_line") - 1, F.col("start_line"))))).where("line_no < end_line")
    near = around.withColumn("line_no", F.col("line_no").cast(lines.schema["line_no"].dataType)).join(told, ["doc_id", "line_no"])
    inside = F.col("line_no") >= F.col("start_line")
    head_at = F.min(F.when(inside & F.col("head"), F.col("line_no"))).over(Window.partitionBy("doc_id", "block_no"))
    near = near.withColumn("head_at", head_at).withColumn("until", F.coalesce("head_at", F.col("end_line")))
    first, above = F.col("line_no") == F.col("start_line"), F.col("line_no") < F.col("until")
    # parts of a title between label and heads, in the order of lines
    own = F.when(first, F.col("firsts")).when(inside & above, F.col("next"))
    near = near.withColumn("own", F.when(F.size(own["parts"]) > 0, own))
    parts = F.array_sort(F.collect_list(F.when(F.col("own").isNotNull(), F.struct("line_no", "own"))))
    distance = F.when(F.col("head_at").isNotNull(), F.col("head_at") - F.col("line_no")).otherwise(F.col("line_no") - F.col("start_line") + 1)
    offset = F.abs(F.col("line_no") - F.col("start_line"))
    close = F.col("like") & (F.col("clean") != "") & offset.between(1, reach) & (F.col("head_at").isNull() | above)
    longest = lambda k: F.max_by(k, F.when(inside & (F.col(k) != "") & F.col("kind").isin(k, "", "table"), F.struct(F.length(k), -F.col("line_no"))))
    tiers = near.groupBy("doc_id", "block_no").agg(
        parts.alias("parts"), F.max(F.when(first, F.col("inline"))).alias("inline"), F.min_by("clean", F.when(inside & above & F.col("like"), F.struct(distance, -F.length("s"), "line_no"))).alias("above"),
        F.min_by("clean", F.when(close, F.struct(offset, "line_no"))).alias("near"), longest("explication").alias("explication"), longest("legend").alias("legend"),
    )
    of_anchor = F.when(F.length(F.coalesce("legend", F.lit(""))) > F.length(F.coalesce("explication", F.lit(""))), F.col("legend")).otherwise(F.coalesce("explication", "legend"))
    # the parts of one line were made a title with it
    between = F.when(F.size("parts") <= 1, F.try_element_at("parts", F.lit(1))["own"]["clean"]).otherwise(lg.clean_title(F.array_join(F.flatten(F.transform("parts", lambda x: x["own"]["parts"])), " ")))
    values = {"between": between, "label": F.col("inline"), "above": F.col("above"), "near": F.col("near"), "anchor": of_anchor}
    found = F.filter(F.array(*(F.struct(F.lit(k).alias("tier"), v.alias("title")) for k, v in values.items())), lambda x: F.coalesce(x["title"], F.lit("")) != "")
    out = tiers.select("doc_id", "block_no", F.try_element_at(found, F.lit(1)).alias("t"))
    return blocks.select("doc_id", "block_no").join(out, ["doc_id", "block_no"], "left").select("doc_id", "block_no", F.col("t.tier").alias("tier"), F.coalesce("t.title", F.lit("")).alias("title"))
