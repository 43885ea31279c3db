"""Title blocks of sheets: fields, and titles of sections from lines, cells and phrases, told once and apart from the fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import scalar as sc
from docspark.functions import stamp
from docspark.functions.grammar import let, once
from docspark.functions.rows import matches, squeezed
from docspark.operators import tables
from docspark.plans.settle import sent, settled

#: What a title says by itself, with it.
TOLD = ("title", "asked", "polished", "key", "score", "ok")
#: Titles of a block at most.
MOST_TITLES = 20


def fields(docs: DataFrame) -> DataFrame:
    """doc_id, place, field, value of ``docs(doc_id, text)``: each field once, in the order in which it is shown.

    Of the values found for a field the last of the rules counts, if it can be one; a letter in place of the stage moves to the
    stage's sign. Null and empty texts have none.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    copied = F.try_element_at(F.filter(lines, lambda x: matches(x, "копиров")), F.lit(1))
    # first the values, then their rows: rows without any would be told by reading the text once more
    each = docs.select("doc_id", once(stamp.candidates(F.col("text"), copied)).alias("values"))
    each = each.select("doc_id", F.posexplode("values").alias("rule", "c")).select("doc_id", "rule", "c.*")
    won = each.groupBy("doc_id", "field").agg(F.max_by("value", "rule").alias("value"))
    letter = (F.col("field") == "Стадия") & matches(F.col("value"), "[СРПТ]", whole=True)
    # both rows from one pass over the values: two filters of ``won`` would have every text read twice
    kept = lambda ok, field, value, later: F.when(ok, F.struct(field.alias("field"), value.alias("value"), F.lit(later).alias("later")))
    both = F.array(kept(~stamp.garbage_value(F.col("field"), F.col("value")), F.col("field"), F.col("value"), 0), kept(letter, F.lit("Стадия (обозначение)"), F.upper("value"), 1))
    good = won.select("doc_id", F.explode(F.array_compact(both)).alias("x")).select("doc_id", "x.*")
    single = good.groupBy("doc_id", "field").agg(F.min_by("value", "later").alias("value"))
    place = F.array_position(F.array(*map(F.lit, stamp.FIELDS)), F.col("field"))
    return single.select("doc_id", place.cast("int").alias("place"), "field", "value").where("place > 0")


def field_maps(found: DataFrame) -> DataFrame:
    """doc_id, fields: the fields of a block as a map."""
    return found.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields"))


def _titles_told(texts: DataFrame, given: bool = False) -> DataFrame:
    """What a title says by itself, once for each different ``title``, for those that are titles: polished, with its ``key``, and whether it
    reads (``ok``); dated lines do not. ``given``: they are titles already."""
    title, kept = F.col("title"), F.col("polished")
    told = texts.select("title").distinct()
    told = told if given else settled(told.where(stamp.section_title(title)))
    dated = title.rlike(r"^\d{1,3}\.\d{2}\.?\s+")
    told = told.select("title", dated.alias("dated"), stamp.title_key(title).alias("asked"), once(stamp.polished(title)).alias("polished"))
    told = told.select("*", stamp.title_key(kept).alias("key"), once(sc.readability(kept).cast("double")).alias("score"))
    return settled(told.withColumn("ok", ~F.col("dated") & (F.col("score") >= 8.0) & ~matches(kept, r"^подготов\w+\s+период", r"^рабоч\w+\s+документ\w+")))


def title_candidates(docs: DataFrame) -> DataFrame:
    """doc_id, source, ord, title: lines that can be titles, then cells of parted lines, then phrases of plans and lists."""
    return _candidates(docs).select("doc_id", "source", "ord", "title")


def _candidates(docs: DataFrame) -> DataFrame:
    """``title_candidates`` with what each title says by itself; lines are told once for each different line."""
    lines = tables.lines_of(docs).withColumn("line", F.trim("line")).where("line <> ''")
    line = F.col("line")
    signed = matches(line, "разро[бь]", r"пров\.", "гип", r"контр\.", "копиров", r"формат\s*a\d")
    row = lambda source, k, text: F.struct(F.lit(source).alias("source"), k.cast("long").alias("k"), squeezed(text).alias("title"))
    none = F.array().cast("array<struct<source: int, k: bigint, title: string>>")
    whole = F.when(~signed & ~stamp.noise_line(line), F.array(row(0, F.lit(0), line))).otherwise(none)
    cells = F.when(line.contains("|"), F.transform(F.split(line, r"\|"), lambda c, k: row(1, k, c))).otherwise(none)
    own = settled(lines.select("line").distinct().select("line", F.explode(F.concat(whole, cells)).alias("x")).select("line", "x.*"))
    own = own.join(_titles_told(own), "title")
    of = F.struct("source", "k", *TOLD)
    own = settled(own.groupBy("line").agg(F.collect_list(of).alias("of")))
    of_lines = lines.join(sent(own, "line"), "line").select("doc_id", "line_no", F.explode("of").alias("of")).select("doc_id", "line_no", "of.*")
    of_lines = of_lines.select("doc_id", "source", F.when(F.col("source") == 0, F.col("line_no")).otherwise(F.col("line_no").cast("long") * 1000 + F.col("k")).cast("long").alias("ord"), *TOLD)
    compact = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " ")
    # as the patterns begin with letters, other places of a text are passed at once
    phrases = let(compact, lambda c: F.concat(*(F.regexp_extract_all(c, F.lit(f"(?iU)(?={p[0]})({p})"), F.lit(1)) for p in stamp.PHRASES)))
    said = settled(docs.select("doc_id", once(phrases).alias("phrases")).select("doc_id", F.posexplode("phrases").alias("k", "phrase")))
    title = stamp.polished(F.regexp_replace("phrase", r"^[ .,;|]+|[ .,;|]+$", ""))
    made = settled(said.select("phrase").distinct().select("phrase", title.alias("title")))
    made = settled(made.join(_titles_told(made), "title").select("phrase", *TOLD))
    of_texts = said.join(sent(made, "phrase"), "phrase").select("doc_id", F.lit(2).alias("source"), F.col("k").cast("long").alias("ord"), *TOLD)
    return of_lines.unionByName(of_texts)


def _folded(titles: DataFrame, replaces: bool = False) -> DataFrame:
    """Titles ``titles(doc_id, source, ord, title, key, score)`` of a document in order, like ones once: the first, or with ``replaces`` in
    its place the most readable one."""
    kind = "array<struct<key: string, title: string, score: double>>"
    rows = titles.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("source", "ord", F.struct("key", "title", "score").alias("row")))).alias("rows"))

    def step(kept: Column, x: Column) -> Column:
        at = F.array_position(F.transform(kept, lambda k: stamp.keys_alike(k["key"], x["row"]["key"])), True)
        better = F.transform(kept, lambda k, i: F.when((i + 1 == at) & (x["row"]["score"] > k["score"]), x["row"]).otherwise(k)).cast(kind)
        return let(at, lambda at: F.when(at > 0, better if replaces else kept).when((x["row"]["key"] == "") | (F.size(kept) >= MOST_TITLES), kept).otherwise(F.concat(kept, F.array(x["row"])).cast(kind)))

    kept = F.aggregate("rows", F.array().cast(kind), step)
    return rows.select("doc_id", F.posexplode(kept).alias("place", "x")).select("doc_id", "place", "x.title")


def _once(candidates: DataFrame, maps: DataFrame) -> DataFrame:
    """Those of ``candidates``, which are titles by themselves and told so, that no field of their block tells, polished and readable; dated
    lines go."""
    said = stamp.fields_told(F.coalesce("fields", F.create_map().cast("map<string, string>")))
    held = candidates.where("ok").join(maps.select("doc_id", said.alias("said")), "doc_id", "left")
    told = F.coalesce(stamp.told_elsewhere(F.col("title"), F.col("asked"), F.col("said")), F.lit(False))
    return held.where(~told).select("doc_id", "source", "ord", F.col("polished").alias("title"), "key", "score")


def titles(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """doc_id, place, title: up to 20 titles of a block, like ones once, none that a field tells. ``found``: the fields, if they are known."""
    return _folded(_once(_candidates(docs), field_maps(fields(docs) if found is None else found)))


def merged_titles(candidates: DataFrame, maps: DataFrame) -> DataFrame:
    """doc_id, place, title over ``candidates(doc_id, source, ord, title)`` of two sources, 0 and 1.

    Titles of the first source come first, then those of the second that are like none before. Where the first has none, like titles of
    the second are one, the most readable. What a field in ``maps(doc_id, fields)`` tells goes.
    """
    clean = candidates.withColumn("title", stamp.polished(F.col("title"))).where((F.col("title") != "") & stamp.section_title(F.col("title")))
    first = clean.where("source = 0").select("doc_id").distinct()
    told = lambda rows: rows.join(_titles_told(rows, given=True), "title")
    scored = lambda rows: rows.select("*", stamp.title_key(F.col("title")).alias("key"), sc.readability(F.col("title")).cast("double").alias("score"))
    both = _once(told(clean.join(first, "doc_id", "left_semi")), maps)
    alone = _folded(scored(clean.join(first, "doc_id", "left_anti")), replaces=True).select("doc_id", F.lit(1).alias("source"), F.col("place").cast("long").alias("ord"), "title")
    return _folded(both.unionByName(_once(told(alone), maps)))
