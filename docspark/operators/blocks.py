"""Blocks and rows of tables in page text, and what several readings of them come to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import grammar as g
from docspark.functions import lines as ln
from docspark.functions import scalar as s
from docspark.operators import extract
from docspark.operators.extract import first_of


def _by_line() -> Window:
    return Window.partitionBy("doc_id").orderBy("line_no")


def table_blocks(lines: DataFrame, label: str = r"(?iu)таблица\s*\d") -> DataFrame:
    """doc_id, block_no, start_line, end_line, number: from each line with a table label to the line before the next one."""
    size = Window.partitionBy("doc_id")
    marked = lines.withColumn("last_line", F.max("line_no").over(size)).where(F.col("line").rlike(label))
    number = F.regexp_extract("line", r"(?iu)таблица\s*(\d+(?:\.\d+)*)", 1)
    return marked.select("doc_id", F.row_number().over(_by_line()).alias("block_no"), F.col("line_no").alias("start_line"), (F.coalesce(F.lead("line_no").over(_by_line()), F.col("last_line") + 1) - 1).alias("end_line"), number.alias("number"))


def chunks_from_hits(lines: DataFrame, hit: Column) -> DataFrame:
    """doc_id, chunk_no, start_line, text: each line that ``hit`` accepts with the lines up to the next such line."""
    numbered = lines.withColumn("chunk_no", F.count_if(hit).over(_by_line().rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("chunk_no > 0")
    rows = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return numbered.groupBy("doc_id", "chunk_no").agg(F.min("line_no").alias("start_line"), F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("text"))


def merged_headers(lines: DataFrame, marks: tuple[str, ...] = ("поз", "обознач", "наименован", "кол", "примеч")) -> DataFrame:
    """doc_id, line_no, header, n_lines: heads that stand on one line or on up to three, of which each has a mark; a head is
    whole with three marks, and begins where the line before is not part of one."""
    own = F.array_compact(F.array(*(F.when(F.contains(F.lower("line"), F.lit(m)), F.lit(m)) for m in marks)))
    marked = lines.withColumn("own", own)
    w = _by_line()
    ahead = [F.col("own"), *(F.coalesce(F.lead("own", k).over(w), F.array().cast("array<string>")) for k in (1, 2))]
    texts = [F.col("line"), *(F.lead("line", k).over(w) for k in (1, 2))]
    marked = marked.withColumns({f"m{k}": a for k, a in enumerate(ahead)} | {f"t{k}": t for k, t in enumerate(texts)} | {"before": F.coalesce(F.size(F.lag("own").over(w)), F.lit(0))})
    one, two, three = F.size("m0"), F.size(F.array_union("m0", "m1")), F.size(F.array_union(F.array_union("m0", "m1"), "m2"))
    n = F.when(one >= 3, 1).when((F.size("m1") > 0) & (two >= 3), 2).when((F.size("m1") > 0) & (F.size("m2") > 0) & (three >= 3), 3)
    found = marked.where((F.size("own") > 0) & (F.col("before") == 0)).withColumn("n_lines", n).where("n_lines is not null")
    header = F.array_join(F.slice(F.array("t0", "t1", "t2"), F.lit(1), F.col("n_lines")), " ")
    return found.select("doc_id", "line_no", header.alias("header"), "n_lines")


def revision_rows(lines: DataFrame, head: str = r"(?iu)изм\.?|кол\.?\s*уч|№\s*док", stop: str = r"(?iu)заказчик|разро[бь]|пров\.|гип(?!\p{L})", most: int = 12) -> DataFrame:
    """doc_id, line_no, cells: the rows under the first head of four cells, up to a line that ``stop`` matches, ``most`` of them."""
    w = _by_line()
    cut = lines.withColumn("cells", s.row_cells(F.col("line")))
    cut = cut.withColumn("head", F.min(F.when(F.col("line").rlike(head) & (F.size("cells") >= 4), F.col("line_no"))).over(Window.partitionBy("doc_id"))).where("line_no > head")
    cut = cut.withColumn("ended", F.max(F.col("line").rlike(stop).cast("int")).over(w)).where((F.col("ended") == 0) & (F.size("cells") >= 2))
    return cut.withColumn("row_no", F.row_number().over(w)).where(F.col("row_no") <= most).select("doc_id", "line_no", "row_no", "cells")


def requirements(lines: DataFrame, most: int = 30) -> DataFrame:
    """doc_id, line_no: numbered requirements, the first of equal ones (120 folded characters), ``most`` of a document."""
    key = F.left(F.lower(F.regexp_replace(F.trim("line"), r"\s+", " ")), F.lit(120))
    once = first_of(lines.where(ln.requirement(F.col("line"))).withColumn("key", key), ["doc_id", "key"], ["line_no"])
    return once.withColumn("row_no", F.row_number().over(_by_line())).where(F.col("row_no") <= most).select("doc_id", "line_no", "row_no")


def _alike(a: Column, b: Column, numbers_a: Column, numbers_b: Column, least: int = 10) -> Column:
    """Keys of notes are equal, or one of ``least`` characters stands in another such, or they share three words (all, if fewer), or
    the notes share a dotted number; an empty key is like none."""
    wa, wb = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    inside = (F.length(a) >= least) & (F.length(b) >= least) & (F.contains(a, b) | F.contains(b, a))
    shared = F.size(F.array_intersect(wa, wb)) >= F.least(F.lit(3), F.size(wa), F.size(wb))
    return (a != "") & (b != "") & ((a == b) | inside | shared | (F.size(F.array_intersect(numbers_a, numbers_b)) > 0))


def note_key(note: Column) -> Column:
    """The first eight words of three letters and more, folded."""
    words = F.split(F.regexp_replace(F.lower(note), r"(?U)[^\w\s]+", " "), r"(?U)\s+")
    return F.array_join(F.slice(F.filter(words, lambda w: F.length(w) > 2), 1, 8), " ")


def merged_notes(notes: DataFrame) -> DataFrame:
    """doc_id, place, note over ``notes(doc_id, ord, note, quality)``: in order, a note like one that is kept replaces it in its
    place where its quality is higher, and is dropped otherwise; the notes of a document are its legend and few."""
    numbers = F.regexp_extract_all("note", F.lit(r"(\d+(?:\.\d+)+)"), F.lit(1))
    rows = F.array_sort(F.collect_list(F.struct("ord", "note", note_key(F.col("note")).alias("key"), numbers.alias("numbers"), "quality")))
    kind = "array<struct<ord: bigint, note: string, key: string, numbers: array<string>, quality: double>>"

    def step(kept: Column, x: Column) -> Column:
        at = F.array_position(F.transform(kept, lambda k: _alike(k["key"], x["key"], k["numbers"], x["numbers"])), True)
        better = F.transform(kept, lambda k, i: F.when((i + 1 == at) & (x["quality"] > k["quality"]), x).otherwise(k))
        return F.when(at > 0, better).otherwise(F.concat(kept, F.array(x)))

    typed = notes.select("doc_id", F.col("ord").cast("bigint").alias("ord"), "note", F.col("quality").cast("double").alias("quality"))
    grouped = typed.groupBy("doc_id").agg(rows.cast(kind).alias("rows"))
    kept = F.aggregate("rows", F.array().cast(kind), step)
    return grouped.select("doc_id", F.posexplode(kept).alias("place", "x")).select("doc_id", "place", "x.note")


def merged_sections(sections: DataFrame, share: float = 0.5) -> DataFrame:
    """doc_id, first, members, keys, title over ``sections(doc_id, ord, kind, table_number, title, keys)``: in order, the first
    earlier section of the same table number, or of the same kind with ``share`` of the larger key set in common, absorbs a
    section: its keys are added, and its number and title fill empty ones."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("ord").cast("bigint").alias("ord"), "kind", "table_number", "title", "keys")))
    kind = "array<struct<ord: bigint, kind: string, table_number: string, title: string, keys: array<string>, members: array<bigint>>>"
    own = lambda x: F.struct(x["ord"], x["kind"], x["table_number"], x["title"], x["keys"], F.array(x["ord"]).alias("members"))

    def meets(k: Column, x: Column) -> Column:
        shared = F.size(F.array_intersect(k["keys"], x["keys"]))
        number = (x["table_number"] != "") & (k["table_number"] == x["table_number"])
        return number | ((k["kind"] == x["kind"]) & (shared > 0) & (shared >= share * F.greatest(F.size(k["keys"]), F.size(x["keys"]))))

    def step(kept: Column, x: Column) -> Column:
        at = F.array_position(F.transform(kept, lambda k: meets(k, x)), True)
        filled = lambda a, b: F.when(a == "", b).otherwise(a)
        both = lambda k: F.struct(k["ord"].alias("ord"), k["kind"].alias("kind"), filled(k["table_number"], x["table_number"]).alias("table_number"), filled(k["title"], x["title"]).alias("title"), F.array_union(k["keys"], x["keys"]).alias("keys"), F.concat(k["members"], F.array(x["ord"])).alias("members"))
        return F.when(at > 0, F.transform(kept, lambda k, i: F.when(i + 1 == at, both(k)).otherwise(k)).cast(kind)).otherwise(F.concat(kept, F.array(own(x)).cast(kind)))

    kept = F.aggregate("rows", F.array().cast(kind), step)
    out = sections.groupBy("doc_id").agg(rows.alias("rows")).select("doc_id", F.explode(kept).alias("x"))
    return out.select("doc_id", F.col("x.ord").alias("first"), "x.members", F.array_sort("x.keys").alias("keys"), "x.title", "x.table_number")


def named_in_text(wanted: DataFrame, sources: DataFrame) -> DataFrame:
    """``wanted(doc_id, kind, ref)`` whose canonical key is extracted again from a text of the document."""
    key = g.canonical_key(F.col("kind"), F.col("ref"))
    found = extract.spans(sources).select("doc_id", "kind", key.alias("canon_key")).distinct()
    return wanted.withColumn("canon_key", key).join(found, ["doc_id", "kind", "canon_key"], "left_semi").drop("canon_key")


def flattened(docs: DataFrame, single: str, listed: str, mapped: str) -> DataFrame:
    """doc_id, place, text: the text blobs of a nested document - a text, a list of texts, the values of a map - without blanks."""
    every = F.concat(F.array(F.col(single)), F.coalesce(F.col(listed), F.array().cast("array<string>")), F.coalesce(F.map_values(F.col(mapped)), F.array().cast("array<string>")))
    return docs.select("doc_id", F.posexplode(F.filter(every, lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")).alias("place", "text"))


def escalated(asked: DataFrame, hits: DataFrame, least: int = 35) -> DataFrame:
    """kind, ref, step, full, row_ord, score: of ``asked(kind, ref, step, query)`` in order, each query first quick and then full,
    the best row of the first search with a row of at least ``least``; ``hits(query, full, row_ord, score)``.

    A row under the limit never wins later, so the first search that has one above it decides. The best row of a query is the same for
    all that ask it, so a query brings one row to the join.
    """
    first = hits.where(F.col("score") >= least).groupBy("query").agg(F.min(F.struct("full", (-F.col("score")).alias("less"), "row_ord", "score")).alias("h"))
    met = asked.join(first.select("query", "h.full", "h.row_ord", "h.score"), "query")
    best = F.min_by(F.struct("row_ord", "score"), F.struct("step", "full", -F.col("score"), "row_ord"))
    return met.groupBy("kind", "ref").agg(F.min(F.struct("step", "full")).alias("at"), best.alias("best")).select("kind", "ref", "at.step", "at.full", "best.row_ord", "best.score")


def second_pass(refs: DataFrame, first: DataFrame, again: DataFrame) -> DataFrame:
    """Results of a batch lookup: those of the first pass, and of the second where the first failed or skipped; in order."""
    one = first.select("ord", F.col("status").alias("s1"))
    two = again.select("ord", F.col("status").alias("s2"))
    ok = ~F.coalesce("s1", F.lit("skipped")).isin("skipped", "failed")
    out = refs.join(one, "ord", "left").join(two, "ord", "left")
    return out.withColumn("status", F.when(ok, F.col("s1")).otherwise(F.coalesce("s2", "s1", F.lit("skipped")))).withColumn("pass", F.when(ok, 1).otherwise(2)).drop("s1", "s2")


def spans_of_words(words: DataFrame, refs: DataFrame, reach: int = 6, extra: int = 22) -> DataFrame:
    """doc_id, page_no, kind, ref, first, last: the shortest runs of at most ``reach`` words from a token of the kind that read as the
    reference (``lines.phrase_names``). ``words(doc_id, page_no, ord, text)``; a run is read once and meets references on the kind and on
    all digits by which it names them, so numbers that begin alike are not paired."""
    w = Window.partitionBy("doc_id", "page_no").orderBy("ord").rowsBetween(0, reach - 1)
    runs = words.withColumn("run", F.collect_list(F.struct("ord", "text")).over(w))
    kinds = F.array_compact(F.array(*(F.when(ln.kind_token(F.col("text"), F.lit(k)), F.lit(k)) for k in ln.KIND_TOKENS)))
    # a page is one task of the window, but its runs are read by all tasks
    starts = runs.withColumn("kind", F.explode(kinds)).repartition("doc_id", "page_no", "ord")
    each = starts.select("doc_id", "page_no", "kind", F.col("ord").alias("first"), F.posexplode(F.expr("transform(sequence(1, size(run)), n -> struct(run[n - 1].ord as last, array_join(transform(slice(run, 1, n), x -> x.text), ' ') as phrase))")).alias("n", "x"))
    each = each.select("doc_id", "page_no", "kind", "first", "x.last", "x.phrase").withColumn("head", F.left(g.digits(F.regexp_replace("phrase", r"^\S+", "")), F.lit(3))).where(F.length("head") == 3)
    read = each.select("doc_id", "page_no", "kind", "first", "last", "head", g.once(ln.phrase_parts(F.col("phrase"), F.col("kind"))).alias("p")).where("p.named").select("doc_id", "page_no", "kind", "first", "last", "head", "p.run", "p.length")
    asked = refs.select("doc_id", "kind", "ref").distinct().select("*", F.left(g.digits(g.number_of(F.col("ref"))), F.lit(3)).alias("head"), F.explode(ln.phrase_runs(F.col("ref"))).alias("run"))
    met = read.join(asked, ["doc_id", "kind", "head", "run"]).where(F.col("length") <= F.length("ref") + extra)
    return met.groupBy("doc_id", "page_no", "kind", "ref", "first").agg(F.min("last").alias("last"))


def best_words(words: DataFrame, enough: int = 40) -> DataFrame:
    """doc_id, source_ord: the first source of words, in order, with ``enough`` of them, else the one with most."""
    n = words.groupBy("doc_id", "source_ord").agg(F.count("*").alias("n"))
    order = F.struct((F.col("n") < enough).alias("few"), F.when(F.col("n") >= enough, 0).otherwise(-F.col("n")).alias("less"), "source_ord")
    return n.groupBy("doc_id").agg(F.min_by(F.struct("source_ord", "n"), order).alias("best")).select("doc_id", "best.*")


def pinpointed(rects: DataFrame) -> DataFrame:
    """Rectangles that can be a word of a page, by shares of its size and fixed bounds, padded by five points.
    ``rects(doc_id, ord, x0, y0, x1, y1, width, height)``."""
    wide, high = F.least(F.lit(210.0), F.col("width") * 0.32), F.least(F.lit(42.0), F.col("height") * 0.07)
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    own = rects.where((w > 0) & (h > 0) & (w <= wide) & (h <= high) & (w * h <= wide * high * 1.8))
    return own.select("doc_id", "ord", *((F.col(c) - 5).alias(c) for c in ("x0", "y0")), *((F.col(c) + 5).alias(c) for c in ("x1", "y1")))


def subdivided(rects: DataFrame, cols: int = 2, rows: int = 2, overlap: float = 0.08) -> DataFrame:
    """``rects(zone, x0, y0, x1, y1, ...)`` in a grid of parts named zone_row_col that reach ``overlap`` of a part into their
    neighbours; parts of 40 points or less go, and zones under 120 points or without parts stay whole."""
    w, h = (F.col("x1") - F.col("x0")) / cols, (F.col("y1") - F.col("y0")) / rows
    small = (F.col("x1") - F.col("x0") < 120) | (F.col("y1") - F.col("y0") < 120)

    def part(row: int, col: int) -> Column:
        left, right = F.col("x0") + w * col, F.col("x0") + w * (col + 1)
        top, bottom = F.col("y0") + h * row, F.col("y0") + h * (row + 1)
        box = {
            "x0": left - w * overlap if col else F.col("x0"), "y0": top - h * overlap if row else F.col("y0"),
            "x1": right + w * overlap if col < cols - 1 else F.col("x1"), "y1": bottom + h * overlap if row < rows - 1 else F.col("y1"),
        }
        return F.struct(F.concat("zone", F.lit(f"_{row}_{col}")).alias("zone"), *(v.alias(k) for k, v in box.items()))

    whole = F.array(F.struct("zone", "x0", "y0", "x1", "y1"))
    parts = F.filter(F.array(*(part(r, c) for r in range(rows) for c in range(cols))), lambda b: (b["x1"] - b["x0"] > 40) & (b["y1"] - b["y0"] > 40))
    kept = F.when(small | (F.size(parts) == 0), whole).otherwise(parts)
    others = [c for c in rects.columns if c not in ("zone", "x0", "y0", "x1", "y1")]
    return rects.select(*others, F.explode(kept).alias("z")).select(*others, "z.*")


def supplement_zones(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, zone, x0, y0, x1, y1 of ``pages(doc_id, page_no, width, height, n_pages)``: the specification at the right of
    wide sheets of up to 12 pages, and on up to four the notes below, in four parts that overlap; zones under 80 points are none."""
    zone = lambda name, ok, a, b, c, d: F.when(ok, F.struct(F.lit(name).alias("zone"), (F.col("width") * a).alias("x0"), (F.col("height") * b).alias("y0"), (F.col("width") * c).alias("x1"), (F.col("height") * d).alias("y1")))
    n = F.greatest(F.col("n_pages"), F.lit(1))
    spec = zone("spec_right", (n <= 12) & s.is_wide(F.col("width"), F.greatest(F.col("height"), F.lit(1.0))), 0.46, 0.22, 1.0, 0.96)
    notes = zone("supp_notes", n <= 4, 0.02, 0.28, 0.98, 0.97)
    out = pages.select("doc_id", "page_no", F.explode(F.array_compact(F.array(spec, notes))).alias("z")).select("doc_id", "page_no", "z.*")
    out = out.where((F.col("x1") - F.col("x0") >= 80) & (F.col("y1") - F.col("y0") >= 80))
    return out.where("zone = 'spec_right'").unionByName(subdivided(out.where("zone = 'supp_notes'"), overlap=0.14).select(out.columns))


def rendered_summary(rows: DataFrame) -> DataFrame:
    """doc_id, total, found_a, found_b, active of rendered report rows ``(doc_id, cells array<struct<text, href>>)``: links in the
    third and fourth cell, and a ninth that says that the document is in force."""
    cell = lambda i, name: F.trim(F.coalesce(F.try_element_at("cells", F.lit(i))[name], F.lit("")))
    return rows.groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if(cell(3, "href") != "").alias("found_a"), F.count_if(cell(4, "href") != "").alias("found_b"), F.count_if(F.contains(F.lower(cell(9, "text")), F.lit("актуален"))).alias("active"))


def highlights(spans: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, page_no, ref, hits, boxes: spans of words as boxes, equal ones once, counted by page and reference.
    ``words(doc_id, page_no, ord, x0, y0, x1, y1)``."""
    inside = spans.withColumn("ord", F.explode(F.sequence("first", "last"))).join(words.select("doc_id", "page_no", "ord", "x0", "y0", "x1", "y1"), ["doc_id", "page_no", "ord"])
    box = inside.groupBy("doc_id", "page_no", "ref", "first", "last").agg(*(F.round(f(c)).cast("long").alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))))
    return box.groupBy("doc_id", "page_no", "ref").agg(F.count("*").alias("hits"), F.count_distinct("x0", "y0", "x1", "y1").alias("boxes"))
