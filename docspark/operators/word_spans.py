"""Where references stand among the words of a page: runs of words on one line, in four passes.

Words meet references on document, kind and the first digits of the number, never all with all; what stands before and behind a word is
told by windows over the words of its page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import grammar as g
from docspark.functions import lines as ln

#: Words that a run may have, and words before a number among which its kind is sought: for a whole number, and for one of another year.
RUN, BACK, BACK_BODY = 14, 5, 3
# Numbers that may stand without their kind.
BARE = {
    "СНиП": r"^\d{1,2}\.\d{2}\.\d{2}-\d{2,4}$", "СТП": r"^\d+(?:\.\d+){2,}-\d{2,4}$", "РД": r"^\d+(?:\.\d+){2,}-\d{2,4}$", "ТКП": r"^\d{2}(?:[.\-]\d+)+-\d{2,4}$", "СП": r"^\d{2}\.\d{2,3}\.?\d{0,5}-\d{4}$",
    "ТУ": r"^\d{1,3}(?:-\d+){2,}-\d{2,4}$",
}


def bare_word(text: Column) -> Column:
    """A word without brackets and stops around it, a comma before a digit as a point."""
    t = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"""^[(\["']+|[)\]}"'.,;:!?]+$""", "")
    return F.regexp_replace(t, r",(?=\d)", ".")


def number_word(text: Column) -> Column:
    """A word with a digit that can be a part of a number: no size, no letter with a hyphen before it, under three letters."""
    return text.rlike(r"\d") & ~text.rlike(r"^[A-Za-zА-Яа-яЁё]-\d") & ~text.rlike(r"^\d{1,2}$") & (F.regexp_count(text, F.lit("[A-Za-zА-Яа-яЁё]")) < 3)


def on_line(a: Column, b: Column) -> Column:
    """The middles of two boxes are as near as words of one line are."""
    height = F.least(a["y1"] - a["y0"], b["y1"] - b["y0"])
    return F.abs((a["y0"] + a["y1"]) / 2 - (b["y0"] + b["y1"]) / 2) <= F.greatest(F.lit(3.5), height * 0.55)


def _while(items: Column, kind: str, test) -> Column:
    """The first items of an array, as long as they pass."""
    start = F.struct(F.array().cast(f"array<{kind}>").alias("kept"), F.lit(False).alias("done"))
    step = lambda s, x: F.when(s["done"] | ~test(x), F.struct(s["kept"].alias("kept"), F.lit(True).alias("done"))).otherwise(F.struct(F.concat(s["kept"], F.array(x)).alias("kept"), F.lit(False).alias("done")))
    return F.aggregate(items, start, step, lambda s: s["kept"])


def _head(digits: Column) -> Column:
    return F.left(digits, F.lit(3))


def _with_kind(text: Column) -> Column:
    """The kinds that a word is, or holds, a spelling of."""
    within = lambda k: ln.kind_token(text, F.lit(k)) | text.rlike(rf"(?iu)(?<![a-zа-яё])(?:{'|'.join(g.KIND_ALIASES.get(k, (k.lower(),)))})(?![a-zа-яё])")
    return F.array_compact(F.array(*(F.when(within(k), F.lit(k)) for k in ln.KIND_TOKENS)))


def line_spans(words: DataFrame, refs: DataFrame) -> DataFrame:
    """doc_id, page_no, kind, ref, first, last, found_by over ``words(doc_id, page_no, ord, x0, y0, x1, y1, text)`` and ``refs(doc_id, kind,
    ref)``: each span once, with the first pass that finds it.

    1 a word that is the reference; 2 a word of the kind and the numbers that follow it on its line; 3 a number that is the reference's,
    its kind up to five words before it on the line; 4 a number with the reference's body and another year, its kind up to three
    words before it, or none for numbers that stand alone.
    """
    box = F.struct("ord", "text", "y0", "y1").alias("w")
    kind = "struct<ord: bigint, text: string, y0: double, y1: double>"
    typed = words.select("doc_id", "page_no", F.col("ord").cast("bigint").alias("ord"), bare_word(F.col("text")).alias("text"), F.col("y0").cast("double").alias("y0"), F.col("y1").cast("double").alias("y1"))
    page = Window.partitionBy("doc_id", "page_no").orderBy("w.ord")
    placed = typed.select("doc_id", "page_no", box).select(
        "doc_id", "page_no", "w", F.collect_list("w").over(page.rowsBetween(1, RUN - 1)).alias("next"), F.collect_list("w").over(page.rowsBetween(-BACK, -1)).alias("before")
    )
    asked = refs.select("doc_id", "kind", "ref").distinct()
    asked = asked.select("*", _head(g.digits(g.number_of(F.col("ref")))).alias("head"), g.digits(g.body_of(F.col("ref"))).alias("body"))
    out = ["doc_id", "page_no", "kind", "ref", "first", "last", "found_by"]

    # from a word of a kind on: itself, then with the numbers behind it
    run = _while(F.col("next"), kind, lambda x: number_word(x["text"]) & on_line(F.col("w"), x))
    starts = placed.withColumn("kind", F.explode(_with_kind(F.col("w.text")))).withColumn("run", run)
    parts = F.transform(F.sequence(F.lit(0), F.size("run")), lambda n: F.struct(n.alias("n"), F.when(n == 0, F.col("w.ord")).otherwise(F.get(F.col("run"), n - 1)["ord"]).alias("last"), F.array_join(F.concat(F.array("w.text"), F.transform(F.slice("run", F.lit(1), n), lambda x: x["text"])), " ").alias("phrase")))
    each = starts.select("doc_id", "page_no", "kind", F.col("w.ord").alias("first"), F.explode(parts).alias("p")).select("doc_id", "page_no", "kind", "first", "p.*").withColumn("head", _head(g.digits("phrase")))
    parted = F.regexp_replace("phrase", r"(?<=[A-Za-zА-Яа-яЁё])(?=\d)", " ")
    forward = each.join(asked, ["doc_id", "kind", "head"]).where(ln.phrase_names(parted, F.col("kind"), F.col("ref"))).withColumn("found_by", F.when(F.col("n") == 0, 1).otherwise(2)).select(out)

    # from a number back to its kind, as far as the line goes
    line_before = _while(F.reverse("before"), kind, lambda x: on_line(x, F.col("w")))
    numbers = placed.where(number_word(F.col("w.text"))).withColumn("back", line_before)
    kinds = F.flatten(F.transform("back", lambda x, i: F.transform(_with_kind(x["text"]), lambda k: F.struct(k.alias("kind"), (i + 1).alias("distance"), x["ord"].alias("ord")))))
    # a kind counts where it stands nearest to the number
    nearest = F.filter(kinds, lambda c: ~F.exists(kinds, lambda d: (d["kind"] == c["kind"]) & (d["distance"] < c["distance"])))
    back = numbers.select("doc_id", "page_no", F.col("w.text").alias("token"), F.col("w.ord").alias("last"), nearest.alias("kinds")).withColumn("head", _head(g.digits("token")))
    near = back.withColumn("k", F.explode("kinds")).select("doc_id", "page_no", "token", "last", "head", "k.kind", "k.distance", F.col("k.ord").alias("first"))
    met = near.join(asked, ["doc_id", "kind", "head"]).where(F.length("body") >= 4)
    whole = ln.phrase_names(F.concat_ws(" ", "kind", "token"), F.col("kind"), F.col("ref"))
    same = g.digits(g.body_of(F.concat_ws(" ", "kind", "token"))) == F.col("body")
    behind = met.withColumn("found_by", F.when(whole, 3).when(same & (F.col("distance") <= BACK_BODY), 4)).where("found_by is not null").select(out)

    # numbers of kinds that need no name, with none of their kind just before them
    alone = F.array_compact(F.array(*(F.when(F.col("token").rlike(p), F.lit(k)) for k, p in BARE.items())))
    held = F.transform(F.filter("kinds", lambda c: c["distance"] <= BACK_BODY), lambda c: c["kind"])
    lone = back.select("doc_id", "page_no", "token", "head", F.col("last").alias("first"), "last", F.explode(F.array_except(alone, held)).alias("kind")).join(asked, ["doc_id", "kind", "head"])
    lone = lone.where((F.length("body") >= 4) & (g.digits(g.body_of(F.concat_ws(" ", "kind", "token"))) == F.col("body"))).withColumn("found_by", F.lit(4)).select(out)
    every = forward.unionByName(behind).unionByName(lone)
    return every.groupBy("doc_id", "page_no", "kind", "ref", "first", "last").agg(F.min("found_by").alias("found_by"))
