"""References against registries: a blocked fuzzy join, ranked matches, status.

Candidates meet on keys, never by comparing every reference with every row: the digits of a code, and its body with one digit
masked (one misread digit) beside its year, as other years are never compatible. Amendments name the code they amend, so a row also
offers the keys of the code-like runs in its text. What meets is first reduced to pairs of a reference and a row; texts are
joined to these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import grammar as g
from docspark.functions import scalar as s


def _keys(run: Column) -> Column:
    body, year = g.split_year(run)
    masks = F.transform(F.sequence(F.lit(1), F.greatest(F.length(body), F.lit(1))), lambda i: F.concat(F.overlay(body, F.lit("*"), i, F.lit(1)), F.lit("|"), year))
    return F.array_distinct(F.concat(F.array(run), masks))


def candidates(refs: DataFrame, registry: DataFrame) -> DataFrame:
    """(kind, ref, target, run, row_ord, code, name, code_n, name_n, row_run, name_run) of pairs that share a key.

    ``refs(kind, ref)`` with at least four digits; ``registry(row_ord, code, name)``, rows by distinct row_ord.
    """
    asked = refs.select("kind", "ref").distinct().select("*", g.norm_code(g.search_query(F.col("kind"), F.col("ref"))).alias("target"), g.digits(g.query_number(F.col("kind"), F.col("ref"))).alias("run")).where(F.length("run") >= 4)
    rows = registry.select("row_ord", "code", "name", g.norm_code(F.col("code")).alias("code_n"), g.norm_code(F.col("name")).alias("name_n"))
    rows = rows.withColumns({"row_run": g.digits(F.col("code_n")), "name_run": g.digits(F.col("name_n"))})
    inner = F.transform(F.regexp_extract_all(F.concat_ws(" ", "code_n", "name_n"), F.lit(r"(\d[\d.\-]{3,})"), F.lit(1)), g.digits)
    runs = F.filter(F.array_distinct(F.concat(F.array("row_run", "name_run"), inner)), lambda r: r != "")
    offered = rows.select("row_ord", F.explode(F.array_distinct(F.flatten(F.transform(runs, _keys)))).alias("key"))
    met = asked.select("kind", "ref", F.explode(_keys(F.col("run"))).alias("key")).join(offered, "key").select("kind", "ref", "row_ord").distinct()
    return met.join(asked, ["kind", "ref"]).join(rows, "row_ord")


def match_a(refs: DataFrame, registry: DataFrame, threshold: int = 35) -> DataFrame:
    """The best row of registry A for each reference: score 120 for the code itself down to 15, less 40 for amendments."""
    c = candidates(refs, registry)
    by_code, by_name = g.digits_compatible(F.col("run"), F.col("row_run")), g.digits_compatible(F.col("run"), F.col("name_run"))
    in_code, in_name = F.contains("code_n", "target"), F.contains("name_n", "target")
    score = F.when(F.col("code_n") == F.col("target"), 120).when(in_code, 105).when(by_code, 95).when(by_name, 75).when(F.contains("code_n", F.lower("kind")), 35).otherwise(15)
    score = score - F.when(F.lower("code").contains("изменение"), 40).otherwise(0)
    return _best(c.where(by_code | in_code | by_name | in_name).withColumn("score", score), threshold)


def match_b(refs: DataFrame, registry: DataFrame, threshold: int = 20) -> DataFrame:
    """The same for registry B, with its scores 100, 80, 60 and 40."""
    c = candidates(refs, registry)
    by_code, by_name = g.digits_compatible(F.col("run"), F.col("row_run")), g.digits_compatible(F.col("run"), F.col("name_run"))
    in_code, in_name = F.contains("code_n", "target"), F.contains("name_n", "target")
    exact = (F.col("code_n") == F.col("target")) | ((F.col("row_run") == F.col("run")) & F.contains("code_n", F.lower("kind")))
    score = F.when(exact, 100).when(in_code | ((F.col("code_n") != "") & F.contains("target", "code_n")), 80).when(F.contains("row_run", "run"), 60).when(in_name, 40).otherwise(0)
    return _best(c.where(by_code | in_code | by_name | in_name).withColumn("score", score), threshold)


def _best(scored: DataFrame, threshold: int) -> DataFrame:
    top = scored.groupBy("kind", "ref").agg(F.max_by(F.struct("row_ord", "code", "name", "score"), F.struct("score", -F.col("row_ord"))).alias("top"))
    return top.select("kind", "ref", "top.*").where(F.col("score") >= threshold)


def checks_a(matches: DataFrame, cards: DataFrame, today: Column) -> DataFrame:
    """Matches with dates and status; ``cards(row_ord, intro, cancel)`` hold dd.mm.yyyy texts."""
    card = cards.select("row_ord", s.dotted_date(F.col("intro")).alias("intro_date"), s.dotted_date(F.col("cancel")).alias("cancel_date"))
    return matches.join(card, "row_ord", "left").withColumn("status", s.validity(F.col("intro_date"), F.col("cancel_date"), today))


def retry_missing(refs: DataFrame, matches: DataFrame, registry: DataFrame, limit: int = 20) -> DataFrame:
    """References without a match, asked again with one digit exchanged; kinds with near neighbours are left out."""
    missing = refs.select("kind", "ref").distinct().join(matches, ["kind", "ref"], "left_anti").where("kind not in ('ТКП', 'СП', 'СН', 'СНиП')")
    asked = missing.select("kind", "ref", F.posexplode(g.digit_variants(g.query_number(F.col("kind"), F.col("ref")), limit)).alias("step", "num"))
    target = g.norm_code(F.concat_ws(" ", "kind", "num"))
    rows = registry.select("row_ord", "code", g.norm_code(F.col("code")).alias("target"))
    hits = asked.withColumn("target", target).join(rows, "target")
    w = Window.partitionBy("kind", "ref").orderBy("step", "row_ord")
    return hits.withColumn("row_no", F.row_number().over(w)).where("row_no = 1").select("kind", "ref", "num", "row_ord", "code")


def designation_b(number: Column, ond: Column, ond1: Column, other: Column) -> Column:
    part = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    named = F.concat_ws(" ", part(number), part(ond), part(ond1))
    return F.when(named != "", named).otherwise(F.coalesce(part(other), F.lit("")))


def card_fields(cards: DataFrame, text: str = "html") -> DataFrame:
    """Cells of two-column table rows as a map; of a repeated key the last value."""
    html = F.coalesce(F.col(text), F.lit(""))
    pattern = F.lit(r"(?is)<tr[^>]*>\s*<t[dh][^>]*>(.*?)</t[dh]>\s*<t[dh][^>]*>(.*?)</t[dh]>\s*</tr>")
    keys, values = (F.transform(F.regexp_extract_all(html, pattern, F.lit(i)), s.strip_tags) for i in (1, 2))
    pairs = F.filter(F.arrays_zip(keys.alias("key"), values.alias("value")), lambda p: p["key"] != "")
    last = F.reverse(F.aggregate(F.reverse(pairs), F.array().cast("array<struct<key:string,value:string>>"), lambda seen, p: F.when(F.exists(seen, lambda x: x["key"] == p["key"]), seen).otherwise(F.concat(seen, F.array(F.struct(p["key"].alias("key"), p["value"].alias("value")))))))
    return cards.withColumn("fields", F.map_from_entries(last))
