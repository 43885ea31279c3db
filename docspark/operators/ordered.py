"""Conflicting readings settled in order: a reading that is dropped no longer beats those behind it.

Order matters along chains only, so pairs are found by keys as everywhere, and what a pair decides is told beforehand. Who is dropped is then
settled in rounds: a reading is settled once all readings that come before it and beat it are. A round is a join; chains are short,
and the length of the longest is the number of rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import grammar as g
from docspark.plans.settle import settled

NODE = ["doc_id", "kind", "ord"]


def _pairs(nodes: DataFrame) -> DataFrame:
    """doc_id, kind, a, b: places of two readings of one kind whose bodies are one digit, or one or two further digits, apart, or of
    which one lacks a digit of the other (ГОСТ of equal years); a stands before b."""
    each = lambda positions, change: F.array_distinct(F.transform(positions, change))
    places = F.sequence(F.lit(1), F.length("body"))
    shape = {
        "masked": (F.when(F.col("kind") != "ОСТ", each(places, lambda p: F.overlay(F.col("body"), F.lit("*"), p, F.lit(1)))), None),
        "cut": (F.filter(F.array(*(F.left("body", F.length("body") - n) for n in (1, 2))), lambda k: k != ""), F.array("body")),
        "lacks": (F.when((F.col("kind") == "ГОСТ") & (F.col("year") != ""), each(places, lambda p: F.overlay(F.col("body"), F.lit(""), p, F.lit(1)))), F.array("body")),
    }
    found = None
    for name, (keys, others) in shape.items():
        one = nodes.select("doc_id", "kind", F.col("ord").alias("x"), F.explode(keys).alias("key"))
        two = nodes.select("doc_id", "kind", F.col("ord").alias("y"), F.explode(keys if others is None else others).alias("key"))
        met = one.join(two, ["doc_id", "kind", "key"]).where("x <> y").select("doc_id", "kind", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(name == "lacks").alias("lacks"))
        found = met if found is None else found.unionByName(met)
    return found.groupBy("doc_id", "kind", "a", "b").agg(F.min("lacks").alias("lacks"))


def decided(nodes: DataFrame) -> DataFrame:
    """doc_id, kind, a, b, loser: what each pair of ``nodes(doc_id, kind, ord, ref, votes, body, year)`` decides: fewer votes lose, then the
    shorter body; where one lacks a digit of the other the shorter. Years that are told must be equal. Undecided pairs go."""
    side = lambda s: nodes.select("doc_id", "kind", F.col("ord").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("votes", "body", "year")))
    met = _pairs(nodes).join(side("a"), ["doc_id", "kind", "a"]).join(side("b"), ["doc_id", "kind", "b"])
    equal = F.col("year_a") == F.col("year_b")
    prefix = F.startswith("body_a", "body_b") | F.startswith("body_b", "body_a")
    fits = F.when(F.col("lacks"), equal & ~prefix).otherwise(equal | (F.col("year_a") == "") | (F.col("year_b") == ""))
    gap = F.length("body_a") - F.length("body_b")
    shorter = F.when(gap > 0, F.col("b")).when(gap < 0, F.col("a"))
    votes = F.when(F.col("votes_a") > F.col("votes_b"), F.col("b")).when(F.col("votes_b") > F.col("votes_a"), F.col("a"))
    loser = F.when(F.col("lacks"), shorter).otherwise(F.coalesce(votes, shorter))
    return met.where(fits & (F.col("body_a") != F.col("body_b"))).select("doc_id", "kind", "a", "b", loser.alias("loser")).where("loser is not null")


def settled_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` that stay. In order, a reading not dropped by one before it is held against each later one that is still there; the loser of
    the pair goes, and a reading that loses to a later one is still held against the rest.
    """
    beats = settled(edges.where("loser = b").select("doc_id", "kind", "a", "b"))
    beaten = beats.select("doc_id", "kind", F.col("b").alias("ord")).distinct()
    # gone: dropped by an earlier reading; those that nothing beats never are
    known = settled(nodes.select(NODE).join(beaten, NODE, "left_anti").withColumn("gone", F.lit(False)))
    open_edges = beats
    while not open_edges.isEmpty():
        told = open_edges.join(known.select("doc_id", "kind", F.col("ord").alias("a"), "gone"), ["doc_id", "kind", "a"], "left")
        state = told.groupBy("doc_id", "kind", F.col("b").alias("ord")).agg(F.bool_or(F.coalesce(~F.col("gone"), F.lit(False))).alias("dropped"), F.bool_and(F.col("gone").isNotNull()).alias("whole"))
        new = settled(state.where("dropped or whole").select(*NODE, F.col("dropped").alias("gone")))
        open_edges = settled(open_edges.join(new.select("doc_id", "kind", F.col("ord").alias("b")), ["doc_id", "kind", "b"], "left_anti"))
        known = settled(known.unionByName(new))
    gone = known.where("gone").select(NODE)
    # a reading loses to a later one if neither was dropped before they met: the later one by a still earlier reading
    first = beats.join(gone.select("doc_id", "kind", F.col("ord").alias("a")), ["doc_id", "kind", "a"], "left_anti").groupBy("doc_id", "kind", "b").agg(F.min("a").alias("dropped_at"))
    later = edges.where("loser = a").join(gone.select("doc_id", "kind", F.col("ord").alias("a")), ["doc_id", "kind", "a"], "left_anti")
    later = later.join(first, ["doc_id", "kind", "b"], "left").where("dropped_at is null or dropped_at > a").select("doc_id", "kind", F.col("a").alias("ord"))
    return nodes.join(gone.unionByName(later).distinct(), NODE, "left_anti")


def number_readings(votes: DataFrame) -> DataFrame:
    """doc_id, kind, ref, votes of the readings that stay in each document, in the order in which sources first have them."""
    order = Window.partitionBy("doc_id", "kind").orderBy("first_source", "ref")
    nodes = votes.select("doc_id", "kind", F.row_number().over(order).alias("ord"), "ref", "votes", g.body_of(F.col("ref")).alias("body"), g.year_of(F.col("ref")).alias("year"))
    nodes = settled(nodes)
    told = nodes.where("body <> ''")
    return settled_order(nodes, settled(decided(told))).select("doc_id", "kind", "ref", "votes")


def _years_close(a: Column, b: Column) -> Column:
    """Equal years, one the end of the other, or at most one apart; a year that is not told is close to none but itself."""
    x, y = a.try_cast("int"), b.try_cast("int")
    ends = ((F.length(a) == 2) & (F.length(b) == 4) & F.endswith(b, a)) | ((F.length(b) == 2) & (F.length(a) == 4) & F.endswith(a, b))
    return (a == b) | F.coalesce((a != "") & (b != "") & (ends | (F.abs(x - y) <= 1)), F.lit(False))


def year_readings(votes: DataFrame) -> DataFrame:
    """doc_id, kind, ref, votes: editions of one number in order of rank - the longer year, votes, fewer dots, the longer text - each
    kept unless a kept one before it is of a close year with as many votes or more; unvoted ones go once any has votes."""
    year = g.year_of(F.col("ref"))
    dots = F.when(F.col("kind") == "ГОСТ", F.length(F.regexp_replace("ref", r"[^.]", ""))).otherwise(0)
    keyed = votes.withColumns({"base": g.base_key(F.col("kind"), F.col("ref")), "year": year, "found": (F.col("votes") > 0).cast("int")})
    rank = F.struct((-F.col("found")).alias("found"), F.when(F.length(year) >= 4, 0).when(F.length(year) == 2, 1).otherwise(2).alias("year"), (-F.col("votes")).alias("votes"), dots.alias("dots"), (-F.length("ref")).alias("size"))
    keyed = keyed.withColumn("rank", rank)
    # of one year the best, first of equal ones; few years to a number, so a number's editions fit a row
    one = keyed.groupBy("doc_id", "base", "year").agg(F.min(F.struct("rank", "first_source", "ref", "kind", "votes")).alias("x"))
    row = F.struct("x.rank", "x.first_source", "year", "x.kind", "x.ref", "x.votes")
    grouped = one.groupBy("doc_id", "base").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.max("x.votes").alias("most"))
    kind = dict(grouped.dtypes)["rows"]

    def step(kept: Column, x: Column) -> Column:
        beaten = F.exists(kept, lambda k: _years_close(x["year"], k["year"]) & ((x["votes"] < k["votes"]) | ((x["votes"] == k["votes"]) & (x["rank"] > k["rank"]))))
        return F.when(beaten, kept).otherwise(F.concat(kept, F.array(x)))

    able = F.filter("rows", lambda x: (x["votes"] > 0) | (F.col("most") == 0))
    kept = F.when(F.size("rows") == 1, F.col("rows")).otherwise(F.aggregate(able, F.array().cast(kind), step))
    return grouped.select("doc_id", F.explode(kept).alias("x")).select("doc_id", "x.kind", "x.ref", "x.votes")
