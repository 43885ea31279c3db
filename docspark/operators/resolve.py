"""Conflicting readings of one designation: votes of sources, best spelling, year and number variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import grammar as g
from docspark.operators.extract import first_of
from docspark.plans.settle import settled


def source_votes(readings: DataFrame) -> DataFrame:
    """Votes of each (doc_id, kind, ref) of ``readings(doc_id, source_ord, kind, ref)``: sources that read it; equal
    sources count each."""
    return readings.groupBy("doc_id", "kind", "ref").agg(F.count_distinct("source_ord").alias("votes"), F.min("source_ord").alias("first_source"))


def best_spelling(votes: DataFrame) -> DataFrame:
    """One spelling for each canonical key of a document: longest year, most votes, dots, quality, length; first on ties."""
    keyed = votes.withColumn("canon_key", g.canonical_key(F.col("kind"), F.col("ref")))
    rank = F.struct(g.rank_key(F.col("kind"), F.col("ref"), F.col("votes")).alias("rank"), (-F.col("first_source")).alias("first"), F.col("ref").alias("text"))
    best = keyed.groupBy("doc_id", "canon_key").agg(F.max_by(F.struct("kind", "ref", "votes"), rank).alias("best"))
    return best.select("doc_id", "canon_key", "best.kind", "best.ref", "best.votes")


def year_variants(votes: DataFrame) -> DataFrame:
    """Editions of one number that stay: unvoted years go once any is voted; of years at most one apart, or of two and four
    digits with equal ends, the one with fewer votes goes.

    A year is dropped for any better year of its number, kept or not; so a chain of neighbours keeps its peaks.
    """
    keyed = votes.select("doc_id", "kind", "ref", "votes", g.base_key(F.col("kind"), F.col("ref")).alias("base"), g.year_of(F.col("ref")).alias("year"))
    one = first_of(keyed, ["doc_id", "base", "year"], [F.desc("votes"), F.desc(F.length("ref")), "ref"])
    one = one.withColumn("confirmed", F.max("votes").over(Window.partitionBy("doc_id", "base")) > 0).where("not confirmed or votes > 0")
    other = one.select("doc_id", "base", F.col("year").alias("y"), F.col("votes").alias("v"))
    number = lambda c: F.expr(f"try_cast({c} as int)")
    ends = F.when(F.length("year") < F.length("y"), F.endswith("y", "year")).when(F.length("year") > F.length("y"), F.endswith("year", "y")).otherwise(F.abs(number("year") - number("y")) <= 1)
    better = (F.col("v") > F.col("votes")) | ((F.col("v") == F.col("votes")) & ((F.length("y") > F.length("year")) | ((F.length("y") == F.length("year")) & (F.col("y") < F.col("year")))))
    lost = one.join(other, ["doc_id", "base"]).where((F.col("y") != F.col("year")) & (F.col("y") != "") & (F.col("year") != "") & F.coalesce(ends, F.lit(False)) & better)
    return one.join(lost.select("doc_id", "base", "year").distinct(), ["doc_id", "base", "year"], "left_anti").select("doc_id", "kind", "ref", "votes", "base", "year")


def number_conflicts(votes: DataFrame) -> DataFrame:
    """Pairs of one document and kind, of compatible years, whose bodies are one substitution or one to two further digits
    apart, with the reading that loses: fewer votes, then the shorter body; equal ones both stay (loser null).

    ``votes`` is computed once, however many sides of the joins read it. Bodies of one length meet on the body with one digit masked, which two of them share at most once; others on the whole
    shorter body, which only longer ones offer as a prefix. So no document's readings are paired with each other at large.
    """
    keyed = settled(votes.select("doc_id", "kind", "ref", "votes", g.body_of(F.col("ref")).alias("body"), g.year_of(F.col("ref")).alias("year"))).where("body <> ''")
    side = lambda df, name: df.select("doc_id", "kind", "key", *(F.col(c).alias(f"{c}_{name}") for c in ("ref", "votes", "body", "year")))
    masks = F.transform(F.sequence(F.lit(1), F.length("body")), lambda i: F.overlay(F.col("body"), F.lit("*"), i, F.lit(1)))
    masked = keyed.where("kind <> 'ОСТ'").withColumn("key", F.explode(masks))
    years = "body_a <> body_b and (year_a = '' or year_b = '' or year_a = year_b)"
    changed = side(masked, "a").join(side(masked, "b"), ["doc_id", "kind", "key"]).where(f"ref_a < ref_b and {years}")
    cut = keyed.withColumn("key", F.explode(F.array(F.left("body", F.length("body") - 1), F.left("body", F.length("body") - 2)))).where("key <> ''")
    longer = side(keyed.withColumn("key", F.col("body")), "a").join(side(cut, "b"), ["doc_id", "kind", "key"]).where(years)
    swap = F.col("ref_a") > F.col("ref_b")
    longer = longer.select("doc_id", "kind", *(F.when(swap, F.col(f"{c}_{q}")).otherwise(F.col(f"{c}_{p}")).alias(f"{c}_{p}") for p, q in ("ab", "ba") for c in ("ref", "votes", "body", "year")))
    pairs = changed.drop("key").unionByName(longer)
    gap = F.length("body_a") - F.length("body_b")
    loser = (
        F.when(F.col("votes_a") > F.col("votes_b"), F.col("ref_b")).when(F.col("votes_b") > F.col("votes_a"), F.col("ref_a"))
        .when(gap > 0, F.col("ref_b")).when(gap < 0, F.col("ref_a"))
    )
    return pairs.select("doc_id", "kind", "ref_a", "ref_b", loser.alias("loser"))


def without_conflicts(votes: DataFrame) -> DataFrame:
    votes = settled(votes)
    losers = number_conflicts(votes).where("loser is not null").select("doc_id", "kind", F.col("loser").alias("ref")).distinct()
    return votes.join(losers, ["doc_id", "kind", "ref"], "left_anti")


def repair_by_body(votes: DataFrame) -> DataFrame:
    """Each reference with the best reading of its body in the document: most votes, quality, longest year, length."""
    body = g.body_of(F.col("ref"))
    rank = F.struct("votes", g.gost_quality(F.col("ref")).alias("q"), F.length(g.year_of(F.col("ref"))).alias("y"), F.length("ref").alias("n"), "ref")
    best = votes.groupBy("doc_id", "kind", body.alias("body")).agg(F.max_by("ref", rank).alias("repaired"))
    return votes.withColumn("body", body).join(best, ["doc_id", "kind", "body"]).select("doc_id", "kind", "ref", "repaired")


def family_support(refs: DataFrame, digits: int = 6) -> DataFrame:
    """For each ОСТ reference how many of its document share its leading digits."""
    family = F.left(g.body_of(F.col("ref")), F.lit(digits))
    ost = refs.where("kind = 'ОСТ'").withColumn("family", family)
    return ost.withColumn("support", F.count("*").over(Window.partitionBy("doc_id", "family")))


def one_digit_swaps(refs: DataFrame) -> DataFrame:
    """ОСТ references less those that differ in one digit from one of a larger family; equal families keep both."""
    own = family_support(refs).select("doc_id", "ref", g.body_of(F.col("ref")).alias("body"), "support")
    # one body is of one family, so a larger family under a mask is always that of another body: no pairs are made
    met = own.distinct().withColumn("mask", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("body"), F.lit(1))), lambda i: F.overlay(F.col("body"), F.lit("*"), i, F.lit(1)))))
    largest = met.groupBy("doc_id", "mask").agg(F.max("support").alias("s"))
    lost = met.join(largest, ["doc_id", "mask"]).where("s > support").select("doc_id", "ref").distinct()
    return own.join(lost, ["doc_id", "ref"], "left_anti")


def confirmed(refs: DataFrame, trusted: DataFrame) -> DataFrame:
    """References whose canonical key is read in trusted text; documents without trusted text keep all."""
    keyed = refs.withColumn("canon_key", g.canonical_key(F.col("kind"), F.col("ref")))
    known = trusted.select("doc_id", g.canonical_key(F.col("kind"), F.col("ref")).alias("canon_key")).distinct()
    has = trusted.select("doc_id").distinct()
    return keyed.join(known, ["doc_id", "canon_key"], "left_semi").unionByName(keyed.join(has, "doc_id", "left_anti"))


def supplemented(refs: DataFrame, more: DataFrame) -> DataFrame:
    """``refs`` and those of ``more`` with a new canonical key; of the latter the first of each key."""
    key = g.canonical_key(F.col("kind"), F.col("ref"))
    own, new = refs.withColumn("canon_key", key), first_of(more.withColumn("canon_key", key), ["doc_id", "canon_key"], ["ref"])
    return own.select("doc_id", "kind", "ref", "canon_key").unionByName(new.join(own, ["doc_id", "canon_key"], "left_anti").select("doc_id", "kind", "ref", "canon_key"))
