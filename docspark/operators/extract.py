"""From page text to references: spans of designations, containment, first-wins dedupe.

Text is rewritten and spans are found by one Arrow function over the text column (``docspark.operators.rewriting``); all else is
relational and keyed by document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import grammar as g
from docspark.operators.rewriting import read_text


def spans(sources: DataFrame) -> DataFrame:
    """One row for each complete designation of ``sources(doc_id, source_ord, text)``: place in the rewritten text and, as raw_start
    and raw_stop, in the text as it came, from which the context is."""
    read = sources.select("doc_id", "source_ord", F.coalesce("text", F.lit("")).alias("text")).withColumn("read", read_text("text"))
    found = read.select("doc_id", "source_ord", "text", F.explode("read.spans").alias("s"))
    found = found.select("doc_id", "source_ord", "text", "s.kind", "s.start", "s.stop", "s.raw_start", "s.raw_stop", g.once(g.clip_number(F.col("s.raw"), F.col("s.kind"))).alias("num"))
    found = found.where(g.number_complete(F.col("num"), F.col("kind")) & ~g.noise_number(F.col("num")))
    ref = F.concat_ws(" ", "kind", g.format_number(F.col("num"), F.col("kind")))
    context = F.left(F.trim(F.regexp_replace(F.substr("text", F.greatest(F.lit(1), F.col("raw_start") - 79), F.col("raw_stop") - F.col("raw_start") + 160), r"\s+", " ")), F.lit(160))
    return found.select("doc_id", "source_ord", "kind", "start", "stop", "raw_start", "raw_stop", ref.alias("ref"), context.alias("context"))


def outermost(spans: DataFrame, keys: tuple[str, ...] = ("doc_id", "source_ord")) -> DataFrame:
    """Spans that no longer span of their source contains; equal spans all stay."""
    order = Window.partitionBy(*keys).orderBy("start", F.desc("stop"))
    # in this order the furthest end so far belongs to a span that starts no later; it contains all that end before it
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begin = F.max_by("start", F.struct("stop", -F.col("start"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    inside = (reach > F.col("stop")) | ((reach == F.col("stop")) & (begin < F.col("start")))
    return spans.withColumn("inside", F.coalesce(inside, F.lit(False))).where("not inside").drop("inside")


def first_of(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key: no sort of the whole, one shuffle on the keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("row_no", F.row_number().over(w)).where("row_no = 1").drop("row_no")


def references(sources: DataFrame) -> DataFrame:
    """doc_id, ord, kind, ref, context, canon_key: each designation of a document once, in order of first appearance."""
    found = outermost(spans(sources)).withColumn("canon_key", g.canonical_key(F.col("kind"), F.col("ref")))
    once = first_of(found, ["doc_id", "canon_key"], ["source_ord", "start"])
    order = Window.partitionBy("doc_id").orderBy("source_ord", "start", "canon_key")
    return once.select("doc_id", F.row_number().over(order).alias("ord"), "kind", "ref", "context", "canon_key")
