"""Composites: references of documents and of pages, and their checks against both registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.operators import extract, registry, report, resolve
from docspark.plans.settle import settled


def with_combined(sources: DataFrame) -> DataFrame:
    """The sources of each document and, as one more source 0, all of them joined by blank lines in order."""
    whole = sources.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_ord", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    return sources.select("doc_id", "source_ord", "text").unionByName(whole.withColumn("source_ord", F.lit(0).cast(sources.schema["source_ord"].dataType)))


def reconciled(sources: DataFrame) -> DataFrame:
    """doc_id, kind, ref, votes: the designations of each document, one spelling each, after votes over its distinct sources.

    Readings are counted by source; then the best spelling of each key, editions that stay, conflicting numbers, and one-digit
    swaps among ОСТ numbers. Each step is keyed by the document.
    """
    once = sources.where(F.trim(F.coalesce("text", F.lit(""))) != "").groupBy("doc_id", "text").agg(F.min("source_ord").alias("source_ord"))
    readings = extract.outermost(extract.spans(with_combined(once)))
    spelled = settled(resolve.best_spelling(resolve.source_votes(readings)))
    kept = settled(resolve.without_conflicts(settled(resolve.year_variants(spelled))))
    ost = kept.where("kind = 'ОСТ'")
    survivors = resolve.one_digit_swaps(ost).select("doc_id", "ref")
    return kept.where("kind <> 'ОСТ'").unionByName(ost.join(survivors, ["doc_id", "ref"], "left_semi").select(*kept.columns)).select("doc_id", "kind", "ref", "votes")


def page_references(pages: DataFrame) -> DataFrame:
    """doc_id, ref, pages: where each designation of a document is read."""
    sources = pages.select("doc_id", F.col("page_no").alias("source_ord"), "text")
    return report.pages_of(extract.spans(sources).select("doc_id", "ref", F.col("source_ord").alias("page_no")))


def checked(refs: DataFrame, registry_a: DataFrame, cards: DataFrame, today: Column) -> DataFrame:
    """References with the status of their best match in registry A; those not found are asked again with one digit
    exchanged, and the rest say so."""
    found = registry.match_a(refs, registry_a).select("kind", "ref", "row_ord")
    again = registry.retry_missing(refs, found, registry_a).select("kind", "ref", "row_ord")
    dated = registry.checks_a(found.unionByName(again), cards, today).select("kind", "ref", "row_ord", "status")
    return refs.select("kind", "ref").distinct().join(dated, ["kind", "ref"], "left").withColumn("status", F.coalesce("status", F.lit("не в фонде")))
