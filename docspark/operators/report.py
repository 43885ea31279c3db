"""The report: references with the checks of both registries, their pages, and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.functions import grammar as g
from docspark.functions import scalar as s


def _last(checks: DataFrame, key, prefix: str) -> DataFrame:
    return checks.groupBy(key.alias("key")).agg(F.max_by(F.struct("found", "status"), "ord").alias(prefix))


def joined_report(refs: DataFrame, checks_a: DataFrame, checks_b: DataFrame) -> DataFrame:
    """``refs(doc_id, ord, kind, ref)`` with the last check of each registry, by the exact text first and by the normalised code
    second; ``checks(ord, ref, found, status)``."""
    out = refs.withColumn("code", g.norm_code(F.col("ref")))
    for name, checks in (("a", checks_a), ("b", checks_b)):
        exact, loose = _last(checks, F.col("ref"), "exact"), _last(checks, g.norm_code(F.col("ref")), "loose")
        out = out.join(exact.withColumnRenamed("key", "ref"), "ref", "left").join(loose.withColumnRenamed("key", "code"), "code", "left")
        out = out.withColumn(name, F.coalesce("exact", "loose")).drop("exact", "loose")
    found = lambda c: F.coalesce(F.col(f"{c}.found"), F.lit(False))
    status = s.consensus(found("a"), F.col("a.status"), found("b"), F.col("b.status"))
    return out.select("doc_id", "ord", "kind", "ref", found("a").alias("found_a"), found("b").alias("found_b"), status.alias("status"))


def pages_of(readings: DataFrame) -> DataFrame:
    """Pages on which each reference of a document is read, ascending."""
    return readings.groupBy("doc_id", "ref").agg(F.array_sort(F.collect_set("page_no")).alias("pages"))


def summary(report: DataFrame) -> DataFrame:
    return report.groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if("found_a").alias("found_a"), F.count_if("found_b").alias("found_b"), F.count_if(F.col("status") == "актуален").alias("active"), F.bool_and(~F.col("found_a") & ~F.col("found_b")).alias("none_found"))
