"""Label curation, split and manifest of training sets; settings and sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.operators.extract import first_of


def matched_labels(labels: DataFrame, crops: DataFrame) -> DataFrame:
    """Labels with the crop of their stem: the stem itself, else without dots; an exact match scores 10, another 1."""
    bare = lambda c: F.replace(F.lower(c), F.lit("."), F.lit(""))
    exact = labels.join(crops.select(F.col("stem"), F.col("stem").alias("crop")), "stem").withColumn("score", F.lit(10))
    rest = labels.join(crops, "stem", "left_anti").withColumn("bare", bare(F.col("stem")))
    loose = rest.join(crops.select(bare(F.col("stem")).alias("bare"), F.col("stem").alias("crop")), "bare").drop("bare").withColumn("score", F.lit(1))
    return exact.unionByName(loose)


def orphans(labels: DataFrame, crops: DataFrame) -> DataFrame:
    return labels.join(matched_labels(labels, crops).select("file"), "file", "left_anti")


def labels_once(matched: DataFrame) -> DataFrame:
    """One label for each crop and zone: the best score, then the longest text, then the first file."""
    return first_of(matched, ["crop", "zone"], [F.desc("score"), F.desc(F.length("text")), "file"])


def usable_labels(labels: DataFrame, least: int = 3, share: float = 0.35, letters: str = "[А-Яа-яЁё]") -> DataFrame:
    """Labels of some length with a sufficient share of letters of the script."""
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(letters))
    return labels.where((F.length(F.trim("text")) >= least) & (n / F.greatest(F.length("text"), F.lit(1)) >= share))


def train_split(items: DataFrame, key: str, ratio: float, order=None, ranges: int = 4096) -> DataFrame:
    """``part`` valid for max(1, share) items in hash order, ties at the boundary included, and train for others.

    The order's values are counted in ``ranges`` equal ranges, and only the range that holds the boundary is sorted.
    """
    order = (F.xxhash64(F.col(key), F.lit(42)) if order is None else order).cast("long")
    n, low, high = items.agg(F.count("*"), F.min(order), F.max(order)).first()
    if not n:
        return items.withColumn("part", F.lit("train"))
    left, width = max(1, int(n * ratio)), (high - low) // ranges + 1
    span = F.floor((order.cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)")).cast("int")
    for r in items.groupBy(span.alias("span")).count().sort("span").collect():
        if left <= r["count"]:
            break
        left -= r["count"]
    boundary = items.where(span == r["span"]).select(order.alias("o")).sort("o").limit(left).agg(F.max("o")).first()[0]
    return items.withColumn("part", F.when(order <= F.lit(boundary), "valid").otherwise("train"))


def prefer_zone(labels: DataFrame, better: str = "stamp_frame", worse: str = "stamp_block") -> DataFrame:
    has = labels.where(F.col("zone") == better).select("stem").distinct()
    return labels.where(F.col("zone") != worse).unionByName(labels.where(F.col("zone") == worse).join(has, "stem", "left_anti"))


def upsert(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Settings after an upsert: new values win, a label stays where the new one is empty."""
    o = old.select(F.col(key), F.col("value").alias("old_value"), F.col("label").alias("old_label"))
    n = new.select(F.col(key), F.col("value").alias("new_value"), F.col("label").alias("new_label"))
    return o.join(n, key, "full").select(key, F.coalesce("new_value", "old_value").alias("value"), F.coalesce(F.nullif(F.col("new_label"), F.lit("")), F.col("old_label"), F.lit("")).alias("label"))


def by_prefix(settings: DataFrame, prefix: str) -> DataFrame:
    """Settings under a prefix, without it; empty values go."""
    return settings.where(F.startswith("key", F.lit(prefix)) & (F.coalesce("value", F.lit("")) != "")).select(F.substr("key", F.lit(len(prefix) + 1)).alias("key"), "value")


def insert_if_empty(settings: DataFrame, legacy: DataFrame) -> DataFrame:
    return settings.unionByName(legacy.join(settings.where("value <> ''"), "key", "left_anti").join(settings, "key", "left_anti"))


def manifest(labels: DataFrame, most: int = 12_000) -> DataFrame:
    return labels.select("stem", "zone", F.left("text", F.lit(most)).alias("text"), F.length("text").alias("n_chars"))


def newest(files: DataFrame, keep: int) -> DataFrame:
    """Files beyond the ``keep`` newest of each folder, to be pruned."""
    w = Window.partitionBy("folder").orderBy(F.desc("mtime"), "name")
    return files.withColumn("row_no", F.row_number().over(w)).where(F.col("row_no") > keep).drop("row_no")


def label_counts(labels: DataFrame) -> DataFrame:
    """Labels and stems of each zone."""
    return labels.groupBy("zone").agg(F.count("*").alias("n"), F.count_distinct("stem").alias("stems"))


def run_summary(facts: DataFrame) -> DataFrame:
    """Sums of each benchmark run over ``facts(run, n_rows, ok, seconds)``, one row a file."""
    return facts.groupBy("run").agg(F.count("*").alias("files"), F.sum("n_rows").alias("n_rows"), F.count_if(F.col("n_rows") > 0).alias("with_rows"), F.count_if("ok").alias("ok"), F.sum("seconds").alias("seconds"))
