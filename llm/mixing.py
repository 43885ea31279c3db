"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

A source's target says how often each of its documents is expected in the mix. The documents of a source stand in a line, their
expected copies are summed up from the first on, one random offset is added, and a document is taken once for each
whole number that its part of the line crosses. So each document comes the floor or the ceiling of its expected number
of times. Along the line sizes rise through a random half of the documents and fall through the other: neighbours are of like
size, what is taken too long on the way up is taken too short on the way down, and the words taken come near the target.

Orders over all rows are dealt to ranges, each range sums its own rows, and the sums of the ranges before are added: no task takes
a source whole, however much of the table it holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import cut, joined

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, over and over, and the most copies of a document.
WEIGHTS, MOST = (1, 2, 3), 3
SEED = "mix-1"
#: Parts of one copy in which expected copies and offsets are counted, so that all sums are of whole numbers.
UNITS = 10**12


def draw(*parts: Column) -> Column:
    """32 random bits from the seed and the values, the same in each run."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def running(df: DataFrame, order: list[Column], values: dict[str, Column], label: str, within: Sequence[str] = ()) -> DataFrame:
    """``df`` with a column for each of ``values``: its sum over the rows before, in the order given; of the same ``within``.

    ``order`` starts with what ``within`` names and leaves no ties. One exchange by ranges and one by range number; what
    meets in one place is a row for each range (and each value of ``within`` in it).
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = {name: f"__{name}" for name in values}
    ranged = df.select("*", *(v.alias(kinds[k]) for k, v in values.items())).repartitionByRange(parts, *order)
    ranged = cut(ranged.withColumn("__part", F.spark_partition_id()), label)
    totals = ranged.groupBy("__part", *within).agg(*(F.sum(c).alias(c) for c in kinds.values()))
    earlier = Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(totals.select("__part", *within, *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_start") for c in kinds.values())), f"{label}-starts")
    inside = Window.partitionBy("__part", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = joined(ranged, starts, ["__part", *within])
    sums = [(F.col(f"{c}_start") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(name) for name, c in kinds.items()]
    return out.select(*df.columns, *sums)


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """A row for each source of (source, size): source_key, source_size and target words.

    Targets share the size of all sources by weight. With full sources taken out in order of (size a weight), the level of the
    others, words left a weight left, is highest when exactly those are out that the level overflows; that level
    times the weight is each other target.
    """
    sources = cut(sized.groupBy("source", "source_key").agg(F.sum("size").alias("source_size")), "sources")
    ranked = running(sources, [F.col("source").isNull().asc(), F.col("source").asc()], {"nth": F.lit(1).cast("long")}, "ranked")
    weight = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("full", F.col("source_size") * most)
    filled = cut(running(ranked, [(F.col("full") / F.col("weight")).asc(), F.col("nth").asc()], {"full_before": F.col("full"), "weight_before": F.col("weight")}, "filled"), "levels")
    whole = filled.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    left = (F.lit(whole["size"] or 0) - F.col("full_before")).cast("double") / (F.lit(whole["weight"] or 0) - F.col("weight_before")).cast("double")
    level = filled.agg(F.max(left)).first()[0] or 0.0
    return cut(filled.select("source_key", "source_size", F.least(F.col("full").cast("double"), F.lit(level) * F.col("weight")).alias("target")), "targets")


def copies(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = SEED, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, size (words), source_size, target, copies and taken (words) of every row, and the columns named in ``keep``.

    A null or empty text has size 0 and may be taken, which adds no words; sources of no words are never taken. A null source is
    one of its own. Repeated rows and rows with a null doc_id are each counted; of rows alike in source, size and
    doc_id it does not matter which is taken. Very long texts are counted whole; other columns are not read. An
    empty table gives an empty one. Two runs give the same rows.
    """
    source = docs["source"].cast("string")
    sized = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), source.alias("source"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("source_key"),
        F.coalesce(F.regexp_count(docs["text"].cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *(docs[c].alias(f"kept_{c}") for c in keep),
    )
    sized = cut(sized.withColumn("row", F.monotonically_increasing_id()), "sized")
    shares = targets(sized, weights, most)
    expected = F.when(F.col("source_size") > 0, F.floor(F.least(F.lit(float(most)), F.col("target") / F.col("source_size")) * UNITS)).otherwise(0)
    dealt = joined(sized, shares, ["source_key"])
    dealt = dealt.select("*", expected.cast("decimal(20,0)").alias("expected"), draw(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).alias("dealt"))
    dealt = dealt.withColumn("height", F.when(F.col("dealt") % 2 == 0, F.col("size")).otherwise(-F.col("size")))
    order = [F.col("source_key").asc(), (F.col("dealt") % 2).asc(), *(F.col(c).asc() for c in ("height", "dealt", "doc_id", "row"))]
    line = running(dealt, order, {"before": F.col("expected")}, "line", ["source_key"])
    offset = (draw(F.lit(seed), F.col("source_key")) % 1_000_000 * (UNITS // 1_000_000)).cast("decimal(20,0)")
    line = line.withColumn("at", F.col("before") + offset)
    crossed = F.expr(f"(at + expected) div {UNITS} - at div {UNITS}").cast("long")
    return line.select("doc_id", "size", "source_size", "target", crossed.alias("copies"), (crossed * F.col("size")).alias("taken"), *(F.col(f"kept_{c}").alias(c) for c in keep))


def mixture(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mix itself: doc_id, source and text, a row for each copy, numbered from 0 in ``copy``."""
    taken = copies(docs, weights, most, seed, keep=["source", "text"])
    return taken.where("copies > 0").select("doc_id", "source", "text", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).alias("copy"))
