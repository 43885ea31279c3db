"""The plan of a document's tiles: which parts of its pages are read, in which order, and what their texts and words come to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import scalar as s
from docspark.operators import blocks, layout
from docspark.operators.extract import first_of

#: Overlap of neighbouring tiles as a share of one, and of those of wide sheets at least.
OVERLAP, WIDE_OVERLAP = 0.12, 0.18


def jobs(pages: DataFrame, overlap: float = OVERLAP, most_pages: int | None = None) -> DataFrame:
    """doc_id, page_no, job_no, zone, x0, y0, x1, y1 of ``pages(doc_id, page_no, width, height)``.

    The zones beside the grid come first: the specification at the right, then the notes in parts. Then the tiles of a grid that is coarser
    the more pages a document has: of wide sheets column by column from the right, else row by row from below. ``most_pages``: of
    each document the first so many.
    """
    order = Window.partitionBy("doc_id").orderBy("page_no")
    own = pages.withColumn("page_at", F.row_number().over(order))
    own = own if most_pages is None else own.where(F.col("page_at") <= most_pages)
    n = F.count("*").over(Window.partitionBy("doc_id"))
    own = own.select("doc_id", "page_no", "width", "height", n.alias("n_pages"), s.is_wide(F.col("width"), F.greatest(F.col("height"), F.lit(1.0))).alias("wide"))
    gridded = own.withColumns({"cols": s.grid_columns(F.col("n_pages")), "rows": s.grid_rows(F.col("n_pages"))})
    shapes = own.select("doc_id", "page_no", "wide")
    tiles = layout.tile_grid(gridded.where("wide"), max(overlap, WIDE_OVERLAP)).unionByName(layout.tile_grid(gridded.where("not wide"), overlap)).join(shapes, ["doc_id", "page_no"])
    rank = F.when(F.col("wide"), F.struct((-F.col("col")).alias("a"), (-F.col("row")).alias("b"))).otherwise(F.struct((-F.col("row")).alias("a"), (-F.col("col")).alias("b")))
    zone = F.concat_ws("_", F.lit("tile"), F.col("row").cast("string"), F.col("col").cast("string"))
    of_grid = tiles.select("doc_id", "page_no", F.lit(1).alias("later"), rank.alias("rank"), zone.alias("zone"), *layout.BOX)
    beside = blocks.supplement_zones(own)
    # the specification before the parts of the notes, which are in order by name
    of_zones = beside.select("doc_id", "page_no", F.lit(0).alias("later"), F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")).alias("rank"), "zone", *layout.BOX)
    place = F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("later", "rank", "zone"))
    return of_zones.unionByName(of_grid).select("doc_id", "page_no", place.alias("job_no"), "zone", *layout.BOX)


def page_texts(plan: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, page_no, text, n_texts: the different texts of a page's jobs in their order, apart by blank lines.
    ``texts(doc_id, page_no, zone, text)``; blank ones are none."""
    read = plan.select("doc_id", "page_no", "job_no", "zone").join(texts.where(F.trim(F.coalesce("text", F.lit(""))) != ""), ["doc_id", "page_no", "zone"])
    once = first_of(read, ["doc_id", "page_no", "text"], ["job_no"])
    chunks = F.transform(F.array_sort(F.collect_list(F.struct("job_no", "text"))), lambda x: x["text"])
    return once.groupBy("doc_id", "page_no").agg(F.array_join(chunks, "\n\n").alias("text"), F.count("*").alias("n_texts"))


def sources(plan: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, source_ord, text: the different texts of a document, in the order of pages and jobs in which they first stand."""
    read = plan.select("doc_id", "page_no", "job_no", "zone").join(texts.where(F.trim(F.coalesce("text", F.lit(""))) != ""), ["doc_id", "page_no", "zone"])
    once = first_of(read, ["doc_id", "text"], ["page_no", "job_no"])
    return once.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "job_no")).alias("source_ord"), "text")


def page_words(layer: DataFrame, read: DataFrame, usable: DataFrame) -> DataFrame:
    """doc_id, page_no, ord, text, x0, y0, x1, y1: the words of a page's text layer where ``usable(doc_id, page_no)`` has the page, and
    those that were read; of words that stand in one place the first. ``layer`` and ``read`` hold (doc_id, page_no, text, x0, y0, x1, y1)."""
    columns = ["doc_id", "page_no", "text", *layout.BOX]
    own = layer.join(usable.distinct(), ["doc_id", "page_no"], "left_semi").select(*columns, F.lit(0).alias("later"))
    every = own.unionByName(read.select(*columns, F.lit(1).alias("later")))
    order = Window.partitionBy("doc_id", "page_no").orderBy("later", F.round("y0"), "x0", "y0", "text", "x1", "y1")
    words = every.withColumn("ord", F.row_number().over(order)).drop("later")
    copies = layout.word_duplicates(words).select("doc_id", "page_no", F.col("copy").alias("ord")).distinct()
    return words.join(copies, ["doc_id", "page_no", "ord"], "left_anti").select("doc_id", "page_no", "ord", "text", *layout.BOX)
