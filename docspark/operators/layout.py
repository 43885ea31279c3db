"""Tiles, word boxes and rectangles of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions import scalar as s

BOX = ("x0", "y0", "x1", "y1")


def tile_grid(pages: DataFrame, overlap: float = 0.12, least: float = 40.0) -> DataFrame:
    """Overlapping tiles of ``pages(doc_id, page_no, width, height, cols, rows)``; edges are padded inwards only."""
    grid = pages.withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols") - 1))).withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
    w, h = F.col("width") / F.col("cols"), F.col("height") / F.col("rows")
    pad = lambda size, inner: F.when(inner, size * overlap).otherwise(0.0)
    box = {
        "x0": F.greatest(F.lit(0.0), F.col("col") * w - pad(w, F.col("col") > 0)),
        "x1": F.least(F.col("width").cast("double"), (F.col("col") + 1) * w + pad(w, F.col("col") < F.col("cols") - 1)),
        "y0": F.greatest(F.lit(0.0), F.col("row") * h - pad(h, F.col("row") > 0)),
        "y1": F.least(F.col("height").cast("double"), (F.col("row") + 1) * h + pad(h, F.col("row") < F.col("rows") - 1)),
    }
    return grid.withColumns(box).where((F.col("x1") - F.col("x0") > least) & (F.col("y1") - F.col("y0") > least)).select("doc_id", "page_no", "row", "col", *BOX)


def _gridded(boxes: DataFrame, cell: float, p: str = "") -> DataFrame:
    """A row for each cell of a grid that a box touches."""
    span = lambda a, b: F.sequence(F.floor(F.col(f"{p}{a}") / cell), F.floor(F.col(f"{p}{b}") / cell))
    return boxes.withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1")))


def _corner(cell: float, p: str, q: str) -> Column:
    """The cell of the corner that two boxes which meet have in common: one of the cells where they meet."""
    return (F.col("cx") == F.floor(F.greatest(f"{p}x0", f"{q}x0") / cell)) & (F.col("cy") == F.floor(F.greatest(f"{p}y0", f"{q}y0") / cell))


def words_in(words: DataFrame, hits: DataFrame, cell: float = 100.0) -> DataFrame:
    """Words whose box meets a hit rectangle of the page. Both are dealt to the cells of a grid that they touch, so the
    join is on equal keys; a pair that meets in several cells is counted in the cell of its common corner."""
    left = _gridded(words, cell)
    right = _gridded(hits.select("doc_id", "page_no", "hit_id", *(F.col(c).alias(f"h{c}") for c in BOX)), cell, "h")
    meet = (F.col("x0") < F.col("hx1")) & (F.col("hx0") < F.col("x1")) & (F.col("y0") < F.col("hy1")) & (F.col("hy0") < F.col("y1"))
    return left.join(right, ["doc_id", "page_no", "cx", "cy"]).where(_corner(cell, "", "h") & meet).drop("cx", "cy", *(f"h{c}" for c in BOX))


def word_duplicates(words: DataFrame, ratio: float = 0.62, cell: float = 50.0) -> DataFrame:
    """Pairs of words of equal text on a page whose overlap exceeds ``ratio`` of the smaller box; the later one is the copy.
    Equal words meet in a cell of a grid that both touch, so a word that fills a page is not paired with all its likes."""
    a = _gridded(words.select("doc_id", "page_no", "text", F.col("ord").alias("kept"), *(F.col(c).alias(f"a{c}") for c in BOX)), cell, "a")
    b = _gridded(words.select("doc_id", "page_no", "text", F.col("ord").alias("copy"), *(F.col(c).alias(f"b{c}") for c in BOX)), cell, "b")
    over = s.overlap_ratio(tuple(F.col(f"a{c}") for c in BOX), tuple(F.col(f"b{c}") for c in BOX))
    met = a.join(b, ["doc_id", "page_no", "text", "cx", "cy"]).where((F.col("kept") < F.col("copy")) & _corner(cell, "a", "b") & (over > ratio))
    return met.select("doc_id", "page_no", "kept", "copy")


def same_line(words: DataFrame, reach: int = 13) -> DataFrame:
    """Pairs of words at most ``reach`` apart whose centres are within max(3.5, 0.55 of the lower height). A window brings the words
    behind each word, so the words are dealt once and not once for each place they may meet in."""
    behind = Window.partitionBy("doc_id", "page_no").orderBy("ord").rangeBetween(1, reach)
    met = words.select("doc_id", "page_no", "ord", "y0", "y1", F.collect_list(F.struct("ord", F.col("y0").alias("v0"), F.col("y1").alias("v1"))).over(behind).alias("behind"))
    pairs = met.select("doc_id", "page_no", F.col("ord").alias("first"), "y0", "y1", F.explode("behind").alias("b")).select("*", "b.v0", "b.v1")
    near = F.abs((F.col("y0") + F.col("y1")) / 2 - (F.col("v0") + F.col("v1")) / 2) <= F.greatest(F.lit(3.5), 0.55 * F.least(F.col("y1") - F.col("y0"), F.col("v1") - F.col("v0")))
    return pairs.where(near).select("doc_id", "page_no", "first", F.col("b.ord").alias("second"))


def upper_median_height(words: DataFrame) -> DataFrame:
    heights = words.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.col("y1") - F.col("y0"))).alias("h"))
    return heights.select("doc_id", "page_no", F.element_at("h", (F.floor(F.size("h") / 2) + 1).cast("int")).alias("height"))


def rectangles_once(rects: DataFrame) -> DataFrame:
    """One of the rectangles that round to equal points; those under two points wide or high go."""
    at = [F.round(c).cast("long").alias(f"r{c}") for c in BOX]
    big = rects.where("x1 - x0 >= 2 and y1 - y0 >= 2")
    w = Window.partitionBy("doc_id", "page_no", *(F.round(c) for c in BOX)).orderBy("ord")
    return big.withColumn("row_no", F.row_number().over(w)).where("row_no = 1").select("doc_id", "page_no", "ord", *at)


def last_kind_before(words: DataFrame, is_kind, reach: int = 5) -> DataFrame:
    """The nearest earlier word that is a kind, at most ``reach`` words back."""
    w = Window.partitionBy("doc_id", "page_no").orderBy("ord").rowsBetween(-reach, -1)
    return words.withColumn("kind_ord", F.last(F.when(is_kind, F.col("ord")), ignorenulls=True).over(w))


def image_tiles(images: DataFrame, tile: int, overlap: int) -> DataFrame:
    """Overlapping pixel tiles of ``images(doc_id, width, height)``; the last ones end with the image."""
    step = tile - overlap
    starts = lambda size: F.sequence(F.lit(0), F.greatest(F.lit(0), F.col(size) - overlap - 1), F.lit(step))
    grid = images.withColumn("x0", F.explode(starts("width"))).withColumn("y0", F.explode(starts("height")))
    return grid.select("doc_id", "x0", "y0", F.least(F.col("x0") + tile, "width").alias("x1"), F.least(F.col("y0") + tile, "height").alias("y1"))


def strips(labels: DataFrame, height: int) -> DataFrame:
    """Equal horizontal strips of a crop for the lines of its label: doc_id, line_no, y0, y1, line. Comments and lines of one
    character are left out."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) >= 2) & ~F.startswith(x, F.lit("#")))
    own = labels.withColumn("lines", lines).where(F.size("lines") > 0)
    out = own.select("doc_id", F.size("lines").alias("n"), F.posexplode("lines").alias("line_no", "line"))
    return out.select("doc_id", "line_no", F.floor(F.col("line_no") * height / F.col("n")).alias("y0"), F.floor((F.col("line_no") + 1) * height / F.col("n")).alias("y1"), "line")
