"""Readers and writers. Formats that need a library that is not here take the parser as a parameter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.functions import scalar as s

#: Image file types that stand for one-page documents.
IMAGES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp", "gif")
PAGES = "doc_id string, page_no int, text string"


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path), text: one row for each file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def delimited(spark: SparkSession, path: str, tabs: bool = False, encoding: str = "UTF-8", schema: T.StructType | None = None) -> DataFrame:
    """CSV or TSV; without a schema all columns are strings.

    Encodings that Spark's reader does not know, such as cp1251, are decoded file by file, one row a line; all files have one
    header.
    """
    sep = "\t" if tabs else ","
    if encoding.lower() in ("utf-8", "utf-16", "utf-32", "us-ascii", "iso-8859-1"):
        reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("multiLine", True)
        return (reader.schema(schema) if schema else reader).csv(path)

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                head, *rest = bytes(content).decode(encoding).splitlines() or [""]
                yield pd.DataFrame({"head": [head] * len(rest), "line": rest})

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(lines, "head string, line string")
    if schema is None:
        first = rows.select("head").first()
        names = first[0].split(sep) if first else []
        schema = T.StructType([T.StructField(n.strip('"'), T.StringType()) for n in names])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return rows.select(F.from_csv("line", ddl, {"sep": sep}).alias("r")).select("r.*")


def documents(spark: SparkSession, path: str, parse: Callable[[bytes], list[str]], pattern: str = "*") -> DataFrame:
    """Pages of binary files. ``parse`` gives the page texts of one file; a file that it refuses is a page 0 without text."""

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path_, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    texts = parse(bytes(content))
                except ValueError:
                    texts = []
                rows += [(path_, i, t) for i, t in enumerate(texts, 1)] or [(path_, 0, None)]
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInPandas(pages, PAGES)


def images(spark: SparkSession, path: str, read: Callable[[bytes], str]) -> DataFrame:
    """Images as one-page documents; ``read`` is the recogniser."""
    kinds = "*.{" + ",".join(IMAGES + tuple(x.upper() for x in IMAGES)) + "}"
    return documents(spark, path, lambda data: [read(data)], kinds)


def with_headers(pages: DataFrame) -> DataFrame:
    """Pages with text, each under its number."""
    return pages.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("text", F.concat(F.lit("[Страница "), "page_no", F.lit("]\n"), "text"))


def scanned(pages: DataFrame, least: int = 50) -> DataFrame:
    """Documents with less than ``least`` characters of text a page."""
    size = F.avg(F.length(F.trim(F.coalesce("text", F.lit("")))))
    return pages.groupBy("doc_id").agg(size.alias("average"), (size < least).alias("scanned"))


def word_boxes(tsv: DataFrame, scale: float = 1.0, x: float = 0.0, y: float = 0.0) -> DataFrame:
    """Words of a recogniser's table (level, left, top, width, height, text), scaled and moved to page points."""
    words = tsv.where("level = 5 and width > 0 and height > 0").where(F.trim("text") != "")
    return words.select(
        "doc_id", "page_no", "ord", (F.col("left") * scale + x).alias("x0"), (F.col("top") * scale + y).alias("y0"),
        ((F.col("left") + F.col("width")) * scale + x).alias("x1"), ((F.col("top") + F.col("height")) * scale + y).alias("y1"), F.trim("text").alias("text"),
    )


def response_text(body, keys: tuple[str, ...] = ("text", "markdown", "result", "content", "data.text")):
    """The first of several JSON fields that is not empty, else the body itself."""
    return F.coalesce(*(F.nullif(F.get_json_object(body, f"$.{k}"), F.lit("")) for k in keys), body)


def registry_rows(responses: DataFrame) -> DataFrame:
    """Rows of search responses ``[_, rows, …]``: the last of each docid; ``responses(page_no, body)``."""
    row = "array<struct<docid: string, code: string, name: string, activitydate: string, status: string>>"
    rows = responses.select("page_no", F.inline(F.from_json(F.get_json_object("body", "$[1]"), row)))
    return rows.groupBy("docid").agg(F.max_by(F.struct("code", "name", "activitydate", "status"), "page_no").alias("r")).select("docid", "r.*")


def write_manifest(labels: DataFrame, path: str) -> None:
    labels.write.mode("overwrite").json(path)


def write_train_list(labels: DataFrame, path: str) -> None:
    """Image and label by tab; line ends in labels are written as \\n."""
    line = F.concat_ws("\t", "image", F.replace("text", F.lit("\n"), F.lit("\\n")))
    labels.select(line).write.mode("overwrite").text(path)


def write_audit(rows: DataFrame, path: str, most: int = 2000) -> None:
    rows.withColumn("detail", F.left("detail", F.lit(most))).write.mode("append").parquet(path)


def markdown_rows(rows: DataFrame) -> DataFrame:
    """One Markdown table line for each row."""
    cells = [s.escape_cell(F.col(c).cast("string")) for c in rows.columns]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
