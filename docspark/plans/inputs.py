"""Inputs for the registered queries: the tables hold no designations, so they are made from columns by SQL that Spark and
a reference database read alike. Tables stand in braces."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

KIND = "CASE {k} % 4 WHEN 0 THEN 'ГОСТ' WHEN 1 THEN 'СТБ' WHEN 2 THEN 'ТУ' ELSE 'ОСТ' END"
NUMBER = (
    "CASE {k} % 4 WHEN 0 THEN CAST(1000 + {k} % 300 AS STRING) || '-' || CAST(70 + {y} % 25 AS STRING)"
    " WHEN 1 THEN CAST(1000 + {k} % 300 AS STRING) || '-' || CAST(2000 + {y} % 20 AS STRING)"
    " WHEN 2 THEN '14-' || CAST(1 + {k} % 9 AS STRING) || '-' || CAST(100 + {k} % 200 AS STRING) || '-' || CAST(70 + {y} % 25 AS STRING)"
    " ELSE '34 10.' || CAST(100 + {k} % 800 AS STRING) || '-' || CAST(70 + {y} % 25 AS STRING) END"
)


def designation(k: str, y: str) -> str:
    return f"({KIND.format(k=k)}) || ' ' || ({NUMBER.format(k=k, y=y)})"


REFS = f"SELECT CAST(p_partkey AS BIGINT) AS ord, CAST(p_partkey % 50 AS BIGINT) AS doc_id, {KIND.format(k='p_partkey')} AS kind, {designation('p_partkey', 'p_size')} AS ref FROM {{part}}"
#: Page text around a designation, with misread kinds in every third row and dashes for hyphens in every fifth.
SOURCES = (
    "SELECT CAST(p_partkey % 50 AS BIGINT) AS doc_id, CAST(p_partkey AS BIGINT) AS source_ord, 'Лист ' || p_brand || ' по '"
    f" || CASE WHEN p_partkey % 12 = 0 THEN 'GOST ' || ({NUMBER.format(k='p_partkey', y='p_size')}) WHEN p_partkey % 5 = 0 THEN replace({designation('p_partkey', 'p_size')}, '-', '–') ELSE {designation('p_partkey', 'p_size')} END"
    " || ' установить' AS text FROM {part}"
)
#: Readings of one designation by several sources; in every fifth line one digit is misread.
READINGS = (
    "SELECT CAST(l_partkey % 100 AS BIGINT) AS doc_id, CAST(l_linenumber AS BIGINT) AS source_ord, CAST(1 + l_orderkey % 7 AS BIGINT) AS page_no, 'ГОСТ' AS kind,"
    " 'ГОСТ ' || CAST(1000 + l_partkey % 500 + CASE WHEN l_linenumber % 5 = 0 THEN 1 ELSE 0 END AS STRING) || '-' || CAST(70 + l_suppkey % 3 AS STRING) AS ref FROM {lineitem}"
)
REGISTRY = f"SELECT CAST(p_partkey AS BIGINT) AS row_ord, {designation('p_partkey', 'p_size')} AS code, 'Стандарт ' || p_name AS name FROM {{part}} WHERE p_partkey % 2 = 0"
DATES = (
    "SELECT CAST(o_orderkey AS BIGINT) AS ord, CAST(o_orderdate AS DATE) AS intro,"
    " CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 4000 AS INT) END AS cancel, CASE WHEN o_orderkey % 7 = 0 THEN '0' ELSE '1' END AS flag FROM {orders}"
)
MESSAGES = "SELECT conv_id, turn, CASE WHEN turn % 6 = 3 AND conv_id % 3 = 0 THEN 'summary' ELSE role END AS role, text FROM {conversations}"
BOXES = (
    "SELECT CAST(l_orderkey AS BIGINT) AS doc_id, CAST(1 AS BIGINT) AS page_no, CAST(l_linenumber AS BIGINT) AS ord, CAST(l_partkey % 300 AS DOUBLE) AS x0, CAST(l_linenumber * 2 AS DOUBLE) AS y0,"
    " CAST(l_partkey % 300 + l_quantity AS DOUBLE) AS x1, CAST(l_linenumber * 2 + 5 AS DOUBLE) AS y1, l_returnflag AS text FROM {lineitem}"
)
LABELS = (
    "SELECT CAST(doc_id AS STRING) || '.txt' AS file, CASE WHEN doc_id % 5 = 0 THEN 'S.' || CAST(doc_id - doc_id % 2 AS STRING) ELSE 'S' || CAST(doc_id - doc_id % 2 AS STRING) END AS stem,"
    " CASE WHEN doc_id % 2 = 0 THEN 'stamp_frame' ELSE 'stamp_block' END AS zone, text FROM {documents}"
)
CROPS = "SELECT DISTINCT 'S' || CAST(p_partkey AS STRING) AS stem FROM {part} WHERE p_partkey % 3 > 0"


#: Tables of few bytes a row, by their keys, and the rows of a task: as a file is read by a task for each of its row groups at best, a
#: million rows of a few MB would be one task, whatever is then done with their texts.
KEYS = {"part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "customer": "c_custkey", "supplier": "s_suppkey"}
ROWS_OF_A_TASK, FEWEST_ROWS = 50_000, 2_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to tasks in proportion to its rows, at least three for each core if they get 2,000 rows each."""
    rows = df.count()
    tasks = max(math.ceil(rows / ROWS_OF_A_TASK), min(3 * df.sparkSession.sparkContext.defaultParallelism, rows // FEWEST_ROWS))
    return df.repartition(tasks, *keys) if tasks > 1 else df


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of ``sql``; tables in braces are read from the folder, narrow ones are dealt to all tasks."""
    names = {name for name in ("part", "lineitem", "orders", "conversations", "documents", "customer", "supplier", "pages", "labels", "events") if f"{{{name}}}" in sql}
    read = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names}
    return spark.sql(sql, **{name: spread(df, KEYS[name]) if name in KEYS else df for name, df in read.items()})


def plain(sql: str) -> str:
    """``sql`` with plain table names."""
    return sql.replace("{", "").replace("}", "")
