"""The queries of the training-data operators, and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import language_id, toxicity
from llm.byte_bpe import token_digests
from llm.collocations import collocations
from llm.common import table
from llm.greedy_tiling import contaminations
from llm.jaccard_join import jaccard_groups
from llm.mixing import copies
from llm.periodic_runs import run_digests
from llm.quality_classifier import quality_scores
from llm.quality_rules import quality_rules
from llm.substring_dedup import substring_dedup
from llm.token_files import token_files
from llm.url_filter import url_verdicts


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))


def _fold(folds: int, held: int):
    """Whether a document belongs to the fold that is held out; a null doc_id belongs to none."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held, F.lit(False))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~_fold(4, 2)))
    out = toxicity.toxicity(docs, machine)
    return out.select("doc_id", _fold(4, 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = language_id.fit(docs.where(~_fold(3, 1)))
    return language_id.languages(docs, network).select("doc_id", _fold(3, 1).alias("held_out"), "lang_pred", "score")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tkey")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(table(spark, sf_dir, "documents"))


def _looped(docs: DataFrame) -> DataFrame:
    """A tenth of the documents, by the checksum of their id, turn periodic from some word on."""
    checksum = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(checksum / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    split = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("words", F.when(checksum % 10 == 0, words))
    n = F.size("words")
    at = g % F.greatest(n, F.lit(1))
    period = 1 + F.floor((n - at) / (3 + g % 8))
    tail = F.flatten(F.array_repeat(F.slice("words", (at + 1).cast("int"), period.cast("int")), F.ceil((n - at) / period).cast("int")))
    whole = F.slice(F.concat(F.slice("words", F.lit(1), at.cast("int")), tail), F.lit(1), n)
    return split.select("doc_id", F.when(n > 0, F.array_join(whole, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(_looped(table(spark, sf_dir, "documents")))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_url_filter": op2_url_filter,
    "op3_toxicity": op3_toxicity,
    "op4_language_id": op4_language_id,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_files": op10_token_files,
    "op11_source_mix": op11_source_mix,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_phrase_collocations": op13_phrase_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE text IS NOT NULL),
i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS node FROM documents UNION SELECT r.doc_id, ways.b FROM r JOIN ways ON ways.a = r.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.least AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(node) AS least FROM r GROUP BY 1) r USING (doc_id)""",
    "op6_substring_dedup": r"""
WITH l AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM l),
v AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 34 <= len(ws) THEN md5(array_to_string(ws[i:i + 34], ' ')) END AS win FROM i),
f AS (SELECT doc_id, i, word, win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 AS again FROM v),
g AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM f),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN k USING (doc_id)""",
    "op11_source_mix": r"""
WITH d AS (SELECT doc_id, source, coalesce('=' || source, '') AS key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
g AS (SELECT source, key, sum(size)::BIGINT AS source_size FROM d GROUP BY 1, 2),
s AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight, row_number() OVER (ORDER BY source IS NULL, source) AS nth FROM g),
b AS (SELECT *, coalesce(sum(3 * source_size) OVER o, 0)::DOUBLE AS full_before, coalesce(sum(weight) OVER o, 0)::DOUBLE AS weight_before FROM s
      WINDOW o AS (ORDER BY 3 * source_size / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max(((SELECT sum(source_size) FROM s)::DOUBLE - full_before) / ((SELECT sum(weight) FROM s)::DOUBLE - weight_before)) AS level FROM b),
t AS (SELECT key, source_size, least((3 * source_size)::DOUBLE, level * weight) AS target, ('0x' || left(md5('mix-1|' || key), 8))::BIGINT % 1000000 * 1000000 AS offs FROM s, l),
e AS (SELECT d.*, source_size, target, offs, CASE WHEN source_size > 0 THEN floor(least(3.0::DOUBLE, target / source_size) * 1e12::DOUBLE)::HUGEINT ELSE 0::HUGEINT END AS e,
      ('0x' || left(md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null')), 8))::BIGINT AS dealt FROM d JOIN t USING (key)),
p AS (SELECT *, offs + coalesce(sum(e) OVER (PARTITION BY key ORDER BY dealt % 2, CASE WHEN dealt % 2 = 0 THEN size ELSE -size END, dealt, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS spot FROM e),
c AS (SELECT *, ((spot + e) // 1000000000000 - spot // 1000000000000)::BIGINT AS copies FROM p)
SELECT doc_id, size, source_size, target, copies, (copies * size)::BIGINT AS taken FROM c""",
    "op13_phrase_collocations": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p),
n AS (SELECT lang, count(*) AS n FROM i GROUP BY 1),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM i, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(ws) GROUP BY 1, 2, 3 HAVING count(*) >= 100),
c AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS ws FROM g WHERE k >= 2),
x AS (SELECT c.*, unnest(range(1, k)) AS at_word FROM c),
s AS (SELECT x.lang, x.phrase, x.a, at_word, u.a AS l, v.a AS r, n.n, 1000::HUGEINT * x.a::HUGEINT * n.n::HUGEINT // (u.a::HUGEINT * v.a::HUGEINT) AS score
      FROM x JOIN n ON n.lang = x.lang JOIN g u ON u.lang = x.lang AND u.phrase = array_to_string(ws[1:at_word], ' ') JOIN g v ON v.lang = x.lang AND v.phrase = array_to_string(ws[at_word + 1:], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, at_word) AS nth FROM s),
j AS (SELECT lang, ws, k, a, unnest(range(2, k)) AS m FROM c WHERE k >= 3),
y AS (SELECT lang, ws, a, m, unnest(range(1, k - m + 2)) AS f FROM j),
h AS (SELECT lang, array_to_string(ws[f:f + m - 1], ' ') AS phrase, max(a) AS longer FROM y GROUP BY 1, 2),
r AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank FROM b LEFT JOIN h ON h.lang = b.lang AND h.phrase = b.phrase WHERE nth = 1 AND NOT coalesce(100 * longer >= 100 * b.a, false))
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM r WHERE rank <= 2000""",
}
