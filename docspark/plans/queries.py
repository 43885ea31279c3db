"""The registered queries, one for each operator, and independent SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import grammar as g
from docspark.functions import scalar as s
from docspark.functions import sheet
from docspark.operators import dataset, extract, history, layout, registry, report, resolve, sections, tables
from docspark.plans import inputs as i
from docspark.plans import pipelines
from docspark.plans.settle import settled
from docspark.streaming import messages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TODAY = "1996-06-01"


def query(sql: str | None = None):
    """Register the decorated function; ``sql`` may name the inputs as <REFS> and the like."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            text = sql
            for name in ("REFS", "SOURCES", "READINGS", "REGISTRY", "DATES", "MESSAGES", "BOXES", "LABELS", "CROPS"):
                text = text.replace(f"<{name}>", f"({i.plain(getattr(i, name))})")
            ORACLE_SQL[f.__name__] = text
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")



def K():  # noqa: N802
    return F.col("kind")


def R():  # noqa: N802
    return F.col("ref")


_DIGITS = "regexp_replace(split_part(ref, ' ', 1) || regexp_replace(ref, '^\\S+ ', ''), '\\D', '', 'g')"
_BODY = "regexp_replace(regexp_replace(regexp_replace(ref, '^\\S+ ', ''), '-\\d{2,4}$', ''), '\\D', '', 'g')"
_YEAR = "regexp_extract(ref, '-(\\d{2,4})$', 1)"

# ---------------------------------------------------------------- extraction and grammar


@query(f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY source_ord) AS ord, kind, ref, lower(kind) || ':' || {_DIGITS} AS canon_key FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(kind) || ':' || {_DIGITS} ORDER BY source_ord) AS n FROM (SELECT p_partkey AS source_ord, p_partkey % 50 AS doc_id, {i.KIND.format(k='p_partkey')} AS kind, {i.designation('p_partkey', 'p_size')} AS ref FROM part)) WHERE n = 1")
def extract_refs(spark, sf):
    return extract.references(i.frame(spark, sf, i.SOURCES)).select("doc_id", F.col("ord").cast("long").alias("ord"), "kind", "ref", "canon_key")


@query(f"SELECT ord, lower(kind) || ':' || {_DIGITS} AS canon_key, lower(kind) || ':' || {_BODY} AS base_key, {_BODY} AS body, {_YEAR} AS year FROM <REFS>")
def canonical_keys(spark, sf):
    return i.frame(spark, sf, i.REFS).select("ord", g.canonical_key(K(), R()).alias("canon_key"), g.base_key(K(), R()).alias("base_key"), g.body_of(R()).alias("body"), g.year_of(R()).alias("year"))


@query("SELECT ord, regexp_replace(ref, '^\\S+ ', '') AS clipped, true AS complete FROM <REFS>")
def clip_and_complete(spark, sf):
    raw = F.concat(F.regexp_replace(R(), r"^\S+ ", ""), F.lit(" установить по месту"))
    df = i.frame(spark, sf, i.REFS).withColumn("clipped", g.clip_number(raw, K()))
    return df.select("ord", "clipped", g.number_complete(F.col("clipped"), K()).alias("complete"))


@query("SELECT CAST(p_partkey AS BIGINT) AS ord, CAST(1000 + p_partkey % 9000 AS STRING) || '-' || CAST(70 + p_size % 25 AS STRING) AS gost, CAST(1000 + p_partkey % 9000 AS STRING) || '-2010' AS stb, '34 10.' || CAST(100 + p_partkey % 900 AS STRING) || '-97' AS ost, '34.17.' || CAST(100 + p_partkey % 900 AS STRING) AS stp, '45-3.02-' || CAST(1 + p_partkey % 90 AS STRING) || '-2005' AS tkp FROM part")
def format_numbers(spark, sf):
    text = "SELECT CAST(p_partkey AS BIGINT) AS ord, CAST(1000 + p_partkey % 9000 AS STRING) AS n, CAST(100 + p_partkey % 900 AS STRING) AS m, CAST(1 + p_partkey % 90 AS STRING) AS k, CAST(70 + p_size % 25 AS STRING) AS y FROM {part}"
    n, m, k, y = map(F.col, "nmky")
    gost = F.concat(F.left(n, F.lit(2)), F.lit("."), F.right(n, F.lit(2)), F.lit("-"), y)
    return i.frame(spark, sf, text).select("ord", g.format_gost(gost).alias("gost"), g.format_stb(F.concat(n, F.lit(" 2010"))).alias("stb"), g.format_ost(F.concat(F.lit("34 10 . "), m, F.lit("-97"))).alias("ost"), g.format_stp(F.concat(F.lit("34 17 "), m)).alias("stp"), g.format_tkp(F.concat(F.lit("+5 - 3 . 02 - "), k, F.lit(" - 2005"))).alias("tkp"))


@query("SELECT CAST(p_partkey AS BIGINT) AS ord, CASE p_partkey % 6 WHEN 0 THEN 'ГОСТ' WHEN 1 THEN 'СНиП' WHEN 2 THEN 'ОСТ' WHEN 3 THEN 'НРР' WHEN 4 THEN 'ISO' ELSE 'неизв' END AS kind FROM part")
def kind_labels(spark, sf):
    raw = "SELECT CAST(p_partkey AS BIGINT) AS ord, CASE p_partkey % 6 WHEN 0 THEN ' gost ' WHEN 1 THEN 'Сн и П' WHEN 2 THEN 'OCT' WHEN 3 THEN 'HRR' WHEN 4 THEN 'iso' ELSE ' неизв ' END AS raw FROM {part}"
    return i.frame(spark, sf, raw).select("ord", g.kind_label(F.col("raw")).alias("kind"))


@query("SELECT ord, body, year FROM (SELECT ord, d, CASE WHEN length(d) >= 6 AND CAST(right(d, 4) AS INT) BETWEEN 1900 AND 2039 THEN left(d, length(d) - 4) ELSE left(d, length(d) - 2) END AS body, CASE WHEN length(d) >= 6 AND CAST(right(d, 4) AS INT) BETWEEN 1900 AND 2039 THEN right(d, 4) ELSE right(d, 2) END AS year FROM (SELECT ord, regexp_replace(ref, '\\D', '', 'g') AS d FROM <REFS>))")
def body_year_split(spark, sf):
    body, year = g.split_year(g.digits(R()))
    return i.frame(spark, sf, i.REFS).select("ord", body.alias("body"), year.alias("year"))


_SPANS = "SELECT CAST(l_orderkey AS BIGINT) AS doc_id, CAST(1 AS BIGINT) AS source_ord, CAST(l_linenumber AS BIGINT) AS ord, CAST(l_partkey % 40 AS BIGINT) AS start, CAST(l_partkey % 40 + l_quantity AS BIGINT) AS stop FROM {lineitem}"


@query(f"SELECT a.doc_id, a.ord, a.start, a.stop FROM ({i.plain(_SPANS)}) a WHERE NOT EXISTS (SELECT 1 FROM ({i.plain(_SPANS)}) b WHERE b.doc_id = a.doc_id AND b.start <= a.start AND b.stop >= a.stop AND (b.start < a.start OR b.stop > a.stop))")
def span_containment(spark, sf):
    return extract.outermost(i.frame(spark, sf, _SPANS)).select("doc_id", "ord", "start", "stop")


@query("SELECT doc_id, ref, min(ord) AS ord FROM <REFS> GROUP BY 1, 2")
def first_wins_dedupe(spark, sf):
    return extract.first_of(i.frame(spark, sf, i.REFS), ["doc_id", "ref"], ["ord"]).select("doc_id", "ref", "ord")


@query("SELECT ord, lower(replace(ref, ' ', '')) AS code, CASE WHEN kind = 'ОСТ' THEN 1 ELSE 0 END AS dots, CASE WHEN kind = 'ГОСТ' THEN 1 ELSE 0 END AS quality, true AS one FROM <REFS>")
def rank_parts(spark, sf):
    return i.frame(spark, sf, i.REFS).select("ord", g.norm_code(R()).alias("code"), g.dot_score(K(), R()).alias("dots"), g.gost_quality(R()).alias("quality"), g.one_kind(R()).alias("one"))


# ---------------------------------------------------------------- resolution


@query("SELECT doc_id, kind, ref, count(DISTINCT source_ord) AS votes, min(source_ord) AS first_source FROM <READINGS> GROUP BY 1, 2, 3")
def source_votes(spark, sf):
    return resolve.source_votes(i.frame(spark, sf, i.READINGS))


@query(f"SELECT doc_id, 'гост:' || {_DIGITS} AS canon_key, kind, ref, count(DISTINCT source_ord) AS votes FROM <READINGS> GROUP BY ALL")
def best_spelling(spark, sf):
    loose = i.frame(spark, sf, i.READINGS).withColumn("ref", F.when(F.col("source_ord") == 2, F.replace(R(), F.lit("-"), F.lit(" -"))).otherwise(R()))
    votes = resolve.source_votes(loose.withColumn("ref", F.concat_ws(" ", K(), g.format_number(g.number_of(R()), K()))))
    return resolve.best_spelling(votes)


@query(
    f"""WITH v AS (SELECT doc_id, kind, ref, count(DISTINCT source_ord) AS votes, 'гост:' || {_BODY} AS base, {_YEAR} AS year FROM <READINGS> GROUP BY ALL)
    SELECT * FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE b.doc_id = a.doc_id AND b.base = a.base AND b.year <> a.year AND abs(CAST(a.year AS INT) - CAST(b.year AS INT)) <= 1 AND (b.votes > a.votes OR (b.votes = a.votes AND b.year < a.year)))"""
)
def year_variants(spark, sf):
    return resolve.year_variants(resolve.source_votes(i.frame(spark, sf, i.READINGS)))


@query(
    f"""WITH v AS (SELECT doc_id, kind, ref, count(DISTINCT source_ord) AS votes, {_BODY} AS body, {_YEAR} AS year FROM <READINGS> GROUP BY ALL)
    SELECT a.doc_id, a.kind, a.ref AS ref_a, b.ref AS ref_b, CASE WHEN a.votes > b.votes THEN b.ref WHEN b.votes > a.votes THEN a.ref END AS loser FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.year = b.year AND a.ref < b.ref AND hamming(a.body, b.body) = 1"""
)
def number_conflicts(spark, sf):
    return resolve.number_conflicts(resolve.source_votes(i.frame(spark, sf, i.READINGS)))


@query(
    f"""WITH v AS (SELECT doc_id, kind, ref, count(DISTINCT source_ord) AS votes, min(source_ord) AS first_source, {_BODY} AS body, {_YEAR} AS year FROM <READINGS> GROUP BY ALL),
    lost AS (SELECT a.doc_id, CASE WHEN a.votes > b.votes THEN b.ref ELSE a.ref END AS ref FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.year = b.year AND a.ref < b.ref AND hamming(a.body, b.body) = 1 WHERE a.votes <> b.votes)
    SELECT doc_id, kind, ref, votes, first_source FROM v ANTI JOIN lost USING (doc_id, ref)"""
)
def resolve_conflicts(spark, sf):
    return resolve.without_conflicts(resolve.source_votes(i.frame(spark, sf, i.READINGS)))


@query(
    f"""WITH v AS (SELECT doc_id, kind, ref, count(DISTINCT source_ord) AS votes, {_BODY} AS body FROM <READINGS> GROUP BY ALL)
    SELECT doc_id, kind, ref, first_value(ref) OVER (PARTITION BY doc_id, body ORDER BY votes DESC, ref DESC) AS repaired FROM v"""
)
def repair_by_body(spark, sf):
    return resolve.repair_by_body(resolve.source_votes(i.frame(spark, sf, i.READINGS)))


@query(f"SELECT doc_id, ref, count(*) OVER (PARTITION BY doc_id, left({_BODY}, 6)) AS support FROM <REFS> WHERE kind = 'ОСТ'")
def family_support(spark, sf):
    return resolve.family_support(i.frame(spark, sf, i.REFS)).select("doc_id", "ref", "support")


@query(
    f"""WITH r AS (SELECT doc_id, ref, {_BODY} AS body FROM <REFS> WHERE kind = 'ОСТ'), f AS (SELECT *, count(*) OVER (PARTITION BY doc_id, left(body, 6)) AS support FROM r)
    SELECT doc_id, ref, body, support FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE a.doc_id = b.doc_id AND b.support > a.support AND length(a.body) = length(b.body) AND hamming(a.body, b.body) = 1)"""
)
def one_digit_swaps(spark, sf):
    return resolve.one_digit_swaps(i.frame(spark, sf, i.REFS))


@query("SELECT doc_id, ord, kind, ref FROM <REFS> r WHERE doc_id % 2 = 1 OR ord % 3 = 0 OR EXISTS (SELECT 1 FROM <REFS> t WHERE t.ord % 3 = 0 AND t.doc_id = r.doc_id AND t.ref = r.ref)")
def prune_unconfirmed(spark, sf):
    refs = i.frame(spark, sf, i.REFS)
    return resolve.confirmed(refs, refs.where("doc_id % 2 = 0 and ord % 3 = 0")).select("doc_id", "ord", "kind", "ref")


@query(
    """WITH r AS (SELECT doc_id, kind, ref, ord FROM <REFS>), own AS (SELECT doc_id, kind, ref FROM r WHERE ord % 2 = 0)
    SELECT * FROM own UNION ALL (SELECT DISTINCT doc_id, kind, ref FROM r WHERE ord % 2 = 1 AND NOT EXISTS (SELECT 1 FROM own WHERE own.doc_id = r.doc_id AND own.ref = r.ref))"""
)
def merge_supplement(spark, sf):
    refs = i.frame(spark, sf, i.REFS)
    return resolve.supplemented(refs.where("ord % 2 = 0"), refs.where("ord % 2 = 1")).select("doc_id", "kind", "ref")


# ---------------------------------------------------------------- registries


@query(
    """WITH n AS (SELECT ord, kind, ref, CASE WHEN kind = 'ОСТ' THEN regexp_replace(ref, '^\\S+ ', '') ELSE regexp_replace(ref, '^\\S+ ', '') END AS num FROM <REFS>)
    SELECT ord, ref AS full_query, num AS number, replace(replace(num, ' ', ''), '-', '.') AS dotted FROM n"""
)
def query_variants(spark, sf):
    v = g.query_variants(K(), R())
    df = i.frame(spark, sf, i.REFS).withColumn("v", v)
    dotted = F.replace(F.replace(F.regexp_replace(R(), r"^\S+ ", ""), F.lit(" "), F.lit("")), F.lit("-"), F.lit("."))
    return df.select("ord", F.col("v")[0].alias("full_query"), F.col("v")[1].alias("number"), F.when(F.array_contains("v", dotted), dotted).alias("dotted"))


@query(
    """WITH n AS (SELECT DISTINCT CAST(1000 + p_partkey % 300 AS STRING) AS num FROM part), p AS (SELECT num, unnest(range(1, length(num) + 1)) AS i FROM n),
    s(a, b) AS (VALUES ('2','9'), ('9','2'), ('6','8'), ('8','6'), ('0','6'), ('5','6'), ('1','7'), ('3','8'))
    SELECT DISTINCT num, left(num, i - 1) || b || substr(num, i + 1) AS variant FROM p JOIN s ON substr(num, i, 1) = a"""
)
def ocr_digit_variants(spark, sf):
    df = i.frame(spark, sf, "SELECT DISTINCT CAST(1000 + p_partkey % 300 AS STRING) AS num FROM {part}")
    return df.select("num", F.explode(g.digit_variants(F.col("num"), 50)).alias("variant"))


_MATCH = f"""WITH q AS (SELECT DISTINCT kind, ref FROM <REFS>), r AS (SELECT * FROM <REGISTRY>),
    d AS (SELECT *, lower(replace(ref, ' ', '')) AS target, regexp_replace(ref, '\\D', '', 'g') AS run FROM q),
    c AS (SELECT *, lower(replace(code, ' ', '')) AS code_n, regexp_replace(code, '\\D', '', 'g') AS row_run FROM r),
    b AS (SELECT *, CASE WHEN length(run) >= 6 AND CAST(right(run, 4) AS INT) BETWEEN 1900 AND 2039 THEN 4 ELSE 2 END AS n FROM d),
    e AS (SELECT *, CASE WHEN length(row_run) >= 6 AND CAST(right(row_run, 4) AS INT) BETWEEN 1900 AND 2039 THEN 4 ELSE 2 END AS m FROM c),
    m AS (SELECT kind, ref, row_ord, code, CASE WHEN code_n = target THEN {{exact}} WHEN contains(code_n, target) THEN {{inside}} {{same}} ELSE {{near}} END AS score FROM b JOIN e ON (run = row_run OR contains(code_n, target)
      OR (right(run, n) = right(row_run, m) AND length(run) - n = length(row_run) - m AND hamming(left(run, length(run) - n), left(row_run, length(row_run) - m)) <= 1)))
    SELECT kind, ref, row_ord, code, CAST(score AS INT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY kind, ref ORDER BY score DESC, row_ord) AS k FROM m) WHERE k = 1 AND score >= {{least}}"""


@query(_MATCH.format(exact=120, inside=105, same="", near=95, least=35))
def registry_match_a(spark, sf):
    out = registry.match_a(i.frame(spark, sf, i.REFS), i.frame(spark, sf, i.REGISTRY))
    return out.select("kind", "ref", "row_ord", "code", "score")


@query(_MATCH.format(exact=100, inside=80, same="WHEN run = row_run AND contains(code_n, lower(kind)) THEN 100 WHEN contains(target, code_n) THEN 80 WHEN contains(row_run, run) THEN 60", near=0, least=20))
def registry_match_b(spark, sf):
    out = registry.match_b(i.frame(spark, sf, i.REFS), i.frame(spark, sf, i.REGISTRY))
    return out.select("kind", "ref", "row_ord", "code", "score")


@query(
    """WITH c AS (SELECT p_partkey AS ord, CAST(300000 + p_partkey AS STRING) AS a, CAST(301000 + p_partkey - p_partkey % 50 AS STRING) AS b FROM part),
    y AS (SELECT *, CASE WHEN CAST(right(a, 4) AS INT) BETWEEN 1900 AND 2039 THEN 4 ELSE 2 END AS n, CASE WHEN CAST(right(b, 4) AS INT) BETWEEN 1900 AND 2039 THEN 4 ELSE 2 END AS m FROM c)
    SELECT ord, a, b, true AS same FROM y WHERE a = b OR (right(a, n) = right(b, m) AND CASE WHEN length(a) - n = length(b) - m THEN hamming(left(a, length(a) - n), left(b, length(b) - m)) <= 1 ELSE false END)"""
)
def digits_compatible(spark, sf):
    df = i.frame(spark, sf, "SELECT p_partkey AS ord, CAST(300000 + p_partkey AS STRING) AS a, CAST(301000 + p_partkey - p_partkey % 50 AS STRING) AS b FROM {part}")
    return df.withColumn("same", g.digits_compatible(F.col("a"), F.col("b"))).where("same").select("ord", "a", "b", "same")


@query(
    f"""SELECT ord, CASE WHEN DATE '{TODAY}' < intro THEN 'не введён' WHEN DATE '{TODAY}' >= cancel THEN 'отменён' ELSE 'актуален' END AS status_a,
    CASE WHEN flag = '0' AND cancel IS NULL THEN 'отменён' WHEN DATE '{TODAY}' < intro THEN 'не введён' WHEN DATE '{TODAY}' >= cancel THEN 'отменён' ELSE 'актуален' END AS status_b FROM <DATES>"""
)
def validity_status(spark, sf):
    today = F.lit(TODAY).cast("date")
    return i.frame(spark, sf, i.DATES).select("ord", s.validity(F.col("intro"), F.col("cancel"), today).alias("status_a"), s.validity_b(F.col("intro"), F.col("cancel"), F.col("flag"), today).alias("status_b"))


@query(
    f"""WITH s AS (SELECT ord, ord % 5 > 0 AS fa, ord % 4 > 0 AS fb, CASE WHEN DATE '{TODAY}' < intro THEN 'не введён' WHEN DATE '{TODAY}' >= cancel THEN 'отменён' ELSE 'актуален' END AS a,
    CASE WHEN flag = '0' AND cancel IS NULL THEN 'отменён' WHEN DATE '{TODAY}' < intro THEN 'не введён' WHEN DATE '{TODAY}' >= cancel THEN 'отменён' ELSE 'актуален' END AS b FROM <DATES>)
    SELECT status, count(*) AS n FROM (SELECT CASE WHEN fa AND fb AND a = b AND a IN ('актуален', 'отменён') THEN a ELSE 'проверка вручную' END AS status FROM s) GROUP BY 1"""
)
def consensus_status(spark, sf):
    today = F.lit(TODAY).cast("date")
    a, b = s.validity(F.col("intro"), F.col("cancel"), today), s.validity_b(F.col("intro"), F.col("cancel"), F.col("flag"), today)
    return i.frame(spark, sf, i.DATES).groupBy(s.consensus(F.col("ord") % 5 > 0, a, F.col("ord") % 4 > 0, b).alias("status")).agg(F.count("*").alias("n"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS ord, strftime(o_orderdate, '%Y-%m-%d') AS dotted, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders")
def parse_dates(spark, sf):
    df = table(spark, sf, "orders")
    dotted = F.concat(F.lit("введён "), F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" г."))
    iso = F.when(F.col("o_orderkey") % 3 == 0, F.lit("2021-13-45 нет")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss.SSS"))
    return df.select(F.col("o_orderkey").alias("ord"), s.dotted_date(dotted).cast("string").alias("dotted"), s.registry_date(iso).cast("string").alias("iso"))


@query("SELECT row_ord, designation FROM (SELECT p_partkey AS row_ord, CASE WHEN p_partkey % 4 = 0 THEN p_type ELSE p_brand || ' ' || p_name END AS designation FROM part)")
def registry_designation(spark, sf):
    df = table(spark, sf, "part")
    gone = F.col("p_partkey") % 4 == 0
    return df.select(F.col("p_partkey").alias("row_ord"), registry.designation_b(F.when(~gone, F.col("p_brand")), F.when(~gone, F.concat(F.lit(" "), "p_name")), F.lit(""), F.col("p_type")).alias("designation"))


@query(
    """WITH q AS (SELECT DISTINCT kind, ref FROM <REFS> WHERE kind = 'ГОСТ'), r AS (SELECT * FROM <REGISTRY> WHERE row_ord % 3 > 0),
    p AS (SELECT kind, ref, regexp_replace(ref, '^\\S+ ', '') AS num FROM q WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.code = q.ref)), x AS (SELECT *, unnest(range(1, length(num) + 1)) AS i FROM p),
    s(k, a, b) AS (VALUES (1,'2','9'), (2,'9','2'), (3,'6','8'), (4,'8','6'), (5,'0','6'), (6,'5','6'), (7,'1','7'), (8,'3','8')),
    v AS (SELECT kind, ref, left(num, i - 1) || b || substr(num, i + 1) AS num, i * 10 + k AS step FROM x JOIN s ON substr(num, i, 1) = a)
    SELECT kind, ref, num, row_ord, code FROM (SELECT v.*, r.row_ord, r.code, row_number() OVER (PARTITION BY kind, ref ORDER BY step, row_ord) AS n FROM v JOIN r ON r.code = kind || ' ' || num) WHERE n = 1"""
)
def registry_retry(spark, sf):
    refs, reg = i.frame(spark, sf, i.REFS).where("kind = 'ГОСТ'"), i.frame(spark, sf, i.REGISTRY).where("row_ord % 3 > 0")
    exact = refs.select("kind", "ref").distinct().join(reg.select(F.col("code").alias("ref")), "ref", "left_semi")
    return registry.retry_missing(refs, exact, reg, 100)


# ---------------------------------------------------------------- report


@query(
    """WITH r AS (SELECT * FROM <REFS>), a AS (SELECT ref, max_by(found, ord) AS found, max_by(status, ord) AS status FROM (SELECT ord, ref, ord % 3 > 0 AS found, CASE WHEN ord % 2 = 0 THEN 'актуален' ELSE 'отменён' END AS status FROM r WHERE ord % 5 > 0) GROUP BY 1),
    b AS (SELECT ref, max_by(found, ord) AS found, max_by(status, ord) AS status FROM (SELECT ord, ref, ord % 4 > 0 AS found, CASE WHEN ord % 3 = 0 THEN 'отменён' ELSE 'актуален' END AS status FROM r) GROUP BY 1)
    SELECT r.doc_id, r.ord, r.kind, r.ref, coalesce(a.found, false) AS found_a, coalesce(b.found, false) AS found_b, CASE WHEN coalesce(a.found AND b.found AND a.status = b.status, false) THEN a.status ELSE 'проверка вручную' END AS status FROM r LEFT JOIN a USING (ref) LEFT JOIN b USING (ref)"""
)
def report_join(spark, sf):
    refs = i.frame(spark, sf, i.REFS)
    a = refs.where("ord % 5 > 0").selectExpr("ord", "ref", "ord % 3 > 0 as found", "case when ord % 2 = 0 then 'актуален' else 'отменён' end as status")
    b = refs.selectExpr("ord", "upper(replace(ref, '-', '–')) as ref", "ord % 4 > 0 as found", "case when ord % 3 = 0 then 'отменён' else 'актуален' end as status")
    return report.joined_report(refs, a, b)


@query("SELECT doc_id, ref, list_aggregate(list_sort(list(DISTINCT page_no)), 'string_agg', ',') AS pages FROM <READINGS> GROUP BY 1, 2")
def ref_pages(spark, sf):
    return report.pages_of(i.frame(spark, sf, i.READINGS)).select("doc_id", "ref", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


@query("SELECT doc_id, count(*) AS total, count(*) FILTER (ord % 3 > 0) AS found_a, count(*) FILTER (ord % 4 > 0) AS found_b, count(*) FILTER (ord % 2 = 0) AS active, bool_and(ord % 12 = 0) AS none_found FROM <REFS> GROUP BY 1")
def report_summary(spark, sf):
    rows = i.frame(spark, sf, i.REFS).selectExpr("doc_id", "ord % 3 > 0 as found_a", "ord % 4 > 0 as found_b", "case when ord % 2 = 0 then 'актуален' else 'отменён' end as status")
    return report.summary(rows)


# ---------------------------------------------------------------- history

_TOKENS = "greatest(1, length(text) // 3)"


@query("SELECT m.conv_id, m.turn, m.role, m.text, a.name FROM <MESSAGES> m LEFT JOIN (SELECT conv_id, turn, 'file' || CAST(turn AS STRING) AS name FROM conversations WHERE turn % 4 = 0) a USING (conv_id, turn)")
def history_join(spark, sf):
    att = i.frame(spark, sf, "SELECT conv_id, turn, 'file' || CAST(turn AS STRING) AS name FROM {conversations} WHERE turn % 4 = 0")
    return history.with_attachments(i.frame(spark, sf, i.MESSAGES), att).select("conv_id", "turn", "role", "text", "name")


@query("WITH m AS (SELECT * FROM <MESSAGES>), s AS (SELECT conv_id, max(turn) AS since FROM m WHERE role = 'summary' GROUP BY 1) SELECT m.conv_id, m.turn, m.role, m.text FROM m LEFT JOIN s USING (conv_id) WHERE role <> 'summary' AND (since IS NULL OR turn > since)")
def history_after_summary(spark, sf):
    return history.after_summary(i.frame(spark, sf, i.MESSAGES)).select("conv_id", "turn", "role", "text")


@query("SELECT conv_id, max_by(text, turn) AS text, max(turn) AS turn FROM <MESSAGES> WHERE role = 'summary' GROUP BY 1")
def latest_summary(spark, sf):
    return history.latest_summary(i.frame(spark, sf, i.MESSAGES))


@query(f"SELECT conv_id, CAST(sum({_TOKENS}) AS BIGINT) AS tokens, count(*) FILTER (role = 'user') AS user_messages FROM <MESSAGES> WHERE role <> 'summary' GROUP BY 1")
def token_sums(spark, sf):
    return history.token_sums(i.frame(spark, sf, i.MESSAGES))


@query(f"SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM (SELECT *, sum({_TOKENS}) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM <MESSAGES>) WHERE 400 - used >= 100")
def token_budget(spark, sf):
    return history.in_budget(i.frame(spark, sf, i.MESSAGES), 400).select("conv_id", "turn", "used")


@query(f"SELECT conv_id, turn FROM (SELECT *, sum({_TOKENS}) OVER (PARTITION BY conv_id) AS s, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM <MESSAGES> WHERE role <> 'summary') WHERE s >= 130 AND n >= 6 AND b > 4")
def summarise_plan(spark, sf):
    return history.to_summarise(i.frame(spark, sf, i.MESSAGES), 200).select("conv_id", "turn")


@query(
    """WITH m AS (SELECT *, turn % 4 = 0 AND role = 'user' AS has FROM <MESSAGES>), l AS (SELECT *, max(CASE WHEN has THEN turn END) OVER (PARTITION BY conv_id) AS last FROM m)
    SELECT conv_id, turn, md5(CASE WHEN has AND turn = last THEN '<document name="f">' || chr(10) || 'body' || chr(10) || '</document>' || chr(10) || chr(10) || 'Вопрос: ' || text WHEN has THEN '[Ранее загружен документ: f]' || chr(10) || chr(10) || 'Вопрос: ' || text ELSE text END) AS content FROM l"""
)
def last_document(spark, sf):
    m = i.frame(spark, sf, i.MESSAGES).withColumns({"extracted": F.when(F.col("turn") % 4 == 0, "body"), "name": F.lit("f")})
    return history.last_document_only(m).select("conv_id", "turn", F.md5("content").alias("content"))


@query()
def page_chunks(spark, sf):
    lines = tables.lines_of(table(spark, sf, "documents")).select("doc_id", F.col("line_no").alias("page_no"), F.col("line").alias("text"))
    return history.page_chunks(lines, 4000)


# ---------------------------------------------------------------- lines, text quality, tables

_LINES = "SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents"


@query(
    """WITH l AS (SELECT doc_id % 100 AS doc_id, doc_id % 3 AS angle, trim(unnest(string_split(text, chr(10)))) AS raw FROM documents), k AS (SELECT *, lower(regexp_replace(raw, '\\s+', ' ', 'g')) AS key FROM l WHERE length(lower(regexp_replace(raw, '\\s+', ' ', 'g'))) >= 2)
    SELECT doc_id, key, max_by(raw, (length(raw), raw)) AS line, CAST(count(DISTINCT angle) + CASE WHEN bool_or(angle = 0) THEN 0.35 ELSE 0 END AS DOUBLE) AS score FROM k GROUP BY 1, 2"""
)
def line_voting(spark, sf):
    views = table(spark, sf, "documents").select((F.col("doc_id") % 100).alias("doc_id"), (F.col("doc_id") % 3).alias("angle"), "text")
    return tables.line_votes(views)


@query(
    """WITH b AS (SELECT doc_id, unnest(range(len(regexp_split_to_array(text, '\\n')))) AS block_no, trim(unnest(regexp_split_to_array(text, '\\n'))) AS block FROM documents), k AS (SELECT *, left(lower(regexp_replace(block, '\\s+', ' ', 'g')), 120) AS key FROM b WHERE length(block) >= 8)
    SELECT doc_id, key, min(block_no) AS block_no FROM k GROUP BY 1, 2"""
)
def block_dedupe(spark, sf):
    doubled = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return tables.blocks_once(doubled).select("doc_id", "key", "block_no")


@query(
    f"""WITH n AS (SELECT doc_id, line_no, CAST(line_no % 30 AS STRING) || ' ' || trim(line) AS s FROM ({_LINES}) WHERE line_no % 2 = 0 AND length(trim(line)) >= 12), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS note_no FROM n WHERE NOT regexp_matches(s, '\\d+[xх×]\\d+'))
    SELECT doc_id, line_no, note_no FROM k WHERE note_no <= 40"""
)
def numbered_notes(spark, sf):
    lines = tables.lines_of(table(spark, sf, "documents"))
    line = F.when(F.col("line_no") % 2 == 0, F.concat((F.col("line_no") % 30).cast("string"), F.lit(" "), F.trim("line"))).otherwise(F.lit("-"))
    text = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return tables.numbered_notes(text).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("note_no").cast("long").alias("note_no"))


@query(
    """WITH d AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM documents), c AS (SELECT *, string_split(lower(t), '') AS cs FROM d),
    p AS (SELECT *, length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS n, length(t) - length(regexp_replace(t, '(?i)[aeiouy]', '', 'g')) AS v, len(list_filter(range(1, len(cs) - 2), lambda x: cs[x] = cs[x + 1] AND cs[x] = cs[x + 2] AND cs[x] = cs[x + 3])) > 0 AS rep FROM c)
    SELECT doc_id, CASE WHEN length(t) < 3 THEN -100 WHEN n < 3 THEN -50 ELSE round(v * 40.0 / n + least(n, 80) * 0.15 - CASE WHEN v * 1.0 / n < 0.18 OR v * 1.0 / n > 0.62 THEN 18 ELSE 0 END - (length(t) - length(regexp_replace(t, '[0-9]', '', 'g'))) * 4.0 - (length(t) - length(regexp_replace(t, '[|©\\[\\]_`]', '', 'g'))) * 6.0
      - CASE WHEN regexp_matches(t, '(?i)[bcdfghjklmnpqrstvwxz]{5,}') THEN 12 ELSE 0 END - CASE WHEN rep THEN 8 ELSE 0 END, 6) END AS score FROM p"""
)
def text_quality(spark, sf):
    score = s.readability(F.col("text"), "A-Za-z", "aeiouy", "0-9", "bcdfghjklmnpqrstvwxz")
    return table(spark, sf, "documents").select("doc_id", F.round(score, 6).alias("score"))


@query("SELECT doc_id, CASE WHEN length(t) < 20 THEN 0.0 ELSE round(least(0.25, wide * 1.0 / n * 0.4), 6) * CASE WHEN n <= 2 AND length(t) > 120 THEN 0.5 ELSE 1 END END AS quality FROM (SELECT doc_id, t, greatest(1, len(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> ''))) AS n, len(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '' AND len(string_split(trim(x), '  ')) >= 3)) AS wide FROM (SELECT doc_id, trim(replace(text, ' | ', '  ')) AS t FROM documents))")
def table_quality(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", F.regexp_replace(F.replace("text", F.lit(" | "), F.lit("  ")), "[A-Za-z\\u0400-\\u04FF]", "_").alias("t"))
    return df.select("doc_id", F.round(s.table_quality(F.col("t")), 6).alias("quality"))


@query(
    """SELECT doc_id, regexp_matches(t, '[a-m]') AND regexp_matches(t, '[éèêçñóíáúäöüß]') AND (regexp_matches(t, '[a-m]\\S*[éèêçñóíáúäöüß]|[éèêçñóíáúäöüß]\\S*[a-m]') OR (n >= 2 AND n * 1.0 / greatest(length(t), 1) > 0.06)) AS mixed
    FROM (SELECT doc_id, t, length(t) - length(regexp_replace(t, '[a-m]', '', 'g')) AS n FROM (SELECT doc_id, trim(coalesce(text, '')) AS t FROM documents))"""
)
def mixed_script(spark, sf):
    return table(spark, sf, "documents").select("doc_id", s.mixed_script(F.col("text"), "a-m", "éèêçñóíáúäöüß").alias("mixed"))


@query("SELECT CAST(p_partkey AS BIGINT) AS ord, CASE WHEN p_partkey % 2 = 0 THEN 'НАСОС ' ELSE 'HACOC ' END || CAST(p_partkey AS STRING) AS text FROM part")
def homoglyphs(spark, sf):
    df = i.frame(spark, sf, "SELECT CAST(p_partkey AS BIGINT) AS ord, CASE WHEN p_partkey % 2 = 0 THEN 'HAСOC ' ELSE 'HACOC ' END || CAST(p_partkey AS STRING) AS raw FROM {part}")
    return df.select("ord", s.homoglyphs(F.concat("raw", F.lit("\n  \n"))).alias("text"))


@query(f"WITH c AS (SELECT doc_id, line_no, list_filter(list_transform(string_split(trim(line), '|'), lambda x: trim(x)), lambda x: x <> '') AS cells FROM ({_LINES}) WHERE contains(line, '|')) SELECT doc_id, line_no, unnest(range(len(cells))) AS cell_no, unnest(cells) AS cell FROM c WHERE len(cells) >= 2")
def pipe_cells(spark, sf):
    lines = tables.lines_of(table(spark, sf, "documents")).where(F.contains("line", F.lit("|"))).withColumn("cells", s.row_cells(F.col("line"))).where(F.size("cells") >= 2)
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.posexplode("cells").alias("cell_no", "cell")).withColumn("cell_no", F.col("cell_no").cast("long"))


@query(
    f"""WITH k AS (SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '^The|^Le') THEN 'specification' WHEN regexp_matches(line, '^An|^De') THEN 'legend' END AS kind FROM ({_LINES})), a AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM k WHERE kind IS NOT NULL),
    s AS (SELECT doc_id, kind, line_no AS start_line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS section_no, lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS stop FROM a WHERE before IS NULL OR before <> kind)
    SELECT doc_id, section_no, kind, start_line, coalesce(stop, len(string_split(text, chr(10)))) - start_line AS n_lines FROM s JOIN documents USING (doc_id)"""
)
def section_blocks(spark, sf):
    return tables.sections(table(spark, sf, "documents"), {"specification": "^The|^Le", "legend": "^An|^De"})


@query("SELECT doc_id, key, min(ord) AS ord, max_by(name, (length(name), -ord)) AS name FROM (SELECT l_orderkey AS doc_id, CAST(l_partkey % 5 AS STRING) AS key, l_linenumber AS ord, repeat('n', CAST(l_quantity AS INT)) AS name FROM lineitem) GROUP BY 1, 2")
def spec_dedupe(spark, sf):
    rows = i.frame(spark, sf, "SELECT l_orderkey AS doc_id, CAST(l_partkey % 5 AS STRING) AS pos, l_linenumber AS ord, repeat('n', CAST(l_quantity AS INT)) AS name FROM {lineitem}")
    return tables.rows_once(rows)


@query("SELECT doc_id, ord, CASE WHEN e THEN CAST(sum(CAST(e AS INT)) OVER (PARTITION BY doc_id ORDER BY ord) AS STRING) ELSE 'A' END AS pos FROM (SELECT l_orderkey AS doc_id, l_linenumber AS ord, l_partkey % 2 = 0 AS e FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2))")
def auto_numbers(spark, sf):
    rows = i.frame(spark, sf, "SELECT l_orderkey AS doc_id, l_linenumber AS ord, CASE WHEN l_partkey % 2 = 0 THEN '' ELSE 'A' END AS pos FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_returnflag) AS l_returnflag FROM {lineitem} GROUP BY 1, 2)")
    return tables.auto_numbers(rows)


@query("SELECT doc_id, line_no, coalesce(n0, n1, n2, n3) AS name FROM (SELECT doc_id, line_no, CASE WHEN ok THEN line END AS n0, lead(CASE WHEN ok THEN line END, 1) OVER w AS n1, lead(CASE WHEN ok THEN line END, 2) OVER w AS n2, lead(CASE WHEN ok THEN line END, 3) OVER w AS n3 FROM (SELECT l_orderkey AS doc_id, l_linenumber AS line_no, l_returnflag || CAST(l_partkey AS STRING) AS line, l_partkey % 3 = 0 AS ok FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2)) WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))")
def name_nearby(spark, sf):
    rows = i.frame(spark, sf, "SELECT l_orderkey AS doc_id, l_linenumber AS line_no, l_returnflag || CAST(l_partkey AS STRING) AS line FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_returnflag) AS l_returnflag FROM {lineitem} GROUP BY 1, 2)")
    return tables.name_nearby(rows, F.substring("line", 2, 20).cast("long") % 3 == 0).select("doc_id", "line_no", "name")


@query("SELECT doc_id, plan_number, min(line_no) AS line_no FROM (SELECT l_orderkey AS doc_id, l_linenumber AS line_no, CAST(l_partkey % 4 AS STRING) AS plan_number FROM lineitem) GROUP BY 1, 2")
def plan_rows(spark, sf):
    rows = i.frame(spark, sf, "SELECT l_orderkey AS doc_id, l_linenumber AS line_no, CAST(l_partkey % 4 AS STRING) || ' Здание КНС' AS line FROM {lineitem}")
    return tables.plan_rows(rows).select("doc_id", "plan_number", "line_no")


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages")
def tag_strip(spark, sf):
    return table(spark, sf, "pages").select("page_id", s.strip_tags(F.col("html")).alias("text"))


@query("SELECT p_partkey AS ord, p_name AS name, p_brand AS brand FROM part")
def card_fields(spark, sf):
    html = F.concat(F.lit("<table><tr><td>Обозначение</td><td>x</td></tr><tr><td> <b>Обозначение</b></td> <td>"), "p_name", F.lit("</td></tr>\n<tr><th>Марка</th><td><i>"), "p_brand", F.lit("</i></td></tr></table>"))
    cards = registry.card_fields(table(spark, sf, "part").select("p_partkey", html.alias("html")))
    return cards.select(F.col("p_partkey").alias("ord"), F.col("fields")["Обозначение"].alias("name"), F.col("fields")["Марка"].alias("brand"))


@query("SELECT doc_id, unnest(range((length(text) + 899) // 900)) AS chunk_no, md5(substr(text, unnest(range((length(text) + 899) // 900)) * 900 + 1, 900)) AS chunk FROM documents")
def sse_chunks(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", F.posexplode(s.sse_chunks(F.col("text"))).alias("chunk_no", "chunk"))
    return df.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.md5("chunk").alias("chunk"))


@query("SELECT c_custkey AS ord, left(c_name, 2) || '••••••••' AS masked, lower(c_name) AS login, left(sha256(c_name || '|' || c_mktsegment), 40) AS key, contains(lower(c_mktsegment), 'build') OR contains(lower(c_mktsegment), 'auto') AS routed FROM customer")
def names_and_keys(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("ord"), s.mask(F.col("c_name")).alias("masked"), s.login_name(F.concat(F.lit("DOM\\"), "c_name", F.lit("@host"))).alias("login"), s.cache_key(F.col("c_name"), F.col("c_mktsegment")).alias("key"), s.contains_any(F.col("c_mktsegment"), ("build", "auto")).alias("routed"))


# ---------------------------------------------------------------- geometry


@query(
    """WITH g AS (SELECT o_orderkey AS doc_id, 1 AS page_no, 800.0 + o_orderkey % 400 AS w, 500.0 + o_custkey % 300 AS h, CASE WHEN 1 + o_orderkey % 15 <= 1 THEN 4 WHEN 1 + o_orderkey % 15 <= 5 THEN 3 WHEN 1 + o_orderkey % 15 <= 12 THEN 2 ELSE 1 END AS cols, CASE WHEN 1 + o_orderkey % 15 <= 12 THEN 2 ELSE 1 END AS rows FROM orders),
    t AS (SELECT *, unnest(range(cols)) AS col FROM g), u AS (SELECT *, unnest(range(rows)) AS row FROM t)
    SELECT doc_id, row, col, round(CAST(col * w / cols - CASE WHEN col > 0 THEN w / cols * 0.12 ELSE 0 END AS DOUBLE), 6) AS x0, round(CAST((col + 1) * w / cols + CASE WHEN col < cols - 1 THEN w / cols * 0.12 ELSE 0 END AS DOUBLE), 6) AS x1, round(CAST(row * h / rows - CASE WHEN row > 0 THEN h / rows * 0.12 ELSE 0 END AS DOUBLE), 6) AS y0 FROM u"""
)
def tile_grid(spark, sf):
    pages = i.frame(spark, sf, "SELECT o_orderkey AS doc_id, 1 AS page_no, CAST(800 + o_orderkey % 400 AS DOUBLE) AS width, CAST(500 + o_custkey % 300 AS DOUBLE) AS height, 1 + o_orderkey % 15 AS n FROM {orders}")
    pages = pages.withColumns({"cols": s.grid_columns(F.col("n")), "rows": s.grid_rows(F.col("n"))})
    return layout.tile_grid(pages).select("doc_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), *(F.round(c, 6).alias(c) for c in ("x0", "x1", "y0")))


@query("SELECT a.doc_id, a.ord AS kept, b.ord AS copy FROM <BOXES> a JOIN <BOXES> b ON a.doc_id = b.doc_id AND a.text = b.text AND a.ord < b.ord WHERE greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) > 0.2 * least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0))")
def word_overlap_dedupe(spark, sf):
    return layout.word_duplicates(i.frame(spark, sf, i.BOXES), 0.2).select("doc_id", "kept", "copy")


@query("SELECT a.doc_id, a.ord AS first, b.ord AS second FROM <BOXES> a JOIN <BOXES> b ON a.doc_id = b.doc_id AND b.ord > a.ord AND b.ord <= a.ord + 13 WHERE abs((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) <= greatest(3.5, 0.55 * least(a.y1 - a.y0, b.y1 - b.y0))")
def same_line_words(spark, sf):
    return layout.same_line(i.frame(spark, sf, i.BOXES)).select("doc_id", "first", "second")


@query("SELECT a.doc_id, a.ord, b.ord AS hit_id FROM <BOXES> a JOIN <BOXES> b ON a.doc_id = b.doc_id AND b.ord % 3 = 0 AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1")
def words_in_hits(spark, sf):
    boxes = i.frame(spark, sf, i.BOXES)
    return layout.words_in(boxes, boxes.where("ord % 3 = 0").withColumnRenamed("ord", "hit_id")).select("doc_id", "ord", "hit_id")


@query("SELECT doc_id, list_sort(list(y1 - y0 + ord))[len(list(ord)) // 2 + 1] AS height FROM <BOXES> GROUP BY 1")
def median_height(spark, sf):
    boxes = i.frame(spark, sf, i.BOXES).withColumn("y1", F.col("y1") + F.col("ord"))
    return layout.upper_median_height(boxes).select("doc_id", "height")


@query("SELECT doc_id, CAST(x0 AS BIGINT) AS rx0, min(ord) AS ord FROM (SELECT doc_id, ord, x0, round(x1) AS rx1 FROM <BOXES> WHERE x1 - x0 >= 2) GROUP BY doc_id, x0, rx1")
def rectangles_once(spark, sf):
    flat = i.frame(spark, sf, i.BOXES).withColumns({"y0": F.lit(0.0), "y1": F.lit(5.0)})
    return layout.rectangles_once(flat).select("doc_id", "rx0", "ord")


@query("SELECT doc_id, ord, last_value(CASE WHEN text = 'R' THEN ord END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS kind_ord FROM (SELECT doc_id, ord, min(text) AS text FROM <BOXES> GROUP BY 1, 2)")
def neighbour_lookback(spark, sf):
    return layout.last_kind_before(i.frame(spark, sf, i.BOXES).groupBy("doc_id", "page_no", "ord").agg(F.min("text").alias("text")), F.col("text") == "R").select("doc_id", "ord", "kind_ord")


@query("SELECT doc_id, ord, round((x0 + x1) / 2 / 400, 6) AS cx, round((x1 - x0) / 400, 6) AS w, false AS wide FROM <BOXES>")
def detector_boxes(spark, sf):
    box = s.detector_box(*(F.col(c) for c in ("x0", "y0", "x1", "y1")), F.lit(400.0), F.lit(300.0))
    return i.frame(spark, sf, i.BOXES).select("doc_id", "ord", F.round(box["cx"], 6).alias("cx"), F.round(box["w"], 6).alias("w"), s.is_wide(F.lit(400.0), F.lit(300.0)).alias("wide"))


# ---------------------------------------------------------------- data sets, settings

_MATCHED = "SELECT l.*, coalesce(c.stem, d.stem) AS crop, CASE WHEN c.stem IS NOT NULL THEN 10 ELSE 1 END AS score FROM <LABELS> l LEFT JOIN <CROPS> c ON l.stem = c.stem LEFT JOIN <CROPS> d ON lower(replace(l.stem, '.', '')) = lower(d.stem)"


@query(f"SELECT file, zone, crop, score FROM ({_MATCHED}) WHERE crop IS NOT NULL")
def label_crop_match(spark, sf):
    return dataset.matched_labels(i.frame(spark, sf, i.LABELS), i.frame(spark, sf, i.CROPS)).select("file", "zone", "crop", "score")


@query(f"SELECT file, zone FROM ({_MATCHED}) WHERE crop IS NULL")
def label_orphans(spark, sf):
    return dataset.orphans(i.frame(spark, sf, i.LABELS), i.frame(spark, sf, i.CROPS)).select("file", "zone")


@query(f"SELECT crop, zone, file FROM (SELECT *, row_number() OVER (PARTITION BY crop, zone ORDER BY score DESC, length(text) DESC, file) AS n FROM ({_MATCHED}) WHERE crop IS NOT NULL) WHERE n = 1")
def label_dedupe(spark, sf):
    return dataset.labels_once(dataset.matched_labels(i.frame(spark, sf, i.LABELS), i.frame(spark, sf, i.CROPS))).select("crop", "zone", "file")


@query("SELECT file FROM <LABELS> WHERE length(trim(text)) >= 3 AND (length(text) - length(regexp_replace(text, '[a-z]', '', 'g'))) * 1.0 / length(text) >= 0.35")
def usable_labels(spark, sf):
    return dataset.usable_labels(i.frame(spark, sf, i.LABELS), letters="[a-z]").select("file")


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id * 7919 % 1000003) <= greatest(1, count(*) OVER () // 10) THEN 'valid' ELSE 'train' END AS part FROM documents")
def train_split(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return dataset.train_split(docs, "doc_id", 0.1, F.col("doc_id") * 7919 % 1000003)


@query("SELECT stem, zone, count(*) AS n FROM <LABELS> l WHERE zone = 'stamp_frame' OR NOT EXISTS (SELECT 1 FROM <LABELS> f WHERE f.zone = 'stamp_frame' AND f.stem = l.stem) GROUP BY 1, 2")
def prefer_zone(spark, sf):
    return dataset.prefer_zone(i.frame(spark, sf, i.LABELS)).groupBy("stem", "zone").agg(F.count("*").alias("n"))


@query("SELECT coalesce(o.key, n.key) AS key, coalesce(n.value, o.value) AS value, coalesce(nullif(n.label, ''), o.label, '') AS label FROM (SELECT c_name AS key, c_mktsegment AS value, 'old' AS label FROM customer WHERE c_custkey % 3 > 0) o FULL JOIN (SELECT c_name AS key, 'v' || CAST(c_custkey AS STRING) AS value, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'new' END AS label FROM customer WHERE c_custkey % 4 > 0) n ON o.key = n.key")
def settings_upsert(spark, sf):
    old = i.frame(spark, sf, "SELECT c_name AS key, c_mktsegment AS value, 'old' AS label FROM {customer} WHERE c_custkey % 3 > 0")
    new = i.frame(spark, sf, "SELECT c_name AS key, 'v' || CAST(c_custkey AS STRING) AS value, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'new' END AS label FROM {customer} WHERE c_custkey % 4 > 0")
    return dataset.upsert(old, new)


@query("SELECT substr(c_name, 10) AS key, c_mktsegment AS value FROM customer WHERE starts_with(c_name, 'Customer#')")
def settings_prefix(spark, sf):
    return dataset.by_prefix(i.frame(spark, sf, "SELECT c_name AS key, c_mktsegment AS value FROM {customer}"), "Customer#")


@query("SELECT folder, name FROM (SELECT c_mktsegment AS folder, c_name AS name, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_name) AS n FROM customer) WHERE n > 20")
def cache_prune(spark, sf):
    files = i.frame(spark, sf, "SELECT c_mktsegment AS folder, c_name AS name, c_acctbal AS mtime FROM {customer}")
    return dataset.newest(files, 20).select("folder", "name")


@query("SELECT stem, zone, length(left(text, 12000)) AS n, length(text) AS n_chars FROM <LABELS>")
def label_manifest(spark, sf):
    return dataset.manifest(i.frame(spark, sf, i.LABELS)).select("stem", "zone", F.length("text").alias("n"), "n_chars")


# ---------------------------------------------------------------- the whole path


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Extract, match, validate, report: one row for each document."""
    refs = settled(extract.references(i.frame(spark, sf, i.SOURCES)))
    found = registry.match_a(refs, i.frame(spark, sf, i.REGISTRY))
    cards = i.frame(spark, sf, "SELECT CAST(p_partkey AS BIGINT) AS row_ord, '01.01.' || CAST(1980 + p_size % 20 AS STRING) AS intro, CASE WHEN p_size % 3 = 0 THEN '01.06.' || CAST(1990 + p_size % 10 AS STRING) ELSE '—' END AS cancel FROM {part}")
    checks = registry.checks_a(found, cards, F.lit(TODAY).cast("date")).select(F.col("row_ord").alias("ord"), "ref", F.lit(True).alias("found"), "status")
    return report.summary(report.joined_report(refs, checks, checks))


@query()
def document_report(spark, sf):
    return flagship(spark, sf)


# ---------------------------------------------------------------- sheets and sections

_SNIP = "SELECT CAST(p_partkey AS BIGINT) AS ord, CASE WHEN p_partkey % 5 = 0 THEN 'ГОСТ' ELSE 'СНиП' END AS kind, CASE WHEN p_partkey % 5 = 0 THEN 'ГОСТ 481-80' WHEN p_partkey % 3 = 0 THEN 'СНиП 1.03.' || CAST(10 + p_partkey % 80 AS STRING) || '-' || CAST(2000 + p_size % 40 AS STRING) WHEN p_partkey % 3 = 1 THEN 'СНиП 2.01-' || CAST(10 + p_size AS STRING) ELSE 'СНиП 63.13330.2018' END AS ref, CASE WHEN p_partkey % 2 = 0 THEN 'по сп здесь' ELSE 'лист' END AS context FROM {part}"


@query(
    f"""WITH s AS (SELECT *, CASE WHEN kind <> 'СНиП' THEN kind WHEN ref = 'СНиП 63.13330.2018' THEN 'СП' WHEN regexp_matches(ref, '-2\\d{{3}}$') THEN CASE WHEN CAST(right(ref, 4) AS INT) < 2010 THEN kind WHEN context = 'лист' THEN 'СН' ELSE 'СП' END WHEN CAST(right(ref, 2) AS INT) BETWEEN 10 AND 39 THEN 'СП' ELSE kind END AS new_kind FROM ({i.plain(_SNIP)}))
    SELECT ord, new_kind, replace(ref, kind, new_kind) AS new_ref FROM s"""
)
def reclassify_snip(spark, sf):
    kind, ref = sheet.modern_snip(K(), R(), F.col("context"))
    return i.frame(spark, sf, _SNIP).select("ord", kind.alias("new_kind"), ref.alias("new_ref"))


@query(
    """WITH n AS (SELECT ord, kind, ref, regexp_replace(ref, '^\\S+ ', '') AS num, CASE kind WHEN 'ГОСТ' THEN 'GOST' WHEN 'ОСТ' THEN 'OCT' END AS latin FROM <REFS>)
    SELECT ord, phrase FROM (SELECT ord, unnest([ref, kind || num, '(' || ref || ')', '(' || kind || num || ')', latin || ' ' || num, latin || num, '(' || latin || ' ' || num || ')', '(' || latin || num || ')']) AS phrase FROM n) WHERE phrase IS NOT NULL"""
)
def highlight_phrases(spark, sf):
    return i.frame(spark, sf, i.REFS).select("ord", F.explode(sheet.highlight_phrases(K(), R())).alias("phrase"))


@query("SELECT ord, doc_id % 3 > 0 AS found FROM <REFS>")
def source_contains(spark, sf):
    refs = i.frame(spark, sf, i.REFS)
    text = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("Трубы по "), F.replace(R(), F.lit("-"), F.lit(" -")), F.lit(" и далее"))).otherwise(F.concat(F.lit("Трубы по "), K(), F.lit(" 9")))
    return refs.select("ord", sheet.source_has(text, K(), R()).alias("found"))


@query("SELECT doc_id, (length(t) >= 120 OR w >= 25) AND w >= 40 AND n >= 3 AS usable FROM (SELECT doc_id, trim(text) AS t, len(list_filter(regexp_split_to_array(trim(text), '[ \\t\\n]+'), lambda x: x <> '')) AS w, len(regexp_extract_all(text, '\\d{4,}')) AS n FROM documents)")
def usable_layers(spark, sf):
    return table(spark, sf, "documents").select("doc_id", sheet.usable_layer(F.regexp_replace("text", "[А-Яа-я]", "")).alias("usable"))


_CIPHERS = "SELECT CAST(l_orderkey AS BIGINT) AS doc_id, CAST(l_linenumber AS BIGINT) AS ord, CASE l_partkey % 4 WHEN 0 THEN '34-43-' || CAST(10000 + l_partkey AS STRING) || '-78' WHEN 1 THEN CAST(1000 + l_partkey % 7000 AS STRING) || ' - 0 - ЭМ1' WHEN 2 THEN CAST(1000 + l_partkey % 7000 AS STRING) || '-0-КР' ELSE 'VR-' || CAST(100000 + l_partkey AS STRING) END AS raw FROM {lineitem}"


@query(
    f"""WITH c AS (SELECT DISTINCT ON (doc_id, ord, raw) doc_id, ord, CASE WHEN raw LIKE '%-КР' THEN raw || '1' ELSE replace(raw, ' ', '') END AS cipher FROM ({i.plain(_CIPHERS)})),
    s AS (SELECT *, CASE WHEN regexp_matches(cipher, '^34-43-') THEN -100 ELSE CASE WHEN regexp_matches(cipher, '[А-Я]\\d$') THEN 12 ELSE 4 END + CASE WHEN cipher LIKE 'VR-%' THEN 28 ELSE 0 END + CASE WHEN cipher LIKE '%-ЭМ1' THEN 14 WHEN cipher LIKE '%-КР1' THEN 10 ELSE 0 END + CASE WHEN regexp_matches(cipher, '\\d+-\\d+-') THEN 6 ELSE 0 END
      - CASE WHEN regexp_matches(cipher, '0000|1111|2222|3333|4444|5555|6666|7777|8888|9999') THEN 14 ELSE 0 END END AS bonus, CASE WHEN regexp_matches(cipher, '[А-Я]') THEN 2 ELSE 0 END AS cyr FROM c)
    SELECT doc_id, bonus, cyr FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY bonus DESC, cyr DESC, length(cipher) DESC, ord) AS n FROM s) WHERE n = 1"""
)
def best_cipher(spark, sf):
    best = sections.best_ciphers(i.frame(spark, sf, _CIPHERS))
    rank = sheet.cipher_rank(F.col("cipher"))
    return best.select("doc_id", rank["bonus"].alias("bonus"), rank["cyrillic"].alias("cyr"))


@query("SELECT CAST(p_partkey AS BIGINT) AS ord, CASE p_partkey % 3 WHEN 2 THEN '' ELSE CAST(1 + p_partkey % 99 AS STRING) END AS sheet, CASE p_partkey % 2 WHEN 0 THEN '11.25' ELSE '—' END AS date, CASE p_partkey % 2 WHEN 0 THEN 9 ELSE 0 END AS score FROM part")
def file_hints(spark, sf):
    n = (1 + F.col("p_partkey") % 99).cast("string")
    k = F.col("p_partkey")
    file = F.when(k % 3 == 0, F.concat(F.lit("план_Л"), n, F.lit(".pdf"))).when(k % 3 == 1, F.concat(F.lit("план л. "), n, F.lit(".pdf"))).otherwise(F.lit("план.pdf"))
    text = F.when(k % 2 == 0, F.lit("Изм. Лист 1760-0-КР 1:100")).otherwise(F.lit("просто текст"))
    return table(spark, sf, "part").select(k.alias("ord"), sheet.sheet_number(file).alias("sheet"), sheet.block_date(F.when(k % 2 == 0, F.lit("11.25")).otherwise(F.lit("13.45"))).alias("date"), sheet.stamp_score(text).alias("score"))


@query("SELECT CAST(p_partkey AS BIGINT) AS ord, CASE p_partkey % 4 WHEN 0 THEN '—' WHEN 1 THEN CAST(p_size AS STRING) WHEN 2 THEN '—' ELSE '2,5 м' END AS qty, p_partkey % 2 = 0 AS doubled, 2 AS pieces FROM part")
def bom_rows(spark, sf):
    k, q = F.col("p_partkey"), F.col("p_size").cast("string")
    name = F.when(k % 4 == 0, F.concat(F.lit("Щит панель "), q)).otherwise(F.lit("Опора скользящая"))
    qty = F.when(k % 4 == 2, F.lit("много")).when(k % 4 == 3, F.lit("2,5 м")).otherwise(q)
    line = F.when(k % 2 == 0, F.lit("Насос центробежный, насос центробежный")).otherwise(F.lit("Насос центробежный и задвижка стальная"))
    return table(spark, sf, "part").select(k.alias("ord"), sheet.row_quantity(name, qty).alias("qty"), sheet.doubled_phrase(line).alias("doubled"), F.size(sheet.spec_position(F.lit("161 Блок питания 162 Щит управления"))).alias("pieces"))


@query("SELECT CAST(c_custkey AS BIGINT) AS ord, CASE c_custkey % 3 WHEN 0 THEN 'document' WHEN 1 THEN 'table' ELSE 'simple' END AS task, CASE WHEN c_custkey % 2 = 0 THEN 'Анализ: ' || c_name ELSE 'Что это' END AS title FROM customer")
def chat_routing(spark, sf):
    k = F.col("c_custkey")
    ext = F.when(k % 3 == 0, "pdf").when(k % 3 == 1, "XLSX").otherwise("txt")
    file = F.when(k % 2 == 0, F.concat(F.lit("/up/"), "c_name", F.lit(".pdf")))
    return table(spark, sf, "customer").select(k.alias("ord"), sheet.task_of(ext, F.lit("Что это")).alias("task"), sheet.chat_title(F.lit(" Что   это?! "), file, F.when(k % 2 == 0, "Анализ").otherwise("")).alias("title"))


_FIELDS = "SELECT CAST(l_orderkey AS BIGINT) AS doc_id, l_returnflag AS field, CAST(l_linenumber AS BIGINT) AS source_ord, min(CASE WHEN l_partkey % 4 = 0 THEN '' ELSE 'v' || CAST(l_partkey AS STRING) END) AS value, CAST(min(l_quantity % 7) AS BIGINT) AS quality FROM {lineitem} GROUP BY 1, 2, 3"


@query(f"SELECT doc_id, field, value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY quality + CASE source_ord WHEN 1 THEN 4 WHEN 2 THEN 1 ELSE 0 END DESC, source_ord) AS n FROM ({i.plain(_FIELDS)}) WHERE value <> '') WHERE n = 1")
def merge_fields(spark, sf):
    return sections.merged_fields(i.frame(spark, sf, _FIELDS))


@query(
    f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY source_ord) AS k FROM ({i.plain(_FIELDS)})), w AS (SELECT doc_id, field, k, value AS name, quality FROM o WHERE k = 1
    UNION ALL SELECT o.doc_id, o.field, o.k, CASE WHEN o.quality > w.quality + 1 THEN o.value ELSE w.name END, CASE WHEN o.quality > w.quality + 1 THEN o.quality ELSE w.quality END FROM w JOIN o ON o.doc_id = w.doc_id AND o.field = w.field AND o.k = w.k + 1)
    SELECT doc_id, field AS role, max_by(name, k) AS name FROM w GROUP BY 1, 2"""
)
def merge_signatures(spark, sf):
    rows = i.frame(spark, sf, _FIELDS).select("doc_id", F.col("field").alias("role"), "source_ord", F.col("value").alias("name"), F.col("quality").cast("double").alias("readability"))
    return sections.merged_signatures(rows)


@query("SELECT doc_id, ord, CASE WHEN k >= greatest(4, ceil(n * 0.85)) THEN '—' ELSE name END AS name FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, count(*) OVER (PARTITION BY doc_id, name) AS k FROM (SELECT l_orderkey AS doc_id, l_linenumber AS ord, l_linestatus AS name FROM lineitem))")
def collapse_surnames(spark, sf):
    rows = i.frame(spark, sf, "SELECT l_orderkey AS doc_id, l_linenumber AS ord, l_linestatus AS name FROM {lineitem}")
    return sections.collapse_surnames(rows).select("doc_id", "ord", "name")


_SECTIONS = "SELECT CAST(o_custkey AS BIGINT) AS doc_id, CAST(o_orderkey AS BIGINT) AS ord, CASE o_orderkey % 3 WHEN 0 THEN 'specification' WHEN 1 THEN 'legend' ELSE 'explication' END AS kind, CASE WHEN o_orderkey % 4 = 0 THEN 'Т' ELSE '' END AS title, CASE WHEN o_orderkey % 2 = 0 THEN CAST(1 + o_orderkey % 5 AS STRING) || '.' || CAST(o_orderkey % 3 AS STRING) ELSE '' END AS table_number, CAST(o_orderkey % 11 AS BIGINT) AS n_rows, CAST(o_orderkey % 7 AS BIGINT) AS filled, CAST(o_orderkey AS BIGINT) AS start_line FROM {orders}"


@query(f"SELECT doc_id, kind, ord FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY n_rows * 2 + filled + CASE WHEN title <> '' THEN 3 ELSE 0 END DESC, ord) AS n FROM ({i.plain(_SECTIONS)})) WHERE n = 1")
def best_section(spark, sf):
    return sections.best_sections(i.frame(spark, sf, _SECTIONS))


@query(
    f"""WITH n AS (SELECT doc_id, ord, start_line, table_number AS t, coalesce(nullif(table_number, ''), CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS STRING)) AS table_number FROM ({i.plain(_SECTIONS)}))
    SELECT doc_id, ord, table_number, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(split_part(table_number, '.', 1) AS INT), CASE WHEN contains(table_number, '.') THEN CAST(split_part(table_number, '.', 2) AS INT) ELSE 0 END, start_line) AS place FROM n"""
)
def section_numbers(spark, sf):
    return sections.section_order(sections.numbered_sections(i.frame(spark, sf, _SECTIONS))).select("doc_id", "ord", "table_number", "place")


_KEYED = "SELECT doc_id, ord, kind, CASE WHEN ord % 5 = 0 THEN table_number ELSE '' END AS table_number, CASE WHEN n_rows = 0 THEN 'a' ELSE 'a,b' END || CASE WHEN filled = 1 THEN ',c' ELSE ',d,e' END AS keys FROM (" + _SECTIONS + ") s"


@query(
    f"""WITH s AS (SELECT doc_id, ord, kind, table_number, string_split(keys, ',') AS keys FROM ({i.plain(_KEYED)}))
    SELECT a.doc_id, a.ord AS first, b.ord AS second FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.ord < b.ord WHERE (a.table_number <> '' AND a.table_number = b.table_number) OR (a.kind = b.kind AND len(list_intersect(a.keys, b.keys)) >= 0.5 * greatest(len(a.keys), len(b.keys)))"""
)
def mergeable_sections(spark, sf):
    return sections.mergeable(i.frame(spark, sf, _KEYED).withColumn("keys", F.split("keys", ",")))


_PLAN = "SELECT CAST(l_orderkey AS BIGINT) AS doc_id, l_returnflag AS plan_number, CAST(l_linenumber AS BIGINT) AS source_ord, repeat('n', CAST(min(l_quantity) AS INT)) AS name, CASE WHEN min(l_partkey) % 2 = 0 THEN '' ELSE 'note' || CAST(l_linenumber AS STRING) END AS note, 'g' || CAST(l_linenumber AS STRING) AS grid FROM {lineitem} GROUP BY l_orderkey, l_returnflag, l_linenumber"


@query(f"SELECT doc_id, plan_number, max_by(name, (length(name), -source_ord)) AS name, min_by(note, source_ord) FILTER (note <> '') AS note, min_by(grid, source_ord) AS grid FROM ({i.plain(_PLAN)}) GROUP BY 1, 2")
def merge_plan_rows(spark, sf):
    return sections.merged_plan_rows(i.frame(spark, sf, _PLAN))


@query("SELECT r_regionkey AS doc_id, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS row_no, 'key=' || CAST(n_nationkey AS STRING) || ';name=' || n_name || ';more=—' AS row FROM nation JOIN region ON n_regionkey = r_regionkey")
def table_rows(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_regionkey").alias("doc_id"), (F.col("n_nationkey") + 1).cast("long").alias("line_no"), F.array(F.col("n_nationkey").cast("string"), "n_name").alias("cells"))
    head = table(spark, sf, "region").select(F.col("r_regionkey").alias("doc_id"), F.lit(0).cast("long").alias("line_no"), F.array(F.lit("key"), F.lit("name"), F.lit("more")).alias("cells"))
    rows = sections.table_rows(head.unionByName(nation))
    return rows.select("doc_id", F.col("row_no").cast("long").alias("row_no"), F.array_join(F.transform("row", lambda x: F.concat_ws("=", x["key"], x["value"])), ";").alias("row"))


@query("WITH a AS (SELECT ref, kind FROM <REFS> WHERE ord % 3 > 0), b AS (SELECT ref, kind FROM <REFS> WHERE ord % 3 < 2) SELECT *, 'missing' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'extra' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def golden_differences(spark, sf):
    refs = i.frame(spark, sf, i.REFS)
    return sections.differences(refs.where("ord % 3 > 0").select("ref", "kind"), refs.where("ord % 3 < 2").select("ref", "kind"))


@query("WITH n AS (SELECT p_partkey % 50 AS doc_id, 'Опора ' || p_name || ' скользящая' AS note FROM part), r AS (SELECT p_partkey % 50 AS doc_id, lower('1 Опора ' || p_name || ' скользящая 12') AS row FROM part WHERE p_partkey % 2 = 0) SELECT doc_id, note FROM n WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = n.doc_id AND contains(r.row, lower(n.note)))")
def legend_not_in_spec(spark, sf):
    notes = i.frame(spark, sf, "SELECT p_partkey % 50 AS doc_id, 'Опора ' || p_name || ' скользящая' AS note FROM {part}")
    rows = i.frame(spark, sf, "SELECT p_partkey % 50 AS doc_id, '1 Опора ' || p_name || ' скользящая 12' AS name FROM {part} WHERE p_partkey % 2 = 0")
    return sections.new_notes(notes, rows)


@query("SELECT CAST(epoch_us(time_bucket(INTERVAL '1 hour', ts)) // 1000000 AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def windowed_events(spark, sf):
    out = messages.windowed_events(table(spark, sf, "events"))
    return out.select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


# ---------------------------------------------------------------- words around references, labels, tiles


@query("SELECT ord, ref AS shown, kind <> 'ТУ' AS steel, ord % 2 = 0 AS token, true AS gate FROM <REFS>")
def sanitize_refs(spark, sf):
    refs = i.frame(spark, sf, i.REFS)
    prefix = F.when(K() == "ТУ", F.lit("болт")).when(K() == "ОСТ", F.lit("В-20")).otherwise(F.lit("Ст3сп3"))
    raw = F.concat(F.lit("по листу "), F.lower(R()), F.lit(" далее"))
    word = F.when(F.col("ord") % 2 == 0, F.lit("(481-80),")).otherwise(F.lit("481х80"))
    return refs.select("ord", g.sanitized(raw, K()).alias("shown"), g.steel_grade(prefix).alias("steel"), g.number_token(word).alias("token"), g.checkable(K()).alias("gate"))


@query("SELECT CAST(p_partkey AS BIGINT) AS ord, CASE WHEN p_partkey % 3 > 0 THEN 'СНиП 2.0' || CAST(p_partkey % 9 + 1 AS STRING) || '.11-85' END AS snip FROM part")
def implicit_snips(spark, sf):
    k = F.col("p_partkey")
    number = F.concat(F.lit("2.0"), (k % 9 + 1).cast("string"), F.lit(".11-85"))
    text = F.when(k % 3 == 0, F.concat(F.lit("размер "), number)).otherwise(F.concat(F.lit("Строительные нормы "), number, F.lit(" и "), number, F.lit(", 12.03.11-85")))
    return table(spark, sf, "part").select(k.alias("ord"), F.try_element_at(g.bare_snips(text), F.lit(1)).alias("snip"))


@query("SELECT CAST(p_partkey AS BIGINT) AS ord, 'СТБ 1-20 ТНПА СТБ 2073-' || CAST(2000 + p_size % 30 AS STRING) || ' СТБ 2235-' || CAST(2001 + p_size % 30 AS STRING) || '; СТБ 1317-' || CAST(2002 + p_size % 30 AS STRING) || ' конец' AS text FROM part")
def recover_years(spark, sf):
    raw = F.concat(F.lit("СТБ 1-20 ТНПА СТБ 2073-"), (2000 + F.col("p_size") % 30).cast("string"), F.lit(" СТБ 2235-20; СТБ 1317-20 конец"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), g.recovered_years(raw).alias("text"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS ord, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(CASE WHEN 400.0 * 400 * (o_custkey % 30 + 10) / 30.0 > 90000 THEN greatest(72, floor(400 * sqrt(90000 / (400.0 * 400 * (o_custkey % 30 + 10) / 30.0)))) ELSE 400 END AS BIGINT) AS dpi FROM orders")
def dates_and_dpi(spark, sf):
    o = table(spark, sf, "orders")
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    dpi = s.capped_dpi(F.lit(72.0), 72.0 * (F.col("o_custkey") % 30 + 10) / 30, F.lit(400), 90_000)
    return o.select(F.col("o_orderkey").alias("ord"), s.request_date(raw).cast("string").alias("day"), dpi.alias("dpi"))


@query("SELECT CAST(p_partkey AS BIGINT) AS ord, '1.' || CAST(p_size AS STRING) AS number, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_name END AS cleaned, 'Спецификация ' || p_name AS block, 'Узел (АБВ)' AS name, p_brand AS note FROM part")
def titles_and_blocks(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    number, title = s.table_label(F.concat(F.lit("Таблица № 1."), F.col("p_size").cast("string"), F.lit(" – "), "p_name"))
    name, note = s.name_and_note(F.concat(F.lit("Узел (АБВ)  "), "p_brand"))
    text = F.concat(F.lit("начало Спецификация "), "p_name", F.lit(" Экспликация прочее"))
    return p.select(k.alias("ord"), number.alias("number"), title.alias("title"), s.clean_title(F.when(k % 2 == 0, F.lit("Продолжение")).otherwise(F.concat(F.lit(" "), "p_name", F.lit("  ")))).alias("cleaned"), s.block_between(text, "(?iu)специф", "(?iu)экспл").alias("block"), name.alias("name"), note.alias("note"))


@query(
    """WITH s AS (SELECT o_orderkey AS doc_id, 900 + o_orderkey % 700 AS w, 700 + o_custkey % 300 AS h FROM orders), x AS (SELECT *, unnest(range(0, greatest(1, w - 64), 448)) AS x0 FROM s), y AS (SELECT *, unnest(range(0, greatest(1, h - 64), 448)) AS y0 FROM x)
    SELECT doc_id, x0, y0, least(x0 + 512, w) AS x1, least(y0 + 512, h) AS y1 FROM y"""
)
def image_tiles(spark, sf):
    return layout.image_tiles(i.frame(spark, sf, "SELECT o_orderkey AS doc_id, 900 + o_orderkey % 700 AS width, 700 + o_custkey % 300 AS height FROM {orders}"), 512, 64)


@query("WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 2 AND NOT starts_with(x, '#')) AS ls FROM documents), u AS (SELECT doc_id, len(ls) AS n, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM l) SELECT doc_id, line_no, CAST(floor(line_no * 64 / n) AS BIGINT) AS y0, CAST(floor((line_no + 1) * 64 / n) AS BIGINT) AS y1, md5(line) AS line FROM u")
def label_strips(spark, sf):
    return layout.strips(table(spark, sf, "documents"), 64).withColumn("line", F.md5("line"))


@query()
def reconciled_refs(spark, sf):
    return pipelines.reconciled(i.frame(spark, sf, i.SOURCES))


@query(f"SELECT doc_id, ref, list_aggregate(list_sort(list(DISTINCT page_no)), 'string_agg', ',') AS pages FROM (SELECT p_partkey % 50 AS doc_id, 1 + p_partkey % 3 AS page_no, {i.designation('p_partkey', 'p_size')} AS ref FROM part) GROUP BY 1, 2")
def page_refs(spark, sf):
    pages = i.frame(spark, sf, i.SOURCES).select("doc_id", (1 + F.col("source_ord") % 3).alias("page_no"), "text")
    return pipelines.page_references(pages).select("doc_id", "ref", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


@query()
def checked_refs(spark, sf):
    cards = i.frame(spark, sf, "SELECT CAST(p_partkey AS BIGINT) AS row_ord, '01.01.' || CAST(1980 + p_size % 20 AS STRING) AS intro, '' AS cancel FROM {part}")
    return pipelines.checked(i.frame(spark, sf, i.REFS), i.frame(spark, sf, i.REGISTRY), cards, F.lit(TODAY).cast("date"))


from docspark.plans import sheet_queries, spec_queries  # noqa: E402,F401  register their queries here
