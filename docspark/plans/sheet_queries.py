"""Registered queries of blocks, rows and words of sheets; ``docspark.plans.queries`` imports them."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.functions import grammar as g
from docspark.functions import lines as ln
from docspark.operators import blocks, dataset, history, parsers, sections
from docspark.plans import inputs as i
from docspark.plans import queries
from docspark.plans.queries import query, table

#: Lines of a sheet in eight shapes, by k % 8.
SHAPES = (
    "CASE k % 8 WHEN 0 THEN 'Таблица ' || CAST(k % 5 AS STRING) || ' – Трубы' WHEN 1 THEN 'Поз. Обозначение' WHEN 2 THEN 'Наименование Кол. Примечание'"
    " WHEN 3 THEN CAST(1 + k % 90 AS STRING) || ' ТМ-' || CAST(k AS STRING) || ' Опора стальная 6' WHEN 4 THEN 'Изм. | Кол.уч | Лист | № док' WHEN 5 THEN '1 | 2 | ' || CAST(k AS STRING)"
    " WHEN 6 THEN 'Пров. Иванов' ELSE CAST(1 + k % 3 AS STRING) || ' Сварные соединения выполнить по чертежам завода' END"
)
LINES = f"SELECT doc_id, line_no, k, {SHAPES} AS line FROM (SELECT CAST(l_orderkey AS BIGINT) AS doc_id, CAST(l_linenumber AS BIGINT) AS line_no, min(l_partkey) AS k FROM {{lineitem}} GROUP BY 1, 2) l"
L = f"({i.plain(LINES)})"


def lines(spark, sf):
    return i.frame(spark, sf, LINES)


@query(f"SELECT doc_id, row_number() OVER w AS block_no, line_no AS start_line, coalesce(lead(line_no) OVER w, last + 1) - 1 AS end_line, CAST(k % 5 AS STRING) AS number FROM (SELECT *, max(line_no) OVER (PARTITION BY doc_id) AS last FROM {L}) WHERE k % 8 = 0 WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)")
def table_blocks(spark, sf):
    return blocks.table_blocks(lines(spark, sf))


@query(f"WITH n AS (SELECT *, sum(CASE WHEN k % 8 = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS c FROM {L}) SELECT doc_id, CAST(c AS BIGINT) AS chunk_no, min(line_no) AS start_line, string_agg(line, chr(10) ORDER BY line_no) AS text FROM n WHERE c > 0 GROUP BY doc_id, c")
def chunks_from_hits(spark, sf):
    return blocks.chunks_from_hits(lines(spark, sf), ln.loose_row(F.col("line"))["designation"] != "—")


@query(
    f"""WITH m AS (SELECT *, CASE k % 8 WHEN 1 THEN [1, 2] WHEN 2 THEN [3, 4, 5] WHEN 4 THEN [4] ELSE [] END AS own FROM {L}),
    a AS (SELECT *, coalesce(lead(own) OVER w, []) AS o1, coalesce(lead(own, 2) OVER w, []) AS o2, coalesce(len(lag(own) OVER w), 0) AS before, lead(line) OVER w AS l1, lead(line, 2) OVER w AS l2 FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
    n AS (SELECT *, CASE WHEN len(own) >= 3 THEN 1 WHEN len(o1) > 0 AND len(list_distinct(list_concat(own, o1))) >= 3 THEN 2 WHEN len(o1) > 0 AND len(o2) > 0 AND len(list_distinct(list_concat(own, o1, o2))) >= 3 THEN 3 END AS n_lines FROM a WHERE len(own) > 0 AND before = 0)
    SELECT doc_id, line_no, CASE n_lines WHEN 1 THEN line WHEN 2 THEN line || ' ' || l1 ELSE line || ' ' || l1 || ' ' || l2 END AS header, n_lines FROM n WHERE n_lines IS NOT NULL"""
)
def merged_headers(spark, sf):
    return blocks.merged_headers(lines(spark, sf))


@query(
    f"""WITH h AS (SELECT *, min(CASE WHEN k % 8 = 4 THEN line_no END) OVER (PARTITION BY doc_id) AS head FROM {L}), s AS (SELECT *, min(CASE WHEN k % 8 = 6 AND line_no > head THEN line_no END) OVER (PARTITION BY doc_id) AS stop FROM h)
    SELECT * FROM (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS row_no, replace(line, ' | ', '/') AS cells FROM s WHERE line_no > head AND (stop IS NULL OR line_no < stop) AND k % 8 IN (4, 5)) WHERE row_no <= 12"""
)
def revision_rows(spark, sf):
    return blocks.revision_rows(lines(spark, sf)).withColumn("cells", F.array_join("cells", "/"))


@query(f"SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS row_no FROM (SELECT doc_id, min(line_no) AS line_no FROM {L} WHERE k % 8 = 7 GROUP BY doc_id, k % 3)")
def requirements(spark, sf):
    return blocks.requirements(lines(spark, sf))


@query(f"SELECT doc_id, line_no, k % 8 IN (0, 3, 4, 6, 7) AS loose, k % 8 IN (1, 2) AS header, CASE WHEN k % 8 = 3 THEN 'ТМ-' || CAST(k AS STRING) WHEN k % 8 IN (0, 4, 6, 7) THEN '—' END AS designation, CASE WHEN k % 8 = 3 THEN '6' WHEN k % 8 IN (0, 4, 6, 7) THEN '—' END AS qty FROM {L}")
def spec_lines(spark, sf):
    told = lines(spark, sf).select("doc_id", "line_no", "line", g.once(ln.column_header(F.col("line"))).alias("header"))
    read = told.select("doc_id", "line_no", "header", g.once(ln.loose_row(F.col("line"), F.col("header"))).alias("row"))
    return read.select("doc_id", "line_no", F.col("row").isNotNull().alias("loose"), "header", F.col("row.designation").alias("designation"), F.col("row.qty").alias("qty"))


@query(
    """SELECT CAST(p_partkey AS BIGINT) AS ord, CASE p_partkey % 4 WHEN 0 THEN 'Ст3сп3' WHEN 1 THEN '' WHEN 2 THEN '' ELSE '20-К' || CAST(p_size AS STRING) END AS material, p_partkey % 3 < 2 AS token,
    p_partkey % 2 = 0 AS header, CASE p_partkey % 3 WHEN 0 THEN '1:' || CAST(10 + p_size AS STRING) WHEN 1 THEN '1:500' ELSE '' END AS scale, p_partkey % 3 = 0 AS person, p_partkey % 2 = 1 AS bom FROM part"""
)
def line_predicates(spark, sf):
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    before = F.when(k % 4 == 0, F.lit("Лист\nуголок Ст3сп3 ")).when(k % 4 == 1, F.lit("труба 25х2 ")).when(k % 4 == 2, F.lit("Болт ")).otherwise(F.concat(F.lit("полоса 20-К"), n, F.lit(" ")))
    word = F.when(k % 3 == 0, "(ГОСТ)").when(k % 3 == 1, "FOCT").otherwise("лист")
    head = F.when(k % 2 == 0, "Поз. Обозначение Наименование").otherwise("Поз. Наименование")
    scale = F.when(k % 3 == 0, F.concat(F.lit("Масштаб 1 : "), 10 + F.col("p_size"))).when(k % 3 == 1, F.lit("М 1500")).otherwise("1777 лист")
    name = F.when(k % 3 == 0, "Иванов").when(k % 3 == 1, "Иванов И").otherwise("Бвгдж")
    note = F.when(k % 2 == 1, "А. Щит управления релейного зала номер один и панели к нему").otherwise("граница проектируемого участка трубопровода")
    return table(spark, sf, "part").select(k.cast("long").alias("ord"), ln.material_before(before).alias("material"), ln.kind_token(word, F.lit("ГОСТ")).alias("token"), ln.spec_header(head).alias("header"), ln.scale_of(scale).alias("scale"), ln.person_name(name).alias("person"), ln.bom_like(note).alias("bom"))


@query("SELECT CAST(p_partkey AS BIGINT) AS ord, CAST(p_partkey % 9 AS STRING) AS pos, 'A' || CAST(p_size AS STRING) AS designation, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS STRING) ELSE '—' END AS qty, CASE WHEN p_partkey % 2 = 0 THEN '—' ELSE 'см. лист' END AS note FROM part WHERE p_partkey % 3 > 0")
def plan_to_spec(spark, sf):
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.lit("Детали")).otherwise(F.concat(F.lit("A"), F.col("p_size").cast("string"), F.lit(" "), "p_name"))
    row = ln.plan_to_spec((k % 9).cast("string"), name, F.when(k % 2 == 0, F.col("p_size").cast("string")).otherwise("см. лист"))
    return table(spark, sf, "part").select(k.cast("long").alias("ord"), row.alias("row")).where("row is not null").select("ord", "row.*")


@query("SELECT CAST(p_partkey AS BIGINT) AS ord, 'Список ' || p_brand || chr(10) || 'Поз.' || chr(9) || p_name || chr(10) || 'пункт' AS text FROM part")
def tabbed_text(spark, sf):
    raw = F.concat(F.lit("## Список "), "p_brand", F.lit("\r\n```\n| Поз. | "), "p_name", F.lit(" |\n\n- пункт\n```"))
    return table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("ord"), ln.tabbed(raw).alias("text"))


_NOTES = "SELECT CAST(l_orderkey AS BIGINT) AS doc_id, CAST(l_linenumber AS BIGINT) AS ord, min(CASE l_partkey % 5 WHEN 0 THEN 'Граница участка' WHEN 1 THEN 'граница участка работ' WHEN 2 THEN 'Ось трассы' WHEN 3 THEN 'Опора номер ' || CAST(l_partkey % 3 AS STRING) ELSE 'Трубопровод подземный' END) AS note, CAST(min(l_quantity) AS DOUBLE) AS quality FROM {lineitem} GROUP BY 1, 2"


@query()
def merged_notes(spark, sf):
    """A fold in order, tested against a loop."""
    return blocks.merged_notes(i.frame(spark, sf, _NOTES))


@query()
def merged_sections(spark, sf):
    """A fold in order, tested against a loop."""
    from docspark.plans.queries import _KEYED

    rows = i.frame(spark, sf, _KEYED).withColumns({"keys": F.split("keys", ","), "title": F.when(F.col("ord") % 3 == 0, "Т").otherwise("")})
    return blocks.merged_sections(rows).withColumns({"members": F.array_join(F.col("members").cast("array<string>"), ","), "keys": F.array_join("keys", ",")})


_DIGITS = "lower(kind) || ':' || regexp_replace(regexp_replace(ref, '^\\S+ ', ''), '\\D', '', 'g')"


@query(f"WITH r AS (SELECT *, {_DIGITS} AS key FROM <REFS>), w AS (SELECT ord, ord * 7 % 50 AS doc_id, kind, ref, key FROM r) SELECT ord, doc_id, kind, ref FROM w WHERE EXISTS (SELECT 1 FROM r WHERE r.doc_id = w.doc_id AND r.key = w.key)")
def named_in_text(spark, sf):
    wanted = i.frame(spark, sf, i.REFS).withColumn("doc_id", F.col("ord") * 7 % 50).select("ord", "doc_id", "kind", "ref")
    return blocks.named_in_text(wanted, i.frame(spark, sf, i.SOURCES))


@query(
    """WITH t AS (SELECT CAST(c_custkey AS BIGINT) AS doc_id, [CASE WHEN c_custkey % 2 = 0 THEN c_name END, c_mktsegment, ' ', 'n' || CAST(c_nationkey AS STRING)] AS every FROM customer), f AS (SELECT doc_id, list_filter(every, lambda x: trim(coalesce(x, '')) <> '') AS l FROM t)
    SELECT doc_id, unnest(range(len(l))) AS place, unnest(l) AS text FROM f"""
)
def flattened(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("doc_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("one"), F.array("c_mktsegment", F.lit(" ")).alias("many"), F.create_map(F.lit("nation"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).alias("named"))
    return blocks.flattened(c, "one", "many", "named").withColumn("place", F.col("place").cast("long"))


_ASKED = "SELECT 'ГОСТ' AS kind, CAST(p_partkey AS STRING) AS ref, CAST(step AS INT) AS step, 'q' || CAST(p_partkey * step % 997 AS STRING) AS query FROM {part}, (SELECT 1 AS step UNION ALL SELECT 2 UNION ALL SELECT 3) s"
_HITS = "SELECT 'q' || CAST(p_partkey % 997 AS STRING) AS query, p_partkey % 2 = 0 AS full, CAST(p_partkey AS BIGINT) AS row_ord, CAST(p_size AS INT) AS score FROM {part}"


@query(f'SELECT kind, ref, step, "full", row_ord, score FROM (SELECT a.kind, a.ref, a.step, h."full", h.row_ord, h.score, row_number() OVER (PARTITION BY a.kind, a.ref ORDER BY a.step, h."full", h.score DESC, h.row_ord) AS n FROM ({i.plain(_ASKED)}) a JOIN ({i.plain(_HITS).replace("AS full", "AS " + chr(34) + "full" + chr(34))}) h ON a.query = h.query WHERE h.score >= 35) WHERE n = 1')
def escalated_search(spark, sf):
    return blocks.escalated(i.frame(spark, sf, _ASKED), i.frame(spark, sf, _HITS))


@query("SELECT CAST(p_partkey AS BIGINT) AS ord, CASE WHEN p_partkey % 3 = 0 THEN 'found' WHEN p_partkey % 4 > 0 THEN 'second' WHEN p_partkey % 3 = 1 THEN 'failed' ELSE 'skipped' END AS status, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END AS pass FROM part")
def second_pass(spark, sf):
    k = F.col("p_partkey")
    refs = table(spark, sf, "part").select(k.cast("long").alias("ord"))
    first = table(spark, sf, "part").where(k % 3 < 2).select(k.cast("long").alias("ord"), F.when(k % 3 == 0, "found").otherwise("failed").alias("status"))
    again = table(spark, sf, "part").where(k % 4 > 0).select(k.cast("long").alias("ord"), F.lit("second").alias("status"))
    return blocks.second_pass(refs, first, again)


def _words(spark, sf):
    refs = i.frame(spark, sf, i.REFS)
    words = refs.select("doc_id", F.lit(1).cast("long").alias("page_no"), F.col("ord").alias("part"), F.posexplode(F.split(F.concat("ref", F.lit(" лист")), " ")).alias("pos", "text"))
    box = {"x0": (F.col("part") % 3 * 40 + F.col("pos") * 10).cast("double"), "x1": (F.col("part") % 3 * 40 + F.col("pos") * 10 + 9).cast("double"), "y0": F.lit(5.0), "y1": F.lit(9.0)}
    return refs, words.withColumn("ord", F.col("part") * 10 + F.col("pos")).withColumns(box).drop("part", "pos")


@query("SELECT doc_id, CAST(1 AS BIGINT) AS page_no, kind, ref, ord * 10 AS first, ord * 10 + len(string_split(ref, ' ')) - 1 AS last FROM <REFS>")
def spans_of_words(spark, sf):
    refs, words = _words(spark, sf)
    return blocks.spans_of_words(words, refs)


@query("SELECT doc_id, CAST(1 AS BIGINT) AS page_no, ref, count(*) AS hits, count(DISTINCT ord % 3) AS boxes FROM <REFS> GROUP BY doc_id, ref")
def highlight_counts(spark, sf):
    refs, words = _words(spark, sf)
    return blocks.highlights(blocks.spans_of_words(words, refs), words)


@query("WITH n AS (SELECT l_orderkey % 40 AS doc_id, l_linenumber AS source_ord, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT doc_id, source_ord, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n < 40, CASE WHEN n >= 40 THEN 0 ELSE -n END, source_ord) AS r FROM n) WHERE r = 1")
def best_words(spark, sf):
    return blocks.best_words(i.frame(spark, sf, "SELECT l_orderkey % 40 AS doc_id, l_linenumber AS source_ord FROM {lineitem}"))


@query("SELECT doc_id, ord, x0 - 5 AS x0, y0 - 5 AS y0, x1 + 5 AS x1, y1 + 5 AS y1 FROM <BOXES> WHERE x1 - x0 > 0 AND x1 - x0 <= 32 AND (x1 - x0) * 5 <= 32 * 7 * 1.8")
def pinpointed(spark, sf):
    return blocks.pinpointed(i.frame(spark, sf, i.BOXES).withColumns({"width": F.lit(100.0), "height": F.lit(100.0)}))


@query(
    """WITH p AS (SELECT o_orderkey AS doc_id, CAST(800 + o_orderkey % 400 AS DOUBLE) AS w, CAST(500 + o_custkey % 300 AS DOUBLE) AS h, 1 + o_orderkey % 15 AS n FROM orders),
    g AS (SELECT *, unnest([0, 1, 2, 3]) AS c FROM p WHERE n <= 4)
    SELECT doc_id, 'spec_right' AS zone, round(w * 0.46, 6) AS x0, round(h * 0.22, 6) AS y0, round(w, 6) AS x1, round(h * 0.96, 6) AS y1 FROM p WHERE n <= 12 AND w / h >= 1.35
    UNION ALL SELECT doc_id, 'supp_notes_' || c // 2 || '_' || c % 2, round(w * 0.02 + CASE WHEN c % 2 = 1 THEN w * 0.48 * 0.86 ELSE 0 END, 6), round(h * 0.28 + CASE WHEN c > 1 THEN h * 0.345 * 0.86 ELSE 0 END, 6),
        round(w * 0.98 - CASE WHEN c % 2 = 0 THEN w * 0.48 * 0.86 ELSE 0 END, 6), round(h * 0.97 - CASE WHEN c < 2 THEN h * 0.345 * 0.86 ELSE 0 END, 6) FROM g"""
)
def supplement_zones(spark, sf):
    pages = i.frame(spark, sf, "SELECT o_orderkey AS doc_id, 1 AS page_no, CAST(800 + o_orderkey % 400 AS DOUBLE) AS width, CAST(500 + o_custkey % 300 AS DOUBLE) AS height, 1 + o_orderkey % 15 AS n_pages FROM {orders}")
    return blocks.supplement_zones(pages).select("doc_id", "zone", *(F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query("SELECT o_custkey AS doc_id, count(*) AS total, count(*) FILTER (o_orderkey % 2 = 0) AS found_a, count(*) FILTER (o_orderkey % 3 = 0) AS found_b, count(*) FILTER (o_orderkey % 5 < 2) AS active FROM orders GROUP BY 1")
def rendered_summary(spark, sf):
    k = F.col("o_orderkey")
    cell = lambda text, href: F.struct(text.alias("text"), href.alias("href"))
    empty = cell(F.lit("x"), F.lit(None).cast("string"))
    link = lambda ok: cell(F.lit("x"), F.when(ok, "http://x"))
    last = cell(F.when(k % 5 == 0, "Актуален").when(k % 5 == 1, "частично актуален").otherwise("отменён"), F.lit(None).cast("string"))
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.array(empty, empty, link(k % 2 == 0), link(k % 3 == 0), *[empty] * 4, last).alias("cells"))
    return blocks.rendered_summary(rows)


@query("SELECT zone, count(*) AS n, count(DISTINCT stem) AS stems FROM <LABELS> GROUP BY 1")
def label_counts(spark, sf):
    return dataset.label_counts(i.frame(spark, sf, i.LABELS))


@query("SELECT c_nationkey AS run, count(*) AS files, sum(c_custkey % 7) AS n_rows, count(*) FILTER (c_custkey % 7 > 0) AS with_rows, count(*) FILTER (c_custkey % 4 > 0) AS ok, round(sum(c_acctbal), 4) AS seconds FROM customer GROUP BY 1")
def run_summary(spark, sf):
    k = F.col("c_custkey")
    facts = table(spark, sf, "customer").select(F.col("c_nationkey").alias("run"), (k % 7).alias("n_rows"), (k % 4 > 0).alias("ok"), F.col("c_acctbal").alias("seconds"))
    return dataset.run_summary(facts).withColumn("seconds", F.round("seconds", 4))


_T = "greatest(1, length(text) // 3)"


@query(
    f"""WITH m AS (SELECT conv_id, turn, role, {_T} AS t, role = 'user' AND turn % 4 = 0 AS doc FROM <MESSAGES> WHERE role <> 'summary'),
    a AS (SELECT *, max(CASE WHEN doc THEN turn END) OVER p AS last, sum(t) OVER p AS total, count(*) OVER p AS n, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prior FROM m WINDOW p AS (PARTITION BY conv_id)),
    b AS (SELECT *, coalesce(turn = last OR (prior = last AND role = 'assistant'), false) AS anchor FROM a),
    c AS (SELECT *, sum(CASE WHEN anchor THEN t ELSE 0 END) OVER (PARTITION BY conv_id) AS held, sum(CASE WHEN anchor THEN 0 ELSE t END) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM b)
    SELECT conv_id, turn, anchor FROM c WHERE anchor OR total <= 300 OR n <= 4 OR 300 - held - used >= 100"""
)
def token_budget_anchors(spark, sf):
    m = i.frame(spark, sf, i.MESSAGES).withColumn("extracted", F.when(F.col("turn") % 4 == 0, "body"))
    return history.kept_messages(m, 300).select("conv_id", "turn", "anchor")


_FOLD = "left(regexp_replace(lower({c}), '[^0-9a-zа-яё_]+', ' ', 'g'), 140)"


@query(
    f"""WITH n AS (SELECT p_partkey AS ord, p_partkey % 50 AS doc_id, CASE p_partkey % 3 WHEN 0 THEN 'пора ' || p_name || ', скользящая' WHEN 1 THEN p_name ELSE 'Ряд: «' || p_name || '» на опорах и ещё раз на опорах' END AS note FROM part),
    r AS (SELECT p_partkey % 50 AS doc_id, CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE 'Опора ' || p_name || ' скользящая' END AS name FROM part WHERE p_partkey % 2 = 0),
    a AS (SELECT *, {_FOLD.format(c='note')} AS f FROM n), b AS (SELECT *, {_FOLD.format(c='name')} AS f FROM r)
    SELECT ord, doc_id, note FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = a.doc_id AND length(a.f) >= 10 AND b.f <> '' AND (a.f = b.f OR (length(a.f) >= 20 AND (contains(b.f, a.f) OR contains(a.f, b.f)))))"""
)
def notes_beyond_spec(spark, sf):
    notes = i.frame(spark, sf, "SELECT p_partkey AS ord, p_partkey % 50 AS doc_id, CASE p_partkey % 3 WHEN 0 THEN 'пора ' || p_name || ', скользящая' WHEN 1 THEN p_name ELSE 'Ряд: «' || p_name || '» на опорах и ещё раз на опорах' END AS note FROM {part}")
    rows = i.frame(spark, sf, "SELECT p_partkey % 50 AS doc_id, CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE 'Опора ' || p_name || ' скользящая' END AS name FROM {part} WHERE p_partkey % 2 = 0")
    return sections.beyond_spec(notes, rows)


# ---------------------------------------------------------------- whole sheets

_TITLED = LINES.replace("'Пров. Иванов'", "'Ведомость трубопроводов участка'")
_SHEETS = f"SELECT doc_id, array_join(transform(array_sort(collect_list(struct(line_no, line))), x -> x.line), '\n') AS text FROM ({LINES}) GROUP BY doc_id"


@query(
    f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n, CASE k % 8 WHEN 1 THEN 'specification' WHEN 7 THEN 'legend' END AS kind FROM {L}),
    a AS (SELECT *, lag(kind) OVER w AS before FROM l WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    s AS (SELECT doc_id, 'anchor' AS found_by, row_number() OVER w AS section_no, kind, i AS start_line, coalesce(lead(i) OVER w, n) - i AS n_lines FROM a WHERE before IS NULL OR before <> kind WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    t AS (SELECT doc_id, 'label' AS found_by, row_number() OVER w AS section_no, 'table' AS kind, i AS start_line, coalesce(lead(i) OVER w, n) - i AS n_lines FROM l WHERE k % 8 = 0 AND doc_id NOT IN (SELECT doc_id FROM s) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    b AS (SELECT * FROM s UNION ALL SELECT * FROM t)
    SELECT * FROM b UNION ALL SELECT doc_id, 'whole', 1, 'table', 0, n FROM l WHERE i = 0 AND doc_id NOT IN (SELECT doc_id FROM b)"""
)
def discovered_sections(spark, sf):
    return parsers.discovered(i.frame(spark, sf, _SHEETS), {"specification": r"^Поз\.", "legend": "Сварные"})


@query(
    f"""WITH m AS (SELECT *, CASE k % 8 WHEN 1 THEN [1, 2] WHEN 2 THEN [3, 4, 5] WHEN 4 THEN [4] ELSE [] END AS own FROM {L}),
    a AS (SELECT *, coalesce(lead(own) OVER w, []) AS o1, coalesce(lead(own, 2) OVER w, []) AS o2, coalesce(len(lag(own) OVER w), 0) AS before FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
    n AS (SELECT *, CASE WHEN len(own) >= 3 THEN 1 WHEN len(o1) > 0 AND len(list_distinct(list_concat(own, o1))) >= 3 THEN 2 WHEN len(o1) > 0 AND len(o2) > 0 AND len(list_distinct(list_concat(own, o1, o2))) >= 3 THEN 3 END AS n_lines FROM a WHERE len(own) > 0 AND before = 0),
    h AS (SELECT doc_id, min(line_no) AS head_line, min_by(n_lines, line_no) AS n_lines FROM n WHERE n_lines IS NOT NULL GROUP BY 1)
    SELECT doc_id, line_no, CASE WHEN k % 8 = 3 THEN 'ТМ-' || CAST(k AS STRING) ELSE '—' END AS designation, CASE WHEN k % 8 = 3 THEN 'Опора стальная' ELSE substr(line, 3) END AS name, CASE WHEN k % 8 = 3 THEN '6' ELSE '—' END AS qty FROM {L} JOIN h USING (doc_id) WHERE line_no >= head_line + n_lines AND k % 8 IN (3, 7)"""
)
def specification_rows(spark, sf):
    return parsers.specification(lines(spark, sf)).select("doc_id", "line_no", "designation", "name", "qty")


@query(
    f"""WITH l AS (SELECT *, sum(CASE WHEN k % 8 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS block_no FROM ({i.plain(_TITLED)})), h AS (SELECT *, sum(CASE WHEN k % 8 IN (1, 2) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, block_no ORDER BY line_no) AS heads FROM l WHERE block_no > 0)
    SELECT doc_id, CAST(block_no AS BIGINT) AS block_no, max(CASE WHEN k % 8 = 0 THEN CAST(k % 5 AS STRING) END) AS number, coalesce(string_agg(CASE WHEN k % 8 = 6 AND heads = 0 THEN line END, ' ' ORDER BY line_no), '') AS title FROM h GROUP BY 1, 2"""
)
def titles_of_blocks(spark, sf):
    return parsers.titles_of_blocks(i.frame(spark, sf, _TITLED))


_SIGNED = "SELECT CAST(l_orderkey AS BIGINT) AS doc_id, CAST(l_linenumber AS BIGINT) AS line_no, min(CASE l_partkey % 5 WHEN 0 THEN '| Разраб. | Иванов | | 11.25 |' WHEN 1 THEN '| Петрова | Н. контр. | 12.24' WHEN 2 THEN 'ГИП | 123 | -' WHEN 3 THEN 'Утв. Сидоров' ELSE '1 | 2 | Лист' END) AS line FROM {lineitem} GROUP BY 1, 2"


@query(f"SELECT doc_id, min(line_no) AS line_no, CASE WHEN line LIKE '%Разраб%' THEN 'Разраб.' ELSE 'Н. контр.' END AS role, CASE WHEN line LIKE '%Разраб%' THEN 'Иванов' ELSE 'Петрова' END AS name, CASE WHEN line LIKE '%Разраб%' THEN '11.25' ELSE '12.24' END AS date FROM ({i.plain(_SIGNED)}) WHERE line LIKE '%Разраб%' OR line LIKE '%контр%' GROUP BY doc_id, line")
def signature_rows(spark, sf):
    return parsers.signatures(i.frame(spark, sf, _SIGNED))


@query("SELECT o_custkey AS doc_id, count(*) FILTER (o_orderkey % 3 > 0) >= 2 AND count(*) FILTER (o_orderkey % 4 = 0) >= 1 AND count(*) FILTER (o_orderkey % 5 = 0) <= 3 AS usable FROM orders GROUP BY 1")
def usable_stamps(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("k"))
    fields = o.select("doc_id", F.when(F.col("k") % 3 == 0, "Шифр").otherwise("Лист").alias("field"), F.when(F.col("k") % 3 == 0, "34-43-10001-78").otherwise("7").alias("value"))
    signed = o.select("doc_id", F.when(F.col("k") % 4 == 0, "Иванов").otherwise("подп.").alias("name"))
    return parsers.usable_blocks(fields, signed, o.where("k % 5 = 0").select("doc_id", F.lit("Т").alias("title")))


@query(
    """SELECT CAST(p_partkey AS BIGINT) AS ord, p_partkey % 5 IN (0, 4) AS legend, CASE p_partkey % 3 WHEN 0 THEN 'Опора скользящая' ELSE '—' END AS name, CASE p_partkey % 4 WHEN 0 THEN 'legend' WHEN 1 THEN 'specification' WHEN 2 THEN 'explication' ELSE 'table' END AS kind,
    CASE WHEN p_partkey % 2 = 0 THEN p_name WHEN p_partkey % 4 = 1 THEN 'Опора стальная' END AS column_name, regexp_replace(p_name, ' ', '+', 'g') AS encoded FROM part"""
)
def sheet_predicates(spark, sf):
    k = F.col("p_partkey")
    line = F.when(k % 5 == 0, "граница проектируемого участка").when(k % 5 == 1, "бвгджз кровля").when(k % 5 == 2, "Наименование Кол. Примечание").when(k % 5 == 3, "трубa подземная").otherwise("ось подземной трассы")
    raw = F.when(k % 3 == 0, " - Опора   скользящая |").when(k % 3 == 1, "support").otherwise("Масса ед.")
    kind = ln.section_kind(F.when(k % 4 == 0, "legend").otherwise("table"), F.when(k % 4 == 1, "Перечень аппаратуры").otherwise("Т"), F.lit(0), F.when(k % 4 == 2, 5).otherwise(0), F.lit(9))
    row = F.when(k % 2 == 0, F.create_map(F.lit("Наименование"), F.col("p_name"))).when(k % 4 == 1, F.create_map(F.lit("note"), F.lit("7 Опора стальная"))).otherwise(F.create_map(F.lit("note"), F.lit("12")))
    return i.frame(spark, sf, "SELECT p_partkey, p_name FROM {part}").select(k.cast("long").alias("ord"), ln.legend_line(line).alias("legend"), ln.bom_name(raw).alias("name"), kind.alias("kind"), ln.spec_columns(row)["name"].alias("column_name"), F.url_encode("p_name").alias("encoded"))


@query(f"SELECT doc_id, kind, min(ord) AS ord FROM ({i.plain(queries._SECTIONS)}) WHERE kind IN ('explication', 'legend') GROUP BY 1, 2")
def first_sections(spark, sf):
    return parsers.first_sections(i.frame(spark, sf, queries._SECTIONS)).select("doc_id", "kind", "ord")


@query("SELECT doc_id, line_no AS tile_no, CASE WHEN length(trim(line)) = 0 THEN trim('read ' || line) WHEN length(trim(line)) < 120 THEN trim(line) || chr(10) || chr(10) || trim('read ' || line) ELSE trim(line) END AS text FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)")
def tile_texts(spark, sf):
    tiles = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("tile_no", "layer")).withColumn("ocr", F.concat(F.lit("read "), "layer"))
    return parsers.tile_texts(tiles).withColumn("tile_no", F.col("tile_no").cast("long"))


@query("SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY round(y0), x0, ord) AS place FROM (SELECT DISTINCT ON (doc_id, ord) * FROM <BOXES> ORDER BY doc_id, ord, x0)")
def ordered_words(spark, sf):
    boxes = i.frame(spark, sf, i.BOXES).groupBy("doc_id", "page_no", "ord").agg(F.min_by(F.struct("x0", "y0"), "x0").alias("b")).select("doc_id", "page_no", "ord", "b.*")
    return parsers.ordered_words(boxes).select("doc_id", "ord", "place")


_WORDS = "SELECT word, count(*) AS n FROM (SELECT explode(split(p_name, ' ')) AS word FROM {part}) w GROUP BY word"


@query(
    """WITH d AS (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1), w AS (SELECT DISTINCT left(word, 2) || 'q' || substr(word, 4) AS word FROM d UNION SELECT DISTINCT word || 'x' FROM d),
    p AS (SELECT w.word, d.word AS suggestion, levenshtein(w.word, d.word) AS distance, n FROM w JOIN d ON levenshtein(w.word, d.word) <= 1 WHERE w.word NOT IN (SELECT word FROM d))
    SELECT word, suggestion, distance FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, n DESC, suggestion) AS k FROM p) WHERE k = 1"""
)
def suggestions(spark, sf):
    known = i.frame(spark, sf, _WORDS)
    misread = known.select(F.concat(F.left("word", F.lit(2)), F.lit("q"), F.substr("word", F.lit(4))).alias("word")).unionByName(known.select(F.concat("word", F.lit("x")).alias("word")))
    return parsers.suggestions(misread, known)
