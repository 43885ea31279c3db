"""Plans of tiles: order and number of jobs, texts of pages and documents, words of two layers."""

from __future__ import annotations

import pytest

from docspark.operators import tile_plan


@pytest.fixture(scope="module")
def plan(spark):
    rows = [(1, 1, 1000.0, 800.0), (2, 1, 2384.0, 842.0), *((3, p, 595.0, 842.0) for p in range(1, 6)), *((4, p, 1400.0, 1000.0) for p in range(1, 14)), (5, 1, 945.0, 700.0), (6, 1, 30.0, 30.0)]
    return tile_plan.jobs(spark.createDataFrame(rows, "doc_id long, page_no long, width double, height double")).cache()


def zones(plan, doc, page=1):
    return [r["zone"] for r in plan.where(f"doc_id = {doc} and page_no = {page}").orderBy("job_no").collect()]


def test_jobs_in_order(plan):
    notes = [f"supp_notes_{r}_{c}" for r in (0, 1) for c in (0, 1)]
    assert zones(plan, 1) == notes + [f"tile_{r}_{c}" for r in (1, 0) for c in (3, 2, 1, 0)]
    assert zones(plan, 2) == ["spec_right", *notes] + [f"tile_{r}_{c}" for c in (3, 2, 1, 0) for r in (1, 0)]
    assert zones(plan, 3, 5) == [f"tile_{r}_{c}" for r in (1, 0) for c in (2, 1, 0)]  # five pages: no zones on upright sheets
    assert zones(plan, 4, 13) == ["tile_0_0"] and zones(plan, 5)[0] == "spec_right" and zones(plan, 6) == []


def test_wide_sheets_overlap_more(plan):
    one = {r["zone"]: r for r in plan.where("doc_id in (1, 2)").collect() if r["doc_id"] == 1}
    two = {r["zone"]: r for r in plan.where("doc_id = 2").collect()}
    assert one["tile_0_0"]["x1"] == pytest.approx(250 * 1.12) and two["tile_0_0"]["x1"] == pytest.approx(596 * 1.18)


def test_the_most_pages(spark):
    pages = spark.createDataFrame([(1, p, 1000.0, 1000.0) for p in range(9)], "doc_id long, page_no long, width double, height double")
    got = tile_plan.jobs(pages, most_pages=1).collect()
    assert {r["page_no"] for r in got} == {0} and len(got) == 12  # a document of one page: four parts of the notes, eight tiles


def test_texts_of_pages_and_documents(spark, plan):
    texts = [(1, 1, "tile_1_3", "б"), (1, 1, "tile_0_0", "а"), (1, 1, "supp_notes_0_0", "а"), (1, 1, "tile_1_2", " "), (1, 1, "tile_1_1", None), (3, 1, "tile_0_0", "в"), (3, 2, "tile_1_0", "в"), (3, 2, "tile_0_0", "г"), (9, 1, "tile_0_0", "д")]
    df = spark.createDataFrame(texts, "doc_id long, page_no long, zone string, text string")
    got = {(r["doc_id"], r["page_no"]): (r["text"], r["n_texts"]) for r in tile_plan.page_texts(plan, df).collect()}
    assert got == {(1, 1): ("а\n\nб", 2), (3, 1): ("в", 1), (3, 2): ("в\n\nг", 2)}
    assert sorted(tuple(r) for r in tile_plan.sources(plan, df).collect()) == [(1, 1, "а"), (1, 2, "б"), (3, 1, "в"), (3, 2, "г")]


def test_words_of_two_layers(spark):
    kind = "doc_id long, page_no long, text string, x0 double, y0 double, x1 double, y1 double"
    layer = spark.createDataFrame([(1, 1, "ГОСТ", 0.0, 0.0, 10.0, 5.0), (2, 1, "ГОСТ", 0.0, 0.0, 10.0, 5.0)], kind)
    read = spark.createDataFrame([(1, 1, "ГОСТ", 0.5, 0.0, 10.5, 5.0), (1, 1, "ТУ", 20.0, 0.0, 30.0, 5.0), (2, 1, "ТУ", 0.0, 0.0, 10.0, 5.0)], kind)
    got = tile_plan.page_words(layer, read, spark.createDataFrame([(1, 1)], "doc_id long, page_no long"))
    assert sorted((r["doc_id"], r["text"], r["x0"]) for r in got.collect()) == [(1, "ГОСТ", 0.0), (1, "ТУ", 20.0), (2, "ТУ", 0.0)]
