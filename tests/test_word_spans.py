"""Spans of references among words: each pass, lines, and what is no span."""

from __future__ import annotations

import pytest

from docspark.operators import word_spans

G, T, D = ("ГОСТ", "ГОСТ 10704-91"), ("ТУ", "ТУ 6-21-51-90"), ("РД", "РД 34.03.304-67")
#: Words as (line, text), the reference, the spans (first, last, pass).
PAGES = {
    1: ([(0, "по"), (0, "ГОСТ10704-91"), (0, "и")], G, [(1, 1, 1)]),
    2: ([(0, "(ГОСТ"), (0, "10704-91)"), (0, "трубы")], G, [(0, 1, 2)]),
    3: ([(0, "FOCT"), (0, "10704"), (0, "-91")], G, [(0, 1, 2), (0, 2, 2)]),
    4: ([(0, "ГОСТ"), (0, "на"), (0, "трубы"), (0, "10704-91")], G, [(0, 3, 3)]),
    5: ([(0, "ГОСТ"), *[(0, "а")] * 4, (0, "10704-91")], G, [(0, 5, 3)]),
    6: ([(0, "ГОСТ"), *[(0, "а")] * 5, (0, "10704-91")], G, []),
    7: ([(0, "ГОСТ"), (1, "10704-91")], G, []),
    8: ([(0, "10704-91")], G, []),
    9: ([(0, "6-21-51-90")], T, [(0, 0, 4)]),
    10: ([(0, "PA"), (0, "34.03.304-87")], D, [(0, 1, 4)]),
    11: ([(0, "34.03.304-87")], D, [(0, 0, 4)]),
    12: ([(0, "РД"), (0, "а"), (0, "а"), (0, "а"), (0, "34.03.304-87")], D, [(4, 4, 4)]),
    13: ([(0, "ГОСТ"), (0, "10704-91,"), (1, "ГОСТ"), (1, "10704-91")], G, [(0, 1, 2), (2, 3, 2)]),
    14: ([(0, "ГОСТ"), (0, "ГОСТ"), (0, "10704-91")], G, [(1, 2, 2)]),
    15: ([], G, []),
}


def test_spans_pass_by_pass(spark):
    rows = [(d, 1, n, 10.0 * n, 20.0 * line, 10.0 * n + 9, 20.0 * line + 8, text) for d, (words, *_) in PAGES.items() for n, (line, text) in enumerate(words)]
    words = spark.createDataFrame(rows, "doc_id long, page_no long, ord long, x0 double, y0 double, x1 double, y1 double, text string")
    refs = spark.createDataFrame([(d, *ref) for d, (_, ref, _) in PAGES.items()], "doc_id long, kind string, ref string")
    got: dict = {d: [] for d in PAGES}
    for r in word_spans.line_spans(words, refs).collect():
        got[r["doc_id"]].append((r["first"], r["last"], r["found_by"]))
    assert {d: sorted(s) for d, s in got.items()} == {d: want for d, (*_, want) in PAGES.items()}


@pytest.mark.parametrize(("a", "b", "same"), [((0, 8), (3.4, 11.4), True), ((0, 8), (4.5, 12.5), False), ((0, 20), (10, 30), True), ((0, 20), (12, 32), False)])
def test_words_of_one_line(spark, a, b, same):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(*map(float, a), *map(float, b))], "a0 double, a1 double, b0 double, b1 double")
    one, two = (F.struct(F.col(f"{c}0").alias("y0"), F.col(f"{c}1").alias("y1")) for c in "ab")
    assert df.select(word_spans.on_line(one, two)).first()[0] is same
