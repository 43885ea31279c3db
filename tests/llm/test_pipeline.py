"""The pipeline's stages, and the registered queries of the subpackage."""

from __future__ import annotations

import __spark_entry__ as entry
import corpus_pipeline
from llm import byte_bpe, greedy_tiling, jaccard_join, quality_rules, queries, substring_dedup
from llm.common import cut

import public_tokenizers


def test_stages_in_order(spark, sf):
    """Each stage against its operator on the stage's own input; the result against the stages one by one."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    after = [cut(corpus_pipeline.STAGES[0][1](spark, docs, sf), "t")]
    for _, stage in corpus_pipeline.STAGES[1:]:
        after.append(cut(stage(spark, after[-1], sf), "t"))
    quality, once, stripped, clean, tokens = after
    assert ids(quality) == ids(quality_rules.quality_rules(docs).where("kept"))
    assert ids(once) == ids(jaccard_join.jaccard_groups(quality).where("doc_id = component_id"))
    assert ids(stripped) == ids(once) and substring_dedup.substring_dedup(once).agg({"n_removed": "sum"}).first()[0] >= 0
    assert ids(clean) == ids(stripped) - ids(greedy_tiling.contaminations(stripped, bench))
    assert ids(tokens) == ids(clean)
    assert all(df.columns == columns for df in after[:-1])
    assert stripped.where("n_chars <> length(text)").count() == 0
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf)) == key(tokens) == key(byte_bpe.token_digests(clean, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def test_stages_on_odd_and_empty_tables(spark, sf):
    """Nulls, blanks, repeats, a very long text and a column whose name the stages use inside: each stage on all of them."""
    from test_operators import ROWS

    odd = spark.createDataFrame([(i, t, lang, "s", None, "k") for i, t, lang in ROWS], "doc_id long, text string, lang string, source string, n_chars long, key_id string").repartition(2)
    once = {i for i, _, _ in ROWS if i is not None} - {5, 7, 9}  # they say what 4, 6 and 8 say, or nearly
    want = {"quality rules": [11], "n-gram Jaccard join": [None, *once], "substring dedup": [i for i, _, _ in ROWS], "benchmark decontamination": [i for i, _, _ in ROWS], "byte-level BPE": [i for i, _, _ in ROWS]}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == odd.columns
        assert sorted((r["doc_id"] for r in out.select("doc_id").collect()), key=str) == sorted(want[name], key=str), name
        assert stage(spark, odd.limit(0), sf).count() == 0


def test_registered(spark, sf):
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {name.split("_")[0] for name in names} and "pipeline" in names
    for name in queries.QUERIES:
        # collocations are told by language, all others by row
        assert names[name](spark, sf).columns[0] == ("lang" if name.startswith("op13_") else "page_id" if name.startswith("op2_") else "doc_id")
