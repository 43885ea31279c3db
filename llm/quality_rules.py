"""Quality rules: counted rules first, then bands of n-gram perplexity for each language.

The perplexity comes from modified Kneser-Ney models of the corpus itself (``llm.kneser_ney``), counted over all documents
that pass the counted rules. Each language has two models, one of each half of its documents by the hash of the text, and a
document is scored by the half it is not in: so no text, copies included, makes itself likely, and the levels of all
documents are those of unseen ones. Where the entries pass a size check, they go to the tasks as sorted hash arrays; beyond
that, texts and entries are joined by shards. A document is rejected when its log perplexity lies outside its language's
band, from the ``TAIL`` to the 1 - ``TAIL`` quantile of the documents that pass the counted rules, by more than an allowance
for short texts, whose levels vary more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import Words, cut, joined, marked, mix, runs, slices, texts_of, _BYTE, _R, _R_INV, powers
from llm.kneser_ney import by_document, fits, gram_counts, grams_of, model_of, packed_models, sharded_scores, smoothed

ORDER = 5
#: Share of a language's documents that lie below its band, and above it.
TAIL = 0.01
#: Nats allowed beyond the band for a text of one byte; the allowance falls with the root of the length.
SHORT = 0.5
HALVES = 2
MIN_WORDS = 50
#: Stands for a null doc_id in joins.
MISSING = -(2**63)
#: Languages with fewer documents that pass the counted rules have no band.
MIN_DOCUMENTS = 20
_U = np.uint64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
COUNTS = tuple(x.split()[0] for x in BASE.split(", "))


def base_counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The five counts of each document of a slice."""
    words = Words(data, offsets)
    docs = len(offsets) - 1
    per = lambda flags, places: np.diff(np.r_[0, np.cumsum(flags)][places])
    inside = np.zeros(len(data) + 1, np.int8)
    inside[words.start] += 1
    inside[words.end] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool) if len(data) else np.zeros(0, bool)
    # ends and starts may coincide only where documents meet, where both steps cancel rightly
    chars = per(inside & ((data & 0xC0) != 0x80), offsets)
    symbols = per(_SYMBOL[data], offsets)
    # lines
    edge = np.zeros(len(data) + 1, bool)
    edge[1:] = data == 10
    edge[offsets] = True
    start = np.flatnonzero(edge[:-1])
    end = np.r_[start[1:], len(data)][: len(start)]
    end = end - ((data[end - 1] == 10) & (end > start)) if len(start) else end
    has_word = np.diff(np.r_[0, np.cumsum(inside)][np.c_[start, end]], axis=1)[:, 0] > 0
    start, end = start[has_word], end[has_word]
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * powers(_R, len(data)), out=total[1:])
    owner = np.searchsorted(offsets, start, "right") - 1
    line = mix(mix((total[end] - total[start]) * powers(_R_INV, len(data) + 1)[start]) + mix(owner.astype(_U)))
    _, at = np.unique(line, return_index=True)
    dup = np.bincount(owner, minlength=docs) - np.bincount(owner[at], minlength=docs)
    # three-word windows
    owner = np.repeat(np.arange(docs), np.diff(words.first))
    hashes = words.hashes()
    covered = np.zeros(len(hashes), bool)
    if len(hashes) >= 3:
        whole = owner[2:] == owner[:-2]
        keys = mix(runs(hashes, 3) + mix(owner[:-2].astype(_U)))
        _, back, n = np.unique(keys, return_inverse=True, return_counts=True)
        # windows across documents are left out: at most their own count is wrong, and it is not used
        again = whole & (np.bincount(back, whole)[back] > 1)
        for j in range(3):
            covered[j : len(hashes) - 2 + j] |= again
    return [np.diff(words.first), chars, symbols, dup, per(covered, words.first)]


def _passes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which documents of a slice pass the counted rules."""
    words, *_, repeated = base_counts(data, offsets)
    return (words >= MIN_WORDS) & (100 * repeated <= 50 * words)


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        data, offsets = texts_of(batch.column("text"))
        counts = [*base_counts(data, offsets), np.diff(grams_of(data, offsets, 1)[1])]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "tkey", "lang")] + [pa.array(c.astype(np.int64)) for c in counts], ["doc_id", "tkey", "lang", *COUNTS, "n_bytes"])


def _scored(sent, order: int):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {lang: model_of(data, order) for lang, data in sent.value.items()}
        for batch in slices(batches):
            data, offsets = texts_of(batch.column("text"))
            counts = base_counts(data, offsets)
            grams, places = grams_of(data, offsets, order)
            models = np.array(batch.column("model").to_pylist(), object)
            logs = np.zeros(len(grams), np.float32)
            for model in set(models) & set(held):
                mask = np.repeat(models == model, np.diff(places))
                logs[mask] = held[model].logs(grams[mask])
            n = np.diff(places)
            with np.errstate(all="ignore"):
                level = np.where(np.isin(models.astype(str), list(held)), -by_document(logs, places) / n, np.nan)
            columns = [pa.array(c.astype(np.int64)) for c in (*counts, n)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tkey"), batch.column("lang"), *columns, pa.array(np.where(np.isfinite(level), level, np.nan), from_pandas=True)], ["doc_id", "tkey", "lang", *COUNTS, "n_bytes", "level"])

    return scored


def _failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, log_perplexity of each row.

    Null and empty texts count 0 words, fail the counted rules and have no perplexity. A null language is one of its own.
    A text whose language has no band is kept if it passes the counted rules. Repeated rows are each judged and returned;
    a null doc_id is returned as null. Very long texts are counted and scored whole. Other columns are not read; an empty table
    gives an empty one.
    """
    return judged(docs).drop("tkey")


def passing(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns kept, that the rules keep."""
    verdict = judged(docs).where("not kept").select(F.coalesce("doc_id", F.lit(MISSING)).alias("key_id"), F.col("tkey").alias("key_text")).distinct()
    return joined(marked(docs), cut(verdict, "rejected"), ["key_id", "key_text"], "left_anti").select("whole.*")


def judged(docs: DataFrame) -> DataFrame:
    """``quality_rules`` with tkey, a hash of the text that tells rows apart that share a doc_id."""
    spark = docs.sparkSession
    tagged = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"), docs["text"].cast("string").alias("text"))
    half = F.pmod("tkey", F.lit(HALVES))
    named = lambda part: F.concat_ws("/", "lang", part.cast("string"))
    tagged = tagged.withColumn("tkey", F.xxhash64("text")).withColumn("model", named(HALVES - 1 - half))
    sent = None
    entries = smoothed(gram_counts(tagged.select("text", named(half).alias("lang")), ORDER, _passes), ORDER)
    if fits(entries):
        sent = spark.sparkContext.broadcast(packed_models(entries))
        rows = tagged.mapInArrow(_scored(sent, ORDER), f"doc_id long, tkey long, lang string, {BASE}, n_bytes long, level double")
    else:
        level = sharded_scores(tagged.select(F.coalesce("doc_id", F.lit(MISSING)).alias("doc_id"), "tkey", F.col("model").alias("lang"), "text"), entries, ORDER)
        level = level.select(F.col("doc_id").alias("key"), "tkey", F.col("lang").alias("model"), (-F.col("log") / F.col("n")).alias("level"))
        counted = tagged.mapInArrow(_base, f"doc_id long, tkey long, lang string, {BASE}, n_bytes long").withColumn("key", F.coalesce("doc_id", F.lit(MISSING))).withColumn("model", named(HALVES - 1 - half))
        rows = counted.join(level, ["key", "tkey", "model"], "left").select("doc_id", "tkey", "lang", *COUNTS, "n_bytes", "level")
    rows = cut(rows, "scored", texts=True)
    if sent is not None:
        sent.unpersist()
    verdict = rows.join(F.broadcast(bands(rows.where(~_failed()), TAIL)), "lang", "left").withColumn("base_failed", _failed())
    room = SHORT / F.sqrt(F.nullif(F.col("n_bytes"), F.lit(0)))
    inside = F.coalesce(F.col("level").between(F.col("low") - room, F.col("high") + room), F.lit(True))
    return verdict.select("doc_id", "tkey", *COUNTS, "base_failed", (~F.col("base_failed") & inside).alias("kept"), F.col("level").alias("log_perplexity"))


def bands(rows: DataFrame, tail: float) -> DataFrame:
    """(lang, low, high) over ``rows(lang, level)``: one row for each language with at least ``MIN_DOCUMENTS`` levels. The bounds
    are levels of documents, which lie within the band themselves."""
    found = rows.groupBy("lang").agg(F.percentile_approx("level", [tail, 1 - tail], 10_000).alias("q"), F.count("level").alias("docs"))
    return found.where(f"docs >= {MIN_DOCUMENTS}").select("lang", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
