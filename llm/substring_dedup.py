"""Substring dedup: find every passage of a given number of words that stands more than once in the corpus.

Windows of equal words have the same anchor: the least hash among their eight-word grams. Consecutive windows on one
anchor make a segment of at most 28 windows. Segments whose anchor stands once in the corpus hold nothing repeated and
leave at once; segments met whole more than once are repeated throughout. What is left - differing segments on one anchor,
as at the edges of a shared passage - goes to shards by anchor. A shard holds its distinct segments in a compressed FM-index (wavelet
matrix over the Burrows-Wheeler transform); its segments stream through it by backward search, and the matching statistics
at or above the threshold are the repeated intervals. The windows of an anchor with very many segments go to no index: they are
counted by the hash of the whole window, and those met more than once are repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.fm_index import FMIndex
from llm.common import Words, cut, drop, id_name, joined, longs, marked, mix, powers, runs, slices, text_session, texts_of, _R, _R_INV

WINDOW = 35
GRAM = 8
#: Words of one FM-index, and the distinct segments from which an anchor's windows are counted one by one.
SHARD_WORDS = 150_000
HOT_SEGMENTS = 1_000
_U = np.uint64
_PLACE = _U((1 << 24) - 1)
KEY = ["doc_id", "tkey"]


def segments(words: Words, window: int) -> tuple[np.ndarray, ...]:
    """For a slice of documents: document, first word in it, windows and anchor of each segment, and hash of its words."""
    hashes = words.hashes()
    grams = runs(hashes, GRAM)
    span = window - GRAM + 1
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, _U, _U))
    if len(hashes) < window:
        return none
    least = (grams & ~_PLACE) | (np.arange(len(grams), dtype=_U) & _PLACE)
    reach = 1
    while reach * 2 <= span:
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    place = (least & _PLACE).astype(np.int64)  # least[i]: of the window that starts at word i
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    inside = doc[: len(place)] == doc[window - 1 : window - 1 + len(place)]
    new = np.r_[True, (place[1:] != place[:-1]) | (inside[1:] != inside[:-1]) | (doc[1 : len(place)] != doc[: len(place) - 1])]
    at = np.flatnonzero(new)
    count = np.diff(np.r_[at, len(place)])
    at, count = at[inside[at]], count[inside[at]]
    total = np.zeros(len(hashes) + 1, _U)
    np.cumsum(hashes * powers(_R, len(hashes)), out=total[1:])
    body = mix((total[at + count + window - 1] - total[at]) * powers(_R_INV, len(hashes) + 1)[at] + count.astype(_U))
    # the place is known modulo 2**24, and it is at or after the window's start
    anchor = grams[at + ((place[at] - at) & int(_PLACE))]
    return doc[at], at - words.first[doc[at]], count, anchor, body


def _occurrences(window: int):
    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            doc, first, count, anchor, body = segments(Words(*texts_of(batch.column("text"))), window)
            rows = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [longs(anchor), longs(body), batch.column("doc_id").take(rows), batch.column("tkey").take(rows), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))],
                ["anchor", "body", "doc_id", "tkey", "first", "count"],
            )

    return occurrences


def _passages(window: int):
    """The words of the wanted segments, but for those of hot anchors."""

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(*texts_of(batch.column("text")))
            raw = words.data.tobytes()
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("tkey").to_pylist()
            out: list[list] = [[] for _ in range(7)]
            for d, wanted in enumerate(batch.column("wanted").to_pylist()):
                w0 = int(words.first[d])
                for x in wanted:
                    if not x["hot"]:
                        first, count = x["first"], x["count"]
                        text = raw[words.start[w0 + first] : words.end[w0 + first + count + window - 2]]
                        for column, v in zip(out, (x["anchor"], ids[d], keys[d], first, count, x["single"], text), strict=True):
                            column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["anchor", "doc_id", "tkey", "first", "count", "single", "words"])

    return passages


def _hot_windows(window: int):
    """Hash and place of each window of the wanted segments of hot anchors."""

    def hot_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(*texts_of(batch.column("text")))
            hashes = runs(words.hashes(), window)
            rows = [(d, x["first"], x["count"], x["single"]) for d, wanted in enumerate(batch.column("wanted").to_pylist()) for x in wanted if x["hot"]]
            doc, first, count, single = (np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else [()] * 4))
            at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
            doc, single = np.repeat(doc, count), np.repeat(single.astype(bool), count)
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [longs(hashes[words.first[doc] + at]), batch.column("doc_id").take(take), batch.column("tkey").take(take), pa.array(at.astype(np.int32)), pa.array(single)],
                ["key", "doc_id", "tkey", "at", "single"],
            )

    return hot_windows


def _search(window: int):
    """Shards of whole anchors, in anchor order: index their segments, stream the single ones through the index."""

    def shard(table: pa.Table) -> pa.RecordBatch:
        words = Words(*texts_of(table.column("words").cast(pa.large_binary()).combine_chunks().view(pa.large_string())))
        _, number = np.unique(words.hashes(), return_inverse=True)
        sizes = np.diff(words.first)
        begin = words.first[:-1] + np.arange(len(sizes))  # each segment is followed by a 0
        text = np.zeros(len(number) + len(sizes), np.int64)
        text[np.arange(len(number)) + np.repeat(np.arange(len(sizes)), sizes)] = number + 1
        index = FMIndex(text, window)
        single, count = table.column("single").to_numpy(zero_copy_only=False), table.column("count").to_numpy().astype(np.int64)
        asked = np.flatnonzero(single)
        row = np.repeat(asked, count[asked])
        offset = np.arange(len(row)) - np.repeat(np.cumsum(count[asked]) - count[asked], count[asked])
        hit = index.matches(text, begin[row] + offset + window - 1, window) >= window
        row, offset = row[hit], offset[hit]
        take = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [table.column("doc_id").take(take).combine_chunks(), table.column("tkey").take(take).combine_chunks(), pa.array((table.column("first").to_numpy()[row] + offset).astype(np.int32)), pa.array(np.full(len(row), window, np.int32))],
            ["doc_id", "tkey", "at", "length"],
        )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for batch in batches:
            anchor = batch.column("anchor").to_numpy()
            at = 0
            while at < batch.num_rows:
                if waiting >= SHARD_WORDS and anchor[at] != held[-1].column("anchor")[-1].as_py():
                    yield shard(pa.Table.from_batches(held))
                    held, waiting = [], 0
                room = max(1, (SHARD_WORDS - waiting) // (window + 10))
                to = min(at + room, batch.num_rows)
                to = int(np.searchsorted(anchor, anchor[to - 1], "right"))
                held.append(batch.slice(at, to - at))
                waiting += (to - at) * (window + 10)
                at = to
        if held:
            yield shard(pa.Table.from_batches(held))

    return search


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join touching intervals of one document, given in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, key, at = (batch.column(c).to_numpy() for c in ("doc_id", "tkey", "at"))
        end = at.astype(np.int64) + batch.column("length").to_numpy()
        other = np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]
        group = np.cumsum(other)
        furthest = np.maximum.accumulate(end + group * (1 << 40)) - group * (1 << 40)
        new = np.flatnonzero(other | np.r_[True, at[1:] > furthest[:-1]])
        last = np.r_[new[1:], len(doc)] - 1
        yield pa.RecordBatch.from_arrays([pa.array(doc[new]), pa.array(key[new]), pa.array(at[new].astype(np.int32)), pa.array(furthest[last].astype(np.int32))], ["doc_id", "tkey", "at", "to"])


def keyed(docs: DataFrame) -> DataFrame:
    docs = id_name(docs)
    return docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), F.xxhash64("text").alias("tkey"), "text")


def repeated_intervals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, tkey, spans): for ``keyed`` documents with repeated passages their word intervals [at, to), merged and in
    order; tkey tells rows apart that share a doc_id."""
    texts = docs.where(F.length("text") >= 2 * window - 1)
    found = cut(texts.mapInArrow(_occurrences(window), "anchor long, body long, doc_id long, tkey long, first int, count int"), "segments", texts=True)
    anchors = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("body").alias("low"), F.max("body").alias("high")).where("n > 1")
    # written first, so that the join has an exchange of its own in which a hot anchor can be split
    anchors = cut(anchors.select("anchor", (F.col("low") < F.col("high")).alias("mixed")), "anchors")
    again = cut(found.join(anchors, "anchor"), "again")
    drop(found)
    drop(anchors)
    # one row for each distinct segment of a mixed anchor; single ones are asked for, all are indexed
    bodies = again.where("mixed").groupBy("anchor", "body").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "tkey", "first", "count")).alias("one"))
    bodies = cut(bodies, "bodies")
    hot = cut(bodies.groupBy("anchor").agg(F.count("*").alias("n")).where(f"n >= {HOT_SEGMENTS}").select("anchor", F.lit(True).alias("hot")), "hot")
    wanted = joined(bodies, hot, ["anchor"], "left").select("one.doc_id", "one.tkey", F.struct("anchor", "one.first", "one.count", (F.col("n") == 1).alias("single"), F.coalesce("hot", F.lit(False)).alias("hot")).alias("w"))
    wanted = cut(wanted.groupBy(*KEY).agg(F.collect_list("w").alias("wanted")), "wanted")
    pieces = joined(texts, wanted, KEY).mapInArrow(_passages(window), "anchor long, doc_id long, tkey long, first int, count int, single boolean, words binary")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    matched = pieces.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_search(window), "doc_id long, tkey long, at int, length int")
    whole = again.where("not mixed").select(*KEY, "first", "count").unionAll(again.where("mixed").join(bodies.where("n > 1").select("anchor", "body"), ["anchor", "body"], "left_semi").select(*KEY, "first", "count"))
    # a hot anchor's windows are counted by their hash, in the tasks first: no task or index holds all rows of one
    asked = cut(wanted.where(F.exists("wanted", lambda x: x["hot"])), "asked")
    windows = cut(joined(texts, asked, KEY).mapInArrow(_hot_windows(window), "key long, doc_id long, tkey long, at int, single boolean"), "windows", texts=True)
    met = cut(windows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "met")
    counted = joined(windows.where("single"), met, ["key"], "left_semi").select(*KEY, "at", F.lit(window).alias("length"))
    spans = matched.unionAll(counted).unionAll(whole.select(*KEY, F.col("first").alias("at"), (F.col("count") + window - 1).alias("length")))
    spans = spans.repartition(parts, *KEY).sortWithinPartitions(*KEY, "at").mapInArrow(_merged, "doc_id long, tkey long, at int, to int")
    return cut(spans.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("at", "to"))).alias("spans")), "spans", texts=True)


def removal(words: Words, spans: list) -> np.ndarray:
    """Which words of a slice go, by the spans of each document (None: none)."""
    gone = np.zeros(len(words.start) + 1, np.int32)
    for d, found in enumerate(spans):
        for x in found or ():
            gone[words.first[d] + x["at"]] += 1
            gone[words.first[d] + x["to"]] -= 1
    return np.cumsum(gone)[:-1] > 0


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        words = Words(*texts_of(batch.column("text")))
        gone = removal(words, batch.column("spans").to_pylist())
        raw = words.texts()
        first = words.first.tolist()
        removed = np.r_[0, np.cumsum(gone)][words.first]
        digests = []
        for a, b in zip(first[:-1], first[1:], strict=True):
            kept = raw[a:b] if not gone[a:b].any() else [raw[i] for i in (np.flatnonzero(~gone[a:b]) + a).tolist()]
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(words.first)), pa.array(np.diff(removed)), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their repeated words; what stood between kept words stays as it was."""
    for batch in slices(batches):
        texts, spans = batch.column("text").to_pylist(), batch.column("spans").to_pylist()
        if any(spans):
            words = Words(*texts_of(batch.column("text")))
            gone = removal(words, spans)
            raw = words.data.tobytes()
            for d, found in enumerate(spans):
                if found:
                    kept = (np.flatnonzero(~gone[words.first[d] : words.first[d + 1]]) + words.first[d]).tolist()
                    parts, last = [], None
                    for i in kept:
                        parts.append(b" " if last is not None and last != i - 1 else raw[words.end[i - 1] : words.start[i]] if last is not None else b"")
                        parts.append(raw[words.start[i] : words.end[i]])
                        last = i
                    texts[d] = b"".join(parts).decode()
        yield pa.RecordBatch.from_arrays([batch.column("whole"), pa.array(texts, pa.string())], ["whole", "text"])


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row.

    Null or short texts have nothing removed; the digest of no words is that of the empty string. Repeated rows count as
    copies of each other, so their windows are repeated. Rows that share a doc_id but not the text are kept apart. A null
    doc_id is kept as null. Very long texts are read whole. Other columns are not read; an empty table gives an empty one.
    """
    text_session(docs.sparkSession)
    docs = keyed(docs)
    spans = repeated_intervals(docs, window)
    out = joined(docs, spans, KEY, "left").mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != -(2**63), F.col("doc_id")))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs``, all columns kept, with the repeated words cut out of ``text``; texts without repeats stay byte for byte."""
    text_session(docs.sparkSession)
    spans = repeated_intervals(keyed(docs), window)
    spans = spans.select(F.col("doc_id").alias("key_id"), F.col("tkey").alias("key_text"), "spans")
    rows = joined(marked(docs), spans, ["key_id", "key_text"], "left").select("whole", F.col("whole.text").cast("string").alias("text"), "spans")
    kind = T.StructType([T.StructField("whole", docs.schema), T.StructField("text", T.StringType())])
    return rows.mapInArrow(_strip, kind).select(F.col("whole").withField("text", F.col("text").cast(docs.schema["text"].dataType)).alias("whole")).select("whole.*")
