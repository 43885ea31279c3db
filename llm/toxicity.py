"""Toxicity by a factorization machine over hashed terms.

Terms are the distinct words of a text and their first 4, 5 and 6 bytes, hashed to a fixed number of buckets. The machine
adds, for each pair of terms present, the inner product of their factors to the linear weights, so an insult beside the
mention of a group weighs more than both alone, also where neither tells anything by itself: every bucket that stands in some
sampled documents gets a weight and factors, whatever their labels. The terms to which these fits gave the largest weights and
factors are fitted once more, without the others, which mostly tell single documents apart. Both fits are made in numpy, in one
task, on a bounded sample of the labelled documents; scoring reads every document once, where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import Words, cut, joined, mix, slices, text_session, texts_of, _BYTE, _R, _R_INV, powers
from llm.greedy_tiling import _BETWEEN

BUCKETS = 1 << 20
PREFIXES = (4, 5, 6)
#: Labelled documents of either label to learn from at most; taken by the hash of doc_id.
MAX_PER_LABEL = 6_000
#: Terms of fewer sampled documents, or of a lesser share of them, have no weights: they would only tell these documents apart.
LEAST_DOCUMENTS, LEAST_SHARE = 3, 0.003
#: Terms that are fitted again: those with the largest weight and factors of the first fit, linear or in pairs.
MAX_TERMS = 2048
FACTORS = 8
FIRST_EPOCHS, EPOCHS, BATCH = 4, 15, 128
#: Pull of weights and factors towards zero.
PULL = 1e-4
THRESHOLD = 0.3
_U = np.uint64


def terms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Document and bucket of each term of a slice; repeats are left in."""
    words = Words(*texts_of(pc.utf8_lower(column)), separators=_BETWEEN)
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    total = np.zeros(len(words.data) + 1, _U)
    np.cumsum(_BYTE[words.data] * powers(_R, len(words.data)), out=total[1:])
    inverse = powers(_R_INV, len(words.data) + 1)
    docs, hashes = [doc], [mix((total[words.end] - total[words.start]) * inverse[words.start])]
    for p in PREFIXES:
        at = np.flatnonzero(words.end - words.start >= p)
        start = words.start[at]
        docs.append(doc[at])
        hashes.append(mix((total[start + p] - total[start]) * inverse[start] + _U(p)))
    return np.concatenate(docs), (np.concatenate(hashes) >> _U(44)).astype(np.int64)


def _term_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        doc, bucket = terms_of(batch.column("text"))
        both = np.unique(doc * BUCKETS + bucket)
        doc, bucket = both // BUCKETS, both % BUCKETS
        places = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(bucket.astype(np.int32)))], ["doc_id", "toxic", "terms"])


class Machine:
    """A fitted factorization machine: bias, the buckets with weights, their weights and factors."""

    def __init__(self, bias: float, buckets: np.ndarray, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.buckets, self.weights, self.factors = bias, buckets, weights, factors

    @classmethod
    def fit(cls, lists: list[np.ndarray], labels: np.ndarray, positives: float, epochs: int = EPOCHS, seed: int = 7) -> Machine:
        """Logistic loss by AdaGrad over mini-batches of the distinct terms of each document; only the terms of a batch are read
        and changed. ``positives``: share of label 1 outside the sample."""
        n, y = len(lists), labels.astype(np.float32)
        doc = np.repeat(np.arange(n), [len(x) for x in lists])
        buckets, term, count = np.unique(np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64), return_inverse=True, return_counts=True)
        wide = count >= max(LEAST_DOCUMENTS, LEAST_SHARE * n)
        doc, term, buckets = doc[wide[term]], (np.cumsum(wide) - 1)[term[wide[term]]].astype(np.int32), buckets[wide]
        m = len(buckets)
        if not m or y.sum() in (0, n):
            return cls(float(np.log((positives + 1e-6) / (1 - positives + 1e-6))), buckets[:0], np.zeros(0, np.float32), np.zeros((0, FACTORS), np.float32))
        ones, zeros = float(y.sum()), float(n - y.sum())
        places = np.searchsorted(doc, np.arange(n + 1))
        rng = np.random.default_rng(seed)
        bias, w, v = float(np.log(ones / zeros)), np.zeros(m, np.float32), rng.normal(0, 0.02, (m, FACTORS)).astype(np.float32)
        gb, gw, gv = 1e-3, np.full(m, 1e-3, np.float32), np.full((m, FACTORS), 1e-3, np.float32)
        order = rng.permutation(np.flatnonzero(np.diff(places)))
        batches = []
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            size = places[rows + 1] - places[rows]
            own = np.concatenate([term[places[d] : places[d + 1]] for d in rows])
            used, back = np.unique(own, return_inverse=True)
            by_term = np.argsort(back, kind="stable")
            # rows, terms in use, each entry's term, where rows begin; and by term: each entry's row, where terms begin
            batches.append((rows, used, back, np.cumsum(size) - size, np.repeat(np.arange(len(rows)), size)[by_term], np.searchsorted(back[by_term], np.arange(len(used)))))
        for _ in range(epochs):
            for k in rng.permutation(len(batches)):
                rows, used, back, begin, row, first = batches[k]
                wu, vu = w[used], v[used]
                s = np.add.reduceat(vu[back], begin)
                z = bias + np.add.reduceat(wu[back], begin) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vu * vu).sum(1)[back], begin))
                g = ((1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[rows]) / len(rows)).astype(np.float32)
                of_term = np.add.reduceat(g[row], first)
                dw = of_term + PULL * wu
                dv = np.add.reduceat((g[:, None] * s)[row], first) - of_term[:, None] * vu + PULL * vu
                gb += float(g.sum()) ** 2
                gw[used] += dw * dw
                gv[used] += dv * dv
                bias -= 0.1 * float(g.sum()) / gb**0.5
                w[used] -= 0.1 * dw / np.sqrt(gw[used])
                v[used] -= 0.05 * dv / np.sqrt(gv[used])
        # the sample holds the labels in other shares than the documents
        bias += np.log(max(positives, 1e-6) / max(1 - positives, 1e-6)) - np.log(ones / zeros)
        return cls(float(bias), buckets, w, v)

    @classmethod
    def fit_strongest(cls, lists: list[np.ndarray], labels: np.ndarray, positives: float, epochs: int = EPOCHS) -> Machine:
        """Fit all terms, then the strongest alone."""
        every = cls.fit(lists, labels, positives, FIRST_EPOCHS)
        if len(every.buckets) <= MAX_TERMS:
            return cls.fit(lists, labels, positives, epochs)
        strength = np.abs(every.weights) + np.linalg.norm(every.factors, axis=1)
        kept = np.zeros(BUCKETS, bool)
        kept[every.buckets[np.argsort(-strength, kind="stable")[:MAX_TERMS]]] = True
        return cls.fit([x[kept[x]] for x in lists], labels, positives, epochs)

    def table(self) -> np.ndarray:
        where = np.full(BUCKETS, -1, np.int32)
        where[self.buckets] = np.arange(len(self.buckets))
        return where

    def scores(self, doc: np.ndarray, bucket: np.ndarray, docs: int, where: np.ndarray) -> np.ndarray:
        at = where[bucket]
        hit = at >= 0
        both = np.unique(doc[hit] * (len(self.buckets) + 1) + at[hit])
        doc, at = both // (len(self.buckets) + 1), both % (len(self.buckets) + 1)
        z = np.full(docs, self.bias)
        z += np.bincount(doc, self.weights[at], docs)
        for f in range(self.factors.shape[1]):
            v = self.factors[at, f].astype(np.float64)
            z += 0.5 * (np.bincount(doc, v, docs) ** 2 - np.bincount(doc, v * v, docs))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def packed(self) -> dict:
        return {"bias": self.bias, "buckets": self.buckets.astype("<i8").tobytes(), "weights": self.weights.astype("<f4").tobytes(), "factors": self.factors.astype("<f4").tobytes()}


def _fitted(positives: float):
    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, labels = [], []
        for batch in batches:
            terms = batch.column("terms")
            flat, places = terms.flatten().to_numpy(), np.asarray(terms.offsets)
            lists += [flat[a - places[0] : b - places[0]] for a, b in zip(places[:-1], places[1:], strict=True)]
            labels.append(batch.column("toxic").to_numpy())
        m = Machine.fit_strongest(lists, np.concatenate(labels) if labels else np.zeros(0), positives)
        kinds = {"bias": pa.float64(), "buckets": pa.binary(), "weights": pa.binary(), "factors": pa.binary()}
        yield pa.RecordBatch.from_pylist([m.packed()], schema=pa.schema(list(kinds.items())))

    return fitted


def fit(docs: DataFrame, labels: DataFrame, max_per_label: int = MAX_PER_LABEL) -> Machine:
    """Learn from ``labels(doc_id, toxic)``; of more than ``max_per_label`` documents with a label about so many, by hash.

    Labels without a doc_id or a value are left out; of contrary labels of one doc_id the toxic one counts. Rows that share
    a doc_id all have its label. Null and empty texts have no terms and teach nothing. Without both labels the machine
    gives every text the share of toxic labels. Other columns are not read.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = cut(known, "labels")
    count = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, F.lit(max_per_label / max(count.get(1, 1), 1))).otherwise(F.lit(max_per_label / max(count.get(0, 1), 1)))
    sample = cut(known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000), "sample")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    lists = joined(rows, sample, ["doc_id"]).select("doc_id", "toxic", "text").mapInArrow(_term_lists, "doc_id long, toxic int, terms array<int>")
    positives = count.get(1, 0) / max(1, sum(count.values()))
    lists = cut(lists, "terms", texts=True)
    model = lists.repartition(1).sortWithinPartitions("doc_id", F.xxhash64("terms")).mapInArrow(_fitted(positives), "bias double, buckets binary, weights binary, factors binary").first()
    if model is None:  # nothing to learn from
        return Machine.fit([], np.zeros(0), positives)
    read = lambda name, kind: np.frombuffer(model[name], kind)
    return Machine(model["bias"], read("buckets", "<i8"), read("weights", "<f4"), read("factors", "<f4").reshape(-1, FACTORS))


def _scored(sent):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine: Machine = sent.value
        where = machine.table()
        for batch in slices(batches):
            doc, bucket = terms_of(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(machine.scores(doc, bucket, batch.num_rows, where))], ["doc_id", "score"])

    return scored


def toxicity(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score of every row: null and empty texts get the score of no terms. Very long texts are read whole; a term counts
    once in a text. Repeated rows are each returned, a null doc_id is returned as null, and other columns are not read."""
    text_session(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # (FACTORS + 1) * MAX_TERMS floats
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(_scored(sent), "doc_id long, score double")
