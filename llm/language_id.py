"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read in windows of ``WINDOW`` consecutive bytes; within a window the state runs on through words, marks and white
space, forwards and backwards, and every position is labelled. The last window of a text ends with it and overlaps the one
before, whose positions are not labelled again; a shorter text is one window. A document's probabilities are the geometric mean of
those of all its positions, normalised. The network is trained in numpy by backpropagation through time, in one task, on the
windows of a bounded sample of documents of each language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import cut, slices, text_session, texts_of, _LOWER

HIDDEN = 8
WINDOW = 64
#: Windows that are read side by side.
SIDE = 2048
#: Documents of each language to learn from at most (about; taken by the hash of doc_id).
MAX_DOCUMENTS = 300
STEPS, BATCH, RATE = 700, 128, 0.01
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class Network:
    """Parameters: for each direction the input table x (256 bytes), the recurrent matrix u and the bias b of the three gates
    update, reset and new; the output matrix o and bias c."""

    NAMES = ("xf", "uf", "bf", "xb", "ub", "bb", "o", "c")

    def __init__(self, labels: list[str], params: dict[str, np.ndarray]):
        self.labels, self.params = labels, params

    @classmethod
    def fresh(cls, labels: list[str], rng: np.random.Generator) -> Network:
        h, n = HIDDEN, len(labels)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(h), shape).astype(np.float32)
        p = {}
        for d in "fb":
            p |= {f"x{d}": draw(256, 3 * h), f"u{d}": draw(h, 3 * h), f"b{d}": np.zeros(3 * h, np.float32)}
        return cls(labels, p | {"o": draw(2 * h, n), "c": np.zeros(n, np.float32)})

    def _run(self, data: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States after each byte of windows of equal length, in the direction's order: (bytes, HIDDEN, windows)."""
        x, u = (self.params["x" + d] + self.params["b" + d]).T.copy(), self.params["u" + d].T.copy()
        t, n = data.shape[1], data.shape[0]
        read = np.ascontiguousarray(data.T)
        h = np.zeros((HIDDEN, n), np.float32)
        states, tape = np.empty((t, HIDDEN, n), np.float32), []
        for i in range(t):
            a, r = x[:, read[i]], u @ h
            gates = _sigmoid(a[: 2 * HIDDEN] + r[: 2 * HIDDEN])
            z, reset = gates[:HIDDEN], gates[HIDDEN:]
            new = np.tanh(a[2 * HIDDEN :] + reset * r[2 * HIDDEN :])
            if keep:
                tape.append((h, z, reset, new, r[2 * HIDDEN :]))
            states[i] = h = new + z * (h - new)
        return states, tape

    def logs(self, data: np.ndarray) -> np.ndarray:
        """Log probabilities of the labels at each position: (bytes, labels, windows)."""
        ahead, _ = self._run(data, "f", False)
        back, _ = self._run(data[:, ::-1], "b", False)
        return _log_softmax(self._out(ahead, back))

    def _out(self, ahead: np.ndarray, back: np.ndarray) -> np.ndarray:
        o = self.params["o"]
        return o[:HIDDEN].T @ ahead + o[HIDDEN:].T @ back[::-1] + self.params["c"][:, None]

    def gradients(self, data: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of all positions, and its gradient by backpropagation through time."""
        t, n = data.shape[1], data.shape[0]
        ahead, tape_f = self._run(data, "f", True)
        back, tape_b = self._run(data[:, ::-1], "b", True)
        logs = _log_softmax(self._out(ahead, back))
        loss = -float(logs[:, target, np.arange(n)].mean())
        g = np.exp(logs)
        g[:, target, np.arange(n)] -= 1
        g /= n * t
        o = self.params["o"]
        flat = lambda x: x.transpose(1, 0, 2).reshape(x.shape[1], -1)
        out = {"o": flat(np.concatenate([ahead, back[::-1]], axis=1)) @ flat(g).T, "c": g.sum((0, 2))}
        for d, tape, onto, read in (("f", tape_f, o[:HIDDEN] @ g, data), ("b", tape_b, (o[HIDDEN:] @ g)[::-1], data[:, ::-1])):
            u = self.params["u" + d]
            du, into = np.zeros_like(u), np.empty((t, 3 * HIDDEN, n), np.float32)
            carried = np.zeros((HIDDEN, n), np.float32)
            for i in range(t - 1, -1, -1):
                h, z, reset, new, rn = tape[i]
                dh = carried + onto[i]
                dz = dh * (h - new) * z * (1 - z)
                dn = dh * (1 - z) * (1 - new * new)
                dr = dn * rn * reset * (1 - reset)
                into[i] = np.concatenate([dz, dr, dn])
                through = np.concatenate([dz, dr, dn * reset])
                carried = dh * z + u @ through
                du += h @ through.T
            where = read.T.ravel()
            dx = np.stack([np.bincount(where, x, 256) for x in flat(into)], axis=1).astype(np.float32)
            out |= {"x" + d: dx, "u" + d: du, "b" + d: into.sum((0, 2))}
        return loss, out

    def train(self, windows: list[tuple[np.ndarray, np.ndarray]], rng: np.random.Generator, steps: int = STEPS) -> None:
        """Adam over batches of windows of equal length, each language as likely as the others; ``windows``: bytes and targets of
        each length."""
        count = np.bincount(np.concatenate([y for _, y in windows]), minlength=len(self.labels))
        ways = [1.0 / count[y] for _, y in windows]
        first = {k: np.zeros_like(v) for k, v in self.params.items()}
        second = {k: np.zeros_like(v) for k, v in self.params.items()}
        totals = [w.cumsum() for w in ways]
        group = np.cumsum([w[-1] for w in totals])
        for step in range(1, steps + 1):
            k = int(np.searchsorted(group, rng.random() * group[-1], "right"))
            data, target = windows[min(k, len(windows) - 1)]
            total = totals[min(k, len(windows) - 1)]
            rows = np.minimum(np.searchsorted(total, rng.random(min(BATCH, 4 * len(target))) * total[-1], "right"), len(target) - 1)
            _, g = self.gradients(data[rows], target[rows])
            rate = RATE * (1 - step / (steps + 1)) ** 0.5
            for k, v in self.params.items():
                first[k] += 0.1 * (g[k] - first[k])
                second[k] += 0.01 * (g[k] ** 2 - second[k])
                v -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    """Over the axis before the last."""
    x = x - x.max(-2, keepdims=True)
    return x - np.log(np.exp(x).sum(-2, keepdims=True))


def windows_of(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and length of each window of a slice, and how many of its first positions the window before has."""
    size = np.diff(offsets)
    n = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(size)), n)
    at = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
    length = np.minimum(size[doc], WINDOW)
    start = np.minimum(at, size[doc] - length)
    return doc, offsets[doc] + start, length, at - start


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, dict[int, list]] = {}
    for batch in slices(batches):
        data, offsets = texts_of(batch.column("text"))
        docs, start, size, _ = windows_of(offsets)
        data = _LOWER[data]
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in set(langs):
            own = langs[docs] == lang
            for n in np.unique(size[own]).tolist():
                at = start[own & (size == n)]
                found.setdefault(lang, {}).setdefault(n, []).append(data[at[:, None] + np.arange(n)])
    labels = sorted(found)
    rng = np.random.default_rng(11)
    network = Network.fresh(labels or ["und"], rng)
    if len(labels) > 1:
        windows: dict[int, list] = {}
        for y, lang in enumerate(labels):
            for n, xs in found[lang].items():
                x = np.concatenate(xs)
                windows.setdefault(n, []).append((x, np.full(len(x), y)))
        network.train([tuple(np.concatenate(v) for v in zip(*w, strict=True)) for _, w in sorted(windows.items())], rng)
    p = [network.params[k].ravel() for k in Network.NAMES]
    yield pa.RecordBatch.from_pylist([{"labels": network.labels, "params": np.concatenate(p).tolist()}], schema=pa.schema([("labels", pa.list_(pa.string())), ("params", pa.list_(pa.float32()))]))


def fit(docs: DataFrame, max_documents: int = MAX_DOCUMENTS) -> Network:
    """Learn from ``docs(doc_id, text, lang)``; of more than ``max_documents`` of a language about so many, by hash of doc_id.

    Rows without a doc_id, a language or any text are left out; repeated rows weigh as often as they stand; a very long text gives
    all its windows; other columns are not read. With one language or none the network is not trained.
    """
    rows = docs.where("lang is not null and text <> '' and doc_id is not null").select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["text"].cast("string").alias("text"))
    count = rows.groupBy("lang").count().withColumn("share", 1_000_000.0 * max_documents / F.col("count")).drop("count")
    sample = rows.join(F.broadcast(count), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("share")).select("lang", "text")
    sample = cut(sample, "sample")
    got = sample.repartition(1).sortWithinPartitions("lang", "text").mapInArrow(_learned, "labels array<string>, params array<float>").first()
    if got is None:  # nothing to learn from
        return Network.fresh(["und"], np.random.default_rng(0))
    network, flat = Network.fresh(list(got["labels"]), np.random.default_rng(0)), np.array(got["params"], np.float32)
    at = 0
    for k in Network.NAMES:
        shape = network.params[k].shape
        network.params[k] = flat[at : at + int(np.prod(shape))].reshape(shape)
        at += int(np.prod(shape))
    return network


def _predicted(sent):
    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network: Network = sent.value
        labels = np.array([*network.labels, "und"], object)
        for batch in slices(batches):
            data, offsets = texts_of(batch.column("text"))
            docs, start, length, seen = windows_of(offsets)
            lower = _LOWER[data]
            total = np.zeros((batch.num_rows, len(network.labels)))
            for n in np.unique(length).tolist():
                rows = np.flatnonzero(length == n)
                for i in range(0, len(rows), SIDE):
                    part = rows[i : i + SIDE]
                    logs = network.logs(lower[start[part][:, None] + np.arange(n)])
                    twice = np.flatnonzero(seen[part])  # each position counts once
                    for w in twice.tolist():
                        logs[: seen[part[w]], :, w] = 0
                    each = logs.sum(0)
                    for y in range(len(network.labels)):
                        total[:, y] += np.bincount(docs[part], each[y], batch.num_rows)
            p = np.exp(_log_softmax((total / np.maximum(np.diff(offsets), 1)[:, None]).T)).T
            best = p.argmax(1)
            score = p[np.arange(len(p)), best]
            letters = np.diff(np.r_[0, np.cumsum(_LETTER[data])][offsets])
            for d in np.flatnonzero(letters == 0).tolist():
                if not any(map(str.isalpha, batch.column("text")[d].as_py() or "")):
                    best[d], score[d] = len(network.labels), 0.0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(labels[best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return predicted


def languages(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, lang_pred, score of every row; ``und`` with score 0 for null and empty texts and those without a letter.

    Very long texts are read whole, window by window. Of equal probabilities the first label counts. Repeated rows are each returned, a
    null doc_id is returned as null, and other columns are not read; an empty table gives an empty result.
    """
    text_session(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(network)  # a few thousand numbers
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(_predicted(sent), "doc_id long, lang_pred string, score double")
