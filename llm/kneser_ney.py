"""Interpolated modified Kneser-Ney models over UTF-8 bytes, counted and smoothed by Spark, one for each language.

A gram of order k is k bytes of the text (A-Z lower-cased, runs of white space as one space), packed into a long.
``gram_counts`` counts the highest order over all texts. ``smoothed`` derives the lower orders' continuation counts, the
three discounts of each order and language, and gives two kinds of entries: log p(last byte | the bytes before it) for
each gram seen, and log gamma(context) for each context seen. A text is scored by the longest gram seen, times the gammas
of the longer contexts seen.

Two ways to score. ``Model`` holds the entries as sorted hash arrays and is sent to the tasks, if ``fits`` says so.
``sharded_scores`` deals entries and the texts' distinct grams by the two bytes before the last, which a gram shares with all
grams and contexts of order 3 and more that it can fall back to, and joins them shard by shard; the few entries of lower
orders are in every shard, and the model is never in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import cut, drop, mix, slices, texts_of, _LOWER, _SPACE

#: Entries of all models that are sent to the tasks at most (14 bytes each).
MAX_SENT_ENTRIES = 4_000_000
#: Entries of a shard, about, and of one row of packed entries at most.
SHARD_ENTRIES, ROW_ENTRIES = 500_000, 50_000
_U = np.uint64
SYMBOLS = 256


def grams_of(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each counted byte of a slice, and the places where documents begin among them."""
    low = _LOWER[data]
    space = _SPACE[low]
    low = np.where(space, np.uint8(32), low)
    begin = np.zeros(len(low) + 1, bool)
    begin[offsets] = True
    keep = ~space  # of a run of white space the first stays, unless the document begins with it
    keep[1:] |= ~space[:-1] & ~begin[1:-1]
    places = np.r_[0, np.cumsum(keep)][offsets]
    low = low[keep]
    at = np.arange(len(low)) - np.repeat(places[:-1], np.diff(places))  # how far into its document each byte is
    out = low.astype(_U)
    for j in range(1, order):
        back = np.full(len(low), 32, np.uint8)  # before a text stand spaces
        back[j:] = low[:-j] if j else low
        back[at < j] = 32
        out |= back.astype(_U) << _U(8 * j)
    return out, places


def _counted(order: int, keep: Callable[[np.ndarray, np.ndarray], np.ndarray] | None):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
            keys, back = np.unique(np.concatenate([k for k, _ in held[lang]]), return_inverse=True)
            return keys, np.bincount(back, np.concatenate([n for _, n in held[lang]])).astype(np.int64)

        def rows(lang: str) -> pa.RecordBatch:
            keys, n = merged(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

        for batch in slices(batches):
            data, offsets = texts_of(batch.column("text"))
            grams, places = grams_of(data, offsets, order)
            langs = np.array(batch.column("lang").to_pylist(), object)
            kept = np.ones(len(langs), bool) if keep is None else keep(data, offsets)
            for lang in set(langs[kept]):
                mask = np.repeat((langs == lang) & kept, np.diff(places))
                held.setdefault(lang, []).append(np.unique(grams[mask], return_counts=True))
                if sum(len(k) for k, _ in held[lang]) > 600_000:
                    held[lang] = [merged(lang)]
                    if len(held[lang][0][0]) > 300_000:
                        yield rows(lang)
                        del held[lang]
        for lang in held:
            yield rows(lang)

    return counted


def gram_counts(docs: DataFrame, order: int, keep: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(lang, gram, n) over all texts of ``docs(text, lang)``, summed in the tasks before the shuffle; ``keep`` may say which of
    a slice's texts count, by their bytes and offsets."""
    return docs.select("text", "lang").mapInArrow(_counted(order, keep), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def smoothed(counts: DataFrame, order: int) -> DataFrame:
    """(lang, k, context, gram, value): for context false the log probability of a gram of order k, for context true log
    gamma of the k - 1 bytes before the last one."""
    counts = cut(counts, "grams", texts=True)
    tables = {order: counts}
    for k in range(order - 1, 0, -1):
        tables[k] = tables[k + 1].groupBy("lang", F.col("gram").bitwiseAND(2 ** (8 * k) - 1).alias("gram")).agg(F.count("*").alias("n"))
        if k > 1:
            tables[k] = cut(tables[k], f"grams{k}")
    lower, entries = None, None
    for k in range(1, order + 1):
        now = tables[k]
        of = now.groupBy("lang").agg(*(F.count_if(F.col("n") == i).cast("double").alias(f"n{i}") for i in range(1, 5)))
        y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
        of = of.select("lang", *(F.greatest(F.lit(0.1), F.least(F.lit(float(i)), F.coalesce(i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")), F.lit(0.5 * i)))).alias(f"d{i}") for i in (1, 2, 3)))
        of = F.broadcast(of)  # one row for each language
        now = now.withColumn("h", F.shiftright("gram", 8)).join(of, "lang")
        cut_by = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        now = now.withColumn("cut", cut_by)
        contexts = now.groupBy("lang", "h").agg(F.sum("n").alias("total"), F.sum("cut").alias("spare"))
        now = now.join(contexts, ["lang", "h"])
        gamma = F.col("spare") / F.col("total")
        if lower is None:
            now = now.withColumn("below", F.lit(1.0 / SYMBOLS))
        else:
            now = now.withColumn("low", F.col("gram").bitwiseAND(2 ** (8 * (k - 1)) - 1)).join(lower, ["lang", "low"])
        now = now.select("lang", "gram", ((F.col("n") - F.col("cut")) / F.col("total") + gamma * F.col("below")).alias("p"))
        now = cut(now, f"order{k}")
        lower = now.select("lang", F.col("gram").alias("low"), F.col("p").alias("below"))
        both = now.select("lang", F.lit(k).alias("k"), F.lit(False).alias("context"), "gram", F.log("p").cast("float").alias("value"))
        both = both.unionAll(contexts.select("lang", F.lit(k), F.lit(True), F.col("h"), F.log(gamma).cast("float")))
        entries = both if entries is None else entries.unionAll(both)
    return cut(entries, "entries")


class Table:
    """A sorted hash array: keys are mixed and sorted, so the leading bits of a key tell about where it stands."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys = mix(keys)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.float32)
        self.shift = _U(64 - max(8, len(keys).bit_length() + 1))
        self.first = np.searchsorted(self.keys, np.arange(1 << (64 - int(self.shift)), dtype=_U) << self.shift).astype(np.int32)
        self.deep = int(np.bincount((self.keys >> self.shift).astype(np.int64)).max(initial=0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys; nan where absent."""
        out = np.full(len(keys), np.nan, np.float32)
        if not len(self.keys):
            return out
        keys = mix(keys)
        at = self.first[(keys >> self.shift).astype(np.int64)]
        left = np.arange(len(keys))
        for _ in range(self.deep):
            at = np.minimum(at, len(self.keys) - 1)
            here = self.keys[at]
            hit = here == keys
            out[left[hit]] = self.values[at[hit]]
            on = here < keys
            if not on.any():
                break
            left, at, keys = left[on], at[on] + 1, keys[on]
        return out


class Model:
    """Entries of one language (or of one shard of it)."""

    def __init__(self, k: np.ndarray, context: np.ndarray, gram: np.ndarray, value: np.ndarray, order: int):
        self.order = order
        pick = lambda o, c: (k == o) & (context == c)
        self.grams = [Table(gram[pick(o, False)].view(_U), value[pick(o, False)]) for o in range(1, order + 1)]
        self.contexts = [Table(gram[pick(o, True)].view(_U), value[pick(o, True)]) for o in range(1, order + 1)]

    def logs(self, grams: np.ndarray) -> np.ndarray:
        """Natural log probability of the last byte of each gram after the others."""
        out = self.grams[-1].find(grams)
        left = np.flatnonzero(np.isnan(out))
        spare = np.zeros(len(left), np.float32)
        for o in range(self.order, 0, -1):
            if not len(left):
                return out
            part = grams[left]
            spare += np.nan_to_num(self.contexts[o - 1].find((part & _U(2 ** (8 * o) - 1)) >> _U(8)))
            if o == 1:
                break
            value = self.grams[o - 2].find(part & _U(2 ** (8 * (o - 1)) - 1))
            hit = ~np.isnan(value)
            out[left[hit]] = value[hit] + spare[hit]
            left, spare = left[~hit], spare[~hit]
        out[left] = spare - np.float32(np.log(SYMBOLS))
        return out


def fits(entries: DataFrame) -> bool:
    return entries.count() <= MAX_SENT_ENTRIES


def packed_models(entries: DataFrame) -> dict[str, bytes]:
    """The entries of each language in one binary, for tables that ``fits`` accepts; tasks build a ``Model`` from it."""
    rows = entries.select(F.lit(0).alias("shard"), "lang", "k", "context", "gram", "value").mapInArrow(_packed, PACKED)
    parts: dict[str, list] = {}
    for r in rows.toLocalIterator():
        parts.setdefault(r["lang"], []).append(bytes(r["model"]))
    return {lang: b"".join(x) for lang, x in parts.items()}


ENTRY = np.dtype([("k", "u1"), ("context", "?"), ("gram", "<i8"), ("value", "<f4")])


def model_of(data: bytes, order: int) -> Model:
    x = np.frombuffer(data, ENTRY)
    return Model(x["k"], x["context"], np.ascontiguousarray(x["gram"]), x["value"], order)


def by_document(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[places[1:]] - total[places[:-1]]


def _sent_scores(sent, order: int):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {lang: model_of(data, order) for lang, data in sent.value.items()}
        for batch in slices(batches):
            grams, places = grams_of(*texts_of(batch.column("text")), order)
            langs = np.array(batch.column("lang").to_pylist(), object)
            logs = np.zeros(len(grams), np.float32)
            for lang in set(langs) & set(held):
                mask = np.repeat(langs == lang, np.diff(places))
                logs[mask] = held[lang].logs(grams[mask])
            n = np.diff(places)
            none = (n == 0) | ~np.isin(langs.astype(str), list(held))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(by_document(logs, places), mask=none), pa.array(n.astype(np.int64))], ["doc_id", "lang", "log", "n"])

    return scored


def sent_scores(docs: DataFrame, entries: DataFrame, order: int) -> DataFrame:
    """(doc_id, lang, log, n) of every row of ``docs(doc_id, lang, text)``, by entries that ``fits`` accepts; log is null where
    the language has no model or the text no bytes."""
    sent = docs.sparkSession.sparkContext.broadcast(packed_models(entries))
    return docs.select("doc_id", "lang", "text").mapInArrow(_sent_scores(sent, order), "doc_id long, lang string, log double, n long")


# ---------------------------------------------------------------- the model in shards


def _shard(two, shards: int):
    """Shard of the two bytes before the last, as numpy array or Column; neighbours are spread."""
    return two * 40503 % 65521 % shards


def _asked(order: int, shards: int):
    """For each text and shard its distinct grams and how often each occurs."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            grams, places = grams_of(*texts_of(batch.column("text")), order)
            langs, rows = batch.column("lang").to_pylist(), []
            for d, (a, b) in enumerate(zip(places[:-1].tolist(), places[1:].tolist(), strict=True)):
                keys, n = np.unique(grams[a:b], return_counts=True)
                shard = _shard((keys >> _U(8) & _U(65535)).astype(np.int64), shards)
                for s in np.unique(shard):
                    own = shard == s
                    # grams in order as differences, counts as bytes; both shrink well under the shuffle's compression
                    rows.append((d, int(s), langs[d], pack(np.diff(keys[own], prepend=_U(0))), pack(n[own].astype(_U))))
            if rows:
                d, s, lang, keys, n = zip(*rows, strict=True)
                d = pa.array(d)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s, pa.int32()), batch.column("doc_id").take(d), batch.column("tkey").take(d), pa.array(lang, pa.string()), pa.array(keys, pa.binary()), pa.array(n, pa.binary())],
                    ["shard", "doc_id", "tkey", "lang", "keys", "counts"],
                )

    return asked


def pack(values: np.ndarray) -> bytes:
    """Numbers as bytes with a mark for those that need two or eight."""
    if not len(values):
        return b""
    size = np.where(values < 254, 1, np.where(values < 65536, 3, 9))
    at = np.r_[0, np.cumsum(size)]
    out = np.zeros(at[-1], np.uint8)
    raw = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    out[at[:-1]] = np.where(size == 1, raw[:, 0], np.where(size == 3, 254, 255))
    for kind, width in ((3, 2), (9, 8)):
        rows = np.flatnonzero(size == kind)
        out[at[rows][:, None] + 1 + np.arange(width)] = raw[rows, :width]
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    marked = np.flatnonzero(raw >= 254)
    if not len(marked):
        return raw.astype(_U)
    starts, skip = np.ones(len(raw), bool), 0
    for i in marked.tolist():  # a mark's own bytes may look like marks
        if i >= skip:
            skip = i + (3 if raw[i] == 254 else 9)
            starts[i + 1 : skip] = False
    at = np.flatnonzero(starts)
    out = raw[at].astype(_U)
    for mark, width in ((254, 2), (255, 8)):
        rows = np.flatnonzero(raw[at] == mark)
        full = np.zeros((len(rows), 8), np.uint8)
        full[:, :width] = raw[at[rows][:, None] + 1 + np.arange(width)]
        out[rows] = full.view("<u8")[:, 0]
    return out


def _score(order: int):
    """Rows in order of shard and salt, a shard's packed entries first: each model is built once its first text comes."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, held = None, {}, {}
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            columns = (batch.column(c).to_pylist() for c in ("shard", "salt", "doc_id", "tkey", "lang", "keys", "counts", "model"))
            for shard, salt, doc, key, lang, keys, n, model in zip(*columns, strict=True):
                if at != (shard, salt):
                    at, parts, held = (shard, salt), {}, {}
                if model is not None:
                    parts.setdefault(lang, []).append(model)
                    continue
                if lang in parts:
                    held[lang] = model_of(b"".join(parts.pop(lang)), order)
                if lang in held:
                    n = unpack(n).astype(np.float64)
                    for column, v in zip(out, (doc, key, lang, float(n @ held[lang].logs(np.cumsum(unpack(keys), dtype=_U))), int(n.sum())), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64()), strict=True)], ["doc_id", "tkey", "lang", "log", "n"])

    return score


PACKED = "shard int, lang string, model binary"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries as binaries of at most ``ROW_ENTRIES`` for each shard and language; both may come in any order."""
    for batch in batches:
        x = np.empty(batch.num_rows, ENTRY)
        for c in x.dtype.names:
            x[c] = batch.column(c).to_numpy(zero_copy_only=False)
        langs = batch.column("lang").dictionary_encode()
        shard, lang = batch.column("shard").to_numpy(), langs.indices.to_numpy()
        order = np.lexsort((lang, shard))
        x, shard, lang = x[order], shard[order], lang[order]
        new = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (lang[1:] != lang[:-1])]) if len(x) else np.zeros(0, int)
        cuts = [(a, min(a + ROW_ENTRIES, b)) for p, b in zip(new.tolist(), np.r_[new, len(x)][1:].tolist(), strict=True) for a in range(p, b, ROW_ENTRIES)]
        yield pa.RecordBatch.from_arrays([pa.array([int(shard[a]) for a, _ in cuts], pa.int32()), langs.dictionary.take(pa.array([int(lang[a]) for a, _ in cuts], pa.int32())), pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary())], ["shard", "lang", "model"])


def sharded_scores(docs: DataFrame, entries: DataFrame, order: int) -> DataFrame:
    """(doc_id, tkey, lang, log, n): summed log probability and number of bytes of each key of ``docs(doc_id, tkey, lang,
    text)`` whose language has a model and whose text has any bytes. Both sums count repeated rows as often as they stand.

    There are as many shards as entries need. Where a shard's texts are many, they are dealt to several tasks by a salt, and
    its entries are sent to each of these.
    """
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    shards = int(max(2, entries.count() // SHARD_ENTRIES))
    salts = max(1, parts // shards)
    two = F.when(F.col("context"), F.col("gram")).otherwise(F.shiftright("gram", 8)).bitwiseAND(65535)
    everywhere = F.sequence(F.lit(0), F.lit(shards - 1))
    shard = F.when(F.col("k") < 3, everywhere).otherwise(F.array(_shard(two, shards).cast("int")))
    # sorted within its tasks only, so that each packs long runs; nothing is gathered
    model = entries.withColumn("shard", F.explode(shard)).sortWithinPartitions("shard", "lang").select("shard", "lang", "k", "context", "gram", "value")
    model = cut(model.mapInArrow(_packed, PACKED), "shards")
    model = model.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(name) for name in names]
    model = model.select("shard", "salt", *none("long", "doc_id", "tkey"), "lang", *none("binary", "keys", "counts"), "model")
    asked = docs.mapInArrow(_asked(order, shards), "shard int, doc_id long, tkey long, lang string, keys binary, counts binary")
    asked = asked.select("shard", F.pmod(F.xxhash64("doc_id", "tkey"), F.lit(salts)).cast("int").alias("salt"), "doc_id", "tkey", "lang", "keys", "counts", *none("binary", "model"))
    both = model.unionAll(asked).repartition(parts, "shard", "salt").sortWithinPartitions("shard", "salt", F.col("model").isNull())
    return both.mapInArrow(_score(order), "doc_id long, tkey long, lang string, log double, n long").groupBy("doc_id", "tkey", "lang").agg(F.sum("log").alias("log"), F.sum("n").alias("n"))
