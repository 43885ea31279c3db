"""Token ids as binary: blocks of concatenated ids with Elias-Fano encoded document boundaries.

A block is one row of a Parquet table in the output folder, so any store that Spark writes to will do, and a
failed task's output is not committed. Blocks are in order of (part, block), and the documents in them in order of doc_id:

    part, block  int     range partition of doc_id, and number within it
    docs, ids    long    documents and ids in the block
    width        int     bytes of an id: 2 if all ids are under 65,536, else 4
    data         binary  little-endian ids, one document after the other, each with the end id
    missing      long    documents without a doc_id; they come first
    base         long    the least doc_id
    ends, names  struct  Elias-Fano sequences: where each document ends in ``data``, and doc_id less ``base`` of each with one

A sequence is (n long, low_bits int, low binary, high binary, samples binary): the low parts, packed, least bit first; the
high parts in unary, so that bit (value >> low_bits) + place is set; and for select the place in ``high`` of every 64th one,
as an unsigned 32-bit integer. Nothing in a block is a table of 64-bit numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import TEXT_ROWS, batch_rows, cut, id_name, joined, powers, shared_dir, slices, _BYTE, _R, _R_INV

BLOCK_IDS = 1_000_000
REMEMBERED = 500_000
SAMPLE = 64
SEQUENCE = "struct<n: long, low_bits: int, low: binary, high: binary, samples: binary>"
FORMAT = f"part int, block int, docs long, ids long, width int, data binary, missing long, base long, ends {SEQUENCE}, names {SEQUENCE}"


class EliasFano:
    """A sequence of unsigned numbers that does not decrease, in about 2 + log2(largest / length) bits for each."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n, values = len(values), values.astype(np.uint64)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(places[-1]) + 64) // 64 * 64 if n else 0, np.uint8)
        high[places] = 1
        pack = lambda x: np.packbits(x.astype(np.uint8).ravel(), bitorder="little").tobytes()
        return cls(n, bits, pack(low), pack(high), places[::SAMPLE].astype("<u4").tobytes())

    def fields(self) -> dict:
        return {"n": self.n, "low_bits": self.low_bits, "low": self.low, "high": self.high, "samples": self.samples}

    def select(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places ``i``: from the nearest sample on, words of ``high`` are counted until the one is reached."""
        if not len(i):
            return np.zeros(0, np.uint64)
        words = np.frombuffer(self.high, "<u8")
        at = np.frombuffer(self.samples, "<u4")[i // SAMPLE].astype(np.int64)
        word, left = at >> 6, i % SAMPLE + 1
        here = words[word] & (np.uint64(2**64 - 1) << (at & 63).astype(np.uint64))
        while True:
            count = np.bitwise_count(here).astype(np.int64)
            on = count < left
            if not on.any():
                break
            left = np.where(on, left - count, left)
            word = np.where(on, word + 1, word)
            here = np.where(on, words[word], here)
        ones = np.cumsum(np.unpackbits(here.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=1)
        place = word * 64 + np.argmax(ones == left[:, None], axis=1)
        # only the low parts asked for are read
        bit = i[:, None].astype(np.int64) * self.low_bits + np.arange(self.low_bits)
        bits = np.frombuffer(self.low, np.uint8)[bit >> 3] >> (bit & 7).astype(np.uint8) & 1
        low = (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return (place - i).astype(np.uint64) << np.uint64(self.low_bits) | low


def _same(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, size: np.ndarray) -> bool:
    """Whether all runs of ``size`` bytes at ``at`` in ``a`` equal those at ``bt`` in ``b``."""
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return bool((a[np.repeat(at, size) + step] == b[np.repeat(bt, size) + step]).all())


class WordCodec(dict):
    """A tokenizer file of the tokenizers library; as a dict it holds the ids of single words, as little-endian bytes.

    The file's pre-tokenizer is fixed: contractions, runs of letters, single numerals, runs of anything else but white
    space; the words are encoded apart from each other. Only words not met before go to the library, and texts outside
    Latin, where the normalizer looks at more than one character, go there whole.
    """

    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = regex.compile(self.SPLIT).findall
        self.plain = regex.compile(r"[\x00-ǃ]*").fullmatch
        kinds = [next((k for k, c in ((0, r"\s"), (1, r"\p{L}"), (2, r"\p{N}")) if regex.match(c, chr(i))), 3) for i in range(256)]
        self.kinds = np.array(kinds, np.uint8)
        size = self.tokenizer.get_vocab_size()
        self.forget()
        self.last = np.zeros(size, bool)  # ids that end a word
        self.last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = ids = self.whole(word)
        return ids

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def forget(self) -> None:
        """The words known by hash: sorted hashes, and for each where its ids lie and how many they are, and the same of its
        bytes, which tell apart words of one hash."""
        self.known, self.at, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")
        self.byte_at, self.bytes = np.zeros((0, 2), np.int64), np.zeros(0, np.uint8)

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Encode words not met before in one call: each ends with an id that ends a word."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):
            each = [np.frombuffer(self.whole(w), "<u4") for w in words]
            ids, ends = np.concatenate(each), np.cumsum([len(x) for x in each])
        begin = np.r_[0, ends[:-1]]
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known)
        self.at = np.concatenate([self.at, begin + len(self.flat)])[order]
        self.size = np.concatenate([self.size, ends - begin])[order]
        self.flat, self.known = np.concatenate([self.flat, ids]), known[order]
        raw = [w.encode("latin-1") for w in words]
        long = np.array([len(w) for w in raw], np.int64)
        self.byte_at = np.concatenate([self.byte_at, np.c_[np.cumsum(long) - long + len(self.bytes), long]])[order]
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(raw), np.uint8)])

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where hashes stand among the known ones, and which do."""
        if not len(self.known):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return at, self.known[at] == hashes

    def encode(self, text: str) -> bytes:
        if "<|" in text or not self.plain(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, self.split(text.lower())))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Texts of one-byte characters without apostrophes are split together, and each word of theirs looked up once."""
        out: list = [None] * len(texts)
        some, raw = [], []
        for i, text in enumerate(texts):
            try:
                if "'" in text or "<|" in text:
                    raise ValueError
                raw.append(text.lower().encode("latin-1"))
                some.append(i)
            except ValueError:
                out[i] = self.encode(text)
        data = np.frombuffer(b"".join(raw), np.uint8)
        if len(data):
            places = np.cumsum([0, *map(len, raw)])
            kind = self.kinds[data]
            new = np.r_[True, (kind[1:] != kind[:-1]) | (kind[1:] == 2)]
            new[places[:-1][places[:-1] < len(data)]] = True
            start = np.flatnonzero(new)
            end = np.r_[start[1:], len(data)]
            word = kind[start] > 0
            start, end = start[word], end[word]
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_BYTE[data] * powers(_R, len(data)), out=total[1:])
            hashes = (total[end] - total[start]) * powers(_R_INV, len(data) + 1)[start]
            distinct, one, back = np.unique(hashes, return_index=True, return_inverse=True)
            size = end - start
            at, hit = self.places(distinct)
            met, stored = one[hit], self.byte_at[at[hit]]
            alike = (size == size[one][back]).all() and _same(data, start, data, start[one][back], size)
            if not (alike and (size[met] == stored[:, 1]).all() and _same(data, start[met], self.bytes, stored[:, 0], size[met])):
                return [self.encode(text) for text in texts]  # two words of one hash
            if not hit.all():
                if len(self.known) + np.count_nonzero(~hit) > REMEMBERED:
                    self.forget()
                    hit[:] = False
                new = np.flatnonzero(~hit)
                whole = data.tobytes().decode("latin-1")
                self.learn(distinct[new], [whole[a:b] for a, b in zip(start[one[new]].tolist(), end[one[new]].tolist(), strict=True)])
                at, _ = self.places(distinct)
            n = self.size[at][back]
            ends = np.cumsum(n)
            flat = self.flat[np.arange(n.sum()) + np.repeat(self.at[at][back] - (ends - n), n)]
            cuts = np.r_[0, ends][np.searchsorted(start, places)].tolist()
            for i, a, b in zip(some, cuts[:-1], cuts[1:], strict=True):
                out[i] = flat[a:b].tobytes()
        return [b"" if x is None else x for x in out]


_RUN = pa.struct([("n", pa.int64()), ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("samples", pa.binary())])
BLOCK = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64()), ("width", pa.int32()), ("data", pa.binary()), ("missing", pa.int64()), ("base", pa.int64()), ("ends", _RUN), ("names", _RUN)])


@lru_cache(maxsize=2)
def word_codec(path: str) -> WordCodec:
    return WordCodec(path)


def _blocks(path: str, end_id: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, number = word_codec(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        ids: list = []
        texts: list[bytes] = []
        held = 0

        def block() -> pa.RecordBatch:
            ends = np.cumsum([len(t) // 4 for t in texts])
            data = np.frombuffer(b"".join(texts), "<u4")
            width = 2 if data.max() < 65536 else 4
            ef = EliasFano.of(ends)
            named = np.array([i for i in ids if i is not None], np.int64)
            base = int(named[0]) if len(named) else 0
            names = EliasFano.of(named.view(np.uint64) - np.array([base], np.int64).view(np.uint64))
            row = {"part": part, "block": number, "docs": len(texts), "ids": len(data), "width": width, "data": data.astype(f"<u{width}").tobytes(), "missing": len(ids) - len(named), "base": base, "ends": ef.fields(), "names": names.fields()}
            return pa.RecordBatch.from_pylist([row], schema=BLOCK)

        for batch in slices(batches):
            encoded = code.encode_all([t or "" for t in batch.column("text").to_pylist()])
            for doc, text in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                ids.append(doc)
                texts.append(text + end)
                held += len(texts[-1]) // 4
                if held >= BLOCK_IDS:
                    yield block()
                    number, held = number + 1, 0
                    ids.clear()
                    texts.clear()
        if texts:
            yield block()

    return blocks


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1) -> None:
    """Write ``docs(doc_id, text)`` as blocks in ascending doc_id order; null ids come first, null texts are empty.

    Rows that share a doc_id are in order of their text. An empty table gives a folder without blocks.
    """
    docs = id_name(docs)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = docs.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    with batch_rows(docs.sparkSession, TEXT_ROWS):
        dealt.mapInArrow(_blocks(tokenizer, end_id), FORMAT).write.option("compression", "none").parquet(folder)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.to_pylist():
            ends = EliasFano(**x["ends"]).select(np.arange(x["docs"])).astype(np.int64)
            starts = np.r_[0, ends[:-1]]
            data = np.frombuffer(x["data"], f"<u{x['width']}").astype("<u4").tobytes()
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            names = EliasFano(**x["names"]).select(np.arange(x["docs"] - x["missing"])) + np.array([x["base"]], np.int64).view(np.uint64)
            ids = np.r_[np.zeros(x["missing"], np.int64), names.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=np.arange(x["docs"]) < x["missing"]), pa.array(starts + x["start"]), pa.array(ends - starts), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the blocks of a folder."""
    blocks = spark.read.schema(FORMAT).parquet(folder)
    heads = blocks.select("part", "block", "ids")
    # block starts: totals of parts (as many as range partitions) first, then blocks within each part
    totals = heads.groupBy("part").agg(F.sum("ids").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    own = F.sum("ids").over(Window.partitionBy("part").orderBy("block")) - F.col("ids")
    starts = heads.select("part", "block", own.alias("own")).join(before, "part").select("part", "block", (F.col("own") + F.col("before")).alias("start"))
    return joined(blocks, cut(starts, "starts"), ["part", "block"]).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the blocks to a new folder beside the checkpoints and read them back: a row for each row of ``docs``.

    Null and empty texts have the end id only. Repeated rows and rows with a null doc_id, which come first, are each written. Very long
    texts are encoded whole. Other columns are not read; an empty table gives an empty one.
    """
    import uuid

    folder = f"{shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, folder, tokenizer, end_id)
    return read_token_files(docs.sparkSession, folder)
