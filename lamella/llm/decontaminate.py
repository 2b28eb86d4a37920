"""Benchmark decontamination with an FM-index per shard of training documents.

A shard is a slice of a partition (bounded bytes).  Its whole word sequence is
indexed once, whatever the benchmark: a Burrows-Wheeler transform over word
numbers whose ranks are answered by a wavelet matrix, and suffix positions
sampled every ``SAMPLE`` places.  The indexes are written to the shared folder,
one row per shard.  Test phrases come in batches of bounded bytes, one job each:
all windows of a batch run backward through a shard's index at once, each
occurrence is located by walking to a sampled position, and what the batches
found in a document is merged at the end.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, cut, give_back, in_slices, texts, with_text

WINDOW = 10
SAMPLE = 8
#: Benchmark text of one batch: some 20 bytes of a task's memory for each.
BATCH_BYTES = 4 << 20
SHARD_BYTES = 4 << 20
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_ALL = np.uint64((1 << 64) - 1)


def reverse_bits(x: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros_like(x)
    for i in range(n):
        out |= (x >> i & 1) << (n - 1 - i)
    return out


class WaveletMatrix:
    """Ranks and accesses over a sequence of small integers, vectorised over queries."""

    def __init__(self, bits: list[np.ndarray], counts: np.ndarray, size: int):
        """bits: packed, by level, the highest first; counts: how often each symbol occurs."""
        self.bits, self.size = bits, size
        self.levels, self.words, self.before, self.zeros = range(len(bits) - 1, -1, -1), [], [], []
        for packed in bits:  # in words of 64, the last of them never full, and the ones before each
            words = np.frombuffer(packed.tobytes().ljust((size // 64 + 1) * 8, b"\0"), ">u8").astype(np.uint64)
            ones = np.cumsum(np.bitwise_count(words), dtype=np.int64)
            self.words.append(words)
            self.before.append(np.concatenate(([0], ones[:-1])))
            self.zeros.append(size - int(ones[-1]))
        # the last level's order is by reversed bits: where each symbol's block begins there
        order = np.argsort(reverse_bits(np.arange(len(counts)), len(bits)))
        self.starts = np.zeros(len(counts), np.int64)
        self.starts[order] = np.concatenate(([0], np.cumsum(counts[order])[:-1]))

    @classmethod
    def of(cls, sequence: np.ndarray) -> WaveletMatrix:
        counts, bits = np.bincount(sequence), []
        for level in range(max(1, (len(counts) - 1).bit_length()) - 1, -1, -1):
            bit = sequence >> level & 1
            bits.append(np.packbits(bit.astype(np.uint8)))
            if level:
                sequence = np.concatenate((sequence[bit == 0], sequence[bit == 1]))
        return cls(bits, counts, len(sequence))

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The ones of a level before each place."""
        return before[at >> 6] + np.bitwise_count(words[at >> 6] & ~(_ALL >> (at & 63).astype(np.uint64)))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        for level, words, before, zeros in zip(self.levels, self.words, self.before, self.zeros):
            ones = self._ones(words, before, at)
            at = np.where(symbol >> level & 1, zeros + ones, at - ones)
        return at - self.starts[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and its rank there."""
        symbol = np.zeros(len(at), np.int64)
        for level, words, before, zeros in zip(self.levels, self.words, self.before, self.zeros):
            ones = self._ones(words, before, at)
            bit = (words[at >> 6] >> (63 - (at & 63)).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            symbol |= bit << level
            at = np.where(bit, zeros + ones, at - ones)
        return symbol, at - self.starts[symbol]


def suffix_array(sequence: np.ndarray) -> np.ndarray:
    """Suffixes in order; the last symbol must be the smallest and stand nowhere else.

    As many symbols as fit 63 bits are sorted at once; then the length doubles,
    and only suffixes that are not yet alone are sorted again.
    """
    n, width = len(sequence), max(1, int(sequence.max()).bit_length())
    h = max(1, min(63 // width, n))
    key = np.zeros(n, np.int64)
    for k in range(h):
        key <<= width
        key[: n - k] |= sequence[k:]
    order = np.argsort(key, kind="stable")
    key = key[order]
    fresh = np.concatenate(([True], key[1:] != key[:-1]))
    del key
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n, dtype=np.int32), 0))
    while True:
        alone = fresh & np.append(fresh[1:], True)
        open_ = np.flatnonzero(~alone)  # places in the order
        if not len(open_):
            return order
        suffix = order[open_]
        ahead = np.where(suffix + h < n, rank[np.minimum(suffix + h, n - 1)] + 1, 0)
        key = rank[suffix].astype(np.int64) * (n + 1) + ahead
        turn = np.argsort(key, kind="stable")
        order[open_], key = suffix[turn], key[turn]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        fresh[open_] = new
        rank[order[open_]] = np.maximum.accumulate(np.where(new, open_, 0))
        h *= 2


class FMIndex:
    """Counts and locates patterns in a sequence of positive integers."""

    def __init__(self, tree: WaveletMatrix, first: np.ndarray, sampled: np.ndarray, samples: np.ndarray):
        self.tree, self.first, self.sampled, self.samples = tree, first, sampled, samples
        self.sample_no = np.cumsum(sampled, dtype=np.int32) - 1
        self.size = tree.size

    @classmethod
    def of(cls, sequence: np.ndarray) -> FMIndex:
        sequence = np.concatenate((sequence, np.zeros(1, sequence.dtype)))
        order = suffix_array(sequence)
        first = np.concatenate(([0], np.cumsum(np.bincount(sequence))))
        sampled = order % SAMPLE == 0
        samples, sequence = order[sampled].astype(np.uint32), sequence[order - 1]
        del order
        return cls(WaveletMatrix.of(sequence), first, sampled, samples)

    def dump(self) -> bytes:
        return pickle.dumps((self.tree.bits, np.diff(self.first).astype(np.uint32), self.size, np.packbits(self.sampled), self.samples))

    @classmethod
    def load(cls, data: bytes) -> FMIndex:
        bits, counts, size, sampled, samples = pickle.loads(data)
        counts = counts.astype(np.int64)
        return cls(WaveletMatrix(bits, counts, size), np.concatenate(([0], np.cumsum(counts))), np.unpackbits(sampled, count=size).astype(bool), samples)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row interval of each pattern (rows of a matrix, right-aligned)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            on = np.flatnonzero((patterns.shape[1] - k <= lengths) & (low < high))
            if not len(on):
                break
            symbol = patterns[on, k].astype(np.int64)
            known = symbol < len(self.first) - 1
            low[on[~known]] = high[on[~known]] = 0
            on, symbol = on[known], symbol[known]
            low[on], high[on] = (self.first[symbol] + self.tree.rank(symbol, x) for x in (low[on].copy(), high[on].copy()))
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        where, steps, left = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        rows = rows.copy()
        while len(left):
            done = self.sampled[rows[left]]
            hit = left[done]
            where[hit] = self.samples[self.sample_no[rows[hit]]].astype(np.int64) + steps[hit]
            left = left[~done]
            if len(left):
                symbol, rank = self.tree.access(rows[left])
                rows[left] = self.first[symbol] + rank
                steps[left] += 1
        return where


class Shard:
    """The index of some documents: words have numbers from 2, 1 ends a document."""

    def __init__(self, index: FMIndex, words: list[bytes], starts: np.ndarray):
        self.index, self.words, self.starts = index, words, starts

    @classmethod
    def of(cls, documents: list[bytes | None]) -> Shard:
        number: dict[bytes, int] = {}
        parts, starts, at, end = [], [0], 0, np.ones(1, np.int32)
        for text in documents:
            words = text.translate(ALNUM).split() if text else []
            for w in words:
                if w not in number:
                    number[w] = len(number) + 2
            parts += [np.fromiter(map(number.__getitem__, words), np.int32, len(words)), end]
            at += len(words) + 1
            starts.append(at)
        flat, words = np.concatenate(parts) if parts else np.zeros(0, np.int32), list(number)
        del parts, number
        return cls(FMIndex.of(flat), words, np.array(starts))

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.starts) - 1

    def dump(self) -> bytes:
        return pickle.dumps((self.index.dump(), b"\n".join(self.words), self.starts))

    @classmethod
    def load(cls, data: bytes) -> Shard:
        index, words, starts = pickle.loads(data)
        return cls(FMIndex.load(index), words.split(b"\n") if words else [], starts)


class Phrases:
    """The distinct windows of a set of items, as a matrix of word numbers from 2."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        fresh, rows, lengths, owners = count(2), [], [], []
        self.items = [item for item, _ in items]
        for owner, (_, text) in enumerate(items):
            words = text.translate(ALNUM).split() if text else []
            if not words:
                continue
            for w in words:
                if w not in self.number:
                    self.number[w] = next(fresh)
            ids = np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))
            n = min(window, len(ids))
            found = np.zeros((len(ids) - n + 1, window), np.int32)
            found[:, window - n :] = np.lib.stride_tricks.sliding_window_view(ids, n)
            rows.append(found)
            lengths.append(np.full(len(found), n))
            owners.append(np.full(len(found), owner))
        self.matrix, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True) if rows else (np.zeros((0, window), np.int32), np.zeros(0, np.int64))
        self.lengths = np.zeros(len(self.matrix), np.int64)
        if rows:
            self.lengths[which] = np.concatenate(lengths)
        # the owners of window w are those from first[w] to first[w + 1]
        order = np.argsort(which, kind="stable")
        self.owners = np.concatenate(owners)[order] if rows else np.zeros(0, np.int64)
        self.first = np.searchsorted(which[order], np.arange(len(self.matrix) + 1))


def find(phrases: Phrases, shard: Shard) -> dict[int, tuple[list, list]]:
    """Of the documents that hold a window: number to the items found and the spans of hit words [from, to)."""
    asked = phrases.number
    known = {w: i for i, w in enumerate(shard.words, 2) if w in asked}
    here = np.zeros(len(phrases.number) + 2, np.int64)
    here[2:] = [known.get(w, -1) for w in phrases.number]
    mapped = here[phrases.matrix]
    some = np.flatnonzero((mapped >= 0).all(1))
    low, high = shard.index.search(mapped[some], phrases.lengths[some])
    hit = high > low
    some, low, n = some[hit], low[hit], (high - low)[hit]
    if not len(some):
        return {}
    which = np.repeat(some, n)
    where = shard.index.locate(np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum())))
    flags = np.zeros(int(shard.starts[-1]) + 1, np.int64)
    np.add.at(flags, where, 1)
    np.add.at(flags, where + phrases.lengths[which], -1)
    flags = np.cumsum(flags) > 0
    doc = np.searchsorted(shard.starts, where, side="right") - 1
    out = {}
    for d in np.unique(doc).tolist():
        a, b = shard.starts[d], shard.starts[d + 1] - 1
        spans = np.flatnonzero(np.diff(np.concatenate(([0], flags[a:b].astype(np.int8), [0])))).reshape(-1, 2).tolist()
        owners = {int(o) for w in np.unique(which[doc == d]).tolist() for o in phrases.owners[phrases.first[w] : phrases.first[w + 1]]}
        out[d] = [x for x in (phrases.items[o] for o in sorted(owners)) if x is not None], spans
    return out


def _index(batches: Iterator[pa.RecordBatch], carried: str | None) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    give_back()
    for batch in in_slices(with_text(batches, carried), most=SHARD_BYTES):
        shard, n = Shard.of(texts(batch.column("text"))), batch.num_rows
        own = batch.drop_columns(["text"]) if "text" in batch.schema.names else batch
        docs = pa.StructArray.from_arrays([*own.columns, pa.array(shard.sizes, pa.int64())], [*own.schema.names, "n_words"])
        data = pa.array([shard.dump()], pa.binary())
        del shard
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), docs), data], ["shard", "docs", "index"])
        number += 1


def _search(batches: Iterator[pa.RecordBatch], items: list, window: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    give_back()
    phrases = Phrases(items, window)
    for batch in batches:
        for number, data in zip(batch.column("shard").to_pylist(), batch.column("index")):
            found = find(phrases, Shard.load(data.as_buffer().to_pybytes()))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(found), pa.int64()), pa.array(list(found), pa.int32()), pa.array([i for i, _ in found.values()], pa.list_(kind)), pa.array([s for _, s in found.values()], pa.list_(pa.list_(pa.int64())))],
                    ["shard", "doc", "items", "spans"],
                )


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """The written index of a corpus, one row per shard: shard, docs (id, with ``carry`` the whole row, and n_words), index.

    It does not depend on any benchmark and serves any number of ``search`` calls.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.struct("*").alias("row") if carry else F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)
    kept = f"id: {kind['id']}, row: {kind['row']}" if carry else f"id: {kind['id']}"
    return cut(rows.mapInArrow(partial(_index, carried=text_col if carry else None), f"shard long, docs array<struct<{kept}, n_words: long>>, index binary"))


def search(index: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Per document of the index: id, (row,) n_words, n_hit, items (sorted ids), spans of hit words [from, to).

    Null texts have no words; an item without words matches nothing; an item
    without an id marks words but is not listed; ids may be of any type; equal
    rows on either side are each handled like any other.  Empty tables give no
    row, or no hit.  The benchmark is read in batches of about ``batch_bytes``,
    one job after the other: the driver and the tasks hold one batch at a time.
    """
    asked = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where("text is not null")
    size = asked.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    kind, batches = dict(asked.dtypes)["item"], max(1, -(-size // batch_bytes))
    shape = f"shard long, doc int, items array<{kind}>, spans array<array<long>>"
    hits = None
    for k in range(batches):
        part = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(batches)) == k) if batches > 1 else asked
        found = part.select("item", F.col("text").cast("binary")).toArrow()
        items = list(zip(found["item"].to_pylist(), found["text"].to_pylist()))
        found = cut(index.select("shard", "index").mapInArrow(partial(_search, items=items, window=window, kind=found["item"].type), shape))
        hits = found if hits is None else hits.unionByName(found)
    merged = hits.groupBy("shard", "doc").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    none = F.array().cast("array<array<bigint>>")

    def join(done, span):
        """Spans come sorted; one that begins within or right after the last is added to it."""
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.array(last[0], F.greatest(last[1], span[1]))))
        return F.when((F.size(done) > 0) & (F.get(last, 1) >= span[0]), longer).otherwise(F.concat(done, F.array(span)))

    docs = index.select("shard", F.posexplode("docs").alias("doc", "d")).select("shard", "doc", "d.*")
    joined = docs.join(merged, ["shard", "doc"], "left").withColumn("spans", F.when(F.size("spans") > 0, F.aggregate("spans", none, join)).otherwise(none))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return joined.select("id", *(["row"] if "row" in docs.columns else []), "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast(f"array<{kind}>")).alias("items"), "spans")


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, **options) -> DataFrame:
    """``search`` in the index of the documents; ``options`` go there."""
    return search(build(docs, id_col, text_col, carry), benchmark, **options)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The flat form of ``scan``: counts and a hash of the items found."""
    named = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def without(text: bytes, spans: list[list[int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    words = [m.span() for m in WORD.finditer(text.lower())]
    parts, at = [], 0
    for a, b in spans:
        parts.append(text[at : words[a][0]])
        at = words[b - 1][1]
    return b"".join([*parts, text[at:]])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches):
        spans = batch.column("spans").to_pylist()
        cut = [t if t is None or not s else without(t, s) for t, s in zip(texts(batch.column("text")), spans)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([t if t is None else t.decode() for t in cut])], ["id", "text"])


def remove(found: DataFrame, text_col: str = "text") -> DataFrame:
    """id and text without the removal spans, from a ``scan`` with ``carry``."""
    kind = dict(found.dtypes)["id"]
    return found.select("id", F.col("row")[text_col].alias("text"), "spans").mapInArrow(_remove, f"id {kind}, text string")
