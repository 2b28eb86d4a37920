"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is read as two blocks of 31 bits (the last two bits take
part only in the final comparison).  The anchors of a block are the 2**26 words
of the perfect [31, 26] Hamming code, whose covering radius is 1: each word is
replicated to every anchor within a distance of 2, which is its own anchor and
15 more.  If x and y differ in one bit of a block, x's own anchor is within 2 of
y.  If they differ in two, one of the pairs of flips that lead from x to an
anchor holds one of the two bits, so they meet there as well.  Hence two
fingerprints at distance 5 or less meet: of their two blocks one differs in two
bits at most.

A larger threshold, such as that of a Jaccard similarity of 0.8, takes further
readings of the fingerprint, each a fixed permutation of its bits; a pair beyond
distance 5 is found if it meets in any of them (``readings`` in
``near_duplicates`` has the chances).  Equal fingerprints are merged beforehand.

Within an anchor all fingerprints are compared and only a spanning forest of
the links leaves the task, so a group of n near copies makes at most n - 1 rows.
An anchor with more than ``limit`` fingerprints is not compared in one task: for
thresholds up to 3 it is keyed again by the eight-bit parts of the bits outside
the block (of which one must be equal), and what is still too large is dealt
into pairs of chunks.  The hottest anchors are not even shuffled to one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPREAD, components, cut, in_slices, meet, texts

#: Fingerprints of one anchor that a task compares in memory.
LIMIT = 2048
THRESHOLD = 3
LOW31 = (1 << 31) - 1
_PARITY = [sum(1 << (p - 1) for p in range(1, 32) if p >> b & 1) for b in range(5)]
#: Distance up to which two readings of 31 bits leave one with two differing bits at most.
COVERED = 5
#: For each syndrome the 15 pairs of positions whose flips lead to an anchor at distance 2.
_PAIRS = np.zeros((32, 15), dtype=np.uint64)
for _s in range(1, 32):
    _PAIRS[_s] = [1 << (a - 1) | 1 << ((a ^ _s) - 1) for a in range(1, 32) if a < a ^ _s and a ^ _s]


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a text; zero if it is null or has no word."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= shingle:
        cuts = [flat]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        cuts = [flat[a:b] for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(c, seed) for c in cuts], np.uint64, len(cuts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        part = h[at : at + 4096]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(len(part), 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches):
        fp = np.array([fingerprint(t, shingle) for t in texts(batch.column("text"))], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fp)], ["id", "fp"])


def threshold_of(similarity: float) -> int:
    """Bits in which two sets of that Jaccard similarity differ on average, rounded: their fingerprints' angle times 64."""
    return round(64 * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def reading(fp: np.ndarray, number: int) -> np.ndarray:
    """The bits of each fingerprint in the order of a reading; the first is as they are."""
    bits = fp.view(np.uint64)
    if number == 0:
        return bits
    out = np.zeros(len(fp), np.uint64)
    for to, at in enumerate(np.random.default_rng(number).permutation(64).tolist()):
        out |= (bits >> np.uint64(at) & np.uint64(1)) << np.uint64(to)
    return out


def anchors(fp: np.ndarray, readings: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Anchor keys and fingerprints, each fingerprint at all its anchors of both blocks of each reading."""
    keys, who = [], []
    for block in range(2 * readings):
        word = (reading(fp, block // 2) >> np.uint64(31 * (block % 2))) & np.uint64(LOW31)
        syndrome = np.zeros(len(fp), np.int64)
        for b, mask in enumerate(_PARITY):
            syndrome |= (np.bitwise_count(word & np.uint64(mask)).astype(np.int64) & 1) << b
        own = np.where(syndrome > 0, word ^ (np.uint64(1) << np.maximum(syndrome - 1, 0).astype(np.uint64)), word)
        off = np.flatnonzero(syndrome)
        near = word[off, None] ^ _PAIRS[syndrome[off]]
        keys += [own | np.uint64(block << 31), near.ravel() | np.uint64(block << 31)]
        who += [fp, np.repeat(fp[off], 15)]
    return np.concatenate(keys).view(np.int64), np.concatenate(who)


def _replicate(batches: Iterator[pa.RecordBatch], readings: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False)
        for at in range(0, len(fp), 20_000):
            key, who = anchors(fp[at : at + 20_000], readings)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(who)], ["key", "fp"])


def forest(key: np.ndarray, fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among rows of equal key; rows come sorted by key."""
    n = len(fp)
    label = np.arange(n)
    bits = fp.view(np.uint64)

    def merge(i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up

    active, k, held, size = np.arange(n - 1), 1, [], 0
    while len(active := active[active + k < n]) and len(active := active[key[active] == key[active + k]]):
        near = active[np.bitwise_count(bits[active] ^ bits[active + k]) <= threshold]
        near = near[label[near] != label[near + k]]
        if len(near):
            held.append((near, near + k))
            size += len(near)
        if size > 200_000:
            merge(*map(np.concatenate, zip(*held)))
            held, size = [], 0
        k += 1
    if held:
        merge(*map(np.concatenate, zip(*held)))
    moved = np.flatnonzero(label != np.arange(n))
    return fp[moved], fp[label[moved]]


def _compare(batches: Iterator[pa.RecordBatch], limit: int, threshold: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key in; links (key null) and rows of oversized keys (b null) out."""

    def out(key, a, b):
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["key", "a", "b"])

    def solve(key, fp):
        a, b = forest(key, fp, threshold)
        return out([None] * len(a), a, b)

    rest_key, rest_fp, over = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    for batch in batches:
        key = np.concatenate((rest_key, batch.column("key").to_numpy(zero_copy_only=False)))
        fp = np.concatenate((rest_fp, batch.column("fp").to_numpy(zero_copy_only=False)))
        rest_key, rest_fp = key[:0], fp[:0]
        if not len(key):
            continue
        if over is not None:  # the rest of an oversized key
            n = len(key) if key[-1] == over else int(np.argmax(key != over))
            if n:
                yield out(key[:n], fp[:n], [None] * n)
            key, fp = key[n:], fp[n:]
            if not len(key):
                continue
            over = None
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(key)])))
        large = np.repeat(sizes > limit, sizes)
        last = starts[-1]
        if sizes[-1] > limit:
            over = key[-1]
        else:
            rest_key, rest_fp, large = key[last:].copy(), fp[last:].copy(), large[:last]
            key, fp = key[:last], fp[:last]
        if large.any():
            n = int(large.sum())
            yield out(key[large], fp[large], [None] * n)
        if not large.all():
            yield solve(key[~large], fp[~large])
    if len(rest_key):
        yield solve(rest_key, rest_fp)


def _hot(batches: Iterator[pa.RecordBatch], readings: int) -> Iterator[pa.RecordBatch]:
    """Anchors with one in 2 * SPREAD of the rows of a slice, and how many they have there.

    What an anchor with one in SPREAD of all rows has outside of these slices is
    less than half of that; so the rest is found here.
    """
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False)
        for at in range(0, len(fp), 20_000):
            key, n = np.unique(anchors(fp[at : at + 20_000], readings)[0], return_counts=True)
            some = n >= max(2, n.sum() // (2 * SPREAD))
            yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(n[some], pa.int64())], ["key", "n"])


def _met(keyed: DataFrame, limit: int, threshold: int) -> DataFrame:
    met = keyed.repartition("key").sortWithinPartitions("key")
    return cut(met.mapInArrow(partial(_compare, limit=limit, threshold=threshold), "key long, a long, b long"))


def links(fps: DataFrame, threshold: int = THRESHOLD, limit: int = LIMIT, readings: int = 1) -> DataFrame:
    """Edges (a, b) whose components are those of the pairs at ``threshold`` or less that meet.

    fps: distinct fingerprints in a long column ``fp``.
    """
    keyed = fps.select("fp").mapInArrow(partial(_replicate, readings=readings), "key long, fp long")
    # no more than 2 * SPREAD anchors can hold one in 2 * SPREAD of all rows: these are broadcast, their rows stay
    most = max(limit, 32 * readings * fps.count() // (2 * SPREAD))
    seen = fps.select("fp").mapInArrow(partial(_hot, readings=readings), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    hot = F.broadcast(cut(seen.where(F.col("n") > most).select("key")))
    met = _met(keyed.join(hot, "key", "left_anti"), limit, threshold)
    found = met.where("key is null").select("a", "b")
    over = met.where("key is not null").select("key", F.col("a").alias("fp")).unionByName(keyed.join(hot, "key").select("key", "fp"))
    if over.isEmpty():
        return found
    if threshold > THRESHOLD or readings > 1:
        return found.unionByName(_dealt(over, limit, threshold))
    # The 33 bits outside the block, in four parts of which one is equal in every pair.
    other = F.expr("if((shiftright(key, 31) & 1L) = 0, shiftrightunsigned(fp, 31), (fp & 2147483647L) | shiftleft(shiftrightunsigned(fp, 62), 31))")
    parts = F.array(*[F.expr(f"named_struct('p', {p}, 'v', shiftrightunsigned(o, {8 * p}) & {511 if p == 3 else 255}L)") for p in range(4)])
    again = over.withColumn("o", other).select("key", "fp", F.explode(parts).alias("x")).select(F.xxhash64("key", "x.p", "x.v").alias("key"), "fp").distinct()
    met = _met(again, limit, threshold)
    found = found.unionByName(met.where("key is null").select("a", "b"))
    over = met.where("key is not null").select("key", F.col("a").alias("fp"))
    if over.isEmpty():
        return found
    return found.unionByName(_dealt(over, limit, threshold))


def _dealt(over: DataFrame, limit: int, threshold: int) -> DataFrame:
    """Edges within keys of any size: dealt into chunks, of which every two meet in a task."""
    counts = over.groupBy("key").count().select("key", F.col("count").alias("n"), F.ceil(2 * F.col("count") / limit).cast("int").alias("m"))
    dealt = meet(over, counts, "key", over.count()).withColumn("c", F.pmod(F.xxhash64("fp"), "m"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda o: F.struct(F.least("c", o).alias("i"), F.greatest("c", o).alias("j")))
    keyed = dealt.select("key", "fp", F.explode(pairs).alias("x")).select(F.xxhash64("key", "x.i", "x.j").alias("key"), "fp").distinct()
    return _met(keyed, 1 << 30, threshold).select("a", "b")  # two chunks of limit / 2 each, on average


def named(rows: DataFrame, edges: DataFrame, fps: DataFrame, id_col: str) -> DataFrame:
    """For each row of (id, fp) its fingerprint and the smallest id of its component under links of distinct fingerprints."""
    joined = components(edges)
    best = joined.join(fps, joined.node == fps.fp).groupBy("label").agg(F.min("low").alias("best"), F.count("*").alias("n"))
    linked = meet(joined, best, "label", joined.count()).select(F.col("node").alias("fp"), "best")
    names = cut(fps.join(linked, "fp", "left").select("fp", F.coalesce("best", "low").alias("component_id"), "n"))
    return meet(rows, names, "fp", rows.count()).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, threshold: int | None = None, readings: int | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits) and component_id.

    component_id is the smallest id reachable by links: fingerprints of
    ``shingle``-word shingles that differ in ``threshold`` bits or less, by
    default as many as sets of the Jaccard ``similarity`` differ in on average
    (10 for 0.8).  Up to 5 bits no link is lost.  Beyond, a pair is found if it
    meets in one of the ``readings``, which are five by default: with a
    chance of 0.99 at 6 and 7 bits, 0.96 at 8, 0.87 at 9 and 0.75 at 10.

    A null or wordless text has fingerprint zero and is linked like any other; a
    null id is returned with its component, and is never a component_id unless
    all ids of the component are null.  Ids may be of any type that has an
    order.  Repeated rows are returned as often as they come; other columns are
    not looked at; an empty table gives no row.  The rows of a hot fingerprint,
    and the nodes of a hot component, are spread.
    """
    threshold = threshold_of(similarity) if threshold is None else threshold
    readings = (1 if threshold <= COVERED else 5) if readings is None else readings
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = cut(rows.mapInArrow(partial(_fingerprints, shingle=shingle), f"id {dict(rows.dtypes)['id']}, fp long"))
    fps = cut(rows.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n")))
    return named(rows, links(fps, threshold, limit, readings), fps, id_col)
