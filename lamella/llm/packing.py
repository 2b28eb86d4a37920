"""Best-fit packing by a grouping genetic algorithm on islands.

Token counts are small integers, so a packing of any number of documents is a
list of (pattern, copies): a pattern says how many pieces of each length share a
sequence.  The chromosome is that list; its size is bounded by the sequence
length, not by the number of documents.  Crossover injects whole well-filled
sequences of one parent into the other, removes the other's sequences that would
use pieces twice, and best-fits what these displaced; mutation dissolves the
worst-filled sequences.  Islands are Spark tasks with populations of their own;
after each epoch the best of every island moves to the next one.

Pieces then take the places of their length in turn: each partition counts its
pieces by length, a running sum over partitions numbers them, and a lookup in
the patterns gives sequence and offset.  No task holds the pieces of one length.
"""

from __future__ import annotations

import json
import random
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, in_slices
from .vocab import byte_bpe

CAPACITY = 2048
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 6, 3, 6, 6
#: (pattern, copies); a pattern is ((length, how often), ...).
Packing = list[tuple[tuple[tuple[int, int], ...], int]]


def fill(pattern) -> int:
    return sum(n * k for n, k in pattern)


def best_fit(need: dict[int, int], open_bins: Packing, capacity: int) -> Packing:
    """Best-fit decreasing of ``need`` (length: count) into the bins given and new ones."""
    rooms: dict[int, list] = {}
    for pattern, copies in open_bins:
        rooms.setdefault(capacity - fill(pattern), []).append((pattern, copies))
    order = sorted(rooms)

    def put(pattern, copies, room):
        if room not in rooms:
            insort(order, room)
            rooms[room] = []
        rooms[room].append((pattern, copies))

    for length in sorted((x for x, n in need.items() if n > 0), reverse=True):
        n = need[length]
        while n > 0:
            at = bisect_left(order, length)
            if at == len(order):
                per = capacity // length
                if n >= per:
                    put(((length, per),), n // per, capacity - per * length)
                if n % per:
                    put(((length, n % per),), 1, capacity - n % per * length)
                break
            room = order[at]
            pattern, copies = rooms[room].pop()
            if not rooms[room]:
                del rooms[room], order[at]
            per = room // length
            full = min(copies, n // per)
            if full:
                put((*pattern, (length, per)), full, room - per * length)
                n, copies = n - full * per, copies - full
            if n and copies:
                put((*pattern, (length, n)), 1, room - n * length)
                n, copies = 0, copies - 1
            if copies:
                put(pattern, copies, room)
    return [x for room in rooms.values() for x in room]


def tidy(packing: Packing) -> Packing:
    """Equal patterns counted once."""
    total: Counter = Counter()
    for pattern, copies in packing:
        parts: Counter = Counter()
        for length, k in pattern:
            parts[length] += k
        total[tuple(sorted(parts.items(), reverse=True))] += copies
    return list(total.items())


def used(packing: Packing) -> Counter:
    out: Counter = Counter()
    for pattern, copies in packing:
        for length, k in pattern:
            out[length] += k * copies
    return out


def fitness(packing: Packing, capacity: int) -> tuple[int, float]:
    """Fewer sequences first; then the fuller ones (Falkenauer's squared fill)."""
    return sum(c for _, c in packing), -sum(c * (fill(p) / capacity) ** 2 for p, c in packing)


def keep_fitting(packing: Packing, left: Counter) -> Packing:
    """As many copies of each sequence, fullest first, as ``left`` has pieces for."""
    kept = []
    for pattern, copies in packing:
        copies = min(copies, *(left[n] // k for n, k in pattern))
        if copies:
            kept.append((pattern, copies))
            for n, k in pattern:
                left[n] -= k * copies
    return kept


def crossover(one: Packing, other: Packing, need: Counter, capacity: int, rng: random.Random) -> Packing:
    ranked = sorted(other, key=lambda x: (-fill(x[0]), x[0]))
    share = rng.uniform(0.2, 0.6)
    injected = [x for x in ranked[: max(1, len(ranked) * 2 // 3)] if rng.random() < share]
    left = Counter(need)
    left.subtract(used(injected))
    kept = keep_fitting(sorted(one, key=lambda x: (-fill(x[0]), x[0])), left)
    return tidy(best_fit(left, injected + kept, capacity))


def mutate(packing: Packing, capacity: int, rng: random.Random) -> Packing:
    ranked = sorted(packing, key=lambda x: (fill(x[0]), x[0]))
    worst = max(1, len(ranked) // 20)
    gone = ranked[:worst] + [x for x in ranked[worst:] if rng.random() < 0.05]
    out = set(map(id, gone))
    return tidy(best_fit(used(gone), [x for x in ranked if id(x) not in out], capacity))


def evolve(need: dict[int, int], population: list[Packing], capacity: int, generations: int, size: int, seed: int) -> list[Packing]:
    """One island's epoch: the population, best first.  Settled as soon as the bound is met."""
    rng, need = random.Random(seed), Counter(need)
    bound = -(-sum(n * c for n, c in need.items()) // capacity)
    population = [*population, tidy(best_fit(need, [], capacity))]
    while len(population) < size:
        part = {n: rng.randint(0, c) for n, c in need.items()}
        begun = best_fit(part, [], capacity)
        population.append(tidy(best_fit({n: c - part[n] for n, c in need.items()}, begun, capacity)))
    population.sort(key=lambda p: fitness(p, capacity))
    for _ in range(generations):
        if fitness(population[0], capacity)[0] <= bound:
            break
        one, other = rng.sample(population[: max(2, size // 2 + 1)], 2)
        children = [crossover(one, other, need, capacity, rng), crossover(other, one, need, capacity, rng), mutate(population[0], capacity, rng)]
        population = sorted(population + children, key=lambda p: fitness(p, capacity))[:size]
    return population


def _island(frames: Iterator[pd.DataFrame], need: dict[int, int], capacity: int, generations: int, size: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for island, seed, given in zip(frame.island, frame.seed, frame.given):
            begun = [[(tuple(map(tuple, p)), c) for p, c in packing] for packing in json.loads(given)]
            best = evolve(need, begun, capacity, generations, size, seed)
            rows.append((island, json.dumps(best[:2])))
        yield pd.DataFrame(rows, columns=["island", "best"])


def solve(spark: SparkSession, need: dict[int, int], capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, size: int = POPULATION) -> Packing:
    """The packing found for a histogram of lengths from 1 to ``capacity``."""
    whole = [(((capacity, 1),), need[capacity])] if need.get(capacity) else []
    need = {n: c for n, c in need.items() if 0 < n < capacity and c > 0}
    if not need:
        return whole
    bound = -(-sum(n * c for n, c in need.items()) // capacity)
    found: list[list] = [[] for _ in range(islands)]
    best = None
    for epoch in range(epochs):
        # elites migrate along a ring: island i goes on with its own and its neighbour's
        given = [(i, 1000 * epoch + i, json.dumps(found[i] + found[i - 1][:1])) for i in range(islands)]
        frame = spark.createDataFrame(given, "island int, seed long, given string").repartition(islands)
        rows = frame.mapInPandas(partial(_island, need=need, capacity=capacity, generations=generations, size=size), "island int, best string").collect()
        for r in rows:
            found[r["island"]] = json.loads(r["best"])
        best = min((p for f in found for p in f), key=lambda p: fitness(p, capacity))
        if fitness(best, capacity)[0] <= bound:
            break
    return whole + [(tuple(map(tuple, p)), c) for p, c in best]


def _pieces(batches: Iterator[pa.RecordBatch], vocabulary: str, capacity: int, end: bytes) -> Iterator[pa.RecordBatch]:
    encode, part, ranks = byte_bpe(vocabulary).encode, TaskContext.get().partitionId(), Counter()
    for batch in in_slices(batches):
        rows = []
        for i, text in enumerate(batch.column("text").to_pylist()):
            ids = encode(text) + end
            total = len(ids) // 4
            ends = range(total % capacity or min(total, capacity), total + 1, capacity)
            start = 0
            for piece, stop in enumerate(ends):
                n = stop - start
                rows.append((i, piece, start, n, zlib.crc32(ids[4 * start : 4 * stop]), ranks[n]))
                ranks[n] += 1
                start = stop
        cols = list(zip(*rows))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(pa.array(cols[0])), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5]), pa.array([part] * len(rows), pa.int32()), pa.array(cols[5], pa.int64())],
            ["id", "piece", "start", "length", "ids_crc32", "part", "rank"],
        )


def places(packing: Packing) -> np.ndarray:
    """For each pattern and length, sorted by (length, first slot): key, per sequence, first sequence, offset."""
    taken, sequence, rows = Counter(), 0, []
    for pattern, copies in packing:
        offset = 0
        for n, k in pattern:
            rows.append((n << 44 | taken[n], k, sequence, offset))
            taken[n] += k * copies
            offset += n * k
        sequence += copies
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _place(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, slot = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "slot"))
        row = table[np.searchsorted(table[:, 0], length << 44 | slot, side="right") - 1] if len(length) else table[:0]
        turn = slot - (row[:, 0] & (1 << 44) - 1)
        sequence, offset = row[:, 2] + turn // row[:, 1], row[:, 3] + turn % row[:, 1] * length
        names = ["id", "piece", "start", "length", "ids_crc32"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, **search) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and one end id; one longer than ``capacity`` is
    cut into pieces of that length, of which the first may be shorter.  A null
    text is empty (its piece is the end id alone); repeated rows and null ids
    are packed like any other; other columns are not read; an empty table gives
    no row.  ``search`` goes to ``solve``.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    shape = f"id {kind}, piece int, start long, length long, ids_crc32 long"
    end = int(end_id).to_bytes(4, "little")
    pieces = cut(rows.mapInArrow(partial(_pieces, vocabulary=vocabulary, capacity=capacity, end=end), f"{shape}, part int, rank long"))
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    # at most ``capacity`` rows
    need = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = places(solve(docs.sparkSession, need, capacity, **search))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = pieces.join(offsets, ["part", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank")).alias("slot"))
    return numbered.mapInArrow(partial(_place, table=table), f"{shape}, sequence_id long, offset long").withColumnRenamed("id", id_col)
