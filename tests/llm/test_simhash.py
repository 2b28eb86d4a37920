import itertools
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lamella.llm import simhash
from lamella.llm.common import components, meet


def brute(text, width=3):
    words = (text or "").encode().lower().split()
    cuts = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(c, 42) for c in cuts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(fps, threshold=3):
    up = {i: i for i in range(len(fps))}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= threshold:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(fps))]


def test_fingerprints():
    rng = random.Random(1)
    for n in [0, 1, 2, 3, 4, 50, 5000]:
        text = " ".join(rng.choice(["Foo", "bär", "x", "ZZ", "\n", "qu ux"]) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == brute(text) and simhash.fingerprint(text.encode(), 5) == brute(text, 5)
    assert simhash.fingerprint(None) == 0 == simhash.fingerprint(b" \t\n")


def test_every_close_pair_meets_at_an_anchor():
    rng = random.Random(2)
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 5)):
            b ^= 1 << bit
        x, y = (set(simhash.anchors(np.array([v], np.uint64).view(np.int64))[0].tolist()) for v in (a, b))
        assert x & y and len(x) <= 32


def cloud(rng, n):
    """Fingerprints in clusters that chain, and loners."""
    seeds, out = [rng.getrandbits(64) for _ in range(6)], set()
    while len(out) < n:
        x = rng.choice([*seeds, rng.getrandbits(64)])
        for bit in rng.sample(range(64), rng.randint(0, 5)):
            x ^= 1 << bit
        out.add(x)
    return sorted(out)


def linked(spark, fps, limit, threshold=3):
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3), threshold, limit))
    label = {r["node"]: r["label"] for r in found.collect()}
    groups = {}
    for i, f in enumerate(signed):
        groups.setdefault(label.get(f, f), []).append(i)
    return sorted(groups.values())


def expected(fps, threshold=3):
    groups = {}
    for i, r in enumerate(roots(fps, threshold)):
        groups.setdefault(r, []).append(i)
    return sorted(groups.values())


def test_links_with_and_without_oversized_anchors(spark):
    fps = cloud(random.Random(3), 400)
    want = expected(fps)
    assert linked(spark, fps, simhash.LIMIT) == want
    assert linked(spark, fps, 4) == want  # most groups take the second and third way
    assert linked(spark, fps, simhash.LIMIT, 5) == expected(fps, 5) == linked(spark, fps, 8, 5)


def test_hottest_anchors_are_not_shuffled_by_key(spark, monkeypatch):
    monkeypatch.setattr("lamella.llm.simhash.SPREAD", 1 << 20)
    fps = cloud(random.Random(6), 300)
    assert linked(spark, fps, 16) == expected(fps)  # every anchor above the limit counts as hot


def test_chances_of_further_readings():
    """Pairs at 6 to 10 bits meet as often as the docstring says."""
    rng = random.Random(4)
    for bits, chance in ((5, 1.0), (6, 0.99), (7, 0.99), (8, 0.96), (9, 0.87), (10, 0.75)):
        met = 0
        for _ in range(400):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), bits):
                b ^= 1 << bit
            x, y = (set(simhash.anchors(np.array([v], np.uint64).view(np.int64), 5)[0].tolist()) for v in (a, b))
            met += bool(x & y)
        assert abs(met / 400 - chance) < 0.06, (bits, met / 400)
    assert simhash.threshold_of(0.8) == 10 and simhash.threshold_of(1) == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, 7), (1, 2), (2, 1), (1, 2), (500, 3), (3, 400)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 1: 1, 2: 1, 3: 3, 400: 3, 500: 3}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hubs_are_spread(spark):
    edges = [(1000 + i, 5) for i in range(300)] + [(1000 + i, 7) for i in range(299, 320)] + [(2, 3), (3, 4), (9000, 8000)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{1000 + i: 5 for i in range(320)}, 5: 5, 7: 5, 2: 2, 3: 2, 4: 2, 8000: 8000, 9000: 8000}


def test_hot_keys_meet_like_others(spark):
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 500), (2, 40), (3, 1)) for i in range(n)], "k long, i long")
    groups = spark.createDataFrame([(1, 500, "a"), (2, 40, "b"), (3, 1, "c")], "k long, n long, v string")
    want = sorted(map(tuple, rows.join(groups, "k").collect()))
    for total in (541, 40 * 1024, 1 << 30):  # all keys hot, one of them, none
        assert sorted(map(tuple, meet(rows, groups, "k", total).collect())) == want


def test_documents(spark):
    long = " ".join(f"w{i}" for i in range(300))
    near = long.replace("w17", "other")
    rows = [(5, long, "x"), (3, near, "y"), (3, near, "y"), (9, None, "z"), (8, "", "z"), (7, "  ", "z"), (None, long, "n"), (2, "One", "s"), (4, "one", "s"), (None, "alone by itself", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string").withColumnRenamed("component_id", "fp")
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df, shingle=3, threshold=3).collect()), key=str)
    fps = [brute(t) for _, t, _ in rows]
    want = []
    for i, r in enumerate(roots(fps)):
        ids = [rows[j][0] for j, q in enumerate(roots(fps)) if q == r and rows[j][0] is not None]
        want.append((rows[i][0], f"{fps[i]:016x}", min(ids, default=None)))
    assert got == sorted(want, key=str)
    named = simhash.near_duplicates(df.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), shingle=3, threshold=3)
    assert sorted(((r["doc_id"] and int(r["doc_id"][1:]), r["fingerprint"], r["component_id"] and int(r["component_id"][1:])) for r in named.collect()), key=str) == got
    huge = spark.createDataFrame([(1, "lo ha " * 500_000), (2, "lo ha " * 500_000)], "doc_id long, text string")
    assert {r["component_id"] for r in simhash.near_duplicates(huge).collect()} == {1}
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_edited_copies(spark):
    """Of copies edited to a Jaccard similarity of 0.85 or more over five-word shingles nine in ten join their text; others never do."""
    rng, rows = random.Random(12), []
    for n in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(150, 400))]
        rows.append((n * 10, base, 1.0))
        for k in range(1, 4):
            copy = list(base)
            for at in rng.sample(range(len(copy)), max(1, len(copy) // rng.choice((60, 80, 150)))):
                copy[at] = "edited" + str(rng.random())
            x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (base, copy))
            rows.append((n * 10 + k, copy, len(x & y) / len(x | y)))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w, _ in rows], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    close = [got[i] == i // 10 * 10 for i, _, j in rows if i % 10 and j >= 0.85]
    assert len(close) > 60 and sum(close) >= 0.9 * len(close)
    assert all(c // 10 == i // 10 for i, c in got.items())
