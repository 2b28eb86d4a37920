import hashlib
import random
import re
import tracemalloc

import duckdb
import numpy as np
import pytest

from lamella.llm import decontaminate as dc
from lamella.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            p = w[i : i + window]
            for k in range(len(own) - len(p) + 1):
                if own[k : k + len(p)] == p:
                    hit.update(range(k, k + len(p)))
                    if item is not None:
                        found.add(item)
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)


def test_index_against_scanning():
    rng = random.Random(3)
    for _ in range(40):
        n, k = rng.choice([1, 2, 5, 50, 400]), rng.choice([1, 2, 9, 40])
        s = np.array([rng.randint(1, k) for _ in range(n)])
        index = dc.FMIndex.load(dc.FMIndex.of(s).dump())
        assert dc.suffix_array(np.append(s, 0)).tolist() == sorted(range(n + 1), key=lambda i: [*s[i:].tolist(), 0])
        pats = [[rng.randint(1, k + 1) for _ in range(rng.randint(1, 4))] for _ in range(30)]
        m = np.zeros((30, 4), int)
        for row, p in zip(m, pats):
            row[4 - len(p) :] = p
        low, high = index.search(m, np.array(list(map(len, pats))))
        for p, a, b in zip(pats, low, high):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(n - len(p) + 1) if s[i : i + len(p)].tolist() == p]


@pytest.fixture(scope="module")
def case():
    rng = random.Random(8)
    pool = ["Alpha", "beta", "ça", "x9", "the", "THE", "日本"]
    text = lambda n: " ".join(rng.choice(pool) + rng.choice(["", ",", ". ", "\n"]) for _ in range(n))
    items = [(1, "the the"), (2, text(14)), (10, text(25)), (3, None), (4, "?!"), (None, text(12)), (2, text(3)), (7, "zebra")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(30)]
    docs += [(100, items[1][1] + " more " + items[2][1]), (101, "pre " + items[2][1][:80]), (102, None), (103, ""), (104, items[5][1]), (105, "Zebra " * 3), (105, "Zebra " * 3), (None, "a zebra")]
    docs.append((106, ("filler words here " * 9000) + items[2][1]))
    return docs, items


@pytest.mark.parametrize("size", [dc.BATCH_BYTES, 60])
def test_against_brute_force(spark, case, size):
    docs, items = case
    d = spark.createDataFrame([(*x, "row") for x in docs], "doc_id long, text string, n_words string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in dc.digest(dc.scan(d, b, batch_bytes=size)).collect()), key=str)
    assert got == sorted(((i, *brute(t, items)) for i, t in docs), key=str)


def test_spans_are_removed(spark, case):
    docs, items = case
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = dc.scan(d, b, carry=True)
    assert found.select("row.*").columns == d.columns
    kept = {r["id"]: r["text"] for r in dc.remove(found).collect()}
    hits = {r["id"]: r for r in found.collect()}
    for i, t in docs:
        if i is not None:
            assert (kept[i] == t) == (hits[i]["n_hit"] == 0) and len(words(kept[i])) == hits[i]["n_words"] - hits[i]["n_hit"]


def test_ids_of_any_type_and_one_index_for_several_benchmarks(spark, case):
    docs, items = case
    named = [(None if i is None else f"item-{i}", t) for i, t in items]
    d = spark.createDataFrame([(None if i is None else f"d{i}", t) for i, t in docs], "doc_id string, text string").repartition(2)
    index = dc.build(d)
    for part in (named[:3], named[3:], named):
        b = spark.createDataFrame(part, "item_id string, text string")
        got = sorted((tuple(r) for r in dc.digest(dc.search(index, b)).collect()), key=str)
        assert got == sorted(((None if i is None else f"d{i}", *brute(t, part)) for i, t in docs), key=str)


def test_repeated_texts_are_sorted_in_few_rounds():
    s = np.append(np.tile(np.arange(1, 40), 3000), 0)
    order = dc.suffix_array(s)
    assert sorted(order.tolist()) == list(range(len(s))) and order[0] == len(s) - 1 and order[1] == len(s) - 40


def test_memory_of_a_batch():
    """The stated bound: some 20 bytes for each of the benchmark's text, here 1 MB of it."""
    rng = random.Random(1)
    items = [(i, " ".join(f"w{rng.randrange(20_000)}" for _ in range(300)).encode()) for i in range(550)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    phrases = dc.Phrases(items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size > 900_000 and len(phrases.lengths) > 100_000 and peak < 40 * size


def test_memory_of_a_shard():
    """Neither building, writing nor reading an index takes more than some 10 bytes for each of the text, here 2 MB of it."""
    rng = random.Random(2)
    docs = [" ".join(f"word{rng.randrange(20_000)}" for _ in range(400)).encode() for _ in range(500)]
    size = sum(map(len, docs))
    tracemalloc.start()
    data = dc.Shard.of(docs).dump()
    built = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    shard = dc.Shard.load(data)
    read = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size > 1_500_000 and shard.sizes.tolist() == [400] * 500 and built < 12 * size and read < 12 * size, (built / size, read / size)


def test_ranks_at_every_place():
    """Also where a sequence ends with, before or after a word of 64 bits."""
    rng = np.random.default_rng(5)
    for n in (1, 63, 64, 65, 127, 128, 200):
        s = rng.integers(0, 6, n)
        tree = dc.WaveletMatrix.of(s)
        for c in range(int(s.max()) + 1):
            assert tree.rank(np.full(n + 1, c), np.arange(n + 1)).tolist() == [int((s[:i] == c).sum()) for i in range(n + 1)]
        symbol, rank = tree.access(np.arange(n))
        assert symbol.tolist() == s.tolist() and rank.tolist() == [int((s[:i] == s[i]).sum()) for i in range(n)]


def test_empty_tables(spark, case):
    docs, items = case
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert dc.scan(d.limit(0), b).count() == 0
    assert dc.scan(d, b.limit(0)).where("n_hit > 0").count() == 0


def test_query_against_sql(spark, tiny):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    df = QUERIES["op6_decontaminate"](spark, tiny)
    assert sorted(map(tuple, df.collect())) == sorted(c.sql(f"select {', '.join(df.columns)} from ({ORACLE_SQL['op6_decontaminate']})").fetchall())
