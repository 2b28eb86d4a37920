import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from lamella.llm import packing
from lamella.llm.queries import QUERIES
from lamella.llm.vocab import ByteBPE, vocabulary


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


@pytest.mark.parametrize("special", [True, False])
def test_ids_equal_the_library(special):
    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    t.encode_special_tokens = not special
    rng, bpe = random.Random(5), ByteBPE(special=special)
    alphabet = ["a", "bc", " ", " ", "\n", "\t", "é", "'s", "!", "7", " ", "　", "\x1c", "\x85", "​", "\0", "<|endoftext|>", "日本"]
    for _ in range(5000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12)))
        assert bpe.ids(text).tolist() == t.encode(text, add_special_tokens=False).ids, text
    assert bpe.ids("hi <|endoftext|> there").tolist() == ([5303, 220, 50256, 612] if special else [5303, 1279, 91, 437, 1659, 5239, 91, 29, 612])
    assert len(bpe.ids(" " * 2_000_000 + "x")) > 0 and bpe.ids(None).tolist() == []


def test_best_fit_is_whole_and_fits():
    rng = random.Random(1)
    for _ in range(50):
        need = {rng.randint(1, 63): rng.randint(1, 40) for _ in range(12)}
        done = packing.tidy(packing.best_fit(need, [], 64))
        assert packing.used(done) == Counter(need) and all(packing.fill(p) <= 64 for p, _ in done)


def test_crossover_and_mutation_keep_every_piece():
    rng = random.Random(2)
    need = Counter({rng.randint(1, 99): rng.randint(1, 30) for _ in range(25)})
    a, b = (packing.evolve(need, [], 100, 0, 4, s)[i] for s, i in ((1, 1), (2, 2)))
    for child in (packing.crossover(a, b, need, 100, rng), packing.mutate(a, 100, rng)):
        assert packing.used(child) == need and all(packing.fill(p) <= 100 for p, _ in child)
    best = packing.evolve(need, [a, b], 100, 10, 6, 3)[0]
    assert packing.fitness(best, 100) <= min(packing.fitness(x, 100) for x in (a, b))


def test_search_beats_best_fit_decreasing(spark):
    """Triplets (Falkenauer, 1996): each sequence can be filled by three pieces; best-fit decreasing can't find them."""
    rng, need = random.Random(11), Counter()
    for _ in range(20):
        a = rng.randint(380, 490)
        b = rng.randint(251, (1000 - a) // 2)
        need.update((a, b, 1000 - a - b))
    bfd = sum(c for _, c in packing.best_fit(need, [], 1000))
    done = packing.solve(spark, need, 1000)
    found = sum(c for _, c in done)
    assert packing.used(done) == need and 20 <= found < bfd


def check(rows, docs, whole, capacity=packing.CAPACITY):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for i, text in docs.items():
        ids, at = [*whole(text), 0], 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == capacity)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_seq), -(-sum(r["length"] for r in rows) // capacity)


def test_query(spark, tiny, whole):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    n, bound = check(QUERIES["op2_packing"](spark, tiny).collect(), docs, whole)
    assert n <= bound + 1


def test_edges(spark, whole):
    docs = {1: None, 2: "", 3: "word " * 100, 4: "a b  c \n d", 5: "word"}
    df = spark.createDataFrame([(i, t, 0) for i, t in docs.items()], "doc_id long, text string, offset int").repartition(3)
    n, bound = check(packing.pack(df, capacity=32).collect(), docs, whole, 32)
    assert n <= bound + 1
    twice = packing.pack(spark.createDataFrame([(None, "x"), (None, "x"), (1, "x")], "doc_id long, text string")).collect()
    assert len(twice) == 3 and sorted(r["offset"] for r in twice) == [0, 2, 4]
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
