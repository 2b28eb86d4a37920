import math
import zlib
from collections import Counter

import numpy as np
import pytest

from lamella.llm import language_model as lm
from lamella.llm.common import most_frequent


def check_base(rows, docs):
    counts = Counter()
    for i, t in docs:
        if zlib.crc32(str("" if i is None else i).encode()) % 10:
            counts.update([*(t or "").encode().lower().split(), lm.END])
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(docs)
    want = Counter()
    for i, t in docs:
        tokens = [*(t or "").encode().lower().split(), lm.END]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        want[(i, zlib.crc32(str("" if i is None else i).encode()) % 10 == 0, len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 5))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in rows) == want


@pytest.mark.parametrize("lexicon", [300, lm.LEXICON])
def test_exact_counts_with_any_lexicon(spark, tiny, lexicon):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = lm.score(docs, lexicon=lexicon, clustered=100, classes=12).collect()
    check_base(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # lower perplexity than the unigram


def test_probabilities_sum_to_one():
    """Over all words and the unseen one, after any class and after an unseen word."""
    words, counts = [lm.END, b"a", b"b", b"c."], [5, 7, 3, 2]
    book = lm.Lexicon(words, counts, [0, 0, 1, 2])
    m = lm.Model(book, np.random.default_rng(1).integers(0, 9, (3, 3)).astype(float), np.array([12.0, 3, 2]), np.array([2.0, 1, 1]), 17, 4)
    for before in range(4):
        seen = sum(10 ** (m.log_move[before, c] + m.log_count[i] - m.class_base[c]) for i, c in enumerate(book.classes))
        assert math.isclose(seen + 10 ** m.log_move[before, m.unseen], 1)


def brute_score(docs, classes, head, text):
    """The model by its definition, from the class of every word; head: the words whose bigrams are counted whole."""
    tokens = lambda t: [*(t or "").encode().lower().split(), lm.END]
    counts, size = Counter(), max(classes.values()) + 1
    table, left, right = np.zeros((size, size)), np.zeros(size), np.zeros(size)
    for t in docs:
        before = lm.END
        for w in tokens(t):
            counts[w] += 1
            if before in head or w in head:
                table[classes[before], classes[w]] += 1
            else:
                right[classes[before]] += 1
                left[classes[w]] += 1
            before = w
    table += np.outer(right, left) / max(1, right.sum())
    n = np.array([sum(k for w, k in counts.items() if classes[w] == c) for c in range(size)], float)
    d = np.array([sum(classes[w] == c for w in counts) for c in range(size)], float)
    share, base = (n + 0.1) / (n.sum() + 0.1 * size), n + 0.1 * (d + 1)
    out, before = 0.0, classes[lm.END]
    for w in tokens(text):
        move = share if before is None else (table[before] + size * share) / (table[before].sum() + size)
        before = classes.get(w)
        out += math.log10((move * 0.1 / base).sum() if before is None else move[before] * (counts[w] + 0.1) / base[before])
    return out


def test_score_against_brute_force_with_any_lexicon(spark):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(300)]
    p = 1 / np.arange(1, 301)
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 60), p=p / p.sum())) + (" never%d" % i if i % 7 == 0 else "")) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 10 == 0}
    learn = [t for i, t in docs if i not in held]
    model, book = lm.train(df.where(~df.doc_id.isin(*held)), clustered=40, classes=6)
    classes = dict(zip(model.lexicon.number, model.lexicon.classes.tolist()))
    assert classes.keys() == {r["word"] for r in book.collect()} and len(set(classes.values())) == 6
    head = {w for w, _ in most_frequent(book, 40)} | {lm.END}
    for lexicon in (lm.LEXICON, 60, 45):
        rows = lm.score(df, lexicon=lexicon, clustered=40, classes=6).collect()
        assert len(rows) == len(docs)
        for r in rows:
            assert math.isclose(r["score"], brute_score(learn, classes, head, dict(docs)[r["doc_id"]]), abs_tol=1e-6)


def test_query_counts_transitions_beyond_the_clustered_words(spark, tmp_path):
    """With more words than are clustered: the class pairs of all neighbours, two further words' too."""
    from lamella.llm.queries import QUERIES

    rng = np.random.default_rng(11)
    docs = [(i, " ".join(f"w{k}" for j in rng.integers(0, 1_500, 20) for k in (j, (j + 1) % 1_500)) + (" never%d" % i if i % 20 == 0 else "")) for i in range(300)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    learn = [(t,) for i, t in docs if zlib.crc32(str(i).encode()) % 10]
    model, _ = lm.train(spark.createDataFrame(learn, "text string"))
    classes = dict(zip(model.lexicon.number, model.lexicon.classes.tolist()))
    assert len(classes) > lm.CLUSTERED + 300
    got = {r["doc_id"]: r["score"] for r in QUERIES["op4_language_model"](spark, str(tmp_path)).collect()}
    assert got.keys() == {i for i, _ in docs}
    for i in [*range(0, 300, 60), *[i for i, _ in docs if zlib.crc32(str(i).encode()) % 10 == 0][:3]]:
        assert math.isclose(got[i], brute_score([t for (t,) in learn], classes, classes.keys(), docs[i][1]), abs_tol=1e-6)


@pytest.mark.parametrize("lexicon", [lm.LEXICON, 60, 45])
def test_exact_transitions_with_any_lexicon(spark, lexicon):
    rng = np.random.default_rng(7)
    p = 1 / np.arange(1, 301)
    docs = [(i, " ".join(f"w{k}" for k in rng.choice(300, rng.integers(0, 60), p=p / p.sum())) + (" never%d" % i if i % 7 == 0 else "")) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    learn = [t for i, t in docs if zlib.crc32(str(i).encode()) % 10]
    model, _ = lm.train(spark.createDataFrame([(t,) for t in learn], "text string"), clustered=40, classes=6)
    classes = dict(zip(model.lexicon.number, model.lexicon.classes.tolist()))
    rows = lm.score(df, exact=True, lexicon=lexicon, clustered=40, classes=6).collect()
    check_base(rows, docs)
    for r in rows:
        assert math.isclose(r["score"], brute_score(learn, classes, classes.keys(), dict(docs)[r["doc_id"]]), abs_tol=1e-6)


def test_words_with_the_same_neighbours_share_a_class(spark):
    """Two alternating groups of words: the further words join the group they act like."""
    rng = np.random.default_rng(2)
    first, second = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    p = 1 / np.arange(1, 61)
    docs = [(i, " ".join(x for _ in range(40) for x in (rng.choice(first, p=p / p.sum()), rng.choice(second, p=p / p.sum())))) for i in range(60)]
    model, _ = lm.train(spark.createDataFrame(docs, "doc_id long, text string"), clustered=20, classes=3)
    found = {w: int(model.lexicon.classes[i]) for w, i in model.lexicon.number.items()}
    a, b = (Counter(c for w, c in found.items() if w[:1] == x).most_common(1)[0] for x in (b"a", b"b"))
    assert a[0] != b[0] and a[1] >= 0.9 * 60 and b[1] >= 0.9 * 60


def likelihood(pairs, where):
    size = where.max() + 1
    table = np.zeros((size, size))
    np.add.at(table, (where[:, None].repeat(len(where), 1), where[None].repeat(len(where), 0)), pairs)
    h = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return h(table) - h(table.sum(0)) - h(table.sum(1))


def test_exchange_ends_where_no_single_move_helps():
    rng = np.random.default_rng(3)
    pairs = rng.poisson(3, (14, 14)) * rng.integers(0, 2, (14, 14)).astype(float)
    where = lm.exchange(pairs, 4, 2, rounds=50)
    best = likelihood(pairs, where)
    assert where[-2:].tolist() == [4, 5]
    for w in range(12):
        for c in range(4):
            other = where.copy()
            other[w] = c
            assert likelihood(pairs, other) <= best + 1e-6


def test_edges(spark):
    docs = [(1, None), (None, "A b."), (7, ""), (7, ""), (9, "x 1 é ! " * 5000)]
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, score double")
    check_base(lm.score(df).collect(), docs)
    assert lm.score(df.limit(0)).count() == 0
    alone = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0][0]
    row = lm.score(spark.createDataFrame([(alone, "a b")], "doc_id long, text string")).first()
    assert row["held_out"] and row["train_tokens"] == 0 and row["n_known"] == 0 and math.isfinite(row["score"])


def test_edges_with_exact_transitions(spark):
    docs = [(1, None), (None, "A b."), (7, ""), (7, ""), (9, "x 1 é ! " * 5000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = lm.score(df, exact=True).collect()
    check_base(rows, docs)
    assert all(math.isfinite(r["score"]) for r in rows)
    assert lm.score(df.limit(0), exact=True).count() == 0
    alone = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0][0]
    row = lm.score(spark.createDataFrame([(alone, "a b")], "doc_id long, text string"), exact=True).first()
    assert row["held_out"] and row["train_tokens"] == 0 and math.isfinite(row["score"])
