import itertools
import random

from lamella.llm import licenses
from lamella.llm.licenses import Automaton, Scanner, words_of
from lamella.llm.queries import QUERIES


def test_matching_statistics_against_brute_force():
    rng = random.Random(2)
    for _ in range(150):
        templates = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 12))] for _ in range(3)]
        text = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(30)]
        inside = lambda w: any(t[i : i + len(w)] == w for t in templates for i in range(len(t)))
        automaton = Automaton(templates)
        for i, (state, n) in enumerate(automaton.statistics(text), 1):
            assert n == max(k for k in range(i + 1) if k == 0 or inside(text[i - k : i]))
            if n:
                want = {(t, e) for t, w in enumerate(templates) for e in range(n - 1, len(w)) if w[e - n + 1 : e + 1] == text[i - n : i]}
                assert set(automaton.ends[state]) == want


def brute(text):
    words, places, labels = words_of(text or ""), [], set()
    for label, phrase in licenses.PHRASES.items():
        p = words_of(phrase)
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


BASE = ("n_words", "n_base", "first_word", "last_word", "base_labels")


def test_query(spark, tiny):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    rows = QUERIES["op9_licenses"](spark, tiny).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert tuple(r[n] for n in BASE) == brute(docs[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_chains_cover_templates_with_gaps():
    s = Scanner()
    label, grant = next(x for x in licenses.templates() if x[1].startswith("Permission is hereby granted, free of charge, to any person obtaining"))
    words = grant.split()
    changed = " ".join(words[:20] + ["INSERTED", "words"] + words[20:30] + words[33:])
    got = s.scan(f"intro {changed} outro".encode())
    assert got["labels"] == "mit" and got["score"] > 0.8 and got["base_labels"] == ""
    assert any(x["label"] == "mit" and x["start"] == 1 for x in got["spans"])
    assert s.scan(" ".join(reversed(words)).encode())["labels"] == ""
    assert s.scan(b"Licensed under CC BY-NC 4.0.")["labels"] == "cc-by-nc"
    assert s.scan(" ".join(words[:8]).encode())["labels"] == ""  # far too little of it
    assert s.scan(b"the mit license and the gnu General Public License, apache license")["base_labels"] == "apache,gpl,mit"


def test_chains_cover_the_most_words():
    """Against all ordered choices of matches."""
    rng, s = random.Random(7), Scanner((("x", "a b c d e f g h i j k l m n o p q r"),), least=1, gap=3)
    for _ in range(300):
        found = sorted({(rng.randint(0, 12), rng.randint(0, 12), rng.randint(1, 5)) for _ in range(rng.randint(1, 6))})
        most = 0
        for k in range(1, len(found) + 1):
            for chain in itertools.combinations(found, k):
                total, ok = chain[0][2], True
                for (a, b, n), (c, d, m) in zip(chain, chain[1:]):
                    over = max(0, a + n - c, b + n - d)
                    ok = ok and over < m and c + over - a - n <= 3 and d + over - b - n <= 3
                    total += m - over
                most = max(most, total if ok else 0)
        assert max(c for *_, c in s.chained(found, 1)) == most


def test_recall_and_precision_on_edited_licences():
    """Each licence's text with a word in 25 changed, whole or by the paragraph, amid prose; and prose of the same words."""
    rng, s = random.Random(3), licenses.scanner()
    filler = ["invented", "prosewords", "thatnolicence", "holds", "the", "and", "of", "this"]
    edit = lambda words: [w if rng.random() > 0.04 else rng.choice(filler) for w in words]
    prose = lambda n: [rng.choice(filler) for _ in range(n)]
    whole = paragraphs = caught = wrong = 0
    by_label = {}
    for label, text in licenses.templates():
        if len(text.split()) >= 30:
            by_label.setdefault(label, []).append(text)
    for label, parts in by_label.items():
        got = s.scan(" ".join([*prose(50), *edit(" ".join(parts).split()), *prose(50)]).encode())["labels"].split(",")
        whole += label in got
        for text in rng.sample(parts, min(6, len(parts))):
            got = s.scan(" ".join([*prose(50), *edit(text.split()), *prose(50)]).encode())["labels"].split(",")
            paragraphs, caught, wrong = paragraphs + 1, caught + (label in got), wrong + len(set(got) - {label, ""})
    assert whole == len(by_label) >= 10 and caught >= 0.95 * paragraphs and wrong <= 0.05 * paragraphs
    vocabulary = sorted({w for _, t in licenses.templates() for w in t.split()})
    assert not any(s.scan(" ".join(rng.choice(vocabulary) for _ in range(400)).encode())["labels"] for _ in range(50))


def test_parts_of_a_licence_are_enough():
    s = licenses.scanner()
    assert s.scan(b"X THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF")["labels"] == "mit"


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "MIT license MIT License"), (3, "x " * 80_000 + "mit license"), (3, "x"), (3, "x")]
    df = spark.createDataFrame([(*r, "l") for r in rows], "doc_id long, text string, labels string")
    got = sorted((tuple(r[n] for n in BASE) for r in licenses.scan(df).collect()), key=str)
    assert got == sorted((brute(t) for _, t in rows), key=str)
    assert licenses.scan(df.limit(0)).count() == 0
