import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from lamella.llm import language_id as li
from lamella.llm.queries import QUERIES


def test_codebooks():
    for n in (2, 3, 4, 5, 6, 12, 40):
        code = li.codebook(n)
        assert code.shape[0] == n and set(np.unique(code)) <= {-1, 1}
        assert all((code[i] != code[j]).any() for i in range(n) for j in range(i))
        assert (np.abs(code.sum(0)) < n).all()
    assert li.codebook(4).shape == (4, 7)


def test_held_out_accuracy(spark, tiny):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    rows = QUERIES["op7_language_id"](spark, tiny).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_many_languages_and_errors_corrected(spark):
    rng = random.Random(1)
    letters = {f"l{k}": "".join(rng.sample("abcdefghijklmnopqrstuvwxyzéèßñøåλμξ", 9)) for k in range(9)}
    text = lambda lang, n=60: " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(2, 8))) for _ in range(n))
    rows = [(lang, text(lang)) for lang in letters for _ in range(12)]
    model = li.train(spark.createDataFrame(rows, "lang string, text string"))
    tests = [(lang, text(lang, 40)) for lang in letters for _ in range(10)]
    assert sum(model.predict(t.encode())[0] == lang for lang, t in tests) >= 0.97 * len(tests)
    broken = model.weights.copy()
    model.weights = broken.copy()
    model.weights[:, 0] = 0  # one classifier lost
    assert sum(model.predict(t.encode())[0] == lang for lang, t in tests) >= 0.9 * len(tests)


def plain_grams(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c if "a" <= c <= "z" or ord(c) > 127 else " " for c in text)
    b = re.sub(" +", " ", f" {low} ").encode()
    out = []
    for n, more in ((1, 0), (2, 100_003), (3, 50_000_017)):
        for i in range(len(b) - n + 1):
            x = b[i] + 1
            for k, base in zip(range(1, n), (263, 269)):
                x = x * base + b[i + k] + 1
            out.append((x + more) * 0x9E3779B1 >> 13 & li.BUCKETS - 1)
    return out


def brute(learn, text):
    """Language and score by the definition, in plain loops."""
    languages = sorted({lang for lang, _ in learn})
    counts = {lang: Counter(g for x, t in learn if x == lang for g in plain_grams(t)) for lang in languages}
    share = {lang: lambda g, c=counts[lang], n=sum(counts[lang].values()): (c[g] + 0.5) / (n + 0.5 * li.BUCKETS) for lang in languages}
    code, grams, seen = li.codebook(len(languages)), plain_grams(text), range(li.BUCKETS)
    loss, trust = [0.0] * len(languages), []
    losses = []
    for column in code.T:
        sides = {s: [x for x, c in zip(languages, column) if c == s] for s in (1, -1)}
        weight = {g: math.log(sum(share[x](g) for x in sides[1]) / len(sides[1])) - math.log(sum(share[x](g) for x in sides[-1]) / len(sides[-1])) for g in seen}
        margins = [sum(share[x](g) * weight[g] for g in seen) for x in languages]
        centre = sum(sum(m for m, c in zip(margins, column) if c == s) / len(sides[s]) for s in (1, -1)) / 2
        trust.append(max(1e-3, min(c * (m - centre) for m, c in zip(margins, column))))
        margin = (sum(weight[g] for g in grams) - len(grams) * centre) / len(grams) ** 0.75
        losses.append([math.log1p(math.exp(-c * margin)) for c in column])
    for t, each in zip(trust, losses):
        loss = [a + t / sum(trust) * b for a, b in zip(loss, each)]
    likely = [math.exp(-(x - min(loss)) * len(trust)) for x in loss]
    return languages[loss.index(min(loss))], max(likely) / sum(likely)


def test_against_brute_force(spark):
    rng = random.Random(6)
    letters = {"a": "aeinrst", "b": "aéèlmrs", "c": "öüßchen"}
    docs = [(i, " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(1, 30))), lang) for i, lang in enumerate(rng.choices("abc", k=24))]
    docs += [(50, "Mixed aeinrst öüßchen éèlmrs 12!", "a"), (51, "x", None)]
    learn = [(lang, t) for i, t, lang in docs if lang and zlib.crc32(str(i).encode()) % 3 != 1]
    for r in li.cross_fit(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(2)).collect():
        lang, score = brute(learn, dict((i, t) for i, t, _ in docs)[r["doc_id"]])
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-3


def test_edges(spark):
    rows = [(1, "hello there friend", "en"), (2, "bonjour mon ami", "fr"), (3, None, "en"), (4, " 12 :) ", "fr"), (5, "hello friend", None), (None, "mon ami", None), (6, "hello " * 50000, "en"), (6, "hello " * 50000, "en")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r["doc_id"]: r for r in li.cross_fit(df).collect()}
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == "und" and got[4]["score"] == 0 and got[3]["ambiguous"]
    assert got[6]["lang_pred"] == "en" and len(li.cross_fit(df).collect()) == 8
    assert li.cross_fit(df.limit(0)).count() == 0
    nothing = li.cross_fit(df.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    one = li.cross_fit(df.selectExpr("doc_id", "text", "'xx' lang")).collect()
    assert {r["lang_pred"] for r in one} == {"xx", "und"}
