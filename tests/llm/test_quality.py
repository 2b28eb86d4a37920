import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece as spm
from pyspark.sql import functions as F

from lamella.llm import quality
from lamella.llm.queries import QUERIES
from lamella.llm.vocab import vocabulary


def brute(text):
    words = [w for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line in seen and line.strip(" \t\n\r\x0b\x0c"):
            dup += 1
        seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_base_counts_against_brute_force():
    meter, rng = quality.Meter("piece_bpe_32k.model"), random.Random(4)
    for _ in range(400):
        text = "".join(rng.choice(["a", "b", "ß", "日", " ", " ", "\n", "\t", "#", "<x>", " ", "\x1c"]) for _ in range(rng.randint(0, 60)))
        m = meter.measure(text.encode())
        assert tuple(m[n] for n in NAMES) == brute(text), text


def test_fertility_against_the_library():
    """The figures of whole texts, from the public file by its own library."""
    meter, rng = quality.Meter("piece_bpe_32k.model"), random.Random(8)
    sp = spm.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    for _ in range(200):
        text = "".join(rng.choice(["word", "ing", " ", " ", "\n", "日本", "é", "##", "<|endoftext|>", "7", "힣"]) for _ in range(rng.randint(1, 80)))
        m, ids, parts = meter.measure(text.encode()), sp.encode(text), sp.encode(text, out_type=str)
        assert m["n_tokens"] == len(ids)
        if ids:
            p = [n / len(ids) for n in Counter(ids).values()]
            want = (len(text) / len(ids), sum(bool(re.fullmatch("<0x..>", x)) for x in parts) / len(parts), -sum(x * math.log2(x) for x in p))
            assert [m[n] for n in quality.REACH] == pytest.approx(want, abs=1e-9)


def corpus(n=300):
    """Ordinary English-like texts, and for each figure texts that only it can tell."""
    rng = random.Random(3)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(4000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(80, 400))), "en") for i in range(n)]
    spoiled = {
        "chars_per_token": " ".join(f"{rng.choice(words)}#{rng.choice('!?;~')}" for _ in range(300)),
        "byte_share": " ".join(rng.choice(words) + rng.choice(["\U00013000", "\U00012000", ""]) for _ in range(300)),
        "entropy": " ".join(rng.choice(words[:40]) for _ in range(300)),
    }
    return rows, {1000 + k: (name, text) for k, (name, text) in enumerate(spoiled.items())}


def test_each_figure_rejects(spark):
    rows, spoiled = corpus()
    df = spark.createDataFrame([*rows, *((i, t, "en") for i, (_, t) in spoiled.items())], "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"]: r for r in quality.rules(df, lang_col="lang").collect()}
    assert sum(got[i]["kept"] for i, *_ in rows) >= 0.98 * len(rows)
    for i, (name, _) in spoiled.items():
        assert name in got[i]["outside"] and not got[i]["kept"]


def test_bands_against_brute_force(spark):
    rows, spoiled = corpus(120)
    df = spark.createDataFrame([*rows, *rows[:20], *((i, t, "en") for i, (_, t) in spoiled.items())], "doc_id long, text string, lang string")
    meter = quality.Meter("piece_bpe_32k.model")
    texts = sorted({t for _, t, _ in rows} | {t for _, t in spoiled.values()})
    m = {t: meter.measure(t.encode()) for t in texts}
    x, y = np.log2([m[t]["n_tokens"] for t in texts]), np.array([m[t]["entropy"] for t in texts])
    curve = np.polyfit(x, y, 2)
    middle = lambda v: sorted(v)[(len(v) + 1) // 2 - 1]
    levelled = {
        **{n: np.array([m[t][n] for t in texts]) - middle([m[t][n] for t in texts]) for n in ("chars_per_token",)},
        "byte_share": np.array([m[t]["byte_share"] for t in texts]), "entropy": y - np.polyval(curve, x),
    }
    levelled["chars_per_token"] *= np.sqrt([m[t]["n_tokens"] for t in texts])
    want = {t: [] for t in texts}
    for name, v in levelled.items():
        q = [sorted(v)[math.ceil(p * len(v)) - 1] for p in (0.25, 0.5, 0.75)]
        low, high = quality.REACH[name]
        wide = max(q[2] - q[0], quality.NARROW[name]) * (1 + 3 / math.sqrt(len(texts)))
        for t, value in zip(texts, v):
            if (low is not None and value < q[1] - low * wide) or value > q[1] + high * wide:
                want[t].append(name)
    by_id = {**{i: t for i, t, _ in rows}, **{i: t for i, (_, t) in spoiled.items()}}
    for r in quality.rules(df, lang_col="lang").collect():
        assert list(r["outside"]) == want[by_id[r["doc_id"]]], r["doc_id"]


def test_query_keeps_prose_and_rejects_junk(spark, tiny):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{tiny}/labels.parquet").collect()}
    rows = {r["doc_id"]: r for r in QUERIES["op3_quality"](spark, tiny).collect()}
    assert rows.keys() == docs.keys()
    for i, r in rows.items():
        assert tuple(r[n] for n in NAMES) == brute(docs[i])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    passed = [(good[i], r["kept"]) for i, r in rows.items() if i in good and not r["base_failed"]]
    assert all(kept for g, kept in passed if g == 1)
    assert sum(not kept for g, kept in passed if g == 0) >= 0.8 * sum(g == 0 for g, _ in passed)


def test_languages_scripts_and_edges(spark):
    rows, _ = corpus(60)
    german = [(2000 + i, t.replace("th", "schü"), "de") for i, t, _ in rows]
    odd = [(1, "힣龥ꀀ " * 60, None), (3, None, "en"), (4, "", "xx"), (5, "x" * 30, "en"), (5, "x" * 30, "en"), (None, rows[0][1], None), (6, "lo " * 400_000, "en")]
    df = spark.createDataFrame([(*r, True) for r in [*((100 + i, t, g) for i, t, g in rows), *german, *odd]], "doc_id long, text string, lang string, kept boolean")
    measured = quality.rules(df, lang_col="lang")
    got = {r["doc_id"]: r for r in measured.collect()}
    assert got[1]["script"] == "Cjk" and not got[3]["kept"] and got[4]["chars_per_token"] is None and got[6]["base_failed"] and got[None]["kept"]
    bands = {r["group"] for r in quality.fit(measured.withColumn("digest", F.xxhash64("n_words", "n_tokens", "entropy"))).collect()}
    assert bands == {"l:en", "l:de", "s:Latin", "*"}
    few = quality.rules(df.limit(5), lang_col="lang").collect()
    assert all(r["kept"] != r["base_failed"] and not r["outside"] for r in few)
    assert quality.rules(df.limit(0)).count() == 0
    assert quality.rules(df, carry=True).select("row.*").columns == df.columns
