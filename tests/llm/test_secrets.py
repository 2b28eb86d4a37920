import hashlib
import random
import re

from lamella.llm import secrets
from lamella.llm.queries import QUERIES

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    spans = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [sum(k == n for _, k, _ in spans) for n in range(3)], ",".join(s for *_, s in sorted(spans))


def test_base_spans_against_plain_patterns():
    rng = random.Random(6)
    parts = ["password", "PassWd", "tOken", "api_key", "apikey", "=", ":", '"', "'", " ", "AKIA", "ABCDEF0123456789", "deadbeef", "0123456789abcdef", "é", "ſecret", "secret", "x", "-._", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        found = secrets.base_spans(text)
        counts, joined = brute(text)
        assert [sum(k == kind for *_, k in found) for kind in secrets.KINDS[:3]] == counts and secrets._join(found) == joined, text


def test_novel_strings_near_sensitive_words_only():
    rng = random.Random(7)
    random_key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    primed = secrets.trained()
    found = lambda t: [t[a:b] for a, b, k in secrets.novel_spans(t, secrets.base_spans(t), primed)]
    assert found(f"the private key is {random_key} they said") == [random_key]
    assert found(f"Authorization: Bearer {random_key}") == [random_key]
    assert found(f"the nice word is {random_key} they said") == []
    assert found("the private key is getElementByIdAndReturnResponse2 they said") == []
    assert found(f"copied {random_key} twice, the key {random_key} again") == []  # the neighbourhood explains it
    assert found("the key is aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1 they said") == []
    assert secrets.novelty(random_key, "the key", "", primed) >= 1.5 * secrets.novelty("configurationManagerInstance1234567890ab", "the key", "", primed)


def test_query(spark, tiny):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    rows = QUERIES["op8_secrets"](spark, tiny).collect()
    assert len(rows) == len(docs)
    for r in rows:
        counts, joined = brute(docs[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == counts and r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(r["spans"].split(","))


def test_edges_and_redaction(spark):
    rows = [(1, None), (2, ""), (None, "é token = abcdefabcdef12345678 end"), (3, "x" * 100_000 + " password: hunter2hunter2"), (3, "plain"), (3, "plain")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, spans string")
    got = secrets.scan(df, carry=True)
    assert got.count() == 6 and got.select("row.*").columns == df.columns
    assert [r["spans"] for r in got.where("doc_id is null").collect()] == ["assign:2:30,hex:10:30"]
    clean = {r["row"]["text"]: r["text"] for r in secrets.redact(got).collect()}
    assert clean["plain"] is None and clean[rows[2][1]] == "é [REDACTED] end" and clean[rows[3][1]].endswith("x [REDACTED]")
    assert secrets.scan(df.limit(0)).count() == 0


def planted(docs, n, copies=1):
    """Texts with a secret that no pattern knows, in the midst of them, and the secrets."""
    rng, out = random.Random(9), []
    alphabets = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789ABCDEF")
    shapes = ('signingKey, "{}"', 'put("{}", clientSecret)', "Authorization: Bearer {}", "private_key => {}", "credentials {} follow")
    for k in range(n):
        value = "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(20, 48)))
        words = rng.choice(docs).split(" ")
        words.insert(rng.randint(0, len(words)), rng.choice(shapes).format(value))
        out += [(" ".join(words), value)] * copies
    return out


def test_recall_of_planted_secrets_and_clean_texts(spark, tiny):
    """Nine in ten planted secrets are found, those that the corpus repeats among them, and few clean texts report anything."""
    docs = [r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect() if r["text"] and len(r["text"]) > 300]
    rows = planted(docs, 150) + planted(docs[::-1], 1, 300)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)] + [(-1 - i, t) for i, t in enumerate(docs)], "doc_id long, text string").repartition(4)
    spans = {r["doc_id"]: r["found"] for r in secrets.scan(df).collect()}
    caught = [any(s["start"] <= t.find(v) and t.find(v) + len(v) <= s["end"] for s in spans[i]) for i, (t, v) in enumerate(rows)]
    assert sum(caught[:150]) >= 135 and all(caught[150:])
    assert sum(any(s["kind"] == "novel" for s in spans[-1 - i]) for i in range(len(docs))) <= 0.02 * len(docs)


def test_dictionary_holds_the_corpus(spark):
    df = spark.createDataFrame([(i, f"zorblaxine frobnicator {i} " * 50) for i in range(40)], "doc_id long, text string")
    own, plain = secrets.learn(df), secrets.trained()
    assert own == secrets.learn(df.repartition(3))
    assert secrets.novelty("FrobnicatorZorblaxine", "the key ", "", own) < secrets.novelty("FrobnicatorZorblaxine", "the key ", "", plain)
