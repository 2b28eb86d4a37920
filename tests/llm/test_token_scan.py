import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from lamella.llm import token_scan as ts
from lamella.llm.queries import QUERIES


def brute(tokens, separator):
    out, start = [], 0
    for i, t in enumerate(tokens):
        if t == separator:
            out.append((len(out), start, i + 1 - start, True))
            start = i + 1
    return out + ([(len(out), start, len(tokens) - start, False)] if start < len(tokens) else [])


@pytest.mark.parametrize(("dtype", "separator", "step"), [("<u2", 9, 40), ("<u2", 50256, 64), ("<u4", 9, 50), ("<u4", 0x01020309, 33), ("<u2", 0x0909, 16)])
def test_files_of_any_bytes(spark, tmp_path, dtype, separator, step):
    """Ranges of a few bytes, tokens whose bytes look like separators across token boundaries, a byte order mark, an unended document, an empty file."""
    rng = random.Random(4)
    first = separator & 255
    some = [separator, separator, 1, 2, first << 8 | 7, 7 << 8 | first, separator >> 8 & 255 | first << 8, first, 0x0A0D, 0x2020, 0]
    want, files = Counter(), [[rng.choice(some) for _ in range(rng.randint(0, 150))] for _ in range(6)] + [[separator] * 30, [], [0xBBEF, 0xBF, separator, 3, separator], [0xBBEF, 0xBF, 3], [1]]
    for f, tokens in enumerate(files):
        (tmp_path / f"f{f:02d}").write_bytes(np.array(tokens, dtype).tobytes())
        want.update((f, *x) for x in brute(tokens, separator))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for most in (step, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            spark.conf.set("spark.sql.files.openCostInBytes", 0)
            got = ts.scan(spark, str(tmp_path), separator, dtype).collect()
            assert Counter((int(r["file"][-2:]), *tuple(r)[1:]) for r in got) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_written_files_are_flat(spark, tmp_path):
    docs = spark.createDataFrame([(f"text number {i}" * (i % 5),) for i in range(60)], "text string").repartition(3)
    ts.flatten(docs, str(tmp_path / "f"))
    tokens = np.concatenate([np.fromfile(p, "<u2") for p in sorted((tmp_path / "f").glob("part-*"))])
    assert Counter(tokens.tolist())[ts.SEPARATOR] == 60 and len(tokens) == 60 + sum(len(ts.byte_bpe().ids(r["text"])) for r in docs.collect())


def test_query_equals_packed_lengths(spark, tiny):
    got = {r["doc_id"]: r["n_tokens"] for r in QUERIES["op10_token_counts"](spark, tiny).collect()}
    packed = Counter()
    for r in QUERIES["op2_packing"](spark, tiny).collect():
        packed[r["doc_id"]] += r["length"]
    assert got == packed


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "word " * 3000), (3, "<|endoftext|>"), (3, "<|endoftext|>")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, start int").repartition(2)
    got = Counter((r["doc_id"], r["n_tokens"]) for r in ts.token_counts(df).collect())
    special = len(ts.byte_bpe("byte_bpe_50k.json", False).ids("<|endoftext|>")) + 1
    assert special > 2 and got == Counter({(1, 1): 1, (2, 1): 1, (None, 3): 1, (3, 3002): 1, (3, special): 2}) and sum(got.values()) == 6
    assert ts.token_counts(df.limit(0)).count() == 0
    assert not list(Path(spark.conf.get("spark.checkpoint.dir")).glob("flat-*"))
