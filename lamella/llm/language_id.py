"""Language identification by error-correcting output codes.

Every language gets a codeword; every column of the code is a two-class problem
that one linear classifier over hashed byte n-grams answers.  Classifier weights
are log-odds of the n-gram counts of the two groups of languages, which come
from one distributed sum over all learning rows.  Decoding adds each column's
logistic loss, weighted by how well the column separates the learning counts,
and takes the codeword of least loss; the runner-up's distance gives the score
and the ambiguity flag.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, is_held_out, texts

#: Hash buckets of n-grams of one to three bytes.
BUCKETS = 1 << 14
#: Up to this many languages the code is exhaustive; beyond, random columns are drawn.
EXHAUSTIVE = 5
COLUMNS = 31
#: Languages that can be told apart: each takes 128 KB of a task's and the driver's memory.
LANGUAGES = 1_024
SMOOTH = 0.5
#: Scores below this are flagged as ambiguous.
CLEAR = 0.6
#: A margin is divided by this power of the number of n-grams: neighbours are not independent.
DAMP = 0.75
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 65 or 91 <= c < 97 or 123 <= c < 128 else c for c in range(256))
_SPACES = re.compile(rb" +")
UNDETERMINED = "und"


def codebook(languages: int, seed: int = 7) -> np.ndarray:
    """One row of +1 and -1 per language; columns differ from each other and their opposites."""
    if languages <= 1:
        return np.ones((languages, 1))
    if languages <= EXHAUSTIVE:
        return np.array([(1, *c) for c in product((1, -1), repeat=languages - 1) if -1 in c]).T
    rng, best = np.random.default_rng(seed), None
    for _ in range(200):  # the draw whose nearest codewords are farthest apart
        code = rng.choice((1, -1), (languages, max(COLUMNS, 2 * languages.bit_length() + 1)))
        code = code[:, np.abs(code.sum(0)) < languages]
        alike = code.astype(np.float32) @ code.T
        apart = (code.shape[1] - alike[np.triu_indices(languages, 1)].max()) / 2
        if best is None or apart > best[0]:
            best = apart, code
    return best[1]


def grams(text: bytes | None) -> np.ndarray:
    """Buckets of the n-grams of a text; other than letters counts as one space."""
    if not text:
        return np.zeros(0, np.int64)
    b = np.frombuffer(_SPACES.sub(b" ", b" " + text.translate(_LOWER) + b" "), np.uint8).astype(np.int64)
    one = b + 1
    two = one[:-1] * 263 + one[1:]
    three = two[:-1] * 269 + one[2:]
    return np.concatenate([x * 0x9E3779B1 >> 13 & BUCKETS - 1 for x in (one, two + 100_003, three + 50_000_017)])


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return any(map(str.isalpha, text.decode()))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in in_slices(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), texts(batch.column("text"))):
            if lang not in total:
                total[lang] = np.zeros(BUCKETS, np.int64)
            total[lang] += np.bincount(grams(text), minlength=BUCKETS)
    for lang, counts in total.items():
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(counts[some])], ["lang", "bucket", "n"])


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray):
        """counts: n-grams by language and bucket."""
        self.languages = languages
        self.code = codebook(len(languages)).astype(float)
        shares = (counts + SMOOTH) / (counts.sum(1, keepdims=True) + SMOOTH * BUCKETS)
        plus, minus = (np.maximum(self.code.T * s, 0) @ shares / np.maximum(np.maximum(self.code.T * s, 0).sum(1, keepdims=True), 1) for s in (1, -1))
        self.weights = (np.log(np.maximum(plus, 1e-12)) - np.log(np.maximum(minus, 1e-12))).T.astype(np.float32)
        # how far apart the column's own groups lie, per n-gram
        margins = shares @ self.weights
        self.centre = ((margins * (self.code > 0)).sum(0) / np.maximum((self.code > 0).sum(0), 1) + (margins * (self.code < 0)).sum(0) / np.maximum((self.code < 0).sum(0), 1)) / 2
        gap = np.minimum.reduce(self.code * (margins - self.centre), 0) if len(languages) > 1 else np.ones(1)
        self.trust = np.clip(gap, 1e-3, None)
        self.trust /= self.trust.sum()

    def predict(self, text: bytes | None) -> tuple[str, float, bool]:
        """Language, score, ambiguous."""
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        at = grams(text)
        margin = np.zeros(self.weights.shape[1])
        for k in range(0, len(at), 1 << 16):
            margin += self.weights[at[k : k + (1 << 16)]].sum(0, dtype=np.float64)
        margin = (margin - len(at) * self.centre) / len(at) ** DAMP
        loss = (self.trust * np.logaddexp(0, -self.code * margin)).sum(1)
        order = np.argsort(loss, kind="stable")
        likely = np.exp(-(loss - loss[order[0]]) * len(self.trust))
        score = float(likely[order[0]] / likely.sum())
        return self.languages[order[0]], score, score < CLEAR


def train(rows: DataFrame) -> Model:
    """From columns lang and text; rows without a language are left out.  What is
    gathered has at most ``BUCKETS`` rows per language; more than ``LANGUAGES``
    of these are an error."""
    if rows.select("lang").where("lang is not null").distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    counted = rows.where("lang is not null").select("lang", "text").mapInArrow(_count, "lang string, bucket int, n long")
    found = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = found["lang"].to_pylist()
    languages = sorted(set(names))
    counts = np.zeros((len(languages), BUCKETS))
    counts[[languages.index(x) for x in names], found["bucket"].to_numpy()] = found["n"].to_numpy()
    return Model(languages, counts)


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches):
        found = list(zip(*(model.predict(t) for t in texts(batch.column("text")))))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found[0], pa.string()), pa.array(found[1], pa.float64()), pa.array(found[2], pa.bool_())], ["id", "lang_pred", "score", "ambiguous"])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score from 0 to 1, ambiguous.

    A text that is null or has no letter, and any text if nothing was learnt,
    gets ``und``, score 0 and is ambiguous.  Repeated rows and null ids are
    predicted like any other; other columns are not read; an empty table gives
    no row.  No shuffle.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(partial(_predict, model=model), f"id {dict(rows.dtypes)['id']}, lang_pred string, score double, ambiguous boolean").withColumnRenamed("id", id_col)


def cross_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held_out: int = 1) -> DataFrame:
    """``identify`` for all documents, learnt from those outside the held-out fold."""
    held = is_held_out(F.col(id_col), folds, held_out)
    model = train(docs.where(~held).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")))
    return identify(docs, model, id_col, text_col).select(id_col, held.alias("held_out"), "lang_pred", "score", "ambiguous")
