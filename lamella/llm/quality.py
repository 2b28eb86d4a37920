"""Quality rules by tokeniser fertility.

Each whole text is encoded with a public SentencePiece vocabulary.  Per text:
characters per token, share of byte-fallback tokens, and entropy of the tokens
in bits.  A text is rejected outside the bands of its language, or else of its
script, or else of all texts.

The bands are fitted to the table itself, over all texts that pass the base
rules, each distinct text once.  Within a language, characters per token scatter
with the root of the number of tokens, and entropy grows with the number of
tokens; so the first is centred at the group's median and scaled by that root
(by a constant in groups of several languages, which differ at any length), and
of the second the group's least-squares parabola in log2(tokens) is taken away.  A band reaches a
number of interquartile ranges (``REACH``) from the median, somewhat more in
small groups, whose quartiles are uncertain.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPREAD, cut, in_slices, texts, with_text
from .vocab import pieces

SYMBOLS = b"#*$%&|<>"
#: White space and the continuation bytes of UTF-8: without them a byte is a code point.
_NOT_CHARS = b"\x20\x09\x0a\x0b\x0c\x0d" + bytes(range(0x80, 0xC0))
#: Interquartile ranges from the median to the lower and the upper end of a band.
REACH = {"chars_per_token": (3.5, 3.5), "byte_share": (None, 6.0), "entropy": (2.5, 6.0)}
#: Ranges count as this wide at least: a group may be nothing but near copies.
NARROW = {"chars_per_token": 0.3, "byte_share": 0.01, "entropy": 0.05}
#: What stands for the root of the number of tokens in a group of several languages.
MIXED = 16.0
#: Bands of such a group are wider by this factor: its commonest language makes the range, and others differ from it.
WIDER = 2.0
#: Distinct texts that a group must have for bands of its own.
LEAST = 16


def repeated(rows: np.ndarray) -> int:
    """Words in windows of three that stand twice or more; rows: word numbers from 0."""
    n = len(rows) - 2
    if n < 2:
        return 0
    width = int(rows.max()) + 1
    if width < 1 << 21:
        key = (rows[:-2] * width + rows[1:-1]) * width + rows[2:]
    else:
        _, pair = np.unique(rows[:-1] * width + rows[1:], return_inverse=True)
        key = pair[:-1].astype(np.int64) * width + rows[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(n + 2, bool)
    for k in range(3):
        hit[k : k + n] |= twice
    return int(hit.sum())


def script(text: str) -> str:
    """Script of most letters among at most the distinct characters of the text."""
    if text.isascii():
        return "Latin"
    seen: dict[str, int] = {}
    for c in set(text):
        if c.isalpha():
            name = unicodedata.name(c, "* ").split()[0].capitalize()
            seen[name] = seen.get(name, 0) + text.count(c)
    return max(sorted(seen), key=seen.get) if seen else "*"


def entropy(ids: np.ndarray) -> float:
    """Bits per token of the text's own distribution of tokens."""
    ids = np.sort(ids)
    n = np.diff(np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1], [True]))))
    return max(0.0, float(np.log2(len(ids)) - (n * np.log2(n)).sum() / len(ids)))


class Meter:
    def __init__(self, vocabulary: str):
        self.sp = pieces(vocabulary)
        self.is_byte = np.array([self.sp.is_byte(i) for i in range(self.sp.get_piece_size())])

    def measure(self, text: bytes | None) -> dict:
        """Counts of the base rules, and the fertility figures (null where there is no token)."""
        text = text or b""
        words, whole, number = text.split(), text.decode(), defaultdict(count().__next__)
        rows = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        seen, dup = set(), 0
        for line in text.split(b"\n"):
            if line in seen:
                dup += bool(line.strip())
            else:
                seen.add(line)
        out = {
            "n_words": len(words), "word_chars": len(text.translate(None, _NOT_CHARS)), "n_symbols": len(text) - len(text.translate(None, SYMBOLS)), "n_dup_lines": dup,
            "n_repeat_words": repeated(rows), "n_tokens": 0, "chars_per_token": None, "byte_share": None, "entropy": None, "script": script(whole),
        }
        ids = np.array(self.sp.encode_as_ids(whole), np.int64)
        if len(ids):
            out |= {"n_tokens": len(ids), "chars_per_token": len(whole) / len(ids), "byte_share": float(self.is_byte[ids].mean()), "entropy": entropy(ids)}
        return out


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, entropy double, script string"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_KINDS = [pa.int64()] * 6 + [pa.float64()] * 3 + [pa.string()]


def _measure(batches: Iterator[pa.RecordBatch], vocabulary: str, carried: str | None) -> Iterator[pa.RecordBatch]:
    meter = Meter(vocabulary)
    for batch in in_slices(with_text(batches, carried)):
        found = [meter.measure(t) for t in texts(batch.column("text"))]
        rest = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), *(pa.array([f[n] for f in found], k) for n, k in zip(_NAMES, _KINDS))], [*rest, *_NAMES])


def _levelled(curve: str = "curve", median: str = "middle") -> dict:
    """The figures as the bands see them, from columns with the group's parabola and medians."""
    x, c, m = F.log2(F.col("n_tokens")), F.col(curve), F.col(median)
    return {
        "chars_per_token": (F.col("chars_per_token") - m[0]) * F.when(m[1] > 0, F.sqrt("n_tokens")).otherwise(MIXED),
        "byte_share": F.col("byte_share"),
        "entropy": F.col("entropy") - (c[0] + c[1] * x + c[2] * x * x),
    }


_GROUP = "group string, curve array<double>, middle array<double>, bands array<array<double>>"


def fit(found: DataFrame, least: int = LEAST, reach: dict = REACH) -> DataFrame:
    """Bands by group from measured rows (with ``lang``, ``digest``, ``base_failed``): group, curve, middle, bands.

    A group is a language (``l:``), a script (``s:``) or all rows (``*``).  It
    needs ``least`` distinct texts, and one in ``SPREAD`` of all; so there are
    no more than 3 * SPREAD rows, which the driver gathers.
    """
    spark = found.sparkSession
    figures = ["n_tokens", *REACH]
    good = found.where(~F.col("base_failed") & (F.col("n_tokens") > 0)).groupBy("lang", "script", "digest").agg(*[F.first(c).alias(c) for c in figures])
    groups = F.array(F.concat(F.lit("l:"), "lang"), F.concat(F.lit("s:"), "script"), F.lit("*"))
    each = good.select(F.explode(groups).alias("group"), *figures).where("group is not null")
    x, y = F.log2(F.col("n_tokens")), F.col("entropy")
    sums = [F.sum(x**k).alias(f"x{k}") for k in range(5)] + [F.sum(y * x**k).alias(f"y{k}") for k in range(3)]
    medians = F.percentile_approx("chars_per_token", 0.5).alias("middle")
    total = good.count()
    first = each.groupBy("group").agg(F.count("*").alias("n"), medians, *sums).where(F.col("n") >= max(least, total // SPREAD)).collect()
    fitted = []
    for r in first:
        a = np.array([[r[f"x{i + j}"] for j in range(3)] for i in range(3)]) + 1e-6 * np.eye(3)
        fitted.append((r["group"], np.linalg.lstsq(a, np.array([r[f"y{k}"] for k in range(3)]), rcond=None)[0].tolist(), [r["middle"], float(r["group"].startswith("l:"))]))
    known = spark.createDataFrame(fitted, "group string, curve array<double>, middle array<double>")
    quartiles = [F.percentile_approx(c, [0.25, 0.5, 0.75], 10_000).alias(n) for n, c in _levelled().items()]
    ranges = {r["group"]: r for r in each.join(F.broadcast(known), "group").groupBy("group").agg(*quartiles).collect()}
    sizes, rows = {r["group"]: r["n"] for r in first}, []
    for group, curve, middle in fitted:
        bands = []
        for name, (low, high) in reach.items():
            a, b, c = ranges[group][name]
            wide = max(c - a, NARROW[name]) * (1.0 if middle[1] else WIDER) * (1 + 3 / sizes[group] ** 0.5)
            bands.append([float("-inf") if low is None else b - low * wide, float("inf") if high is None else b + high * wide])
        rows.append((group, curve, middle, bands))
    return spark.createDataFrame(rows, _GROUP)


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None, vocabulary: str = "piece_bpe_32k.model", carry: bool = False, least: int = LEAST, reach: dict = REACH) -> DataFrame:
    """One row per document: base counts, fertility, base_failed, kept, and outside, the figures that lie outside their bands.

    With ``carry`` the whole input row comes along as struct ``row``.  A null
    text has no words and fails the base rules.  A language without bands, or
    none, falls to the bands of the script, then to those of all texts; where
    these are fewer than ``least``, the base rules alone decide.  Repeated rows
    and null ids are judged like any other; other columns are not looked at; an
    empty table gives no row.  Measured rows are written once; the bands cross a
    shuffle of one small row per distinct text.
    """
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), lang.alias("lang"), F.xxhash64(text_col).alias("digest"), F.struct("*").alias("row") if carry else F.col(text_col).alias("text"))
    kept = ", ".join(f"{n} {k}" for n, k in rows.dtypes if n != "text")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    found = cut(rows.mapInArrow(partial(_measure, vocabulary=vocabulary, carried=text_col if carry else None), f"{kept}, {SCHEMA}").withColumn("base_failed", base))
    bands = fit(found, least, reach)

    def by(prefix: str) -> DataFrame:
        part = bands.where(F.col("group").startswith(prefix))
        return F.broadcast(part.select(F.substring("group", 3, 1 << 30).alias(f"{prefix}key"), F.struct("curve", "middle", "bands").alias(prefix)))

    rest = bands.where("group = '*'").select("curve", "middle", "bands").first()
    every = F.lit(None) if rest is None else F.struct(F.lit(rest["curve"]).alias("curve"), F.lit(rest["middle"]).alias("middle"), F.array(*map(F.lit, rest["bands"])).alias("bands"))
    joined = found.join(by("l:"), F.col("lang") == F.col("l:key"), "left").join(by("s:"), F.col("script") == F.col("s:key"), "left").withColumn("all", every)
    judged = joined.withColumn("fit", F.coalesce("`l:`", "`s:`", "all")).withColumn("curve", F.col("fit.curve")).withColumn("middle", F.col("fit.middle"))
    out = [F.when(~c.between(F.col("fit.bands")[k][0], F.col("fit.bands")[k][1]), F.lit(n)) for k, (n, c) in enumerate(_levelled().items())]
    judged = judged.withColumn("outside", F.array_compact(F.array(*out))).withColumn("kept", ~F.col("base_failed") & (F.size("outside") == 0))
    names = ["id", "lang", *(["row"] if carry else []), *_NAMES, "base_failed", "kept", "outside"]
    return judged.select(*names).withColumnRenamed("id", id_col)
