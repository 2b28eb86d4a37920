"""Secret scans by dictionary-primed zstandard novelty.

Three fixed patterns are always reported.  Beyond them every token of 12
characters or more with a sensitive word on either side is a candidate: its
novelty is the number of bytes that it adds to the compressed size of the code
around it (the median of three neighbourhoods: before, after, both).  The
compressor's dictionary is trained on code words and on the most frequent parts
of words and identifiers of the corpus itself, so that it knows how likely each
character is; what the dictionary and the neighbourhood explain costs little, a
random string costs all of its entropy and is reported as ``novel``.  On so few
bytes the compressor can't tell a word that its dictionary lacks from a random
string, so words of the public vocabulary count as one byte each.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_slices, most_frequent, with_text
from .vocab import vocabulary

KINDS = ("assign", "access", "hex", "novel")


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key")))
ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the maximal runs that are long enough
_ASSIGN_HINTS = ("passw", "secret", "token", "api")
_SENSITIVE = "key|secret|token|passw|pwd|auth|bearer|credential|private|signature|access"
#: A sensitive word from a non-letter or a change of case on, or one that ends a run-together name.
CONTEXT = re.compile(
    rf"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])|(?<=[A-Z])(?=[A-Z][a-z]))(?i:{_SENSITIVE})"
    r"|(?i:key|secret|token|password|passwd|pwd|credential|signature)s?(?![A-Za-z])",
    re.ASCII,
)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{12,}={0,2}")
#: Characters on either side of a candidate that prime the compressor and may hold the sensitive word.
AROUND = 160
#: Marginal compressed bytes per character from which a candidate is novel, and the least in all.
PER_CHAR, LEAST = 0.7, 8
#: Parts of words and identifiers, parted at changes of case; all are shorter than any candidate.
PART = re.compile(r"[A-Z]?[a-z]{3,10}(?![a-z])|[A-Z]{4,11}(?![A-Z])")
#: Most frequent parts that the dictionary is trained on, its size in bytes, and distinct parts that a task counts before it hands them on.
PARTS, DICTIONARY, FLUSH = 6_000, 48 << 10, 400_000
IDENTIFIERS = b" ".join(
    b"""abstract access_token account address algorithm allocate api_key application arguments array assert async
 attribute authorization await background base64 boolean buffer button callback certificate character class client
 collection column command component configuration connection const constructor container content context continue
 controller count create credentials current database datetime default define delete description destination
 dictionary directory document domain element email enabled encoding encrypt endpoint environment error example
 exception execute export extends false fetch field filename filter finally float format function generate getElementById
 global handler header height https implements import index initialize input insert instance integer interface
 internal iterator javascript json keyword lambda language length library license listener localhost location logger
 manager maximum message metadata method middleware minimum module name namespace network none notification null number
 object operation option order output override package parameter parent parse password path pattern payload permission
 pointer port position prefix private process profile project promise property protected protocol provider public
 python query queue random readonly record reference register remove render replace repository request require
 resource response result return router schema script search secret section security select self send server service
 session setting signature size source static status storage string struct style subscribe suffix super switch table
 target template test text thread throw timeout timestamp title token transaction transform true type undefined
 unsigned update upload username utils validate value variable vector version view virtual void volatile webhook
 width window wrapper www example.com mailto index.html application/json abcdefghijklmnopqrstuvwxyz
 ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 ======================== ------------------------ ________________________""".split()
)


def trained(parts: list[tuple[bytes, int]] = (), size: int = DICTIONARY) -> bytes:
    """A zstandard dictionary from ``IDENTIFIERS`` and (part, count): content and the codes of characters."""
    words = IDENTIFIERS.split()
    most = max((n for _, n in parts), default=1)
    weight = np.sqrt(np.array([most] * len(words) + [n for _, n in parts], float))
    words = [*words, *(w for w, _ in parts)]
    drawn = np.random.default_rng(3).choice(len(words), (3_000, 24), p=weight / weight.sum())
    return zstandard.train_dictionary(size, [b" ".join(words[i] for i in row) for row in drawn], level=9).as_bytes()


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array([w.encode() for w in seen], pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    for batch in in_slices(batches):
        for text in batch.column("text").to_pylist():
            seen.update(PART.findall(text or ""))
        if len(seen) > FLUSH:
            yield out()
            seen.clear()
    if seen:
        yield out()


def learn(docs: DataFrame, text_col: str = "text", most: int = PARTS) -> bytes:
    """The dictionary of a corpus: parts are counted over all of its texts."""
    counts = cut(docs.select(F.col(text_col).alias("text")).mapInArrow(_parts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    return trained(most_frequent(counts, most))


@lru_cache(maxsize=4)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(dictionary)
    return zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)


def novelty(candidate: str, before: str, after: str, dictionary: bytes) -> int:
    """Compressed bytes that the candidate adds to its neighbourhood, the median of three."""
    c = _compressor(dictionary)
    added = []
    for near in (before, after, before + after):
        near = near.encode()
        added.append(len(c.compress(near + candidate.encode())) - len(c.compress(near)))
    return sorted(added)[1]


@lru_cache(maxsize=1)
def _words() -> frozenset[str]:
    """The vocabulary's words of five ASCII letters or more."""
    with open(vocabulary("byte_bpe_50k.json"), encoding="utf-8") as f:
        pieces = json.load(f)["model"]["vocab"]
    return frozenset(w for w in (p.lstrip("\u0120").lower() for p in pieces) if len(w) >= 5 and w.isascii() and w.isalpha())


def explained(candidate: str) -> int:
    """Characters that whole words of the vocabulary take away, less one for each word."""
    low, words, i, out = candidate.lower(), _words(), 0, 0
    while i <= len(low) - 5:
        n = next((n for n in range(min(20, len(low) - i), 4, -1) if low[i : i + n] in words), 0)
        out += max(0, n - 1)
        i += n or 1
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, in the order of their kinds."""
    out = []
    low = text.lower()
    if any(h in low for h in _ASSIGN_HINTS):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return out


def novel_spans(text: str, base: list[tuple[int, int, str]], dictionary: bytes, per_char: float = PER_CHAR, least: int = LEAST) -> list[tuple[int, int, str]]:
    out = []
    named = np.array([m.span() for m in CONTEXT.finditer(text)]).reshape(-1, 2)
    if not len(named):
        return out
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        # a sensitive word that begins after the token, or ends before it, within reach
        after, before = np.searchsorted(named[:, 0], b), np.searchsorted(named[:, 1], a, side="right") - 1
        if not (after < len(named) and named[after, 1] <= b + AROUND) and not (before >= 0 and named[before, 0] >= a - AROUND):
            continue
        if any(s < b and a < e for s, e, _ in base):
            continue
        bar = max(least, per_char * (b - a))
        added = novelty(m[0], text[max(0, a - AROUND) : a], text[b : b + AROUND], dictionary)
        if added >= bar and added - explained(m[0]) >= bar:
            out.append((a, b, "novel"))
    return out


def _join(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def _scan(batches: Iterator[pa.RecordBatch], options: dict, carried: str | None) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(with_text(batches, carried)):
        base, spans = [], []
        for text in batch.column("text").to_pylist():
            found = base_spans(text or "")
            base.append(found)
            spans.append(found + novel_spans(text or "", found, **options))
        rest = [n for n in batch.schema.names if n != "text"]
        columns = [
            *(pa.array([sum(k == kind for *_, k in b) for b in base], pa.int64()) for kind in KINDS[:3]),
            pa.array([hashlib.sha256(_join(b).encode()).hexdigest() for b in base]),
            pa.array([_join(s) for s in spans]),
            pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in sorted(s)] for s in spans], _SPAN),
        ]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), *columns], [*rest, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, dictionary: bytes | None = None, **options) -> DataFrame:
    """One row per document: counts by kind, digests, and ``found``, the spans in code points.

    dictionary: from ``learn`` or ``trained``; without it, it is learnt from the documents.

    With ``carry`` the whole input row comes along as struct ``row``.  A null or
    empty text has no spans; repeated rows and null ids are scanned like any
    other; other columns are not looked at; an empty table gives no row.  Only
    part counts are shuffled.  ``options`` go to ``novel_spans``.
    """
    options["dictionary"] = learn(docs, text_col) if dictionary is None else dictionary
    rows = docs.select(F.col(id_col).alias("id"), F.struct("*").alias("row") if carry else F.col(text_col).alias("text"))
    kept = ", ".join(f"{n} {k}" for n, k in rows.dtypes if n != "text")
    shape = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<start: long, end: long, kind: string>>"
    return rows.mapInArrow(partial(_scan, options=options, carried=text_col if carry else None), f"{kept}, {shape}").withColumnRenamed("id", id_col)


def redacted(text: str, spans: list[dict], mark: str) -> str:
    parts, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            parts += [text[at : s["start"]], mark]
        at = max(at, s["end"])
    return "".join([*parts, text[at:]])


def _redact(batches: Iterator[pa.RecordBatch], mark: str, carried: str) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(with_text(batches, carried)):
        found, text = batch.column("found").to_pylist(), batch.column("text")
        cut = [redacted(text[i].as_py(), s, mark) if s else None for i, s in enumerate(found)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(cut, pa.string())], ["row", "text"])


def redact(found: DataFrame, text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """``row``, and ``text`` with every span replaced by ``mark`` (null where there is no span),
    from a ``scan`` with ``carry``."""
    rows = found.select("row", "found")
    return rows.mapInArrow(partial(_redact, mark=mark, carried=text_col), f"row {dict(rows.dtypes)['row']}, text string")
