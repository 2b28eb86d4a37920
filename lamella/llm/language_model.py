"""Class-based n-gram scoring after Brown: P(w | v) = P(class w | class v) P(w | class w).

Word counts come from one distributed count over all training texts, and every
word of them gets a class.  The ``clustered`` most frequent words are assigned
by exchange clustering on their bigram counts.  Every further word then goes to
the class that raises the same objective most, by its own counts of the classes
beside it, which are distributed rows by word; all words outside
the clustered ones count as one context there.  Class transitions are summed
from these counts; those between two further words, of which each side is
counted alone, are an estimate there, as if independent.  With ``exact`` they
are all counted anew, from the class of every word in its place.

Each task holds the ``lexicon`` most frequent words with their classes.  Words
beyond meet counts and classes in a join on the word, and their places return to
their documents, so that every word is scored with its own count and class.  What
is left of a text is a byte per token, its class, which the counts of class
pairs and the score are then taken from.  A
word that training never saw may be of any class, by the classes' shares.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_slices, is_held_out, most_frequent, texts

#: Words that every task holds; the tail beyond is joined.
LEXICON = 131_072
#: Words that exchange clustering assigns; their bigrams are a table of at most its square.
CLUSTERED = 1_024
CLASSES = 48
ADD = 0.1
END = b"\n"  # no word holds white space
#: Distinct words, or words with a neighbouring class, that one task counts before it hands them on.
FLUSH = 400_000
#: The class of a word that the lexicon does not have, until the join brings it.
TAIL = 255
_CONTEXT = np.dtype([("j", "<u2"), ("n", "<u4")])
_PLACE = np.dtype("<u4")


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    for batch in in_slices(batches):
        for text in texts(batch.column("text")):
            seen.update(words_of(text))
            seen[END] += 1
        if len(seen) > FLUSH:
            yield out()
            seen.clear()
    if seen:
        yield out()


def _numbers(batch: pa.RecordBatch, number: dict[bytes, int], other: int) -> tuple[np.ndarray, list[bytes]]:
    """The words of a slice's texts by ``number`` or else ``other``, an end before each text and after the last; and the words."""
    flat: list[bytes] = []
    for text in texts(batch.column("text")):
        flat.append(END)
        flat += words_of(text)
    flat.append(END)
    return np.fromiter(map(number.get, flat, repeat(other)), np.int64, len(flat)), flat


def _bigrams(batches: Iterator[pa.RecordBatch], words: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Counts of (word, next word) by number; all others have the number after the last."""
    number, size = dict(zip(words, range(len(words)))), len(words) + 1
    total = np.zeros(size * size, np.int64)
    for batch in in_slices(batches):
        if batch.num_rows:  # each text runs from the end before it to its own, which is the next one's first
            seq, _ = _numbers(batch, number, size - 1)
            total += np.bincount(seq[:-1] * size + seq[1:], minlength=size * size)
    some = np.flatnonzero(total)
    for at in range(0, len(some), 100_000):
        part = some[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part // size, pa.int32()), pa.array(part % size, pa.int32()), pa.array(total[part])], ["a", "b", "n"])


def exchange(pairs: np.ndarray, classes: int, fixed: int, rounds: int = 8) -> np.ndarray:
    """Exchange clustering (Kneser and Ney, 1993; Martin et al., 1998).

    pairs: square matrix of bigram counts, rows and columns by falling word
    count; the last ``fixed`` units stay in classes of their own.  Each other
    word moves to the class that raises sum n log n(class pair) - the class
    margins most, in turn, until no word moves or ``rounds`` are done.
    """
    n = len(pairs) - fixed
    classes = min(classes, n)
    where = np.concatenate((np.arange(n) % classes, classes + np.arange(fixed))).astype(np.int64)
    size = classes + fixed

    def h(x):
        return x * np.log(np.maximum(x, 1))

    table = np.zeros((size, size))
    np.add.at(table, (where[:, None].repeat(len(where), 1), where[None].repeat(len(where), 0)), pairs)
    for _ in range(rounds):
        moved = 0
        for w in range(n):
            old = where[w]
            right = np.bincount(where, weights=pairs[w], minlength=size)
            left = np.bincount(where, weights=pairs[:, w], minlength=size)
            own = pairs[w, w]
            right[old] -= own
            left[old] -= own
            table[old] -= right
            table[:, old] -= left
            table[old, old] -= own
            # gain of adding w to each class, from the rows and columns that change
            # w's neighbours keep their own margins wherever w goes
            out, into = table.sum(1)[:classes] + left[:classes], table.sum(0)[:classes] + right[:classes]
            rows, cols = table[:classes], table[:, :classes].T
            gain = (h(rows + right) - h(rows)).sum(1) + (h(cols + left) - h(cols)).sum(1)
            d = np.arange(classes)
            diagonal = table[d, d]
            gain += h(diagonal + right[:classes] + left[:classes] + own) + h(diagonal) - h(diagonal + right[:classes]) - h(diagonal + left[:classes])
            r, c = right.sum() + own, left.sum() + own
            gain -= h(out + r) - h(out) + h(into + c) - h(into)
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = old
            where[w] = new
            table[new] += right
            table[:, new] += left
            table[new, new] += own
            moved += new != old
        if not moved:
            break
    return where


def _contexts(batches: Iterator[pa.RecordBatch], classes: dict[bytes, int], size: int) -> Iterator[pa.RecordBatch]:
    """For words without a class, their counts of the class before (j below ``size``) and after (from ``size`` on)."""
    number: defaultdict = defaultdict(count().__next__)
    held, total = [], 0

    def out():
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        row = np.empty(len(keys), _CONTEXT)
        row["j"], row["n"] = keys % (2 * size), n
        data, width = pa.py_buffer(row.tobytes()), _CONTEXT.itemsize
        ends = np.searchsorted(keys, np.arange(len(number) + 1) * (2 * size)).astype(np.int32) * width
        contexts = pa.BinaryArray.from_buffers(pa.binary(), len(number), [None, pa.py_buffer(ends.tobytes()), data])
        whole = pa.RecordBatch.from_arrays([pa.array(list(number), pa.binary()), contexts], ["word", "contexts"])
        for at in range(0, whole.num_rows, 50_000):
            yield whole.slice(at, 50_000)

    for batch in in_slices(batches):
        if not batch.num_rows:
            continue
        seq, flat = _numbers(batch, classes, -1)
        at = np.flatnonzero(seq < 0)
        seq[at] = size - 1
        ids = np.fromiter((number[flat[i]] for i in at.tolist()), np.int64, len(at)) * (2 * size)
        held += [ids + seq[at - 1], ids + size + seq[at + 1]]
        total += len(at)
        if len(number) > FLUSH or total > 10 * FLUSH:
            yield from out()
            number = defaultdict(count().__next__)
            held, total = [], 0
    if held:
        yield from out()


def _assign(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows sorted by word in, any number for each; (word, class), and sums of contexts (class, j, n), out.

    table: counts of class pairs, the last one the words without a class.
    """
    size = len(table)
    log_before, log_after = np.log(table[:, :-1] + 0.5), np.log(table[:-1] + 0.5)  # before x class, class x after
    margin = np.log(table[:-1].sum(1) + 1) + np.log(table[:, :-1].sum(0) + 1)
    # each occurrence has one context on either side, so half of the contexts weigh the margins
    gain = np.concatenate((log_before, log_after.T)) - margin / 2  # j x class
    sums = np.zeros((size - 1, 2 * size), np.int64)
    held, counts = None, np.zeros(2 * size, np.int64)

    def out(words, each):
        best = (each @ gain).argmax(1)
        np.add.at(sums, best, each)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(best, pa.int32()), pa.nulls(len(best), pa.int32()), pa.nulls(len(best), pa.int64())], ["word", "class", "j", "n"])

    for batch in batches:
        words, each = batch.column("word").to_pylist(), batch.column("contexts").to_pylist()
        if not words:
            continue
        fresh = np.fromiter((a != b for a, b in zip(words, [held, *words])), bool, len(words))
        group = np.cumsum(fresh)  # 0 goes on with what is held
        row = np.frombuffer(b"".join(each), _CONTEXT)
        lengths = np.fromiter(map(len, each), np.int64, len(each)) // _CONTEXT.itemsize
        table_ = np.zeros((int(group[-1]) + 1, 2 * size), np.int64)
        np.add.at(table_, (np.repeat(group, lengths), row["j"]), row["n"])
        table_[0] += counts
        names = [held, *(words[i] for i in np.flatnonzero(fresh).tolist())]
        if len(names) > 1:
            begin = 0 if held is not None else 1
            if len(names) - 1 > begin:
                yield out(names[begin:-1], table_[begin:-1])
        held, counts = names[-1], table_[-1]
    if held is not None:
        yield out([held], counts[None])
    c, j = np.nonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.nulls(len(c), pa.binary()), pa.array(c, pa.int32()), pa.array(j, pa.int32()), pa.array(sums[c, j])], ["word", "class", "j", "n"])


class Lexicon:
    """Frequent words with numbers, their counts and classes."""

    def __init__(self, words: list[bytes], counts: list[int], classes: list[int]):
        self.number = {w: i for i, w in enumerate(words)}
        self.counts, self.classes = np.array(counts, np.int64), np.array(classes, np.int64)


class Model:
    """Everything that scoring needs but the counts and classes of tail words.

    The class after the last is that of a word which training never saw: from
    it, as from no class, the classes' own shares lead on.
    """

    def __init__(self, lexicon: Lexicon, transitions: np.ndarray, in_class: np.ndarray, kinds: np.ndarray, total: int, distinct: int):
        self.lexicon, self.total = lexicon, total
        self.unseen = size = len(transitions)
        # transitions back off to the class's own share; emissions add ADD for each word and the unseen one
        self.share, self.per_word = (in_class + ADD) / (total + ADD * size), ADD / (in_class + ADD * (kinds + 1))
        self.follow(transitions)
        self.class_base = np.append(np.log10(in_class + ADD * (kinds + 1)), 0.0)
        self.log_count = np.log10(lexicon.counts + ADD)
        self.base = float(np.log10(total + ADD * (distinct + 1)))

    def follow(self, transitions: np.ndarray) -> None:
        """Takes these counts of class pairs for its own."""
        size = self.unseen
        given = np.concatenate((transitions, np.zeros((1, size))))
        move = (given + size * self.share) / (given.sum(1, keepdims=True) + size)
        self.log_move = np.log10(np.concatenate((move, (move * self.per_word).sum(1, keepdims=True)), 1))

    def read(self, words: list[bytes]) -> tuple[list, dict[bytes, bytes]]:
        """Classes, n_tokens, n_known, base and emission score without what the tail words add; their places by word."""
        tokens = [*words, END]
        rows = np.fromiter(map(self.lexicon.number.get, tokens, repeat(-1)), np.int64, len(tokens))
        known = rows >= 0
        classes = np.where(known, self.lexicon.classes[np.maximum(rows, 0)], TAIL)
        counts = self.log_count[rows[known]].sum()
        own = counts - self.class_base[classes[known]].sum()
        number: defaultdict = defaultdict(count().__next__)
        at = np.flatnonzero(~known)
        ids = np.fromiter((number[tokens[i]] for i in at.tolist()), np.int64, len(at))
        order = np.argsort(ids, kind="stable")
        at, ids = at[order], ids[order]
        data, size = at.astype(_PLACE).tobytes(), _PLACE.itemsize
        ends = (np.searchsorted(ids, np.arange(len(number) + 1)) * size).tolist()
        places = {w: data[a:b] for w, a, b in zip(number, ends, ends[1:])}
        return [classes.astype(np.uint8).tobytes(), len(rows), int((self.lexicon.counts[rows[known]] > 0).sum()), float(counts - len(rows) * self.base), float(own)], places

    def finish(self, classes: bytes, places: list[bytes], counts: list[int | None], kinds: list[int | None]) -> tuple[bytes, int, float, float]:
        """The classes with those of a document's tail words in their places; n_known, base and emission score that these add."""
        n = [len(p) // _PLACE.itemsize for p in places]
        seen = np.repeat([c is not None for c in counts], n)
        log = np.repeat(np.log10(np.array([c or 0 for c in counts]) + ADD), n)
        kind = np.repeat([self.unseen if c is None else c for c in kinds], n)
        whole = np.frombuffer(classes, np.uint8).copy()
        whole[np.frombuffer(b"".join(places), _PLACE)] = kind
        return whole.tobytes(), int(seen.sum()), float(log.sum()), float((log - self.class_base[kind])[seen].sum())


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """A row per document and one per distinct tail word of it.

    A document's own row has a word that no text holds and no other row has, so
    that these rows spread over the join's partitions.
    """
    for batch in in_slices(batches, most=4 << 20):
        uid, word, places, at, figures = [], [], [], [], []
        for u, text in zip(batch.column("uid").to_pylist(), texts(batch.column("text"))):
            found, tail = model.read(words_of(text))
            at.append(len(uid))
            figures.append(found)
            uid += [u] * (1 + len(tail))
            word += [END + str(u).encode(), *tail]
            places += [None, *tail.values()]
        row = np.full(len(uid), -1)
        row[at] = np.arange(len(at))
        row = pa.array(row, mask=row < 0)
        cols = [pa.array(c, k).take(row) for c, k in zip(zip(*figures), (pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(uid, pa.int64()), batch.column("id").take(row), pa.array(word, pa.binary()), pa.array(places, pa.binary()), *cols],
            ["uid", "id", "word", "places", "classes", "n_tokens", "n_known", "base", "own"],
        )


def _finish(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Rows sorted by document in, its own and those of its tail words; one row per document out."""
    uid, own, tail, done, kind = None, None, ([], [], []), [], pa.int64()

    def close():
        classes, known, base, more = model.finish(own[1], *tail) if tail[0] else (own[1], 0, 0.0, 0.0)
        done.append((own[0], classes, own[2], own[3] + known, own[4] + base, own[5] + more))

    def out():
        kinds = (kind, pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], ["id", "classes", "n_tokens", "n_known", "base_score", "own"])

    for batch in batches:
        kind = batch.column("id").type
        for u, place, n, c, *figures in zip(*(batch.column(x).to_pylist() for x in ("uid", "places", "n", "class", "id", "classes", "n_tokens", "n_known", "base", "own"))):
            if u != uid:
                if uid is not None:
                    close()
                uid, tail = u, ([], [], [])
            if place is None:
                own = figures
            else:
                for held, x in zip(tail, (place, n, c)):
                    held.append(x)
        if done:
            yield out()
            done.clear()
    if uid is not None:
        close()
        yield out()


def _sequences(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class before each token and its own, all documents in a row, and where each document begins.

    Every document ends with the end, whose class so stands before the next one's first token.
    """
    column = batch.column("classes").cast(pa.binary())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    return np.roll(flat, 1), flat, ends[:-1] - ends[0]


def _follow(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Counts of class pairs."""
    total = np.zeros(size * size, np.int64)
    for batch in batches:
        if batch.num_rows:
            before, own, _ = _sequences(batch)
            total += np.bincount(before.astype(np.int64) * size + own, minlength=size * size)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some // size, pa.int32()), pa.array(some % size, pa.int32()), pa.array(total[some])], ["a", "b", "n"])


def _moves(batches: Iterator[pa.RecordBatch], log_move: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Documents with their classes in, with their scores out."""
    for batch in batches:
        if batch.num_rows:
            before, own, begin = _sequences(batch)
            score = batch.column("own").to_numpy() + np.add.reduceat(log_move[before, own], begin)
            names = ["id", "n_tokens", "n_known", "base_score"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(score)], [*names, "score"])


def train(texts_: DataFrame, clustered: int = CLUSTERED, classes: int = CLASSES, lexicon: int = LEXICON) -> tuple[Model, DataFrame]:
    """The model of a table of training texts (column ``text``); and (word, n, class) of all its words.

    Its transitions between two words beyond the ``clustered`` ones are an estimate, which ``score`` replaces with ``exact``.
    """
    rows = texts_.select("text")
    counts = cut(rows.mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    head = most_frequent(counts, clustered)
    if all(w != END for w, _ in head):  # the end is always one
        found = counts.where(F.col("word") == F.lit(END)).select("n").first()
        head.append((END, found[0] if found else 0))
    size = len(head) + 1
    pairs = np.zeros((size, size))
    # at most (clustered + 2)**2 rows
    found = rows.mapInArrow(partial(_bigrams, words=[w for w, _ in head]), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    pairs[found["a"].to_numpy(), found["b"].to_numpy()] = found["n"].to_numpy()
    where = exchange(pairs, classes, 1)  # all other words stay apart, as the last class
    size = int(where.max())
    table = np.zeros((size + 1, size + 1))
    np.add.at(table, (where[:, None].repeat(len(where), 1), where[None].repeat(len(where), 0)), pairs)
    named = {w: int(c) for (w, _), c in zip(head, where)}
    each = rows.mapInArrow(partial(_contexts, classes=named, size=size + 1), "word binary, contexts binary")
    # a word has one row for each time that a task hands on its counts, and these are merged as they pass
    each = each.repartition("word").sortWithinPartitions("word")
    assigned = cut(each.mapInArrow(partial(_assign, table=table), "word binary, class int, j int, n long"))
    contexts = np.zeros((size, 2 * (size + 1)))
    for r in assigned.where("word is null").groupBy("class", "j").agg(F.sum("n").alias("n")).collect():
        contexts[r["class"], r["j"]] = r["n"]
    before, after = contexts[:, : size + 1], contexts[:, size + 1 :]
    transitions = table[:-1, :-1] + before[:, :-1].T + after[:, :-1] + np.outer(after[:, -1], before[:, -1]) / max(1.0, after[:, -1].sum())
    book = cut(counts.join(assigned.where("word is not null").select("word", "class"), "word", "left"))
    in_class, kinds = np.zeros(size), np.zeros(size)
    np.add.at(in_class, where[:-1], [n for _, n in head])
    np.add.at(kinds, where[:-1], [n > 0 for _, n in head])
    total, distinct = int(in_class.sum()), int(kinds.sum())
    for r in book.where("class is not null").groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("d")).collect():
        in_class[r["class"]] += r["n"]
        kinds[r["class"]] += r["d"]
        total, distinct = total + r["n"], distinct + r["d"]
    words = {w: (n, named[w]) for w, n in head} | {w: (n, named.get(w, c)) for w, n, c in most_frequent(book, lexicon, "class")}
    known = Lexicon(list(words), [n for n, _ in words.values()], [c for _, c in words.values()])
    return Model(known, transitions, in_class, kinds, total, distinct), book


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held_out: int = 0, exact: bool = False, **size) -> DataFrame:
    """One row per document with its base and class-model log10 probabilities.

    Trained on the documents whose crc32(id) modulo ``folds`` is not
    ``held_out``.  A null text is empty: its one token is the end.  Words unseen
    in training keep probability through the additive terms.  Repeated rows and
    null ids (an empty id text) are scored like any other; other columns are not
    read; an empty table, or one without training rows, gives rows scored by the
    additive terms alone.

    exact: every transition of the training texts is counted, by the classes of
    its two words, also where both are beyond the clustered ones; otherwise
    those are taken as independent.  Either way the classes of all tokens, a
    byte each, are written once.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = is_held_out(F.col("id"), folds, held_out)
    model, book = train(rows.where(~out), **size)
    kind = dict(rows.dtypes)["id"]
    shape = f"uid long, id {kind}, word binary, places binary, classes binary, n_tokens long, n_known long, base double, own double"
    scored = rows.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(partial(_score, model=model), shape)
    # a word beyond the lexicon has a share of the tokens below 1 / lexicon: no key of this join is hot
    tail = scored.join(book, "word", "left")
    met = tail.select("uid", "id", "places", "n", "class", "classes", "n_tokens", "n_known", "base", "own").repartition("uid").sortWithinPartitions("uid")
    done = cut(met.mapInArrow(partial(_finish, model=model), f"id {kind}, classes binary, n_tokens long, n_known long, base_score double, own double"))
    held = is_held_out(F.col("id"), folds, held_out)
    if exact:
        pairs = np.zeros((model.unseen, model.unseen))
        for r in done.where(~held).select("classes").mapInArrow(partial(_follow, size=model.unseen), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
            pairs[r["a"], r["b"]] = r["n"]
        model.follow(pairs)
    scored = done.mapInArrow(partial(_moves, log_move=model.log_move), f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("id").alias(id_col), held.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
