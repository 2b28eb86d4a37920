"""Token counts by separator scan of flat token files.

A flat file is nothing but token ids of fixed width; documents end with a
separator id and there is no index.  Spark's text source plans byte ranges of
any file and reads them in parallel; asked to break lines at the first byte of
the separator, it hands on raw bytes, from which each task rebuilds its part of
the stream.  A part is searched for separators at once, at every offset, since
where it begins in the file is not known yet: the source moves each range to the
next line.  A prefix scan over the parts then gives their places; with these a
match that no token begins at is dropped, separators that straddle two parts are
stitched, and the start and number of each document follow.  The scan has one
row per part for its files, and one per block of about a megabyte within a part.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop_folder, in_slices, shared_dir
from .vocab import byte_bpe

#: The separator of the public 50k byte-level vocabulary.
SEPARATOR = 50256
#: Bytes of the mark that the text source swallows at the beginning of a file.
MARK = 3


def separator_bytes(separator: int, dtype: str) -> bytes:
    return np.array([separator], dtype).tobytes()


def parts(spark: SparkSession, path: str, first: bytes) -> DataFrame:
    """Lines below ``path``, broken at a byte: file, file_size, part (the offset of its range) and line, in order within a part."""
    read = spark.read.option("encoding", "ISO-8859-1").option("lineSep", first.decode("latin1")).text(path)
    about = [F.col(f"_metadata.{a}").alias(b) for a, b in (("file_path", "file"), ("file_size", "file_size"), ("file_block_start", "part"))]
    return read.select(*about, F.col("value").cast("binary").alias("line"))


def _stream(lines: pa.Array, first: int) -> np.ndarray:
    """The bytes of lines, each followed by the byte that ended it."""
    n = len(lines)
    at = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + n + 1].astype(np.int64)
    data = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    ends = at[1:] - at[0] + np.arange(n)
    out, inner = np.empty(len(data) + n, np.uint8), np.ones(len(data) + n, bool)
    inner[ends] = False
    out[inner], out[ends] = data, first
    return out


def _search(batches: Iterator[pa.RecordBatch], separator: bytes) -> Iterator[pa.RecordBatch]:
    """One row per block: its bytes, the places in its part where the separator's bytes begin, the part's first and the latest last bytes."""
    pattern, width = np.frombuffer(separator, np.uint8), len(separator)
    now, at, block, carry = None, 0, 0, np.zeros(0, np.uint8)
    for batch in batches:
        if not batch.num_rows:
            continue
        names, starts = batch.column("file").dictionary_encode(), batch.column("part").to_numpy(zero_copy_only=False)
        codes = names.indices.to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((np.diff(starts) != 0) | (np.diff(codes) != 0)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
            key = names[a].as_py(), int(starts[a])
            if key != now:
                now, at, block, carry = key, 0, 0, carry[:0]
            new = _stream(batch.column("line").slice(a, b - a), pattern[0])
            whole = np.concatenate((carry, new))
            found = np.flatnonzero(whole[: max(0, len(whole) - width + 1)] == pattern[0])
            for k in range(1, width):
                found = found[whole[found + k] == pattern[k]]
            found = found + (at - len(carry))
            carry = whole[max(0, len(whole) - width + 1) :]
            head = pa.array([new[: width - 1].tobytes() if block == 0 else None], pa.binary())
            ends = pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(found, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0]]), batch.column("file_size").slice(a, 1), pa.array([key[1]], pa.int64()), pa.array([block], pa.int64()), pa.array([len(new)], pa.int64()), ends, head, pa.array([carry.tobytes()], pa.binary())],
                ["file", "file_size", "part", "block", "bytes", "ends", "head", "tail"],
            )
            at, block = at + len(new), block + 1


def search(spark: SparkSession, path: str, separator: int = SEPARATOR, dtype: str = "<u2") -> DataFrame:
    """The blocks of the flat files below ``path``, written to the shared folder: the files are not needed any more."""
    sep = separator_bytes(separator, dtype)
    shape = "file string, file_size long, part long, block long, bytes long, ends array<long>, head binary, tail binary"
    return cut(parts(spark, path, sep[:1]).mapInArrow(partial(_search, separator=sep), shape))


def stitch(blocks: DataFrame, separator: int = SEPARATOR, dtype: str = "<u2") -> DataFrame:
    """One row per document from ``search``: file, ordinal (from 0), start (token), n_tokens with its separator, closed.

    Tokens after a file's last separator form a last document with closed =
    false; an empty file has none, and bytes that fill no token are left out.
    """
    sep = separator_bytes(separator, dtype)
    width = len(sep)
    by_file, by_part = Window.partitionBy("file").orderBy("part"), Window.partitionBy("file", "part").orderBy("block")
    before = Window.unboundedPreceding, -1
    # one row per part: where it begins, and a separator that straddles its beginning
    each = blocks.groupBy("file", "part").agg(F.max("file_size").alias("file_size"), F.sum("bytes").alias("bytes"), F.max("head").alias("head"), F.max_by("tail", "block").alias("tail"))
    base = F.coalesce(F.sum("bytes").over(by_file.rowsBetween(*before)), F.lit(0))
    lack = F.col("file_size") - F.sum("bytes").over(Window.partitionBy("file"))
    # the last line may lack its end byte (-1); three bytes less than there are were a mark at the beginning
    shift = F.when(lack >= MARK - 1, MARK).otherwise(0)
    # a part has a byte or more, so that of width - 1 parts the last bytes are enough
    earlier = F.concat(*[F.coalesce(F.lag("tail", k).over(by_file), F.lit(b"")) for k in range(width - 1, 0, -1)]) if width > 1 else F.lit(b"")
    known = F.expr(f"substring(earlier, greatest(1, length(earlier) - {width - 2}))")
    each = each.select("*", (base + shift).alias("base"), earlier.alias("earlier")).withColumn("known", known)
    cross = [F.when(F.substring(F.concat("known", "head"), k, width) == F.lit(sep), F.col("base") - F.length("known") + k - 1) for k in range(1, width)]
    each = each.withColumn("cross", F.array_compact(F.array(*[F.when(F.length("known") >= k, c) for k, c in enumerate(cross, 1)])) if cross else F.array().cast("array<long>"))
    placed = blocks.select("file", "part", "block", "ends").join(each.select("file", "part", "file_size", "base", "cross"), ["file", "part"])
    ends = F.concat(F.when(F.col("block") == 0, F.col("cross")).otherwise(F.array().cast("array<long>")), F.transform("ends", lambda e: e + F.col("base")))
    ends = F.transform(F.filter(ends, lambda e: e % width == 0), lambda e: F.expr("0L") + (e / width).cast("long"))
    placed = cut(placed.select("file", "file_size", "part", "block", ends.alias("ends")))
    # documents and the end of the last one, before each part and before each block within it
    n, last = F.size("ends").cast("long"), F.when(F.size("ends") > 0, F.element_at("ends", -1) + 1)
    totals = placed.groupBy("file", "part").agg(F.sum(n).alias("n"), F.max(last).alias("last"))
    totals = totals.select("file", "part", F.coalesce(F.sum("n").over(by_file.rowsBetween(*before)), F.lit(0)).alias("n_before"), F.coalesce(F.max("last").over(by_file.rowsBetween(*before)), F.lit(0)).alias("open_before"))
    inner = placed.select("*", F.coalesce(F.sum(n).over(by_part.rowsBetween(*before)), F.lit(0)).alias("n_in"), F.max(last).over(by_part.rowsBetween(*before)).alias("open_in"))
    inner = inner.join(totals, ["file", "part"]).select("file", "ends", (F.col("n_before") + F.col("n_in")).alias("first"), F.coalesce("open_in", "open_before").alias("open"))
    cuts = F.transform("ends", lambda e, k: F.struct(F.when(k == 0, F.col("open")).otherwise(F.get("ends", k - 1) + 1).alias("a"), e.alias("b")))
    closed = inner.select("file", "first", F.posexplode(cuts).alias("k", "c")).select("file", (F.col("first") + F.col("k")).alias("ordinal"), F.col("c.a").alias("start"), (F.col("c.b") + 1 - F.col("c.a")).alias("n_tokens"), F.lit(True).alias("closed"))
    files = placed.groupBy("file").agg((F.max("file_size") / width).cast("long").alias("tokens"), F.sum(n).alias("ordinal"), F.coalesce(F.max(last), F.lit(0)).cast("long").alias("start"))
    rest = files.where("tokens > start").select("file", "ordinal", "start", (F.col("tokens") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)


def scan(spark: SparkSession, path: str, separator: int = SEPARATOR, dtype: str = "<u2") -> DataFrame:
    """The documents of the flat files below ``path``; see ``stitch``."""
    return stitch(search(spark, path, separator, dtype), separator, dtype)


def _tokens(batches: Iterator[pa.RecordBatch], text: str, vocabulary: str, dtype: str) -> Iterator[pa.RecordBatch]:
    ids = byte_bpe(vocabulary, False).ids
    for batch in in_slices(batches, text, most=2 << 20):
        yield pa.RecordBatch.from_arrays([pa.array([ids(t).astype(dtype).tobytes() for t in batch.column(text).to_pylist()], pa.binary())], ["tokens"])


def _ordinals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64())], ["id", "number", "ordinal"])
        at += n


def flatten(docs: DataFrame, path: str, text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", separator: int = SEPARATOR, dtype: str = "<u2") -> None:
    """Write the documents as flat token files below ``path``, one per partition: ids, and a separator after each document.

    The text source writes raw bytes and ends each row with the separator's.
    """
    tokens = docs.mapInArrow(partial(_tokens, text=text_col, vocabulary=vocabulary, dtype=dtype), "tokens binary")
    writer = tokens.select(F.col("tokens").cast("string").alias("value")).write.mode("overwrite").option("encoding", "ISO-8859-1").option("lineSep", separator_bytes(separator, dtype).decode("latin1"))
    writer.option("compression", "none").option("maxRecordsPerFile", 0).text(path)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", separator: int = SEPARATOR, dtype: str = "<u2") -> DataFrame:
    """One row per document: id, file, ordinal, start, n_tokens with the separator.

    The documents are written as flat files and counted from those alone; the
    files are deleted once searched, and ids join in by file and ordinal.  For
    that ``docs`` has to give its rows in the same partitions and order twice,
    as a table does; if it does not, the numbers of documents tell, and it is an
    error.  A null text is a separator alone; the separator's own string in a
    text is plain text; repeated rows and null ids are counted like any other;
    other columns are not read; an empty table gives no row.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/flat-{uuid.uuid4().hex}"
    flatten(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), path, "text", vocabulary, separator, dtype)
    blocks = search(spark, path, separator, dtype)
    drop_folder(spark, path)
    found = stitch(blocks, separator, dtype).withColumn("number", F.regexp_extract("file", r"part-(\d+)-[^/]*$", 1).cast("int"))
    # the same columns as before: without the text Spark might deal out the rows otherwise
    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = ids.mapInArrow(_ordinals, f"id {dict(ids.dtypes)['id']}, number int, ordinal long")
    wanted = names.groupBy("number").agg(F.count("*").alias("wanted"))
    if not found.groupBy("number").agg(F.count("*").alias("n")).join(wanted, "number", "full").where("not n <=> wanted").isEmpty():
        raise RuntimeError("the documents did not come in the same partitions twice; write them as a table first")
    return names.join(found, ["number", "ordinal"]).select(F.col("id").alias(id_col), F.col("number").alias("file"), "ordinal", "start", "n_tokens")
