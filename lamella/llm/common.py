"""What the operators share: reading tables, cutting lineage, text kernels, components."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z, every other byte as it is (bytes.lower does just that).
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"

#: Lower-cases A-Z and turns every byte that is no digit, letter or part of a
#: non-ASCII character into a space; ``.split()`` then gives the word list.
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 0x80 or chr(c).isalnum() else 32
    for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``; a local master may do with a temporary one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="lamella-"))
    return sc.getCheckpointDir()


def drop_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: later plans read the rows back from shared storage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, nulls kept."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def in_slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of text, whatever the batch size."""
    for batch in batches:
        size, start = 0, 0
        column = batch.column(text)
        lengths = pc.binary_length(column).fill_null(0).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + n > most:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if batch.num_rows > start:
            yield batch.slice(start)


def give_back() -> None:
    """Returns to the system what this worker has freed; earlier stages' share of it as well, as workers serve one stage after the other."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone keeps it
    if trim:
        trim(0)


def with_text(batches: Iterator[pa.RecordBatch], carried: str | None) -> Iterator[pa.RecordBatch]:
    """Batches with a column ``text``: their own, or that field of the carried ``row``, which is not sent twice."""
    for batch in batches:
        if carried is None:
            yield batch
        else:
            yield pa.RecordBatch.from_arrays([*batch.columns, pc.struct_field(batch.column("row"), [carried])], [*batch.schema.names, "text"])


def is_held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def map_texts(df: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(kernel, schema)


#: Fewer keys than this can hold more than 1/SPREAD of all rows each, so these may be broadcast.
SPREAD = 1_024


def meet(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of ``rows`` to ``groups`` on ``key``, the rows of hot keys spread over all tasks.

    groups: one row per key, with a column ``n``, the number of its rows; total:
    the sum of ``n``, or more.  A key with more than total / SPREAD rows is hot.
    There are fewer than SPREAD of these, whatever the data: they are broadcast,
    and their rows stay where they lie.  All other keys meet in a shuffle.
    """
    bar = total // SPREAD
    hot, rest = F.broadcast(groups.where(F.col("n") > bar)), groups.where(F.col("n") <= bar)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key))


def most_frequent(counts: DataFrame, room: int, *more: str) -> list[tuple]:
    """Of (word, n) with one row per word, the ``room`` words of greatest n, or a few less; by falling n, then word.  more: further columns to return.

    Only these reach the driver.  n is cut into steps of a 32nd octave, of which
    there are at most 2,048; the step that does not fit whole is cut by a hash
    of the word.
    """
    step = F.floor(F.log2("n") * 32)
    floor, last = None, None
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("d")).collect(), reverse=True):
        if r["d"] > room:
            last = r["s"]
            break
        room, floor = room - r["d"], r["s"]
    keep = step >= floor if floor is not None else F.lit(False)
    if last is not None and room:
        bucket = F.pmod(F.xxhash64("word"), F.lit(4096))
        some = 0
        for r in sorted(counts.where(step == last).groupBy(bucket.alias("b")).agg(F.count("*").alias("d")).collect()):
            if r["d"] > room:
                break
            room, some = room - r["d"], r["b"] + 1
        keep = keep | ((step == last) & (bucket < some))
    found = counts.where(keep).select("word", "n", *more).toArrow()
    return sorted(zip(*(found[c].to_pylist() for c in ("word", "n", *more))), key=lambda x: (-x[1], x[0]))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of an edge table (a, b): one row (node, label) per node.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the
    edge set is a star forest; the label is the smallest node of the component.
    Each round is a shuffle of the remaining edges and is cut by a checkpoint;
    the edges of a hub are spread (``meet``).  Loops (a = b), repeated edges and
    an empty table are fine.
    """
    state = cut(edges.where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct())
    before, total = None, 2 * state.count()
    for _ in range(most_rounds):
        both = state.unionByName(state.selectExpr("b a", "a b"))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).selectExpr("a", "least(a, m) m", "n")
        large = cut(meet(both, low, "a", total).where("b > a").selectExpr("b a", "m b").where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = meet(large, low, "a", total).where("b <> m").selectExpr("b a", "m b").unionByName(low.selectExpr("a", "m b"))
        state = cut(small.distinct())
        now = state.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before, total = tuple(now), 2 * now[0]
    else:
        raise RuntimeError("components did not settle")
    return state.selectExpr("a node", "b label").unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
