"""What Parquet files say about themselves: one row per column chunk, read in tasks.

Footers give counts and lengths; the headers of a chunk's pages, which are
walked one after the other, give the number of pages, the entries of its
dictionary and the bytes that headers and levels take.  Tasks read local and
HDFS files by themselves; of other stores the driver reads the footers through
Hadoop, and what only page headers tell is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .files import data_files, footers

CHUNKS = (
    "file string, record_group int, path string, type string, encodings string, compression string, max_repetition_level int, max_definition_level int, num_records long, num_values long, num_nulls long, "
    "length long, uncompressed_length long, dictionary_length long, num_pages long, num_dictionary_values long, data_header_length long, dictionary_header_length long, repetition_levels_length long, definition_levels_length long, "
    "file_length long, group_length long"
)
_NAMES = [c.split()[0] for c in CHUNKS.split(", ")]
#: A page header is a few dozen bytes; one with long statistics is read again with more.
HEADER = 1024


class _Compact:
    """The structs, integers and binaries of Thrift's compact protocol, as nested dicts by field number."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def varint(self) -> int:
        out = shift = 0
        while True:
            b = self.byte()
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    def value(self, kind: int):
        if kind in (1, 2):
            return kind == 1
        if kind == 3:
            return self.byte()
        if kind in (4, 5, 6):
            n = self.varint()
            return n >> 1 ^ -(n & 1)
        if kind == 7:
            self.at += 8
            return None
        if kind == 8:
            n = self.varint()
            self.at += n
            if self.at > len(self.data):
                raise IndexError
            return None
        if kind in (9, 10):
            head = self.byte()
            n = head >> 4 if head >> 4 < 15 else self.varint()
            return [self.value(head & 15) for _ in range(n)]
        return self.struct()

    def struct(self) -> dict:
        out, field = {}, 0
        while True:
            head = self.byte()
            if head == 0:
                return out
            if head >> 4:
                field += head >> 4
            else:
                n = self.varint()
                field = n >> 1 ^ -(n & 1)
            out[field] = self.value(head & 15)


def page_headers(f, start: int, end: int) -> Iterator[tuple[dict, int]]:
    """(header, its length) of each page between two offsets of an open file."""
    while start < end:
        room = HEADER
        while True:
            f.seek(start)
            reader = _Compact(f.read(min(room, end - start)))
            try:
                header = reader.struct()
                break
            except IndexError:
                if room >= end - start:
                    raise ValueError("broken page header") from None
                room *= 8
        yield header, reader.at
        start += reader.at + header[3]


def _chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.fs
    import pyarrow.parquet as pq

    for frame in frames:
        for name, size in zip(frame["path"], frame["length"]):
            fs, at = pyarrow.fs.FileSystem.from_uri(name) if "://" in name else (pyarrow.fs.LocalFileSystem(), unquote(urlparse(name).path))
            rows = []
            with fs.open_input_file(at) as f:
                try:
                    meta = pq.ParquetFile(f).metadata
                except Exception as e:
                    raise ValueError(f"{name} is not a valid Parquet file") from e
                levels = {meta.schema.column(i).path: meta.schema.column(i) for i in range(meta.num_columns)}
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    columns = [group.column(i) for i in range(group.num_columns)]
                    for c in columns:
                        start = c.dictionary_page_offset if c.has_dictionary_page and c.dictionary_page_offset else c.data_page_offset
                        pages = entries = data_header = dictionary_header = repetition = definition = 0
                        for header, n in page_headers(f, start, start + c.total_compressed_size):
                            pages += 1
                            if header[1] == 2:
                                entries += header[7][1]
                                dictionary_header += n
                            else:
                                data_header += n
                                if header[1] == 3:
                                    definition += header[8][5]
                                    repetition += header[8][6]
                        nulls = c.statistics.null_count if c.is_stats_set and c.statistics.has_null_count else None
                        rows.append((
                            name, g, c.path_in_schema, c.physical_type, ",".join(sorted(set(c.encodings))), c.compression, levels[c.path_in_schema].max_repetition_level, levels[c.path_in_schema].max_definition_level,
                            group.num_rows, c.num_values, nulls, c.total_compressed_size, c.total_uncompressed_size, max(0, c.data_page_offset - start), pages, entries, data_header, dictionary_header, repetition, definition,
                            size, sum(x.total_compressed_size for x in columns),
                        ))
                if not rows:  # no row group: the file counts all the same
                    rows.append((name, -1, *[None] * 18, size, 0))
            yield pd.DataFrame(rows, columns=_NAMES).astype({n: "Int64" for n, k in (c.split() for c in CHUNKS.split(", ")) if k in ("int", "long")})


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """One row per column chunk of the files below ``path``; a file without row groups has one with record_group -1."""
    found = data_files(spark, path)
    if all(urlparse(p).scheme in ("", "file", "hdfs") for p, _ in found):
        n = min(len(found), 8 * spark.sparkContext.defaultParallelism) or 1
        named = spark.createDataFrame(found, "path string, length long").repartition(n)
        return named.mapInPandas(_chunks, CHUNKS)
    rows = []
    for f in footers(spark, path):
        for g, group in enumerate(f["groups"]):
            rows += [(f["path"], g, c["path"], c["type"], c["encodings"], c["compression"], c["max_repetition_level"], c["max_definition_level"], group["num_records"], c["num_values"], c["num_nulls"], c["data_length"], c["uncompressed_length"], c["dictionary_length"], *[None] * 6, f["length"], group["length"]) for c in group["columns"]]
        if not f["groups"]:
            rows.append((f["path"], -1, *[None] * 18, f["length"], 0))
    return spark.createDataFrame(rows, CHUNKS)
