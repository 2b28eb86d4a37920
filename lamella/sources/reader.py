"""Readers and views: lazy, composable handles on files of nested records."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import fold as folds
from ..plans.project import ALL, Options, plan
from ..schema import Node, depict, from_spark, parse, read_text, to_spark, unparse
from ..types import CustomType, Types
from . import files, stats

VALUE = "value"
#: Position in the file or folder, its place in the list, and the record, inside a view.
INDEX, FILE, RECORD = "_index", "_file", "_record"
#: The position at which the row's part file begins.
PART = "_part"
#: Part files of which (path hash, first position) is broadcast, about 2 MB; with more of them it is joined.
PARTS_BROADCAST = 1 << 16


def _known(options: dict, allowed: Sequence[str]) -> None:
    wrong = sorted(set(options) - set(allowed))
    if wrong:
        raise ValueError(f"{wrong[0]} is not a supported option; expected one of {', '.join(allowed)}")


@dataclass(frozen=True)
class View:
    """A lazy table of records.  ``frame`` has the record's fields, or ``value``, and two hidden
    positions; ``bare`` is the same without positions, which cost the scan something."""

    frame: DataFrame
    record: bool
    bare: DataFrame | None = None
    _sampled: bool = False
    _indexed: bool = False
    _changed: bool = False
    _counts: Callable[[], list[int]] | None = field(default=None, compare=False)

    @property
    def df(self) -> DataFrame:
        """The records as a DataFrame, without positions."""
        return self.frame.drop(INDEX, FILE, PART) if self.bare is None else self.bare

    def with_index(self, name: str = "index") -> DataFrame:
        return self.frame.withColumnRenamed(INDEX, name).drop(FILE, PART)

    def sample(self, f: Callable[[Column], Column]) -> View:
        """Rows whose position in their file satisfies ``f``; once, and before any transform."""
        if self._sampled:
            raise ValueError("Cannot define multiple sample functions")
        if self._indexed or self._changed:
            raise ValueError("sample must come before any index or transform")
        return replace(self, frame=self.frame.where(f(F.col(INDEX))), bare=None, _sampled=True)

    def index_by(self, f: Callable[[Column, Callable[[str], Column]], Column]) -> View:
        """One value per row from its position and its fields."""
        if self._indexed:
            raise ValueError("Cannot define multiple index functions")
        if self._changed:
            raise ValueError("index_by must come before any transform")
        made = self.frame.select(f(F.col(INDEX), F.col).alias(VALUE), INDEX, FILE, PART)
        return replace(self, frame=made, bare=None, record=False, _indexed=True)

    def eduction(self, *steps: Callable[[DataFrame], DataFrame]) -> View:
        """Transforms from left to right; see ``operators.rows``."""
        frame, bare = self.frame, self.bare
        for step in steps:
            frame, bare = step(frame), None if bare is None else step(bare)
        record = self.record and (frame.columns == self.frame.columns or [c for c in frame.columns if c not in (INDEX, FILE, PART)] != [VALUE])
        return replace(self, frame=frame, bare=bare, record=record, _changed=True)

    def head(self, n: int) -> View:
        """The first n rows by position; once sampled or transformed, those of least position that are left."""
        if self._counts is None or self._changed or self._sampled:
            return replace(self, frame=self.frame.orderBy(FILE, INDEX).limit(n), bare=None, _changed=True)
        cond, left = F.lit(False), n
        for number, count in enumerate(self._counts()):
            cond = cond | ((F.col(FILE) == number) & (F.col(INDEX) < min(count, left)))
            left -= min(left, count)
            if not left:
                break
        return replace(self, frame=self.frame.where(cond), bare=None, _changed=True)

    def tail(self, n: int) -> View:
        """The last n rows of the last file or folder, by position; of several the rest from those before."""
        if self._counts is None or self._changed:
            raise ValueError("tail needs an untransformed view of files")
        cond, left = F.lit(False), n
        for number, count in reversed(list(enumerate(self._counts()))):
            cond = cond | ((F.col(FILE) == number) & (F.col(INDEX) >= max(0, count - left)))
            left -= min(left, count)
            if not left:
                break
        return replace(self, frame=self.frame.where(cond), bare=None, _changed=True)

    def cache(self) -> View:
        """The same view, kept in memory and on disk once it is first run; folds then start from what is kept."""
        return replace(self, frame=self.frame.persist(), bare=None)

    def ordered(self) -> DataFrame:
        """Rows in file order."""
        return self.frame.orderBy(FILE, INDEX).drop(FILE, INDEX, PART)

    def count(self) -> int:
        return self.df.count()

    def first(self):
        row = self.frame.orderBy(FILE, INDEX).first()
        return None if row is None else self._plain(row)

    def rows(self):
        """Records one by one, in file order, without holding them all."""
        return map(self._plain, self.frame.orderBy(FILE, INDEX).toLocalIterator())

    def _plain(self, row):
        return _plain(row, self.record)

    def reduce(self, f, *init):
        """Left fold in file order; without init the first record is the seed.  ``f`` runs in tasks."""
        return folds.reduce(self.frame, partial(_plain, record=self.record), f, *init)

    def fold(self, combine, reduce_=None):
        """Per-partition folds from ``combine()``, combined in file order; ``combine`` is associative."""
        return folds.fold(self.frame, self.record, combine, reduce_ or combine)

    def aggregate(self, *columns: Column) -> DataFrame:
        """Commutative folds as Spark aggregates."""
        return self.df.agg(*columns)


def _plain(row, record: bool):
    found = {k: v for k, v in row.asDict(True).items() if k not in (INDEX, FILE, PART)}
    if not record:
        return found[VALUE]
    return found if any(v is not None for v in found.values()) else None


@dataclass(frozen=True)
class Reader:
    """One file or written folder."""

    spark: SparkSession
    path: str
    types: Types = Types()

    @classmethod
    def open(cls, spark: SparkSession, path: str, custom_types: Sequence[CustomType] = (), **more) -> Reader:
        _known(more, ["custom_types"])
        if not all(isinstance(c, CustomType) for c in custom_types):
            raise ValueError("custom_types expects custom types")
        files.data_files(spark, path)
        return cls(spark, path, Types.of(*custom_types))

    @property
    def notes(self) -> dict:
        return files.sidecar(self.spark, self.path)

    @property
    def node(self) -> Node:
        """The schema tree: as written, or from Spark's schema for foreign files.  A custom
        type that this reader does not know reads as its base type."""
        found = self.notes
        if "schema" in found:
            known = Types({**{n: CustomType(n, b) for n, b in found.get("custom_types", {}).items()}, **self.types.custom})
            return self._based(parse(read_text(found["schema"]), known), found.get("custom_types", {}))
        return from_spark(self.spark.read.parquet(self.path).schema)

    def _based(self, node: Node, written: dict[str, str]) -> Node:
        kind = node.type
        while kind in written and kind not in self.types.custom:
            kind = written[kind]
        return replace(
            node, type=kind, fields=tuple((k, self._based(v, written)) for k, v in node.fields),
            element=node.element and self._based(node.element, written), key=node.key and self._based(node.key, written),
        )

    def schema(self):
        """Plain schema, without encodings."""
        return unparse(self.node)

    def full_schema(self) -> DataFrame:
        """Leaves with the encodings and compression that the files have."""
        return stats.column_stats(self.spark, self.path).select("path", "type", "encodings", "compression")

    def schema_text(self, full: bool = False) -> str:
        return depict(self.node, not full)

    def metadata(self):
        return self.notes.get("metadata")

    def custom_types(self) -> dict[str, str]:
        return self.notes.get("custom_types", {})

    def num_records(self) -> int:
        return stats.num_records(self.spark, self.path)

    def stats(self) -> dict[str, DataFrame]:
        return {"global": stats.global_stats(self.spark, self.path), "columns": stats.column_stats(self.spark, self.path), "record_groups": stats.group_stats(self.spark, self.path)}

    def read(self, query=ALL, sub_schema_in: Sequence[str] = (), missing_fields_as_nil: bool = True, readers: dict | None = None, **more) -> View:
        return _read(self, 0, query, sub_schema_in, missing_fields_as_nil, readers, more)


@dataclass(frozen=True)
class FilesReader:
    """An ordered list of files or folders, read as one; they may differ in schema."""

    readers: tuple[Reader, ...]

    @classmethod
    def open(cls, spark: SparkSession, paths: Sequence[str], custom_types: Sequence[CustomType] = (), **more) -> FilesReader:
        return cls(tuple(Reader.open(spark, p, custom_types, **more) for p in paths))

    def read(self, query=ALL, sub_schema_in: Sequence[str] = (), missing_fields_as_nil: bool = True, readers: dict | None = None, **more) -> View:
        views = [_read(r, i, query, sub_schema_in, missing_fields_as_nil, readers, more) for i, r in enumerate(self.readers)]
        frame, bare = views[0].frame, views[0].bare
        for v in views[1:]:
            frame, bare = frame.unionByName(v.frame, allowMissingColumns=True), bare.unionByName(v.bare, allowMissingColumns=True)
        return View(frame, views[0].record, bare, _counts=lambda: [r.num_records() for r in self.readers])


def _read(reader: Reader, number: int, query, path, lenient, tags, more) -> View:
    _known(more, ["query", "sub_schema_in", "missing_fields_as_nil", "readers"])
    if not isinstance(lenient, bool):
        raise ValueError("missing_fields_as_nil expects a boolean")
    if isinstance(path, str) or not all(isinstance(p, str) for p in path):
        raise ValueError("sub_schema_in expects a list of field names")
    for name, f in (tags or {}).items():
        if not isinstance(name, str) or not callable(f):
            raise ValueError("readers expects names with functions")
    node = reader.node
    root = None if node.kind == "record" else VALUE
    found = plan(node, query, path, Options(reader.types, tags or {}, lenient), root)
    stored = found.read_schema
    data = reader.spark.read.schema(stored).parquet(reader.path) if stored.fields else reader.spark.read.parquet(reader.path)
    if found.parts is not None:
        made, record = found.parts, True
    else:
        value = F.lit(None) if found.column is None else found.column
        kind = data.select(value.alias(RECORD)).schema[RECORD].dataType
        record = isinstance(kind, T.StructType)
        made = [value[n].alias(n) for n in kind.names] if record else [value.alias(VALUE)]
    return View(_positioned(reader, data, made, number), record, data.select(*made), _counts=lambda: [reader.num_records()])


def _positioned(reader: Reader, data: DataFrame, made: list[Column], number: int) -> DataFrame:
    """Records with their positions, which run on from part file to part file in name order.

    Spark numbers the rows of each part file; the files' row counts, from a scan
    of no columns, give the position at which each begins.
    """
    parts = len(files.data_files(reader.spark, reader.path))
    row = F.col("_metadata.row_index")
    if parts <= 1:
        return data.select(*made, row.alias(INDEX), F.lit(number).alias(FILE), F.lit(0).cast("long").alias(PART))
    counts = reader.spark.read.parquet(reader.path).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n"))
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # one row per part file
    begins = counts.select(F.xxhash64("path").alias("_path"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(PART))
    rows = data.select(*made, row.alias(INDEX), F.xxhash64("_metadata.file_path").alias("_path"))
    joined = rows.join(F.broadcast(begins) if parts <= PARTS_BROADCAST else begins, "_path").drop("_path")
    return joined.withColumn(INDEX, F.col(PART) + F.col(INDEX)).withColumn(FILE, F.lit(number))


__all__ = ["FILE", "FilesReader", "INDEX", "Reader", "VALUE", "View", "to_spark"]
