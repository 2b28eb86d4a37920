"""Text sources: JSON lines (plain or gzipped), delimited tables, and EDN lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..schema import Keyword, Map, Node, Set, Tag, parse, read_text, to_spark
from ..types import Types


def json_lines(spark: SparkSession, path: str, schema, types: Types = Types()) -> DataFrame:
    """Records of a stated schema; ``.gz`` files are unpacked."""
    return spark.read.schema(_struct(schema, types)).json(path)


def delimited(spark: SparkSession, path: str, schema, sep: str = "|", types: Types = Types()) -> DataFrame:
    """Flat records, one a line; a trailing separator is allowed."""
    return spark.read.schema(_struct(schema, types)).option("sep", sep).csv(path)


def edn_lines(spark: SparkSession, path: str, schema, types: Types = Types()) -> DataFrame:
    """One EDN form a line, parsed in batches in the tasks and shaped to the schema."""
    node = parse(schema, types)
    kind = to_spark(node, types)
    struct = kind if isinstance(kind, T.StructType) else T.StructType([T.StructField("value", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        shape = to_arrow_schema(struct)
        for batch in batches:
            rows = [value_of(read_text(line), node) for line in batch.column(0).to_pylist() if line.strip()]
            rows = rows if isinstance(kind, T.StructType) else [{"value": r} for r in rows]
            yield pa.RecordBatch.from_pylist([r or {} for r in rows], shape)

    return spark.read.text(path).mapInArrow(run, struct)


def value_of(form, node: Node):
    """Plain EDN data as Python values of a schema's shape."""
    if form is None or form == "nil":
        return None
    if isinstance(form, Tag):
        form = form.query
    if node.kind == "leaf":
        if isinstance(form, Keyword):
            return ":" + form.name if node.type == "string" else form.name
        if node.type in ("int", "long"):
            return int(form)
        if node.type in ("float", "double"):
            return float(form)
        return form == "true" if node.type == "boolean" else form
    if node.kind == "record":
        return {k: value_of(form.get(k), n) for k, n in node.fields}
    if node.kind == "map":
        pairs = form.items() if isinstance(form, dict) else [(form.key, form.value)] if isinstance(form, Map) else []
        return [(value_of(k, node.key), value_of(v, node.element)) for k, v in pairs]
    items = [form.element] if isinstance(form, Set) else form
    return [value_of(x, node.element) for x in items]


def _struct(schema, types: Types) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else to_spark(parse(schema, types), types)
