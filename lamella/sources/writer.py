"""Writing nested records: validate, coerce, divert or fail, then Parquet and a sidecar."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.project import show
from ..schema import Node, as_entries, depict, parse, read_text, to_spark
from ..types import CustomType, Types
from . import files
from .footers import chunks

ERRORS = "_errors"
OPTIONS = ("record_group_length", "data_page_length", "optimize_columns", "compression_thresholds", "invalid", "ignore_extra_fields", "custom_types", "metadata")


@dataclass(frozen=True)
class WriteOptions:
    """invalid: ``raise`` fails the write at the first bad record, ``reject`` diverts them."""

    record_group_length: int = 128 << 20
    data_page_length: int = 256 << 10
    optimize_columns: str = "default"
    compression_thresholds: dict | None = None
    invalid: str = "raise"
    ignore_extra_fields: bool = True
    custom_types: tuple = ()
    metadata: object = None

    def __post_init__(self):
        for name in ("record_group_length", "data_page_length"):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int) or not 0 <= value < 2**31:
                raise ValueError(f"{name} expects a positive int")
        if self.optimize_columns not in ("all", "default", "none"):
            raise ValueError("optimize_columns expects one of all, default, none")
        thresholds = self.compression_thresholds
        if thresholds is not None and (not isinstance(thresholds, dict) or any(k != "deflate" or isinstance(v, bool) or not isinstance(v, (int, float)) or v <= 0 for k, v in thresholds.items())):
            raise ValueError("compression_thresholds expects a map from deflate to a positive ratio")
        if self.invalid not in ("raise", "reject"):
            raise ValueError("invalid expects raise or reject")
        if not isinstance(self.ignore_extra_fields, bool):
            raise ValueError("ignore_extra_fields expects a boolean")
        if not all(isinstance(c, CustomType) for c in self.custom_types):
            raise ValueError("custom_types expects custom types")

    @classmethod
    def of(cls, options: dict) -> WriteOptions:
        wrong = sorted(set(options) - set(OPTIONS))
        if wrong:
            raise ValueError(f"{wrong[0]} is not a supported option; expected one of {', '.join(OPTIONS)}")
        return cls(**options)


@dataclass
class Shaped:
    """A stored value; whether it is in error, and the messages, both None where it can't be.

    plain: the value is the input column as it stands.
    """

    value: Column
    bad: Column | None = None
    messages: Column | None = None
    plain: bool = False


def _errors(found: list[tuple[Column | None, Column | str | None]]) -> tuple[Column | None, Column | None]:
    """One condition and one array of messages from several; messages are made only where needed."""
    found = [(F.coalesce(bad, F.lit(False)), F.array(F.lit(m)) if isinstance(m, str) else m) for bad, m in found if bad is not None]
    if not found:
        return None, None
    bad = found[0][0]
    for more, _ in found[1:]:
        bad = bad | more
    none = F.array().cast("array<string>")
    return bad, F.when(bad, F.concat(*[F.when(b, m).otherwise(none) for b, m in found])).otherwise(none)


def extra_fields(node: Node, kind: T.DataType, path: tuple = ()) -> list[tuple]:
    if node.kind == "record" and isinstance(kind, T.StructType):
        out = []
        for f in kind.fields:
            child = node.child(f.name)
            out += [(*path, f.name)] if child is None else extra_fields(child, f.dataType, (*path, f.name))
        return out
    if isinstance(kind, T.ArrayType) and node.element is not None:
        return extra_fields(node.element, kind.elementType, (*path, None))
    return []


def shape(node: Node, c: Column, kind: T.DataType, types: Types, path: tuple = ()) -> Shaped:
    """Coerce a column to a schema node.  Conditions hold only where the parent is present."""
    at = show(path)
    stored = to_spark(node, types)
    what = {"leaf": "value", "record": "record"}.get(node.kind, "collection")
    missing = (c.isNull() if node.required else None, f"Required {what} at path '{at}' is missing")
    nothing = F.lit(None).cast(stored)

    def wrong(text: str) -> Shaped:
        return Shaped(nothing, *_errors([missing, (c.isNotNull(), text)]))

    if isinstance(kind, T.NullType):
        return Shaped(nothing, *_errors([(F.lit(True) if node.required else None, missing[1])]))
    if node.kind == "leaf":
        value, bad = types.write(node.type, c, kind)
        return Shaped(value, *_errors([missing, (bad, f"Could not coerce value at path '{at}' into a {node.type}")]), plain=value is c)
    if node.kind == "record":
        if not isinstance(kind, T.StructType):
            return wrong(f"Could not read value at path '{at}' as a record")
        have = {f.name: f.dataType for f in kind.fields}
        parts = [(n, shape(child, c[n] if n in have else F.lit(None), have.get(n, T.NullType()), types, (*path, n))) for n, child in node.fields]
        inner = [(None if s.bad is None else c.isNotNull() & s.bad, s.messages) for _, s in parts]
        plain = list(have) == [n for n, _ in parts] and all(s.plain for _, s in parts)
        value = c if plain else F.when(c.isNotNull(), F.struct(*[s.value.alias(n) for n, s in parts]))
        return Shaped(value, *_errors([missing, *inner]), plain)
    if node.kind == "map":
        entry = {}
        if isinstance(kind, T.MapType):
            entries, entry = F.map_entries(c), {"key": kind.keyType, "value": kind.valueType}
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and kind.elementType.names == ["key", "value"]:
            entries, entry = c, {f.name: f.dataType for f in kind.elementType.fields}
        if not entry:
            return wrong(f"Could not read value at path '{at}' as a map")

        def pair(e: Column) -> tuple[Shaped, Shaped]:
            return shape(node.key, e["key"], entry["key"], types, (*path, None, "key")), shape(node.element, e["value"], entry["value"], types, (*path, None, "val"))

        def both(e: Column) -> tuple[Column | None, Column | None]:
            k, v = pair(e)
            no_key = None if as_entries(node) or isinstance(kind, T.MapType) or node.key.required else e["key"].isNull()
            return _errors([(k.bad, k.messages), (v.bad, v.messages), (no_key, f"Required value at path '{show((*path, None, 'key'))}' is missing")])

        key, value = pair(F.lit(None))
        plain = isinstance(kind, T.MapType) and key.plain and value.plain and not as_entries(node)
        made = F.transform(entries, lambda e: F.struct(pair(e)[0].value.alias("key"), pair(e)[1].value.alias("value")))
        if not as_entries(node):
            made = F.map_from_entries(F.filter(made, lambda e: e["key"].isNotNull()))
        return Shaped(c if plain else made, *_errors([missing, _inside(entries, both)]), plain)
    if not isinstance(kind, T.ArrayType):
        return wrong(f"Could not read value at path '{at}' as a {node.kind}")

    def one(e: Column) -> Shaped:
        return shape(node.element, e, kind.elementType, types, (*path, None))

    def of(e: Column) -> tuple[Column | None, Column | None]:
        s = one(e)
        return s.bad, s.messages

    uneven = None
    if node.element.kind == "leaf" and node.element.type == "fixed-length-byte-array":
        uneven = F.size(F.array_distinct(F.transform(c, lambda e: F.length(e)))) > 1
    plain = one(F.lit(None)).plain
    made = c if plain else F.transform(c, lambda e: one(e).value)
    errors = _errors([missing, _inside(c, of), (uneven, f"Fixed-length values at path '{at}' differ in length")])
    return Shaped(F.array_distinct(made) if node.kind == "set" else made, *errors, plain=plain and node.kind != "set")


def _inside(c: Column, of: Callable[[Column], tuple[Column | None, Column | None]]) -> tuple[Column | None, Column | None]:
    """The errors of a collection's elements, each message once."""
    if of(F.lit(None))[0] is None:
        return None, None
    return F.exists(c, lambda e: of(e)[0]), F.array_distinct(F.flatten(F.transform(c, lambda e: of(e)[1])))


def _tree(schema, types: Types) -> Node:
    return parse(read_text(schema) if isinstance(schema, str) and schema.lstrip()[:1] in tuple("{[(#") else schema, types)


def _shaped(df: DataFrame, node: Node, types: Types, root: str | None) -> tuple[list[Column], Column | None, Column | None]:
    """Stored columns, whether a record is in error, and its messages."""
    if root:
        s = shape(node, F.col(root), df.schema[root].dataType, types)
        return [s.value.alias(root)], s.bad, s.messages
    if node.kind != "record":
        raise ValueError("name the column that holds a root which is no record")
    values, errors, stored = [], [], to_spark(node, types)
    have = {f.name: f.dataType for f in df.schema.fields}
    if node.required:
        nil = F.lit(True)
        for name in have:
            nil = nil & F.col(f"`{name}`").isNull()
        errors.append((nil, "Required record at path '[]' is missing"))
    for name, child in node.fields:
        part = shape(child, F.col(f"`{name}`") if name in have else F.lit(None), have.get(name, T.NullType()), types, (name,))
        values.append(part.value.alias(name, metadata=stored[name].metadata))
        errors.append((part.bad, part.messages))
    return values, *_errors(errors)


def validate(df: DataFrame, schema, types: Types = Types(), root: str | None = None, strict_fields: bool = False) -> DataFrame:
    """``df`` in the schema's stored form, with ``_errors``, an array of messages.

    root: the column that holds a root which is no record.
    """
    node = _tree(schema, types)
    extra = extra_fields(node, df.schema[root].dataType if root else df.schema)
    if strict_fields and extra:
        raise ValueError(f"Field(s) not in schema: {', '.join(map(show, extra))}")
    values, _, messages = _shaped(df, node, types, root)
    return df.select(*values, (F.array().cast("array<string>") if messages is None else messages).alias(ERRORS))


def rejects(df: DataFrame, schema, types: Types = Types(), root: str | None = None) -> DataFrame:
    """The records that a write would divert, as they came, with ``_errors``."""
    _, bad, messages = _shaped(df, _tree(schema, types), types, root)
    if bad is None:
        return df.limit(0).withColumn(ERRORS, F.array().cast("array<string>"))
    return df.where(bad).withColumn(ERRORS, messages)


def _leaves(node: Node, path: tuple = ()) -> list[tuple[str, Node]]:
    """Leaves with their paths in the Parquet file."""
    if node.kind == "leaf":
        return [(".".join(path), node)]
    if node.kind == "record":
        return [x for name, child in node.fields for x in _leaves(child, (*path, name))]
    if node.kind == "map" and not as_entries(node):
        return _leaves(node.key, (*path, "key_value", "key")) + _leaves(node.element, (*path, "key_value", "value"))
    if node.kind == "map":
        return _leaves(node.key, (*path, "list", "element", "key")) + _leaves(node.element, (*path, "list", "element", "value"))
    return _leaves(node.element, (*path, "list", "element"))


def encoding_options(node: Node, optimize: str, root: str | None = None) -> dict[str, str]:
    """Parquet's settings for the encodings of a schema.

    Version 2 pages hold delta-coded integers and incrementally coded strings;
    a leaf gets these where its dictionary is off.  ``all``: dictionaries are
    tried on every leaf; ``default``: on all but those with another stated
    encoding; ``none``: on those alone whose stated encoding is one.
    """
    out = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false" if optimize == "none" else "true"}
    for path, leaf in _leaves(node, (root,) if root else ()):
        tabled = leaf.encoding in ("dictionary", "frequency", "packed-run-length")
        if optimize == "none" and tabled:
            out[f"parquet.enable.dictionary#{path}"] = "true"
        elif optimize == "default" and not tabled and leaf.encoding != "plain":
            out[f"parquet.enable.dictionary#{path}"] = "false"
    return out


def write(df: DataFrame, schema, path: str, xform: Callable[[DataFrame], DataFrame] | None = None, root: str | None = None, **options) -> DataFrame | None:
    """Write records under ``path``, replacing what was there.

    xform: a transform before validation.  With ``invalid="reject"`` the input is
    judged once, and the rejected records are returned as a DataFrame: the
    input's columns and ``_errors``.  A threshold of compression is the least
    ratio of uncompressed to compressed length; Parquet has one codec for all
    columns here, so it is the whole's ratio that is measured, and a folder
    below it is written again without compression.
    """
    opts = WriteOptions.of(options)
    types = Types.of(*opts.custom_types)
    if xform:
        df = xform(df)
    node = _tree(schema, types)
    extra = extra_fields(node, df.schema[root].dataType if root else df.schema)
    if extra and not opts.ignore_extra_fields:
        raise ValueError(f"Field(s) not in schema: {', '.join(map(show, extra))}")
    values, bad, messages = _shaped(df, node, types, root)
    turned = None
    if bad is None:
        good = df.select(*values)
    elif opts.invalid == "reject":
        files.scratch(df.sparkSession)
        judged = df.select(F.when(~bad, F.struct(*values)).alias("good"), F.when(bad, F.struct("*")).alias("bad"), F.when(bad, messages).alias(ERRORS)).checkpoint()
        good, turned = judged.where("good is not null").select("good.*"), judged.where("bad is not null").select("bad.*", ERRORS)
    else:
        failed = F.raise_error(F.concat(F.lit("Failed to write record: "), messages[0]))
        good = df.where(F.when(bad, failed.cast("boolean")).otherwise(F.lit(True))).select(*values)
    spark = df.sparkSession

    def save(rows: DataFrame, to: str, codec: str | None) -> None:
        settings = {"parquet.block.size": max(1, opts.record_group_length), "parquet.page.size": max(1, opts.data_page_length)} | encoding_options(node, opts.optimize_columns, root)
        writer = rows.write.mode("overwrite").options(**settings)
        (writer.option("compression", codec) if codec else writer).parquet(to)

    ratio = (opts.compression_thresholds or {}).get("deflate")
    save(good, path, None if opts.compression_thresholds is None else "gzip" if ratio else "none")
    if ratio:
        found = chunks(spark, path).agg(F.sum("uncompressed_length"), F.sum("length")).first()
        if found[1] and found[0] / found[1] < ratio:
            again = f"{files.scratch(spark)}/again-{uuid.uuid4().hex}"
            save(spark.read.parquet(path), again, "none")
            save(spark.read.parquet(again), path, "none")
            files.delete(spark, again)
    notes = {"schema": depict(node, False), "metadata": opts.metadata, "custom_types": {c.name: c.base for c in opts.custom_types}}
    files.write_text(spark, f"{path}/{files.SIDECAR}", json.dumps(notes))
    if opts.invalid == "reject":
        return rejects(df, node, types, root) if turned is None else turned
    return None
