"""Projection: compile a nested query against a schema into Spark columns.

The result of a query has the shape of the query.  Only the leaves it names are
in the pruned read schema, which is handed to the Parquet reader explicitly:
Catalyst prunes struct paths by itself, but not through a lambda over an array.
A record none of whose fields has a value reads as null, at any depth, and a
collection of which the query selects no stored leaf reads as null.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import Col, Map, Node, Req, Set, Tag, as_entries, from_spark, notes, read_text, to_spark
from ..types import Types

#: The query for everything below a node.
ALL = "_"


class MissingField(ValueError):
    pass


@dataclass
class Result:
    """column: None where the query selects nothing; stored: pruned Spark type of what is read;
    plain: the column is what the file holds; source: a column that is null where the value is,
    if that is cheaper to ask; parts: the fields of a record."""

    column: Column | None
    stored: T.DataType | None = None
    plain: bool = False
    source: Column | None = None
    parts: list | None = None

    @property
    def present(self) -> Column:
        if self.parts is not None:
            return _any(self.parts)
        return (self.column if self.source is None else self.source).isNotNull()


@dataclass(frozen=True)
class Options:
    types: Types = Types()
    readers: Mapping[str, Callable[[Column], Column]] = None
    missing_as_nil: bool = True


def show(path: tuple) -> str:
    return "[" + " ".join("nil" if p is None else f":{p}" for p in path) + "]"


def is_empty(query) -> bool:
    """A query element that selects nothing, at any depth."""
    if query is None:
        return True
    if isinstance(query, Tag):
        return False
    if isinstance(query, dict):
        return all(map(is_empty, query.values()))
    if isinstance(query, (list, tuple, set, frozenset)):
        return all(map(is_empty, query))
    return isinstance(query, Set) and is_empty(query.element)


def normal(query) -> Any:
    """Schemas, Spark types and text as queries of the same shape."""
    if isinstance(query, T.DataType):
        query = from_spark(query)
    if isinstance(query, Req):
        return normal(query.schema)
    if isinstance(query, Node):
        if query.kind == "leaf":
            return Col(query.type)
        if query.kind == "record":
            return {k: normal(v) for k, v in query.fields}
        if query.kind == "map":
            return Map(normal(query.key), normal(query.element))
        inner = normal(query.element)
        return [inner] if query.kind == "vector" else (inner,) if query.kind == "list" else Set(inner)
    return query


class Compiler:
    def __init__(self, options: Options):
        self.options, self.missing = options, []

    def reader(self, name: str) -> Callable[[Column], Column]:
        found = (self.options.readers or {}).get(name)
        if found is None:
            raise ValueError(f"No reader function was provided for tag '{name}'")
        return found

    def everything(self, node: Node, c: Column) -> Result:
        """The whole of a node, null records collapsed."""
        stored = to_spark(node, self.options.types)
        if node.kind == "leaf":
            custom = self.options.types.chain(node.type) if node.type in self.options.types.custom else []
            return Result(self.options.types.read(node.type, c), stored) if custom else Result(c, stored, True)
        if node.kind == "record":
            parts = [(k, self.everything(v, c[k])) for k, v in node.fields]
            value = F.struct(*[r.column.alias(k) for k, r in parts])
            return Result(F.when(_any(parts), value), stored, parts=parts)
        if node.kind == "map":
            return self.map_of(node, ALL, ALL, c, (), True)
        probe = self.everything(node.element, F.lit(None))
        if probe.plain:
            return Result(c, stored, True)
        return Result(F.transform(c, lambda e: self.everything(node.element, e).column), stored, source=c)

    def compile(self, node: Node | None, query, c: Column | None, path: tuple = (), repeated: bool = False, element: bool = False) -> Result:
        query = normal(query)
        if isinstance(query, Tag):
            return self.tagged(node, query, c, path, repeated, element)
        if is_empty(query):
            return Result(None)
        if node is None:
            return self.absent(query, path)
        if isinstance(query, str) and query == ALL:
            return self.everything(node, c)
        if isinstance(query, (str, Col)):
            name = query if isinstance(query, str) else query.type
            if node.kind != "leaf":
                raise ValueError(f"Element at path '{show(path)}' is not a column")
            if name != node.type:
                raise ValueError(f"Mismatched column types for field '{show(path)}'. Asked for '{name}' but schema defines '{node.type}'")
            return self.everything(node, c)
        if isinstance(query, dict):
            return self.record(node, query, c, path, repeated)
        if isinstance(query, Map):
            if node.kind != "map":
                raise ValueError(f"Element at path '{show(path)}' is a {node.kind} in schema, cannot be read as a map")
            return self.map_of(node, query.key, query.value, c, path)
        if isinstance(query, Set) or isinstance(query, (set, frozenset)):
            inner = query.element if isinstance(query, Set) else _only(query)
            if node.kind != "set":
                raise ValueError(f"Element at path '{show(path)}' is a {node.kind} in schema, cannot be read as a set")
            found = self.sequence(node, inner, c, path)
            return found if found.plain or found.column is None else Result(F.array_distinct(found.column), found.stored)
        if isinstance(query, (list, tuple)):
            if node.kind not in ("vector", "list", "set", "map"):
                raise ValueError(f"Element at path '{show(path)}' is a {node.kind} in schema, cannot be read as a {'vector' if isinstance(query, list) else 'list'}")
            return self.sequence(node, _only(query), c, path)
        raise TypeError(f"Unable to parse query element '{query!r}'")

    def absent(self, query, path: tuple) -> Result:
        """A field that the schema does not have: null, though tags below see it."""
        if isinstance(query, dict):
            parts = []
            for k, q in query.items():
                r = self.compile(None, q, None, (*path, k))
                if r.column is not None:
                    parts.append((k, r))
            if not parts:
                return Result(None)
            return Result(F.when(_any(parts), F.struct(*[r.column.alias(k) for k, r in parts])), parts=parts)
        if not (isinstance(query, (str, Col, list, tuple, set, frozenset, Set, Map))):
            raise TypeError(f"Unable to parse query element '{query!r}'")
        self.missing.append(path)
        kind = None
        if isinstance(query, Col) or isinstance(query, str) and query != ALL:
            kind = self.options.types.spark(query if isinstance(query, str) else query.type)
        return Result(F.lit(None) if kind is None else F.lit(None).cast(kind))

    def record(self, node: Node, query: dict, c: Column, path: tuple, repeated: bool) -> Result:
        if node.kind != "record":
            raise ValueError(f"Element at path '{show(path)}' is not a record in schema")
        known = [k for k, _ in node.fields if k in query]
        parts, stored = [], []
        for k in [*known, *(k for k in query if k not in known)]:
            child = node.child(k)
            r = self.compile(child, query[k], None if child is None else c[k], (*path, k), repeated)
            if r.column is None:
                continue
            parts.append((k, r))
            if r.stored is not None:
                stored.append(T.StructField(k, r.stored, True, notes(child)))
        if not parts:
            return Result(None)
        value = F.struct(*[r.column.alias(k) for k, r in parts])
        return Result(F.when(_any(parts), value), T.StructType(stored) if stored else None, parts=parts)

    def sequence(self, node: Node, query, c: Column, path: tuple) -> Result:
        inside = node.element
        whole = to_spark(node, self.options.types)
        if node.kind == "map":
            inside = Node("record", True, fields=(("key", node.key), ("value", node.element)))
            if isinstance(query, dict) and "val" in query:
                query = {("value" if k == "val" else k): v for k, v in query.items()}
            entries = c if as_entries(node) else F.map_entries(c)
        else:
            entries = c
        probe = self.compile(inside, query, F.lit(None), (*path, None), True, True)
        if probe.column is None:
            return Result(None)
        if probe.stored is None:  # nothing of it is stored
            return Result(F.lit(None))
        if probe.plain and node.kind != "map":
            return Result(c, T.ArrayType(probe.stored), True)
        stored = whole if node.kind == "map" else T.ArrayType(probe.stored)
        return Result(F.transform(entries, lambda e: Compiler(self.options).compile(inside, query, e, (*path, None), True, True).column), stored, source=c)

    def map_of(self, node: Node, key_query, value_query, c: Column, path: tuple, whole: bool = False) -> Result:
        stored = to_spark(node, self.options.types)
        key = self.compile(node.key, key_query, F.lit(None), (*path, None, "key"), True, True)
        value = self.compile(node.element, value_query, F.lit(None), (*path, None, "val"), True, True)
        if key.column is None or value.column is None:
            return Result(None)

        def read(q, n, step):
            return lambda e: Compiler(self.options).compile(n, q, e, (*path, None, step), True, True).column

        if as_entries(node):
            out = F.transform(c, lambda e: F.struct(read(key_query, node.key, "key")(e["key"]).alias("key"), read(value_query, node.element, "val")(e["value"]).alias("value")))
            return Result(c if key.plain and value.plain else out, stored, key.plain and value.plain)
        if key.plain:
            if value.plain:
                return Result(c, stored, True)
            return Result(F.transform_values(c, lambda k, v: read(value_query, node.element, "val")(v)), stored, source=c)
        # projected keys may meet: the last entry of a key wins, a null key goes
        pairs = F.transform(F.map_entries(c), lambda e: F.struct(read(key_query, node.key, "key")(e["key"]).alias("key"), read(value_query, node.element, "val")(e["value"]).alias("value")))
        # sorted by key, then place: of each key the last one stays.  The inner transform names the sorted array once.
        placed = F.filter(F.transform(pairs, lambda e, i: F.struct(e["key"].alias("key"), i.alias("i"), e["value"].alias("value"))), lambda e: e["key"].isNotNull())
        order = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(a["i"] - b["i"])
        last = F.transform(F.array(F.array_sort(placed, order)), lambda s: F.filter(s, lambda e, i: (i + 1 == F.size(s)) | (F.get(s, i + 1)["key"] != e["key"])))[0]
        return Result(F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))), stored)

    def tagged(self, node: Node | None, tag: Tag, c: Column | None, path: tuple, repeated: bool, element: bool) -> Result:
        if isinstance(tag.query, Tag):
            raise ValueError(f"Element at path '{show(path)}' is tagged twice")
        function = self.reader(tag.name)
        if node is None and isinstance(tag.query, (list, tuple, Set, Map, set, frozenset)):
            found = Result(F.lit(None))  # tags inside a missing collection are not looked at
            self.missing.append(path)
        else:
            found = self.compile(node, tag.query, c, path, repeated, element)
        inner = F.lit(None) if found.column is None else found.column
        value = function(inner)
        if node is not None and node.kind == "leaf" and repeated and not element:
            value = F.when(inner.isNotNull(), value)
        return Result(value, found.stored)


def _only(query):
    if len(query) != 1:
        raise TypeError(f"Unable to parse query element '{query!r}': one element is expected")
    return next(iter(query))


def _any(parts) -> Column:
    out = F.lit(False)
    for _, r in parts:
        out = out | r.present
    return out


def sub_schema(node: Node, path: list[str], strict: bool = False) -> Node | None:
    """The node below a path of record fields; None if it does not exist."""
    at: tuple = ()
    for name in path:
        if node.kind in ("vector", "list", "set", "map"):
            raise ValueError(f"Path '{show(tuple(path))}' contains a repeated field at '{show(at)}'")
        if node.kind == "leaf":
            raise ValueError(f"Path '{show(tuple(path))}' goes through a column at '{show(at)}'")
        node, at = node.child(name), (*at, name)
        if node is None:
            if strict:
                raise MissingField(f"The following fields don't exist: {[show(at)]}")
            return None
    return node


@dataclass
class Plan:
    """column None: nothing selected, every row reads as null.  parts: the columns of a
    root record, which has no use for a null of its own."""

    column: Column | None
    read_schema: T.StructType
    parts: list[Column] | None = None


def plan(root: Node, query=ALL, path: list[str] = (), options: Options = Options(), root_column: str | None = None) -> Plan:
    """Compile a query on the node below ``path``.

    root_column: the column that holds a root which is no record.
    """
    if isinstance(query, str) and query != ALL and query.lstrip()[:1] in tuple("{[(#:\""):
        query = read_text(query)
    path = list(path)
    node = sub_schema(root, path, not options.missing_as_nil)
    c: Column | None = None
    if node is not None:
        parts = ([root_column] if root_column else []) + path
        if parts:
            c = F.col(".".join(f"`{p}`" for p in parts))
    compiler = Compiler(options)
    if node is not None and c is None:
        found = _root_record(compiler, node, normal(query))
    else:
        found = compiler.compile(node, query, c, tuple(path))
    if compiler.missing and not options.missing_as_nil:
        raise MissingField("The following fields don't exist: " + ", ".join(map(show, dict.fromkeys(compiler.missing))))
    stored = found.stored
    for name in reversed(path):
        stored = None if stored is None else T.StructType([T.StructField(name, stored)])
    if root_column and stored is not None:
        stored = T.StructType([T.StructField(root_column, stored)])
    parts = None if found.parts is None else [r.column.alias(k) for k, r in found.parts]
    return Plan(found.column, stored if isinstance(stored, T.StructType) else T.StructType([]), parts if c is None else None)


class _Fields:
    """The root record's fields are columns."""

    def __getitem__(self, name: str) -> Column:
        return F.col(f"`{name}`")


def _root_record(compiler: Compiler, node: Node, query) -> Result:
    return compiler.compile(node, query, _Fields())


__all__ = ["ALL", "Compiler", "MissingField", "Options", "Plan", "Result", "is_empty", "plan", "sub_schema"]
