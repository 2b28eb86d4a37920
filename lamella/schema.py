"""Schemas of nested records, written as plain Python data or as text.

=====================  ==========================================
``{"a": s, ...}``       record
``[s]``                 vector
``(s,)``                list
``Set(s)``              set
``Map(k, v)``           map
``"int"``               column of a type
``Req(s)``              the same, required
``Col(type, enc, comp)``  column with a stated encoding and compression
=====================  ==========================================

The text form is EDN: ``{:a #req int :b [string] :c #{long} :d {string #col [int delta]}}``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import types as T

from .types import LOGICAL, PRIMITIVES, RATIO, Types

ENCODINGS: dict[str, tuple[str, ...]] = {
    "boolean": ("plain", "dictionary"),
    "int": ("plain", "vlq", "zig-zag", "packed-run-length", "delta", "dictionary", "frequency"),
    "long": ("plain", "vlq", "zig-zag", "delta", "dictionary", "frequency"),
    "float": ("plain", "dictionary", "frequency"),
    "double": ("plain", "dictionary", "frequency"),
    "byte-array": ("plain", "incremental", "delta-length", "dictionary", "frequency"),
    "fixed-length-byte-array": ("plain", "dictionary", "frequency"),
}
COMPRESSIONS = ("none", "deflate")


@dataclass(frozen=True)
class Col:
    """A leaf as the user writes it."""

    type: str
    encoding: str = "plain"
    compression: str = "none"


@dataclass(frozen=True)
class Req:
    schema: Any


@dataclass(frozen=True)
class Set:
    element: Any


@dataclass(frozen=True)
class Map:
    key: Any
    value: Any


@dataclass(frozen=True)
class Tag:
    """A function to apply to a node of a query, by name."""

    name: str
    query: Any


@dataclass(frozen=True)
class Node:
    """kind: leaf, record, vector, list, set or map.  native: the Spark type of a leaf of a
    foreign file, where it is not the one that its type is stored as."""

    kind: str
    required: bool = False
    type: str = ""
    encoding: str = "plain"
    compression: str = "none"
    fields: tuple[tuple[str, Node], ...] = ()
    element: Node | None = None
    key: Node | None = None
    native: T.DataType | None = None

    def child(self, name: str) -> Node | None:
        return dict(self.fields).get(name)


def parse(form, types: Types = Types()) -> Node:
    """A schema tree from plain data; what a form must hold is checked."""
    if isinstance(form, Node):
        return form
    if isinstance(form, T.DataType):
        return from_spark(form)
    if isinstance(form, Req):
        node = parse(form.schema, types)
        if node.required:
            raise ValueError("req is applied twice")
        return replace(node, required=True)
    if isinstance(form, str):
        form = Col(form)
    if isinstance(form, Col):
        base = types.base_of(form.type)
        encoding = {"zigzag": "zig-zag"}.get(form.encoding, form.encoding)
        if encoding not in ENCODINGS[base]:
            raise ValueError(f"Unsupported encoding '{form.encoding}' for type '{form.type}'")
        if form.compression not in COMPRESSIONS:
            raise ValueError(f"Unsupported compression '{form.compression}'")
        return Node("leaf", type=form.type, encoding=encoding, compression=form.compression)
    if isinstance(form, dict):
        if not form or not all(isinstance(k, str) for k in form):
            raise ValueError("a record has named fields; write a map as Map(key, value)")
        return Node("record", fields=tuple((k, parse(v, types)) for k, v in form.items()))
    if isinstance(form, (list, tuple, set, frozenset)):
        if len(form) != 1:
            raise ValueError("Repeated field must define a single schema element")
        kind = "vector" if isinstance(form, list) else "list" if isinstance(form, tuple) else "set"
        return Node(kind, element=parse(next(iter(form)), types))
    if isinstance(form, Set):
        return Node("set", element=parse(form.element, types))
    if isinstance(form, Map):
        return Node("map", key=parse(form.key, types), element=parse(form.value, types))
    raise ValueError(f"Unable to parse schema element '{form}'")


def unparse(node: Node, plain: bool = True):
    """The form that ``parse`` makes the tree from; ``plain`` leaves encodings out."""
    if node.kind == "leaf":
        out = node.type if plain or (node.encoding, node.compression) == ("plain", "none") else Col(node.type, node.encoding, node.compression)
    elif node.kind == "record":
        out = {k: unparse(v, plain) for k, v in node.fields}
    elif node.kind == "map":
        out = Map(unparse(node.key, plain), unparse(node.element, plain))
    else:
        inner = unparse(node.element, plain)
        out = [inner] if node.kind == "vector" else (inner,) if node.kind == "list" else Set(inner)
    return Req(out) if node.required else out


def as_entries(node: Node) -> bool:
    """Maps whose keys Spark can't hold as keys are stored as arrays of entries."""
    return node.kind == "map" and (node.key.kind == "map" or not node.key.required and node.key.kind != "leaf")


def to_spark(node: Node, types: Types = Types()) -> T.DataType:
    if node.kind == "leaf":
        return node.native or types.spark(node.type)
    if node.kind == "record":
        return T.StructType([T.StructField(k, to_spark(v, types), True, notes(v)) for k, v in node.fields])
    if node.kind == "map":
        key, value = to_spark(node.key, types), to_spark(node.element, types)
        if as_entries(node):
            return T.ArrayType(T.StructType([T.StructField("key", key), T.StructField("value", value)]))
        return T.MapType(key, value)
    return T.ArrayType(to_spark(node.element, types))


def notes(node: Node) -> dict:
    """What of a node Spark's own schema does not keep."""
    out: dict = {"required": True} if node.required else {}
    if node.kind in ("list", "set"):
        out["repetition"] = node.kind
    if node.kind == "leaf" and (node.type not in PRIMITIVES or node.encoding != "plain"):
        out |= {"logical_type": node.type} | ({"encoding": node.encoding} if node.encoding != "plain" else {})
    return out


_BACK = {"boolean": "boolean", "int": "int", "bigint": "long", "float": "float", "double": "double", "binary": "byte-array", "string": "string", "timestamp": "inst", "tinyint": "int", "smallint": "int", "date": "inst", "timestamp_ntz": "inst"}


def from_spark(kind: T.DataType, note: dict | None = None) -> Node:
    note = note or {}
    required = bool(note.get("required"))
    if kind == RATIO:
        return Node("leaf", required, "ratio")
    if isinstance(kind, T.StructType):
        return Node("record", required, fields=tuple((f.name, from_spark(f.dataType, f.metadata)) for f in kind.fields))
    if isinstance(kind, T.ArrayType):
        return Node(note.get("repetition", "vector"), required, element=from_spark(kind.elementType))
    if isinstance(kind, T.MapType):
        return Node("map", required, key=replace(from_spark(kind.keyType), required=True), element=from_spark(kind.valueType))
    if isinstance(kind, T.DecimalType):
        name = "bigint" if kind.scale == 0 else "bigdec"
    else:
        name = _BACK.get(kind.simpleString(), "string")
    name = note.get("logical_type", name)
    usual = PRIMITIVES[name] if name in PRIMITIVES else LOGICAL[name][0] if name in LOGICAL else kind
    return Node("leaf", required, name, note.get("encoding", "plain"), native=None if usual == kind else kind)


def leaf_paths(node: Node, path: tuple = ()) -> list[tuple[tuple, Node]]:
    """Key path of each leaf; None stands for a repetition step."""
    if node.kind == "leaf":
        return [(path, node)]
    if node.kind == "record":
        return [x for k, v in node.fields for x in leaf_paths(v, (*path, k))]
    if node.kind == "map":
        return leaf_paths(node.key, (*path, None, "key")) + leaf_paths(node.element, (*path, None, "val"))
    return leaf_paths(node.element, (*path, None))


def levels(node: Node, repetition: int = 0, definition: int = 0, path: tuple = ()) -> list[tuple[tuple, int, int]]:
    """(path, highest repetition level, highest definition level) of each leaf."""
    definition += not node.required
    if node.kind == "leaf":
        return [(path, repetition, definition)]
    if node.kind == "record":
        return [x for k, v in node.fields for x in levels(v, repetition, definition, (*path, k))]
    inner = [(("key",), node.key), (("val",), node.element)] if node.kind == "map" else [((), node.element)]
    return [x for step, n in inner for x in levels(n, repetition + 1, definition + 1, (*path, None, *step))]


def depict(node: Node, plain: bool = True, indent: int = 0) -> str:
    """EDN text of a schema; records are written one field a line."""
    mark = "#req " if node.required else ""
    if node.kind == "leaf":
        if plain or (node.encoding, node.compression) == ("plain", "none"):
            return mark + node.type
        return f"{mark}#col [{node.type} {node.encoding}{'' if node.compression == 'none' else ' ' + node.compression}]"
    if node.kind == "record":
        pad = "\n" + " " * (indent + len(mark) + 1)
        return mark + "{" + pad.join(f":{k} {depict(v, plain, indent + len(mark) + len(k) + 3)}" for k, v in node.fields) + "}"
    if node.kind == "map":
        return f"{mark}{{{depict(node.key, plain, indent + len(mark) + 1)} {depict(node.element, plain, indent + len(mark) + 1)}}}"
    a, b = {"vector": "[]", "list": "()", "set": ("#{", "}")}[node.kind]
    return mark + a + depict(node.element, plain, indent + len(mark) + len(a)) + b


_TOKEN = re.compile(r'\s*(?:[,\s]|;[^\n]*\n)*(#\{|[\[\](){}]|#[^\s\[\](){}]+|"(?:[^"\\]|\\.)*"|[^\s\[\](){},"]+)')


@dataclass(frozen=True)
class Keyword:
    name: str


def read_text(text: str):
    """Plain data from EDN text, for schemas and queries alike: ``#req`` and ``#col``
    give Req and Col, any other ``#tag`` gives Tag, keyword-keyed maps give dicts."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"Unable to parse '{text[at:]}'")
        tokens.append(m[1])
        at = m.end()
        while at < len(text) and text[at] in " \t\r\n,":
            at += 1
    pos = 0

    def one():
        nonlocal pos
        if pos >= len(tokens):
            raise ValueError("unexpected end of text")
        t = tokens[pos]
        pos += 1
        if t in ("[", "(", "{", "#{"):
            close, items = {"[": "]", "(": ")", "{": "}", "#{": "}"}[t], []
            while True:
                if pos >= len(tokens):
                    raise ValueError("unexpected end of text")
                if tokens[pos] == close:
                    pos += 1
                    break
                items.append(one())
            if t == "[":
                return items
            if t == "(":
                return tuple(items)
            if t == "#{":
                if len(items) != 1:
                    raise ValueError("Repeated field must define a single schema element")
                return Set(items[0])
            if len(items) % 2:
                raise ValueError("a map has an even number of forms")
            pairs = list(zip(items[::2], items[1::2]))
            if all(isinstance(k, Keyword) for k, _ in pairs):
                return {k.name: v for k, v in pairs}
            if len(pairs) != 1:
                raise ValueError("Map field must contain a single key/value schema element")
            return Map(*pairs[0])
        if t in ("]", ")", "}"):
            raise ValueError(f"unexpected '{t}'")
        if t.startswith("#"):
            form = one()
            if t == "#req":
                return Req(form)
            if t == "#col":
                return Col(*(form if isinstance(form, list) else [form]))
            return Tag(t[1:], form)
        if t.startswith(":"):
            return Keyword(t[1:])
        if t.startswith('"'):
            return t[1:-1].replace('\\"', '"').replace("\\\\", "\\")
        return None if t == "nil" else t

    form = one()
    if pos != len(tokens):
        raise ValueError(f"unexpected '{tokens[pos]}'")
    return form


__all__ = ["Col", "Keyword", "LOGICAL", "Map", "Node", "Req", "Set", "Tag", "depict", "from_spark", "leaf_paths", "levels", "parse", "read_text", "to_spark", "unparse"]
