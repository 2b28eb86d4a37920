"""Primitive, logical and custom leaf types: their Spark types and write-side coercions.

A coercion is a pair of column expressions: the value in the target type, and
whether the source value can't be coerced (None where it always can).  Writes coerce within a family
(numbers among numbers, anything to string) and never parse: a string is no int.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TEXTS = (T.StringType, T.VarcharType, T.CharType)
RATIO = T.StructType([T.StructField("num", T.DecimalType(38, 0)), T.StructField("den", T.DecimalType(38, 0))])

PRIMITIVES: dict[str, T.DataType] = {
    "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(),
    "byte-array": T.BinaryType(), "fixed-length-byte-array": T.BinaryType(),
}
#: Logical type: (Spark type, base type by name).
LOGICAL: dict[str, tuple[T.DataType, str]] = {
    "string": (T.StringType(), "byte-array"), "inst": (T.TimestampType(), "long"), "uuid": (T.StringType(), "fixed-length-byte-array"), "char": (T.StringType(), "int"),
    "bigint": (T.DecimalType(38, 0), "byte-array"), "bigdec": (T.DecimalType(38, 10), "byte-array"), "ratio": (RATIO, "byte-array"),
    "keyword": (T.StringType(), "string"), "symbol": (T.StringType(), "string"), "byte-buffer": (T.BinaryType(), "byte-array"),
}
_UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
_RANGE = {"int": (-(2**31), 2**31 - 1), "long": (-(2**63), 2**63 - 1)}


def same(c: Column) -> Column:
    return c


@dataclass(frozen=True)
class CustomType:
    """A named type over another; the functions map columns to columns."""

    name: str
    base: str
    to_base: Callable[[Column], Column] = same
    from_base: Callable[[Column], Column] = same
    coerce: Callable[[Column], Column] = same

    def __post_init__(self):
        if not isinstance(self.name, str) or not isinstance(self.base, str):
            raise ValueError("a custom type's name and base are names")
        for f in (self.to_base, self.from_base, self.coerce):
            if not callable(f):
                raise ValueError(f"custom type {self.name}: functions are expected")


@dataclass(frozen=True)
class Types:
    """The types that a reader or writer knows."""

    custom: dict[str, CustomType] = field(default_factory=dict)

    def __post_init__(self):
        for name in self.custom:
            self.chain(name)

    @classmethod
    def of(cls, *custom: CustomType) -> Types:
        return cls({c.name: c for c in custom})

    def chain(self, name: str) -> list[CustomType]:
        """Custom types from ``name`` down to the built-in one."""
        found: list[CustomType] = []
        while name in self.custom:
            if any(c.name == name for c in found):
                raise ValueError(f"Loop detected for custom type '{name}'")
            found.append(self.custom[name])
            name = found[-1].base
        if name not in PRIMITIVES and name not in LOGICAL:
            raise ValueError(f"Unknown type: '{name}'")
        return found

    def built_in(self, name: str) -> str:
        found = self.chain(name)
        return found[-1].base if found else name

    def spark(self, name: str) -> T.DataType:
        """How a type is stored."""
        name = self.built_in(name)
        return PRIMITIVES[name] if name in PRIMITIVES else LOGICAL[name][0]

    def read(self, name: str, c: Column) -> Column:
        for t in reversed(self.chain(name)):
            c = t.from_base(c)
        return c

    def write(self, name: str, c: Column, source: T.DataType) -> tuple[Column, Column | None]:
        """The stored value, and whether ``c`` can't be coerced."""
        found = self.chain(name)
        for t in found:
            c = t.to_base(t.coerce(c))
        if found:
            stored = self.spark(name)
            value = c.cast(stored)
            return value, c.isNotNull() & value.isNull()
        return coerce(name, c, source)

    def base_of(self, name: str) -> str:
        """Name of the primitive below a type."""
        name = self.built_in(name)
        while name in LOGICAL:
            name = LOGICAL[name][1]
        return name


def coerce(name: str, c: Column, source: T.DataType) -> tuple[Column, Column | None]:
    """Value in built-in type ``name`` and failure (None: never), for a column of Spark type ``source``."""
    target = PRIMITIVES[name] if name in PRIMITIVES else LOGICAL[name][0]
    never, always = None, c.isNotNull()
    none = F.lit(None).cast(target)
    if isinstance(source, T.NullType):
        return none, never
    if source == target and name not in ("inst", "uuid", "char", "ratio"):
        return c, never
    if name == "boolean":
        # truthiness: every value but false counts as true
        return (c, never) if isinstance(source, T.BooleanType) else (F.when(c.isNotNull(), F.lit(True)), never)
    if name in ("int", "long"):
        if not isinstance(source, NUMBERS):
            return none, always
        low, high = _RANGE[name]
        whole = F.when(F.isnan(c), F.lit(None)).otherwise(c) if isinstance(source, (T.FloatType, T.DoubleType)) else c
        outside = ~F.coalesce(whole.try_cast("decimal(38,6)").between(F.lit(low).cast("decimal(38,6)"), F.lit(high).cast("decimal(38,6)")), F.lit(False))
        outside = c.isNotNull() & outside
        return F.when(~outside, whole.try_cast(target)), outside
    if name in ("float", "double"):
        return (c.cast(target), never) if isinstance(source, NUMBERS) else (none, always)
    if name in ("byte-array", "fixed-length-byte-array", "byte-buffer"):
        if isinstance(source, T.BinaryType):
            return c, never
        if isinstance(source, T.ArrayType) and isinstance(source.elementType, NUMBERS):
            digits = F.transform(c, lambda b: F.lpad(F.hex(F.pmod(b.cast("int"), F.lit(256))), 2, "0"))
            return F.unhex(F.array_join(digits, "")), F.exists(c, lambda b: b.isNull() | (b < -128) | (b > 255))
        return none, always
    if name in ("string", "keyword", "symbol"):
        if isinstance(source, TEXTS):
            return c, never
        return (c.cast("string"), never) if name == "string" else (none, always)
    if name == "inst":
        # epoch milliseconds are what is kept
        return (F.timestamp_millis(F.unix_millis(c.cast("timestamp"))), never) if isinstance(source, (T.TimestampType, T.TimestampNTZType)) else (none, always)
    if name == "uuid":
        return (F.when(c.rlike(_UUID), F.lower(c)), c.isNotNull() & ~c.rlike(_UUID)) if isinstance(source, TEXTS) else (none, always)
    if name == "char":
        if isinstance(source, TEXTS):
            return F.when(F.char_length(c) == 1, c), c.isNotNull() & (F.char_length(c) != 1)
        if isinstance(source, NUMBERS):
            outside = c.isNotNull() & ~c.between(0, 65535)
            return F.when(~outside, F.decode(F.unhex(F.lpad(F.hex(c.cast("int")), 4, "0")), "UTF-16BE")), outside
        return none, always
    if name in ("bigint", "bigdec"):
        if not isinstance(source, (*NUMBERS, *TEXTS)):
            return none, always
        value = c.try_cast(target)
        return value, c.isNotNull() & value.isNull()
    if name == "ratio":
        if source == RATIO:
            bad = c.isNotNull() & (c["num"].isNull() | c["den"].isNull() | (c["den"] == 0))
            return F.when(~bad, c), bad
        value, bad = coerce("bigint", c, source)
        return F.when(value.isNotNull(), F.struct(value.alias("num"), F.lit(1).cast("decimal(38,0)").alias("den"))), bad
    raise ValueError(f"Unknown type: '{name}'")


def instant_to_millis(c: Column) -> Column:
    return F.unix_millis(c)


def millis_to_instant(c: Column) -> Column:
    return F.timestamp_millis(c)


def uuid_to_bytes(c: Column) -> Column:
    return F.unhex(F.translate(c, "-", ""))


def bytes_to_uuid(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.hex(c)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def zig_zag(c: Column) -> Column:
    """Signed to unsigned, small magnitudes to small numbers."""
    return F.shiftleft(c.cast("long"), 1).bitwiseXOR(F.shiftright(c.cast("long"), 63))


def un_zig_zag(c: Column) -> Column:
    return F.shiftrightunsigned(c.cast("long"), 1).bitwiseXOR(-c.cast("long").bitwiseAND(F.lit(1)))


def bit_width(c: Column) -> Column:
    """Bits that a non-negative integer needs."""
    return F.when(c == 0, 0).otherwise(F.length(F.bin(c)))


def varint_size(c: Column) -> Column:
    """Bytes of an unsigned variable-length integer."""
    return F.greatest(F.lit(1), F.ceil(bit_width(c) / 7)).cast("int")
