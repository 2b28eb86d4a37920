"""Denormalising flat tables into nested records: lookups and groups.

A lookup is a left outer join to a table with a unique key; the row found becomes
a struct, null where none was.  No side is broadcast by hand: Spark broadcasts a
side below its own threshold and shuffles otherwise.  Large tables are dealt into as
many parts as their files' size asks for, whatever the session's number, so that
sorts of a part stay in memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files

#: Bytes of Parquet to a part, and the least number of parts that is stated; below it Spark's number is as good.
PART_BYTES, LEAST_PARTS = 8 << 20, 8
#: The part in which a fact lies.
_PLACE = "_place"


def lookup(facts: DataFrame, key: str, dim: DataFrame, dim_key: str, name: str, keep_key: bool = False) -> DataFrame:
    """``facts`` with struct ``name``: the row of ``dim`` whose ``dim_key`` equals ``key``."""
    fields = [c for c in dim.columns if c != dim_key or keep_key]
    packed = dim.select(F.col(dim_key).alias("_k"), F.struct(*fields).alias(name))
    out = facts.join(packed, facts[key] == packed["_k"], "left").drop("_k")
    return out if keep_key else out.drop(key)


def group(rows: DataFrame, key: str, order: list[str], name: str, fields: list[str] | None = None) -> DataFrame:
    """One row per key with array ``name`` of the other columns, sorted by ``order``."""
    fields = fields or [c for c in rows.columns if c != key]
    sorted_ = F.array_sort(F.collect_list(F.struct(*order, *[c for c in fields if c not in order])))
    return rows.groupBy(key).agg(F.transform(sorted_, lambda e: F.struct(*[e[c].alias(c) for c in fields])).alias(name))


def _strip(df: DataFrame, prefix: str) -> DataFrame:
    return df.toDF(*[c.removeprefix(prefix) for c in df.columns])


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    prefix = {"region": "r_", "nation": "n_", "customer": "c_", "supplier": "s_", "part": "p_", "orders": "o_", "lineitem": "l_"}
    return {t: _strip(spark.read.parquet(f"{sf_dir}/{t}.parquet"), p) for t, p in prefix.items()}


def parts(spark: SparkSession, *paths: str) -> int:
    """The number of parts into which tables of these files are dealt; 0: as Spark has it."""
    n = -(-sum(length for p in paths for _, length in files.data_files(spark, p)) // PART_BYTES)
    return n if n >= LEAST_PARTS else 0


def dealt(df: DataFrame, n: int, key: str) -> DataFrame:
    return df.repartition(n, key) if n else df


def placed(df: DataFrame, n: int, key: str) -> DataFrame:
    """``df`` with the part, of n, that the rows of a key share."""
    return df.withColumn(_PLACE, F.pmod(F.hash(key), F.lit(n)))


def fetch(facts: DataFrame, key: str, dim: DataFrame, dim_key: str, name: str, n: int) -> DataFrame:
    """(part, key, struct ``name``): the rows of ``dim`` that each part of ``facts`` asks for, once
    a part.  So facts are shuffled once for any number of lookups, and never with what was looked up."""
    asked = dealt(facts.select(_PLACE, F.col(key)), n, key).distinct()
    packed = dim.select(F.col(dim_key).alias(key), F.struct(*dim.columns).alias(name))
    return asked.join(dealt(packed, n, key), key).repartitionById(n, _PLACE)


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with order > customer > nation > region, part, and supplier > nation > region."""
    t = tables(spark, sf_dir)
    nation = lookup(t["nation"], "regionkey", t["region"], "regionkey", "region")
    customer = lookup(t["customer"], "nationkey", nation, "nationkey", "nation")
    supplier = lookup(t["supplier"], "nationkey", nation, "nationkey", "nation")
    order = lookup(t["orders"], "custkey", customer, "custkey", "customer")
    n = parts(spark, f"{sf_dir}/lineitem.parquet", f"{sf_dir}/orders.parquet")
    if not n:
        items = lookup(t["lineitem"], "orderkey", order, "orderkey", "order", keep_key=True)
        items = lookup(items, "partkey", t["part"], "partkey", "part", keep_key=True)
        return lookup(items, "suppkey", supplier, "suppkey", "supplier", keep_key=True)
    facts = placed(t["lineitem"], n, "orderkey")
    heads = placed(order.select("orderkey", F.struct(*order.columns).alias("order")), n, "orderkey").repartitionById(n, _PLACE)
    items = facts.repartitionById(n, _PLACE).join(heads, ["orderkey", _PLACE], "left")
    items = items.join(fetch(facts, "partkey", t["part"], "partkey", "part", n), ["partkey", _PLACE], "left")
    items = items.join(fetch(facts, "suppkey", supplier, "suppkey", "supplier", n), ["suppkey", _PLACE], "left")
    return items.select(*t["lineitem"].columns, "order", "part", "supplier")


def customers(spark: SparkSession, sf_dir: str, orders: list[str] | None = None, items: list[str] | None = None) -> DataFrame:
    """Customers with orders[] and orders[].items[]; without orders the array is null.

    orders, items: the fields that their records are to have, all without; no others are shuffled.
    """
    t = tables(spark, sf_dir)
    n = parts(spark, f"{sf_dir}/lineitem.parquet", f"{sf_dir}/orders.parquet")
    lines, heads = t["lineitem"], t["orders"]
    if items is not None:
        lines = lines.select("orderkey", *[c for c in lines.columns if c in {*items, "linenumber", "partkey", "suppkey"} - {"orderkey"}])
    if orders is not None:
        heads = heads.select("custkey", *[c for c in heads.columns if c in {*orders, "orderkey"} - {"custkey"}])
    grouped = group(dealt(lines, n, "orderkey"), "orderkey", ["linenumber", "partkey", "suppkey"], "items", items)
    by_order = dealt(heads, n, "orderkey").join(grouped, "orderkey", "left")
    by_customer = group(dealt(by_order, n, "custkey"), "custkey", ["orderkey"], "orders", orders and [*orders, "items"])
    return dealt(t["customer"], n, "custkey").join(by_customer, "custkey", "left")
