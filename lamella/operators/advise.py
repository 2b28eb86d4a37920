"""Storage advice: one aggregate over the leaves, and the encoding that suits each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import varint_size, zig_zag

_WIDTH = {"int": 4, "bigint": 8, "float": 4, "double": 8, "boolean": 1, "smallint": 2, "tinyint": 1, "timestamp": 8, "date": 4}


def advise(df: DataFrame, page_bytes: int = 256 << 10) -> DataFrame:
    """One row per top-level leaf: values, distinct values, and the encoding of least estimated size.

    A dictionary has to fit a page.  Nested leaves are advised after a projection.
    """
    leaves = [f for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    aggs = []
    for f in leaves:
        c = F.col(f"`{f.name}`")
        size = F.length(c) + 4 if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.lit(_WIDTH.get(f.dataType.simpleString(), 8))
        whole = isinstance(f.dataType, (T.IntegerType, T.LongType))
        aggs.append(F.struct(
            F.count(c).alias("n"), F.approx_count_distinct(c).alias("d"), F.avg(size).alias("w"),
            (F.avg(varint_size(zig_zag(c))) if whole else F.lit(None).cast("double")).alias("v"), (F.min(c) >= 0 if whole else F.lit(None).cast("boolean")).alias("p"),
        ).alias(f.name))
    found = df.agg(*aggs).first()  # one row
    rows = []
    for f in leaves:
        s = found[f.name]
        n, d, w = s["n"], max(1, s["d"]), s["w"] or 0
        costs = {"delta-length" if isinstance(f.dataType, (T.StringType, T.BinaryType)) else "plain": n * w}
        if s["v"] is not None:
            costs["vlq" if s["p"] else "zig-zag"] = n * s["v"]
        if d * w <= page_bytes:
            costs["dictionary"] = d * w + n * max(1, (d - 1).bit_length()) / 8
        best = min(costs, key=lambda k: (costs[k], k))
        rows.append((f.name, f.dataType.simpleString(), n, d, best, float(costs[best])))
    return df.sparkSession.createDataFrame(rows, "path string, type string, num_values long, num_distinct long, encoding string, estimated_length double")
