"""Python functions once per distinct value."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def apply_distinct(df: DataFrame, column: str, f: Callable, returns: str | T.DataType, alias: str | None = None) -> DataFrame:
    """``df`` with ``alias`` = f(column), f called once per distinct value, null included.

    Worth it where values repeat: the column is reduced to its distinct values,
    the function runs over those in Arrow batches, and the results join back.
    Spark chooses the join from the sizes that the shuffle measures.
    """
    kind = df.schema[column].dataType
    result = returns if isinstance(returns, str) else returns.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            keys = pdf["_key"].astype(object).where(pdf["_key"].notna(), None)
            yield pd.DataFrame({"_key": pdf["_key"], "_result": [f(x) for x in keys]})

    distinct = df.select(F.col(column).alias("_key")).distinct()
    made = distinct.mapInPandas(run, f"_key {kind.simpleString()}, _result {result}")
    joined = df.join(made, df[column].eqNullSafe(made["_key"]), "left")
    return joined.withColumn(alias or column, F.col("_result")).drop("_key", "_result")
