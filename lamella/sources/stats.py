"""Storage statistics as small DataFrames, aggregated from the rows of ``footers.chunks``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .footers import chunks

_LENGTHS = ("data_header_length", "dictionary_header_length", "repetition_levels_length", "definition_levels_length")


def num_records(spark: SparkSession, path: str) -> int:
    """A count of no columns, which Spark answers from the footers, in tasks."""
    try:
        return spark.read.parquet(path).count()
    except Exception as e:
        if "FAILED_READ_FILE" in str(e) or "CANNOT_READ" in str(e) or "is not a Parquet file" in str(e):
            raise ValueError(f"{path} is not a valid Parquet file") from e
        raise


def _sum(name: str):
    return F.coalesce(F.sum(name), F.lit(0)).cast("long").alias(name)


def global_stats(spark: SparkSession, path: str) -> DataFrame:
    """One row: records, files, row groups, columns and byte counts."""
    summed = ("length", "dictionary_length", *_LENGTHS)
    groups = chunks(spark, path).groupBy("file", "record_group").agg(F.max("num_records").alias("n"), F.count("path").alias("columns"), F.max("file_length").alias("file_length"), *map(_sum, summed))
    files = groups.groupBy("file").agg(F.sum("n").alias("n"), F.count(F.when(F.col("record_group") >= 0, 1)).alias("groups"), F.max("columns").alias("columns"), F.max("file_length").alias("file_length"), *map(_sum, summed))
    one = files.agg(
        _sum("n").name("num_records"), F.count("*").alias("num_files"), _sum("groups").name("num_record_groups"), F.coalesce(F.max("columns"), F.lit(0)).cast("long").alias("num_columns"),
        _sum("file_length"), *map(_sum, summed),
    )
    data, rest = F.col("length") - F.col("dictionary_length"), F.col("file_length") - F.col("length")
    return one.select("num_records", "num_files", "num_record_groups", "num_columns", F.col("file_length").alias("length"), data.alias("data_length"), "dictionary_length", rest.alias("metadata_length"), *_LENGTHS)


def column_stats(spark: SparkSession, path: str) -> DataFrame:
    """One row per leaf: type, encodings, compression, levels, values, pages and byte counts."""
    found = chunks(spark, path).where("record_group >= 0")
    nulls = F.when(F.count("num_nulls") == F.count("*"), F.sum("num_nulls"))
    encodings = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("encodings", ","))))), ",")
    return found.groupBy("path").agg(
        F.first("type").alias("type"), encodings.alias("encodings"), F.array_join(F.array_sort(F.collect_set("compression")), ",").alias("compression"),
        F.max("max_repetition_level").alias("max_repetition_level"), F.max("max_definition_level").alias("max_definition_level"),
        F.sum("num_values").alias("num_values"), (F.sum("num_values") - nulls).alias("num_non_nil_values"), F.sum("num_dictionary_values").alias("num_dictionary_values"),
        F.count("*").alias("num_column_chunks"), F.sum("num_pages").alias("num_pages"), F.sum("length").alias("length"), F.sum("uncompressed_length").alias("uncompressed_length"),
        F.sum("dictionary_length").alias("dictionary_length"), *[F.sum(n).alias(n) for n in _LENGTHS],
    )


def group_stats(spark: SparkSession, path: str) -> DataFrame:
    """One row per row group, numbered in file order."""
    found = chunks(spark, path).where("record_group >= 0").groupBy("file", "record_group")
    each = found.agg(F.max("num_records").alias("num_records"), F.count("*").alias("num_column_chunks"), F.max("group_length").alias("length"), F.sum("dictionary_length").alias("dictionary_length"), *[F.sum(n).alias(n) for n in _LENGTHS])
    order = Window.orderBy("file", "record_group")  # one row per row group
    return each.withColumn("record_group", (F.row_number().over(order) - 1).cast("long")).select("record_group", "file", "num_records", "num_column_chunks", "length", "dictionary_length", *_LENGTHS)
