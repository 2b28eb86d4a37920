"""Small files and footers through Hadoop's file systems, so that any store Spark reads will do."""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import SparkSession

#: Beside the data of a written folder; Spark skips names that begin with an underscore.
SIDECAR = "_lamella.json"


def _path(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def sidecar(spark: SparkSession, path: str) -> dict:
    at = f"{path}/{SIDECAR}"
    return json.loads(read_text(spark, at)) if exists(spark, at) else {}


def data_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, length) of the Parquet files of a file or folder, in name order."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    if not fs.getFileStatus(p).isDirectory():
        return [(path, fs.getFileStatus(p).getLen())]
    found, it = [], fs.listFiles(p, True)
    while it.hasNext():
        status = it.next()
        name = status.getPath().getName()
        if not name.startswith(("_", ".")):
            found.append((status.getPath().toString(), status.getLen()))
    return sorted(found)


def footers(spark: SparkSession, path: str) -> list[dict]:
    """Per file: path, length and row groups with their column chunks, from the footers alone."""
    out, jvm = [], spark._jvm
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader
    for name, length in data_files(spark, path):
        source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(name), spark._jsc.hadoopConfiguration())
        try:
            opened = reader.open(source)
        except Exception as e:
            raise ValueError(f"{name} is not a valid Parquet file") from e
        try:
            meta, groups, schema = opened.getFooter(), [], {}
            for d in meta.getFileMetaData().getSchema().getColumns():
                schema[".".join(d.getPath())] = (d.getMaxDefinitionLevel(), d.getMaxRepetitionLevel(), d.getPrimitiveType().getPrimitiveTypeName().toString())
            for block in meta.getBlocks():
                chunks = []
                for c in block.getColumns():
                    stats = c.getStatistics()
                    column = ".".join(c.getPath().toArray())
                    definition, repetition, kind = schema[column]
                    chunks.append({
                        "path": column, "type": kind, "max_definition_level": definition, "max_repetition_level": repetition,
                        "encodings": ",".join(sorted(str(e) for e in c.getEncodings())), "compression": c.getCodec().toString(),
                        "num_values": c.getValueCount(), "num_nulls": stats.getNumNulls() if stats is not None and stats.isNumNullsSet() else None,
                        "data_length": c.getTotalSize(), "uncompressed_length": c.getTotalUncompressedSize(),
                        "dictionary_length": max(0, c.getFirstDataPageOffset() - c.getDictionaryPageOffset()) if c.getDictionaryPageOffset() > 0 else 0,
                    })
                groups.append({"num_records": block.getRowCount(), "length": block.getCompressedSize(), "columns": chunks})
            out.append({"path": name, "length": length, "groups": groups})
        finally:
            opened.close()
    return out


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``; a local master may do with a temporary one."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="lamella-"))
    return sc.getCheckpointDir()
