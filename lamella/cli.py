"""``python -m lamella.cli COMMAND PATH``: schema, meta, custom-types, read, write, stats."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .plans.project import ALL
from .schema import read_text
from .sources.reader import Reader
from .sources.writer import write


def main(args: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    top = argparse.ArgumentParser(prog="lamella")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("schema", "meta", "custom-types", "read", "write", "stats"):
        p = sub.add_parser(name)
        p.add_argument("path")
        if name == "schema":
            p.add_argument("--full", action="store_true")
        if name in ("schema", "meta"):
            p.add_argument("--compact", action="store_true", help="on one line")
        if name == "read":
            p.add_argument("--pretty", action="store_true")
            p.add_argument("--head", type=int)
            p.add_argument("--tail", type=int)
            p.add_argument("--query", default=ALL)
            p.add_argument("--query-file")
            p.add_argument("--sub-schema-in", default="")
        if name == "write":
            p.add_argument("--input", required=True, help="JSON lines")
            p.add_argument("--schema")
            p.add_argument("--schema-file")
            p.add_argument("--metadata", help="JSON")
            p.add_argument("--metadata-file", help="JSON")
            p.add_argument("--compression-thresholds", help='JSON, such as {"deflate": 1.5}')
            p.add_argument("--record-group-length", type=int, default=128 << 20)
            p.add_argument("--data-page-length", type=int, default=256 << 10)
            p.add_argument("--optimize-columns", default="default")
        if name == "stats":
            p.add_argument("--columns", action="store_true")
            p.add_argument("--record-groups", action="store_true")
            p.add_argument("--sort-by")
            p.add_argument("--desc", action="store_true")
    a = top.parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    if a.command == "write":
        text = open(a.schema_file).read() if a.schema_file else a.schema
        write(spark.read.json(a.input), read_text(text), a.path, metadata=json.loads(open(a.metadata_file).read()) if a.metadata_file else json.loads(a.metadata) if a.metadata else None,
              compression_thresholds=json.loads(a.compression_thresholds) if a.compression_thresholds else None, record_group_length=a.record_group_length, data_page_length=a.data_page_length, optimize_columns=a.optimize_columns)
        return 0
    r = Reader.open(spark, a.path)
    if a.command == "schema":
        text = r.schema_text(a.full)
        print(" ".join(text.split()) if a.compact else text, file=out)
    elif a.command == "meta":
        print(json.dumps(r.metadata(), separators=(",", ":")) if a.compact else json.dumps(r.metadata()), file=out)
    elif a.command == "custom-types":
        print(json.dumps(r.custom_types()), file=out)
    elif a.command == "read":
        query = open(a.query_file).read() if a.query_file else a.query
        view = r.read(query, [k for k in a.sub_schema_in.split(".") if k])
        view = view.tail(a.tail) if a.tail is not None else view.head(a.head) if a.head is not None else view
        for row in view.rows():
            print(json.dumps(row, default=str, ensure_ascii=False, indent=2 if a.pretty else None), file=out)
    else:
        found = r.stats()["columns" if a.columns else "record_groups" if a.record_groups else "global"]
        if a.sort_by:
            found = found.orderBy(found[a.sort_by].desc() if a.desc else found[a.sort_by])
        print("\t".join(found.columns), file=out)
        for row in found.toLocalIterator():
            print("\t".join(map(str, row)), file=out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
