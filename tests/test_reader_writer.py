import json
import os

import pytest
from pyspark.sql import functions as F

from lamella import ALL, CustomType, FilesReader, Reader, rejects, validate, write
from lamella.schema import Map, Tag
from lamella.cli import main
from lamella.operators import distinct, rows
from lamella.sources import texts


@pytest.fixture(scope="module")
def numbers(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("numbers") / "f")
    df = spark.range(1000).selectExpr("id", "array(id, id + 1) pair", "if(id % 10 = 0, null, id) some").coalesce(1)
    write(df, "{:id #req long :pair [long] :some long}", path, record_group_length=4096, data_page_length=1024)
    return Reader.open(spark, path)


def test_index_runs_on_across_row_groups(numbers):
    assert numbers.stats()["record_groups"].count() >= 1
    assert [r["id"] for r in numbers.read({"id": ALL}).sample(lambda i: i % 2 == 1).rows()] == list(range(1, 1000, 2))


def test_sample_index_order_rules(numbers):
    v = numbers.read({"id": ALL})
    assert [x for x in v.sample(lambda i: i > 996).index_by(lambda i, c: i * 1000 + c("id")).rows()] == [997997, 998998, 999999]
    with pytest.raises(ValueError):
        v.sample(lambda i: i > 1).sample(lambda i: i > 1)
    with pytest.raises(ValueError):
        v.eduction(rows.filter_(F.col("id") > 1)).sample(lambda i: i > 1)
    with pytest.raises(ValueError):
        v.index_by(lambda i, c: i).index_by(lambda i, c: i)


def test_head_tail_count_first(numbers):
    v = numbers.read({"id": ALL})
    assert v.count() == 1000 and v.first() == {"id": 0} and v.head(3).count() == 3
    assert [r["id"] for r in v.tail(3).rows()] == [997, 998, 999]


def test_eductions(numbers):
    v = numbers.read()
    assert v.eduction(rows.cat("pair")).df.agg(F.sum("value")).first()[0] == sum(2 * i + 1 for i in range(1000))
    assert v.eduction(rows.keep(F.col("some")), rows.map_(F.col("value") + 1)).count() == 900
    assert v.eduction(rows.filter_(F.lit(False))).count() == 0
    assert v.eduction(rows.take(7)).count() == 7
    assert v.eduction(rows.map_(F.col("id") % 3), rows.frequencies()).df.count() == 3


def test_folds(numbers):
    v = numbers.read({"id": ALL})
    assert v.reduce(lambda a, r: a + r["id"], 10) == 10 + sum(range(1000))
    assert v.eduction(rows.map_(F.col("id"))).reduce(lambda a, b: a + b) == sum(range(1000))
    assert v.eduction(rows.filter_(F.lit(False))).reduce(lambda *a: "none" if not a else a) == "none"
    joined = v.fold(lambda *s: [x for p in s for x in p], lambda s, r: [*s, int(r["id"])])
    assert joined == list(range(1000))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """1,000 records in order, in seven part files of uneven size."""
    path = str(tmp_path_factory.mktemp("parts") / "f")
    write(spark.range(0, 1000, 1, 7).selectExpr("id", "id % 10 kind").where("id < 150 or id > 160"), "{:id #req long :kind long}", path, record_group_length=1024)
    return Reader.open(spark, path)


def test_positions_run_on_through_a_folder(folder):
    ids = [i for i in range(1000) if i < 150 or i > 160]
    v = folder.read({"id": ALL})
    assert [r["id"] for r in v.rows()] == ids and v.first() == {"id": 0} and folder.num_records() == len(ids)
    assert sorted((r["index"], r["id"]) for r in v.with_index().collect()) == list(enumerate(ids))
    assert [r["id"] for r in v.sample(lambda i: i < 5).rows()] == ids[:5]
    assert [r["id"] for r in v.tail(400).rows()] == ids[-400:] and [r["id"] for r in v.head(300).rows()] == ids[:300]
    assert v.tail(5000).count() == v.head(5000).count() == len(ids) and v.head(0).count() == 0
    assert [r["id"] for r in v.sample(lambda i: i % 2 == 1).head(3).rows()] == ids[1:7:2]
    assert list(v.index_by(lambda i, c: i * 1000 + c("id")).rows()) == [i * 1000 + x for i, x in enumerate(ids)]
    assert v.reduce(lambda a, r: [*a, r["id"]], []) == ids
    join = lambda *s: [x for p in s for x in p]
    assert v.fold(join, lambda s, r: [*s, int(r["id"])]) == ids
    kept = v.eduction(rows.filter_(F.col("id") % 3 == 0)).cache()
    assert kept.fold(join, lambda s, r: [*s, int(r["id"])]) == [i for i in ids if i % 3 == 0] == kept.reduce(lambda a, r: [*a, r["id"]], [])
    with pytest.raises(ValueError, match="shuffled"):
        folder.read().eduction(lambda df: df.repartition(4, "kind").sortWithinPartitions("id")).fold(join, lambda s, r: [*s, int(r["id"])])


def test_reduce_runs_in_tasks(folder, monkeypatch):
    """Rows don't pass through the driver; a large state makes it stream the rest."""
    ids = [i for i in range(1000) if i < 150 or i > 160]
    v = folder.read({"id": ALL})
    assert os.getpid() not in v.reduce(lambda a, r: a | {os.getpid()}, set())
    join = lambda a, b: (a if isinstance(a, list) else [a]) + [b]
    for limit in (1 << 20, 1000, 0):
        monkeypatch.setattr("lamella.operators.fold.STATE_BYTES", limit)
        assert v.reduce(lambda a, r: [*a, r["id"]], []) == ids
        assert v.eduction(rows.map_(F.col("id"))).reduce(join) == ids
        assert v.eduction(rows.filter_(F.col("id") == 700)).reduce(lambda a, b: 1 / 0) == {"id": 700}
        assert v.eduction(rows.filter_(F.col("id") > 600)).reduce(lambda a, r: a * 31 % 1009 + r["id"], 7) == _chained(i for i in ids if i > 600)


def _chained(ids):
    state = 7
    for i in ids:
        state = state * 31 % 1009 + i
    return state


def test_positions_with_more_part_files_than_are_broadcast(folder, monkeypatch):
    monkeypatch.setattr("lamella.sources.reader.PARTS_BROADCAST", 2)
    assert [r["id"] for r in folder.read({"id": ALL}).tail(3).rows()] == [997, 998, 999]


def test_encodings_reach_the_file(spark, tmp_path):
    df = spark.range(5000).selectExpr("id a", "id b", "concat('user-', lpad(id, 8, '0')) c", "id % 7 d", "concat('x', id % 3) e").coalesce(1)
    schema = "{:a #req #col [long delta] :b long :c #col [string incremental] :d #col [long dictionary] :e string}"
    found = {}
    for optimize in ("all", "default", "none"):
        path = str(tmp_path / optimize)
        write(df, schema, path, optimize_columns=optimize)
        r = Reader.open(spark, path)
        found[optimize] = {x["path"]: x for x in r.stats()["columns"].collect()}
        assert r.read().df.exceptAll(df).count() == 0 and r.num_records() == 5000
    default, none, every = found["default"], found["none"], found["all"]
    assert "DELTA_BINARY_PACKED" in default["a"]["encodings"] and default["a"]["num_dictionary_values"] == 0
    assert "DELTA_BYTE_ARRAY" in default["c"]["encodings"] and default["e"]["num_dictionary_values"] == 3
    assert none["d"]["num_dictionary_values"] == 7 and none["e"]["num_dictionary_values"] == 0
    assert every["a"]["num_dictionary_values"] > 0 or "DELTA_BINARY_PACKED" in every["a"]["encodings"]
    one = default["e"]
    assert one["num_pages"] >= 2 and one["definition_levels_length"] > 0 == one["repetition_levels_length"] and 0 < one["data_header_length"] < one["length"] and one["dictionary_header_length"] > 0


def test_compression_ratio_decides(spark, tmp_path):
    import os

    same, noise = spark.range(20_000).selectExpr("'the same text' s"), spark.createDataFrame([(os.urandom(64).hex(),) for _ in range(2000)], "s string")
    for df, least, want in ((same, 1.5, "GZIP"), (noise, 1000.0, "UNCOMPRESSED"), (same, None, "UNCOMPRESSED")):
        path = str(tmp_path / f"{want}{least}")
        write(df, "{:s string}", path, compression_thresholds={"deflate": least} if least else {}, optimize_columns="none")
        r = Reader.open(spark, path)
        assert {x["compression"] for x in r.stats()["columns"].collect()} == {want} and r.num_records() == df.count()


def test_last_of_the_keys_that_meet_wins(spark, tmp_path):
    path = str(tmp_path / "f")
    write(spark.sql("select map('ab', 1, 'ac', 2, 'b', 3, 'ad', 4) m"), "{:m {string int}}", path)
    view = Reader.open(spark, path).read({"m": Map(Tag("first", ALL), ALL)}, readers={"first": lambda c: F.substring(c, 1, 1)})
    assert next(iter(view.rows()))["m"] == {"a": 4, "b": 3}


def test_several_files(spark, tmp_path):
    paths = [str(tmp_path / n) for n in "ba"]
    for k, p in enumerate(paths):
        write(spark.createDataFrame([(10 * k + i,) for i in range(3)], "x int").coalesce(1), "{:x int :y string}" if k else "{:x int}", p)
    v = FilesReader.open(spark, paths).read({"x": ALL, "y": "string"})
    assert [r["x"] for r in v.rows()] == [0, 1, 2, 10, 11, 12]
    assert [r["x"] for r in v.sample(lambda i: i == 1).rows()] == [1, 11]
    assert [r["x"] for r in v.tail(4).rows()] == [2, 10, 11, 12]


def test_round_trip_of_every_type(spark, tmp_path):
    path = str(tmp_path / "f")
    df = spark.sql("""select true b, 1 i, 2L l, 1.5f f, 2.5D d, X'0102' y, array(1, 255) z, timestamp'2020-01-01 00:00:00.123456' t, '12345678-1234-1234-1234-1234567890AB' u, 'q' c,
      '123' big, 1.25BD dec, 7 r, ':k' k, 's' s, map('a', array(1)) m, array('x', 'x') st""")
    schema = "{:b boolean :i int :l long :f float :d double :y byte-array :z byte-array :t inst :u uuid :c char :big bigint :dec bigdec :r ratio :k keyword :s symbol :m {string [int]} :st #{string}}"
    write(df, schema, path)
    r = Reader.open(spark, path)
    got = next(iter(r.read().rows()))
    assert bytes(got["z"]) == b"\x01\xff" and got["t"].microsecond == 123000 and got["u"].endswith("ab") and got["big"] == 123 and got["r"]["den"] == 1 and got["st"] == ["x"]
    assert r.schema_text().replace("\n", "").replace("  ", " ").startswith("{:b boolean")


@pytest.mark.parametrize(("value", "kind", "ok"), [
    ("1", "int", True), ("1.9D", "int", True), ("'1'", "int", False), ("3000000000", "int", False), ("true", "int", False), ("1", "string", True), ("array(1)", "string", True), ("1", "keyword", False),
    ("'a'", "char", True), ("'ab'", "char", False), ("65", "char", True), ("70000", "char", False), ("'x'", "uuid", False), ("'12'", "bigint", True), ("'1x'", "bigint", False), ("1", "inst", False),
    ("array(1, 300)", "byte-array", False), ("'a'", "byte-array", False), ("0", "boolean", True), ("1e300D", "float", True), ("double('nan')", "int", False),
])
def test_coercions(spark, value, kind, ok):
    row = validate(spark.sql(f"select {value} v"), f"{{:v {kind}}}").first()
    assert (row["_errors"] == []) is ok and (not ok or row["v"] is not None)


def test_required_only_below_a_present_parent(spark):
    df = spark.createDataFrame([(1, None), (2, (None, None)), (3, ("x", [])), (4, ("x", [(None,), ("y",)]))], "id int, a struct<b: string, c: array<struct<d: string>>>")
    found = {r["id"]: r["_errors"] for r in validate(df, "{:id int :a {:b #req string :c #req [{:d #req string}]}}").collect()}
    assert found[1] == [] and found[3] == []
    assert found[2] == ["Required value at path '[:a :b]' is missing", "Required collection at path '[:a :c]' is missing"]
    assert found[4] == ["Required value at path '[:a :c nil :d]' is missing"]


def test_invalid_records_fail_or_are_diverted(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "id long, extra string")
    with pytest.raises(Exception, match="Failed to write record"):
        write(df, "{:id #req long}", str(tmp_path / "f"))
    bad = write(df, "{:id #req long}", str(tmp_path / "g"), invalid="reject")
    assert [(r["extra"], r["_errors"]) for r in bad.collect()] == [("b", ["Required value at path '[:id]' is missing"])]
    assert sorted(r["id"] for r in Reader.open(spark, str(tmp_path / "g")).read().rows()) == [1, 3]
    assert rejects(df, "{:id long}").count() == 0
    with pytest.raises(ValueError, match="extra"):
        write(df, "{:id long}", str(tmp_path / "h"), ignore_extra_fields=False)
    with pytest.raises(Exception, match="record"):
        write(spark.createDataFrame([(None,)], "x int"), "#req {:x int}", str(tmp_path / "i"))


@pytest.mark.parametrize("options", [
    {"record_group_length": -1}, {"data_page_length": "x"}, {"optimize_columns": "some"}, {"compression_thresholds": 1}, {"compression_thresholds": {"lzo": 1}}, {"compression_thresholds": {"deflate": -1}},
    {"invalid": "drop"}, {"ignore_extra_fields": 1}, {"custom_types": ("x",)}, {"nothing": 1},
], ids=str)
def test_bad_write_options(spark, options, tmp_path):
    with pytest.raises(ValueError):
        write(spark.range(1), "{:id long}", str(tmp_path / "f"), **options)


def test_bad_read_options(numbers, spark):
    for bad in ({"x": 1}, {"sub_schema_in": "id"}, {"missing_fields_as_nil": 1}, {"readers": {"a": 1}}):
        with pytest.raises(ValueError):
            numbers.read(**bad)
    with pytest.raises(ValueError):
        Reader.open(spark, numbers.path, nothing=1)


def test_custom_types(spark, tmp_path):
    path = str(tmp_path / "f")
    day = CustomType("day", "long", to_base=lambda c: F.datediff(c, F.lit("1970-01-01").cast("date")), from_base=lambda c: F.date_from_unix_date(c.cast("int")))
    write(spark.sql("select date'1970-01-11' d"), "{:d day}", path, custom_types=(day,))
    assert Reader.open(spark, path).read().first() == {"d": 10}
    assert Reader.open(spark, path).custom_types() == {"day": "long"}
    assert str(Reader.open(spark, path, [day]).read({"d": "day"}).first()["d"]) == "1970-01-11"
    with pytest.raises(ValueError, match="Unknown type"):
        write(spark.sql("select 1 d"), "{:d day}", path)


def test_metadata_stats_and_empty_files(spark, tmp_path):
    path = str(tmp_path / "f")
    write(spark.createDataFrame([], "a int, b string"), "{:a int :b string}", path, metadata={"k": [1, None]})
    r = Reader.open(spark, path)
    assert r.metadata() == {"k": [1, None]} and r.read().count() == 0 and r.num_records() == 0
    assert r.stats()["global"].first()["data_length"] == 0
    with pytest.raises(FileNotFoundError):
        Reader.open(spark, str(tmp_path / "none"))
    (tmp_path / "bad.parquet").write_bytes(b"no such thing")
    with pytest.raises(ValueError, match="not a valid"):
        Reader.open(spark, str(tmp_path / "bad.parquet")).num_records()


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.tbl").write_text("1|x|\n2|y|\n")
    assert texts.delimited(spark, str(tmp_path / "a.tbl"), {"a": "int", "b": "string"}).count() == 2
    (tmp_path / "a.json").write_text('{"a": 1, "b": {"c": [1]}}\n')
    assert texts.json_lines(spark, str(tmp_path / "a.json"), {"a": "int", "b": {"c": ["int"]}}).first()["b"]["c"] == [1]
    (tmp_path / "a.edn").write_text('{:a 1 :b ["x" nil] :m {"k" 2}}\n{:a nil}\n')
    got = texts.edn_lines(spark, str(tmp_path / "a.edn"), {"a": "int", "b": ["string"]}).collect()
    assert (got[0]["a"], got[0]["b"], got[1]["a"]) == (1, ["x", None], None)


def test_distinct_values(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "x string")
    got = distinct.apply_distinct(df, "x", lambda s: "nil" if s is None else s * 2, "string")
    assert sorted(r["x"] for r in got.collect()) == ["aa", "aa", "bb", "nil"]


def test_command_line(spark, numbers, tmp_path, capsys):
    import sys

    (tmp_path / "in.json").write_text('{"a": 1}\n{"a": 2}\n')
    out = str(tmp_path / "f")
    assert main(["write", out, "--input", str(tmp_path / "in.json"), "--schema", "{:a #req long}", "--metadata", '{"x": 1}'], spark) == 0
    for args, want in ((["schema", out], "{:a #req long}"), (["meta", out], '{"x": 1}'), (["custom-types", out], "{}"), (["read", out, "--tail", "1", "--query", "{:a _}"], '{"a": 2}')):
        main(args, spark, sys.stdout)
        assert capsys.readouterr().out.strip() == want
    (tmp_path / "meta.json").write_text('{"from": "a file"}')
    main(["write", out, "--input", str(tmp_path / "in.json"), "--schema", "{:a #req long}", "--metadata-file", str(tmp_path / "meta.json"), "--compression-thresholds", '{"deflate": 0.01}'], spark)
    for args, want in ((["meta", out, "--compact"], '{"from":"a file"}'), (["schema", out, "--compact"], "{:a #req long}"), (["read", out, "--head", "1", "--pretty"], '{\n  "a": 1\n}')):
        main(args, spark, sys.stdout)
        assert capsys.readouterr().out.strip() == want
    main(["stats", out, "--columns", "--sort-by", "path", "--desc"], spark, sys.stdout)
    assert json.dumps("INT64") not in capsys.readouterr().out
