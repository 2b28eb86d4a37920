import pytest
from pyspark.sql import types as T

from lamella import Col, CustomType, Map, Req, Set, Types, depict, parse, read_text, unparse
from lamella.schema import as_entries, leaf_paths, levels, to_spark

FORMS = [
    "int", Req("int"), ["int"], ("string",), Set("long"), Map("string", "int"), {"a": "int", "b": ["string"]}, Req({"a": Req(["int"])}),
    Map(Map("int", "int"), ["long"]), Map(["int"], Set("string")), Set(Map("string", "string")), [[["int"]]], {"a": [{"b": Map("keyword", {"c": "uuid"})}]},
]


@pytest.mark.parametrize("form", FORMS, ids=str)
def test_forms_survive_parsing_and_text(form):
    node = parse(form)
    assert unparse(node) == form
    assert parse(read_text(depict(node))) == node


def test_full_text_keeps_encodings():
    node = parse(read_text("{:a #col [int delta deflate] :b #req #col [string incremental]}"))
    assert depict(node, plain=False) == "{:a #col [int delta deflate]\n :b #req #col [string incremental]}"
    assert depict(node) == "{:a int\n :b #req string}"


@pytest.mark.parametrize("form", [
    Req(Req("int")), ["int", "int"], [], {}, "nothing", Col("int", "incremental"), Col("boolean", "delta"), Col("int", "plain", "lzo"), 3, None, {1: "int"},
], ids=str)
def test_bad_schemas(form):
    with pytest.raises(ValueError):
        parse(form)


@pytest.mark.parametrize("text", ["{:a int", "[int", "#{int long}", "{int}", "{string int long}", "int int", "]"])
def test_bad_text(text):
    with pytest.raises(ValueError):
        parse(read_text(text))


def test_both_spellings_of_zig_zag():
    assert parse(Col("int", "zigzag")).encoding == parse(Col("int", "zig-zag")).encoding


def test_levels_of_the_two_document_schema():
    node = parse(read_text("#req {:docid #req long :links {:forward [long] :backward [long]} :name [{:language [{:code #req string :country string}] :url string}]}"))
    assert [len(p) for p, _ in leaf_paths(node)] == [1, 3, 3, 5, 5, 3]
    assert [(r, d) for _, r, d in levels(node)] == [(0, 0), (1, 4), (1, 4), (2, 6), (2, 7), (1, 4)]


def test_spark_types():
    assert to_spark(parse({"a": "inst", "b": Map(Req("string"), ["int"])})) == T.StructType([
        T.StructField("a", T.TimestampType(), metadata={"logical_type": "inst"}), T.StructField("b", T.MapType(T.StringType(), T.ArrayType(T.IntegerType()))),
    ])
    assert as_entries(parse(Map(Map("int", "int"), "int"))) and not as_entries(parse(Map("int", "int")))


def test_custom_type_chains_and_loops():
    types = Types.of(CustomType("foo", "int"), CustomType("bar", "foo"))
    assert types.built_in("bar") == "int" and [t.name for t in types.chain("bar")] == ["bar", "foo"]
    with pytest.raises(ValueError, match="Loop"):
        Types.of(CustomType("a", "b"), CustomType("b", "a"))
    with pytest.raises(ValueError, match="Unknown type"):
        Types.of(CustomType("a", "none"))
    with pytest.raises(ValueError):
        CustomType("a", "int", to_base=3)
