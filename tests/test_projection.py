import pytest
from pyspark.sql import functions as F

from lamella import ALL, Map, MissingField, Reader, Set, Tag, write
from lamella.plans.project import is_empty

SCHEMA = "#req {:docid #req long :links {:forward [long] :backward [long]} :name [{:language [{:code #req string :country string}] :url string}]}"
R1 = dict(docid=10, links=dict(forward=[20, 40, 60], backward=None), name=[
    dict(language=[dict(code="en-us", country="us"), dict(code="en", country=None)], url="http://A"), dict(language=None, url="http://B"), dict(language=[dict(code="en-gb", country="gb")], url=None),
])
R2 = dict(docid=20, links=dict(forward=[80], backward=[10, 30]), name=[dict(language=None, url="http://C")])
SHAPE = "docid long, links struct<forward:array<long>,backward:array<long>>, name array<struct<language:array<struct<code:string,country:string>>,url:string>>"


@pytest.fixture(scope="module")
def paper(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("paper") / "f")
    write(spark.createDataFrame([R1, R2], SHAPE).coalesce(1), SCHEMA, path, metadata={"by": "test"})
    return Reader.open(spark, path)


@pytest.fixture(scope="module")
def ask(paper):
    return lambda *a, **k: list(paper.read(*a, **k).rows())


size = lambda c: F.when(c.isNull(), 0).otherwise(F.size(c))


def bare(x):
    """Null-valued keys are as good as absent."""
    if isinstance(x, dict):
        return {k: bare(v) for k, v in x.items() if v is not None}
    return [bare(e) for e in x] if isinstance(x, list) else x


def test_everything(ask, paper):
    assert ask() == [R1, R2]
    assert ask(SCHEMA) == [R1, R2] and ask(paper.node) == [R1, R2]


def test_two_fields(ask):
    want = [{"docid": 10, "name": [{"language": [{"country": "us"}, None]}, None, {"language": [{"country": "gb"}]}]}, {"docid": 20, "name": [None]}]
    assert ask({"docid": ALL, "name": [{"language": [{"country": ALL}]}]}) == want
    assert ask("{:docid _ :name [{:language [{:country _}]}]}") == want
    assert ask("{:docid long :name [{:language [{:country string}]}]}") == want


@pytest.mark.parametrize("q", [{}, None, {"docid": None}, {"foo": None}, {"name": {}}, {"name": None}, {"name": []}, {"name": [{}]}, {"name": [None]}, {"name": [{"foo": ALL}]}, {"foo": ALL}], ids=str)
def test_nothing_selected(ask, q):
    assert ask(q) == [None, None]


def test_empty_elements():
    assert all(map(is_empty, [None, {}, [], [None], [{}], {"a": {"b": None}}])) and not any(map(is_empty, [ALL, "int", {"a": ALL}, Tag("t", None)]))


def test_missing_fields(ask):
    assert bare(ask({"docid": ALL, "name": [{"foo": ALL}]})) == [{"docid": 10}, {"docid": 20}]
    with pytest.raises(MissingField, match=r"\[:foo\]"):
        ask({"foo": ALL}, missing_fields_as_nil=False)
    with pytest.raises(MissingField, match=r"\[:name nil :foo\]"):
        ask({"name": [{"foo": ALL}]}, missing_fields_as_nil=False)
    with pytest.raises(MissingField):
        ask(sub_schema_in=["nope"], missing_fields_as_nil=False)
    assert ask(sub_schema_in=["nope"]) == [None, None]


def test_sub_schema(ask):
    assert ask(sub_schema_in=["links", "backward"]) == [None, [10, 30]]
    assert ask({"forward": ALL}, ["links"]) == [{"forward": [20, 40, 60]}, {"forward": [80]}]
    with pytest.raises(ValueError, match="repeated"):
        ask(sub_schema_in=["name", "url"])
    with pytest.raises(ValueError, match="column"):
        ask(sub_schema_in=["docid", "x"])


@pytest.mark.parametrize(("q", "error"), [
    ({"docid": "int"}, ValueError), ({"docid": {"a": ALL}}, ValueError), ({"docid": [ALL]}, ValueError), ({"name": Set(ALL)}, ValueError), ({"name": Map(ALL, ALL)}, ValueError),
    ({"name": {"url": ALL}}, ValueError), ({"name": "string"}, ValueError), ({"name": [ALL, ALL]}, TypeError), ({"docid": 3}, TypeError), ({"foo": 3}, TypeError),
], ids=str)
def test_bad_queries(ask, q, error):
    with pytest.raises(error):
        ask(q)


def test_tags(ask):
    assert ask({"docid": ALL, "name": Tag("n", ALL)}, readers={"n": size}) == [{"docid": 10, "name": 3}, {"docid": 20, "name": 1}]
    assert ask({"docid": Tag("inc", ALL)}, readers={"inc": lambda c: c + 1}) == [{"docid": 11}, {"docid": 21}]
    assert ask(Tag("empty", {"foo": ALL}), readers={"empty": lambda c: c.isNull()}) == [True, True]
    assert ask({"docid": ALL, "foo": {"bar": Tag("n", [{"baz": ALL}])}}, readers={"n": lambda c: F.when(c.isNull(), 0)}) == [{"docid": 10, "foo": {"bar": 0}}, {"docid": 20, "foo": {"bar": 0}}]
    with pytest.raises(ValueError, match="No reader function"):
        ask({"docid": Tag("x", ALL)})
    with pytest.raises(ValueError, match="twice"):
        ask({"docid": Tag("x", Tag("x", ALL))}, readers={"x": size})


@pytest.fixture(scope="module")
def roots(spark, tmp_path_factory):
    def make(rows, shape, schema):
        path = str(tmp_path_factory.mktemp("root") / "f")
        write(spark.createDataFrame([(r,) for r in rows], f"value {shape}").coalesce(1), schema, path, root="value")
        return Reader.open(spark, path)

    return make


def test_tag_on_leaf_of_element(roots):
    r = roots([[{"foo": None}, {"foo": 1}], [{"foo": None}], None, [{"foo": 1}]], "array<struct<foo:int>>", "[{:foo int}]")
    assert list(r.read("[{:foo #inc _}]", readers={"inc": lambda c: F.coalesce(c, F.lit(100)) + 1}).rows()) == [[None, {"foo": 2}], [None], None, [{"foo": 2}]]


def test_tag_on_element_sees_null(roots):
    r = roots([[1, None, 2], None, [1, 2], [None]], "array<int>", "[int]")
    assert list(r.read("[#inc _]", readers={"inc": lambda c: F.coalesce(c, F.lit(0)) + 1}).rows()) == [[2, 1, 3], None, [2, 3], [1]]


def test_roots_that_are_no_records(roots):
    assert list(roots([1, None, 3], "int", "int").read().rows()) == [1, None, 3]
    assert list(roots([[1], [], None, [None]], "array<int>", "[int]").read().rows()) == [[1], [], None, [None]]
    r = roots([{"a": 1, "b": 2}, {}, None], "map<string,int>", "{#req string int}")
    assert list(r.read().rows()) == [{"a": 1, "b": 2}, {}, None]
    assert list(r.read([{"val": ALL}]).rows()) == [[{"value": 1}, {"value": 2}], [], None]
    assert list(r.read(Map(Tag("same", ALL), ALL), readers={"same": lambda c: F.lit("k")}).rows()) == [{"k": 2}, {}, None]
    assert sorted(next(iter(roots([["b", "a", "b"]], "array<string>", Set("string")).read(Set(ALL)).rows()))) == ["a", "b"]


def test_collapse_is_recursive(spark, tmp_path):
    df = spark.createDataFrame([(1, ((None,),)), (2, (("x",),))], "id int, a struct<b: struct<c: string>>")
    write(df, "{:id int :a {:b {:c string}}}", str(tmp_path / "f"))
    got = {r["id"]: r["a"] for r in Reader.open(spark, str(tmp_path / "f")).read().rows()}
    assert got == {1: None, 2: {"b": {"c": "x"}}}


def _schema_read(df) -> str:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("ReadSchema: ")[1].split("\n")[0]


def test_only_named_leaves_are_read(paper):
    assert _schema_read(paper.read({"docid": ALL}).df) == "struct<docid:bigint>"
    assert _schema_read(paper.read({"name": [{"url": ALL}]}).df) == "struct<name:array<struct<url:string>>>"
    assert _schema_read(paper.read(sub_schema_in=["links", "forward"]).df) == "struct<links:struct<forward:array<bigint>>>"
    assert _schema_read(paper.read({}).df) == "struct<>"


def test_filters_reach_the_scan(paper):
    plan = paper.read({"docid": ALL}).df.where("docid > 15")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(docid,15)" in plan
