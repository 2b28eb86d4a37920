import json
import random

import duckdb
import pytest

from lamella.llm import chat
from lamella.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize(("value", "text"), [
    ({"b": 1, "a": [True, None, "é\n\"\u001f"]}, '{"a":[true,null,"é\\n\\"\\u001f"],"b":1}'), (1.0, "1"), (1e21, "1e+21"), (1e-7, "1e-7"), (0.000001, "0.000001"), (123456.5, "123456.5"), (-0.0, "0"), (1e20, "100000000000000000000"),
    ({"\U0001f600": 1, "דּ": 2}, '{"\U0001f600":1,"דּ":2}'), (1.5e-10, "1.5e-10"), (1.25e-5, "0.0000125"),
], ids=str)
def test_canonical_json(value, text):
    assert chat.canonical(value) == text and json.loads(text) == value


def test_schemas():
    schema = {"type": "object", "required": ["q"], "additionalProperties": False, "properties": {"q": {"type": "string"}, "n": {"type": ["integer", "null"]}, "xs": {"type": "array", "items": {"enum": [1, 2]}}}}
    assert chat.errors({"q": "x", "n": None, "xs": [1, 2]}, schema) == []
    assert chat.errors({"n": 1.5, "xs": [3], "z": 0}, schema) == ["$.q: missing", "$.z: unknown", "$.n: not integer|null", "$.xs[0]: not in enum"]
    assert chat.errors("abc", {"minLength": 4, "pattern": "a", "title": "t"}) == ["$: keyword pattern is not supported", "$: below minLength"]
    assert chat.errors(5, {"maximum": 4, "const": 6}) == ["$: not const", "$: above maximum"] and chat.errors(5.0, {"const": 5, "minimum": 5}) == []
    assert chat.errors({"n": True, "q": ""}, schema) == ["$.n: not integer|null"]


@pytest.fixture(scope="module")
def linked(spark):
    ref = lambda *ids: json.dumps({"use": [{"$ref": i} for i in ids]})
    calls = [
        (1, 1, "a", "t", ref()), (1, 3, "b", "t", ref("a")), (1, 2, "c", "t", ref("d")), (1, 5, "d", "t", ref("b")), (1, 6, "e", "t", ref("c", "nope")),
        (2, 1, "x", "t", ref("y")), (2, 2, "y", "t", ref("x")), (2, 3, "z", "t", ref("x")), (2, 4, "self", "t", ref("self")),
        (3, 1, "a", "none", "{}"), (3, 2, None, "t", None), (3, 3, "dup", "t", "[1]"), (3, 4, "dup", "t", "{bad"), (3, 4, "dup", "t", "{bad"), (None, 1, "a", "t", '{"k": "%s"}' % ("v" * 50_000)),
    ]
    results = [(1, 4, "a", "late"), (1, 2, "a", "first"), (1, 7, "ghost", "?"), (3, 9, None, "no id"), (2, 5, "x", None), (3, 5, "dup", "r"), (None, 2, "a", "r")]
    c = spark.createDataFrame([(*x, 0) for x in calls], "conv long, turn long, call_id string, name string, arguments string, status int").repartition(3)
    r = spark.createDataFrame(results, "conv long, turn long, call_id string, content string")
    schemas = {"t": {"type": "object"}}
    return c, r, chat.link(c, r, schemas).collect(), schemas


def test_links(linked, spark):
    c, r, rows, schemas = linked
    assert len(rows) == 15 + 1 + 3  # one more result of (1, "a"), and the orphans
    by = {(x["conv"], x["turn"], x["call_id"]): x for x in rows if x["status"] != "orphan" and x["result_no"] in (None, 1)}
    second = next(x for x in rows if x["result_no"] == 2)
    assert (second["call_id"], second["result_turn"], json.loads(second["json"])["result"]) == ("a", 4, "late")
    assert {json.loads(x["json"])["result"] for x in rows if x["status"] == "orphan"} == {"?", "no id", "r"}
    assert (by[1, 1, "a"]["status"], by[1, 1, "a"]["n_results"], by[1, 1, "a"]["result_turn"]) == ("linked", 2, 2)
    assert json.loads(by[1, 1, "a"]["json"]) == {"arguments": {"use": []}, "id": "a", "name": "t", "result": "first"}
    assert by[1, 3, "b"]["status"] == "unanswered" and by[2, 1, "x"]["status"] == "linked" and by[3, 3, "dup"]["status"] == "linked"
    assert sum(x["status"] == "duplicate" for x in rows) == 2 and by[3, 2, None]["status"] == "unanswered"
    assert by[3, 1, "a"]["errors"] == "none: no schema" and by[3, 3, "dup"]["errors"] == "$: not object" and by[3, 4, "dup"]["errors"] == "$: no JSON"
    assert json.loads(by[3, 4, "dup"]["json"])["arguments"] is None
    assert {x["content"] for x in chat.orphans(c, r).collect()} == {"?", "no id", "r"}
    assert chat.link(c.limit(0), r, schemas).count() == r.count() and chat.link(c.limit(0), r.limit(0), schemas).count() == 0 and chat.link(c, r.limit(0), schemas).where("n_results > 0").count() == 0


def brute_order(calls):
    """By the definition: all that a call leads to, and the longest path at its order turn."""
    turn = {c: min(t for d, t, _ in calls if d == c) for c, _, _ in calls}
    refs = {c: {r for d, _, rs in calls if d == c for r in rs if r in turn} for c in turn}
    reach = {c: set(r) for c, r in refs.items()}
    for _ in turn:
        reach = {c: r.union(*(reach[x] for x in r)) for c, r in reach.items()}
    out = {c: None for c in turn}
    fine = [c for c in turn if not any(x in reach[x] for x in reach[c] | {c})]
    late = {c: max([turn[c], *(turn[x] for x in reach[c])]) for c in fine}

    def depth(c):
        return max([0, *(1 + depth(r) for r in refs[c] if late[r] == late[c])])

    return out | {c: (late[c], depth(c)) for c in fine}


def test_order_against_brute_force(spark):
    """In one task and in rounds."""
    rng, calls, want = random.Random(5), [], {}
    for conv in range(40):
        n = rng.randint(1, 9)
        own = [(f"c{rng.randrange(n)}", t, [f"c{rng.randrange(n + 2)}" for _ in range(rng.choice((0, 0, 1, 1, 2)))]) for t in range(n)]
        want |= {(conv, c): v for c, v in brute_order(own).items()}
        assert chat.settle(own) == brute_order(own)
        calls += [(conv, *c) for c in own]
    df = spark.createDataFrame(calls, "conv long, call_id string, turn long, refs array<string>").repartition(3)
    first = {k: min(t for conv, c, t, _ in calls if (conv, c) == k) for k in want}
    for group in (chat.GROUP, 4):
        got = {(r["conv"], r["call_id"]): (r["order_turn"], r["order_depth"], r["cyclic"]) for r in chat.order(df, group).collect()}
        assert got == {k: (*v, False) if v else (first[k], 0, True) for k, v in want.items()}


def test_query_exercises_order_and_checks(spark):
    rows = QUERIES["op5_chat"](spark, "/root/testdata/sf0.01").collect()
    assert {r["status"] for r in rows} >= {"linked", "unanswered", "message"}
    assert any(r["order_depth"] for r in rows) and any(r["cyclic"] for r in rows) and any(r["order_turn"] != r["turn"] for r in rows)
    assert {"$.turn: not integer", "search: no schema"} <= {e for r in rows for e in r["errors"].split("; ")}


def test_order(linked):
    rows = {(x["conv"], x["call_id"]): (x["order_turn"], x["order_depth"], x["cyclic"]) for x in linked[2] if x["status"] != "orphan"}
    assert rows[1, "a"] == (1, 0, False) and rows[1, "b"] == (3, 0, False) and rows[1, "d"] == (5, 0, False)
    assert rows[1, "c"] == (5, 1, False) and rows[1, "e"] == (6, 0, False)  # c waits for d, which comes later
    assert rows[2, "z"][2] and rows[2, "x"][2] and rows[2, "y"][2] and rows[2, "self"][2]


def test_query_against_sql(spark, tiny):
    c = duckdb.connect()
    c.sql(f"create view conversations as select * from '{tiny}/conversations.parquet'")
    df = QUERIES["op5_chat"](spark, tiny)
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, c.sql(f"select {', '.join(df.columns)} from ({ORACLE_SQL['op5_chat']})").fetchall()))
