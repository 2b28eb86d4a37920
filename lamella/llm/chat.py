"""Chat formatting: tool calls and their results, linked, ordered, checked and serialised.

Calls and results meet in a hash join on (conversation, call id).  Arguments are
JSON; each is checked against the schema of its tool and written in canonical
form (RFC 8785: sorted keys, no blanks, shortest numbers).  A call may refer to
others by ``{"$ref": id}``.  Its order key is the latest turn among itself and
all that it refers to, directly or not, and its depth at that turn, so that
sorting by it puts every call after its references; a call that leads to a
cycle can't be ordered and keeps its own turn.

The calls of a conversation are ordered in one task by Kahn's algorithm, on ids,
turns and references alone.  A conversation of more than ``GROUP`` calls is too
large for a task: its calls are settled in rounds over the whole table.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Calls of one conversation that a task holds, some 500 bytes each.
GROUP = 250_000
#: Keywords of a schema that are checked, and those that say nothing about a value.
KEYWORDS = {"type", "enum", "const", "required", "properties", "additionalProperties", "items", "minimum", "maximum", "minLength", "maxLength"}
REMARKS = {"title", "description", "default", "examples", "$schema", "$id", "$comment"}
_TYPES = {"string": str, "boolean": bool, "array": list, "object": dict, "null": type(None)}


def number(x: int | float) -> str:
    """A number as ECMAScript writes it."""
    if isinstance(x, int):
        return str(x)
    if not math.isfinite(x):
        raise ValueError("no JSON number")
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    text = repr(x)
    if "e" not in text:
        return text
    digits, power = text.split("e")
    if -7 < int(power) < 0:
        return f"{x:.{len(digits.replace('.', '').replace('-', '')) - 1 - int(power)}f}"
    return f"{digits.removesuffix('.0')}e{'+' if int(power) > 0 else '-'}{abs(int(power))}"


def canonical(value) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(k)}:{canonical(v)}" for k, v in sorted(value.items(), key=lambda x: x[0].encode("utf-16-be", "surrogatepass"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, bool) or value is None:
        return json.dumps(value)
    return json.dumps(value, ensure_ascii=False) if isinstance(value, str) else number(value)


def errors(value, schema: dict, path: str = "$") -> list[str]:
    """What a value violates of ``KEYWORDS``; a keyword that is not known is a violation of its own."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds or []

    def fits(kind):
        if kind in ("integer", "number"):
            return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or value == int(value))
        return isinstance(value, _TYPES[kind])

    if kinds and not any(map(fits, kinds)):
        return [f"{path}: not {'|'.join(kinds)}"]
    out = [f"{path}: keyword {k} is not supported" for k in sorted(schema.keys() - KEYWORDS - REMARKS)]
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        out.append(f"{path}: not const")
    number_ = isinstance(value, (int, float)) and not isinstance(value, bool)
    size = value if number_ else len(value) if isinstance(value, str) else None
    low, high = ("minimum", "maximum") if number_ else ("minLength", "maxLength")
    if size is not None:
        out += [f"{path}: below {low}"] * (low in schema and size < schema[low]) + [f"{path}: above {high}"] * (high in schema and size > schema[high])
    out += [f"{path}: not in enum"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        out += [f"{path}.{k}: unknown" for k in sorted(value) if k not in known and schema.get("additionalProperties") is False]
        for k in sorted(known):
            if k in value:
                out += errors(value[k], known[k], f"{path}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += errors(x, schema["items"], f"{path}[{i}]")
    return out


def references(value) -> list[str]:
    if isinstance(value, dict):
        if isinstance(value.get("$ref"), str) and len(value) == 1:
            return [value["$ref"]]
        value = list(value.values())
    return sorted({r for x in value for r in references(x)}) if isinstance(value, list) else []


def check(name: str | None, arguments: str | None, schemas: dict) -> tuple[str | None, list[str], list[str]]:
    """Canonical arguments (null if no JSON object), references and errors."""
    try:
        value = json.loads(arguments or "{}")
        text = canonical(value)
        text.encode()
    except (ValueError, RecursionError):
        return None, [], ["$: no JSON"]
    if not isinstance(value, dict):
        return None, [], ["$: not object"]
    return text, references(value), errors(value, schemas[name]) if name in schemas else [f"{name}: no schema"]


def _check(batches: Iterator[pa.RecordBatch], schemas: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [check(n, a, schemas) for n, a in zip(batch.column("name").to_pylist(), batch.column("arguments").to_pylist())]
        rest = ["conv", "turn", "call_id", "name"]
        text, refs, wrong = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(text, pa.string()), pa.array(refs, pa.list_(pa.string())), pa.array(wrong, pa.list_(pa.string()))], [*rest, "canonical", "refs", "errors"])


def _json(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = [batch.column(n).to_pylist() for n in ("status", "call_id", "name", "canonical", "content")]
        lines = []
        for status, i, n, a, c in zip(*cols):
            if status == "message":
                lines.append(f'{{"content":{canonical(c)},"role":{canonical(n)}}}')
            elif status == "orphan":
                lines.append(f'{{"id":{canonical(i)},"result":{canonical(c)}}}')
            else:
                lines.append(f'{{"arguments":{a or "null"},"id":{canonical(i)},"name":{canonical(n)},"result":{canonical(c)}}}')
        rest = [n for n in batch.schema.names if n not in ("canonical", "content", "name")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(lines, pa.string())], [*rest, "json"])


def settle(calls: list[tuple]) -> dict:
    """call id to (order_turn, order_depth), or None if it leads to a cycle; calls: (call id, turn, references)."""
    turn, refs, users, state = {}, defaultdict(set), defaultdict(list), {}
    for c, t, r in calls:
        turn[c] = t if c not in turn else min(turn[c], t, key=lambda x: (x is not None, x))
        refs[c].update(r or ())
    open_ = {}
    for c in turn:
        known = [r for r in refs[c] if r in turn]
        open_[c] = len(known)
        for r in known:
            users[r].append(c)
    ready = [c for c in turn if not open_[c]]
    low = lambda k: (k[0] is not None, *k)
    while ready:
        c = ready.pop()
        best = (turn[c], 0)
        for r in refs[c]:
            if r in turn:
                k, d = state[r]
                best = max(best, (k, d + 1), key=low)
        state[c] = best
        for u in users[c]:
            open_[u] -= 1
            if not open_[u]:
                ready.append(u)
    return {c: state.get(c) for c in turn}


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation in; one row per conversation and call id out."""
    held, rows = None, []

    def out():
        found = settle([(c, t, r) for c, t, r in rows])
        return pa.RecordBatch.from_arrays(
            [pa.array([held[0]] * len(found), kinds[0]), pa.array(list(found), pa.string()), pa.array([f and f[0] for f in found.values()], kinds[1]), pa.array([f and f[1] for f in found.values()], pa.int64()), pa.array([f is None for f in found.values()])],
            ["conv", "call_id", "k", "d", "cyclic"],
        )

    for batch in batches:
        kinds = [batch.column("conv").type, batch.column("turn").type]
        for conv, *row in zip(*(batch.column(n).to_pylist() for n in ("conv", "call_id", "turn", "refs"))):
            if held is not None and conv != held[0]:
                yield out()
                rows = []
            held = (conv,)
            rows.append(row)
    if rows:
        yield out()


def order(calls: DataFrame, group: int = GROUP) -> DataFrame:
    """conv, call_id, order_turn, order_depth, cyclic for a table conv, call_id, turn, refs without null ids."""
    kinds = dict(calls.dtypes)
    shape = f"conv {kinds['conv']}, call_id string, k {kinds['turn']}, d long, cyclic boolean"
    counts = calls.groupBy("conv").agg(F.count("*").alias("n"))
    large = cut(counts.where(F.col("n") > group).select(F.col("conv").alias("large")))
    # few conversations are that large; Spark broadcasts them if they are few indeed
    small = calls.join(large, F.col("conv").eqNullSafe(F.col("large")), "left_anti")
    settled = small.repartition("conv").sortWithinPartitions("conv").mapInArrow(_settle, shape)
    if not large.isEmpty():
        settled = settled.unionByName(_rounds(calls.join(large, F.col("conv").eqNullSafe(F.col("large")), "left_semi")))
    turns = calls.groupBy("conv", "call_id").agg(F.min("turn").alias("turn"))
    found = turns.join(settled.withColumnsRenamed({"conv": "c", "call_id": "i"}), F.col("conv").eqNullSafe(F.col("c")) & (F.col("call_id") == F.col("i")))
    return found.select("conv", "call_id", F.when(F.col("cyclic"), F.col("turn")).otherwise(F.col("k")).alias("order_turn"), F.coalesce("d", F.lit(0).cast("long")).alias("order_depth"), "cyclic")


def _rounds(calls: DataFrame) -> DataFrame:
    """As ``settle``: in each round the calls are settled whose references all are."""
    nodes = cut(calls.groupBy("conv", "call_id").agg(F.min("turn").alias("turn")))
    edges = calls.select("conv", "call_id", F.explode("refs").alias("ref")).distinct()
    edges = cut(edges.join(nodes.select("conv", F.col("call_id").alias("ref")), ["conv", "ref"]))
    wanted = edges.groupBy("conv", "call_id").agg(F.count("*").alias("wanted"))
    left = cut(nodes.join(wanted, ["conv", "call_id"], "left"))
    done = cut(left.where("wanted is null").select("conv", "call_id", F.col("turn").alias("k"), F.lit(0).cast("long").alias("d")))
    left = left.where("wanted is not null")
    while True:
        via = edges.join(done.select("conv", F.col("call_id").alias("ref"), "k", "d"), ["conv", "ref"])
        best = via.groupBy("conv", "call_id").agg(F.count("*").alias("have"), F.max(F.struct("k", (F.col("d") + 1).alias("d"))).alias("b"))
        now = left.join(best, ["conv", "call_id"]).where("have = wanted").select("conv", "call_id", F.greatest(F.struct(F.col("turn").alias("k"), F.lit(0).cast("long").alias("d")), "b").alias("b"))
        now = cut(now.select("conv", "call_id", "b.k", "b.d"))
        if now.isEmpty():
            break
        left = cut(left.join(now.select("conv", "call_id"), ["conv", "call_id"], "left_anti"))
        done = cut(done.unionByName(now))
    return done.withColumn("cyclic", F.lit(False)).unionByName(left.select("conv", "call_id", F.lit(None).cast(dict(left.dtypes)["turn"]).alias("k"), F.lit(None).cast("long").alias("d"), F.lit(True).alias("cyclic")))


def link(calls: DataFrame, results: DataFrame, schemas: dict, others: DataFrame | None = None, group: int = GROUP) -> DataFrame:
    """Rows conv, turn, call_id, status, n_results, result_no, result_turn, errors, order_turn, order_depth, cyclic, json.

    calls: conv, turn, call_id, name, arguments (JSON text; null means none);
    results: conv, turn, call_id, content; others: conv, turn, role, content.

    A call has one row for each of its results (numbered by turn, then content),
    or one without; status is ``linked``, ``unanswered`` or ``duplicate`` (an
    earlier call, by turn, name and arguments, has the id; it takes no result).
    A result whose call does not exist is a row ``orphan``, each of the others a
    row ``message``.  A null id or conversation links to nothing.  Arguments that are no JSON
    object become null with an error; a tool without schema is an error; a
    reference to no call is left out of the order.  Repeated rows are kept;
    empty tables give no row.
    """
    rows = calls.select("conv", "turn", "call_id", "name", "arguments")
    kinds = dict(rows.dtypes)
    head = f"conv {kinds['conv']}, turn {kinds['turn']}, call_id string"
    checked = cut(rows.mapInArrow(partial(_check, schemas=schemas), f"{head}, name string, canonical string, refs array<string>, errors array<string>"))
    ordered = order(checked.where("call_id is not null").select("conv", "call_id", "turn", "refs"), group)
    same = Window.partitionBy("conv", "call_id")
    place = F.when(F.col("call_id").isNotNull(), F.row_number().over(same.orderBy("turn", "name", "canonical"))).otherwise(1)
    placed = checked.withColumn("place", place).join(ordered.withColumnsRenamed({"conv": "c", "call_id": "i"}), F.col("conv").eqNullSafe(F.col("c")) & (F.col("call_id") == F.col("i")), "left").drop("c", "i")
    numbered = results.select(F.col("conv").alias("c"), F.col("call_id").alias("i"), F.col("turn").alias("result_turn"), "content")
    each = Window.partitionBy("c", "i")
    numbered = numbered.withColumn("result_no", F.row_number().over(each.orderBy("result_turn", "content")).cast("long")).withColumn("n_results", F.count("*").over(each))
    meets = (F.col("conv") == F.col("c")) & (F.col("call_id") == F.col("i"))
    # the first call of an id alone takes results, so that a result has one row
    linked = placed.where("place = 1").join(numbered, meets, "left").unionByName(placed.where("place > 1"), allowMissingColumns=True)
    status = F.when(F.col("place") > 1, "duplicate").when(F.col("result_no").isNotNull(), "linked").otherwise("unanswered")
    ready = linked.select(
        "conv", "turn", "call_id", "name", "canonical", "content", status.alias("status"), F.coalesce("n_results", F.lit(0).cast("long")).alias("n_results"), "result_no", "result_turn",
        F.array_join("errors", "; ").alias("errors"), F.coalesce("order_turn", "turn").alias("order_turn"), F.coalesce("order_depth", F.lit(0).cast("long")).alias("order_depth"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"),
    )
    own = {"status": F.lit("orphan"), "name": F.lit(None).cast("string"), "canonical": F.lit(None).cast("string"), "n_results": F.lit(0).cast("long"), "result_no": F.lit(None).cast("long"), "errors": F.lit(""), "order_turn": F.col("turn"), "order_depth": F.lit(0).cast("long"), "cyclic": F.lit(False)}
    lone = orphans(calls, results).withColumn("result_turn", F.col("turn"))
    ready = ready.unionByName(lone.withColumns(own).select(ready.columns))
    if others is not None:
        own |= {"status": F.lit("message"), "name": F.col("role"), "call_id": F.lit(None).cast("string"), "result_turn": F.lit(None).cast(kinds["turn"])}
        ready = ready.unionByName(others.withColumns(own).select(ready.columns))
    return ready.mapInArrow(_json, f"{head}, status string, n_results long, result_no long, result_turn {kinds['turn']}, errors string, order_turn {kinds['turn']}, order_depth long, cyclic boolean, json string")


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results whose call does not exist."""
    ids = calls.where("call_id is not null").select(F.col("conv").alias("c"), F.col("call_id").alias("i"))
    return results.join(ids, (F.col("conv") == F.col("c")) & (F.col("call_id") == F.col("i")), "left_anti")


def exchanges(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A plain conversation as calls, results and other messages.

    Each user turn calls a tool and the next assistant turn answers.  A call
    refers to the exchange before it (``after``).  So that order and checks have
    work to do, conversations differ by number: in every fourth the first
    exchange needs the second (a forward reference), in another fourth the second
    refers back all the same (a cycle); one turn in five is given as text, and
    late turns of every seventh conversation ask a tool without a schema.
    """
    conv, turn = F.col("conv_id"), F.col("turn")

    def named(t):
        return F.concat_ws("-", conv.cast("string"), t.cast("string"))

    kind = F.pmod(conv, F.lit(4))
    after = F.when((turn >= 2) & ~((kind == 1) & (turn < 4)), F.struct(named(turn - 2).alias("$ref")))
    needs = F.when(kind.isin(1, 3) & (turn < 2), F.struct(named(turn + 2).alias("$ref")))
    as_text = F.pmod(conv + turn, F.lit(5)) == 0
    texts = F.to_json(F.struct(after.alias("after"), needs.alias("needs"), F.col("text").alias("prompt"), turn.cast("string").alias("turn")))
    numbers = F.to_json(F.struct(after.alias("after"), needs.alias("needs"), F.col("text").alias("prompt"), turn.alias("turn")))
    name = F.when((F.pmod(conv, F.lit(7)) == 3) & (turn >= 4), "search").otherwise("reply")
    calls = conversations.where("role = 'user'").select(conv.alias("conv"), "turn", named(turn).alias("call_id"), name.alias("name"), F.when(as_text, texts).otherwise(numbers).alias("arguments"))
    results = conversations.where("role = 'assistant'").select(conv.alias("conv"), "turn", named(turn - 1).alias("call_id"), F.col("text").alias("content"))
    others = conversations.where("role is null or role not in ('user', 'assistant')").select(conv.alias("conv"), "turn", "role", F.col("text").alias("content"))
    return calls, results, others


_REFERENCE = {"type": "object", "properties": {"$ref": {"type": "string"}}, "required": ["$ref"]}
REPLY = {"reply": {"type": "object", "properties": {"prompt": {"type": "string"}, "turn": {"type": "integer", "minimum": 0}, "after": _REFERENCE, "needs": _REFERENCE}, "required": ["prompt", "turn"], "additionalProperties": False}}
