"""Tool-call linking: results joined to calls by identifier, a topological order, schema checks, canonical JSON.

Calls and results are joined on (conversation, call id), so one large conversation spreads over all tasks. The order of
calls is (level, turn, call id), and a call's position counts the calls before it: its level is the greatest number of
*forward* references (to a call at its own turn or later) on a path through its prerequisites. Where no call refers
forward, every level is 0 and nothing is iterated. Otherwise the references of a conversation of up to ``GROUP_REFERENCES``
are sorted in one Arrow group; those of larger ones in rounds, in which chains halve, so that a chain of n calls takes about
log2(n) of them.

Arguments are parsed once in an Arrow pass that checks the schema and writes canonical JSON: sorted keys, no white space, one
spelling of each number (equal numbers are written the same) and of each character.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .common import Scratch, limit_arrow_batches

#: References of a conversation that one task sorts; more go through rounds.
GROUP_REFERENCES = 50_000
LINKED, UNANSWERED, ORPHAN = "linked", "unanswered", "orphan_result"


class NotJson(ValueError):
    pass


def _members(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise NotJson("a key stands twice")
    return out


def _refuse(name: str):
    raise NotJson(name)


def parsed(text: str | None):
    """The value of a JSON text, numbers as decimals. No JSON: NotJson, also where a key stands twice or nesting is too deep to read."""
    try:
        return json.loads(text or "", parse_int=Decimal, parse_float=Decimal, parse_constant=_refuse, object_pairs_hook=_members)
    except (ValueError, RecursionError, InvalidOperation, TypeError) as e:
        raise NotJson(str(e)) from None


def number_text(n: Decimal) -> str:
    """The one spelling of a number: plain digits between 1e-6 and 1e21, else a digit, its decimals and an exponent; zero has no sign."""
    if not n:
        return "0"
    sign, digits, exponent = n.as_tuple()
    text = "".join(map(str, digits)).lstrip("0")
    kept = text.rstrip("0")
    exponent += len(text) - len(kept)
    point = len(kept) + exponent
    head = "-" if sign else ""
    if -6 < point <= 21:
        if point <= 0:
            return f"{head}0.{'0' * -point}{kept}"
        return head + (kept + "0" * exponent if exponent >= 0 else f"{kept[:point]}.{kept[point:]}")
    return f"{head}{kept[0]}{'.' + kept[1:] if len(kept) > 1 else ''}e{'+' if point > 0 else '-'}{abs(point - 1)}"


_LONE = re.compile("[\ud800-\udfff]")


def canonical(value) -> str:
    """A parsed value as canonical JSON. Keys are sorted by their code points; half characters are written as escapes."""
    if isinstance(value, Decimal):
        return number_text(value)
    if isinstance(value, str):
        return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(value, ensure_ascii=False))
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in sorted(value)) + "}"
    return {None: "null", True: "true", False: "false"}[value]


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, Decimal) and value == value.to_integral_value()
    kinds = {"string": str, "number": Decimal, "boolean": bool, "array": list, "object": dict, "null": type(None)}
    return isinstance(value, kinds[kind])


def follows(value, schema: dict) -> bool:
    """Whether a parsed value follows a schema, nested ones too.

    Known are type (one or several), enum, const, minimum, maximum, exclusiveMinimum, exclusiveMaximum, minLength, maxLength,
    pattern, items, minItems, maxItems, required, properties and additionalProperties (false or a schema).
    """
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return False
    same = lambda x: canonical(parsed(json.dumps(x))) == canonical(value)
    if "enum" in schema and not any(map(same, schema["enum"])) or "const" in schema and not same(schema["const"]):
        return False
    if isinstance(value, Decimal):
        low, high, above, below = (schema.get(k) for k in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"))
        bounds = ((low, lambda x: value >= x), (high, lambda x: value <= x), (above, lambda x: value > x), (below, lambda x: value < x))
        return all(ok(Decimal(str(x))) for x, ok in bounds if x is not None)
    if isinstance(value, str):
        fits = schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value))
        return fits and ("pattern" not in schema or re.search(schema["pattern"], value) is not None)
    if isinstance(value, list):
        fits = schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value))
        return fits and all(follows(x, schema["items"]) for x in value if "items" in schema)
    if isinstance(value, dict):
        known, other = schema.get("properties", {}), schema.get("additionalProperties", True)
        if not all(k in value for k in schema.get("required", [])):
            return False
        if other is False and any(k not in known for k in value):
            return False
        return all(follows(v, known[k] if k in known else other) for k, v in value.items() if k in known or isinstance(other, dict))
    return True


def read_arguments(calls: DataFrame, schemas: dict[str, dict], references_key: str) -> DataFrame:
    """(conv_id, call_id, turn, name, args, valid, needs): calls with canonical arguments, whether they follow the tool's schema, and the ids they name."""
    limit_arrow_batches(calls.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            args, valid, needs = [], [], []
            for name, text in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                try:
                    value = parsed(text)
                    written = canonical(value)
                    ok = isinstance(value, dict) and name in schemas and follows(value, {"type": "object"} | schemas[name])
                except (NotJson, RecursionError):
                    value, written, ok = None, None, False
                named = value.get(references_key) if isinstance(value, dict) else None
                args.append(written)
                valid.append(ok)
                needs.append([x for x in named if isinstance(x, str) and not _LONE.search(x)] if isinstance(named, list) else [])
            columns = [*b.columns[:4], pa.array(args, pa.string()), pa.array(valid, pa.bool_()), pa.array(needs, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "call_id", "turn", "name", "args", "valid", "needs"])

    kinds = dict(calls.dtypes)
    schema = f"conv_id {kinds['conv_id']}, call_id {kinds['call_id']}, turn {kinds['turn']}, name string, args string, valid boolean, needs array<string>"
    return calls.select("conv_id", "call_id", "turn", F.col("name").cast("string").alias("name"), F.col("arguments").cast("string").alias("arguments")).mapInArrow(run, schema)


def sorted_levels(edges: list[tuple[str, str, int]]) -> dict[str, int | None]:
    """The levels of calls that refer to others, from (call, needs, step); null on or behind a cycle."""
    waits: dict[str, int] = {}
    behind: dict[str, list[tuple[str, int]]] = {}
    for call, needs, step in edges:
        waits[call] = waits.get(call, 0) + 1
        waits.setdefault(needs, 0)
        behind.setdefault(needs, []).append((call, step))
    level = dict.fromkeys(waits, 0)
    ready = [c for c, n in waits.items() if not n]
    done = set(ready)
    while ready:
        c = ready.pop()
        for call, step in behind.get(c, []):
            level[call] = max(level[call], level[c] + step)
            waits[call] -= 1
            if not waits[call]:
                ready.append(call)
                done.add(call)
    return {c: level[c] if c in done else None for c in level}


def levels(calls: DataFrame, references: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, call_id, level) for calls whose level may not be 0, from (conv_id, call_id, turn) and (conv_id, call_id, needs).

    The level is null for calls on or behind a cycle. References to ids that are no call of the conversation are ignored.
    """
    turn = calls.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), F.col("turn").alias("t"))
    edges = references.join(calls.select("conv_id", "call_id", "turn"), ["conv_id", "call_id"])
    edges = edges.join(turn, (edges.conv_id == turn.c) & (edges.needs == turn.i)).select("conv_id", "call_id", "needs", (F.col("t") >= F.col("turn")).cast("int").alias("step")).distinct()
    edges = scratch.write(edges)
    size = edges.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("step").alias("step")).where("step = 1")
    small, large = (edges.join(size.where(f"n {sign} {GROUP_REFERENCES}").select("conv_id", "n"), "conv_id") for sign in ("<=", ">"))

    def sort(table: pa.Table) -> pa.Table:
        found = sorted_levels(list(zip(*(table.column(k).to_pylist() for k in ("call_id", "needs", "step")), strict=True)))
        conv = table.column("conv_id")[0].as_py()
        return pa.Table.from_arrays([pa.array([conv] * len(found), table.schema.field("conv_id").type), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int32())], names=["conv_id", "call_id", "level"])

    out = small.drop("n").groupBy("conv_id").applyInArrow(sort, f"conv_id {dict(edges.dtypes)['conv_id']}, call_id string, level int")
    large = scratch.write(large)
    return out if large.isEmpty() else out.unionByName(levels_by_rounds(large, scratch))


def levels_by_rounds(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, call_id, level) for the calls of (conv_id, call_id, needs, step, n), n being the conversation's references, in rounds over all tasks.

    In a round a call whose prerequisites are all settled settles, and a reference to a call that waits for one other alone
    goes over to that one, with the steps between: chains halve. Steps beyond n, or a reference to the call itself, tell a
    cycle; such a call waits for itself from then on. When a round changes nothing, what is left is on or behind a cycle.
    """
    key = ["conv_id", "call_id"]
    ends = edges.select("conv_id", F.col("needs").alias("call_id")).distinct().join(edges.select(*key).distinct(), key, "left_anti")
    done, mark = scratch.write(ends.withColumn("level", F.lit(0))), None
    open_ = edges.select(*key, "needs", "step", "n")
    floor = scratch.write(edges.select(*key).distinct().withColumn("floor", F.lit(0)))

    def raised(given: DataFrame) -> DataFrame:
        """The floors, where the settled prerequisites ask for more (call, given) raised to that."""
        most = given.groupBy(*key).agg(F.max("given").alias("given"))
        return floor.join(most, key, "left").select(*key, F.greatest("floor", F.coalesce("given", F.lit(0))).cast("int").alias("floor"))

    while True:
        known = done.select("conv_id", F.col("call_id").alias("needs"), "level")
        floor = scratch.write(raised(open_.join(known, ["conv_id", "needs"]).select(*key, (F.col("level") + F.col("step")).alias("given"))))
        rest = scratch.write(open_.join(known, ["conv_id", "needs"], "left_anti").select(*key, "needs", "step", "n"))
        waiting = rest.select(*key).distinct()
        done = scratch.write(done.unionByName(floor.join(waiting, key, "left_anti").select(*key, F.col("floor").alias("level"))))
        row = rest.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*key, "needs", "step").cast("decimal(20,0)")).alias("h")).first()
        if not row.n or (row.n, row.h) == mark:
            return done.unionByName(waiting.withColumn("level", F.lit(None).cast("int")))
        mark = (row.n, row.h)
        floor = scratch.write(floor.join(waiting, key, "left_semi"))
        alone = rest.groupBy(*key).agg(F.count("*").alias("k"), F.first("needs").alias("over"), F.first("step").alias("more")).where("k = 1 AND over <> call_id").drop("k")
        jump = scratch.write(alone.join(floor, key).select("conv_id", F.col("call_id").alias("needs"), "over", "more", F.col("floor").alias("under")))
        moved = rest.join(jump, ["conv_id", "needs"], "left")
        to, step = F.coalesce("over", "needs"), F.col("step") + F.coalesce("more", F.lit(0))
        looped = (to == F.col("call_id")) | (step > F.col("n"))
        new = moved.select(*key, F.when(looped, F.col("call_id")).otherwise(to).alias("needs"), F.when(looped, 0).otherwise(step).cast("int").alias("step"), "n")
        floor = scratch.write(raised(moved.where("over IS NOT NULL").select(*key, (F.col("under") + F.col("step")).alias("given"))))
        open_ = scratch.write(new.groupBy(*key, "needs").agg(F.max("step").alias("step"), F.first("n").alias("n")))


def positions(ranked: DataFrame, scratch: Scratch) -> DataFrame:
    """``ranked`` (conv_id, level, turn, call_id and others) with ``position``: the rows of the conversation before a row, from 0, in the order of the four.

    Rows are dealt by ranges of the whole order, so that a conversation of any size spreads over tasks; each task counts its
    own rows, and what earlier tasks hold of a conversation is added.
    """
    order = ["conv_id", "level", "turn", "call_id"]
    spark = ranked.sparkSession
    dealt = ranked.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for b in batches:
            at = []
            for conv in b.column(0).to_pylist():
                n = n + 1 if conv == last else 0
                last = conv
                at.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64())], names=[*b.schema.names, "own"])

    names = ["conv_id", *(c for c in ranked.columns if c != "conv_id")]
    schema = T.StructType([*dealt.select(*names).schema.fields, T.StructField("own", T.LongType())])
    counted = scratch.write(dealt.select(*names).mapInArrow(run, schema).withColumn("part", F.spark_partition_id()))
    parts = counted.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.Window.partitionBy("conv_id").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1))
    # a row for each conversation that goes on from an earlier task: no more than tasks
    offsets = parts.withColumn("before", before).where("before > 0").select("conv_id", "part", "before")
    out = counted.join(F.broadcast(offsets), ["conv_id", "part"], "left")
    return out.select(*ranked.columns, (F.col("own") + F.coalesce("before", F.lit(0))).alias("position"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], references_key: str = "after") -> DataFrame:
    """One row per call, and one per result that answers no call.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON text); ``results``: conv_id, call_id, turn, content.
    ``arguments[references_key]``, where it is an array, names the calls that must come first by its strings.
    Returns conv_id, call_id, turn, status, valid, level, position, cyclic, n_results, json.

    The level of a call on or behind a cycle of references is null and it is marked cyclic; it has no position, nor have calls
    without an id or conversation, and orphans. Of several results of a call the earliest turn answers (ties: the least
    content) and all are counted; of repeated calls of one id the earliest is used. Null ids never link: such calls are
    unanswered, such results orphans. Each orphan is a row of its own with an n_results of 1. Arguments that are null or no
    JSON object (a JSON null for a required key is a member like any other and follows if its type may be null), and tools
    without a schema, are not valid; arguments that are no JSON, repeat a key or nest too deeply to be read are written as null.
    Other columns are not read; empty tables give no rows.
    """
    scratch = Scratch(calls.sparkSession)
    head = F.struct(F.col("turn"), F.col("name"), F.col("arguments"))
    both = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    keyed = calls.where(both).groupBy("conv_id", "call_id").agg(F.min(head).alias("h"))
    own = keyed.select("conv_id", "call_id", "h.*").unionByName(calls.where(~both).select("conv_id", "call_id", "turn", "name", "arguments"))
    own = scratch.write(read_arguments(own, schemas, references_key))
    answer = results.where(both).groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    answer = answer.select(F.col("conv_id").alias("rc"), F.col("call_id").alias("ri"), F.col("r.content").alias("content"), "n_results")
    references = own.where(both).select("conv_id", "call_id", F.explode("needs").alias("needs"))
    rank = levels(own.where(both), references, scratch).select(F.col("conv_id").alias("lc"), F.col("call_id").alias("li"), "level")
    out = own.join(answer, (F.col("conv_id") == F.col("rc")) & (F.col("call_id") == F.col("ri")), "left")
    out = out.join(rank, (F.col("conv_id") == F.col("lc")) & (F.col("call_id") == F.col("li")), "left")
    quoted = lambda c: F.when(c.isNull(), F.lit("null")).otherwise(F.substring(F.to_json(F.array(c)), F.lit(2), F.length(F.to_json(F.array(c))) - 2))
    body = F.concat(
        F.lit('{"arguments":'), F.coalesce("args", F.lit("null")), F.lit(',"id":'), quoted(F.col("call_id")),
        F.lit(',"name":'), quoted(F.col("name")), F.lit(',"result":'), quoted(F.col("content")), F.lit("}"),
    )
    linked = out.select(
        "conv_id", "call_id", "turn", F.when(F.col("n_results").isNull(), UNANSWERED).otherwise(LINKED).alias("status"), "valid",
        F.when(F.col("li").isNull(), 0).otherwise(F.col("level")).alias("level"), (F.col("li").isNotNull() & F.col("level").isNull()).alias("cyclic"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), body.alias("json"),
    )
    linked = scratch.write(linked)
    placed = both & ~F.col("cyclic")
    none = F.lit(None).cast("long").alias("position")
    linked = positions(linked.where(placed), scratch).unionByName(linked.where(~placed).select("*", none))
    known = own.select(F.col("conv_id").alias("kc"), F.col("call_id").alias("ki"))
    single = results.select(F.col("conv_id").alias("rc"), F.col("call_id").alias("ri"), F.col("turn").alias("r_turn"), "content", F.lit(1).cast("long").alias("n_results"))
    lost = single.join(known, (F.col("rc") == F.col("kc")) & (F.col("ri") == F.col("ki")), "left_anti")
    orphan = F.concat(F.lit('{"id":'), quoted(F.col("ri")), F.lit(',"result":'), quoted(F.col("content")), F.lit("}"))
    lost = lost.select(
        F.col("rc").alias("conv_id"), F.col("ri").alias("call_id"), F.col("r_turn").alias("turn"), F.lit(ORPHAN).alias("status"), F.lit(False).alias("valid"),
        F.lit(0).alias("level"), F.lit(False).alias("cyclic"), "n_results", orphan.alias("json"), none,
    )
    columns = ["conv_id", "call_id", "turn", "status", "valid", "level", "position", "cyclic", "n_results", "json"]
    return linked.unionByName(lost).select(*columns)


#: The tools of the registered query.
SCHEMAS = {
    "lookup": {"type": "object", "required": ["query", "limit"], "properties": {"query": {"type": "string", "maxLength": 12}, "limit": {"type": "integer", "minimum": 1, "maximum": 45}, "after": {"type": "array"}}, "additionalProperties": False},
    "measure": {"type": "object", "required": ["limit"], "properties": {"limit": {"type": "number", "minimum": 5}, "query": {"type": "string"}, "after": {"type": "array"}}},
}


def calls_of_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read out of plain conversations, which hold no tool calls.

    An assistant's turn is a call whose tool and arguments come from its text, written with unsorted keys; the user's turn
    after it is its result, a system's turn the result of a call that isn't there. A call refers to the assistant's turn two
    before, every fifth turn forward to the one two after; where both meet, at every third, they form a cycle.
    """
    call = lambda shift: F.concat_ws(":", F.lit("call"), F.col("conv_id"), F.col("turn") + shift)
    size = F.char_length(F.coalesce("text", F.lit("")))
    word = F.regexp_replace(F.substring_index(F.coalesce("text", F.lit("")), " ", 1), "[^A-Za-z]", "")
    after = F.filter(F.array(F.when(((F.col("turn") - 2) % 5 != 0) | (F.col("turn") % 3 == 0), call(-2)), F.when(F.col("turn") % 5 == 0, call(2))), lambda x: x.isNotNull())
    text = F.concat(F.lit('{ "query": "'), word, F.lit('", "limit": '), size % 50, F.lit(', "after": '), F.to_json(after), F.lit(" }"))
    made = conversations.where("role = 'assistant'").select(
        "conv_id", call(0).alias("call_id"), "turn", F.when(size % 3 == 0, "lookup").when(size % 3 == 1, "measure").otherwise("other").alias("name"), text.alias("arguments")
    )
    answers = conversations.where("role <> 'assistant'").select("conv_id", call(-1).alias("call_id"), "turn", F.col("text").alias("content"))
    return made, answers


ORACLE = """
    WITH RECURSIVE base AS (SELECT *, length(coalesce(text, '')) AS n FROM conversations),
    calls AS (
        SELECT conv_id, call_id, min(turn) AS turn, arg_min(name, h) AS name, arg_min(word, h) AS word, arg_min(lim, h) AS lim FROM (
            SELECT conv_id, 'call:' || conv_id || ':' || turn AS call_id, turn, CASE n % 3 WHEN 0 THEN 'lookup' WHEN 1 THEN 'measure' ELSE 'other' END AS name,
                regexp_replace(string_split(coalesce(text, ''), ' ')[1], '[^A-Za-z]', '', 'g') AS word, n % 50 AS lim,
                {'name': CASE n % 3 WHEN 0 THEN 'lookup' WHEN 1 THEN 'measure' ELSE 'other' END,
                 'args': '{ "query": "' || regexp_replace(string_split(coalesce(text, ''), ' ')[1], '[^A-Za-z]', '', 'g') || '", "limit": ' || (n % 50)} AS h
            FROM base WHERE role = 'assistant') GROUP BY ALL),
    results AS (
        SELECT conv_id, 'call:' || conv_id || ':' || (turn - 1) AS call_id, min(turn) AS turn, arg_min(text, {'t': turn, 'x': text}) AS content, count(*) AS n_results
        FROM base WHERE role <> 'assistant' GROUP BY ALL),
    edges AS (
        SELECT c.conv_id, c.turn AS turn, d.turn AS needs, CASE WHEN d.turn >= c.turn THEN 1 ELSE 0 END AS step
        FROM calls c JOIN calls d ON c.conv_id = d.conv_id
            AND ((d.turn = c.turn - 2 AND ((c.turn - 2) % 5 <> 0 OR c.turn % 3 = 0)) OR (c.turn % 5 = 0 AND d.turn = c.turn + 2))),
    reach AS (SELECT conv_id, turn, needs FROM edges UNION SELECT r.conv_id, r.turn, e.needs FROM reach r JOIN edges e ON r.conv_id = e.conv_id AND r.needs = e.turn),
    looped AS (SELECT conv_id, turn FROM reach WHERE turn = needs),
    bad AS (SELECT conv_id, turn FROM looped UNION SELECT r.conv_id, r.turn FROM reach r JOIN looped l ON r.conv_id = l.conv_id AND r.needs = l.turn),
    walk AS (
        SELECT conv_id, turn, 1 AS level FROM edges ANTI JOIN bad USING (conv_id, turn) WHERE step = 1
        UNION
        SELECT e.conv_id, e.turn, w.level + e.step FROM walk w JOIN (SELECT * FROM edges ANTI JOIN bad USING (conv_id, turn)) e ON e.conv_id = w.conv_id AND e.needs = w.turn),
    top AS (SELECT conv_id, turn, max(level) AS level FROM walk GROUP BY ALL),
    placed AS (
        SELECT c.conv_id, c.call_id, row_number() OVER (PARTITION BY c.conv_id ORDER BY coalesce(t.level, 0), c.turn, c.call_id) - 1 AS position
        FROM calls c LEFT JOIN top t ON t.conv_id = c.conv_id AND t.turn = c.turn ANTI JOIN bad x ON x.conv_id = c.conv_id AND x.turn = c.turn)
    SELECT c.conv_id, c.call_id, c.turn, CASE WHEN r.n_results IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
        CASE c.name WHEN 'lookup' THEN length(c.word) <= 12 AND c.lim BETWEEN 1 AND 45 WHEN 'measure' THEN c.lim >= 5 ELSE false END AS valid,
        CASE WHEN x.turn IS NULL THEN coalesce(t.level, 0) END AS level, p.position, x.turn IS NOT NULL AS cyclic, coalesce(r.n_results, 0) AS n_results,
        '{"arguments":{"after":[' || concat_ws(',', CASE WHEN (c.turn - 2) % 5 <> 0 OR c.turn % 3 = 0 THEN '"call:' || c.conv_id || ':' || (c.turn - 2) || '"' END,
            CASE WHEN c.turn % 5 = 0 THEN '"call:' || c.conv_id || ':' || (c.turn + 2) || '"' END) || '],"limit":' || c.lim || ',"query":"' || c.word || '"},"id":"' || c.call_id || '","name":"' || c.name || '","result":' || coalesce(CAST(to_json(r.content) AS VARCHAR), 'null') || '}' AS json
    FROM calls c LEFT JOIN results r USING (conv_id, call_id) LEFT JOIN top t ON t.conv_id = c.conv_id AND t.turn = c.turn LEFT JOIN bad x ON x.conv_id = c.conv_id AND x.turn = c.turn LEFT JOIN placed p ON p.conv_id = c.conv_id AND p.call_id = c.call_id
    UNION ALL
    SELECT r.conv_id, r.call_id, r.turn, 'orphan_result', false, 0, NULL, false, r.n_results,
        '{"id":"' || r.call_id || '","result":' || coalesce(CAST(to_json(r.content) AS VARCHAR), 'null') || '}'
    FROM results r ANTI JOIN calls c USING (conv_id, call_id)"""
