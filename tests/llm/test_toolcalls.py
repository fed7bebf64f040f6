"""Canonical JSON, schemas, levels of long chains and random graphs, positions over several tasks."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from twinlens.llm import toolcalls
from twinlens.llm.common import Scratch


def written(text):
    return toolcalls.canonical(toolcalls.parsed(text))


def test_one_spelling_for_each_number():
    for text, want in {"1": "1", "1.0": "1", "1e0": "1", "100": "100", "1e2": "100", "1E+2": "100", "-0": "0", "0.0e9": "0", "0.10": "0.1", "1e-6": "0.000001", "1e-7": "1e-7", "123e18": "123000000000000000000", "1e21": "1e+21", "12.5e30": "1.25e+31", "-1.50": "-1.5",
                       "12345678901234567890.125": "12345678901234567890.125"}.items():
        assert written(text) == want
    assert written('{"b": [1.0, {"z": null, "a": true}], "a": "x\\u0041\\n\\ud800"}') == '{"a":"xA\\n\\ud800","b":[1,{"a":true,"z":null}]}'
    for bad in ("NaN", "[Infinity]", '{"a":1,"a":2}', "", None, "{", "[" * 100_000, "1 2", "01"):
        with pytest.raises(toolcalls.NotJson):
            toolcalls.parsed(bad)


values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8)


@settings(max_examples=200, deadline=None)
@given(values)
def test_round_trip(value):
    text = written(json.dumps(value))
    assert written(text) == text == written(json.dumps(value, indent=3, sort_keys=True)) and toolcalls.parsed(text) == toolcalls.parsed(json.dumps(value))


def test_nested_schemas():
    schema = {"type": "object", "required": ["at"], "additionalProperties": {"type": "string"}, "properties": {"at": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "exclusiveMinimum": 0}, "k": {"enum": [1, "x", [2]]}, "s": {"type": ["string", "null"], "pattern": "^a", "minLength": 2}}}}}}
    good = ['{"at":[{"n":1}]}', '{"at":[{"n":1.0,"k":1e0},{"n":3,"k":[2],"s":"ab"}],"x":"y"}', '{"at":[{"n":2,"s":null}]}']
    bad = ["[]", "{}", '{"at":[]}', '{"at":[{"n":0}]}', '{"at":[{"n":1.5}]}', '{"at":[{"n":1,"k":2}]}', '{"at":[{"n":1,"s":"a"}]}', '{"at":[{"n":1,"s":"ba"}]}', '{"at":[{"n":1}],"x":1}', '{"at":[{"n":true}]}']
    assert all(toolcalls.follows(toolcalls.parsed(t), schema) for t in good) and not any(toolcalls.follows(toolcalls.parsed(t), schema) for t in bad)


def graph(spark, edges, turns):
    calls = spark.createDataFrame([(1, f"c{i}", t) for i, t in enumerate(turns)], "conv_id long, call_id string, turn long")
    references = spark.createDataFrame([(1, f"c{a}", f"c{b}") for a, b in edges], "conv_id long, call_id string, needs string")
    return calls, references


def plain_levels(edges, turns):
    """Levels by looking at every path; null where a path comes back."""
    needs = {}
    for a, b in edges:
        if b < len(turns):
            needs.setdefault(a, set()).add(b)
    out = {}

    def level(c, path):
        if c in path:
            return None
        if c not in out:
            found = [(level(d, path | {c}), int(turns[d] >= turns[c])) for d in needs.get(c, ())]
            if any(x is None for x, _ in found):
                return None
            out[c] = max((x + s for x, s in found), default=0)
        return out[c]

    return {c: level(c, frozenset()) for c in range(len(turns))}


@pytest.mark.parametrize("seed", [1, 2])
def test_levels_of_random_graphs(spark, seed, monkeypatch):
    rng = random.Random(seed)
    turns = [rng.randint(0, 30) for _ in range(40)]
    edges = {(rng.randrange(40), rng.randrange(44)) for _ in range(34)} | ({(a, a + 1) for a in range(10)} if seed == 2 else set())
    edges = [(a, b) for a, b in edges if a != b or seed == 2]
    want = plain_levels(edges, turns)
    for limit in (50_000, 0):
        monkeypatch.setattr(toolcalls, "GROUP_REFERENCES", limit)
        got = {int(r.call_id[1:]): r.level for r in toolcalls.levels(*graph(spark, edges, turns), Scratch(spark)).collect()}
        assert all(got.get(c, 0) == n for c, n in want.items())


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n = 600
    calls, references = graph(spark, [(i, i + 1) for i in range(n - 1)], list(range(n)))
    monkeypatch.setattr(toolcalls, "GROUP_REFERENCES", 0)
    scratch = Scratch(spark)
    got = {int(r.call_id[1:]): r.level for r in toolcalls.levels(calls, references, scratch).collect()}
    assert got == {i: n - 1 - i for i in range(n)} and scratch.n < 7 * 13


def test_positions_over_tasks(spark):
    rows = [(c, lv, t, f"c{c}-{t}") for c in (1, 2) for t in range(200 if c == 1 else 5) for lv in (t % 3,)]
    df = spark.createDataFrame(rows, "conv_id long, level int, turn long, call_id string")
    got = {(r.conv_id, r.call_id): r.position for r in toolcalls.positions(df, Scratch(spark)).collect()}
    for c in (1, 2):
        assert [got[c, r[3]] for r in sorted(x for x in rows if x[0] == c)] == list(range(sum(x[0] == c for x in rows)))
