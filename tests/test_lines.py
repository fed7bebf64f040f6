"""Line starts against counting in the text, and reports whose positions come through them."""

import json

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinlens.functions import text as single
from twinlens.operators import mapping_tables
from twinlens.sources import lines, reports

TEXTS = ["", "\n", "a", "é\nabc", "\n\n\n", "x\r\ny\n", "ü" * 50 + "\n" + "😀" * 3, "no end", "many\n" * 400]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aé\n😀\r", max_size=60), st.integers(0, 300))
def test_a_position_by_line_starts(text, offset):
    index = lines.LineStarts(text)
    assert index.position(offset) == single.offset_position(text, min(offset, index.size))


def test_index_and_positions_over_tables(spark):
    rows = [(f"f{i}", t, 1, 2) for i, t in enumerate(TEXTS)] + [("gone", None, 1, 2)]
    sources = spark.createDataFrame(rows, "path string, text string, size int, starts int").repartition(3)
    index = {r["path"]: (r["starts"], r["size"]) for r in lines.line_index(sources).collect()}
    assert index == {f"f{i}": (lines.LineStarts(t).starts, len(t.encode())) for i, t in enumerate(TEXTS)}
    spots = spark.createDataFrame([(f"f{i}", k, "extra", None) for i in range(len(TEXTS)) for k in (0, 1, 2, 3, 7, 101, 2000, 5000, 2**40)] + [("gone", 1, "x", None), ("f3", None, "x", None), (None, 1, "x", None)], "file string, k long, _extra string, size int")
    got = lines.with_positions(spots, lines.line_index(sources), "file", at="k").collect()
    assert len(got) == 9 * len(TEXTS) + 3
    for r in got:
        text = TEXTS[int(r["file"][1:])] if r["file"] not in (None, "gone") and r["k"] is not None else None
        assert (r["at"] and tuple(r["at"])) == (None if text is None else single.offset_position(text, min(r["k"], len(text.encode()))))


def test_a_sliced_batch_of_sources(spark, monkeypatch):
    """The index reads the texts' buffer of a batch at its offset."""
    caught = {}

    class Held:
        def where(self, *_):
            return self

        select = where

        def mapInArrow(self, run, schema):  # noqa: N802
            caught["run"] = run

    monkeypatch.setattr(lines.F, "col", lambda name: type("C", (), {"cast": lambda s, t: s, "alias": lambda s, n: s})())
    lines.line_index(Held())
    monkeypatch.undo()
    whole = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(TEXTS))]), pa.array([t.encode() for t in TEXTS], pa.binary())], names=["path", "text"])
    for start in range(len(TEXTS)):
        (out,) = caught["run"]([whole.slice(start, 3)])
        assert out.column(1).to_pylist() == [lines.LineStarts(t).starts for t in TEXTS[start : start + 3]]
    (out,) = caught["run"]([whole.slice(0, 0)])
    assert out.num_rows == 0


def test_no_text_is_joined_to_diagnostics(spark):
    sources = spark.createDataFrame([("a.ts", "x")], "path string, text string")
    texts = spark.createDataFrame([(0, "[]")], "report_id long, json string")
    plan = reports.walked_reports(texts, "/r", "oxlint", sources)._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[: plan.index("Join")]
    assert "text" not in joined and "_index_starts" in joined


def test_column_zero_stays(spark):
    """Columns as reported, 0 too, by the scans of tables and on the driver; a missing column is 1."""
    place = [{"line": 3, "column": 0}, {"line": 3}, {"line": 0, "column": 0}]
    nested = json.dumps({"diagnostics": [{"category": "c", "location": {"path": "a.ts", "start": p}} for p in place] + [{"category": "c", "location": {"path": "a.ts", "range": {"start": {"lineNumber": 2, "columnNumber": 0}}}}]})
    labelled = json.dumps({"diagnostics": [{"filename": "a.ts", "code": "c", "message": "m", **p} for p in place] + [{"filename": "a.ts", "code": "c", "message": "m", "labels": [{"span": {"line": 2, "column": 0}}]}]})
    flat = json.dumps([{"filePath": "/r/a.ts", "messages": [{"ruleId": "c", "message": "m", **p} for p in [*place, {"line": 2, "column": 0}]]}])
    want = [(3, 0), (3, 1), (0, 0), (2, 0)]
    for tool, text in (("biome", nested), ("oxlint", labelled), ("eslint", flat)):
        table = spark.createDataFrame([(0, text)], "report_id long, json string")
        scan = reports.flat_reports(table, "/r") if tool == "eslint" else reports.walked_reports(table, "/r", tool)
        assert [(r["start_line"], r["start_column"]) for r in scan.orderBy("tie").collect()] == want, tool
        assert [(r["start_line"], r["start_column"]) for r in reports.local_reports(text, "/r", tool)] == want, tool


def test_mapping_tables(spark):
    rules = spark.createDataFrame(
        [("biome", " lint/a ", "eslint", "a", "approximate", "n"), ("eslint", "a", "biome", "lint/a", "approximate", "n"), ("eslint", "b", "biome", "lint/b", None, None), ("other", "x", "biome", "y", "exact", None), (None, "x", "biome", "y", "exact", None), ("eslint", None, "biome", "y", "exact", None)],
        "baseline_tool string, baseline string, candidate_tool string, candidate string, confidence string, notes string",
    )
    aliases = spark.createDataFrame([(1, "oxlint", "no-x"), (1, "eslint", "no-x"), (1, "biome", "lint/noX"), (2, "eslint", "alone"), (3, "eslint", ""), (None, "biome", "q")], "alias_id int, tool string, code string")
    table = mapping_tables.mapping_table(rules, aliases)
    assert sorted(map(tuple, table.collect())) == [(0, "a", 1, "lint/a", 1), (0, "b", 1, "lint/b", 0), (0, "no-x", 1, "lint/noX", 0), (0, "no-x", 2, "no-x", 0), (1, "lint/noX", 2, "no-x", 0)]
    assert sorted(map(tuple, mapping_tables.configured_counts(table).collect())) == [("biome", "oxlint", 1, 0), ("eslint", "biome", 2, 1), ("eslint", "oxlint", 1, 0)]
    found = sorted((r["baseline"], r["candidate"], r["confidence"], r["notes"]) for r in mapping_tables.oriented(rules, aliases, "eslint", "biome").where(F.col("candidate") != "y").collect())
    assert found == [("a", " lint/a ", "approximate", "n"), ("a", "lint/a", "approximate", "n"), ("b", "lint/b", "exact", None), ("no-x", "lint/noX", "exact", "from an alias")]
