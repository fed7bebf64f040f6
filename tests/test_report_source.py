"""Captured reports as a data source: rows as the scans give them, filters in the reader, files of other tools never opened."""

import json
import os

import pytest
from pyspark.sql import functions as F

from twinlens.sources import report_source, reports

ROWS = [{"line": 3, "column": 0}, {"line": 4}, {"line": 9, "column": 2}]


@pytest.fixture
def captured(spark, tmp_path):
    texts = []
    for i in range(6):
        name = f"/r/f{i}.ts"
        texts.append((i, "eslint", json.dumps([{"filePath": name, "messages": [{"ruleId": "c", "severity": k, "message": "é\nm", **r} for k, r in enumerate(ROWS)]}])))
        texts.append((10 + i, "biome", json.dumps({"diagnostics": [{"category": "c", "severity": s, "description": "d", "location": {"path": name, "start": r}} for s, r in zip(("info", "warning", "error"), ROWS, strict=True)]})))
        texts.append((20 + i, "oxlint", json.dumps({"diagnostics": [{"filename": name, "code": "c", "severity": "error", "message": "m", **r} for r in ROWS]})))
    texts.append((30, "oxlint", " "))
    df = spark.createDataFrame(texts, "report_id long, tool string, json string").repartition(3)
    report_source.capture(df, f"{tmp_path}/c")
    return df, f"{tmp_path}/c"


def test_rows_are_those_of_the_scans(spark, captured):
    df, folder = captured
    names = ["report_id", "tool", "path", "code", "severity", "message", "start_line", "start_column", "end_line", "end_column", "tie"]
    got = sorted(map(tuple, report_source.scan(spark, folder, "/r").select(*names).collect()))
    want = []
    for tool in ("eslint", "biome", "oxlint"):
        own = df.where(F.col("tool") == tool)
        rows = reports.flat_reports(own, "/r") if tool == "eslint" else reports.walked_reports(own, "/r", tool)
        want += map(tuple, rows.select(*names).collect())
    assert got == sorted(want) and len(got) == 54


def test_filters_go_into_the_reader(spark, captured):
    _, folder = captured
    found = report_source.scan(spark, folder, "/r")
    kept = found.where("tool IN ('eslint', 'biome') AND path = 'f2.ts' AND severity = 'error' AND start_line > 3")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    # what the reader takes is filtered nowhere else
    assert "start_line" in plan[plan.index("Filter") :] and "Filter" in plan and "path#" not in plan[plan.index("Filter") :].split("\n")[0] and "severity#" not in plan[plan.index("Filter") :].split("\n")[0]
    assert sorted((r["tool"], r["path"], r["severity"], r["start_line"]) for r in kept.collect()) == [("biome", "f2.ts", "error", 9), ("eslint", "f2.ts", "error", 9)]
    assert found.where(F.col("path").startswith("f1")).count() == 9 and found.where("tool = 'none'").count() == 0


def test_filters_of_one_plan_do_not_stay_for_the_next(spark, captured):
    found = report_source.scan(spark, captured[1], "/r")
    counts = [found.where(f).count() for f in ("tool = 'eslint'", "true", "path = 'f1.ts'", "severity = 'info'", "true")]
    assert counts == [18, 54, 9, 12, 54]


def test_files_of_other_tools_are_never_opened(spark, captured):
    """A file that can't be parsed fails every scan but those that don't ask for its tool."""
    _, folder = captured
    with open(os.path.join(folder, "tool=biome", "part-bad.txt"), "w") as f:
        f.write("{")
    found = report_source.scan(spark, folder, "/r")
    assert found.where("tool = 'eslint'").count() == 18 and found.where("tool = 'eslint'").rdd.getNumPartitions() <= 3
    with pytest.raises(Exception, match="JSON|Expecting"):
        found.count()
