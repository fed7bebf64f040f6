"""The report folder: order over many part files, replacement in one step, failures that leave the old report, and the command."""

import json
import random

import pytest
from pyspark.sql import functions as F

from twinlens import cli
from twinlens.errors import OperationalError
from twinlens.operators import matching, report, report_sink
from twinlens.plans import demo
from twinlens.sources import config

ROWS = f"section string, order {report_sink.ORDER}, json string"


def rows_of(spark, n, seed=1, sections=("one", "two")):
    rng = random.Random(seed)
    rows = [(rng.choice(sections), (f"f{k % 7:02}", k, None, 0, None, None, None, k), json.dumps({"k": k, "text": 'a,"entry":' + "x" * (k % 5)})) for k in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, ROWS).repartition(5)


def listed(spark, path):
    out = {}
    for r in sorted(report_sink.read(spark, path).collect(), key=lambda r: (r["section"], r["n"])):
        assert r["n"] == len(out.setdefault(r["section"], []))
        out[r["section"]].append(r["json"])
    return out


def test_rows_come_back_in_order(spark, tmp_path):
    rows = rows_of(spark, 500)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = report_sink.write(spark, f"{tmp_path}/r", {"mode": "lint", "ä": [1]}, rows, ["two", "none", "one"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (r["order"]["path"], r["order"]["line"])):
        want.setdefault(r["section"], []).append(r["json"])
    assert listed(spark, f"{tmp_path}/r") == want
    assert [(s["name"], s["rows"]) for s in manifest["sections"]] == [("two", len(want["two"])), ("none", 0), ("one", len(want["one"]))]
    assert max(len(s["files"]) for s in manifest["sections"]) > 1 and report_sink.manifest_of(spark, f"{tmp_path}/r")["head"] == {"mode": "lint", "ä": [1]}
    # the files alone, one after the other, are the report's order too
    section = manifest["sections"][0]
    lines = [x for f in section["files"] for x in (tmp_path / "r" / manifest["version"] / "section=two" / f["file"]).read_text().splitlines()]
    assert [json.loads(x)["entry"] for x in lines] == [json.loads(x) for x in want["two"]]


def test_a_failed_run_leaves_the_old_report(spark, tmp_path):
    path = f"{tmp_path}/r"
    report_sink.write(spark, path, {"n": 1}, rows_of(spark, 60), ["one", "two"])
    before = listed(spark, path)
    broken = rows_of(spark, 60, 2).withColumn("json", F.when(F.col("order.line") == 31, F.raise_error("lost").cast("string")).otherwise(F.col("json")))
    for bad in (broken, rows_of(spark, 60, 2, ("one", "odd"))):
        with pytest.raises(Exception, match="lost|no such section"):
            report_sink.write(spark, path, {"n": 2}, bad, ["one", "two"])
        assert listed(spark, path) == before and report_sink.manifest_of(spark, path)["head"] == {"n": 1}
        assert len([p for p in (tmp_path / "r").iterdir() if p.name.startswith("v-")]) == 1
    report_sink.write(spark, path, {"n": 3}, rows_of(spark, 10, 3), ["one", "two"])
    assert report_sink.manifest_of(spark, path)["head"] == {"n": 3} and sum(map(len, listed(spark, path).values())) == 10
    assert len([p for p in (tmp_path / "r").iterdir() if p.name.startswith("v-")]) == 1


def test_reports_without_rows(spark, tmp_path):
    report_sink.write(spark, f"{tmp_path}/r", {}, spark.createDataFrame([], ROWS), ["one"])
    assert listed(spark, f"{tmp_path}/r") == {} and report_sink.manifest_of(spark, f"{tmp_path}/r")["sections"] == [{"name": "one", "rows": 0, "files": []}]
    with pytest.raises(OperationalError):
        report_sink.read(spark, f"{tmp_path}/gone")


def test_half_a_million_rows_and_a_small_driver_result(spark, tmp_path):
    n = 500_000
    place = F.struct(F.concat(F.lit("f"), F.col("id") % 1000).alias("path"), F.col("id").alias("line"), *(F.lit(None).alias(c) for c in ("column", "kind", "code", "message", "fingerprint", "tie"))).cast(report_sink.ORDER)
    rows = spark.range(n).select(F.lit("matches").alias("section"), place.alias("order"), F.to_json(F.struct("id")).alias("json"))
    before = spark.conf.get("spark.driver.maxResultSize", "1g")
    manifest = report_sink.write(spark, f"{tmp_path}/r", {}, rows, ["matches"])
    assert before and manifest["sections"][0]["rows"] == n and len(json.dumps(manifest)) < 10_000
    got = report_sink.read(spark, f"{tmp_path}/r")
    assert got.agg(F.count("*"), F.count_distinct("n"), F.min("n"), F.max("n")).first() == (n, n, 0, n - 1)
    step = n // 1000
    assert got.where(F.col("n") % step != F.floor(F.get_json_object("json", "$.id").cast("long") / 1000)).isEmpty()


def test_lint_rows_are_the_report(spark, tmp_path):
    """Sections by tasks hold what the single document holds, in its order."""
    links = matching.linked(demo.event_diagnostics(spark, "/root/testdata/sf0.001"), demo.MAPPINGS, demo.BASELINE, demo.CANDIDATE).cache()
    report_sink.write(spark, f"{tmp_path}/r", {}, report_sink.lint_rows(links), report_sink.LINT_SECTIONS)
    got = listed(spark, f"{tmp_path}/r")
    for bucket, name in report.SECTIONS.items():
        assert got.get(name, []) == [r["json"] for r in report.section_documents(links, bucket).collect()], name
    for side, name in (("b", "baseline"), ("c", "candidate")):
        assert got[f"{name}.diagnostics"] == [r["json"] for r in report.diagnostic_documents(links, side).collect()]
    links.unpersist()


def test_the_command_writes_a_folder(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    (tmp_path / config.NAME).write_text(config.TEMPLATE)
    (tmp_path / "a.ts").write_text("debugger\n")
    messages = [{"ruleId": r, "severity": 2, "message": r, "line": 1, "column": 0} for r in ("no-debugger", "no-console")]
    (tmp_path / "b.json").write_text(json.dumps([{"filePath": "a.ts", "messages": messages}]))
    (tmp_path / "c.json").write_text(json.dumps([{"filePath": "a.ts", "messages": messages[:1]}]))
    args = ["compare", "lint", "a.ts", "--baseline", "eslint", "--candidate", "eslint", "--baseline-report", "b.json", "--candidate-report", "c.json", "--report-folder", f"{tmp_path}/out", "--no-save-report"]
    args[6] = "oxlint"
    (tmp_path / "c.json").write_text(json.dumps([{"filename": "a.ts", "code": "no-debugger", "message": "no-debugger", "severity": "error", "line": 1, "column": 0}]))
    assert cli.main(args, spark) == 1
    assert "report written" in capsys.readouterr().err
    got, manifest = listed(spark, f"{tmp_path}/out"), report_sink.manifest_of(spark, f"{tmp_path}/out")
    assert manifest["head"]["rawSummary"]["exactMatches"] == 1 and "matches" not in manifest["head"]
    assert len(got["matches"]) == 1 and len(got["baselineOnly"]) == 1 and len(got["baseline.diagnostics"]) == 2 and len(got["plan.discovered"]) == 1
    assert json.loads(got["matches"][0])["baseline"]["span"]["startColumn"] == 0
