"""Linters run by tasks: portions of about equal bytes, crashes as rows, and the same report as one run gives."""

import json
import stat
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from twinlens import cli
from twinlens.errors import ToolFailure
from twinlens.operators import matching
from twinlens.shared import Steps
from twinlens.sources import lint_runs, process

LINTER = """
    import json, os, sys
    if sys.argv[1:] == ["--version"]:
        print("1.2.3"); sys.exit()
    files = [a for a in sys.argv[1:] if not a.startswith("--") and a not in ("lint", "json")]
    with open({log!r}, "a") as f:
        f.write(json.dumps(files) + "\\n")
    out = []
    for f in files:
        for n, line in enumerate(open(f).read().split("\\n"), 1):
            if "CRASH" in line:
                sys.stderr.write("cannot read " + f); sys.exit(2)
            for mark, rule in {rules!r}:
                if mark in line:
                    out.append((f, n, rule, "found " + mark))
    if {name!r} == "eslint":
        print(json.dumps([{{"filePath": f, "messages": [{{"ruleId": r, "severity": 2, "message": m, "line": n, "column": 0}} for g, n, r, m in out if g == f]}} for f in files]))
    else:
        print(json.dumps({{"diagnostics": [{{"filename": f, "code": r, "severity": "error", "message": m, "line": n, "column": 0}} for f, n, r, m in out]}}))
    if any("WARN" in open(f).read() for f in files):
        sys.stderr.write("odd " + str(len(files)))
    sys.exit(1 if out else 0)
"""


@pytest.fixture
def project(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("PATH", "/usr/bin:/bin")
    (tmp_path / "twinlens.toml").write_text("version = 1\n[discovery]\ninclude = ['**/*.ts']\nexclude = []\n")
    for name, rules in (("eslint", [("no", "no-console"), ("dbg", "no-debugger")]), ("oxlint", [("dbg", "eslint(no-debugger)")])):
        path = tmp_path / "node_modules" / ".bin" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"#!{sys.executable}\n" + textwrap.dedent(LINTER).format(log=str(tmp_path / f"{name}.log"), name=name, rules=rules))
        path.chmod(path.stat().st_mode | stat.S_IEXEC)
    for i in range(40):
        (tmp_path / "src").mkdir(exist_ok=True)
        (tmp_path / "src" / f"f{i:02}.ts").write_text("x\n" * (i % 7 * 20) + ("dbg\n" if i % 3 == 0 else "") + ("no\n" if i % 5 == 0 else ""))
    return tmp_path


def tool_of(root, name="eslint"):
    return process.Tool(name, str(root / "node_modules" / ".bin" / name), "1.2.3", str(root), 20)


def files_of(spark, root):
    return spark.createDataFrame([(f"src/{p.name}", p.stat().st_size, "x") for p in sorted((root / "src").iterdir())], "path string, bytes long, portion string").repartition(3)


def test_portions_are_balanced_and_in_order(spark):
    sizes = {f"p{i:03}": (i * 37) % 101 for i in range(300)} | {"q": 5000, "r": None}
    files = spark.createDataFrame(list(sizes.items()), "path string, bytes long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((r["path"], r["portion"]) for r in lint_runs.portioned(files, 700, Steps(spark)).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total, want = 0, []
    for path in sorted(sizes):
        want.append((path, total // 700))
        total += sizes[path] or 0
    assert got == want


def test_runs_by_tasks_find_what_one_run_finds(spark, project):
    runs = lint_runs.lint_runs(files_of(spark, project), tool_of(project), size=400)
    rows = runs.collect()
    assert len(rows) > 5 and {r["status"] for r in rows} == {"ok"} and {r["exit_code"] for r in rows} <= {0, 1}
    asked = [json.loads(x) for x in (project / "eslint.log").read_text().splitlines()]
    assert sorted(f for part in asked for f in part) == [f"src/f{i:02}.ts" for i in range(40)] and len(asked) == len(rows)
    got = lint_runs.diagnostics(runs, "eslint", str(project)).select("path", "code", "start_line", "start_column").collect()
    _, text, _ = process.lint_once(tool_of(project), [f"src/f{i:02}.ts" for i in range(40)])
    want = {(f["filePath"], m["ruleId"], m["line"], 0) for f in json.loads(text) for m in f["messages"]}
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 15
    # reading the runs again runs nothing again
    assert runs.count() == len(rows) and len((project / "eslint.log").read_text().splitlines()) == len(asked) + 1


def test_a_crash_is_a_row(spark, project):
    (project / "src" / "f07.ts").write_text("CRASH\n")
    (project / "src" / "f20.ts").write_text("WARN\n")
    runs = lint_runs.lint_runs(files_of(spark, project), tool_of(project), size=400)
    failed = runs.where("status = 'failed'").collect()
    assert len(failed) == 1 and "cannot read src/f07.ts" in failed[0]["error"] and failed[0]["json"] is None
    assert runs.where("status = 'ok'").count() > 4 and runs.where(F.col("warning").startswith("ESLint stderr:")).count() == 1
    with pytest.raises(ToolFailure, match=r"f07\.ts"):
        lint_runs.run_document(runs, tool_of(project))


def test_command_lines_have_an_end(spark, project):
    runs = lint_runs.lint_runs(files_of(spark, project), tool_of(project), size=1 << 20, command=60)
    assert runs.count() == 8 and runs.select("report_id").distinct().count() == 8
    assert lint_runs.lint_runs(files_of(spark, project).limit(0), tool_of(project)).count() == 0


def test_the_command_gives_one_report_either_way(spark, project, capsys):
    args = ["compare", "lint", "--baseline", "eslint", "--candidate", "oxlint", "--output", "json", "--report-file", "r.json"]
    both = []
    for more in ([], ["--lint-tasks", "6"]):
        assert cli.main([*args, *more], spark) == 1
        both.append(json.loads((project / "r.json").read_text()))
        capsys.readouterr()
    one, many = both
    assert len((project / "oxlint.log").read_text().splitlines()) > 4
    for doc in both:
        for run in ("baseline", "candidate"):
            doc[run] = doc[run]["diagnostics"]
    assert one == many and one["rawSummary"]["exactMatches"] == 14 and matching.FIELDS
