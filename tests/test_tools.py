"""Commands against stand-ins for the tools: scripts that answer as the tools do."""

import json
import os
import stat
import sys
import textwrap

import pytest

from twinlens import cli
from twinlens.operators.capability import REFUSED_REASON
from twinlens.sources import process

#: A formatter: squeezes runs of '#', says what its mode asks for, and keeps a record of its runs.
FORMATTER = """
    import os, sys
    mode, marks = {mode!r}, {marks!r}
    if sys.argv[1:] == ["--version"]:
        print({version!r}); sys.exit()
    open({log!r}, "a").write(" ".join(sys.argv[1:]) + "\\n")
    text = sys.stdin.buffer.read().decode()
    if "CRASH" in text:
        sys.stdout.write("half"); sys.stderr.write("cannot read " + sys.argv[-1]); sys.exit(2)
    if "REFUSE" in text:
        sys.stderr.write("No parser could be inferred for file " + sys.argv[-1]); sys.exit(2)
    if "BYTES" in text:
        sys.stdout.buffer.write(b"\\xff"); sys.exit()
    if "SLEEP" in text:
        import time; time.sleep(30)
    if mode == "warn":
        sys.stderr.write("\\r\\n odd option \\r\\n")
    for m in marks:
        text = text.replace(m + m, m) if mode == "once" else m.join(x for x in text.split(m) if x or m not in text)
    sys.stdout.write(text if mode != "crlf" else text.replace("\\n", "\\r\\n"))
"""
#: A linter: reports lines with a mark, in the dialect of its tool.
LINTER = """
    import json, sys
    if sys.argv[1:] == ["--version"]:
        print("1.2.3"); sys.exit()
    open({log!r}, "a").write(" ".join(sys.argv[1:]) + "\\n")
    files = [a for a in sys.argv[1:] if not a.startswith("--") and a not in ("lint", "json")]
    out = []
    for f in files:
        for n, line in enumerate(open(f).read().split("\\n"), 1):
            for mark, rule in {rules!r}:
                if mark in line:
                    out.append((f, n, rule, "found " + mark))
    if {name!r} == "eslint":
        print(json.dumps([{{"filePath": f, "messages": [{{"ruleId": r, "severity": 2, "message": m, "line": n, "column": 1}} for g, n, r, m in out if g == f]}} for f in files]))
    else:
        print(json.dumps({{"diagnostics": [{{"filename": f, "code": r, "severity": "error", "message": m, "line": n, "column": 1}} for f, n, r, m in out]}}))
    sys.exit(1 if out else 0)
"""


@pytest.fixture
def project(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "twinlens.toml").write_text("version = 1\n[execution]\ntimeout_seconds = 5\nformatter_jobs = 2\n[discovery]\ninclude = ['**/*.ts', '**/*.json']\nexclude = []\n")

    def tool(name, template, **values):
        path = tmp_path / "node_modules" / ".bin" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"#!{sys.executable}\n" + textwrap.dedent(template).format(log=str(tmp_path / f"{name}.log"), name=name, **values))
        path.chmod(path.stat().st_mode | stat.S_IEXEC)

    def formatter(name, mode="squeeze", marks="#", version="1.0.0"):
        tool(name, FORMATTER, mode=mode, marks=marks, version=version)

    def write(name, text):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())

    return tmp_path, formatter, lambda name, rules: tool(name, LINTER, rules=rules), write


@pytest.fixture(autouse=True)
def _only_stand_ins(monkeypatch):
    """Nothing of the host's own tools may answer."""
    monkeypatch.setenv("PATH", "/usr/bin:/bin")


def format_args(*more):
    return ["compare", "format", "--baseline", "prettier", "--candidate", "biome", "--output", "json", "--report-file", "out/report.json", *more]


def saved(root):
    return json.loads((root / "out" / "report.json").read_text())


def test_format_rows_of_every_kind(spark, project, capsys):
    root, formatter, _, write = project
    formatter("prettier", "warn")
    formatter("biome", marks="")
    (root / "twinlens.toml").write_text((root / "twinlens.toml").read_text() + "[tools.biome]\nunsupported = ['**/none.ts']\n[tools.prettier]\nexclude = ['**/left.ts']\n")
    for name, text in {"same.ts": "a\n", "differs.ts": "a##b\n", "crash.ts": "CRASH", "bytes.ts": "BYTES", "none.ts": "x", "sub dir/left.ts": "y", "o.md": "no"}.items():
        write(f"src/{name}", text)
    before = {p: p.read_bytes() for p in (root / "src").rglob("*") if p.is_file()}
    assert cli.main(format_args("src"), spark) == 3
    printed = capsys.readouterr()
    doc = saved(root)
    assert json.loads(printed.out) == doc and "failed on 2 files" in printed.err
    assert {f["path"]: f["status"] for f in doc["files"]} == {
        "src/bytes.ts": "failed", "src/crash.ts": "failed", "src/differs.ts": "different", "src/none.ts": "unsupported", "src/same.ts": "identical", "src/sub dir/left.ts": "skipped"}
    by = {f["path"]: f for f in doc["files"]}
    assert [f["path"] for f in doc["files"]] == sorted(by) and before == {p: p.read_bytes() for p in before}
    crash = by["src/crash.ts"]["baseline"]
    assert (crash["exitCode"], crash["output"], crash["stderr"]) == (2, "half", "cannot read src/crash.ts") and "exit code 2" in crash["error"]
    assert "no UTF-8" in by["src/bytes.ts"]["candidate"]["error"]
    good = by["src/differs.ts"]["baseline"]
    assert good["warnings"] == ["Prettier stderr:\n odd option "] and good["arguments"] == ["--stdin-filepath", "src/differs.ts"] and good["version"] == "1.0.0" and good["idempotent"]
    assert by["src/differs.ts"]["diff"].startswith("--- baseline/src/differs.ts\n+++ candidate/src/differs.ts\n@@ -1 +1 @@\n-a#b\n+a##b\n")
    assert by["src/none.ts"]["candidate"] == {"status": "unsupported", "tool": "biome", "arguments": [], "reason": "declared unsupported by configuration"}
    assert by["src/none.ts"]["baseline"]["status"] == "skipped" and "not run" in by["src/none.ts"]["baseline"]["reason"]
    assert doc["summary"] | {"discovered": 6, "compared": 4, "identical": 1, "different": 1, "unsupported": 1, "skipped": 1, "failed": 2} == doc["summary"]
    assert len(doc["failures"]) == 4 and doc["failures"][2].startswith("src/crash.ts baseline Prettier: ") and doc["failures"][2].endswith("stdout: half\nstderr: cannot read src/crash.ts")
    assert [d["path"] for d in doc["plan"]["unsupported"]] == ["src/none.ts"] and [d["path"] for d in doc["plan"]["skipped"]] == ["src/sub dir/left.ts"]
    assert "none.ts" not in (root / "prettier.log").read_text() and "left.ts" not in (root / "biome.log").read_text()


@pytest.mark.parametrize(("policy", "code"), [("ignore", 0), ("difference", 1), ("error", 3)])
def test_unsupported_files_and_policies(spark, project, policy, code):
    root, formatter, _, write = project
    formatter("prettier")
    formatter("oxfmt", version="Version: 0.60.0")
    write("a.ts", "a\n")
    write("package-lock.json", "{}")
    args = ["compare", "format", "--baseline", "prettier", "--candidate", "oxfmt", "--report-file", "out/report.json", "--unsupported-policy", policy]
    assert cli.main(args, spark) == code
    doc = saved(root)
    assert [d["reason"] for d in doc["plan"]["unsupported"]] == [REFUSED_REASON] and doc["summary"]["unsupported"] == 1 and doc["failures"] == []


def test_refusals_at_run_time():
    known = process.Tool("oxfmt", "x", "oxfmt v0.60.0", ".", 5)
    text = "No parser could be inferred for file a"
    assert process.refusal(known, "x/package-lock.json", text) == REFUSED_REASON
    for t, path, told in ((known, "x/other.json", text), (known, "package-lock.json", "else"), (process.Tool("oxfmt", "x", "0.61.0", ".", 5), "package-lock.json", text), (process.Tool("biome", "x", "0.60.0", ".", 5), "package-lock.json", text)):
        assert process.refusal(t, path, told) is None


def test_line_ends_and_idempotency(spark, project):
    root, formatter, _, write = project
    formatter("prettier", "crlf")
    formatter("biome", marks="")
    write("a.ts", "a\nb\n")
    assert cli.main(format_args(), spark) == 1
    assert saved(root)["files"][0]["status"] == "baseline_non_idempotent"
    formatter("prettier", "once", "#")
    write("a.ts", "a####b\n")
    assert cli.main(format_args("a.ts"), spark) == 1 and saved(root)["summary"]["baselineNonIdempotent"] == 1


def test_a_slow_tool_is_a_failed_row(spark, project):
    root, formatter, _, write = project
    (root / "twinlens.toml").write_text("version = 1\n[execution]\ntimeout_seconds = 1\n")
    formatter("prettier")
    formatter("biome")
    write("a.ts", "SLEEP")
    assert cli.main(format_args(), spark) == 3
    assert "timed out after 1 s" in saved(root)["files"][0]["baseline"]["error"]


def test_plan_runs_no_tool(spark, project, capsys):
    root, formatter, linter, write = project
    linter("eslint", [])
    write("a.ts", "x")
    (root / "twinlens.toml").write_text("version = 1\n[[matching.rules]]\nbaseline_tool = 'biome'\nbaseline = 'lint/x'\ncandidate_tool = 'eslint'\ncandidate = 'y'\nconfidence = 'approximate'\nnotes = 'why'\n")
    assert cli.main(["plan", "lint", "--baseline", "eslint", "--candidate", "biome", "--report-file", "out/report.json"], spark) == 0
    doc, text = saved(root), capsys.readouterr().out
    assert doc["mode"] == "lint" and doc["configuredRuleMappings"] == {"exact": 0, "approximate": 1} and doc["plan"]["comparable"] == ["a.ts"]
    assert doc["ruleMappings"] == [{"baselineTool": "eslint", "baseline": "y", "candidateTool": "biome", "candidate": "lint/x", "confidence": "approximate", "notes": "why"}]
    assert [t["available"] for t in doc["plan"]["tools"]] == [True, False] and "No Biome" in text and "eslint:y <-> biome:lint/x" in text
    assert not (root / "eslint.log").exists()
    assert cli.main(["compare", "lint", "--baseline", "eslint", "--candidate", "biome"], spark) == 3


def test_lint_report(spark, project, capsys):
    root, _, linter, write = project
    linter("eslint", [("AA", "no-debugger"), ("BB", "plug/own")])
    linter("oxlint", [("AA", "eslint(no-debugger)"), ("CC", "eslint(no-console)")])
    write("src/a.ts", "AA\nBB\nCC\n")
    write("src/b.ts", "AA\n")
    args = ["compare", "lint", "src", "--baseline", "eslint", "--candidate", "oxlint", "--report-file", "out/report.json"]
    assert cli.main(args, spark) == 1
    doc, text = saved(root), capsys.readouterr().out
    assert [m["kind"] for m in doc["matches"]] == ["exact_match"] * 2 and [m["baseline"]["path"] for m in doc["matches"]] == ["src/a.ts", "src/b.ts"]
    assert [d["code"] for d in doc["unmappedBaseline"]] == ["plug/own"] and [d["code"] for d in doc["candidateOnly"]] == ["eslint(no-console)"] and doc["baselineOnly"] == []
    assert doc["mappingSummary"]["observedBaselineRuleIds"] == ["no-debugger", "plug/own"] and doc["mappingSummary"]["unmappedBaselineRuleIds"] == ["plug/own"]
    assert {"tool": "oxlint", "code": "eslint(no-debugger)"} in doc["mappingSummary"]["exactMappedRuleIds"]
    assert list(doc) == [
        "schemaVersion", "mode", "profile", "projectRoot", "plan", "baseline", "candidate", "rawSummary", "comparableSummary", "mappingSummary", "matches", "baselineOnly", "candidateOnly", "unmappedBaseline", "unmappedCandidate",
        "unsupportedFiles", "skippedFiles", "failures"]
    run = doc["baseline"]
    assert run["arguments"] == ["--format", "json", "src/a.ts", "src/b.ts"] and run["exitCode"] == 1 and len(run["diagnostics"]) == 3 and list(run["diagnostics"][0]) == ["tool", "path", "code", "canonicalCode", "severity", "message", "span", "fingerprint"]
    assert "Unmapped baseline\n  src/a.ts:2:1  plug/own\n    found BB\n" in text and "Candidate only" in text
    linter("oxlint", [("AA", "eslint(no-debugger)")])
    assert cli.main([*args, "--profile", "comparable"], spark) == 0 and cli.main(args, spark) == 1


def test_lint_failures(spark, project, capsys):
    root, _, linter, write = project
    linter("eslint", [])
    write("a.ts", "x")
    bad = root / "node_modules" / ".bin" / "oxlint"
    for code, text, told in ((2, "", "exit code: 2"), (1, "", "without a report"), (0, "no json", "JSON")):
        bad.write_text(f"#!/bin/sh\nprintf '{text}'\nprintf 'own words' >&2\nexit {code}\n")
        bad.chmod(0o755)
        if told != "JSON":
            assert cli.main(["compare", "lint", "--baseline", "eslint", "--candidate", "oxlint"], spark) == 3
            error = capsys.readouterr().err
            assert told in error and "own words" in error and "command: " in error
        else:
            with pytest.raises(Exception, match="no JSON"):
                cli.main(["compare", "lint", "--baseline", "eslint", "--candidate", "oxlint"], spark)


def test_many_files_run_in_portions(project):
    root, _, linter, write = project
    linter("oxlint", [("A", "r")])
    names = [f"f{i}.ts" for i in range(9)]
    for n in names:
        write(n, "A\n")
    from twinlens.sources import config

    done = process.lint(config.load(), "oxlint", names, portion=15)
    assert len(done.reports) == 5 and len((root / "oxlint.log").read_text().splitlines()) == 5
    assert [d["filename"] for r in done.reports for d in json.loads(r)["diagnostics"]] == names


def test_discovery(spark, project):
    root, formatter, _, write = project
    formatter("prettier")
    formatter("biome")
    for name in ("a.ts", "build/b.ts", "sub/c.ts", "sub/keep/d.ts", "e.ts", "deep/x/f.ts", "out/report.json", "deep/_own.ts", ".dot/g.ts"):
        write(name, "x\n")
    write(".gitignore", "e.ts\nsub/*\n!sub/keep\n")
    write("deep/.ignore", "x/\n")
    os.symlink(root / "a.ts", root / "link.ts")
    os.symlink(root / "sub", root / "again")

    def paths(*args):
        assert cli.main(format_args(*args), spark) == 0
        return [f["path"] for f in saved(root)["files"]]

    assert paths() == [".dot/g.ts", "a.ts", "deep/_own.ts", "e.ts", "sub/c.ts", "sub/keep/d.ts"]  # no work tree: .gitignore is without effect
    (root / ".git").mkdir()
    assert paths() == [".dot/g.ts", "a.ts", "deep/_own.ts", "sub/keep/d.ts"]
    assert paths("build/b.ts", "e.ts") == ["build/b.ts", "e.ts"]
    assert paths("sub") == ["sub/keep/d.ts"]
    write("z.md", "x")
    assert cli.main(format_args("z.md"), spark) == 2 and cli.main(format_args("gone"), spark) == 2


def reduce_args(mode, b, c, *more):
    return ["reduce", "src/case.ts", "--mode", mode, "--baseline", b, "--candidate", c, "--report-file", "out/report.json", *more]


def test_lint_reduction(project, capsys):
    root, _, linter, write = project
    linter("eslint", [("AA", "no-debugger"), ("BB", "no-console")])
    linter("oxlint", [("BB", "eslint(no-console)")])
    write("src/case.ts", "x\nBB\ny\nAA first\nz\nAA second\n")
    assert cli.main(reduce_args("lint", "eslint", "oxlint")) == 1
    assert (root / "src" / "case.reduced.ts").read_text() in ("AA first\n", "AA second\n") and sorted(os.listdir(root / "src")) == ["case.reduced.ts", "case.ts"]
    doc = saved(root)
    assert doc["signature"] == {"side": "baseline", "category": "baseline_only", "canonicalCode": "no-debugger", "baseline": {"canonicalCode": "no-debugger", "message": "found AA", "severity": "error"}}
    assert (doc["originalLines"], doc["reducedLines"], doc["originalBytes"]) == (6, 1, 28) and doc["attempts"] >= 3 and "attempts" in capsys.readouterr().out
    assert cli.main(reduce_args("lint", "eslint", "oxlint", "--mismatch", "2")) == 2 and "the comparison has 2" in capsys.readouterr().err
    assert cli.main(reduce_args("lint", "prettier", "oxlint")) == 2 and cli.main(reduce_args("lint", "eslint", "oxlint", "--timeout", "0")) == 2
    assert cli.main(reduce_args("lint", "eslint", "oxlint", "--output", "src/case.ts")) == 2


def test_format_reduction(project, capsys):
    root, formatter, _, write = project
    formatter("prettier")
    formatter("biome", marks="")
    write("src/case.ts", "x\ny##\nz\n")
    assert cli.main(reduce_args("format", "prettier", "biome", "--output", "small.ts")) == 1
    assert (root / "small.ts").read_text() == "y##\n" and saved(root)["signature"]["category"] == "different"
    write("src/case.ts", "CRASH\n")
    assert cli.main(reduce_args("format", "prettier", "biome")) == 3
    write("src/case.ts", "SLEEP")
    assert cli.main(reduce_args("format", "prettier", "biome", "--timeout", "1")) == 3 and "timed out after 1 s" in capsys.readouterr().err


def test_doctor_and_init(project, capsys):
    root, formatter, _, _ = project
    formatter("biome", version="2.0\nmore")
    assert cli.main(["doctor"]) == 0
    told = capsys.readouterr().out
    assert "Biome: " in told and "2.0\n" in told and "ESLint: not found" in told
    (root / "twinlens.toml").write_text("version = 1\n[tools.oxlint]\ncommand = 'nowhere/oxlint'\n")
    assert cli.main(["doctor"]) == 3
    assert cli.main(["--config", "other.toml", "init"]) == 0 and "**/*.mjs" in (root / "other.toml").read_text() and "**/*.jsonc" in (root / "other.toml").read_text()


def test_conflicting_options(spark, project):
    assert cli.main(format_args("--no-save-report"), spark) == 2
    assert cli.main(["compare", "format", "--baseline", "biome", "--candidate", "biome"], spark) == 2
