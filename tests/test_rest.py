import subprocess

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinlens import cli
from twinlens.errors import UsageError
from twinlens.functions import globs, scalars
from twinlens.operators import capability, formatting, reduction, report
from twinlens.sources import config, reports


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("path", "expected"), [("/project/one/./two/../b.ts", "one/b.ts"), ("../a", "../a"), ("a/../..", ".."), ("/other/x", "other/x"), ("/project", "."), ("x//y/.", "x/y")])
def test_paths(spark, path, expected):
    assert one(spark, scalars.normalize_path(F.col("p"), "/project"), p=path) == expected


def test_positions(spark):
    for offset, want in ((0, (1, 1)), (2, (1, 3)), (3, (2, 1)), (99, (2, 4))):
        assert tuple(one(spark, scalars.offset_position(F.col("t"), F.lit(offset)), t="é\nabc")) == want


def test_globs():
    import re

    match = lambda g, p: bool(re.match(globs.globs_regex([g]), p))
    assert match("**/lock.json", "lock.json") and match("**/lock.json", "a/b/lock.json") and match("*.ts", "a/b.ts")
    assert match("src/{a,b}?.[!t]s", "src/a1.js") and not match("src/{a,b}?.[!t]s", "src/a1.ts")
    for bad in ("[a", "{a", "a}"):
        with pytest.raises(UsageError):
            globs.globs_regex([bad], "f")


def test_classification(spark):
    s = {"unsupported": ["**/lock.json"], "exclude": ["**/lock.json", "gen/**"], "include": ["src/**", "gen/**", "lock.json"]}
    for path, want in (("lock.json", "unsupported"), ("gen/a.ts", "skipped"), ("b.ts", "skipped"), ("src/a.TS", "supported"), ("src/a.vue", "unknown")):
        assert one(spark, capability.classify(F.col("p"), "biome", s), p=path)["status"] == want
    for v, want in (("Version: v0.60.0", "unsupported"), ("0.61.0", "unknown")):
        assert one(spark, capability.classify(F.col("p"), "oxfmt", None, F.lit(v)), p="x/package-lock.json")["status"] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12), st.booleans())
def test_diffs_apply(tmp_path_factory, a, b, final):
    left, right = "\n".join(a) + ("\n" if final and a else ""), "\n".join(b) + ("\n" if b else "")
    script = formatting.edit_script(left.splitlines(True), right.splitlines(True))
    assert [left.splitlines(True)[i] for op, i, _ in script if op != "+"] == left.splitlines(True)
    assert [right.splitlines(True)[j] if op == "+" else left.splitlines(True)[i] for op, i, j in script if op != "-"] == right.splitlines(True)


def test_patch(tmp_path):
    left, right = "".join(f"{i}\n" for i in range(30)), "".join(f"{i}\n" for i in range(30) if i not in (3, 20)) + "end"
    (tmp_path / "f").write_text(left)
    (tmp_path / "d").write_text(formatting.diff_text("f", left, right))
    done = subprocess.run(["git", "apply", "--unsafe-paths", "-p1", "d"], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert (tmp_path / "f").read_text() == right
    assert formatting.diff_text("f", left, left) == ""


def test_reduction_of_one_text():
    text = "a\nb\nKEEP\nc\nd\n"
    memo = reduction.Memo(lambda t: "KEEP" in t, text)
    assert reduction.minimise(text, memo) == "KEEP\n" and memo.attempts == len(memo.seen) - 1


def test_config(tmp_path):
    (tmp_path / "twinlens.toml").write_text(config.TEMPLATE)
    assert config.load(cwd=str(tmp_path)).values["execution"]["formatter_jobs"] == 4
    rule = {"baseline_tool": "eslint", "baseline": "a", "candidate_tool": "biome", "candidate": "b", "confidence": "exact"}
    flipped = {"baseline_tool": "biome", "baseline": "B", "candidate_tool": "eslint", "candidate": "A", "confidence": "exact"}
    for rules in ([rule, flipped], [rule, rule | {"candidate": "c"}], [rule | {"candidate_tool": "eslint"}], [rule | {"candidate_tool": "oxfmt"}], [rule | {"baseline": " "}]):
        with pytest.raises(UsageError):
            config.validate(config.merged({"version": 1, "matching": {"rules": rules}}))
    for bad in ({"version": 2}, {"version": 1, "x": {}}, {"version": 1, "execution": {"timeout_seconds": 0}}, {"version": 1, "discovery": {"include": ["[a"]}}):
        with pytest.raises(UsageError):
            config.validate(config.merged(bad))


def test_blank_and_broken_reports(spark):
    blank = spark.createDataFrame([(0, " ")], "report_id long, json string")
    assert reports.flat_reports(blank, "/p").count() == 0 and reports.walked_reports(blank, "/p", "oxlint").count() == 0
    with pytest.raises(Exception, match="no JSON"):
        reports.walked_reports(blank, "/p", "biome").collect()
    with pytest.raises(Exception, match="messages"):
        reports.flat_reports(spark.createDataFrame([(0, '[{"filePath": "a"}]')], "report_id long, json string"), "/p").collect()


def test_command(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.ts").write_text("debugger;\n")
    (tmp_path / "b.json").write_text('[{"filePath": "src/a.ts", "messages": [{"ruleId": "no-debugger", "severity": 2, "message": "m", "line": 1, "column": 1}]}]')
    (tmp_path / "c.json").write_text('{"diagnostics": [{"filename": "src/a.ts", "code": "eslint(no-debugger)", "severity": "error", "message": "m", "line": 1, "column": 1}]}')
    args = ["compare", "lint", "src", "--baseline", "eslint", "--candidate", "oxlint", "--baseline-report", "b.json", "--candidate-report", "c.json", "--output", "json", "--report-file", "r.json"]
    assert cli.main(args, spark) == 0
    assert '"exactMatches": 1' in (tmp_path / "r.json").read_text() and "exactAgreement" in capsys.readouterr().out
    assert cli.main([*args[:3], "--baseline", "eslint", "--candidate", "eslint"], spark) == 2
    assert cli.main(["compare", "lint", "gone", *args[3:]], spark) == 2
    assert cli.main(["init"], spark) == 0 and cli.main(["init"], spark) == 2


def test_report_documents(spark):
    assert report.camel({"exact_matches": 1, "none": None}) == {"exactMatches": 1}


def test_registered_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 50
