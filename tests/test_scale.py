"""Large groups, long diffs, the linkage on the driver against the one over tables, and running counts."""

import random
import subprocess
import time
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinlens.errors import OperationalError
from twinlens.functions import text as single
from twinlens.functions import scalars
from twinlens.operators import formatting, matching, reduction
from twinlens.operators.mappings import Mappings
from twinlens.sources import reports
from twinlens.streaming import live

FIELDS = "side string, tool string, path string, code string, severity string, message string, start_line long, start_column long, end_line long, end_column long, tie long"
MAPPED = Mappings(rules=[{"baseline_tool": "eslint", "baseline": "own", "candidate_tool": "biome", "candidate": "lint/x/other", "confidence": "approximate"}])


def plain_pick(b, c, conf):
    free, out = set(range(len(c))), []
    for i, (bl, bc) in enumerate(b):
        best = None
        for j in sorted(free):
            cl, cc = c[j]
            if conf is not None and conf[i][j] < 0:
                continue
            d = (0, 0) if bl < 0 and cl < 0 else (matching.NO_POSITION,) * 2 if bl < 0 or cl < 0 else (abs(bl - cl), abs(bc - cc))
            key = (*d, 0 if conf is None else int(conf[i][j]), j)
            best = key if best is None or key < best else best
        if best is None:
            out.append((-1, 0))
        else:
            free.discard(best[3])
            out.append((best[3], best[2]))
    return out


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 14), st.integers(1, 14), st.booleans())
def test_indexed_pick(seed, nb, nc, mapped):
    rng = np.random.default_rng(seed)
    top = int(rng.integers(1, 12))
    b, c = (np.stack([rng.integers(-1, top, n), rng.integers(1, top + 1, n)], axis=1) for n in (nb, nc))
    c = c[np.lexsort((c[:, 1], np.where(c[:, 0] < 0, matching.NO_POSITION, c[:, 0])))]
    conf = rng.integers(-1, 2, (nb, nc)) if mapped else None
    want = plain_pick(b.tolist(), c.tolist(), conf)
    assert matching.pick_indexed(b[:, 0], b[:, 1], c[:, 0], c[:, 1], conf) == want == matching.pick(b[:, 0], b[:, 1], c[:, 0], c[:, 1], conf)


def test_a_group_of_a_hundred_thousand_rows(spark):
    n = 50_000
    rows = spark.range(2 * n).select(
        F.when(F.col("id") < n, "baseline").otherwise("candidate").alias("side"), F.when(F.col("id") < n, "eslint").otherwise("biome").alias("tool"), F.lit("one.ts").alias("path"), F.lit("no-console").alias("code"),
        F.lit("error").alias("severity"), F.lit("m").alias("message"), (F.col("id") % n / 10).cast("long").alias("start_line"), (F.col("id") % 10 + 1).alias("start_column"), F.lit(None).cast("long").alias("end_line"),
        F.lit(None).cast("long").alias("end_column"), F.col("id").alias("tie"),
    )
    began = time.time()
    got = matching.linked(rows, Mappings(), "eslint", "biome").groupBy("bucket", "kind").count().collect()
    assert [(r.bucket, r.kind, r["count"]) for r in got] == [("match", "exact_match", n)] and time.time() - began < 60


@pytest.mark.parametrize("mappings", [Mappings(), MAPPED])
def test_linkage_on_the_driver_is_that_over_tables(spark, mappings):
    rng = random.Random(7)
    codes = {"eslint": ["no-console", "own", "plug/x", None, "eqeqeq"], "biome": ["lint/s/noConsole", "lint/x/other", "lint/y/x", None, "lint/z/eqeqeq"]}
    rows = []
    for k in range(300):
        side = rng.choice(["baseline", "candidate"])
        tool = "eslint" if side == "baseline" else "biome"
        line = rng.choice([None, *range(1, 9)])
        rows.append((side, tool, rng.choice(["a.ts", "b.ts", "c.ts"]), rng.choice(codes[tool]), rng.choice(["error", "warning"]), rng.choice(["m", "n", 'q "x" \\ y']), line, None if line is None else rng.randint(1, 4), None, None, k))
    names = [x.split()[0] for x in FIELDS.split(", ")]
    dicts = [dict(zip(names, r, strict=True)) for r in rows]
    local = matching.local_links([d for d in dicts if d["side"] == "baseline"], [d for d in dicts if d["side"] == "candidate"], mappings, "eslint", "biome")
    links = matching.linked(spark.createDataFrame(rows, FIELDS), mappings, "eslint", "biome")
    tie = lambda d: None if d is None else d["tie"]
    got = {(r.bucket, r.kind, r.confidence, tie(r.b), tie(r.c)) for r in links.collect()}
    assert got == {(x["bucket"], x["kind"], x["confidence"], tie(x["b"]), tie(x["c"])) for x in local} and len(local) == len(got)
    prints = {r.tie: r.fingerprint for s in ("b", "c") for r in links.where(f"{s} IS NOT NULL").select(f"{s}.tie", f"{s}.fingerprint").collect()}
    assert prints == {d["tie"]: d["fingerprint"] for x in local for d in (x["b"], x["c"]) if d}
    one = [x for x in local if (x["b"] or x["c"])["path"] == "a.ts"]
    want = sorted((m.side, m.category, m.code or "", *(m.baseline or ()), *(m.candidate or ())) for m in reduction.local_mismatches(one))
    found = reduction.mismatches(links.where("path = 'a.ts'")).collect()
    assert sorted(map(str, ((r.side, r.category, r.code or "", *(r.baseline or ()), *(r.candidate or ())) for r in found))) == sorted(map(str, want))


def test_a_mismatch_that_is_not_there(spark):
    rows = [("baseline", "eslint", "a.ts", "no-console", "error", "m", 1, 1, None, None, 0)]
    links = matching.linked(spark.createDataFrame(rows, FIELDS), Mappings(), "eslint", "biome")
    assert reduction.nth_mismatch(links, "baseline_only", 0).count() == 1
    with pytest.raises(OperationalError, match="has 1 of baseline_only"):
        reduction.nth_mismatch(links, "baseline_only", 1)


FLAT = """[{"filePath": "/project/src/a.ts", "messages": [{"ruleId": "no-debugger", "severity": 2, "message": "Unexpected", "line": 2, "column": 3, "endLine": 2, "endColumn": 11, "fix": {"range": [18, 26], "text": ""}},
    {"ruleId": "@plugin/no-unused-vars", "severity": 1, "message": "x unused", "line": 3}, {"ruleId": 7, "severity": -1, "line": "2"}]}, {"messages": []}]"""
NESTED = """{"summary": {"errors": 1}, "diagnostics": [{"category": "lint/suspicious/noConsole", "severity": "warning", "description": "No console.", "location": {"path": {"file": "src/a.ts"}, "start": {"line": 1, "column": 7}, "end": {"line": 1}}, "extra": [1]},
    {"code": {"value": "lint/style/x", "url": "u"}, "message": [{"content": "a "}, {"text": ["b"]}], "location": {"path": "src/b.ts", "range": {"start": {"lineNumber": 4, "columnNumber": 2}}}},
    {"category": 5, "code": "y", "severity": "fatal", "location": {"sourceCode": "é\\nabc", "span": [4, 6]}}]}"""
LABELLED = """{"diagnostics": [{"filename": "src/a.ts", "code": "eslint(no-debugger)", "severity": "error", "message": "d", "line": 2, "column": 3}, {"filename": "src/a.ts", "code": {"name": "z"}, "message": "e", "labels": [{"span": {"offset": 4, "length": 2}}]},
    {"filename": "src/none.ts", "ruleId": "q", "message": "f", "span": {"offset": 1}}], "number_of_files": 1}"""


def test_local_reports_are_the_scanned_ones(spark):
    for tool, text in (("eslint", FLAT), ("biome", NESTED), ("oxlint", LABELLED)):
        one = spark.createDataFrame([(0, text)], "report_id long, json string")
        sources = spark.createDataFrame([("src/a.ts", "é\nabc")], "path string, text string")
        rows = reports.flat_reports(one, "/project") if tool == "eslint" else reports.walked_reports(one, "/project", tool, sources)
        names = ["path", "code", "severity", "message", "start_line", "start_column", "end_line", "end_column"]
        local = reports.local_reports(text, "/project", tool, {"src/a.ts": "é\nabc"})
        assert [tuple(r[n] for n in names) for r in rows.orderBy("tie").collect()] == [tuple(d[n] for n in names) for d in local]


def test_unlike_files_of_twenty_thousand_lines():
    left, right = ("".join(f"{s}{i}\n" for i in range(20_000)) for s in "ab")
    tracemalloc.start()
    began = time.time()
    diff = formatting.diff_text("f", left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert diff.count("\n-a") == 20_000 and diff.count("\n+b") == 20_000 and time.time() - began < 20 and peak < 60e6
    order = list(range(4000))
    random.Random(1).shuffle(order)
    script = formatting.edit_script([str(i) for i in range(4000)], [str(i) for i in order])
    assert [j for op, _, j in script if op != "-"] == list(range(4000)) and [i for op, i, _ in script if op != "+"] == list(range(4000))


def common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("farthest", [0, 3, 1000])
def test_scripts_are_shortest_whatever_the_order(monkeypatch, farthest):
    """The number of kept lines is that of a dynamic programme, on permuted and repeated lines, where rows of bits split the script too."""
    monkeypatch.setattr(formatting, "FARTHEST", farthest)
    rng = random.Random(farthest)
    for _ in range(60):
        n = rng.randint(0, 70)
        a = [str(rng.randint(0, rng.choice([3, 20, 90]))) for _ in range(n)]
        b = rng.sample(a, len(a)) if rng.random() < 0.5 else [str(rng.randint(0, 20)) for _ in range(rng.randint(0, 70))]
        script = formatting.edit_script(a, b)
        assert [a[i] for op, i, _ in script if op != "+"] == a and [b[j] for op, _, j in script if op != "-"] == b
        assert sum(op == " " for op, _, _ in script) == common_length(a, b) and all(a[i] == b[j] for op, i, j in script if op == " ")


def test_a_permutation_of_twenty_thousand_lines():
    order = list(range(20_000))
    random.Random(4).shuffle(order)
    began = time.time()
    script = formatting.edit_script([str(i) for i in range(20_000)], [str(i) for i in order])
    tails = []  # the longest rising run of a permutation, by patience sorting
    for x in order:
        k = int(np.searchsorted(tails, x))
        tails[k : k + 1] = [x]
    assert sum(op == " " for op, _, _ in script) == len(tails) and time.time() - began < 60


@pytest.mark.parametrize(("left", "right"), [("a\x0cb\nc\n", "a\x0cc\nc\n"), ("x y\nz", "x q\nz"), ("p\x85q\n", "p\x85r"), ("a\r\nb\r\n", "a\r\nc\r\n"), ("", "one\n"), ("one", "")])
def test_diffs_with_odd_characters_apply(tmp_path, left, right):
    (tmp_path / "f").write_bytes(left.encode())
    (tmp_path / "d").write_bytes(formatting.diff_text("f", left, right).encode())
    done = subprocess.run(["git", "apply", "--unsafe-paths", "-p1", "d"], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert (tmp_path / "f").read_bytes().decode() == right


def test_lines():
    assert single.lines("a\r\nb\rc\n\x0cd e") == ["a\r\n", "b\r", "c\n", "\x0cd e"] and single.lines("") == []


def test_twins_on_the_driver(spark):
    cases = ["/project/a/../b", "x/./y", "../..", "/project", "", "//project//q/", "/other/z"]
    df = spark.createDataFrame([(c,) for c in cases], "p string")
    assert [r[0] for r in df.select(scalars.normalize_path(F.col("p"), "/project")).collect()] == [single.normalize_path(c, "/project") for c in cases]
    told = [" \n\t\n", "\r\n a \r\n\r\n", "x" * 5000, " \n", "one\rtwo"]
    df = spark.createDataFrame([(c,) for c in told], "p string")
    assert [r[0] for r in df.select(scalars.success_stderr(F.lit("biome"), F.col("p"))).collect()] == [single.success_warning("biome", c) for c in told]


def test_running_counts(spark, tmp_path):
    rows = [("2024-01-01 10:05:00", "baseline", "lint/s/noConsole", "error"), ("2024-01-01 10:55:00", "baseline", "no-console", "error"), ("2024-01-01 11:01:00", "candidate", "x", "warning")]
    schema = "ts timestamp, side string, code string, severity string"
    spark.createDataFrame(rows, "ts string, side string, code string, severity string").write.json(str(tmp_path / "in"))
    counts = live.severity_counts(spark.readStream.schema(schema).json(str(tmp_path / "in")), Mappings())
    query = counts.writeStream.outputMode("complete").format("memory").queryName("running").start()
    try:
        query.processAllAvailable()
        got = {(r.window.start.hour, r.side, r.canonical_code, r.severity, r["count"]) for r in spark.table("running").collect()}
        assert got == {(10, "baseline", "no-console", "error", 2), (11, "candidate", "x", "warning", 1)}
    finally:
        query.stop()
