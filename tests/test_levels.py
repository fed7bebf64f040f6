"""Reduction of many cases in rounds against the sequential rule, text by text and attempt by attempt."""

import random
import re

import pytest
from pyspark.sql import functions as F

from twinlens.operators import levels, reduction
from twinlens.operators.mappings import Mappings
from twinlens.plans import plan_queries

CASES = "case_id long, text string, row int, seen string, turn int"


def told(tool, rules):
    """The sequential linter of rules over a line: name to a function that gives (column, severity) or nothing."""

    def run(text):
        out = []
        for n, line in enumerate(text.split("\n")):
            for k, (code, look) in enumerate(rules.items()):
                found = look(line)
                if found:
                    out.append({"tool": tool, "path": "text", "code": code, "severity": found[1], "message": line, "start_line": n + 1, "start_column": found[0], "tie": n * len(rules) + k})
        return out

    return run


def having(mark):
    return lambda line: (1, "warning") if mark in line else None


SEQUENTIAL = reduction.LintMismatches(
    told("eslint", {"no-stars": having("***"), "no-hash": having("###")}),
    told("biome", {"lint/a/noHash": lambda line: (2 - len(line) % 2, "error" if "e" in line else "warning") if "###" in line else None, "lint/a/noBang": having("!!")}),
    "eslint", "biome",
)


def texts(seed, n):
    rng = random.Random(seed)
    lines = ["a", "", "one ***", "two ***", "### x", "### xe", "###", "b !!", "c !! ***", "### !!", "plain", "é"]
    out = [None, "", "\n", "***", "***\n", "\n***", "a\n" * 40, "a\n" * 20 + "!!" + "\nb" * 21]
    return out + ["\n".join(rng.choices(lines, weights=[6, 2, 1, 1, 1, 1, 1, 1, 1, 1, 6, 2], k=rng.randint(1, 40))) + rng.choice(["", "\n"]) for _ in range(n)]


def sequential(cases, signatures, mismatch):
    out = []
    for case, text in cases:
        found = signatures(text) if text is not None else []
        if mismatch < len(found):
            memo = reduction.Memo(reduction.keeps(signatures, found[mismatch]), text)
            small = reduction.minimise(text, memo)
            out.append((case, found[mismatch].category, small, memo.attempts, len(reduction.line_pieces(text)) if text else 0, len(text.encode())))
    return sorted(out, key=str)


@pytest.mark.parametrize(("mismatch", "window"), [(0, 32), (2, 3)])
def test_lint_rounds_are_the_sequential_rule(spark, mismatch, window):
    cases = list(enumerate(texts(mismatch, 40)))
    cases += [cases[20], (None, cases[21][1])]
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in cases], CASES)
    got = [(r["case_id"], r["category"], r["text"], r["attempts"], r["original_lines"], r["original_bytes"]) for r in levels.reduce_cases(df, plan_queries.RULES, mismatch, window).collect()]
    want = sequential(cases, SEQUENTIAL, mismatch)
    assert sorted(got, key=str) == want and len(want) > 10


def test_format_rounds_are_the_sequential_rule(spark):
    upper, once = lambda c: F.replace(c, F.lit("q"), F.lit("Q")), lambda c: F.regexp_replace(c, "zz", "z")
    plain = reduction.FormatMismatches(reduction.plain_outcome(lambda t: t.replace("q", "Q")), reduction.plain_outcome(lambda t: re.sub("zz", "z", t)))
    rng = random.Random(3)
    cases = [(k, "\n".join("".join(rng.choices("abqz", weights=[9, 9, 1, 4], k=3)) for _ in range(rng.randint(1, 25)))) for k in range(40)]
    got = [(r["case_id"], r["category"], r["text"], r["attempts"], r["original_lines"], r["original_bytes"]) for r in levels.reduce_cases(spark.createDataFrame(cases, "case_id long, text string"), levels.format_comparison(upper, once), window=4).collect()]
    assert sorted(got, key=str) == sequential(cases, plain, 0)


def test_no_cases(spark):
    assert levels.reduce_cases(spark.createDataFrame([], CASES), plan_queries.RULES).collect() == []
    assert levels.reduce_cases(spark.createDataFrame([(1, "nothing", 1, "", 1)], CASES), plan_queries.RULES).collect() == []


def test_pieces(spark):
    for text in ("", "\n", "a", "a\n", "a\n\nb", "\n\n"):
        got = spark.range(1).select(levels.pieces(F.lit(text)).alias("p")).first()["p"]
        assert got == reduction.line_pieces(text)


def test_mappings_go_along(spark):
    """A configured pair takes part in the comparison of every candidate."""
    mapped = Mappings(rules=[{"baseline_tool": "eslint", "baseline": "no-stars", "candidate_tool": "biome", "candidate": "lint/a/noBang", "confidence": "approximate"}])
    compared = levels.lint_comparison(plan_queries.linters, mapped, "eslint", "biome")
    rows = levels.reduce_cases(spark.createDataFrame([(1, "x\nc *** !!\ny\n"), (2, "a\nb ***\nc")], "case_id long, text string"), compared).collect()
    assert {(r["case_id"], r["category"], r["text"]) for r in rows} == {(1, "approximate_rule_match", "c *** !!\n"), (2, "baseline_only", "b ***\n")}
