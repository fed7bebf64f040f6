"""Overlapping spans against all pairs, whatever their lengths and however hot a line, and probable matches."""

import random

import pytest
from pyspark.sql import functions as F

from twinlens.operators import matching, overlap, scoring
from twinlens.operators.mappings import Mappings

SPANS = "id long, path string, start_line long, end_line long, level int, bucket int"


def plain_pairs(left, right):
    out = []
    for i, p, a, z in left:
        for j, q, b, y in right:
            if p is not None and p == q and a is not None and b is not None and (a == b or (a <= (b if y is None else y) and b <= (a if z is None else z))):
                out.append((p, i, j))
    return sorted(out)


def spans(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        start = rng.choice([0, 1, 15, 16, 17, 1023, 1024, 70_000, rng.randint(0, 200), rng.randint(0, 10**6)])
        size = rng.choice([None, 0, 1, 15, 16, 17, 1023, 1024, 1025, 65_536, 10**6, 2**31, -3])
        out.append((i, rng.choice(["a", "b", None]), None if rng.random() < 0.05 else start, None if size is None else start + size))
    return out


@pytest.mark.parametrize("hot", [20_000, 5])
def test_pairs_are_those_of_a_nested_loop(spark, hot):
    left, right = spans(1, 150), spans(2, 150)
    left += [(1000 + k, "hot.ts", 7, None) for k in range(60)]
    right += [(1000 + k, "hot.ts", 7, None) for k in range(40)]
    make = lambda rows: spark.createDataFrame([(*r, 1, 2) for r in rows], SPANS).repartition(3)
    got = sorted(map(tuple, overlap.overlap_pairs(make(left), make(right), hot).collect()))
    assert got == plain_pairs(left, right) and len(got) > 3000


def test_long_spans_lie_in_few_buckets(spark):
    rows = spark.createDataFrame([(1, "a", 5, 5, 0, 0), (2, "a", 5, 900, 0, 0), (3, "a", 5, 10**9, 0, 0)], SPANS)
    counts = {r["left_id"]: r["n"] for r in overlap._laid(rows, "left").groupBy("left_id").agg(F.count("*").alias("n")).collect()}
    assert max(counts.values()) <= 2 * len(overlap.WIDTHS)


FIELDS = "side string, tool string, path string, code string, severity string, message string, start_line long, start_column long, end_line long, end_column long, tie long"


def test_probable_matches_are_off_unless_asked_for(spark):
    row = lambda side, code, line, column, end, tie: (side, "eslint" if side == "baseline" else "biome", "a.ts", code, "error", "m", line, column, end, None, tie)
    rows = [
        row("baseline", "own-a", 3, 1, 6, 0), row("baseline", "own-b", 5, 2, None, 1), row("baseline", "no-console", 9, 1, None, 2), row("baseline", "far", 90, 1, None, 3), row("baseline", None, 40, 1, None, 4),
        row("candidate", "lint/x/one", 5, 1, None, 0), row("candidate", "lint/x/two", 6, 1, None, 1), row("candidate", "noConsole", 9, 1, None, 2), row("candidate", "lint/x/three", 30, 1, 41, 3), row("candidate", "lint/x/lone", None, None, None, 4),
    ]
    links = matching.linked(spark.createDataFrame(rows, FIELDS), Mappings(), "eslint", "biome")
    assert scoring.raw_summary(links).first()["probable_matches"] == 0
    out = overlap.with_probable(links)
    found = {(r["b"]["tie"], r["c"]["tie"]) for r in out.where("kind = 'probable_match'").collect()}
    # 1 and 0 begin on one line; 0 overlaps 0 and 1, of which 1 is left to it only if it is the nearest: it isn't
    assert found == {(1, 0), (4, 3)}
    s = scoring.raw_summary(out).first()
    assert s["probable_matches"] == 2 and s["exact_matches"] == 1 and s["baseline_diagnostics"] == 5 and s["candidate_diagnostics"] == 5
    assert scoring.is_difference("comparable") is not None and out.columns == links.columns
