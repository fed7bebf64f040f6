"""Comparison of two formatters' outputs: what each made of a file, idempotency, equality, unified diffs and the summary.

Formatters are column functions, which Catalyst plans like any other expression, or external tools, which an Arrow function
runs over the bytes of each file in a bounded pool. Both give the same outcomes, and files that the plan leaves out get theirs
from the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import bound, normalized_eol
from ..functions.text import lines
from ..functions.values import FORMAT_STATUSES, TOOL_NAMES

Formatter = Callable[[Column], Column]
#: What a side made of a file: members that don't apply are null.
OUTCOME = T.StructType(
    [
        T.StructField("status", T.StringType()), T.StructField("tool", T.StringType()), T.StructField("executable", T.StringType()), T.StructField("version", T.StringType()),
        T.StructField("arguments", T.ArrayType(T.StringType())), T.StructField("exit_code", T.IntegerType()), T.StructField("duration_ms", T.LongType()), T.StructField("idempotent", T.BooleanType()),
        T.StructField("reason", T.StringType()), T.StructField("error", T.StringType()), T.StructField("output", T.StringType()), T.StructField("stderr", T.StringType()), T.StructField("warnings", T.ArrayType(T.StringType())),
    ]
)
#: A side that could run but doesn't, since the other can't.
LEFT_OUT = "the other side can't be compared on this file, so this one was not run"


def outcome_of(**members: Column) -> Column:
    """An outcome of the given members."""
    return F.struct(*(members.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in OUTCOME.fields))


def planned_outcome(own: Column, tool: str) -> Column:
    """The outcome of a side of a file that the plan leaves out, from the side's (status, reason)."""
    left_out = own["status"].isin("unsupported", "skipped")
    status = F.when(own["status"] == "unsupported", "unsupported").otherwise("skipped")
    return outcome_of(status=status, tool=F.lit(tool), arguments=F.array(), warnings=F.array(), reason=F.when(left_out, F.coalesce(own["reason"], own["status"])).otherwise(F.lit(LEFT_OUT)))


def planned_results(planned: DataFrame, baseline_tool: str, candidate_tool: str) -> DataFrame:
    """(path, status, baseline, candidate, diff) of the files that a plan leaves out: unsupported by a side, else skipped."""
    either = (F.col("baseline.status") == "unsupported") | (F.col("candidate.status") == "unsupported")
    return planned.where("NOT comparable").select(
        "path", F.when(either, "unsupported").otherwise("skipped").alias("status"),
        planned_outcome(F.col("baseline"), baseline_tool).alias("baseline"), planned_outcome(F.col("candidate"), candidate_tool).alias("candidate"), F.lit(None).cast("string").alias("diff"),
    )


def outcome(text: Column, formatter: Formatter, failing: Column | None = None, eol: bool = False, planned: Column | None = None, tool: str | None = None) -> Column:
    """The outcome of a formatter given as a column function, applied twice.

    ``failing`` marks texts that the formatter refuses; ``planned``, where it is a status other than supported or unknown,
    stands for the run. A text is idempotent when the second pass gives back the first.
    """
    bad = F.coalesce(failing, F.lit(False)) if failing is not None else F.lit(False)
    status = F.when(bad, "failed").otherwise("success")
    if planned is not None:
        status = F.when(planned.isin("unsupported", "skipped"), planned).otherwise(status)
    ran = status == "success"
    error, code = F.when(status == "failed", "exit code 2"), F.when(status == "failed", 2).when(ran, 0)

    def both(once: Column) -> Column:
        same = bound(formatter(once), lambda twice: normalized_eol(once, eol).eqNullSafe(normalized_eol(twice, eol)))
        return outcome_of(status=status, tool=F.lit(tool), exit_code=code, idempotent=F.when(ran, same), error=error, output=F.when(ran, once), arguments=F.array(), warnings=F.array())

    return bound(formatter(text), both)


def format_status(b: Column, c: Column, eol: bool = False) -> Column:
    """Failed, unsupported, skipped, then idempotency, then equality."""
    either = lambda s: (b["status"] == s) | (c["status"] == s)
    loose = lambda o: F.coalesce(o["idempotent"] == F.lit(False), F.lit(False))
    equal = F.coalesce(normalized_eol(b["output"], eol) == normalized_eol(c["output"], eol), F.lit(False))
    out = F.when(equal, "identical").otherwise("different")
    out = F.when(loose(b) & loose(c), "both_non_idempotent").when(loose(b), "baseline_non_idempotent").when(loose(c), "candidate_non_idempotent").otherwise(out)
    return F.when(either("failed"), "failed").when(either("unsupported"), "unsupported").when(either("skipped"), "skipped").otherwise(out)


def local_status(b: dict, c: dict, eol: bool = False) -> str:
    """As ``format_status``, for two outcomes on the driver."""
    unix = lambda t: t.replace("\r\n", "\n") if eol and t is not None else t
    for s in ("failed", "unsupported", "skipped"):
        if s in (b["status"], c["status"]):
            return s
    loose = b.get("idempotent") is False, c.get("idempotent") is False
    if any(loose):
        return "both_non_idempotent" if all(loose) else "baseline_non_idempotent" if loose[0] else "candidate_non_idempotent"
    same = b.get("output") is not None and c.get("output") is not None and unix(b["output"]) == unix(c["output"])
    return "identical" if same else "different"


def compare(
    files: DataFrame, baseline: Formatter, candidate: Formatter, failing: Column | None = None, eol: bool = False, diffs: bool = False,
    planned: tuple[Column, Column] | None = None, tools: tuple[str | None, str | None] = (None, None),
) -> DataFrame:
    """(path, status, baseline, candidate[, diff]) for (path, text). Only different outputs are diffed, in Arrow batches.

    ``planned`` gives the status that a plan has for each side of a file.
    """
    text, plans = F.col("text"), planned or (None, None)
    sides = [outcome(text, f, failing, eol, p, t) for f, p, t in zip((baseline, candidate), plans, tools, strict=True)]
    out = files.select("path", sides[0].alias("baseline"), sides[1].alias("candidate"))
    return judged(out, eol, diffs)


def judged(outcomes: DataFrame, eol: bool = False, diffs: bool = False) -> DataFrame:
    """Outcomes (path, baseline, candidate) with the status of the file and, where asked for, the diff of different outputs."""
    out = outcomes.select("path", format_status(F.col("baseline"), F.col("candidate"), eol).alias("status"), "baseline", "candidate")
    if diffs:
        out = out.mapInArrow(_with_diffs(out.columns, eol), T.StructType([*out.schema.fields, T.StructField("diff", T.StringType())]))
    return out


def run_tools(files: DataFrame, baseline: Callable[[str, bytes], dict], candidate: Callable[[str, bytes], dict], jobs: int = 4) -> DataFrame:
    """(path, baseline, candidate): outcomes of two external tools over (path, content), ``jobs`` files of a task at a time.

    A tool gets a path and the file's bytes and gives the members of its outcome; one that raises gives a failed outcome. Only
    as many files as there are jobs are held at once.
    """
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("baseline", OUTCOME), T.StructField("candidate", OUTCOME)])
    kind = pa.struct(
        [("status", pa.string()), ("tool", pa.string()), ("executable", pa.string()), ("version", pa.string()), ("arguments", pa.list_(pa.string())), ("exit_code", pa.int32()), ("duration_ms", pa.int64()),
         ("idempotent", pa.bool_()), ("reason", pa.string()), ("error", pa.string()), ("output", pa.string()), ("stderr", pa.string()), ("warnings", pa.list_(pa.string()))]
    )

    def guarded(tool: Callable[[str, bytes], dict], path: str, data: bytes) -> dict:
        try:
            return tool(path, data)
        except Exception as e:  # noqa: BLE001  one file must not end the comparison
            return {"status": "failed", "arguments": [], "warnings": [], "error": f"the run broke off: {e}"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(2 * jobs) as pool:
            for batch in batches:
                for at in range(0, batch.num_rows, jobs):
                    part = batch.slice(at, jobs)
                    paths, data = part.column(0).to_pylist(), [d or b"" for d in part.column(1).to_pylist()]
                    sides = [[pool.submit(guarded, t, p, d) for p, d in zip(paths, data, strict=True)] for t in (baseline, candidate)]
                    yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([f.result() for f in s], kind) for s in sides)], names=["path", "baseline", "candidate"])

    return files.select("path", "content").mapInArrow(run, schema)


def warnings(results: DataFrame) -> DataFrame:
    """(path, side, warning): what successful runs wrote to stderr, each once for a file and side."""
    side = lambda s: F.transform(F.coalesce(F.col(f"{s}.warnings"), F.array().cast("array<string>")), lambda w: F.struct(F.lit(s).alias("side"), w.alias("warning")))
    return results.select("path", F.explode(F.array_distinct(F.concat(side("baseline"), side("candidate")))).alias("w")).select("path", "w.side", "w.warning")


def _with_diffs(names: list[str], eol: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass over results that adds the diff of different outputs; null for the rest."""
    path, status, b, c = (names.index(n) for n in ("path", "status", "baseline", "candidate"))
    unix = lambda t: t.replace("\r\n", "\n") if eol else t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(k).field("output").to_pylist() for k in (b, c))
            rows = zip(batch.column(path).to_pylist(), batch.column(status).to_pylist(), left, right, strict=True)
            diffs = [diff_text(p, unix(x), unix(y)) if s == "different" and x is not None and y is not None else None for p, s, x, y in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(diffs, pa.string())], names=[*names, "diff"])

    return run


def summary(results: DataFrame, discovered: Column | None = None) -> DataFrame:
    """One row of counts by status; ``compared`` leaves out unsupported and skipped files, failed ones count."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    compared = F.count_if(~F.col("status").isin("unsupported", "skipped"))
    return results.agg((discovered if discovered is not None else F.count("*")).alias("discovered"), compared.alias("compared"), *map(n, FORMAT_STATUSES))


def failures(results: DataFrame, baseline_tool: str, candidate_tool: str) -> DataFrame:
    """(path, side, detail) of each side that failed, in failed files, with what the tool wrote."""
    side = lambda s, t: F.struct(F.lit(s).alias("side"), F.lit(TOOL_NAMES[t]).alias("tool"), F.col(s).alias("o"))
    rows = results.where("status = 'failed'").select("path", F.explode(F.array(side("baseline", baseline_tool), side("candidate", candidate_tool))).alias("x")).where("x.o.error IS NOT NULL")
    told = lambda name: F.when(F.col(f"x.o.{name}").isNotNull(), F.concat(F.lit(f"\n{'stdout' if name == 'output' else name}: "), F.col(f"x.o.{name}"))).otherwise("")
    detail = F.concat(F.concat_ws(" ", "path", "x.side", "x.tool"), F.lit(": "), F.col("x.o.error"), told("output"), told("stderr"))
    return rows.select("path", "x.side", detail.alias("detail"))


#: Differences from either end up to which the search for the middle of a script goes on; beyond, rows of common lengths tell where to split.
FARTHEST = 1000


def _common_row(a: list[int], b: list[int]) -> np.ndarray:
    """The length of the longest common subsequence of ``a`` with each beginning of ``b``: one row of bits, a step for each line of ``a``."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full  # a bit is unset where the length rises
    for x in a:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    raw = np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), dtype=np.uint8)
    rises = 1 - np.unpackbits(raw, bitorder="little", count=len(b)).astype(np.int64)
    return np.concatenate([[0], np.cumsum(rises)])


def _halved(a: list[int], b: list[int]) -> tuple[int, int, int, int]:
    """A point that a shortest script passes when half of ``a`` is behind it."""
    half = len(a) // 2
    ahead, back = _common_row(a[:half], b), _common_row(a[half:][::-1], b[::-1])
    j = int((ahead + back[::-1]).argmax())
    return half, j, half, j


def _middle(a: list[int], b: list[int]) -> tuple[int, int, int, int]:
    """The middle run (x, y) to (u, v) of a shortest script, by searches from both ends that keep only their fronts."""
    n, m = len(a), len(b)
    delta, top = n - m, (n + m + 1) // 2
    ahead, back = {1: 0}, {1: 0}
    for d in range(top + 1):
        if d > FARTHEST:
            return _halved(a, b)
        for k in range(-d, d + 1, 2):
            x = ahead[k + 1] if k == -d or (k != d and ahead[k - 1] < ahead[k + 1]) else ahead[k - 1] + 1
            x0, y = x, x - k
            while x < n and y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            ahead[k] = x
            if delta % 2 and abs(delta - k) < d and x + back[delta - k] >= n:
                return x0, x0 - k, x, y
        for k in range(-d, d + 1, 2):
            x = back[k + 1] if k == -d or (k != d and back[k - 1] < back[k + 1]) else back[k - 1] + 1
            x0, y = x, x - k
            while x < n and y < m and a[n - x - 1] == b[m - y - 1]:
                x, y = x + 1, y + 1
            back[k] = x
            if not delta % 2 and abs(delta - k) <= d and x + ahead[delta - k] >= n:
                return n - x, m - y, n - x0, m - (x0 - k)
    raise AssertionError("the searches meet")


def _matched(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Runs (start in a, start in b, length) of equal lines on a shortest script, in order."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        head = 0
        while a0 + head < a1 and b0 + head < b1 and a[a0 + head] == b[b0 + head]:
            head += 1
        if head:
            out.append((a0, b0, head))
        a0, b0, tail = a0 + head, b0 + head, 0
        while a0 < a1 - tail and b0 < b1 - tail and a[a1 - tail - 1] == b[b1 - tail - 1]:
            tail += 1
        if tail:
            out.append((a1 - tail, b1 - tail, tail))
        a1, b1 = a1 - tail, b1 - tail
        if a0 == a1 or b0 == b1:
            continue
        common = set(a[a0:a1]).intersection(b[b0:b1])
        if not common:
            continue
        if len(common) < a1 - a0 or len(common) < b1 - b0:
            # lines that the other side hasn't can't be kept, and only make the search long
            left, right = [i for i in range(a0, a1) if a[i] in common], [j for j in range(b0, b1) if b[j] in common]
            if len(left) < a1 - a0 or len(right) < b1 - b0:
                for x, y, size in _matched([a[i] for i in left], [b[j] for j in right]):
                    out += [(left[x + t], right[y + t], 1) for t in range(size)]
                continue
        x, y, u, v = _middle(a[a0:a1], b[b0:b1])
        if u > x:
            out.append((a0 + x, b0 + y, u - x))
        todo += [(a0, a0 + x, b0, b0 + y), (a0 + u, a1, b0 + v, b1)]
    return sorted(out)


def edit_script(a: list[str], b: list[str]) -> list[tuple[str, int, int]]:
    """A shortest script of (' ' | '-' | '+', position in a, position in b), in memory that grows with the lines alone."""
    codes: dict[str, int] = {}
    left, right = ([codes.setdefault(t, len(codes)) for t in side] for side in (a, b))
    script, x, y = [], 0, 0
    for i, j, size in [*_matched(left, right), (len(a), len(b), 0)]:
        script += [("-", k, y) for k in range(x, i)] + [("+", i, k) for k in range(y, j)] + [(" ", i + k, j + k) for k in range(size)]
        x, y = i + size, j + size
    return script


def diff_text(path: str, left: str, right: str, context: int = 3) -> str:
    """A unified diff with the headers ``baseline/path`` and ``candidate/path``; empty for equal texts."""
    a, b = lines(left), lines(right)
    script = edit_script(a, b)
    changed = [i for i, (op, _, _) in enumerate(script) if op != " "]
    if not changed:
        return ""
    hunks, start, last = [], changed[0], changed[0]
    for i in changed[1:]:
        if i - last > 2 * context:
            hunks.append((start, last))
            start = i
        last = i
    hunks.append((start, last))
    out = [f"--- baseline/{path}\n+++ candidate/{path}\n"]
    for first, end in hunks:
        part = script[max(0, first - context) : end + context + 1]
        n_a, n_b = sum(op != "+" for op, _, _ in part), sum(op != "-" for op, _, _ in part)
        at = lambda start, n: f"{start + (n > 0)}" + ("" if n == 1 else f",{n}")
        out.append(f"@@ -{at(part[0][1], n_a)} +{at(part[0][2], n_b)} @@\n")
        for op, i, j in part:
            line = b[j] if op == "+" else a[i]
            out.append(op + line + ("" if line.endswith("\n") else "\n" if line.endswith("\r") else "\n\\ No newline at end of file\n"))
    return "".join(out)
