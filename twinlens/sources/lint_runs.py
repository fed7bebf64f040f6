"""Linters run by tasks: files dealt in portions of about equal bytes, each portion one run of the tool, its report parsed where it arises.

The tool and the project's files must be where tasks run, under the same root. What a portion came to is a row: a report, or what failed, so
one crash doesn't end the job. Rows are written before anything reads them: a task that is lost runs its portions again, and only what a
whole attempt wrote counts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ToolFailure
from ..shared import Steps
from . import process, reports

#: Bytes of files that a run of a tool gets, and partitions whose sums a plan takes in.
PORTION = 8 << 20
RUN = "report_id long, status string, exit_code int, duration_ms long, warning string, error string, json string"


def portioned(files: DataFrame, size: int, steps: Steps) -> DataFrame:
    """(portion, path) of files (path, bytes): neighbours by path in portions of about ``size`` bytes. Null sizes count as nothing.

    The running sum is made inside ranges of paths, whose totals, a number a range, place them one after the other.
    """
    ranged = steps.write(files.select("path", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes")).distinct().repartitionByRange("path").withColumn("range", F.spark_partition_id()))
    before, starts = 0, {}
    for r in ranged.groupBy("range").agg(F.sum("bytes").alias("n")).orderBy("range").collect():
        starts[r["range"]], before = before, before + r["n"]
    at = F.create_map(*(F.lit(x) for kv in (starts or {-1: 0}).items() for x in kv))
    running = F.sum("bytes").over(Window.partitionBy("range").orderBy("path").rowsBetween(Window.unboundedPreceding, -1))
    return ranged.select("path", F.floor((F.coalesce(running, F.lit(0)) + at[F.col("range")]) / size).cast("long").alias("portion"))


def lint_runs(files: DataFrame, tool: process.Tool, size: int = PORTION, command: int = process.COMMAND_BYTES) -> DataFrame:
    """(report_id, status, exit_code, duration_ms, warning, error, json) of the tool's runs over files (path, bytes), written.

    A portion whose paths don't fit on a command line takes several runs. ``status`` is ok or failed; a failed run has no report
    and its ``error`` says what the tool wrote. Without files nothing runs.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = []
        for n, part in enumerate(process.portions(sorted(table["path"].to_pylist()), command)):
            report = (key[0].as_py() << 20) + n
            try:
                done, text, warning = process.lint_once(tool, part)
                rows.append((report, "ok", done.exit_code, done.duration_ms, warning, None, text))
            except ToolFailure as e:
                rows.append((report, "failed", None, None, None, str(e), None))
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in RUN.split(", ")])

    steps = Steps(files.sparkSession)
    return steps.write(portioned(files, size, steps).groupBy("portion").applyInArrow(run, RUN))


def diagnostics(runs: DataFrame, tool: str, root: str, sources: DataFrame | None = None) -> DataFrame:
    """The diagnostics of the runs' reports; ``sources`` (path, text) serve reports with byte offsets."""
    texts = runs.where("status = 'ok'").select("report_id", "json")
    return reports.flat_reports(texts, root) if tool == "eslint" else reports.walked_reports(texts, root, tool, sources)


def run_document(runs: DataFrame, tool: process.Tool) -> dict:
    """What a report says of all runs together: the worst exit code, the time spent, each warning once. A failed run raises what it said."""
    failed = runs.where("status = 'failed'").orderBy("report_id").select("error").first()
    if failed:
        raise ToolFailure(tool.name, "failed", failed["error"])
    empty = reports.empty_warnings(runs.where("status = 'ok'"), tool.name).select("warning") if tool.name != "biome" else runs.select("warning").limit(0)
    warnings = sorted(r["warning"] for r in runs.select("warning").where("warning IS NOT NULL").union(empty).distinct().collect())
    total = runs.agg(F.max("exit_code").alias("code"), F.sum("duration_ms").alias("ms")).first()
    return process.LintRun(tool.name, tool.executable, tool.version, process.LINT_ARGUMENTS[tool.name], total["code"], total["ms"] or 0, warnings).document()
