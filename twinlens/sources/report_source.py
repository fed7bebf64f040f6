"""Captured reports as a Spark data source: folders of report lines by tool, read a file a task, with filters taken into the reader.

    capture(reports, folder)                 # (report_id, tool, json) to folder/tool=<tool>/part files, a report a line
    diagnostics = scan(spark, folder, root)  # DIAGNOSTIC rows of all of them

Filters on the tool choose the folders, so files of other tools are never opened; filters on path and severity are applied where a
report is parsed, so rows that fail them never leave the task.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

from ..functions.values import LINTERS
from . import files
from .reports import local_reports

NAME = "twinlens_reports"
SCHEMA = "report_id long, tool string, path string, code string, severity string, message string, start_line long, start_column long, end_line long, end_column long, tie long"
#: Columns whose filters the reader takes; none of them is ever null.
FILTERED = ("tool", "path", "severity")


@dataclass
class ReportFile(InputPartition):
    """A file of one tool's reports."""

    tool: str
    file: str


class ReportReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.root, self.filters = options["path"].rstrip("/"), options.get("root", "/"), []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if column in FILTERED and isinstance(f, (EqualTo, EqualNullSafe, In, IsNotNull, StringStartsWith)):
                self.filters.append(f)
            else:
                yield f

    def passes(self, column: str, value: str) -> bool:
        for f in self.filters:
            if f.attribute[0] != column or isinstance(f, IsNotNull):
                continue
            ok = value in f.value if isinstance(f, In) else value.startswith(f.value) if isinstance(f, StringStartsWith) else value == f.value
            if not ok:
                return False
        return True

    def partitions(self) -> list[ReportFile]:
        out = []
        for name, kind, _ in files._entries(self.folder):
            tool = name.removeprefix("tool=")
            if kind == "folder" and name.startswith("tool=") and tool in LINTERS and self.passes("tool", tool):
                out += [ReportFile(tool, f"{self.folder}/{name}/{n}") for n, k, _ in files._entries(f"{self.folder}/{name}") if k == "file" and n[0] not in "._"]
        return out

    def read(self, partition: ReportFile) -> Iterator[tuple]:
        if not isinstance(partition, ReportFile):  # no file is left to read
            return
        for line in files._lines(partition.file):
            own = json.loads(line)
            for d in local_reports(own.get("json") or "", self.root, partition.tool):
                if self.passes("path", d["path"]) and self.passes("severity", d["severity"]):
                    yield (own["report_id"], *(d[c] for c in ("tool", "path", "code", "severity", "message", "start_line", "start_column", "end_line", "end_column", "tie")))


class ReportSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ReportReader:
        return ReportReader(self.options)


def capture(reports: DataFrame, folder: str) -> None:
    """Write reports (report_id, tool, json) for ``scan``; a report is a line of its tool's files."""
    reports.select("tool", F.to_json(F.struct("report_id", "json")).alias("value")).write.partitionBy("tool").text(folder)


def scan(spark: SparkSession, folder: str, root: str) -> DataFrame:
    """The diagnostics of captured reports, with their report and their place in it.

    A blank report of ESLint or Oxlint has no rows, a blank one of Biome and invalid JSON raise; offsets become lines where a report
    carries its source. Turns on the session's push-down of filters into Python data sources.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ReportSource)
    # a plan without any filter would be read with those of the plan before it, so there always is one
    return spark.read.format(NAME).option("root", root).load(folder).where("tool IS NOT NULL")
