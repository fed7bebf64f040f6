"""Which files two tools can be compared on: classification by configuration, then by extension, and the plan's counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.globs import matches_any
from ..functions.scalars import extension, file_name, has_version
from ..functions.values import DATA_EXTENSIONS, LINTERS, SCRIPT_EXTENSIONS, TOOLS

#: A release that rejects one file by name.
REFUSED_VERSION, REFUSED_FILE = "0.60.0", "package-lock.json"
REFUSED_REASON = "Oxfmt 0.60.0 does not support package-lock.json via stdin"
SUPPORTED_REASON = "file extension is supported by the built-in adapter"


def decision(status: str, reason: str | None, source: str) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason"), F.lit(source).alias("source"))


def built_in(path: Column, tool: str, version: Column | None) -> Column:
    """struct(status, reason, source) from the file's name alone."""
    unknown = decision("unknown", None, "unknown")
    known = SCRIPT_EXTENSIONS if tool in LINTERS and tool != "biome" else (*SCRIPT_EXTENSIONS, *DATA_EXTENSIONS)
    out = F.when(extension(path).isin(*known), decision("supported", SUPPORTED_REASON, "builtin")).otherwise(unknown)
    if tool == "oxfmt":
        refused = has_version(version, REFUSED_VERSION) if version is not None else F.lit(False)
        named = F.when(refused, decision("unsupported", REFUSED_REASON, "builtin")).otherwise(unknown)
        out = F.when(file_name(path) == REFUSED_FILE, named).otherwise(out)
    return out


def classify(path: Column, tool: str, settings: dict | None = None, version: Column | None = None) -> Column:
    """struct(status, reason, source): declared unsupported, then excluded, then not included, then built in."""
    s, key = settings or {}, f"tools.{tool}"
    include = s.get("include") or []
    out = built_in(path, tool, version)
    if include:
        out = F.when(~matches_any(path, include, f"{key}.include"), decision("skipped", "not included by configuration", "configuration")).otherwise(out)
    out = F.when(matches_any(path, s.get("exclude") or [], f"{key}.exclude"), decision("skipped", "excluded by configuration", "configuration")).otherwise(out)
    return F.when(matches_any(path, s.get("unsupported") or [], f"{key}.unsupported"), decision("unsupported", "declared unsupported by configuration", "configuration")).otherwise(out)


def plan(files: DataFrame, baseline: str, candidate: str, settings: dict[str, dict] | None = None, versions: dict[str, str | None] | None = None) -> DataFrame:
    """(path, baseline, candidate, comparable) for a table of normalised paths, one row per distinct path; no join, no shuffle but for the distinct."""
    settings, versions = settings or {}, versions or {}
    version = lambda t: F.lit(versions.get(t)).cast("string")
    out = files.select("path").distinct().select(
        "path", classify(F.col("path"), baseline, settings.get(baseline), version(baseline)).alias("baseline"), classify(F.col("path"), candidate, settings.get(candidate), version(candidate)).alias("candidate")
    )
    ok = lambda side: F.col(f"{side}.status").isin("supported", "unknown")
    return out.withColumn("comparable", ok("baseline") & ok("candidate"))


def dispositions(planned: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """(list, path, side, tool, reason, source, tool_order) of files that a side declares unsupported or skips; reports sort them by path, side, tool_order."""
    side = lambda name, tool: F.struct(F.lit(name).alias("side"), F.lit(tool).alias("tool"), F.lit(TOOLS.index(tool)).alias("tool_order"), F.col(f"{name}.status").alias("list"), F.coalesce(f"{name}.reason", F.lit("unspecified")).alias("reason"), F.col(f"{name}.source").alias("source"))
    rows = planned.select("path", F.explode(F.array(side("baseline", baseline), side("candidate", candidate))).alias("x"))
    return rows.where("x.list IN ('unsupported', 'skipped')").select("x.list", "path", "x.side", "x.tool", "x.reason", "x.source", "x.tool_order")


def counts(planned: DataFrame) -> DataFrame:
    """One row: discovered, comparable, unsupported (by either side) and skipped files (that no side declares unsupported)."""
    any_side = lambda s: (F.col("baseline.status") == s) | (F.col("candidate.status") == s)
    return planned.agg(
        F.count("*").alias("discovered"), F.count_if("comparable").alias("comparable"), F.count_if(any_side("unsupported")).alias("unsupported"),
        F.count_if(any_side("skipped") & ~any_side("unsupported")).alias("skipped"),
    )
