"""Scans of captured JSON reports in three dialects, to the DIAGNOSTIC columns and the fix.

``flat`` reports (an array of files with messages) are read natively through VARIANT. ``nested`` and ``labelled`` reports may
nest to any depth and change shape from row to row, so an Arrow function walks them. Byte offsets are turned into lines where the
report carries the source, and otherwise through the sources' line starts, which diagnostics join in place of the texts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import OperationalError
from ..functions import text as single
from ..functions.scalars import normalize_path, severity, strip
from ..functions.values import TOOL_NAMES
from . import lines

UNKNOWN_PATH = "<unknown>"
U32 = 4294967295


def _text(v: Column, path: str) -> Column:
    """A string member; null for members of other types, which a cast would turn into text."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(v, path, "string"))


def _number(v: Column, path: str, most: int = U32) -> Column:
    """A whole number member between 0 and ``most``."""
    at = F.try_variant_get(v, path, "variant")
    n = F.try_variant_get(v, path, "bigint")
    return F.when((F.schema_of_variant(at) == "BIGINT") & n.between(0, most), n)


def _severity(v: Column, path: str) -> Column:
    at = F.try_variant_get(v, path, "variant")
    kind = F.when(F.schema_of_variant(at) == "BIGINT", "number").when(F.schema_of_variant(at) == "STRING", "string")
    return F.coalesce(severity(F.try_variant_get(v, path, "string"), kind), F.lit("unknown"))


def flat_reports(reports: DataFrame, root: str) -> DataFrame:
    """ESLint reports of (report_id, json): one row a message, with ``fix``.

    A blank report has no rows. Text that is no array of objects each with ``messages`` raises when it is read. Order is
    kept in ``tie``: file and message position.
    """
    v = reports.where(strip(F.col("json")) != "").select("report_id", F.parse_json("json").alias("v"))
    wrong = F.raise_error("result is missing `messages`")
    files = v.select("report_id", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("i", "f"))
    listed = F.coalesce(F.try_variant_get("f", "$.messages", "array<variant>"), wrong.cast("array<variant>"))
    m = files.select("report_id", "i", "f", F.posexplode(listed).alias("j", "m"))
    line = _number(F.col("m"), "$.line")
    has_fix = F.try_variant_get("m", "$.fix", "variant").isNotNull() & ~F.is_variant_null(F.try_variant_get("m", "$.fix", "variant"))
    fix = F.struct(_number(F.col("m"), "$.fix.range[0]", 2**63 - 1).alias("start"), _number(F.col("m"), "$.fix.range[1]", 2**63 - 1).alias("end"), _text(F.col("m"), "$.fix.text").alias("replacement"))
    at = lambda c: F.when(line.isNotNull(), c)
    return m.select(
        "report_id", F.lit("eslint").alias("tool"), normalize_path(F.coalesce(_text(F.col("f"), "$.filePath"), F.lit(UNKNOWN_PATH)), root).alias("path"), _text(F.col("m"), "$.ruleId").alias("code"),
        _severity(F.col("m"), "$.severity").alias("severity"), F.coalesce(_text(F.col("m"), "$.message"), F.lit("ESLint diagnostic")).alias("message"), line.alias("start_line"),
        at(F.coalesce(_number(F.col("m"), "$.column"), F.lit(1).cast("long"))).alias("start_column"), at(_number(F.col("m"), "$.endLine")).alias("end_line"), at(_number(F.col("m"), "$.endColumn")).alias("end_column"),
        (F.col("i").cast("long") * F.lit(1 << 32) + F.col("j")).alias("tie"), F.when(has_fix, fix).alias("fix"),
    )


MISSING = object()


def _get(value, *keys):
    """The member at a path of keys, or MISSING; a JSON null is a member."""
    for k in keys:
        if not isinstance(value, dict) or k not in value:
            return MISSING
        value = value[k]
    return value


def _first(value, *paths):
    """The first member that is there, whatever its type."""
    return next((x for x in (_get(value, *p) for p in paths) if x is not MISSING), MISSING)


def _whole(value, most: int = U32):
    return value if isinstance(value, int) and not isinstance(value, bool) and 0 <= value <= most else None


def _from_one(column: int | None) -> int:
    """A column as reported, 0 too; 1 where none is."""
    return 1 if column is None else column


def _string(value, *inside):
    """A string, or the first string among members of it."""
    if isinstance(value, str):
        return value
    return next((x for x in (_get(value, k) for k in inside) if isinstance(x, str)), None)


def _severity_of(value) -> str:
    if isinstance(value, int) and not isinstance(value, bool) and value >= 0:
        return ("info", "warning", "error")[min(value, 2)]
    names = {"fatal": "error", "error": "error", "2": "error", "warn": "warning", "warning": "warning", "1": "warning", "info": "info", "information": "info", "0": "info"}
    return names.get(value.lower(), "unknown") if isinstance(value, str) else "unknown"


def _message_text(value) -> str:
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return "".join(map(_message_text, value))
    inner = _first(value, ("content",), ("text",))
    return "" if inner is MISSING else _message_text(inner)


def _walk(value, lists: tuple[str, ...], alone, path: str | None = None) -> Iterator[tuple]:
    """Entries with the path of the object around them: arrays are walked, the first array among ``lists`` gives its members."""
    if isinstance(value, list):
        for x in value:
            yield from _walk(x, lists, alone, path)
    elif isinstance(value, dict):
        named = _first(value, ("filePath",), ("filename",))
        path = named if isinstance(named, str) else path
        inner = next((value[k] for k in lists if isinstance(value.get(k), list)), None)
        if inner is not None:
            yield from ((x, path) for x in inner)
        else:
            yield from ((x, path) for x in alone(value))


#: One parsed entry: position, the row's fields, lines where the report has them, else byte offsets.
ROW = "report_id long, tie long, raw_path string, code string, severity string, message string, start_line long, start_column long, end_line long, end_column long, from_offset long, to_offset long"


def _nested_entry(e) -> tuple:
    """The fields of a Biome entry; an earlier form of a span that is there but bad is not passed over."""
    code = _first(e, ("category",), ("code",))
    path = _first(e, ("location", "path", "file"), ("location", "path"), ("filePath",), ("filename",))
    description = _get(e, "description")
    message = description if isinstance(description, str) else _message_text(_get(e, "message")) or "Biome diagnostic"
    at = lambda v, *names: next((n for n in (_whole(_get(v, k)) for k in names) if n is not None), None)
    place, offsets = (None,) * 4, (None, None)
    for base in (("location", "range"), ("location",), ("location", "span")):
        start, end = _get(e, *base, "start"), _get(e, *base, "end")
        if start is MISSING or (base[-1] == "span" and not isinstance(start, dict)):
            continue
        line = at(start, "line", "lineNumber")
        if line is not None:
            place = (line, _from_one(at(start, "column", "columnNumber")), at(end, "line", "lineNumber"), at(end, "column", "columnNumber"))
        break
    else:
        span = _get(e, "location", "span")
        if isinstance(span, list) and isinstance(_get(e, "location", "sourceCode"), str):
            offsets = (_whole(span[0], 2**62) if span else None, _whole(span[1], 2**62) if len(span) > 1 else None)
    source = _get(e, "location", "sourceCode")
    named = None if path is MISSING else _string(path, "file", "name", "value")
    return (named or UNKNOWN_PATH, None if code is MISSING else _string(code, "file", "name", "value"), _severity_of(_get(e, "severity")), message, *place, *offsets, source if isinstance(source, str) and offsets[0] is not None else None)


def _labelled_entry(e, around: str | None) -> tuple:
    """The fields of an Oxlint entry: lines of the entry, else of its first label or span, else offsets."""
    code, named, message = _first(e, ("code",), ("ruleId",)), _first(e, ("filename",), ("filePath",)), _get(e, "message")
    labels = _get(e, "labels")
    span = _get(labels[0], "span") if isinstance(labels, list) and labels else MISSING
    span = _get(e, "span") if span is MISSING else span
    four = lambda v: (_whole(_get(v, "line")), _from_one(_whole(_get(v, "column"))), _whole(_get(v, "endLine")), _whole(_get(v, "endColumn")))
    offset, size = _whole(_get(span, "offset"), 2**62), _whole(_get(span, "length"), 2**62)
    place, offsets = four(e), (None, None)
    if place[0] is None:
        place = four(span)
        if place[0] is not None:
            offsets = (None, offset + size if offset is not None and size is not None else None)
        else:
            place = (None,) * 4
            offsets = (offset, None if offset is None else offset + (size or 0))
    path = named if isinstance(named, str) else around or UNKNOWN_PATH
    return (path, None if code is MISSING else _string(code, "name"), _severity_of(_get(e, "severity")), message if isinstance(message, str) else "Oxlint diagnostic", *place, *offsets, None)


def _placed(entry: tuple, known: dict[str, lines.LineStarts]) -> tuple:
    """An entry with the lines of its offsets where it carries the source, whose line starts are made once a report."""
    *fields, line, column, end_line, end_column, start, end, source = entry
    if source is None:
        return entry[:-1]
    if source not in known:
        known[source] = lines.LineStarts(source)
    at = lambda offset: (None, None) if offset is None else known[source].position(offset)
    (from_line, from_column), (to_line, to_column) = at(start), at(end)
    pick = lambda given, found: found if given is None else given
    return (*fields, pick(line, from_line), pick(column, from_column), pick(end_line, to_line), pick(end_column, to_column), None, None)


def _alone_nested(v: dict) -> list:
    if "category" in v and ("location" in v or "message" in v):
        return [v]
    return [v["diagnostic"]] if "diagnostic" in v else []


def _alone_labelled(v: dict) -> list:
    return [v] if "message" in v and ("code" in v or "ruleId" in v) else []


def walked_reports(reports: DataFrame, root: str, tool: str, sources: DataFrame | None = None) -> DataFrame:
    """Biome (``tool`` biome) or Oxlint (oxlint) reports of (report_id, json) as DIAGNOSTIC rows.

    Invalid JSON raises; a blank Biome report raises too, a blank Oxlint report has no rows. ``sources`` (path, text) serve
    byte offsets of reports that don't carry the source; without a source such rows have no position.
    """
    nested = tool == "biome"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in ROW.split(", ")]
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in ROW.split(", ")]
        for b in batches:
            rows = []
            for report, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not nested and not (text or "").strip():
                    continue
                try:
                    value = json.loads(text or "")
                except ValueError as e:
                    raise OperationalError(f"{tool} report {report} is no JSON: {e}") from None
                found = _walk(value, ("diagnostics",), _alone_nested) if nested else _walk(value, ("messages", "diagnostics"), _alone_labelled)
                known: dict[str, lines.LineStarts] = {}
                rows += [(report, k, *_placed(_nested_entry(e) if nested else _labelled_entry(e, path), known)) for k, (e, path) in enumerate(found)]
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    rows = reports.select("report_id", "json").mapInArrow(run, ROW).withColumn("path", normalize_path(F.col("raw_path"), root))
    if sources is not None:
        rows = lines.with_positions(rows, lines.line_index(sources), "path", start="from_offset", end="to_offset")
        start, end = F.col("start"), F.col("end")
    else:
        start = end = F.lit(None).cast("struct<line:bigint,column:bigint>")
    has = F.col("start_line").isNotNull() | F.col("from_offset").isNotNull()
    return rows.select(
        "report_id", F.lit(tool).alias("tool"), "path", "code", "severity", "message", F.coalesce("start_line", start.line).alias("start_line"), F.coalesce("start_column", start.column).alias("start_column"),
        F.coalesce("end_line", F.when(has, end.line)).alias("end_line"), F.coalesce("end_column", F.when(has, end.column)).alias("end_column"), "tie",
    )


def empty_warnings(reports: DataFrame, tool: str) -> DataFrame:
    """(report_id, warning) of blank reports, which have no rows."""
    return reports.where(strip(F.coalesce("json", F.lit(""))) == "").select("report_id", F.lit(empty_warning(tool)).alias("warning"))


def empty_warning(tool: str) -> str:
    return f"{TOOL_NAMES[tool]} wrote an empty report"


def _flat_entries(value, tool: str) -> Iterator[tuple]:
    """The messages of an ESLint report, as the entries of the other reports."""
    for f in value:
        listed = _get(f, "messages")
        if not isinstance(listed, list):
            raise OperationalError(f"a file of the {tool} report has no messages")
        path = _string(_get(f, "filePath")) or UNKNOWN_PATH
        for m in listed:
            line, message, fix = _whole(_get(m, "line")), _string(_get(m, "message")), _get(m, "fix")
            place = (line, _from_one(_whole(_get(m, "column"))), _whole(_get(m, "endLine")), _whole(_get(m, "endColumn"))) if line is not None else (None,) * 4
            spot = _get(fix, "range")
            spot = [_whole(x, 2**63 - 1) for x in spot] if isinstance(spot, list) else []
            given = None if fix is MISSING or fix is None else {"start": spot[0] if spot else None, "end": spot[1] if len(spot) > 1 else None, "replacement": _string(_get(fix, "text"))}
            yield path, _string(_get(m, "ruleId")), _severity_of(_get(m, "severity")), "ESLint diagnostic" if message is None else message, *place, None, None, None, given


def local_reports(text: str, root: str, tool: str, sources: dict[str, str] | None = None) -> list[dict]:
    """The diagnostics of one report on the driver, as the scans of tables of reports give them; ``sources`` are texts by path."""
    if not text.strip() and tool != "biome":
        return []
    try:
        value = json.loads(text)
    except ValueError as e:
        raise OperationalError(f"the {tool} report is no JSON: {e}") from None
    if tool == "eslint":
        if not isinstance(value, list):
            raise OperationalError("the eslint report is no list of files")
        found = _flat_entries(value, tool)
    elif tool == "biome":
        found = ((*_nested_entry(e), None) for e, _ in _walk(value, ("diagnostics",), _alone_nested))
    else:
        found = ((*_labelled_entry(e, path), None) for e, path in _walk(value, ("messages", "diagnostics"), _alone_labelled))
    out, known = [], {}
    for tie, (path, code, level, message, *place, start, end, source, fix) in enumerate(found):
        own = single.normalize_path(path, root)
        source = source if source is not None else (sources or {}).get(own)
        line, column, end_line, end_column = _placed((*place, start, end, source), known)[:4]
        row = {"tool": tool, "path": own, "code": code, "severity": level, "message": message, "start_line": line, "start_column": column, "end_line": end_line, "end_column": end_column}
        out.append(row | {"tie": tie, "fix": fix})
    return out
