"""Scalar expressions over paths, rule ids, positions, text and enumerations; all native columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import FORMATTERS, LINTERS, OUTPUT_LIMIT, TOOL_DEBUG, TOOL_NAMES


def lookup(c: Column, table: dict[str, str]) -> Column:
    """The value of a small constant table; null where the key isn't in it."""
    if not table:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c)


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` evaluated once."""
    return F.transform(F.array(c), use)[0]


def strip(c: Column) -> Column:
    """Without white space at either end, whatever white space it is."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_upper(c: Column) -> Column:
    return F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def normalize_path(path: Column, root: str) -> Column:
    """A path relative to ``root`` where it lies below, without ``.`` and with ``..`` folded; empty is ``.``.

    The root is taken off before ``..`` is folded; leading ``..`` stay; a root slash goes.
    """
    steps = [s for s in root.split("/") if s not in ("", ".")]
    base = F.array(*map(F.lit, steps)).cast("array<string>")
    full = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
    parts = F.filter(F.split(full, "/"), lambda s: (s != "") & (s != "."))
    below = F.transform(F.array(parts), lambda p: F.when(F.slice(p, 1, len(steps)) == base, F.slice(p, F.lit(len(steps) + 1), F.greatest(F.size(p) - len(steps), F.lit(0)))).otherwise(p))[0]
    empty = F.array().cast("array<string>")
    top = lambda acc: F.try_element_at(acc, F.lit(-1))
    can_pop = lambda acc: F.coalesce(top(acc) != "..", F.lit(False))
    folded = F.aggregate(below, empty, lambda acc, s: F.when((s == "..") & can_pop(acc), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s)))
    out = F.array_join(folded, "/")
    return F.when(out == "", ".").otherwise(out)


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case extension without the dot; empty for none and for names that only begin with a dot."""
    return ascii_lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def canonical_base(rule: Column) -> Column:
    """Kebab case of a rule's last name: inside a closing bracket, after the last slash."""
    c = F.regexp_replace(strip(rule), r"^(?s).*\((.*)\)$", "$1")
    c = F.regexp_replace(c, r"^(?s).*/", "")
    return kebab(c)


def kebab(c: Column) -> Column:
    """Runs of ``_``, space and ``-`` become one dash; a dash goes before a capital after a small letter or before one."""
    c = F.regexp_replace(c, r"[_ \-]+", "-")
    c = F.regexp_replace(c, r"(?<=[a-z])(?=[A-Z])|(?<=[^\-])(?=[A-Z][a-z])", "-")
    return F.btrim(ascii_lower(c), F.lit("-"))


def canonical_rule(rule: Column, spellings: dict[str, str]) -> Column:
    """The base name after one look-up among the spellings."""
    return bound(canonical_base(rule), lambda base: F.coalesce(lookup(base, spellings), base))


def offset_position(text: Column, offset: Column) -> Column:
    """struct(line, column), from 1 and in bytes, of a byte offset in UTF-8 text; offsets past the end are the end."""
    one_byte = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    head = F.substring(one_byte, F.lit(1), offset.cast("int"))
    line = F.length(head) - F.length(F.replace(head, F.lit("\n"))) + 1
    return F.struct(line.cast("long").alias("line"), (F.length(F.substring_index(head, "\n", -1)) + 1).cast("long").alias("column"))


def severity(value: Column, kind: Column) -> Column:
    """Severity of a value of JSON type ``kind`` (number or string); anything else is unknown."""
    n = F.try_to_number(value, F.lit("999999999999999999")).cast("long")
    number = F.when(~value.rlike(r"^\d{1,18}$"), "unknown").when(n == 0, "info").when(n == 1, "warning").otherwise("error")
    low = ascii_lower(value)
    text = F.when(low.isin("fatal", "error", "2"), "error").when(low.isin("warn", "warning", "1"), "warning").when(low.isin("info", "information", "0"), "info").otherwise("unknown")
    return F.when(kind == "number", number).when(kind == "string", text).otherwise("unknown")


def _some(c: Column, shown: Column) -> Column:
    return F.when(c.isNull(), "None").otherwise(F.concat(F.lit("Some("), shown, F.lit(")")))


def fingerprint(tool: Column, path: Column, canonical: Column, sev: Column, message: Column, span: Column) -> Column:
    """SHA-256 over tool, path, canonical rule, severity, message and span; the raw rule and the fix take no part."""
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.replace(canonical, F.lit("\\"), F.lit("\\\\")), '"', '\\\\"'), F.lit('"'))
    number = lambda c: _some(c, c.cast("string"))
    at = F.concat(
        F.lit("Span { start_line: "), span.start_line.cast("string"), F.lit(", start_column: "), span.start_column.cast("string"),
        F.lit(", end_line: "), number(span.end_line), F.lit(", end_column: "), number(span.end_column), F.lit(" }"),
    )
    return F.sha2(F.concat_ws("\0", lookup(tool, TOOL_DEBUG), path, _some(canonical, quoted), F.initcap(sev), message, _some(span.start_line, at)), 256)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def normalized_eol(text: Column, on: bool) -> Column:
    """CRLF to LF when ``on``; a lone CR stays."""
    return F.replace(text, F.lit("\r\n"), F.lit("\n")) if on else text


def truncated(text: Column, limit: int = OUTPUT_LIMIT) -> Column:
    """The first ``limit`` characters and a mark, for longer texts."""
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("\n… output truncated"))).otherwise(text)


def success_stderr(tool: Column, text: Column) -> Column:
    """A warning out of a successful tool's stderr: LF line ends, no blank lines around, named, truncated; null if blank."""
    unix = F.regexp_replace(text, "\r\n|\r", "\n")
    body = F.regexp_replace(F.regexp_replace(unix, r"(?U)^(?:[^\S\n]*\n)+", ""), r"(?U)(?:\n[^\S\n]*)+$", "")
    return F.when(strip(body) == "", None).otherwise(F.concat(lookup(tool, TOOL_NAMES), F.lit(" stderr:\n"), truncated(body)))


def shown_arguments(arguments: Column) -> Column:
    """Arguments joined by spaces, those with white space in quotes."""
    return F.array_join(F.transform(arguments, lambda a: F.when(a.rlike(r"\s"), F.concat(F.lit('"'), a, F.lit('"'))).otherwise(a)), " ")


def is_linter(tool: Column) -> Column:
    return tool.isin(*LINTERS)


def is_formatter(tool: Column) -> Column:
    return tool.isin(*FORMATTERS)


def has_version(version: Column, wanted: str) -> Column:
    """Whether a version text holds ``wanted`` as a token between white space or ``v``."""
    return F.coalesce(F.array_contains(F.split(version, r"[\sv]"), wanted), F.lit(False))


def line_count(text: Column) -> Column:
    """Lines of a text; a final newline ends the last one; 0 for an empty text."""
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n")))
    return F.when(text == "", 0).otherwise(breaks + F.when(text.endswith("\n"), 0).otherwise(1))


def human_bytes(n: Column) -> Column:
    """Bytes, or KiB with one decimal, halves to even."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(F.format_string("%.1f KiB", F.bround(n / F.lit(1024.0), 1)))


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def reduced_name(path: Column) -> Column:
    """``stem.reduced.ext`` beside the input; without an extension, ``name.reduced``."""
    return F.regexp_replace(path, r"^((?:.*/)?[^/]+?)(\.[^./]*)?$", "$1.reduced$2")


def ratio(n: Column, d: Column) -> Column:
    """Per cent; 100 when there is nothing to divide."""
    return F.when(d == 0, 100.0).otherwise(n.cast("double") * 100.0 / d)


def dice(matches: Column, baseline: Column, candidate: Column) -> Column:
    """Twice the matches over both sides, in per cent; 100 when both are empty."""
    return F.when(baseline + candidate == 0, 100.0).otherwise(F.lit(2.0) * matches * 100.0 / (baseline + candidate))
