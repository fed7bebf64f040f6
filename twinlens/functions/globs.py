"""Globs as regular expressions: ``*`` and ``?`` also match slashes, ``**/`` matches no or more directories."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import UsageError


def glob_regex(pattern: str) -> str:
    """A full-match regular expression; unbalanced brackets or braces are an error."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if c == "*":
            while pattern[i + 1 : i + 2] == "*":
                i += 1
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            end = pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] in ("!", "^")))
            if end < 0:
                raise UsageError(f"unclosed character class in glob `{pattern}`")
            body = pattern[i + 1 : end]
            negated = body[:1] in ("!", "^")
            body = (body[1:] if negated else body).replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&")
            out, i = out + "[" + "^" * negated + body + "]", end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "}":
            raise UsageError(f"unopened alternates in glob `{pattern}`")
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += re.escape(c)
        i += 1
    if depth:
        raise UsageError(f"unclosed alternates in glob `{pattern}`")
    return out


def globs_regex(patterns: list[str], field: str = "globs") -> str | None:
    """One expression for any of the patterns; null for none."""
    try:
        return "^(?s:" + "|".join(f"(?:{glob_regex(p)})" for p in patterns) + ")$" if patterns else None
    except UsageError as e:
        raise UsageError(f"invalid glob in {field}: {e}") from None


def matches_any(path: Column, patterns: list[str], field: str = "globs") -> Column:
    regex = globs_regex(patterns, field)
    return path.rlike(regex) if regex else F.lit(False)
