"""Text functions for single values on the driver or in Arrow functions; twins of the column expressions of the same names."""

from __future__ import annotations

import re

from .values import OUTPUT_LIMIT, TOOL_NAMES

_LINE = re.compile(r"[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+")


def truncated(text: str, limit: int = OUTPUT_LIMIT) -> str:
    return text if len(text) <= limit else text[:limit] + "\n… output truncated"


def shown_arguments(arguments: list[str]) -> str:
    return " ".join(f'"{a}"' if re.search(r"\s", a) else a for a in arguments)


def success_warning(tool: str, stderr: str) -> str | None:
    """A warning out of a successful tool's stderr; null where it is blank."""
    rows = stderr.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    told = [i for i, r in enumerate(rows) if r.strip()]
    return f"{TOOL_NAMES[tool]} stderr:\n{truncated(chr(10).join(rows[told[0] : told[-1] + 1]))}" if told else None


def lines(text: str) -> list[str]:
    """The lines of a text with their ends, which are LF, CRLF or CR and nothing else."""
    return _LINE.findall(text)


def line_count(text: str) -> int:
    """Lines of a text by LF; a final LF ends the last one."""
    return text.count("\n") + (not text.endswith("\n")) if text else 0


def human_bytes(n: int) -> str:
    return f"{n} B" if n < 1024 else f"{n / 1024:.1f} KiB"


def normalize_path(path: str, root: str) -> str:
    steps = [s for s in root.split("/") if s not in ("", ".")]
    full = path if path.startswith("/") else root.rstrip("/") + "/" + path
    parts, out = [s for s in full.split("/") if s not in ("", ".")], []
    for s in parts[len(steps) :] if parts[: len(steps)] == steps else parts:
        if s == ".." and out and out[-1] != "..":
            out.pop()
        else:
            out.append(s)
    return "/".join(out) or "."


def offset_position(text: str, offset: int) -> tuple[int, int]:
    head = text.encode()[:offset]
    return head.count(b"\n") + 1, len(head) - head.rfind(b"\n")
