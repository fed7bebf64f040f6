"""Errors and exit codes."""

from __future__ import annotations

CLEAN, DIFFERENCES, USAGE, OPERATIONAL = 0, 1, 2, 3


class TwinlensError(Exception):
    """An error with the exit code it ends a command with."""

    exit_code = OPERATIONAL


class UsageError(TwinlensError):
    """Bad arguments or configuration."""

    exit_code = USAGE


class OperationalError(TwinlensError):
    """A file or tool that failed."""


class ToolFailure(OperationalError):
    """A tool that could not be found or started, timed out, was stopped, or wrote output that can't be read."""

    def __init__(self, tool: str, kind: str, detail: str = ""):
        super().__init__(f"{tool}: {kind}" + (f"\n{detail}" if detail else ""))
        self.tool, self.kind, self.detail = tool, kind, detail
