"""What a minimised reproduction keeps, and line-wise delta debugging of one text, for tools that run on the driver; ``levels`` reduces tables of cases."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import OperationalError
from ..functions.values import MATCH_KINDS, NO_POSITION
from . import formatting, matching
from .mappings import Mappings

#: What identifies a diagnostic in a mismatch, wherever it stands: canonical rule, message, severity.
Identity = tuple[str | None, str, str]


@dataclass(frozen=True)
class Mismatch:
    """A mismatch by what it is, positions and paths left out."""

    side: str
    category: str
    code: str | None = None
    baseline: Identity | None = None
    candidate: Identity | None = None

    def document(self) -> dict:
        shown = lambda i: {"canonicalCode": i[0], "message": i[1], "severity": i[2]}
        out = {"side": self.side, "category": self.category, "canonicalCode": self.code}
        return out | {k: shown(v) for k, v in (("baseline", self.baseline), ("candidate", self.candidate)) if v}


Signatures = Callable[[str], list[Mismatch]]
#: Sections in which a comparison's mismatches come.
ORDER = ("baseline_only", "candidate_only", "unmapped_baseline", "unmapped_candidate", "match")


def mismatches(links: DataFrame, *more: str) -> DataFrame:
    """(path, bucket, side, category, code, baseline, candidate) of links that are mismatches: identities, no positions. Columns of ``more`` go along."""
    bucket, match = F.col("bucket"), F.col("bucket") == "match"
    category = F.when(match, F.col("kind")).when(bucket.startswith("unmapped"), F.concat(bucket, F.lit("_only"))).otherwise(bucket)
    side = F.when(match, "both").when(bucket.endswith("_only"), F.regexp_replace(bucket, "_only$", "")).otherwise(bucket)
    identity = lambda x: F.when(F.col(x).isNotNull(), F.struct(F.col(f"{x}.canonical_code").alias("canonical_code"), F.col(f"{x}.message").alias("message"), F.col(f"{x}.severity").alias("severity")))
    rows = links.where(is_mismatch())
    return rows.select("path", "bucket", side.alias("side"), category.alias("category"), F.coalesce("b.canonical_code", "c.canonical_code").alias("code"), identity("b").alias("baseline"), identity("c").alias("candidate"), *more)


def is_mismatch() -> Column:
    return F.col("kind").isNull() | (F.col("kind") != "exact_match")


def nth_mismatch(links: DataFrame, bucket: str, n: int) -> DataFrame:
    """The n-th link of a bucket in report order; an index that isn't there raises."""
    from .report import link_order

    rows = links.where((F.col("bucket") == bucket) & is_mismatch()).orderBy(*link_order())
    found = rows.offset(n).limit(1)
    if found.isEmpty():
        raise OperationalError(f"there is no mismatch {n}: the comparison has {rows.count()} of {bucket}")
    return found


def local_mismatches(links: list[dict]) -> list[Mismatch]:
    """The mismatches of links on the driver, in the order of a report."""
    identity = lambda d: (d["canonical_code"], d["message"], d["severity"]) if d else None
    far = lambda x: NO_POSITION if x is None else x

    def order(x: dict) -> tuple:
        if x["bucket"] != "match":
            return ORDER.index(x["bucket"]), *matching.local_key(x["b"] or x["c"])
        b = x["b"]
        return ORDER.index("match"), b["path"], far(b["start_line"]), far(b["start_column"]), MATCH_KINDS.index(x["kind"]), b["fingerprint"]

    out = []
    for x in sorted((x for x in links if x["kind"] != "exact_match"), key=order):
        code = next((d["canonical_code"] for d in (x["b"], x["c"]) if d and d["canonical_code"]), None)
        if x["bucket"] == "match":
            out.append(Mismatch("both", x["kind"], code, identity(x["b"]), identity(x["c"])))
        else:
            side = x["bucket"].removesuffix("_only")
            out.append(Mismatch(side, f"{side}_only", code, identity(x["b"]), identity(x["c"])))
    return out


class Memo:
    """A predicate that looks at each text once; ``attempts`` counts the texts it had to look at."""

    def __init__(self, holds: Callable[[str], bool], known: str):
        self.holds, self.attempts = holds, 0
        self.seen = {self._key(known): True}

    @staticmethod
    def _key(text: str) -> bytes:
        return hashlib.sha256(text.encode()).digest()

    def __call__(self, text: str) -> bool:
        k = self._key(text)
        if k not in self.seen:
            self.attempts += 1
            self.seen[k] = self.holds(text)
        return self.seen[k]


def line_pieces(text: str) -> list[str]:
    """Lines with their newline; one empty line for an empty text."""
    parts = text.split("\n")
    return [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] or len(parts) == 1 else [])


def minimise(text: str, holds: Callable[[str], bool]) -> str:
    """Remove chunks of lines while the predicate holds, finer and finer, then single lines once from left to right."""
    lines, parts = line_pieces(text), 2
    while len(lines) > 1:
        step = -(-len(lines) // parts)
        for at in range(0, len(lines), step):
            rest = lines[:at] + lines[at + step :]
            if holds("".join(rest)):
                lines, parts = rest, max(parts - 1, 2)
                break
        else:
            if parts >= len(lines):
                break
            parts = min(2 * parts, len(lines))
    at = 0
    while at < len(lines):
        rest = lines[:at] + lines[at + 1 :]
        if holds("".join(rest)):
            lines = rest
        else:
            at += 1
    return "".join(lines)


#: A linter over single texts: its diagnostics as dicts of the DIAGNOSTIC columns.
Linter = Callable[[str], list[dict]]


@dataclass
class LintMismatches:
    """The mismatches of two linters on a text, by the same linkage as a comparison."""

    baseline: Linter
    candidate: Linter
    baseline_tool: str
    candidate_tool: str
    mappings: Mappings = field(default_factory=Mappings)

    def __call__(self, text: str) -> list[Mismatch]:
        return local_mismatches(matching.local_links(self.baseline(text), self.candidate(text), self.mappings, self.baseline_tool, self.candidate_tool))


@dataclass
class LineRules:
    """A linter made of rules that look at lines: rule name to a function from a line to a message, or nothing."""

    tool: str
    rules: dict[str, Callable[[str], str | None]]
    severity: str = "warning"

    def __call__(self, text: str) -> list[dict]:
        out = []
        for n, line in enumerate(text.split("\n"), 1):
            for rule, look in self.rules.items():
                message = look(line)
                if message is not None:
                    out.append({"tool": self.tool, "path": "text", "code": rule, "severity": self.severity, "message": message, "start_line": n, "start_column": 1, "tie": len(out)})
        return out


@dataclass
class FormatMismatches:
    """The status of two formatters on a text, each a function from a text to an outcome; none when they agree.

    A formatter that fails is no mismatch but an error; a text that a side doesn't support is a mismatch of that name.
    """

    baseline: Callable[[str], dict]
    candidate: Callable[[str], dict]

    def __call__(self, text: str) -> list[Mismatch]:
        b, c = self.baseline(text), self.candidate(text)
        status = formatting.local_status(b, c)
        if status == "failed":
            raise OperationalError("a formatter failed: " + "; ".join(x["error"] for x in (b, c) if x.get("error")))
        return [] if status == "identical" else [Mismatch("both", status)]


def plain_outcome(formatter: Callable[[str], str]) -> Callable[[str], dict]:
    """A text function as a formatter that never fails."""

    def run(text: str) -> dict:
        once = formatter(text)
        return {"status": "success", "output": once, "idempotent": formatter(once) == once}

    return run


def selected(signatures: Signatures, text: str, index: int) -> Mismatch:
    """The mismatch to keep; an index that isn't there raises."""
    found = signatures(text)
    if index >= len(found):
        raise IndexError(f"there is no mismatch {index}: the comparison has {len(found)}")
    return found[index]


def keeps(signatures: Signatures, wanted: Mismatch) -> Callable[[str], bool]:
    """Whether a text still shows a mismatch. Where the comparison breaks off it is gone."""

    def holds(text: str) -> bool:
        try:
            return wanted in signatures(text)
        except Exception:  # noqa: BLE001  any failure on a smaller text means that it doesn't show the mismatch
            return False

    return holds
