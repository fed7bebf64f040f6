"""Reports: JSON documents by section, streamed in report order; text renderings; atomic writes."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import human_bytes
from ..functions.values import MATCH_KINDS, MATCH_LABELS, NO_POSITION, SCHEMA_VERSION, TOOL_NAMES

#: Rows shown of a section of a text report.
SHOWN = 20
#: Sections of a lint report by the bucket of their links, in order.
SECTIONS = {"match": "matches", "baseline_only": "baselineOnly", "candidate_only": "candidateOnly", "unmapped_baseline": "unmappedBaseline", "unmapped_candidate": "unmappedCandidate"}


def diagnostic_json(name: str) -> Column:
    """A diagnostic as in reports: camel case, nested span and fix, null members left out when written."""
    c = F.col(name)
    span = F.when(c["start_line"].isNotNull(), F.struct(c["start_line"].alias("startLine"), c["start_column"].alias("startColumn"), c["end_line"].alias("endLine"), c["end_column"].alias("endColumn")))
    members = [c["tool"].alias("tool"), c["path"].alias("path"), c["code"].alias("code"), c["canonical_code"].alias("canonicalCode"), c["severity"].alias("severity"), c["message"].alias("message"), span.alias("span"), c["fix"].alias("fix")]
    return F.when(c.isNotNull(), F.struct(*members, c["fingerprint"].alias("fingerprint")))


def link_order() -> list[Column]:
    """The order of links in a section: matches by place, kind and fingerprint of the baseline, residuals by their own order."""
    far, own = F.lit(NO_POSITION), F.coalesce("b", "c")
    kind = F.coalesce(F.array_position(F.array(*map(F.lit, MATCH_KINDS)), F.col("kind")), F.lit(0))
    code = F.when(F.col("bucket") != "match", own["code"])
    message = F.when(F.col("bucket") != "match", own["message"])
    return [F.col("path"), F.coalesce(own["start_line"], far), F.coalesce(own["start_column"], far), kind, code.asc_nulls_first(), message, own["fingerprint"], own["tie"]]


def link_documents(links: DataFrame, *more: str) -> DataFrame:
    """(section, path, json): one compact JSON document per link, by report section; columns of ``more`` go along."""
    confidence = F.element_at(F.array(F.lit("exact"), F.lit("approximate")), F.col("confidence") + 1)
    match = F.struct(F.col("kind"), confidence.alias("mappingConfidence"), diagnostic_json("b").alias("baseline"), diagnostic_json("c").alias("candidate"))
    section = F.element_at(F.create_map(*(F.lit(x) for kv in SECTIONS.items() for x in kv)), F.col("bucket"))
    body = F.when(F.col("bucket") == "match", F.to_json(match)).when(F.col("b").isNotNull(), F.to_json(diagnostic_json("b"))).otherwise(F.to_json(diagnostic_json("c")))
    return links.select(section.alias("section"), "path", body.alias("json"), *more)


def section_documents(links: DataFrame, bucket: str) -> DataFrame:
    """(json) of one section's links, in report order."""
    return link_documents(links.where(F.col("bucket") == bucket).orderBy(*link_order())).select("json")


def diagnostic_documents(links: DataFrame, side: str) -> DataFrame:
    """(json) of all diagnostics of a side ('b' or 'c') in the order of the tool's run."""
    own = links.where(F.col(side).isNotNull())
    x = F.col(side)
    return own.orderBy("path", x["key"]).select(F.to_json(diagnostic_json(side)).alias("json"))


def planned_json(side: str, tool: str) -> Column:
    c = F.col(side)
    return F.struct(F.lit(tool).alias("tool"), c["status"].alias("status"), c["reason"].alias("reason"), c["source"].alias("source"))


def plan_documents(planned: DataFrame, dispositions: DataFrame, baseline: str, candidate: str, tools: list[dict]) -> dict:
    """The plan of a report: files and dispositions as tables of JSON in order, tools as they are."""
    files = planned.orderBy("path").select(F.to_json(F.struct("path", planned_json("baseline", baseline).alias("baseline"), planned_json("candidate", candidate).alias("candidate"))).alias("json"))
    comparable = planned.where("comparable").orderBy("path").select(F.to_json(F.array("path")).alias("json")).select(F.substring("json", F.lit(2), F.length("json") - 2).alias("json"))
    return {"discovered": files, "comparable": comparable, "unsupported": disposition_documents(dispositions, "unsupported"), "skipped": disposition_documents(dispositions, "skipped"), "tools": tools}


def disposition_documents(dispositions: DataFrame, kind: str) -> DataFrame:
    """(json) of one list of dispositions, as they are sorted."""
    rows = dispositions.where(F.col("list") == kind).orderBy("path", "side", "tool_order")
    return rows.select(F.to_json(F.struct("path", "side", "tool", "reason", "source")).alias("json"))


def outcome_json(side: str) -> Column:
    """A formatter's outcome in camel case; members that don't apply are null and left out, as are no warnings."""
    c = F.col(side)
    names = {"status": "status", "tool": "tool", "executable": "executable", "version": "version", "arguments": "arguments", "exit_code": "exitCode", "duration_ms": "durationMs"}
    names |= {"idempotent": "idempotent", "reason": "reason", "error": "error", "output": "output", "stderr": "stderr"}
    told = F.when(F.size(c["warnings"]) > 0, c["warnings"])
    return F.struct(*(c[k].alias(v) for k, v in names.items()), told.alias("warnings"))


def result_documents(results: DataFrame) -> DataFrame:
    """(path, json): one JSON document per compared file."""
    return results.select("path", F.to_json(F.struct("path", "status", outcome_json("baseline").alias("baseline"), outcome_json("candidate").alias("candidate"), "diff")).alias("json"))


def camel(row: dict) -> dict:
    def name(k: str) -> str:
        head, *rest = k.split("_")
        return head + "".join(x.title() for x in rest)

    return {name(k): v for k, v in row.items() if v is not None}


def one_row(df: DataFrame) -> dict:
    """The members of a table of one row, in camel case."""
    return camel(df.first().asDict())


def mapping_document(classes: DataFrame, summary: dict, baseline: str, candidate: str) -> dict:
    """The rules that were seen, by how they are mapped, out of (side, code, class); as many rows as there are rules."""
    rows = sorted((r.side, r.code, r["class"]) for r in classes.collect())
    tool = {"baseline": baseline, "candidate": candidate}
    seen = lambda side: sorted({c for s, c, _ in rows if s == side})
    mapped = lambda kind: [{"tool": tool[s], "code": c} for s, c, k in rows if k == kind]
    unmapped = lambda side: [c for s, c, k in rows if s == side and k == "unmapped"]
    return {
        "observedBaselineRuleIds": seen("baseline"), "observedCandidateRuleIds": seen("candidate"), "exactMappedRuleIds": mapped("exact"), "approximateMappedRuleIds": mapped("approximate"),
        "unmappedBaselineRuleIds": unmapped("baseline"), "unmappedCandidateRuleIds": unmapped("candidate"), "observedRuleMappingCoverage": summary["coverage"],
    }


def lint_document(root: str, profile: str, plan: dict, runs: tuple[dict, dict], summaries: dict[str, dict], links: DataFrame, dispositions: DataFrame) -> dict:
    """The whole lint report; tables stand for their rows until it is written."""
    sides = {name: run | {"diagnostics": diagnostic_documents(links, side)} for name, side, run in (("baseline", "b", runs[0]), ("candidate", "c", runs[1]))}
    out = {"schemaVersion": SCHEMA_VERSION, "mode": "lint", "profile": profile, "projectRoot": root, "plan": plan, **sides, **summaries}
    out |= {name: section_documents(links, bucket) for bucket, name in SECTIONS.items()}
    return out | {"unsupportedFiles": disposition_documents(dispositions, "unsupported"), "skippedFiles": disposition_documents(dispositions, "skipped"), "failures": []}


def format_document(root: str, baseline: str, candidate: str, plan: dict, summary: dict, results: DataFrame, failures: DataFrame) -> dict:
    """The whole format report; tables stand for their rows until it is written."""
    texts = failures.orderBy("path", "side").select(F.to_json(F.array("detail")).alias("json")).select(F.substring("json", F.lit(2), F.length("json") - 2).alias("json"))
    files = result_documents(results).orderBy("path").select("json")
    return {"schemaVersion": SCHEMA_VERSION, "mode": "format", "projectRoot": root, "baselineTool": baseline, "candidateTool": candidate, "plan": plan, "summary": summary, "files": files, "failures": texts}


def plan_document(mode: str, baseline: str, candidate: str, plan: dict, mappings: list[dict]) -> dict:
    counts = {k: sum(m["confidence"] == k for m in mappings) for k in ("exact", "approximate")}
    rules = [camel(m) for m in mappings]
    return {"schemaVersion": SCHEMA_VERSION, "mode": mode, "baselineTool": baseline, "candidateTool": candidate, "plan": plan, "configuredRuleMappings": counts, "ruleMappings": rules, "failures": []}


def pieces(value, indent: str = "") -> Iterator[str]:
    """A document as JSON, piece by piece; a table is an array of its only column, a row a line, read a partition at a time."""
    inner = indent + "  "
    if isinstance(value, DataFrame):
        rows = (r[0] for r in value.toLocalIterator())
    elif isinstance(value, dict):
        if not value:
            yield "{}"
            return
        for n, (k, v) in enumerate(value.items()):
            yield ("{" if not n else ",") + f"\n{inner}{json.dumps(k)}: "
            yield from pieces(v, inner)
        yield f"\n{indent}}}"
        return
    elif isinstance(value, list):
        rows = (json.dumps(x, ensure_ascii=False) for x in value)
    else:
        yield json.dumps(value, ensure_ascii=False)
        return
    some = False
    for row in rows:
        yield f"{',' if some else '['}\n{inner}{row}"
        some = True
    yield f"\n{indent}]" if some else "[]"


def render(document: dict) -> Iterator[str]:
    yield from pieces(document)
    yield "\n"


def write_atomic(path: str | Path, text: str | Iterable[str]) -> None:
    """Replace a file in one step, by way of a temporary file beside it."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, temporary = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(fd, "w", encoding="utf-8", newline="") as f:
            f.writelines([text] if isinstance(text, str) else text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        Path(temporary).unlink(missing_ok=True)
        raise


def _first(df: DataFrame, n: int = SHOWN) -> tuple[list, str]:
    """The first rows of an ordered table, and a note on whether there are more."""
    rows = df.limit(n + 1).collect()
    return rows[:n], f"  … only the first {n} are shown\n" if len(rows) > n else ""


def _one_line(text: str | None) -> str:
    return (text or "").split("\n")[0]


def _counts(title: str, counts: dict) -> str:
    width = max(map(len, counts)) + 2
    return f"\n{title}\n" + "".join(f"  {k:<{width}}{v}\n" for k, v in counts.items())


def dispositions_text(dispositions: DataFrame) -> str:
    out = ""
    for kind, title in (("unsupported", "Unsupported files"), ("skipped", "Files left out by configuration")):
        rows, more = _first(dispositions.where(F.col("list") == kind).orderBy("path", "side", "tool_order"))
        if rows:
            out += f"\n{title}\n" + "".join(f"  {r.path}: {r.side} {TOOL_NAMES[r.tool]}, {r.reason}\n" for r in rows) + more
    return out


def head_text(title: str, **members: str) -> str:
    return f"{title}\n\n" + "".join(f"{k.replace('_', ' '):<10} {v}\n" for k, v in members.items())


def plan_text(document: dict, counts: dict, dispositions: DataFrame) -> str:
    out = head_text("Comparison plan", mode=document["mode"], baseline=TOOL_NAMES[document["baselineTool"]], candidate=TOOL_NAMES[document["candidateTool"]]) + _counts("Files", counts)
    if document["mode"] == "lint":
        out += _counts("Rule mappings", document["configuredRuleMappings"])
        for m in document["ruleMappings"]:
            out += f"  {m['baselineTool']}:{m['baseline']} <-> {m['candidateTool']}:{m['candidate']} ({m['confidence']})\n" + (f"    {m['notes']}\n" if m.get("notes") else "")
    for t in document["plan"]["tools"]:
        if not t["available"]:
            out += f"\nNo {TOOL_NAMES[t['tool']]}: {_one_line(t['reason'])}\n"
    return out + dispositions_text(dispositions)


def diagnostic_text(d) -> str:
    at = d.path if d.start_line is None else f"{d.path}:{d.start_line}:{d.start_column}"
    return f"  {at}  {d.code or '(no rule)'}\n    {d.message.replace(chr(10), ' ')}\n"


def lint_text(document: dict, counts: dict, links: DataFrame, dispositions: DataFrame) -> str:
    raw, own, mapping = document["rawSummary"], document["comparableSummary"], document["mappingSummary"]
    named = {side: f"{TOOL_NAMES[document[side]['tool']]} {_one_line(document[side]['version'])}" for side in ("baseline", "candidate")}
    out = head_text("Lint comparison", profile=document["profile"], **named) + _counts("Files", counts)
    out += _counts("Rules seen", {"baseline": len(mapping["observedBaselineRuleIds"]), "candidate": len(mapping["observedCandidateRuleIds"]), "mapped exactly": len(mapping["exactMappedRuleIds"]), "mapped approximately": len(mapping["approximateMappedRuleIds"]), "unmapped baseline": len(mapping["unmappedBaselineRuleIds"]), "unmapped candidate": len(mapping["unmappedCandidateRuleIds"])})
    out += _counts("Diagnostics of mapped rules", {"exact matches": own["exactMatches"], "approximate matches": own["approximateMatches"], "baseline only": own["baselineOnly"], "candidate only": own["candidateOnly"]})
    if document["profile"] == "raw":
        out += _counts("All diagnostics", {"baseline": raw["baselineDiagnostics"], "candidate": raw["candidateDiagnostics"], "unmapped baseline": raw["unmappedBaseline"], "unmapped candidate": raw["unmappedCandidate"]})
    shares = {"rules mapped": mapping["observedRuleMappingCoverage"], "files compared": own["comparableFileCoverage"], "exact agreement": own["exactAgreement"], "agreement": own["comparableAgreement"]}
    out += _counts("Per cent", {k: f"{v:.1f}" for k, v in shares.items()})
    for bucket in list(SECTIONS)[1:]:
        rows, more = _first(links.where(F.col("bucket") == bucket).orderBy(*link_order()).select(F.coalesce("b", "c").alias("d")))
        if rows:
            out += f"\n{bucket.replace('_', ' ').capitalize()}\n" + "".join(diagnostic_text(r.d) for r in rows) + more
    rows, more = _first(links.where("bucket = 'match' AND kind <> 'exact_match'").orderBy(*link_order()).select("kind", F.col("b").alias("d"), F.col("c.message").alias("other")))
    for r in rows:
        out += f"\n{MATCH_LABELS[r.kind].capitalize()}\n{diagnostic_text(r.d)}    candidate: {r.other.replace(chr(10), ' ')}\n"
    return out + more + dispositions_text(dispositions)


def format_text(document: dict, results: DataFrame) -> str:
    out = head_text("Format comparison", baseline=TOOL_NAMES[document["baselineTool"]], candidate=TOOL_NAMES[document["candidateTool"]])
    out += _counts("Files", {k: document["summary"][k] for k in ("discovered", "compared", "identical", "different", "baselineNonIdempotent", "candidateNonIdempotent", "bothNonIdempotent", "unsupported", "skipped", "failed")})
    rows, more = _first(results.where("status <> 'identical'").orderBy("path"))
    for r in rows:
        out += f"\n{r.path}: {r.status.replace('_', ' ')}\n" + (r.diff or "")
        for side in ("baseline", "candidate"):
            o = r[side]
            told = {"": o.reason, " error": o.error, " stderr": o.stderr}
            out += "".join(f"  {side}{k}: {v}\n" for k, v in told.items() if v) + "".join(f"  {side} warning: {w}\n" for w in o.warnings or [])
    return out + more


def reduction_text(document: dict) -> str:
    size = lambda k: f"{document[f'{k}Lines']:>5} lines, {human_bytes(document[f'{k}Bytes'])}\n"
    return f"Reduction\n\noriginal  {size('original')}reduced   {size('reduced')}attempts  {document['attempts']}\nduration  {document['durationMs'] / 1000:.1f} s\noutput    {document['output']}\n"
