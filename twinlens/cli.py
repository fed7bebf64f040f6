"""Commands: init, doctor, plan, compare, reduce. Reports come from files captured beforehand, or from the tools themselves."""

from __future__ import annotations

import argparse
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import CLEAN, DIFFERENCES, OPERATIONAL, OperationalError, ToolFailure, TwinlensError, UsageError
from .functions.text import line_count, normalize_path
from .functions.values import FORMATTERS, LINTERS, POLICIES, PROFILES, SCHEMA_VERSION, TOOL_NAMES, TOOLS
from .operators import capability, formatting, matching, overlap, reduction, report, report_sink, scoring
from .sources import config as configuration
from .sources import files, lint_runs, process, reports


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="twinlens", description="Compares two linters or two formatters over the same files.")
    top.add_argument("--config", help="configuration file, instead of the nearest twinlens.toml")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("init", help="write a configuration").add_argument("--force", action="store_true")
    commands.add_parser("doctor", help="show which tools are there")
    for command, told in (("plan", "show what would be compared"), ("compare", "compare")):
        modes = commands.add_parser(command, help=told).add_subparsers(dest="mode", required=True)
        for mode, tools in (("lint", LINTERS), ("format", FORMATTERS)):
            p = modes.add_parser(mode)
            p.add_argument("paths", nargs="*", default=["."], help="files and folders; the project's root if there are none")
            p.add_argument("--baseline", choices=tools, required=True)
            p.add_argument("--candidate", choices=tools, required=True)
            p.add_argument("--output", choices=("terminal", "text", "json"), default="terminal")
            _report_options(p)
            if command == "compare":
                p.add_argument("--unsupported-policy", choices=POLICIES)
                if mode == "lint":
                    p.add_argument("--profile", choices=PROFILES, default="raw")
                    p.add_argument("--baseline-report", help="captured JSON report (a file, or a folder of them) instead of a run")
                    p.add_argument("--candidate-report")
                    p.add_argument("--probable", action="store_true", help="pair residuals whose ranges overlap as probable matches")
                    p.add_argument("--lint-tasks", type=int, default=0, help="run linters in so many portions by tasks, which must see the project under the same root; rules across files see a portion only")
                else:
                    p.add_argument("--normalize-eol", action="store_true")
    p = commands.add_parser("reduce", help="find the least lines of a file that keep a mismatch")
    p.add_argument("path")
    p.add_argument("--mode", choices=("lint", "format"), required=True)
    p.add_argument("--baseline", choices=TOOLS, required=True)
    p.add_argument("--candidate", choices=TOOLS, required=True)
    p.add_argument("--mismatch", type=int, default=0)
    p.add_argument("--output")
    p.add_argument("--timeout", type=int)
    _report_options(p)
    return top


def _report_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("--report-file")
    p.add_argument("--no-save-report", action="store_true")
    p.add_argument("--report-folder", help="a folder of any file system that Spark knows, for reports of any size")


def check(args: argparse.Namespace) -> None:
    if getattr(args, "baseline", None) and args.baseline == args.candidate:
        raise UsageError("baseline and candidate must be different tools")
    if getattr(args, "report_file", None) and args.no_save_report:
        raise UsageError("--report-file and --no-save-report exclude each other")
    if args.command == "reduce":
        kinds = LINTERS if args.mode == "lint" else FORMATTERS
        if {args.baseline, args.candidate} - set(kinds):
            raise UsageError(f"--mode {args.mode} takes {', '.join(kinds)}")
        if args.timeout is not None and args.timeout <= 0:
            raise UsageError("--timeout takes seconds from 1 on")
        if args.mismatch < 0:
            raise UsageError("--mismatch counts from 0")


def report_path(conf: configuration.Config, args: argparse.Namespace) -> Path | None:
    return conf.root / args.report_file if args.report_file else None


def discover(spark: SparkSession, conf: configuration.Config, args: argparse.Namespace) -> DataFrame:
    """(path, text, content) below the given paths. A missing path, or a named file that the globs don't take, is a usage error.

    Ignored folders, ignore files and links hold back what is found in folders, not files that are named. The report's own
    file is never compared.
    """
    root, d, found, named = str(conf.root), conf.values["discovery"], None, []
    own = report_path(conf, args)
    excluded = (normalize_path(str(own), root),) if own else ()
    for p in args.paths:
        full = Path(conf.root, p)
        if not full.exists():
            raise UsageError(f"path doesn't exist: {p}")
        full = Path(os.path.abspath(full))
        rows = files.local_files(spark, [str(full)]) if full.is_file() else files.read_files(_walked(spark, full))
        if full.is_file():
            name = normalize_path(str(full), root)
            if name in excluded:
                continue
            if not _takes(spark, name, d):
                raise UsageError(f"the include and exclude globs don't take {name}")
            named.append(name)
        rows = rows.withColumn("path", files.normalize_path(F.col("path"), root))
        found = rows if found is None else found.union(rows)
    if found is None:
        found = spark.createDataFrame([], "path string, text string, content binary")
    found = found.dropDuplicates(["path"])
    kept = files.keep_files(found, root, d["include"], d["exclude"], excluded, tuple(named))
    return found.join(kept, "path", "left_semi")


def _takes(spark: SparkSession, name: str, discovery: dict) -> bool:
    return spark.range(1).select(files.taken(F.lit(name), discovery["include"], discovery["exclude"]).alias("x")).first().x


def _walked(spark: SparkSession, folder: Path) -> DataFrame:
    """The files below a folder that neither ignore files, of the folder and of those above it in its work tree, nor links hold back."""
    git, outer = files.in_git(folder), []
    for top in folder.parents:
        outer += [files.Outer(normalize_path(str(folder), str(top)), n, (top / n).read_text(errors="replace")) for n in files.IGNORE_FILES if (top / n).is_file() and (git or n == ".ignore")]
        if not git or (top / ".git").exists():
            break
    return files.walk(spark, str(folder), git, tuple(outer))[0]


def emit(args: argparse.Namespace, conf: configuration.Config, mode: str, document: dict, text: str) -> None:
    """Print a report and save it; a report of any size passes through the driver row by row."""
    if args.output == "json":
        sys.stdout.writelines(report.render(document))
    else:
        print(text, end="")
    save(args, conf, mode, document)


def in_folder(spark: SparkSession, args: argparse.Namespace, document: dict, rows: DataFrame, sections: list[str]) -> bool:
    """Whether the report goes to a folder, written by tasks; then it is written, and nothing of its lists is printed or saved elsewhere."""
    if args.report_folder:
        done = report_sink.write_document(spark, args.report_folder, document, rows, sections)
        print(f"report written: {args.report_folder} ({sum(s['rows'] for s in done['sections'])} rows)", file=sys.stderr)
    return bool(args.report_folder)


def save(args: argparse.Namespace, conf: configuration.Config, mode: str, document: dict) -> None:
    if not args.no_save_report:
        path = report_path(conf, args) or conf.root / ".twinlens" / "reports" / f"{mode}-{time.time_ns()}-{os.getpid()}.json"
        report.write_atomic(path, report.render(document))
        print(f"report saved: {path}", file=sys.stderr)


def doctor(conf: configuration.Config) -> int:
    print(f"root: {conf.root}\nconfiguration: {conf.path or 'none, defaults'}")
    code = CLEAN
    for t in TOOLS:
        try:
            exe = process.resolve(conf, t)
            version = process.version(conf.root, t, exe, conf.values["execution"]["timeout_seconds"])
            print(f"{TOOL_NAMES[t]}: {exe} {version.splitlines()[0]}")
        except ToolFailure as e:
            print(f"{TOOL_NAMES[t]}: {e.kind}")
            if conf.tool(t).get("command"):
                code = OPERATIONAL
    return code


class Comparison:
    """What plans and comparisons share: the files, their plan, its counts and dispositions, and the tools that are there."""

    def __init__(self, spark: SparkSession, args: argparse.Namespace, conf: configuration.Config, versions: dict[str, str] | None = None, found: DataFrame | None = None):
        self.args, self.conf = args, conf
        self.files = discover(spark, conf, args) if found is None else found
        self.planned = capability.plan(self.files, args.baseline, args.candidate, conf.values["tools"], versions)
        self.dispositions = capability.dispositions(self.planned, args.baseline, args.candidate)
        self.counts = capability.counts(self.planned).first().asDict()
        self.tools = [process.available(conf, t) for t in sorted((args.baseline, args.candidate), key=TOOLS.index)]
        self.plan = report.plan_documents(self.planned, self.dispositions, args.baseline, args.candidate, self.tools)

    @property
    def comparable(self) -> DataFrame:
        return self.files.join(self.planned.where("comparable").select("path"), "path", "left_semi")

    @property
    def policy(self) -> str:
        return self.args.unsupported_policy or self.conf.values["comparison"]["unsupported"]

    def settle(self, differs: bool, unsupported: int) -> int:
        if unsupported and self.policy == "error":
            print(f"error: {unsupported} files are unsupported, and the policy is error", file=sys.stderr)
        return scoring.settled(differs, unsupported, self.policy)


def plan(spark: SparkSession, args: argparse.Namespace, conf: configuration.Config) -> int:
    """No tool is run."""
    own = Comparison(spark, args, conf)
    mappings = conf.mappings.oriented(args.baseline, args.candidate)
    document = report.plan_document(args.mode, args.baseline, args.candidate, own.plan, mappings)
    emit(args, conf, f"plan-{args.mode}", document, report.plan_text(document, own.counts, own.dispositions))
    return CLEAN


def captured(spark: SparkSession, path: Path) -> DataFrame:
    """(report_id, json): the reports of a file or folder, read by Spark."""
    if not path.exists():
        raise UsageError(f"report doesn't exist: {path}")
    return spark.read.text(str(path), wholetext=True).select(F.monotonically_increasing_id().alias("report_id"), F.col("value").alias("json"))


def _with_side(found: DataFrame, side: str) -> DataFrame:
    fix = F.col("fix") if "fix" in found.columns else F.lit(None)
    return found.select(F.lit(side).alias("side"), *matching.FIELDS, fix.cast(matching.FIX).alias("fix"))


def compare_lint(spark: SparkSession, args: argparse.Namespace, conf: configuration.Config) -> int:
    own, m, root = Comparison(spark, args, conf), conf.mappings, str(conf.root)
    paths: list[str] | None = None
    rows, runs = None, []
    for side, tool, given in (("baseline", args.baseline, args.baseline_report), ("candidate", args.candidate, args.candidate_report)):
        if not given and args.lint_tasks:
            ready = process.tool(conf, tool)
            sizes = own.comparable.select("path", F.octet_length("text").alias("bytes"))
            ran = lint_runs.lint_runs(sizes, ready, max(1, -(-(sizes.agg(F.sum("bytes")).first()[0] or 0) // args.lint_tasks)))
            runs.append(lint_runs.run_document(ran, ready))
            found = lint_runs.diagnostics(ran, tool, root, own.comparable.select("path", "text"))
            rows = _with_side(found, side) if rows is None else rows.unionByName(_with_side(found, side))
            continue
        if given:
            texts = captured(spark, conf.root / given)
            done = process.LintRun(tool, given, "captured report")
        else:
            if paths is None:
                paths = [r.path for r in own.planned.where("comparable").select("path").orderBy("path").toLocalIterator()]
            done = process.lint(conf, tool, paths)
            texts = spark.createDataFrame(list(enumerate(done.reports)), "report_id long, json string")
        if tool != "biome":
            done.warnings += [r.warning for r in reports.empty_warnings(texts, tool).select("warning").distinct().collect()]
        found = reports.flat_reports(texts, root) if tool == "eslint" else reports.walked_reports(texts, root, tool, own.comparable.select("path", "text"))
        rows = _with_side(found, side) if rows is None else rows.unionByName(_with_side(found, side))
        runs.append(done.document())
    links = matching.linked(rows, m, args.baseline, args.candidate)
    links = (overlap.with_probable(links) if args.probable else links).cache()
    classes = scoring.rule_classes(links, m, args.baseline, args.candidate)
    summaries = {
        "rawSummary": report.one_row(scoring.raw_summary(links)),
        "comparableSummary": report.one_row(scoring.comparable_summary(links, F.lit(own.counts["discovered"]), F.lit(own.counts["comparable"]))),
        "mappingSummary": report.mapping_document(classes, scoring.mapping_summary(links, m, args.baseline, args.candidate).first().asDict(), args.baseline, args.candidate),
    }
    document = report.lint_document(root, args.profile, own.plan, tuple(runs), summaries, links, own.dispositions)
    if not in_folder(spark, args, document, report_sink.lint_rows(links), report_sink.LINT_SECTIONS):
        emit(args, conf, "lint", document, report.lint_text(document, own.counts, links, own.dispositions))
    differs = scoring.has_differences(links, args.profile, conf.values["matching"]["count_probable_as_match"]).first().differs
    code = own.settle(differs, own.counts["unsupported"])
    links.unpersist()
    return code


def compare_format(spark: SparkSession, args: argparse.Namespace, conf: configuration.Config) -> int:
    own = Comparison(spark, args, conf)
    if own.counts["comparable"]:
        tools = [process.tool(conf, t) for t in (args.baseline, args.candidate)]
        own = Comparison(spark, args, conf, {t.name: t.version for t in tools}, own.files)
        runs = [lambda path, data, t=t: process.format_text(t, path, data, args.normalize_eol) for t in tools]
        ran = formatting.run_tools(own.comparable, *runs, jobs=conf.values["execution"]["formatter_jobs"])
        results = formatting.judged(ran, args.normalize_eol, diffs=True).unionByName(formatting.planned_results(own.planned, args.baseline, args.candidate))
    else:
        results = formatting.planned_results(own.planned, args.baseline, args.candidate)
    results = results.cache()
    counts = formatting.summary(results, F.lit(own.counts["discovered"]))
    summary = report.one_row(counts)
    failures = formatting.failures(results, args.baseline, args.candidate)
    document = report.format_document(str(conf.root), args.baseline, args.candidate, own.plan, summary, results, failures)
    if not in_folder(spark, args, document, report_sink.format_rows(results), report_sink.FORMAT_SECTIONS):
        emit(args, conf, "format", document, report.format_text(document, results))
    differs = scoring.format_differs(counts).first().differs
    results.unpersist()
    if summary["failed"]:
        print(f"error: a formatter failed on {summary['failed']} files", file=sys.stderr)
        return OPERATIONAL
    return own.settle(differs, summary["unsupported"])


def reduce_file(args: argparse.Namespace, conf: configuration.Config) -> int:
    """The least lines of a file that keep a mismatch, written, read back and looked at once more."""
    path = conf.root / args.path
    if not path.is_file():
        raise UsageError(f"no file to reduce: {args.path}")
    out = conf.root / args.output if args.output else path.with_name(f"{path.stem}.reduced{path.suffix}")
    if out.exists() and out.samefile(path) or os.path.abspath(out) == os.path.abspath(path):
        raise UsageError("the reduced file must not take the place of the original")
    began, names = time.monotonic(), (args.baseline, args.candidate)
    text = path.read_bytes().decode()
    temporary = Path(tempfile.mkstemp(dir=path.parent, prefix=".twinlens-reduce-", suffix=path.suffix)[1])
    try:
        if args.mode == "lint":
            signatures = reduction.LintMismatches(*(_linter(conf, t, temporary, args.timeout) for t in names), *names, conf.mappings)
        else:
            tools = [process.tool(conf, t, args.timeout) for t in names]
            shown = normalize_path(str(path), str(conf.root))
            signatures = reduction.FormatMismatches(*(lambda x, t=t: process.format_text(t, shown, x.encode()) for t in tools))
        try:
            wanted = reduction.selected(signatures, text, args.mismatch)
        except IndexError as e:
            raise UsageError(str(e)) from None
        holds = reduction.keeps(signatures, wanted)
        memo = reduction.Memo(holds, text)
        small = reduction.minimise(text, memo)
        report.write_atomic(out, small)
        if wanted not in signatures(out.read_bytes().decode()):
            raise OperationalError(f"{out} doesn't show the mismatch any more")
    finally:
        temporary.unlink(missing_ok=True)
    document = {"schemaVersion": SCHEMA_VERSION, "mode": args.mode, "baseline": args.baseline, "candidate": args.candidate, "signature": wanted.document()}
    for name, t in (("original", text), ("reduced", small)):
        document |= {f"{name}Lines": line_count(t), f"{name}Bytes": len(t.encode())}
    document |= {"attempts": memo.attempts, "durationMs": int((time.monotonic() - began) * 1000), "output": str(out)}
    print(report.reduction_text(document), end="")
    save(args, conf, "reduce", document)
    return DIFFERENCES


def _linter(conf: configuration.Config, tool: str, file: Path, timeout: int | None) -> reduction.Linter:
    """A linter over a text, by way of a file that stands beside the original."""
    root, shown = str(conf.root), normalize_path(str(file), str(conf.root))

    def run(text: str) -> list[dict]:
        file.write_bytes(text.encode())
        return [d for r in process.lint(conf, tool, [shown], timeout).reports for d in reports.local_reports(r, root, tool, {shown: text})]

    return run


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        check(args)
        if args.command == "init":
            path = Path(args.config or configuration.NAME)
            if path.exists() and not args.force:
                raise UsageError(f"{path} exists; use --force")
            report.write_atomic(path, configuration.TEMPLATE)
            print(f"wrote {path}")
            return CLEAN
        conf = configuration.load(args.config)
        for w in conf.warnings:
            print(f"warning: {w}", file=sys.stderr)
        if args.command == "doctor":
            return doctor(conf)
        if args.command == "reduce":
            return reduce_file(args, conf)
        spark = spark or SparkSession.builder.appName("twinlens").getOrCreate()
        if args.command == "plan":
            return plan(spark, args, conf)
        return (compare_lint if args.mode == "lint" else compare_format)(spark, args, conf)
    except TwinlensError as e:
        print(f"error: {e}", file=sys.stderr)
        return e.exit_code


if __name__ == "__main__":
    sys.exit(main())
