"""Queries of the comparison plan and of the formatter comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.globs import matches_any
from ..functions.text import success_warning
from ..functions.values import POLICIES
from ..operators import capability, formatting, levels, report, scoring
from ..operators.mappings import Mappings
from ..sources.files import ignore_rules, ignored_by, keep_files
from . import demo
from .register import query

EXTENSIONS = ("js", "TS", "json", "jsonc", "md", "tsx", "css", "mjs")
SETTINGS = {
    "biome": {"unsupported": ["**/*.jsonc"], "exclude": ["src1/**"]},
    "oxfmt": {"include": ["src*/**"], "exclude": ["**/[f-h]7*", "**/{x,f9}*.js"]},
}
VERSIONS = {"oxfmt": "Version: 0.60.0", "biome": None}
#: Paths of fake files, one for each document; some are lock files, some lie in ignored folders.
FILES_SQL = f"""files AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN source || '/package-lock.json' WHEN doc_id % 13 = 0 THEN 'node_modules/f' || doc_id || '.js'
    ELSE CASE doc_id % 4 WHEN 0 THEN 'app/' ELSE source || '/' END || 'f' || doc_id || '.' || {list(EXTENSIONS)}[doc_id % 8 + 1] END AS path FROM documents)"""
CLASS_SQL = r"""
    ext AS (SELECT DISTINCT path, lower(regexp_extract(path, '\.([^./]*)$', 1)) AS e FROM files),
    built AS (SELECT path, e IN ('js','jsx','mjs','cjs','ts','tsx','mts','cts','json','jsonc') AS ok FROM ext),
    classed AS (SELECT path,
        CASE WHEN path LIKE '%.jsonc' THEN 'unsupported' WHEN path LIKE 'src1/%' THEN 'skipped' WHEN ok THEN 'supported' ELSE 'unknown' END AS b_status,
        CASE WHEN path LIKE '%.jsonc' THEN 'declared unsupported by configuration' WHEN path LIKE 'src1/%' THEN 'excluded by configuration' WHEN ok THEN 'file extension is supported by the built-in adapter' END AS b_reason,
        CASE WHEN path LIKE '%.jsonc' OR path LIKE 'src1/%' THEN 'configuration' WHEN ok THEN 'builtin' ELSE 'unknown' END AS b_source,
        CASE WHEN regexp_matches(path, '^(.*/)?[fgh]7.*$') OR regexp_matches(path, '^(.*/)?(x|f9).*\.js$') THEN 'excluded' WHEN NOT regexp_matches(path, '^src.*/.*$') THEN 'left'
            WHEN path LIKE '%/package-lock.json' THEN 'refused' WHEN ok THEN 'supported' ELSE 'unknown' END AS c FROM built),
    planned AS (SELECT path, b_status, b_reason, b_source,
        CASE c WHEN 'excluded' THEN 'skipped' WHEN 'left' THEN 'skipped' WHEN 'refused' THEN 'unsupported' ELSE c END AS c_status,
        CASE c WHEN 'excluded' THEN 'excluded by configuration' WHEN 'left' THEN 'not included by configuration' WHEN 'refused' THEN 'Oxfmt 0.60.0 does not support package-lock.json via stdin'
            WHEN 'supported' THEN 'file extension is supported by the built-in adapter' END AS c_reason,
        CASE c WHEN 'excluded' THEN 'configuration' WHEN 'left' THEN 'configuration' WHEN 'refused' THEN 'builtin' WHEN 'supported' THEN 'builtin' ELSE 'unknown' END AS c_source FROM classed)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (k % 8 + 1).cast("int"))
    plain = F.concat(F.when(k % 4 == 0, "app/").otherwise(F.concat("source", F.lit("/"))), F.lit("f"), k, F.lit("."), ext)
    path = F.when(k % 9 == 0, F.concat("source", F.lit("/package-lock.json"))).when(k % 13 == 0, F.concat(F.lit("node_modules/f"), k, F.lit(".js"))).otherwise(plain)
    return demo.table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))


def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capability.plan(files(spark, sf_dir), "biome", "oxfmt", SETTINGS, VERSIONS)


@query("s4_discovery", rf"""WITH {FILES_SQL} SELECT DISTINCT path FROM files WHERE regexp_matches(path, '^(.*/)?[^/]*\.(js|ts|json)$') AND NOT path LIKE 'src2/%' AND NOT path LIKE 'node_modules/%'""")
def s4_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct paths under include and exclude globs and ignored folders."""
    raw = files(spark, sf_dir).select(F.concat(F.lit("/project/./"), "path").alias("path"))
    return keep_files(raw, demo.ROOT, ["**/*.{js,ts}", "**/*.json"], ["src2/**"])


@query("p1_globs", rf"""WITH {FILES_SQL} SELECT doc_id, regexp_matches(path, '^(.*/)?[^/]*lock.json$') AS lock, regexp_matches(path, '^src[^12].*/f..?\.js$') AS short FROM files""")
def p1_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return files(spark, sf_dir).select("doc_id", matches_any(p, ["**/*lock.json"]).alias("lock"), matches_any(p, ["src[!12]*/f?.js", "src[!12]*/f??.js"]).alias("short"))


@query("p3_plan", f"WITH {FILES_SQL}, {CLASS_SQL} SELECT *, b_status IN ('supported', 'unknown') AND c_status IN ('supported', 'unknown') AS comparable FROM planned")
def p3_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classification of every file for both tools."""
    part = lambda s, k: [F.col(f"{s}.{n}").alias(f"{k}_{n}") for n in ("status", "reason", "source")]
    return planned(spark, sf_dir).select("path", *part("baseline", "b"), *part("candidate", "c"), "comparable")


@query("p5_dispositions", f"""WITH {FILES_SQL}, {CLASS_SQL} SELECT b_status AS list, path, 'baseline' AS side, 'biome' AS tool, coalesce(b_reason, 'unspecified') AS reason, b_source AS source FROM planned WHERE b_status IN ('unsupported', 'skipped')
    UNION ALL SELECT c_status, path, 'candidate', 'oxfmt', coalesce(c_reason, 'unspecified'), c_source FROM planned WHERE c_status IN ('unsupported', 'skipped')""")
def p5_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsupported and skipped files by side."""
    return capability.dispositions(planned(spark, sf_dir), "biome", "oxfmt").drop("tool_order")


@query("w3_first_dispositions", f"""WITH {FILES_SQL}, {CLASS_SQL}, d AS (SELECT b_status AS list, path, 'baseline' AS side FROM planned UNION ALL SELECT c_status, path, 'candidate' FROM planned),
    r AS (SELECT list, path, side, row_number() OVER (PARTITION BY list ORDER BY path, side) AS place FROM d WHERE list IN ('unsupported', 'skipped')) SELECT * FROM r WHERE place <= 20""")
def w3_first_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dispositions that a text report shows, in their order: the first of each list by path and side."""
    d = capability.dispositions(planned(spark, sf_dir), "biome", "oxfmt")
    place = F.row_number().over(Window.partitionBy("list").orderBy("path", "side", "tool_order"))
    return d.select("list", "path", "side", place.cast("long").alias("place")).where(F.col("place") <= report.SHOWN)


@query("s4_named_files", rf"""WITH {FILES_SQL} SELECT DISTINCT path FROM files WHERE path LIKE '%.js' AND NOT path LIKE 'app/%' AND (NOT path LIKE 'node_modules/%' OR path IN ('node_modules/f13.js', 'node_modules/f26.js'))""")
def s4_named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are asked for by name come out of ignored folders, too."""
    return keep_files(files(spark, sf_dir), demo.ROOT, ["**/*.js"], [], (), ("node_modules/f13.js", "node_modules/f26.js")).where(~F.col("path").startswith("app/"))


IGNORES = [(".gitignore", "# comment\n\n*.tsx\n!/src3/*.tsx\nsrc1/\nf?1.css\n"), ("src2/.gitignore", "/f[0-4]*\n**/f5*.md\n"), ("src2/.ignore", "!f44*\n")]


@query("s4_ignore_files", rf"""WITH {FILES_SQL} SELECT DISTINCT path FROM files WHERE NOT path LIKE 'src1/%'
    AND NOT (path LIKE '%.tsx' AND NOT (path LIKE 'src3/%' OR path LIKE 'src2/f44%')) AND NOT regexp_matches(path, '(^|/)f[^/]1\.css$')
    AND NOT ((path LIKE 'src2/f0%' OR path LIKE 'src2/f1%' OR path LIKE 'src2/f2%' OR path LIKE 'src2/f3%' OR path LIKE 'src2/f4%') AND NOT path LIKE 'src2/f44%') AND NOT (path LIKE 'src2/f5%.md')""")
def s4_ignore_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ignore files leave, with negated, folder-only, anchored and nested rules."""
    rows = files(spark, sf_dir).select("path").distinct()
    return rows.where(~ignored_by(F.col("path"), ignore_rules(IGNORES)))


@query("p9_outcomes", f"""WITH {FILES_SQL}, {CLASS_SQL}, g AS (SELECT split_part(path, '/', 1) AS folder, count(*) FILTER (b_status = 'unsupported' OR c_status = 'unsupported') AS unsupported, bool_or(c_status = 'unknown') AS differs FROM planned GROUP BY ALL)
    SELECT folder, p.policy, CASE WHEN policy = 'error' AND unsupported > 0 THEN 3 WHEN differs OR (policy = 'difference' AND unsupported > 0) THEN 1 ELSE 0 END AS code FROM g, (VALUES ('ignore'), ('difference'), ('error')) p(policy)""")
def p9_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exit code of each folder's comparison under the three policies, where an unknown file counts as a difference."""
    own = planned(spark, sf_dir).withColumn("folder", F.substring_index("path", "/", 1))
    unsupported = (F.col("baseline.status") == "unsupported") | (F.col("candidate.status") == "unsupported")
    g = own.groupBy("folder").agg(F.count_if(unsupported).alias("unsupported"), F.bool_or(F.col("candidate.status") == "unknown").alias("differs"))
    codes = F.array(*(F.struct(F.lit(p).alias("policy"), scoring.outcome(F.col("differs"), F.col("unsupported"), p).cast("int").alias("code")) for p in POLICIES))
    return g.select("folder", F.explode(codes).alias("x")).select("folder", "x.policy", "x.code")


@query("a11_plan_counts", f"""WITH {FILES_SQL}, {CLASS_SQL} SELECT count(*) AS discovered, count(*) FILTER (b_status IN ('supported', 'unknown') AND c_status IN ('supported', 'unknown')) AS comparable,
    count(*) FILTER (b_status = 'unsupported' OR c_status = 'unsupported') AS unsupported,
    count(*) FILTER ((b_status = 'skipped' OR c_status = 'skipped') AND NOT (b_status = 'unsupported' OR c_status = 'unsupported')) AS skipped FROM planned""")
def a11_plan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File counts; skipped files leave out the unsupported ones."""
    return capability.counts(planned(spark, sf_dir))


def chain(c, pairs):
    for a, b in pairs:
        c = F.regexp_replace(c, a, b)
    return c


#: Formatters over texts: collapse runs of a mark, replace pairs of it once, add a final newline, and nothing.
FORMATTERS = {
    "collapse": lambda c: chain(c, [(r"\*+", "*"), ("#+", "#"), ("%+", "%"), ("!+", "!")]),
    "pairs": lambda c: chain(c, [(r"\*\*", "*"), ("##", "#"), ("%%", "%"), ("!!", "!")]),
    "newline": lambda c: F.concat(chain(F.regexp_replace(c, "\n+$", ""), [(r"\*+", "*"), ("#+", "#"), ("%+", "%"), ("!+", "!")]), F.lit("\n")),
    "same": lambda c: c,
}
_COLLAPSE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '\*+', '*', 'g'), '#+', '#', 'g'), '%+', '%', 'g'), '!+', '!', 'g')"
SQL_FORMATTERS = {
    "collapse": _COLLAPSE,
    "pairs": "replace(replace(replace(replace({x}, '**', '*'), '##', '#'), '%%', '%'), '!!', '!')",
    "newline": _COLLAPSE.replace("{x}", "regexp_replace({x}, '\n+$', '')") + " || chr(10)",
    "same": "{x}",
}


def format_sql(source: str, key: str, text: str, b: str, c: str) -> str:
    f = lambda n, x: "(" + SQL_FORMATTERS[n].replace("{x}", x) + ")"
    return f"""once AS (SELECT {key} AS path, {text} LIKE '%@%' AS bad, {f(b, text)} AS b1, {f(c, text)} AS c1 FROM {source}),
        twice AS (SELECT *, {f(b, "b1")} <> b1 AS bl, {f(c, "c1")} <> c1 AS cl FROM once),
        results AS (SELECT path, CASE WHEN bad THEN 'failed' WHEN bl AND cl THEN 'both_non_idempotent' WHEN bl THEN 'baseline_non_idempotent' WHEN cl THEN 'candidate_non_idempotent'
            WHEN b1 = c1 THEN 'identical' ELSE 'different' END AS status, NOT bad AND NOT bl AS b_ok, NOT bad AND NOT cl AS c_ok FROM twice)"""


def compared(spark: SparkSession, sf_dir: str, b: str, c: str, diffs: bool = False, source: str = "documents") -> DataFrame:
    t = demo.table(spark, sf_dir, source)
    t = t.select(F.col("doc_id").alias("path"), "text") if source == "documents" else t.select(F.col("page_id").alias("path"), F.col("html").alias("text"))
    return formatting.compare(t, FORMATTERS[b], FORMATTERS[c], F.col("text").contains("@"), diffs=diffs)


def _register(b: str, c: str, source: str, key: str, text: str) -> None:
    @query(f"t2_format_{source}_{b}_{c}", f"WITH {format_sql(source, key, text, b, c)} SELECT path, status, b_ok, c_ok FROM results")
    def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
        ok = lambda s: F.coalesce(F.col(f"{s}.idempotent"), F.lit(False))
        return compared(spark, sf_dir, b, c, source=source).select("path", "status", ok("baseline").alias("b_ok"), ok("candidate").alias("c_ok"))


for _b, _c in (("collapse", "same"), ("collapse", "pairs"), ("pairs", "collapse"), ("collapse", "newline"), ("pairs", "pairs")):
    _register(_b, _c, "documents", "doc_id", "text")
_register("collapse", "pairs", "pages", "page_id", "html")


@query("t1_line_ends", """SELECT doc_id AS path, 'identical' AS levelled, CASE WHEN contains(replace(text, chr(13) || chr(10), ''), chr(10)) THEN 'different' ELSE 'identical' END AS plain FROM documents""")
def t1_line_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A formatter that writes CRLF against one that changes nothing, with line ends levelled and as they are."""
    t = demo.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    crlf = lambda c: F.regexp_replace(c, "\r?\n", "\r\n")
    status = lambda eol, name: formatting.compare(t, FORMATTERS["same"], crlf, eol=eol).select("path", F.col("status").alias(name))
    return status(True, "levelled").join(status(False, "plain"), "path")


@query("a12_format_summary", f"""WITH {format_sql("documents", "doc_id", "text", "collapse", "pairs")} SELECT count(*) AS discovered, count(*) AS compared, count(*) FILTER (status = 'identical') AS identical,
    count(*) FILTER (status = 'different') AS different, count(*) FILTER (status = 'baseline_non_idempotent') AS baseline_non_idempotent, count(*) FILTER (status = 'candidate_non_idempotent') AS candidate_non_idempotent,
    count(*) FILTER (status = 'both_non_idempotent') AS both_non_idempotent, CAST(0 AS BIGINT) AS unsupported, CAST(0 AS BIGINT) AS skipped, count(*) FILTER (status = 'failed') AS failed FROM results""")
def a12_format_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting.summary(compared(spark, sf_dir, "collapse", "pairs"))


@query("p8_format_differs", f"""WITH {format_sql("documents", "doc_id", "text", "collapse", "pairs")} SELECT bool_or(status IN ('different', 'baseline_non_idempotent', 'candidate_non_idempotent', 'both_non_idempotent')) AS differs FROM results""")
def p8_format_differs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a format comparison found differences."""
    return scoring.format_differs(formatting.summary(compared(spark, sf_dir, "collapse", "pairs")))


@query("a13_format_failures", f"""WITH {format_sql("documents", "doc_id", "text", "collapse", "pairs")} SELECT path, s.side, path || ' ' || s.side || ' ' || s.tool || ': exit code 2' AS detail
    FROM results, (VALUES ('baseline', 'Biome'), ('candidate', 'Oxfmt')) s(side, tool) WHERE status = 'failed'""")
def a13_format_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting.failures(compared(spark, sf_dir, "collapse", "pairs"), "biome", "oxfmt")


def failing_tool(path: str, data: bytes) -> dict:
    """A stand-in for a formatter that fails on texts with a mark, breaks off on others, and warns of some."""
    text = data.decode()
    if "@" in text:
        return {"status": "failed", "tool": "biome", "arguments": ["format", path], "exit_code": 2, "error": "formatting ended with exit code 2", "output": "partial", "stderr": f"no parser for {path}", "warnings": []}
    if "%%" in text:
        raise ValueError("two signs")
    told = [w for w in (success_warning("biome", f"\r\n {len(text)} characters \n") if "!" in text else None,) if w]
    return {"status": "success", "tool": "biome", "arguments": ["format", path], "exit_code": 0, "output": text, "idempotent": True, "warnings": told}


def plain_tool(path: str, data: bytes) -> dict:
    """A stand-in for a formatter that doesn't support lock files and otherwise leaves texts as they are, but for one mark."""
    if path.endswith("7"):
        return {"status": "unsupported", "tool": "oxfmt", "exit_code": 1, "reason": "not this file", "warnings": []}
    return {"status": "success", "tool": "oxfmt", "exit_code": 0, "output": data.decode().replace("#", ""), "idempotent": True, "warnings": []}


TOOL_SQL = """ran AS (SELECT CAST(doc_id AS VARCHAR) AS path, text, text LIKE '%@%' AS failed, text NOT LIKE '%@%' AND contains(text, '%%') AS broke, doc_id % 10 = 7 AS refused, text LIKE '%#%' AS marked FROM documents),
    results AS (SELECT *, CASE WHEN failed OR broke THEN 'failed' WHEN refused THEN 'unsupported' WHEN marked THEN 'different' ELSE 'identical' END AS status FROM ran)"""


def ran(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through the two stand-ins."""
    t = demo.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return formatting.judged(formatting.run_tools(t, failing_tool, plain_tool))


@query("t5_failed", f"""WITH {TOOL_SQL} SELECT path, status, CASE WHEN failed OR broke THEN 'failed' ELSE 'success' END AS b_status, CASE WHEN failed THEN 2 WHEN NOT broke THEN 0 END AS b_code,
    CASE WHEN failed THEN 'formatting ended with exit code 2' WHEN broke THEN 'the run broke off: two signs' END AS b_error, CASE WHEN failed THEN 'no parser for ' || path END AS b_stderr, CASE WHEN refused THEN 'unsupported' ELSE 'success' END AS c_status, CASE WHEN refused THEN 'not this file' END AS c_reason FROM results""")
def t5_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: outcomes of external tools, of which one fails, breaks off or refuses some files."""
    b, c = F.col("baseline"), F.col("candidate")
    return ran(spark, sf_dir).select("path", "status", b.status.alias("b_status"), b.exit_code.alias("b_code"), b.error.alias("b_error"), b.stderr.alias("b_stderr"), c.status.alias("c_status"), c.reason.alias("c_reason"))


@query("t5_failure_details", f"""WITH {TOOL_SQL} SELECT path, 'baseline' AS side, path || ' baseline Biome: ' || CASE WHEN failed THEN 'formatting ended with exit code 2' || chr(10) || 'stdout: partial' || chr(10) || 'stderr: no parser for ' || path ELSE 'the run broke off: two signs' END AS detail
    FROM results WHERE status = 'failed'""")
def t5_failure_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failures of a report, with what the tool wrote."""
    return formatting.failures(ran(spark, sf_dir), "biome", "oxfmt")


@query("t6_warnings", f"""WITH {TOOL_SQL} SELECT path, 'baseline' AS side, 'Biome stderr:' || chr(10) || ' ' || length(text) || ' characters ' AS warning FROM results WHERE NOT failed AND NOT broke AND text LIKE '%!%'""")
def t6_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What successful runs wrote to stderr, each once."""
    return formatting.warnings(ran(spark, sf_dir))


#: Each document as a version of its file; several share a path, and so its plan.
VERSIONS_SQL = """texts AS (SELECT CAST(f.doc_id AS VARCHAR) AS version, f.path, text FROM files f JOIN documents d ON d.doc_id = f.doc_id)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text, baseline, candidate, comparable): the documents under their ids, with the plan of their files."""
    t = files(spark, sf_dir).join(demo.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return t.join(planned(spark, sf_dir), "path").select(F.col("doc_id").cast("string").alias("path"), "text", "baseline", "candidate", "comparable")


@query("t4_planned", f"""WITH {FILES_SQL}, {CLASS_SQL}, {VERSIONS_SQL} SELECT version AS path, CASE WHEN b_status = 'unsupported' OR c_status = 'unsupported' THEN 'unsupported' WHEN b_status = 'skipped' OR c_status = 'skipped' THEN 'skipped'
        WHEN {SQL_FORMATTERS["collapse"].replace("{x}", "text")} = text THEN 'identical' ELSE 'different' END AS status,
        CASE WHEN b_status IN ('unsupported', 'skipped') THEN b_status ELSE 'success' END AS b_status, CASE WHEN c_status IN ('unsupported', 'skipped') THEN c_status ELSE 'success' END AS c_status FROM planned JOIN texts USING (path)""")
def t4_planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: the plan's status of a side stands for its run."""
    t = versions(spark, sf_dir).withColumns({"bp": F.col("baseline.status"), "cp": F.col("candidate.status")})
    out = formatting.compare(t, FORMATTERS["collapse"], FORMATTERS["same"], planned=(F.col("bp"), F.col("cp")), tools=("biome", "oxfmt"))
    return out.select("path", "status", F.col("baseline.status").alias("b_status"), F.col("candidate.status").alias("c_status"))


_LEFT_OUT = f"'{formatting.LEFT_OUT.replace(chr(39), chr(39) * 2)}'"


@query("u2_all_results", f"""WITH {FILES_SQL}, {CLASS_SQL}, {VERSIONS_SQL}, x AS (SELECT * EXCLUDE (path), version AS path, b_status IN ('supported', 'unknown') AS b_ok, c_status IN ('supported', 'unknown') AS c_ok FROM planned JOIN texts USING (path))
    SELECT path, CASE WHEN b_status = 'unsupported' OR c_status = 'unsupported' THEN 'unsupported' WHEN NOT b_ok OR NOT c_ok THEN 'skipped' WHEN {SQL_FORMATTERS["collapse"].replace("{x}", "text")} = text THEN 'identical' ELSE 'different' END AS status,
        CASE WHEN b_ok AND c_ok THEN 'success' WHEN b_status = 'unsupported' THEN 'unsupported' ELSE 'skipped' END AS b_status, CASE WHEN NOT b_ok THEN b_reason WHEN NOT c_ok THEN {_LEFT_OUT} END AS b_reason,
        CASE WHEN b_ok AND c_ok THEN 'success' WHEN c_status = 'unsupported' THEN 'unsupported' ELSE 'skipped' END AS c_status, CASE WHEN NOT c_ok THEN c_reason WHEN NOT b_ok THEN {_LEFT_OUT} END AS c_reason FROM x""")
def u2_all_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compared files and files that only the plan knows, together."""
    own = versions(spark, sf_dir)
    done = formatting.compare(own.where("comparable"), FORMATTERS["collapse"], FORMATTERS["same"], diffs=True, tools=("biome", "oxfmt"))
    out = done.unionByName(formatting.planned_results(own, "biome", "oxfmt"))
    return out.select("path", "status", F.col("baseline.status").alias("b_status"), F.col("baseline.reason").alias("b_reason"), F.col("candidate.status").alias("c_status"), F.col("candidate.reason").alias("c_reason"))


@query("k8_format_report", f"""WITH {format_sql("documents", "doc_id", "text", "collapse", "pairs")},
    o AS (SELECT * FROM results JOIN twice USING (path))
    SELECT path, '{{"path":' || path || ',"status":"' || status || '","baseline":{{"status":"' || CASE WHEN status = 'failed' THEN 'failed","tool":"biome","arguments":[],"exitCode":2,"error":"exit code 2"}}' ELSE 'success","tool":"biome","arguments":[],"exitCode":0,"idempotent":' || (NOT bl) || ',"output":' || CAST(to_json(b1) AS VARCHAR) || '}}' END
        || ',"candidate":{{"status":"' || CASE WHEN status = 'failed' THEN 'failed","tool":"oxfmt","arguments":[],"exitCode":2,"error":"exit code 2"}}' ELSE 'success","tool":"oxfmt","arguments":[],"exitCode":0,"idempotent":' || (NOT cl) || ',"output":' || CAST(to_json(c1) AS VARCHAR) || '}}' END || '}}' AS json FROM o""")
def k8_format_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: every file's result as a format report holds it, without diffs."""
    t = demo.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    out = formatting.compare(t, FORMATTERS["collapse"], FORMATTERS["pairs"], F.col("text").contains("@"), tools=("biome", "oxfmt"))
    return report.result_documents(out.withColumn("diff", F.lit(None).cast("string")))


@query("t3_unified_diff")
def t3_unified_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diff texts of differing outputs; tests apply them as patches."""
    return compared(spark, sf_dir, "collapse", "same", diffs=True).where("diff IS NOT NULL").select("path", "diff")


#: Two linters that agree on some lines, place or weigh others differently, and know marks that the other doesn't.
def linters(texts: DataFrame) -> DataFrame:
    line = F.col("line")
    hashes = (line.contains("###"), F.when(F.char_length(line) % 2 == 0, 2).otherwise(1), F.when(line.contains("e"), "error").otherwise("warning"))
    left = levels.line_findings(texts, "baseline", "eslint", {"no-stars": line.contains("***"), "no-hash": line.contains("###")})
    return left.unionByName(levels.line_findings(texts, "candidate", "biome", {"lint/a/noHash": hashes, "lint/a/noBang": line.contains("!!")}))


RULES = levels.lint_comparison(linters, Mappings(), "eslint", "biome")
#: The first mismatch of each document, and the line that a reduction leaves of it: every rule looks at one line.
FIRST_SQL = """
    parts AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL),
    found AS (
        SELECT *, contains(line, '***') AS stars, contains(line, '!!') AS bang, contains(line, '###') AS hash, length(line) % 2 = 0 AS moved, contains(line, 'e') AS weighed FROM parts),
    told AS (
        SELECT doc_id, text, line, n, 0 AS section, 'unmapped_baseline_only' AS category FROM found WHERE stars UNION ALL SELECT doc_id, text, line, n, 1, 'unmapped_candidate_only' FROM found WHERE bang
        UNION ALL SELECT doc_id, text, line, n, 2, CASE WHEN moved THEN 'range_changed' ELSE 'severity_changed' END FROM found WHERE hash AND (moved OR weighed)),
    firsts AS (SELECT doc_id AS case_id, any_value(text) AS text, arg_min(category, section * 1000000 + n) AS category, arg_min(line, section * 1000000 + n) AS line FROM told GROUP BY doc_id)"""


@query("r1_reduction", f"""WITH {FIRST_SQL} SELECT case_id, category, line, CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END AS INTEGER) AS original_lines, 1 AS reduced_lines,
    CAST(octet_length(encode(text)) AS INTEGER) AS original_bytes FROM firsts""")
def r1_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that shows a mismatch, reduced to the line that keeps the first one."""
    cases = demo.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), "text")
    out = levels.reduce_cases(cases, RULES)
    return out.select("case_id", "category", F.regexp_replace("text", "\n$", "").alias("line"), "original_lines", "reduced_lines", "original_bytes")


@query("r5_format_reduction", f"""WITH {format_sql("documents", "doc_id", "text", "collapse", "pairs")} SELECT path AS case_id, status AS category, true AS keeps, true AS least FROM results WHERE status NOT IN ('identical', 'failed')""")
def r5_format_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that two formatters disagree on, reduced; whether the result still shows it, and shows it without no line."""
    compared = levels.format_comparison(FORMATTERS["collapse"], FORMATTERS["pairs"], F.col("text").contains("@"))
    cases = demo.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), "text")
    return levels.checked(levels.reduce_cases(cases, compared), compared)
