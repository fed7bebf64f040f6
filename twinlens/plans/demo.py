"""Inputs derived from the driver's tables, which hold no tool reports; each recipe has an SQL twin for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mappings import Mappings

ROOT = "/project"
BASELINE, CANDIDATE = "eslint", "biome"
MAPPINGS = Mappings(rules=[{"baseline_tool": "eslint", "baseline": "custom-view", "candidate_tool": "biome", "candidate": "lint/custom/viewRule", "confidence": "approximate"}])
#: Spelling of each event type's rule, and its canonical name, on either side.
CODES = {
    "error": ("no-debugger", "lint/suspicious/noDebugger", "no-debugger", "no-debugger"),
    "click": ("no-console", "lint/suspicious/noConsole", "no-console", "no-console"),
    "view": ("custom-view", "lint/custom/viewRule", "custom-view", "view-rule"),
    "signup": ("eqeqeq", "lint/nursery/noMagic", "eqeqeq", "no-magic"),
    "purchase": ("plugin/only-here", "lint/style/useIsNan", "only-here", "use-isnan"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as diagnostics: odd ones of the candidate, a file for each user."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    odd = F.col("event_id") % 2 == 1
    code = F.lit(None).cast("string")
    for kind, (b, c, _, _) in CODES.items():
        code = F.when(F.col("event_type") == kind, F.when(odd, c).otherwise(b)).otherwise(code)
    return e.select(
        F.when(odd, "candidate").otherwise("baseline").alias("side"), F.when(odd, CANDIDATE).otherwise(BASELINE).alias("tool"), F.concat(F.lit("u"), F.col("user_id")).alias("path"), code.alias("code"),
        F.when(F.col("value") < 3, "info").when(F.col("value") < 60, "warning").otherwise("error").alias("severity"),
        F.when(F.col("event_id") % 3 == 0, "m").otherwise(F.col("event_type")).alias("message"),
        (F.dayofmonth("ts") % 7 + 1).cast("long").alias("start_line"), F.floor(F.hour("ts") / 12 + 1).cast("long").alias("start_column"),
        F.lit(None).cast("long").alias("end_line"), F.lit(None).cast("long").alias("end_column"), F.col("event_id").cast("long").alias("tie"),
    )


def _case(index: int) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v[index]}'" for k, v in CODES.items()) + " END"


EVENT_SQL = f"""
    diag AS (
        SELECT event_id % 2 AS odd, 'u' || user_id AS path, CASE WHEN event_id % 2 = 1 THEN {_case(1)} ELSE {_case(0)} END AS code,
            CASE WHEN event_id % 2 = 1 THEN {_case(3)} ELSE {_case(2)} END AS canonical,
            CASE WHEN value < 3 THEN 'info' WHEN value < 60 THEN 'warning' ELSE 'error' END AS severity,
            CASE WHEN event_id % 3 = 0 THEN 'm' ELSE event_type END AS message,
            CAST(day(ts) % 7 + 1 AS BIGINT) AS line, CAST(floor(hour(ts) / 12 + 1) AS BIGINT) AS col, CAST(event_id AS BIGINT) AS tie FROM events),
    shown AS (
        SELECT *, sha256(concat_ws(chr(0), CASE odd WHEN 1 THEN 'Biome' ELSE 'Eslint' END, path, 'Some("' || canonical || '")',
            CASE severity WHEN 'info' THEN 'Info' WHEN 'warning' THEN 'Warning' ELSE 'Error' END, message,
            'Some(Span {{ start_line: ' || line || ', start_column: ' || col || ', end_line: None, end_column: None }})')) AS fingerprint FROM diag),
    b AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line, col, code, message, fingerprint, tie) AS n FROM shown WHERE odd = 0),
    c AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line, col, code, message, fingerprint, tie) AS n FROM shown WHERE odd = 1)"""
#: Greedy linkage by recursion over each file's baseline rows, carrying the used candidates.
LINK_SQL = f"""
    WITH RECURSIVE {EVENT_SQL},
    p AS (
        SELECT b.path, b.n AS bn, {{'dl': abs(b.line - c.line), 'dc': abs(b.col - c.col), 'conf': CASE WHEN b.code = 'custom-view' AND c.code = 'lint/custom/viewRule' THEN 1 ELSE 0 END, 'cn': c.n}} AS k
        FROM b JOIN c ON b.path = c.path AND (b.canonical = c.canonical OR (b.code = 'custom-view' AND c.code = 'lint/custom/viewRule'))),
    l AS (SELECT path, bn, list_sort(list(k)) AS ks FROM p GROUP BY ALL),
    top AS (SELECT path, max(n) AS n FROM b GROUP BY path),
    walk AS (
        SELECT path, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS cn, CAST(NULL AS INTEGER) AS conf FROM top
        UNION ALL
        SELECT path, n, CASE WHEN k IS NULL THEN used ELSE list_append(used, k.cn) END, k.cn, k.conf FROM (
            SELECT w.path, w.n + 1 AS n, w.used, list_filter(l.ks, lambda x: NOT list_contains(w.used, x.cn))[1] AS k
            FROM walk w JOIN top t ON t.path = w.path AND w.n < t.n LEFT JOIN l ON l.path = w.path AND l.bn = w.n + 1)),
    matched AS (
        SELECT w.path, b.tie AS b_tie, c.tie AS c_tie, w.conf,
            CASE WHEN w.conf = 1 THEN 'approximate_rule_match' WHEN b.line <> c.line OR b.col <> c.col THEN 'range_changed' WHEN b.severity <> c.severity THEN 'severity_changed'
                WHEN b.message <> c.message THEN 'message_changed' ELSE 'exact_match' END AS kind, b.code AS b_code, c.code AS c_code
        FROM walk w JOIN b ON b.path = w.path AND b.n = w.n JOIN c ON c.path = w.path AND c.n = w.cn),
    links AS (
        SELECT 'match' AS bucket, path, kind, conf AS confidence, b_tie, c_tie, b_code, c_code FROM matched
        UNION ALL
        SELECT CASE WHEN canonical IN ('only-here') THEN 'unmapped_baseline' ELSE 'baseline_only' END, path, NULL, NULL, tie, NULL, code, NULL FROM b ANTI JOIN matched m ON m.b_tie = b.tie
        UNION ALL
        SELECT CASE WHEN canonical IN ('no-magic') THEN 'unmapped_candidate' ELSE 'candidate_only' END, path, NULL, NULL, NULL, tie, NULL, code FROM c ANTI JOIN matched m ON m.c_tie = c.tie)"""
