"""Queries of the lint comparison: links, summaries, signatures, orders, and report scans over captured samples."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import mapping_tables, matching, overlap, reduction, report, report_sink, scoring
from ..operators.mappings import Mappings
from ..shared import shared_dir
from ..sources import lines, report_source, reports
from . import demo
from .register import query


def event_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.linked(demo.event_diagnostics(spark, sf_dir), demo.MAPPINGS, demo.BASELINE, demo.CANDIDATE)


SUMMARY_SQL = """
    SELECT count(*) FILTER (b_tie IS NOT NULL) AS baseline_diagnostics, count(*) FILTER (c_tie IS NOT NULL) AS candidate_diagnostics,
        count(*) FILTER (kind = 'exact_match') AS exact_matches, count(*) FILTER (kind = 'approximate_rule_match') AS approximate_matches, CAST(0 AS BIGINT) AS probable_matches,
        count(*) FILTER (bucket = 'baseline_only') AS baseline_only, count(*) FILTER (bucket = 'candidate_only') AS candidate_only,
        count(*) FILTER (bucket = 'unmapped_baseline') AS unmapped_baseline, count(*) FILTER (bucket = 'unmapped_candidate') AS unmapped_candidate,
        count(*) FILTER (kind = 'severity_changed') AS severity_changes, count(*) FILTER (kind = 'range_changed') AS range_changes,
        count(*) FILTER (kind = 'message_changed') AS message_changes, count(*) FILTER (bucket = 'match') AS m FROM links"""
_D = "CAST({} AS DOUBLE)"


@query(
    "a2_raw_summary",
    f"{demo.LINK_SQL}, s AS ({SUMMARY_SQL}) SELECT * EXCLUDE (m), CAST(0 AS BIGINT) AS tool_failures, 2.0::DOUBLE * exact_matches * 100.0::DOUBLE / (baseline_diagnostics + candidate_diagnostics) AS exact_agreement FROM s",
)
def a2_raw_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counts and agreement over all diagnostics."""
    return scoring.raw_summary(event_links(spark, sf_dir))


@query(
    "a4_comparable_summary",
    f"""{demo.LINK_SQL}, s AS ({SUMMARY_SQL}), t AS (SELECT *, m + baseline_only AS b, m + candidate_only AS c FROM s)
        SELECT b AS baseline_diagnostics, c AS candidate_diagnostics, exact_matches, approximate_matches, probable_matches, baseline_only, candidate_only, severity_changes, range_changes, message_changes,
            2.0::DOUBLE * exact_matches * 100.0::DOUBLE / (b + c) AS exact_agreement, 2.0::DOUBLE * (exact_matches + approximate_matches) * 100.0::DOUBLE / (b + c) AS comparable_agreement,
            (SELECT CAST(count(DISTINCT user_id) FILTER (user_id % 2 = 0) AS DOUBLE) * 100.0::DOUBLE / count(DISTINCT user_id) FROM events) AS comparable_file_coverage,
            m::DOUBLE * 100.0::DOUBLE / b AS baseline_coverage, m::DOUBLE * 100.0::DOUBLE / c AS candidate_precision FROM t""",
)
def a4_comparable_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary over rules that both tools know, with file coverage."""
    n = demo.table(spark, sf_dir, "events").agg(F.count_distinct("user_id").alias("n"), F.count_distinct(F.when(F.col("user_id") % 2 == 0, F.col("user_id"))).alias("k"))
    return scoring.comparable_summary(event_links(spark, sf_dir), n.select("n").scalar(), n.select("k").scalar())


CLASSES_SQL = """
    seen AS (SELECT 'baseline' AS side, b_code AS code, CASE WHEN bucket = 'match' THEN confidence END AS conf FROM links WHERE b_code IS NOT NULL
        UNION ALL SELECT 'candidate', c_code, CASE WHEN bucket = 'match' THEN confidence END FROM links WHERE c_code IS NOT NULL),
    matched_rules AS (SELECT DISTINCT side, code, conf FROM seen WHERE conf IS NOT NULL),
    classes AS (SELECT side, code, CASE conf WHEN 0 THEN 'exact' ELSE 'approximate' END AS class FROM matched_rules
        UNION ALL SELECT DISTINCT side, code, CASE WHEN code IN ('custom-view', 'lint/custom/viewRule') THEN 'approximate' WHEN code IN ('plugin/only-here', 'lint/nursery/noMagic') THEN 'unmapped' ELSE 'exact' END
        FROM seen ANTI JOIN matched_rules USING (side, code))"""


@query("a8_rule_classes", f"{demo.LINK_SQL}, {CLASSES_SQL} SELECT side, code, class FROM classes")
def a8_rule_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed rules as exact, approximate or unmapped."""
    return scoring.rule_classes(event_links(spark, sf_dir), demo.MAPPINGS, demo.BASELINE, demo.CANDIDATE)


@query(
    "a9_mapping_summary",
    f"""{demo.LINK_SQL}, {CLASSES_SQL}, n AS (SELECT count(DISTINCT code) FILTER (side = 'baseline') AS observed_baseline, count(DISTINCT code) FILTER (side = 'candidate') AS observed_candidate,
            count(*) FILTER (class = 'exact') AS exact_mapped, count(*) FILTER (class = 'approximate') AS approximate_mapped, count(*) FILTER (class = 'unmapped' AND side = 'baseline') AS unmapped_baseline,
            count(*) FILTER (class = 'unmapped' AND side = 'candidate') AS unmapped_candidate FROM classes)
        SELECT *, CAST(exact_mapped + approximate_mapped AS DOUBLE) * 100.0::DOUBLE / (observed_baseline + observed_candidate) AS coverage FROM n""",
)
def a9_mapping_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.mapping_summary(event_links(spark, sf_dir), demo.MAPPINGS, demo.BASELINE, demo.CANDIDATE)


@query("a7_observed_rules", f"WITH {demo.EVENT_SQL} SELECT CASE odd WHEN 1 THEN 'candidate' ELSE 'baseline' END AS side, list_sort(list(DISTINCT code)) AS codes FROM diag GROUP BY odd")
def a7_observed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.observed_rules(demo.event_diagnostics(spark, sf_dir))


@query("j1_links", f"{demo.LINK_SQL} SELECT bucket, path, kind, CAST(confidence AS INTEGER) AS confidence, b_tie, c_tie FROM links")
def j1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy one-to-one links with residuals by bucket."""
    return event_links(spark, sf_dir).select("bucket", "path", "kind", "confidence", F.col("b.tie").alias("b_tie"), F.col("c.tie").alias("c_tie"))


#: Lines of orders as a larger workload: a file for each supplier, rules that no tool knows.
LINE_SQL = """
    diag AS (SELECT l_linenumber % 2 AS odd, 's' || l_suppkey AS path, l_returnflag || l_linestatus AS code, lower(l_returnflag || l_linestatus) AS canonical,
        CASE WHEN l_quantity < 10 THEN 'info' WHEN l_quantity < 40 THEN 'warning' ELSE 'error' END AS severity, l_linestatus AS message,
        CAST(day(l_shipdate) AS BIGINT) AS line, CAST(month(l_shipdate) AS BIGINT) AS col, CAST(l_orderkey AS BIGINT) AS tie FROM lineitem),
    b AS (SELECT *, row_number() OVER (PARTITION BY path, canonical ORDER BY line, col, code, message, severity_rank(severity), tie) AS n FROM diag WHERE odd = 0),
    c AS (SELECT *, row_number() OVER (PARTITION BY path, canonical ORDER BY line, col, code, message, severity_rank(severity), tie) AS n FROM diag WHERE odd = 1)"""


def line_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = demo.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
    odd, none = F.col("l_linenumber") % 2 == 1, F.lit(None).cast("long")
    return x.select(
        F.when(odd, "candidate").otherwise("baseline").alias("side"), F.when(odd, "biome").otherwise("eslint").alias("tool"), F.concat(F.lit("s"), "l_suppkey").alias("path"), F.concat("l_returnflag", "l_linestatus").alias("code"),
        F.when(F.col("l_quantity") < 10, "info").when(F.col("l_quantity") < 40, "warning").otherwise("error").alias("severity"), F.col("l_linestatus").alias("message"),
        F.dayofmonth("l_shipdate").cast("long").alias("start_line"), F.month("l_shipdate").cast("long").alias("start_column"), none.alias("end_line"), none.alias("end_column"), F.col("l_orderkey").cast("long").alias("tie"),
    )


_FP = """sha256(concat_ws(chr(0), CASE odd WHEN 1 THEN 'Biome' ELSE 'Eslint' END, path, 'Some("' || canonical || '")', CASE severity WHEN 'info' THEN 'Info' WHEN 'warning' THEN 'Warning' ELSE 'Error' END, message,
    'Some(Span { start_line: ' || line || ', start_column: ' || col || ', end_line: None, end_column: None })'))"""
LINE_LINK_SQL = f"""
    WITH RECURSIVE {LINE_SQL.replace("severity_rank(severity)", _FP)},
    l AS (SELECT b.path, b.canonical, b.n AS bn, list_sort(list({{'dl': abs(b.line - c.line), 'dc': abs(b.col - c.col), 'cn': c.n}})) AS ks FROM b JOIN c ON b.path = c.path AND b.canonical = c.canonical GROUP BY ALL),
    top AS (SELECT path, canonical, max(n) AS n FROM b GROUP BY ALL),
    walk AS (
        SELECT path, canonical, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS cn FROM top
        UNION ALL
        SELECT path, canonical, n, CASE WHEN k IS NULL THEN used ELSE list_append(used, k.cn) END, k.cn FROM (
            SELECT w.path, w.canonical, w.n + 1 AS n, w.used, list_filter(l.ks, lambda x: NOT list_contains(w.used, x.cn))[1] AS k
            FROM walk w JOIN top t ON t.path = w.path AND t.canonical = w.canonical AND w.n < t.n LEFT JOIN l ON l.path = w.path AND l.canonical = w.canonical AND l.bn = w.n + 1)),
    matched AS (SELECT b.path, CASE WHEN b.line <> c.line OR b.col <> c.col THEN 'range_changed' WHEN b.severity <> c.severity THEN 'severity_changed' WHEN b.message <> c.message THEN 'message_changed' ELSE 'exact_match' END AS kind
        FROM walk w JOIN b ON b.path = w.path AND b.canonical = w.canonical AND b.n = w.n JOIN c ON c.path = w.path AND c.canonical = w.canonical AND c.n = w.cn)"""


@query(
    "j1_line_links",
    f"""{LINE_LINK_SQL}, x AS (SELECT path, count(*) FILTER (kind = 'exact_match') AS exact, count(*) FILTER (kind = 'range_changed') AS ranges, count(*) FILTER (kind = 'severity_changed') AS severities, count(*) AS matches FROM matched GROUP BY path),
        d AS (SELECT path, count(*) FILTER (odd = 0) AS nb, count(*) FILTER (odd = 1) AS nc FROM diag GROUP BY path)
        SELECT d.path, coalesce(exact, 0) AS exact, coalesce(ranges, 0) AS ranges, coalesce(severities, 0) AS severities, nb - coalesce(matches, 0) AS unmapped_baseline, nc - coalesce(matches, 0) AS unmapped_candidate FROM d LEFT JOIN x USING (path)""",
)
def j1_line_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 over order lines, counted by file: the larger workload of the bench."""
    links = matching.linked(line_diagnostics(spark, sf_dir), Mappings(), "eslint", "biome")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return links.groupBy("path").agg(
        n(F.col("kind") == "exact_match").alias("exact"), n(F.col("kind") == "range_changed").alias("ranges"), n(F.col("kind") == "severity_changed").alias("severities"),
        n(F.col("bucket") == "unmapped_baseline").alias("unmapped_baseline"), n(F.col("bucket") == "unmapped_candidate").alias("unmapped_candidate"),
    )


@query("w1_order", f"WITH {demo.EVENT_SQL} SELECT 'baseline' AS side, path, n AS place, tie FROM b UNION ALL SELECT 'candidate', path, n, tie FROM c")
def w1_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each diagnostic in its file's order."""
    d = matching.with_identity(demo.event_diagnostics(spark, sf_dir), demo.MAPPINGS).withColumn("key", matching.sort_key())
    place = F.row_number().over(Window.partitionBy("side", "path").orderBy("key"))
    return d.select("side", "path", place.cast("long").alias("place"), "tie")


CATEGORY_SQL = "CASE WHEN bucket = 'match' THEN kind WHEN bucket LIKE 'unmapped%' THEN bucket || '_only' ELSE bucket END"
SIDE_SQL = "CASE WHEN bucket = 'match' THEN 'both' WHEN bucket LIKE '%_only' THEN left(bucket, length(bucket) - 5) ELSE bucket END"


@query(
    "u1_signatures",
    f"""{demo.LINK_SQL}, n AS (SELECT *, canonical FROM links LEFT JOIN (SELECT DISTINCT code, canonical FROM diag) d ON d.code = coalesce(b_code, c_code) WHERE kind IS NULL OR kind <> 'exact_match')
        SELECT {SIDE_SQL} AS side, {CATEGORY_SQL} AS category, canonical AS code, count(*) AS n FROM n GROUP BY ALL""",
)
def u1_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mismatch signatures, positions left out, with how often each occurs."""
    return reduction.mismatches(event_links(spark, sf_dir)).groupBy("side", "category", "code").agg(F.count("*").alias("n"))


@query(
    "r4_lint_signatures",
    f"""{demo.LINK_SQL}, x AS (SELECT l.path, l.bucket, l.kind, b.canonical AS bcode, b.message AS bm, b.severity AS bs, c.canonical AS ccode, c.message AS cm, c.severity AS cs
            FROM links l LEFT JOIN b ON b.tie = l.b_tie LEFT JOIN c ON c.tie = l.c_tie WHERE l.kind IS NULL OR l.kind <> 'exact_match')
        SELECT path, {SIDE_SQL} AS side, {CATEGORY_SQL} AS category, coalesce(bcode, ccode) AS code, bm AS baseline_message, bs AS baseline_severity, cm AS candidate_message, cs AS candidate_severity, count(*) AS n FROM x GROUP BY ALL""",
)
def r4_lint_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signatures that a reduction of each file chooses from."""
    x = reduction.mismatches(event_links(spark, sf_dir)).select(
        "path", "side", "category", "code", F.col("baseline.message").alias("baseline_message"), F.col("baseline.severity").alias("baseline_severity"),
        F.col("candidate.message").alias("candidate_message"), F.col("candidate.severity").alias("candidate_severity"),
    )
    return x.groupBy(*x.columns).agg(F.count("*").alias("n"))


@query(
    "w2_report_order",
    f"""{demo.LINK_SQL}, x AS (SELECT l.bucket, l.path, l.kind, l.b_tie, l.c_tie, coalesce(b.line, c.line) AS line, coalesce(b.col, c.col) AS col, coalesce(b.code, c.code) AS code, coalesce(b.message, c.message) AS message,
            coalesce(b.fingerprint, c.fingerprint) AS fingerprint, coalesce(b.tie, c.tie) AS tie FROM links l LEFT JOIN b ON b.tie = l.b_tie LEFT JOIN c ON c.tie = l.c_tie)
        SELECT bucket, path, b_tie, c_tie, row_number() OVER (PARTITION BY bucket, path ORDER BY line, col,
            CASE kind WHEN 'exact_match' THEN 0 WHEN 'approximate_rule_match' THEN 1 WHEN 'severity_changed' THEN 3 WHEN 'range_changed' THEN 4 WHEN 'message_changed' THEN 5 END,
            CASE WHEN bucket <> 'match' THEN code END, CASE WHEN bucket <> 'match' THEN message END, fingerprint, tie) AS place FROM x""",
)
def w2_report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each link in its file's part of a report section."""
    place = F.row_number().over(Window.partitionBy("bucket", "path").orderBy(*report.link_order()))
    return event_links(spark, sf_dir).select("bucket", "path", F.col("b.tie").alias("b_tie"), F.col("c.tie").alias("c_tie"), place.cast("long").alias("place"))


@query(
    "l1_first_residuals",
    f"""{demo.LINK_SQL} SELECT x.path, x.tie FROM (SELECT b.path, b.tie, b.line, b.col, b.code, b.message, b.fingerprint FROM links JOIN b ON b.tie = links.b_tie WHERE bucket = 'baseline_only'
        ORDER BY b.path, b.line, b.col, b.code, b.message, b.fingerprint, b.tie LIMIT 20) x""",
)
def l1_first_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 baseline residuals in order."""
    return event_links(spark, sf_dir).where("bucket = 'baseline_only'").orderBy(*report.link_order()).limit(report.SHOWN).select("path", F.col("b.tie").alias("tie"))


@query(
    "l2_nth_mismatch",
    f"""{demo.LINK_SQL}, f AS (SELECT b.path, line, col, code, message, fingerprint, tie FROM b JOIN links ON b.tie = links.b_tie WHERE bucket = 'baseline_only' ORDER BY b.path, line, col, code, message, fingerprint, tie LIMIT 1 OFFSET 7) SELECT path, tie FROM f""",
)
def l2_nth_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: the mismatch at an offset."""
    return reduction.nth_mismatch(event_links(spark, sf_dir), "baseline_only", 7).select("path", F.col("b.tie").alias("tie"))


@query(
    "p7_differences",
    f"""{demo.LINK_SQL}, d AS (SELECT path, bool_or(bucket IN ('baseline_only', 'candidate_only') OR coalesce(kind IN ('severity_changed', 'range_changed', 'message_changed'), false)) AS comparable,
            bool_or(bucket <> 'match' OR kind IN ('severity_changed', 'range_changed', 'message_changed')) AS raw FROM links GROUP BY path)
        SELECT path, comparable, raw, CASE WHEN comparable THEN 1 ELSE 0 END AS exit_code FROM d""",
)
def p7_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each file differs under either profile, and the exit code."""
    d = scoring.differences(event_links(spark, sf_dir), "path")
    return d.withColumn("exit_code", scoring.outcome(F.col("comparable"), F.lit(0), "difference"))


#: Rules and aliases out of parts and suppliers: three ways round, spellings with spaces, both confidences.
MAPPING_SQL = """
    rules AS (
        SELECT CASE p_partkey % 4 WHEN 0 THEN 'eslint' WHEN 3 THEN 'oxlint' ELSE 'biome' END AS baseline_tool, CASE p_partkey % 4 WHEN 1 THEN 'lint/' || p_type WHEN 2 THEN 'lint/' || p_type ELSE p_brand END AS baseline,
            CASE p_partkey % 4 WHEN 0 THEN 'biome' WHEN 1 THEN 'eslint' WHEN 2 THEN 'oxlint' ELSE 'eslint' END AS candidate_tool, CASE p_partkey % 4 WHEN 0 THEN 'lint/' || p_type ELSE p_brand || ' ' END AS candidate,
            CASE p_size % 3 WHEN 0 THEN 'approximate' WHEN 1 THEN 'exact' END AS confidence, CASE WHEN p_size % 2 = 0 THEN 'size ' || p_size % 4 END AS notes FROM part),
    aliases AS (
        SELECT s_suppkey AS alias_id, 'eslint' AS tool, s_name AS code FROM supplier UNION ALL SELECT s_suppkey, 'biome', 'lint/n' || s_nationkey FROM supplier WHERE s_suppkey % 3 > 0
        UNION ALL SELECT s_suppkey, 'oxlint', 'n' || s_nationkey FROM supplier WHERE s_suppkey % 5 > 0),
    pairs AS (
        SELECT {'t': list_position(['eslint', 'biome', 'oxlint'], baseline_tool), 'c': trim(baseline)} AS a, {'t': list_position(['eslint', 'biome', 'oxlint'], candidate_tool), 'c': trim(candidate)} AS b,
            CASE WHEN confidence = 'approximate' THEN 1 ELSE 0 END AS confidence FROM rules
        UNION ALL SELECT {'t': list_position(['eslint', 'biome', 'oxlint'], x.tool), 'c': x.code}, {'t': list_position(['eslint', 'biome', 'oxlint'], y.tool), 'c': y.code}, 0 FROM aliases x JOIN aliases y USING (alias_id)
            WHERE list_position(['eslint', 'biome', 'oxlint'], x.tool) < list_position(['eslint', 'biome', 'oxlint'], y.tool)),
    mapped AS (SELECT DISTINCT CASE WHEN a < b THEN a ELSE b END AS a, CASE WHEN a < b THEN b ELSE a END AS b, confidence FROM pairs)"""


def configured(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p, s = demo.table(spark, sf_dir, "part"), demo.table(spark, sf_dir, "supplier")
    k, native, brand = F.col("p_partkey") % 4, F.concat(F.lit("lint/"), "p_type"), F.col("p_brand")
    rules = p.select(
        F.when(k == 0, "eslint").when(k == 3, "oxlint").otherwise("biome").alias("baseline_tool"), F.when(k.isin(1, 2), native).otherwise(brand).alias("baseline"),
        F.when(k == 0, "biome").when(k == 2, "oxlint").otherwise("eslint").alias("candidate_tool"), F.when(k == 0, native).otherwise(F.concat(brand, F.lit(" "))).alias("candidate"),
        F.when(F.col("p_size") % 3 == 0, "approximate").when(F.col("p_size") % 3 == 1, "exact").alias("confidence"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("size "), F.col("p_size") % 4)).alias("notes"),
    )
    nation = F.col("s_nationkey")
    own = F.array(
        F.struct(F.lit("eslint").alias("tool"), F.col("s_name").alias("code")), F.struct(F.lit("biome").alias("tool"), F.when(F.col("s_suppkey") % 3 > 0, F.concat(F.lit("lint/n"), nation)).alias("code")),
        F.struct(F.lit("oxlint").alias("tool"), F.when(F.col("s_suppkey") % 5 > 0, F.concat(F.lit("n"), nation)).alias("code")),
    )
    return rules, s.select(F.col("s_suppkey").alias("alias_id"), F.inline(own))


@query("j8_mapping_table", f"WITH {MAPPING_SQL} SELECT CAST(a.t - 1 AS INTEGER) AS t1, a.c AS c1, CAST(b.t - 1 AS INTEGER) AS t2, b.c AS c2, confidence FROM mapped")
def j8_mapping_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured rules and pairs of aliases, each once, in the order of tools."""
    return mapping_tables.mapping_table(*configured(spark, sf_dir))


@query("j9_oriented_mappings", f"""WITH {MAPPING_SQL}, x AS (
        SELECT baseline, candidate, coalesce(confidence, 'exact') AS confidence, notes FROM rules WHERE baseline_tool = 'eslint' AND candidate_tool = 'biome'
        UNION SELECT candidate, baseline, coalesce(confidence, 'exact'), notes FROM rules WHERE baseline_tool = 'biome' AND candidate_tool = 'eslint'
        UNION SELECT x.code, y.code, 'exact', 'from an alias' FROM aliases x JOIN aliases y USING (alias_id) WHERE x.tool = 'eslint' AND y.tool = 'biome')
    SELECT 'eslint' AS baseline_tool, baseline, 'biome' AS candidate_tool, candidate, confidence, notes FROM x""")
def j9_oriented_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mappings between two tools, turned to baseline and candidate."""
    return mapping_tables.oriented(*configured(spark, sf_dir), "eslint", "biome")


@query("a10_configured_counts", f"""WITH {MAPPING_SQL} SELECT ['eslint', 'biome', 'oxlint'][a.t] AS baseline_tool, ['eslint', 'biome', 'oxlint'][b.t] AS candidate_tool, count(*) FILTER (confidence = 0) AS exact,
    count(*) FILTER (confidence = 1) AS approximate FROM mapped GROUP BY ALL""")
def a10_configured_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: exact and approximate mappings by pair of tools."""
    return mapping_tables.configured_counts(mapping_tables.mapping_table(*configured(spark, sf_dir)))


def diagnostic_sql(x: str, tool: str) -> str:
    """A diagnostic as JSON."""
    text = lambda name, column: f"""',"{name}":"' || {x}.{column} || '"'"""
    members = " || ".join([text("path", "path"), text("code", "code"), text("canonicalCode", "canonical"), text("severity", "severity"), text("message", "message")])
    span = f"""',"span":' || '{{"startLine":' || {x}.line || ',"startColumn":' || {x}.col || '}}'"""
    return f"""'{{"tool":"{tool}"' || {members} || {span} || {text("fingerprint", "fingerprint")} || '}}'"""


_B, _C = diagnostic_sql("b", "eslint"), diagnostic_sql("c", "biome")


@query(
    "k1_report_documents",
    f"""{demo.LINK_SQL} SELECT CASE bucket WHEN 'match' THEN 'matches' WHEN 'baseline_only' THEN 'baselineOnly' WHEN 'candidate_only' THEN 'candidateOnly' WHEN 'unmapped_baseline' THEN 'unmappedBaseline' ELSE 'unmappedCandidate' END AS section, l.path,
            CASE WHEN bucket = 'match' THEN '{{"kind":"' || l.kind || '","mappingConfidence":"' || CASE l.confidence WHEN 0 THEN 'exact' ELSE 'approximate' END || '","baseline":' || {_B} || ',"candidate":' || {_C} || '}}'
            WHEN l.b_tie IS NOT NULL THEN {_B} ELSE {_C} END AS json FROM links l LEFT JOIN b ON b.tie = l.b_tie LEFT JOIN c ON c.tie = l.c_tie""",
)
def k1_report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, K8: the report's links as JSON documents by section."""
    return report.link_documents(event_links(spark, sf_dir))


@query("k8_lint_report", f"""WITH {demo.EVENT_SQL} SELECT 'baseline' AS side, {_B} AS json FROM b UNION ALL SELECT 'candidate', {_C} FROM c""")
def k8_lint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: the diagnostics of both tools' runs, as a lint report holds them."""
    side = lambda s, name: F.struct(F.lit(s).alias("side"), F.to_json(report.diagnostic_json(name)).alias("json"))
    return event_links(spark, sf_dir).select(F.inline(F.array(side("baseline", "b"), side("candidate", "c")))).where("json IS NOT NULL")


@query(
    "k3_report_sink",
    f"""{demo.LINK_SQL}, x AS (SELECT l.*, coalesce(b.line, c.line) AS line, coalesce(b.col, c.col) AS col, coalesce(b.code, c.code) AS code, coalesce(b.message, c.message) AS message, coalesce(b.fingerprint, c.fingerprint) AS fingerprint,
            coalesce(b.tie, c.tie) AS tie, {_B} AS bj, {_C} AS cj FROM links l LEFT JOIN b ON b.tie = l.b_tie LEFT JOIN c ON c.tie = l.c_tie),
        y AS (SELECT CASE bucket WHEN 'match' THEN 'matches' WHEN 'baseline_only' THEN 'baselineOnly' WHEN 'candidate_only' THEN 'candidateOnly' WHEN 'unmapped_baseline' THEN 'unmappedBaseline' ELSE 'unmappedCandidate' END AS section,
            row_number() OVER (PARTITION BY bucket ORDER BY path, line, col, CASE kind WHEN 'exact_match' THEN 0 WHEN 'approximate_rule_match' THEN 1 WHEN 'severity_changed' THEN 3 WHEN 'range_changed' THEN 4 WHEN 'message_changed' THEN 5 END,
                CASE WHEN bucket <> 'match' THEN code END, CASE WHEN bucket <> 'match' THEN message END, fingerprint, tie) - 1 AS n,
            CASE WHEN bucket = 'match' THEN '{{"kind":"' || kind || '","mappingConfidence":"' || CASE confidence WHEN 0 THEN 'exact' ELSE 'approximate' END || '","baseline":' || bj || ',"candidate":' || cj || '}}' WHEN b_tie IS NOT NULL THEN bj ELSE cj END AS json FROM x)
        SELECT * FROM y UNION ALL SELECT 'baseline.diagnostics', row_number() OVER (ORDER BY path, n) - 1, {_B} FROM b UNION ALL SELECT 'candidate.diagnostics', row_number() OVER (ORDER BY path, n) - 1, {_C} FROM c""",
)
def k3_report_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1-K3, K8: a lint report written by tasks into part files and read back in report order."""
    path = f"{shared_dir(spark).rstrip('/')}/report-{uuid.uuid4().hex}"
    report_sink.write(spark, path, {"mode": "lint"}, report_sink.lint_rows(event_links(spark, sf_dir)), report_sink.LINT_SECTIONS)
    return report_sink.read(spark, path)


#: A report for each user out of the events, in each dialect.
REPORT_SQL = """
    e AS (SELECT *, user_id AS report_id, 'src/u' || user_id || '.ts' AS path, CASE WHEN value < 3 THEN 0 WHEN value < 60 THEN 1 ELSE 2 END AS level, CAST(day(ts) AS BIGINT) AS line, CAST(hour(ts) + 1 AS BIGINT) AS col,
        row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events)"""
_LEVEL = "CASE level WHEN 0 THEN 'info' WHEN 1 THEN 'warning' ELSE 'error' END"


def report_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = demo.table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.col("user_id").cast("long").alias("report_id"), F.concat(F.lit("/project/src/u"), "user_id", F.lit(".ts")).alias("path"), "event_type",
        F.when(F.col("value") < 3, 0).when(F.col("value") < 60, 1).otherwise(2).alias("level"), F.dayofmonth("ts").alias("line"), (F.hour("ts") + 1).alias("col"),
    )


def gathered(events: DataFrame, member) -> DataFrame:
    """(report_id, members): the members of each report, by event."""
    return events.groupBy("report_id", "path").agg(F.array_sort(F.collect_list(F.struct("event_id", member.alias("m")))).alias("ms")).select("report_id", "path", F.transform("ms", lambda x: x.m).alias("members"))


def scanned(df: DataFrame) -> DataFrame:
    return df.select("report_id", "tie", "path", "code", "severity", "message", "start_line", "start_column", "end_line", "end_column")


@query("s1_event_reports", f"""WITH {REPORT_SQL} SELECT CAST(report_id AS BIGINT) AS report_id, CAST(n AS BIGINT) AS tie, path, CASE WHEN event_id % 7 <> 0 THEN event_type END AS code, {_LEVEL} AS severity, 'm' || event_id AS message, line AS start_line, col AS start_column,
    CASE WHEN event_id % 2 = 0 THEN line + 1 END AS end_line, CAST(NULL AS BIGINT) AS end_column, CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS BIGINT) END AS fix_start, CASE WHEN event_id % 3 = 0 THEN 'x' || event_id END AS fix_text FROM e""")
def s1_event_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each user, through VARIANT, with fixes."""
    k = F.col("event_id")
    fix = F.when(k % 3 == 0, F.struct(F.array(k, k + 2).alias("range"), F.concat(F.lit("x"), k).alias("text")))
    one = F.struct(F.when(k % 7 != 0, F.col("event_type")).alias("ruleId"), F.col("level").alias("severity"), F.concat(F.lit("m"), k).alias("message"), F.col("line"), F.col("col").alias("column"), F.when(k % 2 == 0, F.col("line") + 1).alias("endLine"), fix.alias("fix"))
    texts = gathered(report_events(spark, sf_dir), one).select("report_id", F.to_json(F.array(F.struct(F.col("path").alias("filePath"), F.col("members").alias("messages")))).alias("json"))
    found = reports.flat_reports(texts, demo.ROOT)
    return found.select("report_id", "tie", "path", "code", "severity", "message", "start_line", "start_column", "end_line", "end_column", F.col("fix.start").alias("fix_start"), F.col("fix.replacement").alias("fix_text"))


@query("s1_empty_reports", "SELECT CAST(event_id AS BIGINT) AS report_id, 'ESLint wrote an empty report' AS warning FROM events WHERE event_id % 3 > 0")
def s1_empty_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank reports are warnings, not errors."""
    k = F.col("event_id")
    texts = demo.table(spark, sf_dir, "events").select(k.cast("long").alias("report_id"), F.when(k % 3 == 0, "[]").when(k % 3 == 1, " \r\n\t").otherwise("").alias("json"))
    return reports.empty_warnings(texts, "eslint")


@query("s2_event_reports", f"""WITH {REPORT_SQL} SELECT CAST(report_id AS BIGINT) AS report_id, CAST(n AS BIGINT) AS tie, path, 'lint/' || event_type AS code, {_LEVEL} AS severity, 'm' || event_id AS message, line AS start_line, col AS start_column,
    CASE WHEN event_id % 2 = 0 THEN line END AS end_line, CASE WHEN event_id % 2 = 0 THEN col + 3 END AS end_column FROM e""")
def s2_event_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each user whose entries name their place in two ways."""
    k = F.col("event_id")
    start = F.struct(F.col("line"), F.col("col").alias("column"))
    end = F.when(k % 2 == 0, F.struct(F.col("line"), (F.col("col") + 3).alias("column")))
    level = F.element_at(F.array(F.lit("info"), F.lit("warning"), F.lit("error")), F.col("level") + 1)
    place = F.struct(F.struct(F.col("path").alias("file")).alias("path"), F.when(k % 3 == 0, start).alias("start"), F.when(k % 3 == 0, end).alias("end"), F.when(k % 3 != 0, F.struct(start.alias("start"), end.alias("end"))).alias("range"))
    one = F.struct(F.concat(F.lit("lint/"), "event_type").alias("category"), level.alias("severity"), F.concat(F.lit("m"), k).alias("description"), place.alias("location"))
    texts = gathered(report_events(spark, sf_dir), one).select("report_id", F.to_json(F.struct(F.col("members").alias("diagnostics"))).alias("json"))
    return scanned(reports.walked_reports(texts, demo.ROOT, "biome"))


@query("s3_event_reports", f"""WITH {REPORT_SQL}, s AS (SELECT e.*, CAST(event_id % 90 AS BIGINT) AS off, repeat('é' || chr(10) || 'ab' || chr(10), 12) AS body FROM e)
    SELECT CAST(report_id AS BIGINT) AS report_id, CAST(n AS BIGINT) AS tie, path, event_type AS code, {_LEVEL} AS severity, 'm' || event_id AS message,
        least(off, 72) // 6 * 2 + CASE WHEN least(off, 72) % 6 < 3 THEN 1 ELSE 2 END AS start_line, least(off, 72) % 3 + 1 AS start_column,
        least(off + 2, 72) // 6 * 2 + CASE WHEN least(off + 2, 72) % 6 < 3 THEN 1 ELSE 2 END AS end_line, least(off + 2, 72) % 3 + 1 AS end_column FROM s""")
def s3_event_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each user whose labels hold byte offsets into sources of their own."""
    k = F.col("event_id")
    level = F.element_at(F.array(F.lit("info"), F.lit("warning"), F.lit("error")), F.col("level") + 1)
    one = F.struct(F.col("path").alias("filename"), F.col("event_type").alias("code"), level.alias("severity"), F.concat(F.lit("m"), k).alias("message"), F.array(F.struct(F.struct((k % 90).alias("offset"), F.lit(2).alias("length")).alias("span"))).alias("labels"))
    events = report_events(spark, sf_dir)
    texts = gathered(events, one).select("report_id", F.to_json(F.struct(F.col("members").alias("diagnostics"))).alias("json"))
    sources = events.select(F.concat(F.lit("src/u"), "report_id", F.lit(".ts")).alias("path"), F.repeat(F.lit("é\nab\n"), 12).alias("text")).distinct()
    return scanned(reports.walked_reports(texts, demo.ROOT, "oxlint", sources))


#: Event reports of odd members, by kind: what is no member of its type is passed over, and column 0 stays 0.
_ODD = f"WITH {REPORT_SQL}, o AS (SELECT *, CAST(event_id AS BIGINT) AS k FROM e)"


def reports_of(events: DataFrame, member, around) -> DataFrame:
    """(report_id, json): the members of each report as JSON texts, by event, inside what ``around`` writes around their list."""
    own = events.groupBy("report_id", "path").agg(F.array_sort(F.collect_list(F.struct("event_id", member.alias("m")))).alias("ms"))
    return own.select("report_id", around(F.array_join(F.transform("ms", lambda x: x.m), ","), F.col("path")).alias("json"))


def said(template: str) -> Column:
    """JSON text with event_id, line and col in the places of <k>, <line> and <col>."""
    parts = re.split(r"<(\w+)>", template)
    names = {"k": "event_id", "line": "line", "col": "col"}
    return F.concat(*(F.col(names[x]).cast("string") if i % 2 else F.lit(x) for i, x in enumerate(parts)))


@query("s1_flat_reports", f"""{_ODD} SELECT CAST(report_id AS BIGINT) AS report_id, CAST(n AS BIGINT) AS tie, path, CASE k % 6 WHEN 0 THEN 'r' || k WHEN 2 THEN '@p/x' WHEN 5 THEN 'q' END AS code,
    CASE k % 6 WHEN 0 THEN 'error' WHEN 2 THEN 'warning' WHEN 4 THEN 'info' WHEN 5 THEN 'error' ELSE 'unknown' END AS severity, CASE k % 6 WHEN 0 THEN 'm' || k WHEN 3 THEN 'm' WHEN 4 THEN 'm' WHEN 5 THEN '' ELSE 'ESLint diagnostic' END AS message,
    CASE WHEN k % 6 IN (0, 2, 3, 4) THEN line END AS start_line, CAST(CASE k % 6 WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 4294967295 END AS BIGINT) AS start_column, CASE WHEN k % 6 = 0 THEN line END AS end_line, CAST(NULL AS BIGINT) AS end_column FROM o""")
def s1_flat_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages whose members are missing, of another type, or no 32-bit numbers."""
    kinds = (
        '{"ruleId":"r<k>","severity":2,"message":"m<k>","line":<line>,"column":0,"endLine":<line>,"endColumn":4294967296}', '{"ruleId":7,"severity":-1,"line":"2"}', '{"ruleId":"@p/x","severity":"WARN","message":null,"line":<line>}',
        '{"severity":1.5,"message":"m","line":<line>,"column":true}', '{"ruleId":null,"severity":0,"message":"m","line":<line>,"column":4294967295}', '{"ruleId":"q","severity":"2","message":"","line":-1,"column":3}',
    )
    member = F.element_at(F.array(*map(said, kinds)), (F.col("event_id") % 6 + 1).cast("int"))
    around = lambda ms, path: F.concat(F.lit('[{"filePath":"'), path, F.lit('","messages":['), ms, F.lit("]}]"))
    return scanned(reports.flat_reports(reports_of(report_events(spark, sf_dir), member, around), demo.ROOT))


#: A source of 12 times six bytes, two lines each, and the place of a byte offset in it.
BODY = "é\nab\n" * 12
_LINE_AT = "(least({0}, 72) // 6 * 2 + CASE WHEN least({0}, 72) % 6 < 3 THEN 1 ELSE 2 END)"
_COLUMN_AT = "(least({0}, 72) % 3 + 1)"


@query("s2_nested_reports", f"""{_ODD}, f AS (SELECT *, k % 3 AS kind, k % 90 AS spot, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS tie FROM o WHERE NOT (k % 3 = 1 AND k // 3 % 4 = 2) AND NOT (k % 3 = 2 AND k // 3 % 4 = 2))
    SELECT CAST(report_id AS BIGINT) AS report_id, CAST(tie AS BIGINT) AS tie, CASE kind WHEN 0 THEN path WHEN 1 THEN 'src/b.ts' ELSE '<unknown>' END AS path, CASE kind WHEN 0 THEN 'lint/a/x' WHEN 1 THEN 'v' || k END AS code,
        CASE kind WHEN 0 THEN 'warning' WHEN 1 THEN 'unknown' ELSE 'error' END AS severity, CASE kind WHEN 0 THEN 'd' || k WHEN 1 THEN 'a bc' || k ELSE 'Biome diagnostic' END AS message,
        CASE kind WHEN 2 THEN {_LINE_AT.format("spot")} ELSE line END AS start_line, CASE kind WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE {_COLUMN_AT.format("spot")} END AS start_column,
        CASE kind WHEN 0 THEN line WHEN 2 THEN {_LINE_AT.format("spot + 2")} END AS end_line, CASE kind WHEN 2 THEN {_COLUMN_AT.format("spot + 2")} END AS end_column FROM f""")
def s2_nested_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2a-S2f: entries in four kinds of wrappers, with column 0, parts of messages, values of codes, and offsets into sources that they carry."""
    kinds = (
        F.concat(F.lit('{"category":"lint/a/x","severity":"warning","description":"d'), F.col("event_id").cast("string"), F.lit('","location":{"path":{"file":"'), F.col("path"), F.lit('"},"start":{"line":'), F.col("line").cast("string"), F.lit(',"column":0},"end":{"line":'), F.col("line").cast("string"), F.lit('}},"extra":[1]}')),
        said('{"code":{"value":"v<k>","url":"u"},"message":[{"content":"a "},{"text":["b",{"content":"c<k>"}]}],"location":{"path":"src/b.ts","range":{"start":{"lineNumber":<line>,"columnNumber":2}}}}'),
        F.concat(F.lit('{"category":5,"code":"y","severity":"fatal","location":{"sourceCode":' + json.dumps(BODY) + ',"span":['), (F.col("event_id") % 90).cast("string"), F.lit(","), (F.col("event_id") % 90 + 2).cast("string"), F.lit("]}}")),
    )
    entry = F.element_at(F.array(*kinds), (F.col("event_id") % 3 + 1).cast("int"))
    # a bare entry counts if it has a category and a place; the others of that kind are hidden in members that nothing reads
    bare = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("[["), entry, F.lit("]]"))).otherwise(F.concat(F.lit('[{"other":'), entry, F.lit("}]")))
    w = F.floor(F.col("event_id") / 3) % 4
    member = (
        F.when(w == 0, F.concat(F.lit('{"diagnostics":['), entry, F.lit("]}"))).when(w == 1, F.concat(F.lit('{"diagnostic":'), entry, F.lit("}"))).when(w == 2, bare)
        .otherwise(F.concat(F.lit('{"category":"no","message":"no","diagnostics":['), entry, F.lit("]}")))
    )
    around = lambda ms, path: F.concat(F.lit("["), ms, F.lit("]"))
    return scanned(reports.walked_reports(reports_of(report_events(spark, sf_dir), member, around), demo.ROOT, "biome"))


@query("s3_labelled_reports", f"""{_ODD}, f AS (SELECT *, k % 4 AS kind, k % 90 AS spot FROM o)
    SELECT CAST(report_id AS BIGINT) AS report_id, CAST(n AS BIGINT) AS tie, CASE WHEN kind = 1 THEN 'src/none.ts' ELSE path END AS path, CASE kind WHEN 0 THEN 'eslint(x)' WHEN 1 THEN 'z' || k WHEN 2 THEN 'q' END AS code,
        CASE kind WHEN 0 THEN 'error' ELSE 'unknown' END AS severity, CASE kind WHEN 2 THEN 'Oxlint diagnostic' ELSE 'm' || k END AS message, CASE kind WHEN 1 THEN NULL WHEN 2 THEN {_LINE_AT.format("spot")} ELSE line END AS start_line,
        CASE kind WHEN 0 THEN 0 WHEN 2 THEN {_COLUMN_AT.format("spot")} WHEN 3 THEN 1 END AS start_column, CASE kind WHEN 0 THEN line + 1 WHEN 2 THEN {_LINE_AT.format("spot")} WHEN 3 THEN {_LINE_AT.format("spot + 4")} END AS end_line,
        CASE kind WHEN 2 THEN {_COLUMN_AT.format("spot")} WHEN 3 THEN {_COLUMN_AT.format("spot + 4")} END AS end_column FROM f""")
def s3_labelled_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3a-S3d, J11: paths of the object around, codes by name, lines with ends by offset, and offsets alone, through line starts."""
    kinds = (
        '{"code":"eslint(x)","severity":"error","message":"m<k>","line":<line>,"column":0,"endLine":<line+1>}', '{"filename":"src/none.ts","code":{"name":"z<k>"},"message":"m<k>","labels":[{"span":{"offset":4,"length":2}}]}',
        '{"ruleId":"q","message":7,"span":{"offset":<at>}}', '{"code":{"other":1},"message":"m<k>","labels":[{"span":{"line":<line>,"offset":<at>,"length":4}}],"span":{"line":1}}',
    )
    at, below = (F.col("event_id") % 90).cast("string"), (F.col("line") + 1).cast("string")
    filled = [F.replace(F.replace(said(t.replace("<at>", "[at]").replace("<line+1>", "[below]")), F.lit("[at]"), at), F.lit("[below]"), below) for t in kinds]
    member = F.element_at(F.array(*filled), (F.col("event_id") % 4 + 1).cast("int"))
    around = lambda ms, path: F.concat(F.lit('[{"filePath":"'), path, F.lit('","messages":['), ms, F.lit("]}]"))
    events = report_events(spark, sf_dir)
    sources = events.select(F.concat(F.lit("src/u"), "report_id", F.lit(".ts")).alias("path")).distinct().withColumn("text", F.lit(BODY))
    return scanned(reports.walked_reports(reports_of(events, member, around), demo.ROOT, "oxlint", sources))


#: Offsets of a text: some three hundred, and some past its end.
_STEP = "greatest(size // 300, 1)"


@query("f5_line_index", f"""WITH t AS (SELECT doc_id, text, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents WHERE text IS NOT NULL),
    parts AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM t),
    starts AS (SELECT doc_id, n, CAST(coalesce(sum(octet_length(encode(part)) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM parts),
    spots AS (SELECT doc_id, unnest(range(0, size + 3 * {_STEP}, {_STEP})) AS byte_offset, size FROM t)
    SELECT o.doc_id, o.byte_offset, s.n AS line, least(o.byte_offset, o.size) - s.start + 1 AS col FROM (SELECT *, least(byte_offset, size) AS spot FROM spots) o ASOF JOIN starts s ON o.doc_id = s.doc_id AND o.spot >= s.start""")
def f5_line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hundreds of byte offsets a document, through the line starts of each."""
    docs = demo.table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.col("doc_id").cast("string").alias("path"), "text")
    size = F.octet_length("text").cast("long")
    step = F.greatest(F.floor(size / 300), F.lit(1).cast("long"))
    spots = docs.select("doc_id", "path", F.explode(F.sequence(F.lit(0).cast("long"), size + 3 * step - 1, step)).alias("byte_offset"))
    found = lines.with_positions(spots, lines.line_index(docs), "path", at="byte_offset")
    return found.select("doc_id", "byte_offset", F.col("at.line").alias("line"), F.col("at.column").alias("col"))


@query("s1_captured_reports", f"""WITH {REPORT_SQL} SELECT CAST(report_id AS BIGINT) AS report_id, CASE user_id % 3 WHEN 0 THEN 'eslint' WHEN 1 THEN 'biome' ELSE 'oxlint' END AS tool, CAST(n AS BIGINT) AS tie, path, event_type AS code, {_LEVEL} AS severity, 'm' || event_id AS message,
    line AS start_line, CAST(event_id % 3 AS BIGINT) AS start_column FROM e WHERE user_id % 3 <> 1 AND {_LEVEL} IN ('warning', 'error')""")
def s1_captured_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of three tools, captured in files and read by the data source with its filters."""
    e, k = report_events(spark, sf_dir), F.col("event_id")
    level = F.element_at(F.array(F.lit("info"), F.lit("warning"), F.lit("error")), F.col("level") + 1)
    column, message = (k % 3).alias("column"), F.concat(F.lit("m"), k).alias("message")
    kinds = {
        "eslint": (F.struct(F.col("event_type").alias("ruleId"), F.col("level").alias("severity"), message, "line", column), lambda path, ms: F.to_json(F.array(F.struct(path.alias("filePath"), ms.alias("messages"))))),
        "biome": (F.struct(F.col("event_type").alias("category"), level.alias("severity"), message, F.struct(F.col("path"), F.struct("line", column).alias("start")).alias("location")), lambda path, ms: F.to_json(F.struct(ms.alias("diagnostics")))),
        "oxlint": (F.struct(F.col("path").alias("filename"), F.col("event_type").alias("code"), level.alias("severity"), message, "line", column), lambda path, ms: F.to_json(F.struct(ms.alias("diagnostics")))),
    }
    texts = None
    for n, (tool, (member, around)) in enumerate(kinds.items()):
        own = gathered(e.where(F.col("report_id") % 3 == n), member).select("report_id", F.lit(tool).alias("tool"), around(F.col("path"), F.col("members")).alias("json"))
        texts = own if texts is None else texts.unionByName(own)
    folder = f"{shared_dir(spark).rstrip('/')}/captured-{uuid.uuid4().hex}"
    report_source.capture(texts, folder)
    found = report_source.scan(spark, folder, demo.ROOT)
    return found.where(F.col("tool").isin("eslint", "oxlint") & F.col("severity").isin("warning", "error")).select("report_id", "tool", "tie", "path", "code", "severity", "message", "start_line", "start_column")


#: Spans out of the events: one line, some lines, and now and then thousands.
SPAN_SQL = """spans AS (SELECT event_id, event_id % 2 AS odd, 'u' || user_id AS path, CAST(day(ts) * 40 + hour(ts) AS BIGINT) AS a,
    CASE WHEN event_id % 5 < 2 THEN CAST(day(ts) * 40 + hour(ts) + CASE WHEN event_id % 35 = 0 THEN event_id ELSE event_id % 23 END AS BIGINT) END AS z FROM events)"""


@query("p13_overlaps", f"""WITH {SPAN_SQL} SELECT l.path, CAST(l.event_id AS BIGINT) AS left_id, CAST(r.event_id AS BIGINT) AS right_id FROM spans l JOIN spans r
    ON l.path = r.path AND l.odd = 0 AND r.odd = 1 AND (l.a = r.a OR (l.a <= coalesce(r.z, r.a) AND r.a <= coalesce(l.z, l.a)))""")
def p13_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the two sides that share a line or begin on the same one."""
    e, k = demo.table(spark, sf_dir, "events"), F.col("event_id")
    start = (F.dayofmonth("ts") * 40 + F.hour("ts")).cast("long")
    spans = e.select(k.cast("long").alias("id"), F.concat(F.lit("u"), "user_id").alias("path"), start.alias("start_line"), F.when(k % 5 < 2, start + F.when(k % 35 == 0, k).otherwise(k % 23)).cast("long").alias("end_line"))
    return overlap.overlap_pairs(spans.where("id % 2 = 0"), spans.where("id % 2 = 1"))


@query(
    "p13_probable_matches",
    f"""{demo.LINK_SQL}, lb AS (SELECT l.path, b.tie, b.line, b.col, b.n FROM links l JOIN b ON b.tie = l.b_tie WHERE l.c_tie IS NULL), lc AS (SELECT l.path, c.tie, c.line, c.col, c.n FROM links l JOIN c ON c.tie = l.c_tie WHERE l.b_tie IS NULL),
        near AS (SELECT x.path, x.tie AS b_tie, y.tie AS c_tie, row_number() OVER (PARTITION BY x.tie ORDER BY abs(x.col - y.col), y.n) AS l, row_number() OVER (PARTITION BY y.tie ORDER BY abs(x.col - y.col), x.n) AS r
            FROM lb x JOIN lc y ON x.path = y.path AND x.line = y.line)
        SELECT path, b_tie, c_tie FROM near WHERE l = 1 AND r = 1""",
)
def p13_probable_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probable matches among the residuals, which only this call makes."""
    links = overlap.with_probable(event_links(spark, sf_dir))
    return links.where("kind = 'probable_match'").select("path", F.col("b.tie").alias("b_tie"), F.col("c.tie").alias("c_tie"))
