"""One query for each scalar operator, over columns of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars, values
from ..operators.mappings import Mappings
from . import demo
from .register import projection, query

#: A path out of a page's address: below the root, outside it, or relative, with dots to fold.
PATH_SQL = """CASE page_id % 5 WHEN 0 THEN '/project/one/./two/../' WHEN 1 THEN 'lib//a/../../' WHEN 2 THEN '/other/project/' WHEN 3 THEN '../x/../..//' ELSE '/project/../' END
    || regexp_replace(url, '^[a-z]+://', '') || CASE page_id % 3 WHEN 0 THEN '/..' WHEN 1 THEN '/./b.ts' ELSE '' END"""


def path_column():
    p = F.col("page_id")
    head = F.when(p % 5 == 0, "/project/one/./two/../").when(p % 5 == 1, "lib//a/../../").when(p % 5 == 2, "/other/project/").when(p % 5 == 3, "../x/../..//").otherwise("/project/../")
    return F.concat(head, F.regexp_replace("url", "^[a-z]+://", ""), F.when(p % 3 == 0, "/..").when(p % 3 == 1, "/./b.ts").otherwise(""))


projection(
    "f1_normalize_path", "pages", lambda: {"page_id": "page_id", "path": scalars.normalize_path(path_column(), demo.ROOT)},
    f"""WITH p AS (SELECT page_id, {PATH_SQL} AS raw FROM pages),
        s AS (SELECT page_id, list_filter(string_split(CASE WHEN raw LIKE '/%' THEN raw ELSE '/project/' || raw END, '/'), lambda x: x NOT IN ('', '.')) AS c FROM p),
        t AS (SELECT page_id, CASE WHEN c[1] = 'project' THEN c[2:] ELSE c END AS c FROM s),
        u AS (SELECT page_id, list_reduce(list_concat([''], c), lambda acc, x: CASE
            WHEN x = '..' AND acc <> '' AND regexp_extract(acc, '[^/]*$') <> '..' THEN regexp_replace(acc, '/?[^/]*$', '') WHEN acc = '' THEN x ELSE acc || '/' || x END) AS path FROM t)
        SELECT page_id, CASE WHEN path = '' THEN '.' ELSE path END AS path FROM u""",
)

#: A rule id in several spellings out of a part.
RULE_SQL = """CASE p_partkey % 6 WHEN 0 THEN 'lint/' || replace(p_type, ' ', '/') WHEN 1 THEN 'plugin(' || replace(p_name, ' ', '_') || 'IsX)' WHEN 2 THEN ' ' || replace(p_brand, '#', 'No') || 'HTMLTag '
    WHEN 3 THEN 'no__' || p_name || '--A' WHEN 4 THEN '@scope/useIsNan' ELSE 'eslint(noDuplicateKeys)' END"""
BASE_SQL = r"""trim(translate(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({r}), '^(?s:.*)\((?s:(.*))\)$', '\1'), '^(?s:.*)/', ''), '[_ -]+', '-', 'g'),
    '([a-z])([A-Z])', '\1-\2', 'g'), '([^-])([A-Z][a-z])', '\1-\2', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')"""


def rule_column():
    k, name = F.col("p_partkey") % 6, F.col("p_name")
    return (
        F.when(k == 0, F.concat(F.lit("lint/"), F.replace("p_type", F.lit(" "), F.lit("/"))))
        .when(k == 1, F.concat(F.lit("plugin("), F.replace(name, F.lit(" "), F.lit("_")), F.lit("IsX)")))
        .when(k == 2, F.concat(F.lit(" "), F.replace("p_brand", F.lit("#"), F.lit("No")), F.lit("HTMLTag ")))
        .when(k == 3, F.concat(F.lit("no__"), name, F.lit("--A")))
        .when(k == 4, "@scope/useIsNan")
        .otherwise("eslint(noDuplicateKeys)")
    )


projection("f2_canonical_base", "part", lambda: {"p_partkey": "p_partkey", "base": scalars.canonical_base(rule_column())}, f"SELECT p_partkey, {BASE_SQL.format(r=RULE_SQL)} AS base FROM part")
projection("f3_kebab", "part", lambda: {"p_partkey": "p_partkey", "kebab": scalars.kebab(F.concat("p_brand", F.lit("_ "), "p_type", F.lit("fooBarBAZQux")))},
    r"""SELECT p_partkey, trim(translate(regexp_replace(regexp_replace(regexp_replace(p_brand || '_ ' || p_type || 'fooBarBAZQux', '[_ -]+', '-', 'g'), '([a-z])([A-Z])', '\1-\2', 'g'), '([^-])([A-Z][a-z])', '\1-\2', 'g'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS kebab FROM part""")  # fmt: skip
projection("f4_canonical_rule", "part", lambda: {"p_partkey": "p_partkey", "rule": Mappings().canonical(rule_column())},
    f"""SELECT p_partkey, CASE b WHEN 'no-unused-variables' THEN 'no-unused-vars' WHEN 'no-unused-variable' THEN 'no-unused-vars' WHEN 'no-unreachable-code' THEN 'no-unreachable' WHEN 'use-is-nan' THEN 'use-isnan'
        WHEN 'use-constructor-super' THEN 'constructor-super' WHEN 'use-getter-return' THEN 'getter-return' WHEN 'no-duplicate-keys' THEN 'no-dupe-keys' WHEN 'no-duplicate-object-keys' THEN 'no-dupe-keys' ELSE b END AS rule
        FROM (SELECT p_partkey, {BASE_SQL.format(r=RULE_SQL)} AS b FROM part)""")  # fmt: skip
projection("f5_offset_position", "documents", lambda: {"doc_id": "doc_id", **{k: scalars.offset_position(F.col("text"), F.greatest(F.col("n_chars") - F.col("doc_id") % 97, F.lit(0)))[k] for k in ("line", "column")}},
    """WITH o AS (SELECT doc_id, least(greatest(n_chars - doc_id % 97, 0), strlen(text)) AS off, string_split(text, chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, off, unnest(range(1, len(ls) + 1)) AS i, unnest(list_transform(ls, lambda x: strlen(x) + 1)) AS n FROM o),
        c AS (SELECT doc_id, off, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS cum FROM l)
        SELECT doc_id, CAST(count(*) FILTER (cum <= off) + 1 AS BIGINT) AS line, CAST(any_value(off) - coalesce(max(cum) FILTER (cum <= off), 0) + 1 AS BIGINT) AS column FROM c GROUP BY doc_id""")  # fmt: skip


@query("f6_severity", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CASE WHEN floor(value) < 0 THEN 'unknown' WHEN floor(value) = 0 THEN 'info' WHEN floor(value) = 1 THEN 'warning' ELSE 'error' END
    WHEN event_id % 3 = 1 THEN CASE event_type WHEN 'error' THEN 'error' ELSE 'unknown' END ELSE 'unknown' END AS severity FROM events""")
def f6_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = demo.table(spark, sf_dir, "events"), F.col("event_id") % 3
    value = F.when(k == 0, F.floor("value").cast("long").cast("string")).otherwise(F.upper("event_type"))
    return e.select("event_id", scalars.severity(value, F.when(k == 0, "number").when(k == 1, "string").otherwise("boolean")).alias("severity"))


@query("f7_fingerprint", f"WITH {demo.EVENT_SQL} SELECT tie, fingerprint FROM shown")
def f7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.matching import with_identity

    return with_identity(demo.event_diagnostics(spark, sf_dir), demo.MAPPINGS).select("tie", "fingerprint")


projection("f8_content_hash", "documents", lambda: {"doc_id": "doc_id", "hash": scalars.content_hash(F.col("text"))}, "SELECT doc_id, sha256(text) AS hash FROM documents")
projection("f9_normalized_eol", "documents", lambda: {"doc_id": "doc_id", "hash": F.md5(scalars.normalized_eol(F.replace("text", F.lit("\n"), F.when(F.col("doc_id") % 2 == 0, "\r\n").otherwise("\r")), True))},
    "SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN text ELSE replace(text, chr(10), chr(13)) END) AS hash FROM documents")
projection("f10_success_stderr", "documents", lambda: {"doc_id": "doc_id", "warning": scalars.success_stderr(F.lit("oxlint"), F.when(F.col("doc_id") % 4 == 0, " \r\n\t \r").otherwise(F.concat(F.lit(" \r\n\r<"), "text", F.lit(">\r\n  \n"))))},
    r"""WITH t AS (SELECT doc_id, '<' || replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) || '>' AS x FROM documents)
        SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN 'Oxlint stderr:' || chr(10) || CASE WHEN length(x) > 4096 THEN left(x, 4096) || chr(10) || '… output truncated' ELSE x END END AS warning FROM t""")  # fmt: skip
projection("f11_truncated", "documents", lambda: {"doc_id": "doc_id", "short": scalars.truncated(F.col("text"), 100)},
    "SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || chr(10) || '… output truncated' ELSE text END AS short FROM documents")
projection("f12_shown_arguments", "part", lambda: {"p_partkey": "p_partkey", "shown": scalars.shown_arguments(F.array(F.lit("--a"), "p_name", "p_brand"))},
    """SELECT p_partkey, '--a ' || CASE WHEN regexp_matches(p_name, '\\s') THEN '"' || p_name || '"' ELSE p_name END || ' ' || CASE WHEN regexp_matches(p_brand, '\\s') THEN '"' || p_brand || '"' ELSE p_brand END AS shown FROM part""")  # fmt: skip
projection("f13_has_version", "part", lambda: {"p_partkey": "p_partkey", "same": scalars.has_version(F.concat(F.lit("Version: v0."), F.col("p_partkey") % 90, F.lit(".0 x")), "0.60.0")}, "SELECT p_partkey, p_partkey % 90 = 60 AS same FROM part")
projection("f14_line_count", "documents", lambda: {"doc_id": "doc_id", "n": scalars.line_count(F.concat("text", F.when(F.col("doc_id") % 2 == 0, "\n").otherwise("")))},
    "SELECT doc_id, CAST(CASE WHEN text = '' AND doc_id % 2 = 1 THEN 0 ELSE len(string_split(text, chr(10))) END AS INTEGER) AS n FROM documents")
projection("f15_human_bytes", "documents", lambda: {"doc_id": "doc_id", "size": scalars.human_bytes(F.octet_length("text"))},
    "SELECT doc_id, CASE WHEN strlen(text) < 1024 THEN strlen(text) || ' B' ELSE printf('%.1f KiB', CAST(CAST(strlen(text) / 1024.0 AS DECIMAL(38, 20)) AS DOUBLE)) END AS size FROM documents")
projection("f16_first_line", "documents", lambda: {"doc_id": "doc_id", "line": scalars.first_line(F.col("text"))}, "SELECT doc_id, string_split(text, chr(10))[1] AS line FROM documents")
projection("f17_tool_names", "events", lambda: {"event_id": "event_id", "name": scalars.lookup(F.element_at(F.array(*map(F.lit, values.TOOLS)), (F.col("event_id") % 5 + 1).cast("int")), values.TOOL_NAMES)},
    "SELECT event_id, ['ESLint', 'Biome', 'Oxlint', 'Prettier', 'Oxfmt'][event_id % 5 + 1] AS name FROM events")
projection("f18_tool_roles", "events", lambda: {"event_id": "event_id", "linter": scalars.is_linter(F.element_at(F.array(*map(F.lit, values.TOOLS)), (F.col("event_id") % 5 + 1).cast("int"))), "formatter": scalars.is_formatter(F.element_at(F.array(*map(F.lit, values.TOOLS)), (F.col("event_id") % 5 + 1).cast("int")))},
    "SELECT event_id, event_id % 5 < 3 AS linter, event_id % 5 IN (1, 3, 4) AS formatter FROM events")
projection("f19_reduced_name", "documents", lambda: {"doc_id": "doc_id", "name": scalars.reduced_name(F.concat("source", F.when(F.col("doc_id") % 2 == 0, "/a.b.tsx").otherwise("/file")))},
    "SELECT doc_id, source || CASE WHEN doc_id % 2 = 0 THEN '/a.b.reduced.tsx' ELSE '/file.reduced' END AS name FROM documents")
