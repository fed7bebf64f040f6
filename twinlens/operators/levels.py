"""Minimised reproductions over tables: delta debugging of all cases at once, a round at a time.

In a round every open case puts its next candidates, texts without one chunk of lines, into one table; the comparison itself (the
linkage of two linters' diagnostics, or two formatters' statuses) is run over that table; and the first candidate of a case that
still shows the case's mismatch becomes its text. A case looks at no more than ``WINDOW`` candidates a round, so a round's table is
bounded by the open texts. States are written between rounds; what a case has looked at goes along as digests, so
attempts are counted as by one who tries the candidates one after the other and each text once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bound, line_count
from ..shared import Steps
from . import formatting, matching, reduction
from .mappings import Mappings
from .report import link_order

#: Candidates of a case that a round looks at.
WINDOW = 32
#: (path, text) to the mismatches of each text: (path, signature, category, place), ``place`` the order of a report.
Comparison = Callable[[DataFrame], DataFrame]
#: (path, text) to diagnostics: a side and the DIAGNOSTIC columns.
Linters = Callable[[DataFrame], DataFrame]
RESULT = ("case_id", "category", "text", "attempts", "original_lines", "reduced_lines", "original_bytes", "reduced_bytes")


def signature(*members: Column) -> Column:
    """A digest of what a mismatch is."""
    return F.sha2(F.to_json(F.struct(*(m.alias(f"m{k}") for k, m in enumerate(members))), {"ignoreNullFields": "false"}), 256)


def lint_comparison(linters: Linters, mappings: Mappings, baseline_tool: str, candidate_tool: str) -> Comparison:
    """The mismatches of two linters by the linkage of a comparison; positions take no part in a signature."""

    def run(texts: DataFrame) -> DataFrame:
        links = matching.linked(linters(texts), mappings, baseline_tool, candidate_tool).where(reduction.is_mismatch())
        section = F.array_position(F.array(*map(F.lit, reduction.ORDER)), F.col("bucket"))
        order = F.struct(section.alias("section"), *(c.alias(f"k{i}") for i, c in enumerate(_ascending(link_order()[1:]))))
        named = reduction.mismatches(links.withColumn("place", order), "place")
        return named.select("path", signature(*(F.col(c) for c in ("side", "category", "code", "baseline", "candidate"))).alias("signature"), "category", "place")

    return run


def _ascending(order: list[Column]) -> list[Column]:
    """The members of an order as columns of a struct, in which nulls come first anyhow."""
    own = F.coalesce("b", "c")
    return [F.when(F.col("bucket") != "match", own["code"]) if k == 3 else c for k, c in enumerate(order)]


def format_comparison(baseline: formatting.Formatter, candidate: formatting.Formatter, failing: Column | None = None) -> Comparison:
    """The status of two formatters where they don't agree; a text that one fails on shows nothing."""

    def run(texts: DataFrame) -> DataFrame:
        out = formatting.compare(texts, baseline, candidate, failing).where(~F.col("status").isin("identical", "failed"))
        return out.select("path", signature(F.lit("both"), F.col("status")).alias("signature"), F.col("status").alias("category"), F.lit(0).alias("place"))

    return run


def pieces(text: Column) -> Column:
    """Lines with their newline; one empty line for an empty text."""
    parts = F.split(text, "\n", -1)
    last = F.size(parts) - 1
    whole = F.transform(F.slice(parts, F.lit(1), last), lambda p: F.concat(p, F.lit("\n")))
    return bound(parts, lambda p: F.when((F.element_at(p, -1) == "") & (F.size(p) > 1), whole).otherwise(F.concat(whole, F.slice(p, -1, 1))))


def without(lines: Column, at: Column, n: Column) -> Column:
    """The text of ``lines`` but ``n`` of them after the first ``at``."""
    rest = F.slice(lines, at + n + 1, F.greatest(F.size(lines) - at - n, F.lit(0)))
    return F.array_join(F.concat(F.slice(lines, F.lit(1), at), rest), "")


def text_key(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(32))


def _ready(state: DataFrame) -> DataFrame:
    """States with the chunk size and the chunks of their next round; texts of one line have no chunks but the line itself.

    A case looks at chunks of ``step`` lines, from chunk ``turn`` on, or at single lines from line ``turn`` on.
    """
    size = F.size("lines")
    step = F.when(F.col("single"), 1).otherwise(F.ceil(size / F.col("parts"))).cast("int")
    turns = F.when(F.col("single"), size).otherwise(F.ceil(size / F.col("step"))).cast("int")
    few = ~F.col("single") & (F.size("lines") <= 1)
    out = state.withColumn("turn", F.when(few, 0).otherwise(F.col("turn"))).withColumn("single", F.col("single") | few)
    return out.withColumn("step", step).withColumn("turns", turns).withColumn("open", ~F.col("single") | (F.col("turn") < F.size("lines")))


def _round(state: DataFrame, compared: Comparison, window: int) -> DataFrame:
    """The states after a round of the open ones."""
    last = F.least(F.col("turn") + window, F.col("turns")) - 1
    tries = state.select("row", "wanted", "seen", "lines", "step", F.explode(F.sequence("turn", last)).alias("k"))
    texts = tries.select("row", "wanted", "seen", "k", without(F.col("lines"), F.col("k") * F.col("step"), F.col("step")).alias("text"))
    # a text that was looked at before didn't show the mismatch, for it is shorter than all that did
    new = texts.where(~F.array_contains("seen", text_key(F.col("text"))))
    named = new.select(F.concat_ws("|", F.col("row").cast("string"), F.col("k").cast("string"), "wanted").alias("path"), "text")
    shown = compared(named).select(F.split("path", r"\|").alias("p"), "signature").where(F.col("signature") == F.col("p")[2])
    first = shown.groupBy(F.col("p")[0].cast("long").alias("row")).agg(F.min(F.col("p")[1].cast("int")).alias("first"))
    after = state.join(first, "row", "left")
    hit = F.col("first").isNotNull()
    tried = F.transform(F.sequence(F.col("turn"), F.coalesce("first", last)), lambda k: text_key(without(F.col("lines"), k * F.col("step"), F.col("step"))))
    fresh = F.array_except(F.array_distinct(tried), F.col("seen"))
    after = after.withColumn("fresh", fresh).withColumn("next", F.when(hit, F.col("first")).otherwise(last + 1))
    start, n = F.col("first") * F.col("step"), F.size("lines")
    rest = F.concat(F.slice("lines", F.lit(1), start), F.slice("lines", start + F.col("step") + 1, F.greatest(n - start - F.col("step"), F.lit(0))))
    spent = ~hit & ~F.col("single") & (F.col("next") >= F.col("turns"))
    return after.select(
        "row", "case_id", "category", "wanted", "original_lines", "original_bytes",
        F.when(hit, rest).otherwise(F.col("lines")).alias("lines"),
        F.when(F.col("single"), F.col("parts")).when(hit, F.greatest(F.col("parts") - 1, F.lit(2))).when(spent, F.least(2 * F.col("parts"), n)).otherwise(F.col("parts")).cast("int").alias("parts"),
        (F.col("single") | (spent & (F.col("parts") >= n))).alias("single"),
        F.when(F.col("single"), F.col("next")).when(hit | spent, 0).otherwise(F.col("next")).cast("int").alias("turn"),
        (F.col("attempts") + F.size("fresh")).alias("attempts"), F.concat("seen", "fresh").alias("seen"),
    )


def reduce_cases(cases: DataFrame, compared: Comparison, mismatch: int = 0, window: int = WINDOW) -> DataFrame:
    """Each text of (case_id, text) reduced to keep its ``mismatch``-th mismatch, with RESULT's columns.

    Chunks of lines go while the mismatch stays, finer and finer, then single lines once from left to right. A text without so many
    mismatches, a null one too, gives no row; repeated cases are reduced each for itself; extra columns are dropped. The
    rounds end when all cases are done: a case takes one for each chunk that goes, and one for each ``window`` that don't.
    """
    steps = Steps(cases.sparkSession)
    rows = steps.write(cases.where("text IS NOT NULL").select(F.monotonically_increasing_id().alias("row"), "case_id", "text"))
    found = compared(rows.select(F.col("row").cast("string").alias("path"), "text"))
    nth = found.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("place"))).where(F.col("n") == mismatch + 1)
    wanted = nth.select(F.col("path").cast("long").alias("row"), F.col("signature").alias("wanted"), "category")
    state = rows.join(wanted, "row").select(
        "row", "case_id", "category", "wanted", line_count(F.col("text")).alias("original_lines"), F.octet_length("text").alias("original_bytes"), pieces(F.col("text")).alias("lines"), F.lit(2).alias("parts"),
        F.lit(False).alias("single"), F.lit(0).alias("turn"), F.lit(0).alias("attempts"), F.array(text_key(F.col("text"))).alias("seen"),
    )
    state, done = steps.write(_ready(state)), []
    while True:
        done.append(state.where("NOT open"))
        state = state.where("open")
        if state.isEmpty():
            break
        state = steps.write(_ready(_round(state, compared, window)))
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    text = F.array_join("lines", "")
    return out.select("case_id", "category", text.alias("text"), "attempts", "original_lines", line_count(text).alias("reduced_lines"), "original_bytes", F.octet_length(text).alias("reduced_bytes"))


def checked(reduced: DataFrame, compared: Comparison) -> DataFrame:
    """(case_id, category, keeps, least) of reductions: whether a text shows its category, and none of those without one of its lines does.

    Ids are those of cases, each reduced once. Texts of one category are looked at by category alone.
    """
    lines = Steps(reduced.sparkSession).write(reduced.select("case_id", "category", pieces(F.col("text")).alias("lines")))
    whole = lines.select(F.concat_ws("|", F.col("case_id").cast("string"), F.lit("-")).alias("path"), F.array_join("lines", "").alias("text"))
    each = lines.select("case_id", "lines", F.explode(F.sequence(F.lit(0), F.size("lines") - 1)).alias("k"))
    each = each.select(F.concat_ws("|", F.col("case_id").cast("string"), F.col("k").cast("string")).alias("path"), without(F.col("lines"), F.col("k"), F.lit(1)).alias("text"))
    shown = compared(whole.union(each)).select(F.split("path", r"\|").alias("p"), F.col("category").alias("seen"))
    shown = shown.select(F.col("p")[0].cast("long").alias("case_id"), "seen", (F.col("p")[1] == "-").alias("is_whole"))
    found = lines.select("case_id", "category").join(shown, "case_id", "left").where(F.col("seen").isNull() | (F.col("seen") == F.col("category")))
    told = found.groupBy("case_id").agg(F.bool_or("is_whole").alias("keeps"), F.bool_or(~F.col("is_whole")).alias("smaller"))
    own = lines.select("case_id", "category").join(told, "case_id", "left")
    return own.select("case_id", "category", F.coalesce("keeps", F.lit(False)).alias("keeps"), (~F.coalesce("smaller", F.lit(False))).alias("least"))


def line_findings(texts: DataFrame, side: str, tool: str, rules: dict[str, Column | tuple[Column, Column, Column]]) -> DataFrame:
    """Diagnostics of a linter made of rules over a ``line``: (path, text) to a row for each line and rule that holds.

    A rule is a condition, or (condition, column, severity). The message is the line.
    """
    lines = texts.select("path", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    rows = []
    for k, (code, rule) in enumerate(rules.items()):
        holds, column, severity = rule if isinstance(rule, tuple) else (rule, F.lit(1), F.lit("warning"))
        rows.append(F.when(holds, F.struct(F.lit(code).alias("code"), severity.alias("severity"), column.cast("long").alias("start_column"), F.lit(k).alias("k"))))
    none = F.lit(None).cast("long")
    each = lines.select("path", "n", "line", F.explode(F.array_compact(F.array(*rows))).alias("f"))
    return each.select(
        F.lit(side).alias("side"), F.lit(tool).alias("tool"), "path", F.col("f.code").alias("code"), F.col("f.severity").alias("severity"), F.col("line").alias("message"), (F.col("n") + 1).cast("long").alias("start_line"),
        F.col("f.start_column").alias("start_column"), none.alias("end_line"), none.alias("end_column"), (F.col("n").cast("long") * len(rules) + F.col("f.k")).alias("tie"),
    )
