"""Summaries of a linkage: raw, comparable and mapping metrics, each one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dice, ratio
from .mappings import Mappings


def _counts(links: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    bucket, kind = F.col("bucket"), F.col("kind")
    return links.agg(
        n(bucket.isin("match", "baseline_only", "unmapped_baseline")).alias("baseline_diagnostics"),
        n(bucket.isin("match", "candidate_only", "unmapped_candidate")).alias("candidate_diagnostics"),
        n(kind == "exact_match").alias("exact_matches"),
        n(kind == "approximate_rule_match").alias("approximate_matches"),
        n(kind == "probable_match").alias("probable_matches"),
        n(bucket == "match").alias("matches"),
        n(bucket == "baseline_only").alias("baseline_only"),
        n(bucket == "candidate_only").alias("candidate_only"),
        n(bucket == "unmapped_baseline").alias("unmapped_baseline"),
        n(bucket == "unmapped_candidate").alias("unmapped_candidate"),
        n(kind == "severity_changed").alias("severity_changes"),
        n(kind == "range_changed").alias("range_changes"),
        n(kind == "message_changed").alias("message_changes"),
    )


def raw_summary(links: DataFrame) -> DataFrame:
    """One row over all diagnostics."""
    return _counts(links).select(
        "baseline_diagnostics", "candidate_diagnostics", "exact_matches", "approximate_matches", "probable_matches", "baseline_only", "candidate_only", "unmapped_baseline",
        "unmapped_candidate", "severity_changes", "range_changes", "message_changes", F.lit(0).cast("long").alias("tool_failures"),
        dice(F.col("exact_matches"), F.col("baseline_diagnostics"), F.col("candidate_diagnostics")).alias("exact_agreement"),
    )


def comparable_summary(links: DataFrame, discovered: Column, comparable: Column) -> DataFrame:
    """One row over diagnostics of rules that both tools know."""
    c = _counts(links).withColumn("b", F.col("matches") + F.col("baseline_only")).withColumn("c", F.col("matches") + F.col("candidate_only"))
    agreed = F.col("exact_matches") + F.col("approximate_matches") + F.col("probable_matches")
    return c.select(
        F.col("b").alias("baseline_diagnostics"), F.col("c").alias("candidate_diagnostics"), "exact_matches", "approximate_matches", "probable_matches", "baseline_only", "candidate_only",
        "severity_changes", "range_changes", "message_changes", dice(F.col("exact_matches"), F.col("b"), F.col("c")).alias("exact_agreement"),
        dice(agreed, F.col("b"), F.col("c")).alias("comparable_agreement"), ratio(comparable, discovered).alias("comparable_file_coverage"),
        ratio(F.col("matches"), F.col("b")).alias("baseline_coverage"), ratio(F.col("matches"), F.col("c")).alias("candidate_precision"),
    )


def observed_rules(diagnostics: DataFrame) -> DataFrame:
    """(side, codes): the distinct rules of each side, sorted; null rules don't count."""
    return diagnostics.groupBy("side").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def rule_classes(links: DataFrame, mappings: Mappings, baseline_tool: str, candidate_tool: str) -> DataFrame:
    """(side, code, class): each observed rule as exact, approximate or unmapped; matches decide before the configuration.

    A rule matched both ways is in both classes.
    """
    end = lambda s, name: F.struct(F.lit(s).alias("side"), F.col(f"{name}.code").alias("code"), F.when(F.col("bucket") == "match", F.col("confidence")).alias("conf"))
    seen = links.select(F.inline(F.array(end("baseline", "b"), end("candidate", "c")))).where("code IS NOT NULL")
    seen = seen.groupBy("side", "code").agg(F.collect_set("conf").alias("confs"))
    own = F.when(F.col("side") == "baseline", baseline_tool).otherwise(candidate_tool)
    other = F.when(F.col("side") == "baseline", candidate_tool).otherwise(baseline_tool)
    known = mappings.endpoint_confidence(own, F.col("code"), other)
    confs = F.when(F.size("confs") > 0, F.col("confs")).otherwise(F.array(F.coalesce(known, F.lit(2))))
    return seen.select("side", "code", F.explode(confs).alias("conf")).select("side", "code", F.element_at(F.array(F.lit("exact"), F.lit("approximate"), F.lit("unmapped")), F.col("conf") + 1).alias("class"))


def mapping_summary(links: DataFrame, mappings: Mappings, baseline_tool: str, candidate_tool: str) -> DataFrame:
    """One row: how many rules each side showed, how many are mapped which way, and the coverage (over 100 where a rule is mapped both ways)."""
    r = rule_classes(links, mappings, baseline_tool, candidate_tool)
    rule = F.concat_ws(":", "side", "code")
    c = r.agg(
        F.count_distinct(F.when(F.col("side") == "baseline", rule)).alias("observed_baseline"),
        F.count_distinct(F.when(F.col("side") == "candidate", rule)).alias("observed_candidate"),
        F.count_if(F.col("class") == "exact").alias("exact_mapped"),
        F.count_if(F.col("class") == "approximate").alias("approximate_mapped"),
        F.count_if((F.col("class") == "unmapped") & (F.col("side") == "baseline")).alias("unmapped_baseline"),
        F.count_if((F.col("class") == "unmapped") & (F.col("side") == "candidate")).alias("unmapped_candidate"),
    )
    return c.withColumn("coverage", ratio(F.col("exact_mapped") + F.col("approximate_mapped"), F.col("observed_baseline") + F.col("observed_candidate")))


def is_difference(profile: str = "comparable", count_probable: bool = False) -> Column:
    """Whether a link is a difference under a profile."""
    bad = F.col("bucket").isin("baseline_only", "candidate_only") | F.col("kind").isin("severity_changed", "range_changed", "message_changed")
    if profile == "raw":
        bad = bad | F.col("bucket").isin("unmapped_baseline", "unmapped_candidate")
    if not count_probable:
        bad = bad | (F.col("kind") == "probable_match")
    return F.coalesce(bad, F.lit(False))


def has_differences(links: DataFrame, profile: str = "comparable", count_probable: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """``differs``: whether any link is a difference under a profile; one row, or one for each value of the columns ``by``."""
    any_ = F.coalesce(F.bool_or(is_difference(profile, count_probable)), F.lit(False)).alias("differs")
    return links.groupBy(*by).agg(any_) if by else links.agg(any_)


def differences(links: DataFrame, *by: str) -> DataFrame:
    """(by, comparable, raw): whether any link is a difference under each profile, in one pass."""
    any_ = lambda profile: F.coalesce(F.bool_or(is_difference(profile)), F.lit(False)).alias(profile)
    return links.groupBy(*by).agg(any_("comparable"), any_("raw"))


def format_differs(summary: DataFrame) -> DataFrame:
    """``differs``: whether a format summary counts any file that differs or isn't idempotent."""
    return summary.select((F.col("different") + F.col("baseline_non_idempotent") + F.col("candidate_non_idempotent") + F.col("both_non_idempotent") > 0).alias("differs"))


def outcome(differs: Column, unsupported: Column, policy: str) -> Column:
    """Exit code: 3 for unsupported files under ``error``, 1 for differences, or for them under ``difference``, else 0."""
    refused = F.when((unsupported > 0) & F.lit(policy == "error"), 3)
    return F.coalesce(refused, F.when(differs | ((unsupported > 0) & F.lit(policy == "difference")), 1), F.lit(0))


def settled(differs: bool, unsupported: int, policy: str) -> int:
    """As ``outcome``, for one comparison on the driver."""
    if unsupported and policy == "error":
        return 3
    return 1 if differs or (unsupported and policy == "difference") else 0
