"""Configured mappings as tables, for configurations too large to be constants of a plan.

``rules`` are rows of baseline_tool, baseline, candidate_tool, candidate, confidence (null: exact) and notes; ``aliases`` rows of
alias_id, tool, code, one a tool. Rows without a tool or code name nothing and are passed over, unknown tools too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import lookup, strip
from ..functions.values import CONFIDENCES, TOOLS
from .mappings import FROM_ALIAS


def rank(tool: Column) -> Column:
    """A tool's place in the order of tools; null for another name."""
    return lookup(tool, {t: str(k) for k, t in enumerate(TOOLS)}).cast("int")


def confidence_rank(confidence: Column) -> Column:
    return lookup(F.coalesce(confidence, F.lit(CONFIDENCES[0])), {c: str(k) for k, c in enumerate(CONFIDENCES)}).cast("int")


def alias_rows(aliases: DataFrame) -> DataFrame:
    return aliases.select("alias_id", "tool", "code", rank(F.col("tool")).alias("at")).where("at IS NOT NULL AND code IS NOT NULL AND code <> ''").dropDuplicates(["alias_id", "at"])


def alias_pairs(aliases: DataFrame) -> DataFrame:
    """(t1, c1, t2, c2): each alias's rules in pairs, in the order of tools; at most one rule a tool, so an alias gives few."""
    rows = alias_rows(aliases)
    left, right = (rows.select("alias_id", F.col("at").alias(f"t{k}"), F.col("code").alias(f"c{k}")) for k in (1, 2))
    return left.join(right, "alias_id").where("t1 < t2").select("t1", "c1", "t2", "c2")


def mapping_table(rules: DataFrame, aliases: DataFrame) -> DataFrame:
    """(t1, c1, t2, c2, confidence): every configured pair once, ends in the order of tools, then codes; ordinals for names."""
    own = rules.select(rank(F.col("baseline_tool")).alias("t1"), "baseline", rank(F.col("candidate_tool")).alias("t2"), "candidate", confidence_rank(F.col("confidence")).alias("confidence"))
    pairs = alias_pairs(aliases).select("t1", F.col("c1").alias("baseline"), "t2", F.col("c2").alias("candidate"), F.lit(0).alias("confidence"))
    ends = own.unionByName(pairs).where("t1 IS NOT NULL AND t2 IS NOT NULL AND baseline IS NOT NULL AND candidate IS NOT NULL AND confidence IS NOT NULL").select(
        F.struct(F.col("t1").alias("t"), strip(F.col("baseline")).alias("c")).alias("a"), F.struct(F.col("t2").alias("t"), strip(F.col("candidate")).alias("c")).alias("b"), "confidence"
    )
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return ends.select(low.t.alias("t1"), low.c.alias("c1"), high.t.alias("t2"), high.c.alias("c2"), "confidence").distinct()


def configured_counts(table: DataFrame) -> DataFrame:
    """(baseline_tool, candidate_tool, exact, approximate) of a mapping table, by pair of tools."""
    name = lambda c: F.element_at(F.array(*map(F.lit, TOOLS)), F.col(c) + 1)
    return table.groupBy(name("t1").alias("baseline_tool"), name("t2").alias("candidate_tool")).agg(F.count_if(F.col("confidence") == 0).alias("exact"), F.count_if(F.col("confidence") == 1).alias("approximate"))


def oriented(rules: DataFrame, aliases: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """The mappings between two tools, turned to baseline and candidate, each once, with their notes; spelt as configured."""
    b, c = F.col("baseline_tool"), F.col("candidate_tool")
    direct, turned = (b == baseline) & (c == candidate), (b == candidate) & (c == baseline)
    own = rules.where(direct | turned).select(
        F.when(direct, F.col("baseline")).otherwise(F.col("candidate")).alias("baseline"), F.when(direct, F.col("candidate")).otherwise(F.col("baseline")).alias("candidate"),
        F.coalesce("confidence", F.lit(CONFIDENCES[0])).alias("confidence"), F.col("notes"),
    )
    side = lambda tool, name: alias_rows(aliases).where(F.col("tool") == tool).select("alias_id", F.col("code").alias(name))
    named = side(baseline, "baseline").join(side(candidate, "candidate"), "alias_id").select("baseline", "candidate", F.lit(CONFIDENCES[0]).alias("confidence"), F.lit(FROM_ALIAS).alias("notes"))
    both = own.unionByName(named).distinct()
    return both.select(F.lit(baseline).alias("baseline_tool"), "baseline", F.lit(candidate).alias("candidate_tool"), "candidate", "confidence", "notes")
