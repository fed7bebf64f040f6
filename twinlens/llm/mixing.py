"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, lang, source). A budget of tokens flows down the tree: each node shares its budget among its
children by weight, no child beyond what it can give (its tokens times ``max_epochs``), and what a short child cannot
take goes to its siblings; only what a whole family cannot take reaches its parent's siblings, because a parent's
limit is the sum of those of its leaves that have weight all the way down. A leaf takes whole passes over its documents, then the token-prefix of one more pass,
each pass in its own seeded order.

The prefix is found by counting tokens in equal ranges of the order first, so that only one small range of a leaf is
ever sorted, however large the leaf.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import Scratch

#: Rows of a range that is sorted, about; a leaf is cut into powers of 16 ranges to stay under it.
RANGE_ROWS = 500


def estimated_tokens(text_col: str = "text") -> Column:
    """A token for four UTF-8 bytes, rounded up; 0 for null or empty texts."""
    return F.floor((F.coalesce(F.octet_length(text_col), F.lit(0)) + 3) / 4).cast("long")


def weight_column(col: Column, weights: dict[str, float], default: float = 1.0) -> Column:
    """The weight of a name, 1 where none is given; negative weights are 0. Names that no row has are without effect."""
    out = F.lit(float(default))
    for k, v in weights.items():
        if not math.isfinite(v):
            raise ValueError(f"the weight of {k} is not finite")
        out = F.when(col == k, max(0.0, float(v))).otherwise(out)
    return out


def share(nodes: DataFrame, parent: list[str], name: str, budget: str, weight: str, limit: str, out: str) -> DataFrame:
    """Split ``budget`` (equal in a family) among children by ``weight`` under ``limit``, in whole tokens.

    With children by ascending limit per weight, the water level is the greatest of
    ``(budget - limits before) / (weights from here)``. Children without weight get nothing.
    """
    family = W.Window.partitionBy(*parent)
    ordered = family.orderBy("_ratio", F.col(name).asc_nulls_first())
    n = nodes.withColumn("_ratio", F.when(F.col(weight) > 0, F.col(limit) / F.col(weight)).otherwise(F.lit(float("inf"))))
    before = F.coalesce(F.sum(limit).over(ordered.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum(weight).over(ordered.rowsBetween(W.Window.currentRow, W.Window.unboundedFollowing))
    n = n.withColumn("_level", F.when(after > 0, (F.col(budget) - before).cast("double") / after).otherwise(F.lit(0.0)))
    n = n.withColumn("_top", F.max("_level").over(family))
    return n.withColumn(out, F.greatest(F.lit(0), F.least(F.col(limit), F.floor(F.col("_top") * F.col(weight)))).cast("long")).drop("_ratio", "_level", "_top")


def budgets(leaves: DataFrame, budget: Column, weights: dict[str, dict[str, float]], max_epochs: int) -> DataFrame:
    """Leaves (domain, lang, source, tokens, n) with ``budget`` tokens, whole passes ``full`` and the ``rest`` of one more."""
    # a child without weight can take nothing, so it adds nothing to what its ancestors can take
    weight = {level: weight_column(F.col(level), weights.get(level, {})) for level in ("domain", "lang", "source")}
    tree = leaves.withColumn("limit3", F.when(weight["source"] > 0, F.col("tokens") * max_epochs).otherwise(F.lit(0).cast("long")))
    tree = tree.withColumn("limit2", F.when(weight["lang"] > 0, F.sum("limit3").over(W.Window.partitionBy("domain", "lang"))).otherwise(F.lit(0).cast("long")))
    given = F.when(weight["lang"] > 0, F.col("limit3")).otherwise(F.lit(0).cast("long"))
    tree = tree.withColumn("limit1", F.when(weight["domain"] > 0, F.sum(given).over(W.Window.partitionBy("domain"))).otherwise(F.lit(0).cast("long")))
    domains = tree.select("domain", "limit1").distinct().withColumn("b0", budget).withColumn("w", weight["domain"])
    domains = share(domains.withColumn("root", F.lit(0)), ["root"], "domain", "b0", "w", "limit1", "b1").select(F.col("domain").alias("d"), "b1")
    langs = tree.select("domain", "lang", "limit2").distinct().join(domains, F.col("domain").eqNullSafe(F.col("d")))
    langs = share(langs.withColumn("w", weight["lang"]), ["domain"], "lang", "b1", "w", "limit2", "b2").select("domain", "lang", "b2")
    l2 = langs.select(F.col("domain").alias("d"), F.col("lang").alias("l"), "b2")
    out = tree.join(l2, F.col("domain").eqNullSafe(F.col("d")) & F.col("lang").eqNullSafe(F.col("l"))).withColumn("w", weight["source"])
    out = share(out, ["domain", "lang"], "source", "b2", "w", "limit3", "budget")
    full = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long")
    return out.select("domain", "lang", "source", "tokens", "n", "budget", full.alias("full"), (F.col("budget") - full * F.col("tokens")).alias("rest"))


def order_key(id_col: Column, epoch: Column, seed: int) -> Column:
    """The place of a document in a pass: 32 hex digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_col.cast("string"), F.lit(""))))


def mix(
    docs: DataFrame, domain: Column, weights: dict[str, dict[str, float]], fraction: float = 0.5, max_epochs: int = 2, seed: int = 17, tokens: Column | None = None,
    id_col: str = "doc_id", lang_col: str = "lang", source_col: str = "source", keep: DataFrame | bool = False,
) -> DataFrame:
    """The chosen documents, one row for each pass that takes them.

    The budget is ``fraction`` of all tokens; what children without weight (0 or less) hold can't be taken, so the result may
    fall short of it. ``tokens`` counts a row's tokens, four bytes each where it isn't given. Returns doc_id, domain, lang, source, tokens, epoch; with ``keep`` the
    columns of ``docs`` alone, whatever their names, or those of a table of the same rows that is read instead of it, for tokens that are dear to count. Null domains, languages, sources and ids are values like any other; rows of one id in a
    leaf stand at one place of the order and are taken or left together. Documents without tokens come with the passes
    and ranges around them. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    tokens = estimated_tokens() if tokens is None else tokens
    named = [domain.alias("_domain"), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"), tokens.alias("_tokens"), F.col(id_col).alias("_id")]
    slim = scratch.write(docs.select(*named))
    leaves = slim.groupBy(F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source")).agg(F.sum("_tokens").alias("tokens"), F.count("*").alias("n"))
    leaves = scratch.write(leaves)
    total = leaves.agg(F.sum("tokens").alias("t"), F.max("n").alias("n")).first()
    digits = 1
    while (total.n or 0) > RANGE_ROWS * 16**digits and digits < 12:
        digits += 1
    plan = scratch.write(budgets(leaves, F.lit(int((total.t or 0) * fraction)).cast("long"), weights, max_epochs))
    leaf = plan.select(*(F.col(c).alias(f"_l{c}") for c in ("domain", "lang", "source")), "full", "rest")
    in_leaf = F.col("_domain").eqNullSafe(F.col("_ldomain")) & F.col("_lang").eqNullSafe(F.col("_llang")) & F.col("_source").eqNullSafe(F.col("_lsource"))

    def placed(df: DataFrame) -> DataFrame:
        return df.join(leaf, in_leaf).withColumn("_key", order_key(F.col("_id"), F.col("full"), seed)).withColumn("_range", F.substring("_key", 1, digits))

    names = ["_ldomain", "_llang", "_lsource"]
    partial = placed(slim.where("_tokens > 0")).where("rest > 0")
    ranges = partial.groupBy(*names, "_range", "rest").agg(F.sum("_tokens").alias("t"))
    up_to = W.Window.partitionBy(*names).orderBy("_range").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    ranges = ranges.withColumn("cum", F.sum("t").over(up_to)).where("cum > rest")
    edge = scratch.write(ranges.groupBy(*names).agg(F.min_by(F.struct("_range", (F.col("rest") - F.col("cum") + F.col("t")).alias("room")), "_range").alias("e")).select(*(F.col(c).alias(f"e{c}") for c in names), F.col("e._range").alias("edge"), F.col("e.room").alias("room")))
    same = F.col("_ldomain").eqNullSafe(F.col("e_ldomain")) & F.col("_llang").eqNullSafe(F.col("e_llang")) & F.col("_lsource").eqNullSafe(F.col("e_lsource"))
    at_edge = partial.join(edge, same & (F.col("_range") == F.col("edge")))
    running = W.Window.partitionBy(*names).orderBy("_key").rangeBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    fits = at_edge.withColumn("cum", F.sum("_tokens").over(running)).where("cum <= room").groupBy(*names).agg(F.max("_key").alias("last"))
    cut = scratch.write(edge.join(fits, same, "left").select("e_ldomain", "e_llang", "e_lsource", "edge", "last"))
    whole = docs if isinstance(keep, bool) else keep
    chosen = placed(whole.select(F.struct(*whole.columns).alias("_row"), *named[:3], named[4]) if keep is not False else slim).join(cut, same, "left")
    in_prefix = F.when(F.col("rest") <= 0, False).when(F.col("edge").isNull(), True).when(F.col("_range") == F.col("edge"), F.coalesce(F.col("_key") <= F.col("last"), F.lit(False))).otherwise(F.col("_range") < F.col("edge"))
    copies = (F.col("full") + F.when(in_prefix, 1).otherwise(0)).cast("int")
    rows = chosen.withColumn("_copies", copies).where("_copies > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    if keep:
        return rows.select("_row.*")
    return rows.select(F.col("_id").alias("doc_id"), F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.col("_tokens").alias("tokens"), F.col("_epoch").alias("epoch"))


#: The weights of the registered query.
WEIGHTS = {"domain": {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0}, "lang": {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}}


def source_domain(source_col: str = "source") -> Column:
    """Sources by the number in their name, modulo 4; without one, ``d0``."""
    return F.concat(F.lit("d"), F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(source_col, r"(\d{1,9})$", 1), F.lit("")), F.lit("999999999")).cast("int") % 4, F.lit(0)))


def oracle(fraction: float = 0.5, max_epochs: int = 2, seed: int = 17) -> str:
    """The query in SQL, with the prefix by a plain running sum."""

    def weight(col: str, names: dict[str, float]) -> str:
        return f"CASE {' '.join(f"WHEN {col} = '{k}' THEN CAST({v} AS DOUBLE)" for k, v in names.items())} ELSE CAST(1 AS DOUBLE) END"

    def level(src: str, parent: str, name: str, b: str, limit: str, out: str) -> str:
        return f"""
            SELECT * EXCLUDE (ratio, lv, w), greatest(0, least({limit}, CAST(floor(max(lv) OVER (PARTITION BY {parent}) * w) AS BIGINT))) AS {out} FROM (
                SELECT *, CAST({b} - coalesce(sum({limit}) OVER (PARTITION BY {parent} ORDER BY ratio, {name} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
                    / sum(w) OVER (PARTITION BY {parent} ORDER BY ratio, {name} NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
                FROM (SELECT *, CAST({limit} AS DOUBLE) / w AS ratio FROM {src}))"""

    return f"""
        WITH d AS (
            SELECT doc_id, 'd' || coalesce(CAST(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS BIGINT) % 4, 0) AS domain, lang, source,
                CAST(floor((coalesce(strlen(text), 0) + 3) / 4) AS BIGINT) AS tokens FROM documents),
        leaf AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS t, CAST(sum(tokens) * {max_epochs} AS BIGINT) AS limit3 FROM d GROUP BY ALL),
        l1 AS (SELECT domain, CAST(sum(limit3) AS BIGINT) AS limit1, {weight("domain", WEIGHTS["domain"])} AS w, 0 AS root,
            (SELECT CAST(floor(sum(t) * {fraction}) AS BIGINT) FROM leaf) AS b0 FROM leaf GROUP BY domain),
        b1 AS ({level("l1", "root", "domain", "b0", "limit1", "b1")}),
        l2 AS (SELECT x.*, b1.b1 FROM (SELECT domain, lang, CAST(sum(limit3) AS BIGINT) AS limit2, {weight("lang", WEIGHTS["lang"])} AS w FROM leaf GROUP BY ALL) x JOIN b1 USING (domain)),
        b2 AS ({level("l2", "domain", "lang", "b1", "limit2", "b2")}),
        l3 AS (SELECT leaf.*, b2.b2, CAST(1 AS DOUBLE) AS w FROM leaf JOIN b2 ON leaf.domain = b2.domain AND leaf.lang IS NOT DISTINCT FROM b2.lang),
        b3 AS ({level("l3", "domain, lang", "source", "b2", "limit3", "b3")}),
        p AS (SELECT domain, lang, source, CASE WHEN t > 0 THEN b3 // t ELSE 0 END AS full_passes, CASE WHEN t > 0 THEN b3 % t ELSE 0 END AS rest FROM b3),
        k AS (SELECT d.*, full_passes, rest, md5('{seed}:' || full_passes || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
            FROM d JOIN p ON d.domain = p.domain AND d.lang IS NOT DISTINCT FROM p.lang AND d.source IS NOT DISTINCT FROM p.source),
        c AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM k)
        SELECT doc_id, domain, lang, source, tokens, CAST(unnest(range(full_passes + CASE WHEN rest > 0 AND cum <= rest THEN 1 ELSE 0 END)) AS INTEGER) AS epoch FROM c"""
