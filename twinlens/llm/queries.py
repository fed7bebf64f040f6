"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import mixing, repeats, toolcalls, trie
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toolcalls import SCHEMAS, calls_of_conversations, link

    return link(*calls_of_conversations(table(spark, sf_dir, "conversations")), SCHEMAS)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import findings, labelled_findings, train

    return findings(table(spark, sf_dir, "documents"), train(labelled_findings(spark)), path_col="source")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .quality import held_out, score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    scored = score(docs, machine)
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .search import exact_top_products

    return exact_top_products(table(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import WEIGHTS, mix, source_domain

    return mix(table(spark, sf_dir, "documents"), source_domain(), WEIGHTS)


def op7_projected_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .search import nearest_by_projection

    return nearest_by_projection(table(spark, sf_dir, "embeddings"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan, train

    return scan(table(spark, sf_dir, "documents"), train())


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=4, max_bits=4)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(trie.rebuilt(table(spark, sf_dir, "conversations")))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_tool_calls": op2_tool_calls,
    "op3_secret_scan": op3_secret_scan,
    "op4_quality": op4_quality,
    "op5_exact_topk": op5_exact_topk,
    "op6_mixing": op6_mixing,
    "op7_projected_ann": op7_projected_ann,
    "op8_license_scan": op8_license_scan,
    "op9_simhash": op9_simhash,
    "op10_packing": op10_packing,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_whitening": op13_whitening,
}
ORACLE: dict[str, str] = {
    "op2_tool_calls": toolcalls.ORACLE,
    "op6_mixing": mixing.oracle(),
    "op11_conversation_trie": trie.ORACLE,
    "op12_suffix_dedup": repeats.ORACLE,
    "op5_exact_topk": """
        WITH v AS (
            SELECT vec_id, min(list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE))) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            GROUP BY vec_id),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
}
