"""A training corpus out of ``documents``: quality, near duplicates, secrets, mixture, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), works on all that the stage before it kept
and returns a DataFrame. All but the last return the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.llm import mixing, packing, quality, secrets, simhash
from twinlens.llm.common import Scratch, table

#: A document stays when the probability of good quality is at least this.
KEEP_FROM = 0.7
#: Tokens that the mixture hands out, as a share of those that reach it: as many as there are, so light branches of the weights
#: lose documents and heavy ones repeat theirs.
MIX_FRACTION = 1.0


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores after it until it is no column of ``docs``."""
    while name in docs.columns:
        name += "_"
    return name


def encoder() -> tuple[str, str, str]:
    """The vocabulary that packing uses, its rank file and pattern."""
    import public_tokenizers as tokenizers

    return tokenizers.path("byte_bpe_50k.json"), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, fitted on the labelled ones, doesn't reject.

    Null and empty texts are scored by their statistics; repeated rows and null ids are scored each for itself, null ids and
    null labels never train. Without labels of both classes the score is a constant. An empty table stays empty.
    """
    machine = quality.train(docs, table(spark, sf_dir, "labels"))
    hold = free_name(docs, "score")
    return quality.score(docs, machine, out_col=hold).where(F.col(hold) >= KEEP_FROM).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group linked by a five-word Jaccard similarity of at least 0.8.

    Repeated rows and equal texts are one group, texts without words (null ones too) another; null ids are the last choice. An
    empty table stays empty.
    """
    return simhash.deduplicate(docs, words=5, similarity=0.8)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with confirmed secrets masked in their texts and ``n_chars`` to match.

    Null and empty texts and texts without secrets are left as they are, row by row; an empty table stays empty.
    """
    forest = secrets.train(secrets.labelled_findings(spark))
    Scratch(spark).tidy()
    path = "source" if "source" in docs.columns else None
    old = free_name(docs, "text_before")
    out = secrets.redact(docs.withColumn(old, F.col("text")), forest, path_col=path)
    if "n_chars" in docs.columns:
        size = F.when(F.col("text").eqNullSafe(F.col(old)), F.col("n_chars")).otherwise(F.char_length("text"))
        out = out.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents to the target weights of domains and languages; one is repeated for each pass that takes it.

    The budget is ``MIX_FRACTION`` of the tokens that packing makes of them. Null languages and sources are names like any
    other; rows of one id in a leaf are taken or left together. An empty table stays empty.
    """
    count = free_name(docs, "tokens")
    counted = packing.with_token_counts(docs, count, *encoder())
    return mixing.mix(counted, mixing.source_domain(), mixing.WEIGHTS, fraction=MIX_FRACTION, tokens=F.col(count), keep=docs)


def packing_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens.

    Null and empty texts are the closing token alone; repeated rows and null ids are packed each for itself. An empty table
    gives no pieces.
    """
    return packing.pack(docs, *encoder())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scans", secret_scans),
    ("mixing_sources", mixing_sources),
    ("packing", packing_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.write(docs)
    return docs


#: No SQL expresses the trained stages; tests/llm holds them against brute force.
ORACLE_SQL = None
