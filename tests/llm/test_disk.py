"""What the pipeline's stages deal and what they leave in the shared folder."""

import os
import random

import pytest

import corpus_pipeline
from twinlens.llm import near
from twinlens.llm.common import Scratch, shared_dir


def in_shared(spark):
    top = shared_dir(spark).removeprefix("file:")
    return sum(os.path.getsize(f"{d}/{x}") for d, _, names in os.walk(top) for x in names if x.endswith(".parquet"))


def texts(n=400, words=400, seed=4):
    rng = random.Random(seed)
    out = [" ".join("w" + str(rng.randint(0, 9**6)) for _ in range(words)) for _ in range(n)]
    return [(k, t, "en", f"s{k % 7}", len(t)) for k, t in enumerate(out + out[:20])]


@pytest.mark.parametrize("stage", [corpus_pipeline.simhash_near_dedup, corpus_pipeline.mixing_sources])
def test_stages_leave_no_copy_of_the_texts(spark, tmp_path, stage):
    rows = texts()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/in")
    docs = spark.read.parquet(f"{tmp_path}/in")
    before = in_shared(spark)
    stage(spark, docs, "").write.parquet(f"{tmp_path}/out")
    whole = sum(os.path.getsize(f"{tmp_path}/in/{x}") for x in os.listdir(f"{tmp_path}/in") if x.endswith(".parquet"))
    assert in_shared(spark) - before < 0.25 * whole


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti"])
def test_join_with_many_keys_is_a_plain_join(spark, monkeypatch, how):
    from pyspark.sql import functions as F

    monkeypatch.setattr(near, "FEW", 10)
    rows = spark.range(20_000).select(F.xxhash64("id").alias("key"), F.col("id").alias("May"), F.lit("x").alias("may_bits"))
    keys = Scratch(spark).write(spark.range(19_000, 21_000).select(F.xxhash64("id").alias("key"), F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).where("k = 1 OR key % 2 = 0"))
    own = keys if how == "inner" else keys.select("key")
    got, want = near.joined(rows, own, "key", how), rows.join(own, "key", how)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    held = near.may_be_key(rows, keys, "key", 2000, "maybe")
    assert sorted(held.where("NOT maybe").drop("maybe").join(keys, "key", "left_semi").collect()) == []
    assert 1000 <= held.where("maybe").count() < 4000


def test_a_passage_is_one_posting(spark):
    import numpy as np

    rows = np.array([(s, k, 50, s) for s in (7, 8, 9) for k in (1, 2, 3)] + [(11, 1, 50, 4), (11, 2, 50, 4), (12, 5, 9, 0)], dtype=near.ENTRY)
    parts = [(0, rows[rows["shingle"] < 9].tobytes()), (1, rows[rows["shingle"] >= 9].tobytes())]
    met = near.shared(spark.createDataFrame(parts, "bucket long, entries binary").repartition(2, "bucket"))
    got = sorted((r.shingle, r.key, r.n, r.pos) for r in near.different(met).collect())
    assert got == [(7, 1, 50, 7), (7, 2, 50, 7), (7, 3, 50, 7), (11, 1, 50, 4), (11, 2, 50, 4)]
