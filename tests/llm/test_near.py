"""Near duplicates by shingle sets against brute force over all pairs."""

import random
from itertools import combinations

import pytest

import corpus_pipeline
from twinlens.llm import near, simhash


def plain_set(text, n=5):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def plain_kept(rows, similarity=0.8):
    sets = {i: plain_set(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if len(x & y) >= similarity * len(x | y):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    return {i for i in up if root(i) == i}


def planted(seed=3):
    """Texts with copies that differ in 1 to 12 words of 200, a chain of changes, a shared line, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randint(0, 5000))
    texts = [None, "", " \n", "one", "One", "one two"]
    for _ in range(40):
        base = [word() for _ in range(200)]
        texts.append(" ".join(base))
        for changes in (1, 3, 5, 8, 12):
            copy = list(base)
            for at in rng.sample(range(200), changes):
                copy[at] = word()
            texts.append(" ".join(copy))
    chain = [word() for _ in range(120)]
    for _ in range(60):
        chain[rng.randrange(120)] = word()
        texts.append(" ".join(chain))
    texts += ["the same line stands in all of these texts " * 3 + " ".join(word() for _ in range(rng.randint(0, 8))) for _ in range(60)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("size", [near.HUB_ROWS, 3])
def test_near_stage_keeps_what_brute_force_keeps(spark, monkeypatch, size):
    monkeypatch.setattr(near, "HUB_ROWS", size)
    monkeypatch.setattr(near, "FEW", size * 100)
    monkeypatch.setattr(near, "BATCH_ROWS", size * 50)
    monkeypatch.setattr(near, "FEW_SKETCHES", size * 25)
    monkeypatch.setattr(near, "BRIEF", 64 if size > 3 else 2)
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect())
    assert got == sorted(plain_kept(rows)) and len(got) < len(rows) - 100


def test_near_duplicates_of_odd_rows(spark):
    text = "a b c d e f g h"
    docs = spark.createDataFrame([(5, text), (5, text), (None, text), (7, text + " i"), (None, "alone here"), (8, "other words of this one")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in simhash.deduplicate(docs, words=5, similarity=0.8).collect()) == [(0, "alone here"), (5, text), (8, "other words of this one")]
    assert simhash.deduplicate(docs.limit(0), words=5, similarity=0.8).count() == 0


def test_sketches_never_rule_out_similar_sets():
    import numpy as np

    rng = np.random.default_rng(6)
    ruled = 0
    for _ in range(400):
        n = int(rng.integers(1, 900))
        own = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        gone = int(rng.integers(0, n // 3 + 1))
        other = np.unique(np.concatenate([own[gone:], rng.integers(0, 2**63, int(rng.integers(0, n // 3 + 1))).astype(np.uint64)]))
        is_similar = near.similar(own.tobytes(), other.tobytes(), 0.8)
        both = len(set(own.tolist()) & set(other.tolist()))
        assert is_similar == (len(other) > 0 and both >= 0.8 * (len(own) + len(other) - both) - 1e-9)
        kept = near.may_be_similar(near.sketch(own), near.sketch(other), 0.8)
        assert kept or not is_similar
        ruled += not kept
    assert ruled > 100
