"""Whole operators and the whole pipeline against plain versions."""

import random
import re
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from .test_llm import model_mix, plain_fingerprint
from .test_near import plain_kept
from twinlens.llm import mixing, packing, quality, secrets, simhash, tokens


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))


def near_texts(seed=11):
    """Texts with copies of a few changed words; short ones, where a word turns few bits, and long ones."""
    rng = random.Random(seed)
    texts = [None, "", " ", "same", "Same", "same"]
    for size in (4, 6, 30, 400, 3000):
        for _ in range(6):
            base = words(rng, size).split(" ")
            texts.append(" ".join(base))
            for changes in (1, 2, 5):
                copy = list(base)
                for at in rng.sample(range(size), min(changes, size)):
                    copy[at] = "x" + copy[at]
                texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("hot", [simhash.HOT, 2])
def test_simhash_from_texts(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    texts = near_texts()
    rows = [(i + 100 if i % 9 else None, t) for i, t in enumerate(texts)]
    fps = [plain_fingerprint(t) for t in texts]
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 4:
            a, b = sorted((root(i), root(j)))
            up[b] = a
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    key = lambda r: tuple((x is not None, x) for x in r)
    want = sorted(((doc, f"{fps[i]:016x}", least.get(root(i))) for i, (doc, _) in enumerate(rows)), key=key)
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), posting_rows=100).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=key) == want
    assert len({root(i) for i in range(len(fps))}) < len(fps) - 20


def test_the_tally_leaves_few_pairs_and_loses_none():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 2**63, 400).astype(np.uint64)
    for i in range(200):
        for b in rng.integers(0, 64, int(rng.integers(0, 6))):
            fps[200 + i] = fps[i] if not b else (fps[200 + i] if (fps[200 + i] ^ fps[i]) < 2**20 else fps[i]) ^ np.uint64(1 << int(b))
    for i in range(0, 400, 37):
        near = np.bitwise_count(fps ^ fps[i]) <= 4
        assert (simhash.differing(fps[i : i + 1], fps, 4) == near).all()


def test_token_counts_of_texts_without_white_space(spark):
    from tokenizers import Tokenizer

    whole, rng = Tokenizer.from_file(P.path("word_bpe_49k.json")), random.Random(3)
    parts = ["a", "B", "z", "0", "1", "9", " ", "é", "ß", "<|startoftext|>", "'s", "'ll", "日本", ".", "!!", "_", "-", "½", "🙂"]
    texts = ["".join(rng.choices(parts, k=rng.randint(5, 90))) for _ in range(300)] + ["a1" * 40_000, "x" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(df, P.path("word_bpe_49k.json"), segment_chars=7).collect()}
    assert got == {i: len(whole.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


@pytest.mark.parametrize(("weights", "fraction"), [({"domain": {"web": 1.0, "book": 5.0}, "lang": {"en": 0.0}}, 0.6), ({"lang": {"en": -2.0, "xx": 9.0}, "source": {"a": 0.0}}, 1.0), ({"domain": {"web": 0.0, "book": 0.0}}, 0.5), ({}, 3.0)])
def test_mixing_with_weights_of_zero(spark, weights, fraction):
    rng = random.Random(5)
    rows = [(i, rng.choice(["web", "book"]), rng.choice(["en", "de", None]), rng.choice("ab"), rng.randint(1, 60)) for i in range(300)] + [(i, "web", "en", "a", 10) for i in range(300, 500)]
    df = spark.createDataFrame(rows, "doc_id long, kind string, lang string, source string, t long")
    named = [dict(zip(("id", "domain", "lang", "source", "tokens"), r, strict=True)) for r in rows]
    usable = [r for r in named if all(weights.get(k, {}).get(r[k], 1.0) > 0 for k in ("domain", "lang", "source"))]
    got = mixing.mix(df, F.col("kind"), weights, fraction=fraction, tokens=F.col("t")).collect()
    taken = {(r.doc_id, r.tokens, r.epoch) for r in got}
    if usable:
        total = int(sum(r["tokens"] for r in named) * fraction)
        want = model_mix(usable, weights, total / sum(r["tokens"] for r in usable) * (1 + 1e-12), 2, 17)
        assert taken == want and len(got) == len(want)
    else:
        assert not got
    # what the usable leaves can give is given, but for less than a document for each
    spent, most = sum(x[1] for x in taken), min(int(sum(r["tokens"] for r in named) * fraction), 2 * sum(r["tokens"] for r in usable))
    assert most - 61 * 12 <= spent <= most


def test_weights_must_be_numbers():
    with pytest.raises(ValueError):
        mixing.weight_column(F.lit("a"), {"a": float("nan")})


def test_encoders_agree_on_documents_and_random_texts(spark):
    fast, plain = packing.ByteBpe(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN), packing.ByteBpe(P.path("byte_bpe_50k.json"))
    docs = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    rng = random.Random(9)
    parts = [" ", "  ", "\n", "\t", "a", "B", "don't", "'LL", "12", "é", "日", "🙂", "<|endoftext|>", "...", "_", "\u00a0", "\u200b", "\ufeff", "ﬁ", "\x00", "\x85", "\u2028", "İ"]
    texts = docs + ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(3000)]
    assert all(fast.encode(t) == plain.encode(t) for t in texts)


def test_packing_of_null_ids_and_repeated_rows(spark):
    args = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rows = [(None, "a b c"), (None, "a b c"), (1, "same text"), (1, "same text"), (2, None), (2, ""), (3, "w " * 3000)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), *args).collect()
    enc = packing.encoder(*args)
    want = {}
    for doc, t in rows:
        want[doc] = want.get(doc, 0) + len(enc.encode(t or "")) // 4 + 1
    got = {}
    for p in pieces:
        got[p.doc_id] = got.get(p.doc_id, 0) + p.length
    assert got == want and sum(p.doc_id == 1 and p.start == 0 for p in pieces) == 2


def test_quality_takes_a_definite_text_of_an_id(spark):
    rows = [(i, f"plain words of page {i}", 1) for i in range(30)] + [(100 + i, f"AA!! B## {i}", 0) for i in range(30)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(i, "another text of this id") for i in range(10)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    a, b = quality.train(df, labels), quality.train(df.repartition(7).orderBy(F.rand(3)), labels)
    assert a.bias == b.bias and (a.linear == b.linear).all() and (a.factors == b.factors).all()


def test_pipeline_against_a_plain_one(spark, tmp_path):
    """Every stage over planted documents: junk, copies, near copies, secrets, a mixture, pieces."""
    rng = random.Random(21)
    docs, good, doc_id = [], [], 0
    secret = lambda k: f'api_key = "{random.Random(k).getrandbits(160):040x}"'

    def add(text, label):
        nonlocal doc_id
        docs.append((doc_id, text, rng.choice(["en", "de"]), rng.choice(["src0", "src1", "src2"]), len(text)))
        good.append((doc_id, label))
        doc_id += 1

    for k in range(60):
        base = words(rng, 150).split(" ")
        if k % 5 == 0:
            base[70:70] = secret(k).split(" ")
        add(" ".join(base), 1)
        if k % 4 == 0:
            copy = list(base)
            copy[3] = "changed"
            add(" ".join(copy), 1)
        if k % 7 == 0:
            add(" ".join(base), 1)
        add("!!! $$$ " + " ".join(rng.choices(["BUY", "WIN", "$$$", "###", "|||"], k=40)), 0)
    sf = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(good, "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    # quality: the same machine, scored text by text
    table = spark.read.parquet(f"{sf}/documents.parquet")
    machine = quality.train(table, spark.read.parquet(f"{sf}/labels.parquet"))

    def score(text):
        s, v = quality.vector(text)
        vx = machine.factors[s] * v[:, None]
        z = machine.bias + machine.linear[s] @ v + ((vx.sum(axis=0) ** 2).sum() - (vx**2).sum()) / 2
        return 1 / (1 + np.exp(-z))

    left = [d for d in docs if score(d[1]) >= corpus_pipeline.KEEP_FROM]
    assert {d[0] for d in left} >= {i for i, q in good if q} and len(left) < len(docs) - 40
    kept = plain_kept([(d[0], d[1]) for d in left])
    assert 60 <= len(kept) < 75
    # secrets: the planted ones are the only ones
    clean = [(d[0], re.sub(r"[0-9a-f]{40}", "[SECRET]", d[1]), *d[2:4]) for d in left if d[0] in kept]
    assert sum("[SECRET]" in d[1] for d in clean) == 12
    enc = packing.encoder(*corpus_pipeline.encoder())
    ids = {d[0]: enc.encode(d[1]) + bytes(4) for d in clean}
    domain = lambda source: f"d{int(source[3:]) % 4}"
    rows = [{"id": d[0], "domain": domain(d[3]), "lang": d[2], "source": d[3], "tokens": len(ids[d[0]]) // 4} for d in clean]
    mixed = model_mix(rows, mixing.WEIGHTS, corpus_pipeline.MIX_FRACTION, 2, 17)
    copies = {}
    for i, _, _ in mixed:
        copies[i] = copies.get(i, 0) + 1
    out = corpus_pipeline.run(spark, sf).collect()
    assert {p.doc_id for p in out} == set(copies)
    covered, places = {}, {}
    for p in out:
        assert p.doc_tokens == len(ids[p.doc_id]) // 4 and p.ids_crc32 == zlib.crc32(ids[p.doc_id][4 * p.start : 4 * (p.start + p.length)])
        for k in range(p.start, p.start + p.length):
            covered[p.doc_id, k] = covered.get((p.doc_id, k), 0) + 1
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert covered == {(i, k): n for i, n in copies.items() for k in range(len(ids[i]) // 4)}
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_redacted_text_is_what_the_stage_gives(spark):
    forest = secrets.train(secrets.labelled_findings(spark))
    df = spark.createDataFrame([(1, 'token = "3f9a02c47be815d6607f4ac29d13be58f0a7c6e1" x', "en", "s0", 99), (2, None, None, None, None), (3, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.secret_scans(spark, df, "").collect()}
    assert got == {1: ('token = "[SECRET]" x', 20), 2: (None, None), 3: ("", 0)} and forest.trees == secrets.TREES
