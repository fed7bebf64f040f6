"""Each operator against brute force, and over odd tables: nulls, empty and long texts, repeated rows, no rows, clashing columns."""

import random
import re
import textwrap
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from twinlens.llm import licenses, mixing, packing, quality, search, secrets, simhash, tokens, toolcalls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, text_hash long, findings string, epoch int"


def odd_docs(spark, n=40):
    rng = random.Random(4)
    words = "alpha beta gamma délta the of and to in is was for token key value x1 y2".split()
    base = [" ".join(rng.choices(words, k=rng.randint(5, 80))) for _ in range(n)]
    texts = [None, "", " \n\t ", "one", "x" * 70_000, " ".join(rng.choices(words, k=30_000)), 'token = "0123456789abcdef0123456789abcdef01234567" end', *base, *base[:5]]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src1", "web", None]), None if t is None else len(t), 0.5, 1, 2, "f", 3) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, "no id", "en", "src1", 5, None, None, None, None, None), (9, "other text of the same id", "en", "src0", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return odd_docs(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


# 1 token counts


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    want = sorted((r.doc_id, len((r.text or "").encode()), len(whole.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.where("doc_id IS NOT NULL").collect())
    for kw in ({}, {"segment_chars": 50, "batch_bytes": 300}):
        got = tokens.token_counts(docs, path, **kw)
        assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got.where("doc_id IS NOT NULL").collect()) == want
        assert got.where("over_limit <> (n_tokens > 2048)").count() == 0 and got.count() == docs.count()
    assert tokens.token_counts(empty, path).count() == 0


def test_other_tokenizers(docs):
    import sentencepiece

    model = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(docs.where("doc_id < 20 AND doc_id <> 9"), model, boundary=None).collect()}
    assert got == {r.doc_id: len(sp.encode(r.text or "")) for r in docs.where("doc_id < 20 AND doc_id <> 9").collect()}


# 2 tool calls


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [
            (1, "a", 0, "f", '{ "b":1.0, "a" : [2, "x"]}'), (1, "b", 2, "f", '{"a": [], "after": ["c"]}'), (1, "c", 4, "f", '{"a": 5}'), (1, "d", 6, "f", '{"a": [], "after": ["b", "gone"]}'),
            (2, "a", 0, "f", '{"a":[],"after":["b"]}'), (2, "b", 1, "f", '{"a":[],"after":["a"]}'), (2, "c", 2, "f", '{"a":[],"after":["b"]}'),
            (3, "z", 0, "g", "not json"), (3, "n", 1, None, None), (None, "a", 0, "f", "{}"), (3, None, 0, "f", "{}"), (3, "z", 5, "f", "{}"),
        ],
        "conv_id long, call_id string, turn long, name string, arguments string",
    ).withColumn("level", F.lit("clash"))
    results = spark.createDataFrame([(1, "a", 1, 'r"1\n'), (1, "a", 3, "r2"), (9, "a", 0, "lost"), (None, "a", 0, "null"), (3, "z", 1, None)], "conv_id long, call_id string, turn long, content string")
    schemas = {"f": {"required": ["a"], "properties": {"a": {"type": "array"}}}}
    got = {(r.conv_id, r.call_id): r for r in toolcalls.link(calls, results, schemas).where("status <> 'orphan_result'").collect()}
    assert got[1, "a"].json == '{"arguments":{"a":[2,"x"],"b":1},"id":"a","name":"f","result":"r\\"1\\n"}'
    assert [got[1, x].position for x in "acbd"] == [0, 1, 2, 3] and [got[2, x].position for x in "abc"] == [None] * 3 and got[3, "z"].position is not None and got[3, None].position is None
    assert (got[1, "a"].valid, got[1, "c"].valid, got[3, "z"].valid) == (True, False, False)
    assert [got[1, x].level for x in "abcd"] == [0, 1, 0, 1] and [got[2, x].cyclic for x in "abc"] == [True] * 3
    assert (got[1, "a"].n_results, got[1, "b"].status, got[3, "z"].status, got[3, "z"].turn) == (2, "unanswered", "linked", 0)
    assert sorted(r.json for r in toolcalls.link(calls, results, schemas).where("status = 'orphan_result'").collect()) == ['{"id":"a","result":"lost"}', '{"id":"a","result":"null"}']
    assert toolcalls.link(calls.limit(0), results.limit(0), schemas).count() == 0


# 3 secrets


@pytest.fixture(scope="module")
def forest(spark):
    return secrets.train(secrets.labelled_findings(spark, 1500))


def test_secret_accuracy_on_other_findings(spark, forest):
    other = secrets.labelled_findings(spark, 4000).where("id >= 1500")
    scored = other.select("label", forest.score(secrets.features(F.col("value"), F.col("before"), F.col("after"), F.col("path"))).alias("s"))
    assert scored.agg(F.avg(((F.col("s") >= 0.5) == (F.col("label") == 1)).cast("int")).alias("a")).first().a > 0.95


def test_forest_score_by_hand(spark, forest):
    f = [random.Random(1).random() * 40 for _ in secrets.FEATURES]
    total = 0.0
    for t in range(forest.trees):
        n = 1
        while forest.feature[forest.at(t, n)] >= 0:
            k = forest.at(t, n)
            n = 2 * n + (f[forest.feature[k]] >= forest.edge[k])
        total += forest.share[forest.at(t, n)]
    got = spark.range(1).select(forest.score(F.array(*map(F.lit, f))).alias("s")).first().s
    assert got == pytest.approx(total / forest.trees)


def test_secret_scan(docs, empty, forest):
    found = [r for r in secrets.findings(docs, forest, path_col="source").collect() if r.is_secret]
    assert [(r.doc_id, r.value) for r in found] == [(6, "0123456789abcdef0123456789abcdef01234567")]
    clean = secrets.redact(docs, forest, path_col="source")
    assert clean.columns == docs.columns and clean.count() == docs.count() and clean.where("text LIKE '%0123456789abcdef%'").count() == 0
    assert clean.where("text = 'token = \"[SECRET]\" end'").count() == 1 and clean.where("doc_id <> 6").exceptAll(docs.where("doc_id <> 6")).count() == 0
    assert secrets.findings(empty, forest).count() == 0


def test_candidates_match_plain_regex(spark):
    texts = ["a b1234567890123456 c", "(k=A1b2C3d4E5f6G7h8) x y1y1y1y1y1y1y1y1y1,z9z9z9z9z9z9z9z9z9", "short1", "q" * 40, None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [[c.value for c in r.c] for r in df.select(secrets.candidates(F.col("text")).alias("c")).collect()]
    assert got == [re.findall(secrets.RUN, t or "") for t in texts]


# 4 quality


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, quality.RANK)))
    s, v = quality.vector("a b c a words")
    pairs = sum(m.factors[i] @ m.factors[j] * a * b for (i, a), (j, b) in combinations(zip(s, v, strict=True), 2))
    assert m.margins(np.array(s), v, np.array([0]))[0] == pytest.approx(0.3 + m.linear[s] @ v + pairs)


def test_quality(spark, docs, empty):
    good, bad = (spark.range(60).select((F.col("id") + k).alias("doc_id"), F.concat(F.lit(t), F.col("id").cast("string")).alias("text"), F.lit(q).alias("quality")) for k, t, q in ((1000, "the plain words of a page ", 1), (2000, "AB!! C### D%%% E!! ", 0)))
    train = good.union(bad)
    labels = train.select("doc_id", "quality").union(spark.createDataFrame([(1, None), (None, 1), (1000, 1)], "doc_id long, quality int"))
    m = quality.train(train.select("doc_id", "text"), labels)
    out = quality.score(train, m).withColumn("held", quality.held_out()).collect()
    assert all((r.score >= 0.7) == (r.quality == 1) for r in out) and any(r.held for r in out)
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    odd = quality.score(docs, m, out_col="new").collect()
    assert len(odd) == docs.count() and all(0 <= r.new <= 1 for r in odd)
    with pytest.raises(ValueError):
        quality.score(docs, m)
    assert quality.score(empty, quality.train(empty, labels.limit(0)), out_col="new").count() == 0


# 5 and 7 search


def vectors(spark, n=400, dims=6):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=dims).astype("float32")], 1) for i in range(n)]
    rows += [(n + i, rows[7][1], 1) for i in range(60)] + [(rows[50])]
    rows += [(None, rows[3][1], 1), (9000, None, 1), (9100, [float("nan")] * dims, 1), (9200, [None] * dims, 1), (9300, [float("inf")] * dims, 1), (9400, [0.0] * dims, 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int"), {i: np.array(v, dtype=np.float64) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()}


def brute(known, every, k, score, largest):
    out = set()
    for q in known:
        if q % every == 0:
            ranked = sorted(((-1 if largest else 1) * score(known[q], known[i]), i) for i in known if i != q)[:k]
            out |= {(q, r + 1, i) for r, (_, i) in enumerate(ranked)}
    return out


def test_exact_products(spark, monkeypatch):
    df, known = vectors(spark)
    ints = {i: np.floor(256 * v).astype(np.int64) for i, v in known.items()}
    want = brute(ints, 50, 5, lambda a, b: int(a @ b), True)
    assert {(r.query_id, r["rank"], r.vec_id) for r in search.exact_top_products(df).collect()} == want
    small = search.block_search(
        df.where("vec_id IS NOT NULL").where(search.finite(F.col("embedding"))).select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("vec")),
        50, 5, search.Products(), index_block=64, query_block=3)
    assert {(r.query_id, r["rank"], r.vec_id) for r in small.collect()} == want
    assert search.exact_top_products(df.limit(0)).count() == 0


def test_dual_tree_prunes_right():
    rng = np.random.default_rng(5)
    centers = rng.integers(-4000, 4000, (12, 4))
    rows = np.concatenate([c + rng.integers(-30, 30, (200, 4)) for c in centers])
    queries = rows[::37]
    made = []
    place, score = search.dual_tree_products(queries, rows, 6, tally=made)
    assert sum(made) < 0.5 * len(queries) * len(rows)
    for q, p, s in zip(queries, place, score, strict=True):
        products = rows @ q
        assert p.tolist() == np.lexsort((np.arange(len(rows)), -products))[:6].tolist() and s.tolist() == products[p].tolist()


def test_cover_tree_radii():
    points = np.random.default_rng(1).normal(size=(700, 3))
    root, order = search.cover_tree(points, leaf=10)
    todo, seen = [root], 0
    while todo:
        n = todo.pop()
        d = np.sqrt(((points[order[n.start : n.stop]] - n.center) ** 2).sum(axis=1))
        assert d.max() <= n.radius + 1e-12 and (not n.children or sum(c.stop - c.start for c in n.children) == n.stop - n.start)
        seen += not n.children
        todo += n.children
    assert sorted(order.tolist()) == list(range(700)) and seen > 10


def test_projection_search(spark):
    df, known = vectors(spark, dims=24)
    known = {i: v for i, v in known.items() if v.any()}
    got = search.nearest_by_projection(df).collect()
    want = brute(known, 100, 10, lambda a, b: float(np.sqrt(((a - b) ** 2).sum())), False)
    hit = {(q, i) for q, _, i in want} & {(r.query_id, r.vec_id) for r in got}
    assert len(hit) >= 0.9 * len(want) and len(got) == len(want)
    assert all(r.score == pytest.approx(np.sqrt(((known[r.query_id] - known[r.vec_id]) ** 2).sum()), rel=1e-12) for r in got)
    assert search.nearest_by_projection(df.limit(0)).count() == 0


def test_recall_on_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in df.collect()}
    want = {(q, i) for q, _, i in brute(rows, 100, 10, lambda a, b: float(((a - b) ** 2).sum()), False)}
    got = {(r.query_id, r.vec_id) for r in search.nearest_by_projection(df).collect()}
    assert len(want & got) >= 0.9 * len(want)


def test_chi_square():
    assert search.chi_square_cdf(15.507313055865453, 8) == pytest.approx(0.95) and search.chi_square_cdf(0.0, 6) == 0


# 6 mixing


def model_mix(rows, weights, fraction, epochs, seed):
    import hashlib

    leaves = {}
    for r in rows:
        leaves.setdefault((r["domain"], r["lang"], r["source"]), []).append(r)
    caps = {k: epochs * sum(r["tokens"] for r in v) for k, v in leaves.items()}

    def fill(budget, children):
        left, out = dict(children), {}
        while left:
            total = sum(w for w, _ in left.values())
            level = budget / total
            full = {k for k, (w, cap) in left.items() if cap <= level * w}
            if not full:
                return out | {k: int(level * w) for k, (w, _) in left.items()}
            for k in full:
                out[k] = left.pop(k)[1]
                budget -= out[k]
        return out

    w = lambda level, k: weights.get(level, {}).get(k, 1.0)
    sub = lambda *p: sum(c for k, c in caps.items() if k[: len(p)] == p)
    out = set()
    b1 = fill(int(sum(sum(r["tokens"] for r in v) for v in leaves.values()) * fraction), {d: (w("domain", d), sub(d)) for d in {k[0] for k in caps}})
    for d, b in b1.items():
        b2 = fill(b, {x: (w("lang", x), sub(d, x)) for x in {k[1] for k in caps if k[0] == d}})
        for x, b in b2.items():
            for s, b in fill(b, {k[2]: (1.0, caps[k]) for k in caps if k[:2] == (d, x)}).items():
                own = leaves[d, x, s]
                t = sum(r["tokens"] for r in own)
                full, rest = divmod(b, t) if t else (0, 0)
                key = lambda r, full=full: hashlib.md5(f"{seed}:{full}:{r['id'] if r['id'] is not None else ''}".encode()).hexdigest()
                for r in own:
                    cum = sum(o["tokens"] for o in own if key(o) <= key(r))
                    for e in range(full + (rest > 0 and cum <= rest)):
                        out.add((r["id"], r["tokens"], e))
    return out


def test_mixing(spark, docs, empty, monkeypatch):
    rng = random.Random(8)
    rows = [(i, rng.choice(["web", "book"]), rng.choice(["en", "de", None]), rng.choice("abc"), rng.randint(1, 60)) for i in range(900)] + [(i, "web", "en", "a", 10) for i in range(900, 1600)]
    df = spark.createDataFrame(rows, "doc_id long, kind string, lang string, source string, t long")
    weights = {"domain": {"web": 1.0, "book": 5.0}, "lang": {"en": 3.0}}
    want = model_mix([dict(zip(("id", "domain", "lang", "source", "tokens"), r, strict=True)) for r in rows], weights, 0.6, 2, 17)
    for size in (2000, 5):
        monkeypatch.setattr(mixing, "RANGE_ROWS", size)
        got = mixing.mix(df, F.col("kind"), weights, fraction=0.6, tokens=F.col("t")).collect()
        assert {(r.doc_id, r.tokens, r.epoch) for r in got} == want and len(got) == len(want)
    kept = mixing.mix(docs, mixing.source_domain(), mixing.WEIGHTS, keep=True)
    assert kept.columns == docs.columns and kept.count() > 0
    assert mixing.mix(empty, mixing.source_domain(), mixing.WEIGHTS).count() == 0


# 8 licences


def test_licenses(spark, docs, empty):
    m = licenses.train()
    texts, labels, families = licenses.variants(77, 6, held_out=True)
    found = [m.classify(" ".join(t)) for t in texts]
    right = [(f or (licenses.UNKNOWN,))[0] == families[x] for f, x in zip(found, labels, strict=True)]
    assert np.mean(right) > 0.93
    # texts without a known licence, among them notices of others that the fit has not seen
    assert np.mean([f is not None for f, x in zip(found, labels, strict=True) if not x]) < 0.03
    assert np.mean([f is not None and f[2] >= licenses.CONFIRM_FROM for f, x in zip(found, labels, strict=True) if not x]) < 0.01
    assert all(m.classify(s)[0] == f and m.classify(s)[2] == pytest.approx(1) for f, t in licenses.TEMPLATES.items() for s in t)
    assert not any(m.classify(s) for s in licenses.OTHERS) and m.classify("released under the Eclipse Public License 2.0") is None
    df = spark.createDataFrame([(1, "x\nReleased under the MIT License.\nThe end."), (2, None), (None, "Licensed under CC BY-NC 4.0."), (3, "")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.line, r.family, r.confirmed) for r in licenses.scan(df, m).collect()) == [(0, 0, "CC-BY-NC", True), (1, 1, "MIT", True)]
    assert licenses.scan(docs, m).count() == 0 and licenses.scan(empty, m).count() == 0


def test_wrapped_notices(spark):
    m = licenses.train()
    whole = {f: max(t, key=len) for f, t in licenses.TEMPLATES.items() if max(map(len, t)) > 150}
    for family, notice in whole.items():
        for mark, width in (("// ", 72), (" * ", 60), ("", 80)):
            rows = textwrap.wrap(notice, width)
            text = "\n".join(["the house by the river stood alone", "", *(mark + r for r in rows), "", "and nobody came"])
            found = [x for x in m.scan(text) if x[4] >= licenses.CONFIRM_FROM]
            assert found and all(x[2] == family and 2 <= x[0] < 2 + len(rows) for x in found), (family, mark, found)


def test_license_scan_against_a_plain_one(spark):
    """Lines and runs by a plain walk over each text, classified with dense vectors."""
    m = licenses.train()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, "Released under the\nGNU General Public\nLicense, version 3"), (-2, " ".join(["Licensed under the MIT license."] * 3000)), (-3, "\n".join(["software license"] * 200)), (-1, "Released under CC0 1.0 Universal.")], "doc_id long, text string")
    every = docs.union(odd)

    def plain(text):
        lines, out = (text or "").split("\n"), []

        def look(start, size):
            words = re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", " ".join(lines[start : start + size]).lower())
            x = np.zeros(len(m.vocabulary))
            kept = {g for g in licenses.grams(words) if g in m.vocabulary}
            x[[m.vocabulary[g] for g in kept]] = 1 / max(1, len(kept)) ** 0.5
            z = (x @ m.weights + m.bias) / m.temperature
            p = np.exp(z - z.max())
            p /= p.sum()
            best = int(p.argmax())
            telling = sum(w in m.telling for w in words)
            return (None if not telling or best == 0 or p[best] < m.believed_from else (m.families[best], m.similarity(m.families[best], words))), telling

        singles = [look(k, 1) for k in range(len(lines))]
        start = 0
        while start < len(lines):
            stop = start
            while stop < len(lines) and singles[stop][1] >= 2 and stop - start < licenses.RUN_LINES:
                stop += 1
            run = look(start, stop - start)[0] if stop - start > 1 else None
            if run and run[1] >= 0.5 and not any(s[0] and s[0][1] >= 0.5 for s in singles[start:stop]):
                out.append((start, stop - start, *run))
            else:
                out += [(k, 1, *singles[k][0]) for k in range(start, max(stop, start + 1)) if singles[k][0]]
            start = max(stop, start + 1)
        return out

    want = sorted((r.doc_id, *x[:3], round(x[3], 6)) for r in every.collect() for x in plain(r.text))
    got = sorted((r.doc_id, r.line, r.lines, r.family, r.similarity) for r in licenses.scan(every, m).collect())
    assert got == want and len(got) > 10


# 9 simhash


def plain_fingerprint(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    s = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_triples():
    t = simhash.triples()
    assert len(t) == 20 and all(any(set(x) <= set(f) for x in t) for f in combinations(range(8), 4))


def test_simhash(spark, docs, empty):
    rows = docs.collect()
    got = sorted((r.doc_id or -1, r.fingerprint) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted((r.doc_id or -1, f"{plain_fingerprint(r.text):016x}") for r in rows)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicate(empty).count() == 0


@pytest.mark.parametrize("chain", [False, True])
def test_components(spark, monkeypatch, chain):
    rng = random.Random(1)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(450):
        x = fps[-1] if chain else rng.choice(fps)
        for b in rng.sample(range(64), rng.randint(0, 6)):
            x ^= 1 << b
        fps.append(x)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(i, str(f)) for i, f in enumerate(signed)], "doc_id long, text string")
    marked = df.select("doc_id", F.col("text").cast("long").alias("fp"), F.lit(0).cast("long").alias("text_hash"))
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: marked)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df, posting_rows=1000).collect()}
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= 4:
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    assert got == {i: root(i) for i in range(len(fps))}


def test_deduplicate(docs):
    one = docs.where("text IS NULL OR text <> 'other text of the same id'")
    out = simhash.deduplicate(one)
    want = {r.component_id for r in simhash.near_duplicates(one).collect()}
    assert out.columns == docs.columns and out.count() == len(want) and {r.doc_id for r in out.collect()} == want
    assert simhash.deduplicate(docs).count() == len(want) + 1  # two texts of one id are two documents


# 10 packing


@pytest.mark.parametrize("pool", [4096, 7])
def test_packing(docs, empty, pool):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    args = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    one = docs.where("doc_id <> 9")
    pieces = packing.pack(one, *args, pool=pool).collect()
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    for r in one.collect():
        ids = [*exact.encode(r.text or "", add_special_tokens=False).ids, 0]
        at = 0
        for p in sorted(by_doc[r.doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and zlib.crc32(np.array(ids[at : at + p.length], dtype="<u4").tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids)
    for s in by_seq.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024 and at & (at - 1) == 0
    assert packing.pack(docs, *args).select("doc_id", "start").count() >= docs.count() and packing.pack(empty, *args).count() == 0


def test_encoders_agree():
    fast = packing.ByteBpe(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    plain = packing.ByteBpe(P.path("byte_bpe_50k.json"))
    texts = ["", "a<|endoftext|>b", "x  y\n\n z\t", "Ünï 12345 it's we'LL", "日本語 テキスト", "🙂🙂 ok", " " * 700 + "a", "a" * 5000, "’s €5", "naïvé ﻿x", "###$$$%%% w***"]
    assert all(fast.encode(t) == plain.encode(t) for t in texts)


def test_rooms():
    for total in (0, 1, 1023, 1024, 5000):
        rooms = packing.rooms_for(total, 1024)
        assert rooms.sum() == total and all(r & (r - 1) == 0 for r in rooms.tolist())


def test_costs_are_balanced():
    lengths = np.array([700, 650, 600, 300, 300, 300, 200, 22])
    pieces = packing.assign(lengths, 1024)
    loads = {}
    for _, _, n, s, _ in pieces:
        loads[s] = loads.get(s, 0) + n
    assert sum(loads.values()) == lengths.sum() and max(loads.values()) <= 1024


# the pipeline


def test_stages_on_odd_tables(spark, docs, tmp_path):
    spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, str(tmp_path))
            assert name == "packing" or (out.columns == given.columns and [t for _, t in out.dtypes] == [t for _, t in given.dtypes])
            out.count()


def test_pipeline(spark):
    d = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, d).collect()
    first = corpus_pipeline.quality_classifier(spark, spark.read.parquet(f"{d}/documents.parquet"), d)
    good = spark.read.parquet(f"{d}/labels.parquet").where("quality = 1").select("doc_id")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert first.join(good, "doc_id").count() >= 0.97 * docs.join(good, "doc_id").count()
    assert out and {r.doc_id for r in out} <= {r.doc_id for r in first.collect()}
