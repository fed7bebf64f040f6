"""Masking by places, blocks of any length, candidates against plain Python, and columns of any name in the mixture."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from twinlens.llm import mixing, secrets


def plain_parts(text):
    """(blocks, rest) by walking from BEGIN to END."""
    blocks, rest, at = [], "", 0
    text = text.replace("\0", secrets._NUL)
    while True:
        begin = re.compile(secrets.BEGIN).search(text, at)
        end = begin and re.compile(secrets.END).search(text, begin.end())
        if not end:
            return blocks, rest + text[at:]
        rest += text[at : begin.start()] + f"{secrets._PLACE}{len(blocks)}\0"
        blocks.append(text[begin.start() : end.end()])
        at = end.end()


def java_words(text):
    return re.split(r"[ \t\n\x0b\f\r]+", text)


def plain_candidates(text):
    """(value, before, after, word) of a text."""
    if text is None:
        return []
    blocks, rest = plain_parts(text)
    own = lambda v: v.replace(secrets._NUL, "\0")
    out, words = [], java_words(rest)
    pieces = re.split(secrets._PLACES, rest)
    for k, b in enumerate(blocks):
        out.append((own(b), "", "", len(java_words("x".join(pieces[: k + 1]))) - 1))
    keyed = re.search(secrets.ASSIGNS, text, re.A)
    at = lambda i: words[i] if 0 <= i < len(words) else ""
    for i, w in enumerate(words):
        given = re.search(secrets.ASSIGNED, " ".join([at(i - 2)[-40:], at(i - 1)[-40:], w]), re.A) if keyed else None
        given = given[1] if given and secrets._PLACE not in given[1] else ""
        for v in dict.fromkeys(x for x in [given, *re.findall(secrets.RUN, w)] if x):
            before = " ".join([at(i - 2)[-40:], at(i - 1)[-40:], w[: w.index(v)][-40:]])
            out.append((own(v), own(before), own(at(i + 1)[:40]), i))
    return out


def plain_masked(text, secret, mask):
    """The text with mask at the places of candidates of which ``secret`` is true, by offsets."""
    blocks, rest = plain_parts(text)
    found = plain_candidates(text)
    flags = [secret(v) for v, *_ in found]
    words, between = java_words(rest), re.findall(r"[ \t\n\x0b\f\r]+", rest) + [""]
    for i, w in enumerate(words):
        gone = bytearray(len(w))
        for (v, _, _, word), bad in list(zip(found, flags, strict=True))[len(blocks) :]:
            v = v.replace("\0", secrets._NUL)
            if bad and word == i:
                for m in re.finditer(secrets.RUN, w):
                    if m[0] == v:
                        gone[m.start() : m.end()] = b"\1" * len(v)
                tail = len(re.search(secrets.AFTER_VALUE, w)[0])
                t = next((t for t in range(tail, -1, -1) if w[: len(w) - t].endswith(v)), None)
                if t is not None:
                    gone[len(w) - t - len(v) : len(w) - t] = b"\1" * len(v)
        out, k = "", 0
        while k < len(w):
            if gone[k]:
                out += mask
                while k < len(w) and gone[k]:
                    k += 1
            else:
                out += w[k]
                k += 1
        words[i] = out
    done = "".join(a + b for a, b in zip(words, between, strict=True))
    for k, b in enumerate(blocks):
        done = done.replace(f"{secrets._PLACE}{k}\0", mask if flags[k] else b)
    return done.replace(secrets._NUL, "\0")


def odd_texts():
    rng = random.Random(2)
    key = lambda n: "".join(rng.choices("abcdefghijkLMNOPQ0123456789+/", k=n))
    block = lambda n, kind="RSA ": f"-----BEGIN {kind}PRIVATE KEY-----\n" + "\n".join(key(64) for _ in range(n)) + f"\n-----END {kind}PRIVATE KEY-----"
    words = ["password", "=", "token:", 'api_key="', '"', "the", "secret=", "summer99", "summer99days", key(20), key(40) + ",", "x" * 18, "pwd=" + key(30) + '").', "abcd))", "\0", "a\0b", "\n\n", "\t", "auth: 'ab1!'", "-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----", "é", "=====" * 5]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 25))) for _ in range(120)]
    texts += [block(3), "a " + block(500) + " b", block(1) + block(2, ""), "x" + block(1) + "y token=" + key(20), "-----BEGIN PRIVATE KEY----- " * 2000, block(1).replace("\n", " ") + " -----END PRIVATE KEY-----", "  lead " + block(2) + "\0 \0", None, "", " "]
    return texts


def test_candidates_by_plain_python(spark):
    texts = odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: [tuple(x) for x in r["c"]] if r["c"] is not None else [] for r in df.select("id", secrets.candidates(F.col("text")).alias("c")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_candidates(t), t


def test_masking_by_places(spark):
    """Every second candidate is taken for a secret, by its value; the rest of the text stays as it is."""
    texts = [t for t in odd_texts() if t]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    secret = lambda v: (len(v) + ord(v[-1])) % 2 == 0
    flag = lambda v: (F.length(v) + F.ascii(F.right(v, F.lit(1)))) % 2 == 0
    found = F.transform(secrets.candidates(F.col("text")), lambda c: F.struct(c.value.alias("value"), c.word.alias("word"), flag(c.value).alias("is_secret")))
    got = {r["id"]: r["m"] for r in df.withColumn("f", found).select("id", secrets.masked(F.col("text"), F.col("f"), "[SECRET]").alias("m")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_masked(t, secret, "[SECRET]"), t


class Everything(secrets.Forest):
    def score(self, f):
        return F.lit(1.0)


@pytest.mark.parametrize(("text", "want"), [
    ('password = "Xk9!vQ2z" and then api_key = "Xk9!vQ2zLm4pRt8sWy3d"', 'password = "[SECRET]" and then api_key = "[SECRET]"'),
    ("password: summer99 is weak, summer99days", "password: [SECRET] is weak, summer99days"),
    ("pwd=abcd then abcd and xabcdx", "pwd=[SECRET] then abcd and xabcdx"),
    ("token=0123456789abcdef0123456789abcdef!", "[SECRET]"),
])
def test_places_not_values(spark, text, want):
    forest = Everything(1, 1, [-1] * 4, [0.0] * 4, [0.0] * 4)
    assert secrets.redact(spark.createDataFrame([(text,)], "text string"), forest).first()["text"] == want


def test_a_block_of_a_megabyte(spark):
    body = "\n".join("QUJD" * 16 for _ in range(16_000))
    text = f"before\n-----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----\nafter"
    forest = Everything(1, 1, [-1] * 4, [0.0] * 4, [0.0] * 4)
    df = spark.createDataFrame([(text, "kept")], "text string, findings string")
    assert secrets.redact(df, forest).collect() == [("before\n[SECRET]\nafter", "kept")]
    assert secrets.findings(df.withColumn("doc_id", F.lit(1)), forest).count() == 1


def test_columns_of_any_name_in_the_mixture(spark):
    names = ["rest", "full", "edge", "last", "room", "t", "_tokens", "_key", "_range", "_copies", "_epoch", "_row", "_domain", "_ldomain", "e_ldomain", "cum", "tokens", "domain", "source_text"]
    rows = [(i, f"text number {i} " * 9, "en" if i % 3 else None, f"src{i % 4}", 5, *[f"{n}{i}" for n in names]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    got = corpus_pipeline.mixing_sources(spark, docs, "")
    assert got.columns == docs.columns
    want = {r[0]: r for r in rows}
    out = got.collect()
    assert out and all(tuple(r) == want[r["doc_id"]] for r in out)
    assert mixing.mix(docs, mixing.source_domain(), mixing.WEIGHTS, keep=True).columns == docs.columns
