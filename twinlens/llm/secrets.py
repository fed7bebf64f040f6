"""Secret scan with a random forest that removes false positives. DataFrame operations only.

Candidates are blocks of private keys, runs of 16 or more key characters, keys of a known prefix, and values of 4 or more
characters of any kind assigned to a key word. A forest trained from labelled findings scores each on length, character
transitions, dictionary coverage, the path and the neighbouring words. The scan is one projection: no shuffle, no Python.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: A run of key characters, bounded on both sides.
RUN = r"(?<![A-Za-z0-9_+/=\-])[A-Za-z0-9_+/=\-]{16,}"
#: Where the private key blocks of a text begin and end; what is inside one, of whatever length, is no candidate of its own.
BEGIN = r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
END = r"-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
#: What stands for a block while words are looked at, by its number; U+0000 of the text itself is written ``_NUL`` meanwhile.
_PLACE, _PLACES, _NUL = "\u0000B", "\u0000B[0-9]+\u0000", "\u0000Z\u0000"
KEY_WORDS = r"(?:token|secret|passw(?:or)?d|passphrase|api[_-]?key|access[_-]?key|auth|bearer|credentials?|private[_-]?key|pwd)"
#: A key word and its sign of assignment; with a value of any characters, the last in its text.
ASSIGNS = r"(?i)" + KEY_WORDS + r"[\"']?\s*[=:]"
AFTER_VALUE = r"[.,;:)\]}>\"']*$"
ASSIGNED = r"(?i)" + KEY_WORDS + r"[\"']?\s?[=:]{1,2}\s?[\"']?([^\s\"'=:][^\s\"']{3,}?)" + AFTER_VALUE
HASH_WORDS = r"(?:commit|sha-?\d*|md5|checksum|digest|etag|uuid|guid|revision|hash|blob|tree|isbn|doi|card|phone|tel|fax|order|invoice|account)"
PATH_WORDS = r"(?i)test|example|sample|fixture|mock|demo|docs?/"
#: Words whose presence inside a candidate speaks for a name rather than a random key.
DICTIONARY = (
    "access account action address admin after agent and app array asset back base before block board body book box branch browser build button cache call card change channel "
    "char check child class client clock close cloud code color column commit config connect content control count create data date debug default delete device domain down edit email "
    "empty end engine entry error event example export field file filter final find first folder form format frame from function global graph group handle hash head help home host "
    "html http image import index info init input item java join json key label layer left level library license line link list load local lock log loop main map master match media member "
    "memory message method mode model module name network next node note number object offset open option order page parent part path plan point port print process project "
    "public query queue read record request response result return right root route row rule schema scope score script search select sequence server service session size source start "
    "state status string style system table target task test text time title type update upload user value version view void when window word write zone"
).split()
#: What stands after a key word and is no secret.
PLAIN = "required string optional undefined <password> ${PASSWORD} {{token}} process.env.TOKEN getpass() ******** changeme self.token config[key] Optional[str] hidden missing expired invalid authentication".split()
TREES = 15
DEPTH = 4
SECRET_FROM = 0.5
FEATURES = ("length", "transitions", "digits", "upper", "vowel_pairs", "distinct", "dictionary", "known_prefix", "key_word", "hash_word", "assigned", "test_path", "only_digits", "longest_run", "symbols", "password_word")
_SHARES = [0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.7, 0.8, 0.9, 0.97]
EDGES: dict[str, list[float]] = {n: _SHARES for n in FEATURES} | {
    "length": [12, 17, 19, 21, 25, 31, 33, 37, 39, 41, 45, 63, 65, 100],
    "longest_run": [2, 3, 4, 5, 6, 8, 10, 14, 18, 26],
} | {n: [0.5] for n in ("known_prefix", "key_word", "hash_word", "assigned", "test_path", "only_digits", "password_word")}


def features(value: Column, before: Column, after: Column, path: Column) -> Column:
    """The features of one candidate as an array of doubles, in the order of FEATURES."""
    low, size = F.lower(value), F.length(value)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    share = lambda c: c.cast("double") / size
    kept = lambda pattern: F.length(F.regexp_replace(value, pattern, ""))
    borders = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
    words = "|".join(w for w in sorted(DICTIONARY, key=lambda w: (-len(w), w)) if len(w) > 3)
    runs = F.split(F.regexp_replace(value, borders, " "), " ")
    named = {
        "length": size.cast("double"),
        "transitions": share(F.size(F.regexp_extract_all(value, F.lit(borders), F.lit(0)))),
        "digits": share(kept("[^0-9]")),
        "upper": share(kept("[^A-Z]")),
        "vowel_pairs": share(F.size(F.regexp_extract_all(low, F.lit("[aeiou][b-df-hj-np-tv-z]"), F.lit(0)))),
        "distinct": share(F.size(F.array_distinct(F.split(value, "")))),
        "dictionary": 1.0 - share(F.length(F.regexp_replace(low, words, ""))),
        "known_prefix": flag(value.rlike(r"^(?:AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{20,}$|^xox[abps]-|^[sr]k_live_|^AIza|^glpat-|^-----BEGIN ")),
        "key_word": flag(F.lower(before).rlike(KEY_WORDS)),
        "hash_word": flag(F.lower(F.concat_ws(" ", before, after)).rlike(r"(?<![a-z])" + HASH_WORDS + r"(?![a-z])")),
        "assigned": flag(before.rlike(r"[=:]\s*[\"']?$")),
        "test_path": flag(F.coalesce(path, F.lit("")).rlike(PATH_WORDS)),
        "only_digits": flag(value.rlike(r"^[0-9+/_=\-]+$")),
        "symbols": share(kept(r"[A-Za-z0-9_+/=\-]")),
        "password_word": flag(F.lower(before).rlike(r"(?:passw(?:or)?d|passphrase|pwd)[\"']?\s*[=:]\s*[\"']?$")),
        "longest_run": F.array_max(F.transform(runs, lambda x: F.length(x))).cast("double"),
    }
    return F.array(*(named[n] for n in FEATURES))


def labelled_findings(spark: SparkSession, n: int = 4000) -> DataFrame:
    """(id, value, before, after, path, label): generated findings, a third of them secrets, from hashed row numbers.

    Stands in where no reviewed findings are at hand. Secrets are random hex, base62 and prefixed keys, mostly assigned to
    key words, blocks of private keys, and passwords assigned to key words; the rest are plain words assigned to key words, checksums, uuids, card and
    phone numbers, placeholders, identifiers, joined and long words of the dictionary and of none, paths and ruled lines.
    """
    r = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m)).cast("int")
    # a list is one literal in the plan, whatever its length
    pick = lambda salt, items: F.element_at(F.split(F.lit("\x01".join(map(str, items))), "\x01"), r(salt, len(items)) + 1)
    text = lambda salt: F.sha2(F.concat_ws(":", F.lit(salt), F.col("id")), 256)
    base62 = F.regexp_replace(F.base64(F.unhex(F.concat(text("a"), text("b")))), "[^A-Za-z0-9]", "")
    word = F.concat(*(pick(f"w{k}", DICTIONARY) for k in range(3)))
    # words of no dictionary: consonants and vowels by turns
    syllables = [c + v for c in "bcdfghklmnprstvwz" for v in "aeiou"]
    odd = F.concat(*(pick(f"o{k}", syllables) for k in range(4)))
    more = F.concat(odd, *(pick(f"o{k}", syllables) for k in range(4, 9)))
    either = lambda salt, own: F.when(r(salt, 2) == 0, odd).otherwise(pick(own, DICTIONARY))
    unlettered = F.substring(F.regexp_replace(base62, "[0-9]", ""), 1, 20 + r("n", 25))
    block = F.concat(F.lit("-----BEGIN "), pick("bk", ["RSA ", "EC ", "", "OPENSSH "]), F.lit("PRIVATE KEY----- "), F.substring(F.base64(F.unhex(F.concat(text("a"), text("b"), text("s"), text("p")))), 1, 64 + r("n", 90)), F.lit(" -----END PRIVATE KEY-----"))
    upper = F.regexp_replace(F.upper(base62), "[^A-Z0-9]", "")
    secret = (
        F.when(r("kind", 10) < 5, F.substring(text("s"), 1, pick("len", [32, 40, 40, 40, 64]).cast("int")))
        .when((r("kind", 10) < 6) & (r("half", 3) == 0), unlettered)
        .when((r("kind", 10) < 6) & (r("half", 3) == 1), block)
        .when(r("kind", 10) < 7, F.substring(base62, 1, 20 + r("n", 25)))
        .when(r("kind", 10) < 8, F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)))
        .when(r("kind", 10) < 9, F.concat(F.lit("ghp_"), F.substring(base62, 1, 36)))
        .otherwise(F.concat(F.lit("sk_live_"), F.substring(base62, 1, 24)))
    )
    digits = F.regexp_replace(F.concat(text("d"), text("e")), "[^0-9]", "")
    other = (
        F.when(r("kind", 10) < 2, F.substring(text("h"), 1, pick("len", [32, 40, 40, 64]).cast("int")))
        .when(r("kind", 10) < 3, F.regexp_replace(F.substring(text("u"), 1, 32), "^(.{8})(.{4})(.{4})(.{4})", r"$1-$2-$3-$4-"))
        .when(r("kind", 10) < 5, F.substring(digits, 1, 16))
        .when(r("kind", 10) < 6, F.concat(pick("ph", ["your_token_here_", "xxxxxxxxxxxxxxxx", "EXAMPLEEXAMPLEKEY", "0123456789abcdef", "changeme_changeme_"]), r("x", 10)))
        .when((r("kind", 10) < 8) & (r("half", 3) == 0), F.concat_ws("_", odd, either("e1", "w9"), r("x", 1000)))
        .when((r("kind", 10) < 8) & (r("half", 3) == 1), F.when(r("x", 3) == 0, more).when(r("x", 3) == 1, F.initcap(more)).otherwise(F.concat_ws("-", odd, either("e1", "w9"), either("e2", "w8"))))
        .when(r("kind", 10) < 8, F.concat_ws("_", word, pick("w9", DICTIONARY), r("x", 1000)))
        .when((r("kind", 10) < 9) & (r("half", 3) == 0), F.concat(F.initcap(odd), F.initcap(either("e1", "w9")), F.initcap(either("e2", "w8")), pick("tail", ["", "Factory", "Exception", "2"])))
        .when((r("kind", 10) < 9) & (r("half", 3) == 1), F.repeat(pick("rule", ["=", "-", "_", "=-", "+-"]), 16 + r("x", 60)))
        .when(r("kind", 10) < 9, F.concat(F.initcap(word), F.initcap(pick("w8", DICTIONARY)), r("x", 100)))
        .otherwise(F.concat_ws("/", either("e1", "p1"), pick("p2", DICTIONARY), either("e2", "p3"), F.when(r("half", 2) == 0, F.concat(F.lit("v"), r("x", 90))).otherwise(odd)))
    )
    key = pick("key", ["token", "secret", "password", "api_key", "auth", "access_key", "credential", "private_key"])
    near_secret = F.when(r("near", 20) < 17, F.concat(key, pick("eq", [' = "', "=", ": ", ':"', " = '", " "]))).otherwise(F.concat_ws(" ", pick("n1", DICTIONARY), pick("n2", DICTIONARY)))
    hash_key = pick("hk", ["commit", "sha256", "md5", "checksum", "digest", "etag", "uuid", "revision", "hash"])
    near_other = (
        F.when(r("kind", 10) < 3, F.concat(hash_key, pick("eq", [" ", ": ", "=", ' = "', " "])))
        .when((r("kind", 10) == 5) & (r("near", 2) == 0), F.concat(key, F.lit(' = "')))
        .otherwise(F.concat_ws(" ", pick("n1", DICTIONARY), pick("n2", DICTIONARY)))
    )
    mark = pick("sym", ["!", "#", "$", "@", "%", "?", "*", "", "", ""])
    letters = lambda salt: F.substring(F.translate(text(salt), "0123456789", "uoiaehrnst"), 1, 4 + r("n", 4))
    password = (
        F.when(r("pk", 3) == 0, F.concat(F.substring(base62, 1, 4 + r("n", 6)), mark, r("x", 100), F.substring(text("p"), 1, 2)))
        .when(r("pk", 3) == 1, F.concat(pick("w1", DICTIONARY), r("x", 1000), mark, pick("w2", DICTIONARY), r("y", 10)))
        .when(r("pq", 2) == 0, F.concat(letters("q1"), r("x", 100), mark, F.when(r("half", 2) == 0, letters("q2")).otherwise(letters("q1")), r("x", 100)))
        .otherwise(F.concat(F.initcap(F.translate(pick("w1", DICTIONARY), "eao", "340")), mark, F.initcap(F.translate(pick("w2", DICTIONARY), "eaio", "34!0")), r("x", 100)))
    )
    plain = F.when(r("pk", 3) == 0, pick("pl", PLAIN)).when(r("pk", 3) == 1, F.concat(pick("w1", DICTIONARY), pick("w2", DICTIONARY))).otherwise(F.concat(pick("w1", DICTIONARY), pick("j", [".", "_", "-"]), pick("w2", DICTIONARY)))
    given = F.concat(pick("gk", ["password", "passwd", "pwd", "passphrase", "password", "secret"]), pick("eq", [' = "', "=", ": ", ':"', " = '"]))
    other, near_other = F.when(r("pw", 6) == 0, plain).otherwise(other), F.when(r("pw", 6) == 0, given).otherwise(near_other)
    secret, near_secret = F.when(r("pw", 5) == 0, password).otherwise(secret), F.when(r("pw", 5) == 0, given).otherwise(near_secret)
    label = F.when(r("label", 3) == 0, 1).otherwise(0)
    return spark.range(n).select(
        "id", F.when(label == 1, secret).otherwise(other).alias("value"), F.when(label == 1, near_secret).otherwise(near_other).alias("before"),
        pick("after", DICTIONARY).alias("after"), F.when(r("path", 10) == 0, F.lit("tests/fixtures/keys")).otherwise(F.lit("src")).alias("path"), label.alias("label"),
    )


def constants(values: list, kind: str) -> Column:
    """A short expression for a long constant array, which the optimiser folds."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


@dataclass
class Forest:
    """Binary trees in flat arrays: node n of tree t is at ``t * 2**(depth + 1) + n``, its children are 2n and 2n + 1.

    ``feature`` is -1 at leaves; ``share`` is the share of secrets at a node.
    """

    trees: int
    depth: int
    feature: list[int]
    edge: list[float]
    share: list[float]

    @classmethod
    def bare(cls, trees: int, depth: int) -> Forest:
        size = trees << (depth + 1)
        return cls(trees, depth, [-1] * size, [0.0] * size, [0.0] * size)

    def at(self, t: int, n: int) -> int:
        return (t << (self.depth + 1)) + n

    def node(self, f: Column, t: Column, steps: int) -> Column:
        """The node of tree ``t`` that an array of features reaches in ``steps`` steps, or the leaf where it rests before."""
        if not steps:
            return F.lit(1)
        feature, edge = constants(self.feature, "int"), constants(self.edge, "double")

        def down(n: Column, _: Column) -> Column:
            k = t * F.lit(2 << self.depth) + n
            return F.when(feature[k] < 0, n).otherwise(n * 2 + F.when(f[feature[k]] < edge[k], 0).otherwise(1))

        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(1), down)

    def score(self, f: Column) -> Column:
        """The mean of the trees' leaves for an array of features."""
        share = constants(self.share, "double")
        leaf = lambda t: share[t * F.lit(2 << self.depth) + self.node(f, t, self.depth)]
        return F.aggregate(F.sequence(F.lit(0), F.lit(self.trees - 1)), F.lit(0.0), lambda acc, t: acc + leaf(t)) / self.trees


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 5, max_rows: int = 100_000) -> Forest:
    """A forest grown level by level from (id, value, before, after, path, label); one aggregation a level.

    Each tree weighs rows by a hashed bootstrap and each node tries a seeded third of the features at fixed edges. What
    comes to the driver is a count per tree, node, feature and bin, whatever the number of rows. ``max_rows`` bounds the
    findings used, taken by hashed id; null labels and values are not used.
    """
    used = findings.where("label IS NOT NULL AND value IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(max_rows)
    scratch = Scratch(findings.sparkSession)
    described = used.select("id", F.col("label").cast("int").alias("label"), features(F.col("value"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")), F.col("path")).alias("f"))
    f = scratch.write(described.coalesce(4))
    bins = F.transform(F.sequence(F.lit(0), F.lit(len(FEATURES) - 1)), lambda j: F.struct(j.alias("j"), F.size(F.filter(_edges()[j], lambda e: e <= F.col("f")[j])).alias("bin")))
    f = scratch.write(f.select("id", "label", "f", bins.alias("bins")).coalesce(4))
    draw = F.pmod(F.xxhash64("id", F.col("t")), F.lit(1000))
    weight = F.when(draw < 368, 0).when(draw < 736, 1).when(draw < 920, 2).otherwise(3)
    rng = random.Random(seed)
    out = Forest.bare(trees, depth)
    for level in range(depth + 1):
        placed = f.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
        placed = placed.select("label", "t", "bins", out.node(F.col("f"), F.col("t"), level).alias("n"), weight.alias("w")).where(f"w > 0 AND n >= {1 << level}")
        sums = placed.select("label", "t", "n", "w", F.explode("bins").alias("b")).groupBy("t", "n", "b.j", "b.bin").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("label")).alias("pos"))
        tally: dict = {}
        for x in sums.collect():
            tally.setdefault((x.t, x.n), {}).setdefault(x.j, {})[x.bin] = (x.w, x.pos)
        for (t, n), by in sorted(tally.items()):
            total = tuple(map(sum, zip(*by[0].values(), strict=True)))
            above = out.share[out.at(t, n // 2)] if n > 1 else 0.3
            out.share[out.at(t, n)] = round((total[1] + above) / (total[0] + 1), 6)
            tried = rng.sample(range(len(FEATURES)), 5)
            if level == depth or total[0] < 8 or not 0 < total[1] < total[0]:
                continue
            gini = lambda w, p: 2 * p * (w - p) / w if w else 0.0
            best = gini(*total) - 1e-9
            for j in tried:
                w = p = 0
                for k, edge in enumerate(EDGES[FEATURES[j]]):
                    dw, dp = by[j].get(k, (0, 0))
                    w, p = w + dw, p + dp
                    cost = gini(w, p) + gini(total[0] - w, total[1] - p)
                    if 0 < w < total[0] and cost < best:
                        best, out.feature[out.at(t, n)], out.edge[out.at(t, n)] = cost, j, float(edge)
    scratch.drop(f)
    return out


def _edges() -> Column:
    """The edges of all features, by position."""
    rows = ";".join(",".join(map(repr, EDGES[n])) for n in FEATURES)
    return F.transform(F.split(F.lit(rows), ";"), lambda x: F.split(x, ",").cast("array<double>"))


def parted(text: Column) -> Column:
    """struct(blocks, rest): the private key blocks of a text, and the text with ``_PLACE`` and a number in place of each.

    A block goes from the first BEGIN after the block before it to the next END. The text is cut at its ENDs, so time grows with its length.
    """
    plain = F.when(F.contains(text, F.lit("\u0000")), F.replace(text, F.lit("\u0000"), F.lit(_NUL))).otherwise(text)
    kind = "struct<blocks:array<string>,rest:string>"

    def cut(whole: Column) -> Column:
        pieces, ends = F.split(whole, END, -1), F.regexp_extract_all(whole, F.lit(END), F.lit(0))
        marked = F.zip_with(F.slice(pieces, F.lit(1), F.size(ends)), ends, lambda p, e: F.struct(p.alias("piece"), e.alias("end"), F.regexp_instr(p, F.lit(BEGIN)).alias("at")))
        none = F.struct(F.array().cast("array<string>").alias("blocks"), F.lit("").alias("rest"))

        def add(done: Column, m: Column) -> Column:
            place = F.concat(F.lit(_PLACE), F.size(done.blocks).cast("string"), F.lit("\u0000"))
            block = F.concat(F.substring(m.piece, m["at"], F.length(m.piece)), m.end)
            with_block = F.struct(F.array_append(done.blocks, block).alias("blocks"), F.concat(done.rest, F.substring(m.piece, F.lit(1), m["at"] - 1), place).alias("rest"))
            return F.when(m["at"] > 0, with_block).otherwise(F.struct(done.blocks.alias("blocks"), F.concat(done.rest, m.piece, m.end).alias("rest")))

        return F.aggregate(marked, none, add, lambda done: F.struct(done.blocks.alias("blocks"), F.concat(done.rest, F.element_at(pieces, -1)).alias("rest")))

    whole = F.struct(F.array().cast("array<string>").alias("blocks"), plain.alias("rest"))
    return F.when(F.contains(text, F.lit("PRIVATE KEY")) & text.rlike(BEGIN), F.transform(F.array(plain), cut)[0]).otherwise(whole).cast(kind)


def candidates(text: Column) -> Column:
    """array<struct<value, before, after, word>>: the candidates of a text in order, with the words around them.

    Blocks of private keys come first, then runs and assigned values by the word that holds them; a value that stands in a word
    more than once is one candidate. ``word`` counts the words before it, a block being one word. ``before`` and ``after`` are
    up to 40 characters of each of the two words before and of the word after.
    """
    return F.transform(F.array(parted(text)), lambda p: _candidates(text, p))[0]


def _candidates(text: Column, parts: Column) -> Column:
    word = lambda words, i: F.coalesce(F.get(words, i), F.lit(""))
    shown = lambda words, i: F.right(word(words, i), F.lit(40))
    none = F.array().cast("array<struct<value:string,before:string,after:string,word:int>>")
    has = lambda pattern: F.coalesce(text.rlike(pattern), F.lit(False))

    def assigned(words: Column, keyed: Column, i: Column) -> Column:
        """The value that ends a word and is assigned to a key word in it or in the two before, where the text has any; else empty."""
        found = F.regexp_extract(F.concat_ws(" ", shown(words, i - 2), shown(words, i - 1), words[i]), ASSIGNED, 1)
        return F.when(keyed, F.when(F.contains(words[i], F.lit(_PLACE)) & F.contains(found, F.lit(_PLACE)), "").otherwise(found)).otherwise("")

    def of(part: Column) -> Column:
        words, keyed = part.words, part.keyed
        at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: words[i].rlike(RUN) | (assigned(words, keyed, i) != ""))
        values = lambda i: F.array_distinct(F.filter(F.concat(F.array(assigned(words, keyed, i)), F.regexp_extract_all(words[i], F.lit(RUN), F.lit(0))), lambda v: v != ""))
        found = F.transform(at, lambda i: F.struct(i.alias("i"), values(i).alias("vs")))
        around = lambda x, v: F.struct(
            v.alias("value"), F.concat_ws(" ", shown(words, x.i - 2), shown(words, x.i - 1), _before(words[x.i], v)).alias("before"), F.left(word(words, x.i + 1), F.lit(40)).alias("after"), x.i.alias("word")
        )
        return F.flatten(F.transform(found, lambda x: F.transform(x.vs, lambda v: around(x, v))))

    def blocks() -> Column:
        pieces = F.split(parts.rest, _PLACES, -1)
        before = lambda k: F.size(F.split(F.array_join(F.slice(pieces, F.lit(1), k + 1), "x"), r"\s+")) - 1
        return F.transform(parts.blocks, lambda v, k: F.struct(_restored(v).alias("value"), F.lit("").alias("before"), F.lit("").alias("after"), before(k).alias("word")))

    # the words and whether any value is assigned are made once and bound, so that the walk stands in the plan once
    part = F.struct(F.split(parts.rest, r"\s+").alias("words"), has(ASSIGNS).alias("keyed"))
    walked = F.when(has(ASSIGNS) | has(RUN), F.transform(F.array(part), of)[0]).otherwise(none)
    walked = F.when(F.contains(text, F.lit("\u0000")), F.transform(walked, lambda x: F.struct(_restored(x.value).alias("value"), _restored(x.before).alias("before"), _restored(x["after"]).alias("after"), x.word.alias("word")))).otherwise(walked)
    return F.concat(F.when(F.size(parts.blocks) > 0, blocks()).otherwise(none), walked)


def _restored(text: Column) -> Column:
    return F.replace(text, F.lit(_NUL), F.lit("\u0000"))


def _before(word: Column, value: Column) -> Column:
    """Up to 40 characters of a word that stand before a value in it."""
    return F.right(F.substring(word, F.lit(1), F.instr(word, value) - 1), F.lit(40))


def masked_word(word: Column, values: Column, mask: str) -> Column:
    """A word with ``mask`` at the places of values: runs that are one, and the assigned value at its end. Overlapping places are one."""
    pieces, runs = F.split(word, RUN, -1), F.regexp_extract_all(word, F.lit(RUN), F.lit(0))
    # where each run begins: after the pieces and runs before it
    before = lambda k: F.length(F.array_join(F.slice(pieces, F.lit(1), k + 1), "")) + F.length(F.array_join(F.slice(runs, F.lit(1), k), ""))
    span = lambda start, size: F.struct(start.cast("int").alias("a"), (start + size).cast("int").alias("z"))
    own_runs = F.filter(F.transform(runs, lambda r, k: F.struct(r.alias("r"), before(k).alias("at"))), lambda x: F.array_contains(values, x.r))
    tail, size = F.length(F.regexp_extract(word, AFTER_VALUE, 0)), F.length(word)
    # an assigned value ends the word but for punctuation, of which as much as can be is no part of it
    ends = lambda v: F.filter(F.sequence(tail, F.lit(0)), lambda t: F.substring(word, size - t - F.length(v) + 1, F.length(v)) == v)
    at_end = F.filter(F.transform(values, lambda v: F.struct(v.alias("v"), F.get(ends(v), F.lit(0)).alias("t"))), lambda x: x.t.isNotNull())
    spans = F.array_sort(F.concat(F.transform(own_runs, lambda x: span(x["at"], F.length(x.r))), F.transform(at_end, lambda x: span(size - x.t - F.length(x.v), F.length(x.v)))))

    def cut(done: Column, s: Column) -> Column:
        fresh = F.concat(done.out, F.substring(word, done.pos + 1, s.a - done.pos), F.lit(mask))
        return F.struct(F.when(s.a >= done.pos, fresh).otherwise(done.out).alias("out"), F.greatest(done.pos, s.z).alias("pos"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("pos"))
    return F.aggregate(spans, start, cut, lambda done: F.concat(done.out, F.substring(word, done.pos + 1, size)))


def scan(docs: DataFrame, forest: Forest, text_col: str = "text", path_col: str | None = None, out_col: str = "findings", threshold: float = SECRET_FROM) -> DataFrame:
    """``docs`` with an array of findings: value, before, after, word (position), score, is_secret.

    A score that equals the threshold is a secret. Null and empty texts have no findings. Rows are kept as they are, repeated
    ones too; ``out_col`` must be free.
    """
    if out_col in docs.columns:
        raise ValueError(f"{out_col} is a column already")
    path = F.col(path_col) if path_col else F.lit("")
    described = F.transform(candidates(F.col(text_col)), lambda c: F.struct(c.alias("c"), features(c.value, c.before, c.after, path).alias("f")))
    scored = F.transform(described, lambda x: F.struct(x.c.alias("c"), F.round(forest.score(x.f), 6).alias("score")))
    flat = lambda x: F.struct(x.c.value.alias("value"), x.c.before.alias("before"), x.c.after.alias("after"), x.c.word.alias("word"), x.score.alias("score"), (x.score >= threshold).alias("is_secret"))
    return docs.withColumn(out_col, F.transform(scored, flat))


def findings(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, threshold: float = SECRET_FROM) -> DataFrame:
    """One row per candidate: id, ordinal, word, value, score, is_secret."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (F.col(path_col) if path_col else F.lit("")).alias("path"))
    found = scan(slim, forest, "text", "path", "findings", threshold)
    return found.select("doc_id", F.posexplode("findings").alias("ordinal", "x")).select("doc_id", "ordinal", "x.word", "x.value", "x.score", "x.is_secret")


def masked(text: Column, found: Column, mask: str) -> Column:
    """A text with ``mask`` at the places of the confirmed ones among its findings: whole blocks, and values in the words that hold them."""
    escaped = lambda v: F.replace(v, F.lit("\u0000"), F.lit(_NUL))

    def of(p: Column) -> Column:
        n = F.size(p.blocks)
        own = F.transform(F.filter(F.slice(found, n + 1, F.greatest(F.size(found) - n, F.lit(0))), lambda x: x.is_secret), lambda x: F.struct(x.word.alias("word"), escaped(x.value).alias("value")))
        # what every word is held against is made once and bound
        part = F.struct(own.alias("own"), F.array_distinct(F.transform(own, lambda x: x.word)).alias("hit"), F.split(p.rest, r"\s+", -1).alias("words"), F.regexp_extract_all(p.rest, F.lit(r"\s+"), F.lit(0)).alias("between"))
        place = lambda k: F.concat(F.lit(_PLACE), k.cast("string"), F.lit("\u0000"))
        kept = F.transform(p.blocks, lambda b, k: F.struct(place(k).alias("place"), F.when(found[k].is_secret, F.lit(mask)).otherwise(b).alias("b")))
        return _restored(F.aggregate(kept, F.transform(F.array(part), words_of)[0], lambda acc, x: F.replace(acc, x.place, x.b)))

    def words_of(q: Column) -> Column:
        values = lambda i: F.transform(F.filter(q.own, lambda x: x.word == i), lambda x: x.value)
        done = F.transform(q.words, lambda w, i: F.when(F.array_contains(q.hit, i), masked_word(w, values(i), mask)).otherwise(w))
        # each word and what stands after it; the last has nothing after it
        return F.array_join(F.zip_with(done, q["between"], lambda w, b: F.concat(w, F.coalesce(b, F.lit("")))), "")

    return F.transform(F.array(parted(text)), of)[0]


def redact(docs: DataFrame, forest: Forest, text_col: str = "text", path_col: str | None = None, threshold: float = SECRET_FROM, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with each confirmed secret replaced by ``mask`` where it stands; the columns stay as they were.

    Places, not values, are masked: a word that happens to hold a short password elsewhere stays, and of overlapping
    findings all is masked once. Null and empty texts and texts without secrets are left as they are.
    """
    hold = "findings"
    while hold in docs.columns:
        hold += "_"
    found = scan(docs, forest, text_col, path_col, hold, threshold)
    out = F.when(F.exists(hold, lambda x: x.is_secret), masked(F.col(text_col), F.col(hold), mask)).otherwise(F.col(text_col))
    return found.withColumn(text_col, out).select(*docs.columns)
