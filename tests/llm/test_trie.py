"""The prefix trie against grouping every prefix, over odd tables and many runs."""

import hashlib
import random
import zlib

import pytest

from twinlens.llm import trie

TABLE = "conv_id long, turn long, role string, text string, depth long, key string, run int"


def plain_trie(rows, heads=6):
    """Nodes by brute force over (conv_id, turn, role, text)."""
    turns = {}
    for c, n, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256("\0".join([str(len(role)), role, text]).encode()).hexdigest()[:32]
            turns.setdefault(c, []).append((n is not None, n or 0, digest, (role, text)))
    turns = {c: [t[3] for t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % heads
        built[c] = tuple(turns.get(c - c % 100, [])[:h] + own[h:])
    nodes = {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    out = {}
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        childless = [q for q in below if not any(len(r) == len(q) + 1 and r[:-1] == q for r in nodes)]
        at_end = sorted(c for c in members if built[c] == p)
        out[min(members), len(p)] = (
            min(nodes[p[:-1]]) if p else None, len(members), sum(len(q) == len(p) + 1 for q in below), len(childless), sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q),
            hashlib.sha256(",".join(map(str, at_end)).encode()).hexdigest(),
        )
    return out


def odd_conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(30), *range(100, 140), 205, 207, 1_000_000_007]:
        start = ["hello", "", None, "näher 😀"][rng.randrange(4)]
        for n in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, n, rng.choice(["user", "assistant", None, ""]) if n > 1 else "user", start if n == 0 else rng.choice(["a", "b", "a\0b", None]), 7, "k", 1))
    rows += [(3, None, "system", "first", 1, None, None), (3, None, "system", "first", 1, None, None), (4, 1, "user", "tied", None, None, None), (4, 1, "user", "also tied", None, None, None)]
    rows += [(None, 0, "user", "no conversation", 0, "", 0), (11, 20, "user", "x" * 300_000, 0, "", 0)]
    rows += [(150 + i, n, "user", "the same", 0, "", 0) for i in range(40) for n in range(7)]
    rng.shuffle(rows)
    return rows


def nodes_of(df):
    rows = df.collect()
    out = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize(("seed", "runs"), [(1, 1), (2, 4), (3, 40)])
def test_trie_of_rebuilt_conversations(spark, seed, runs):
    rows = odd_conversations(seed)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", runs)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = nodes_of(trie.trie(trie.rebuilt(spark.createDataFrame(rows, TABLE).repartition(3))))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == plain_trie(rows)


def test_runs_of_every_cut():
    """Any cut of the sorted sequences into runs gives the same nodes."""
    rng = random.Random(8)
    seqs = sorted({bytes(b for t in (rng.choices("ab", k=rng.randint(0, 6))) for b in [ord(t)] * trie.WIDTH) for _ in range(30)})
    sizes = [trie.np.arange(3, 3 + len(s) // trie.WIDTH) for s in seqs]
    def walked(cuts):
        bounds, rows = [0, *cuts, len(seqs)], []
        for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            run = trie.Run(-1 if k == 0 else trie.common_turns(seqs[a - 1], seqs[a]), -1 if b == len(seqs) else trie.common_turns(seqs[b - 1], seqs[b]))
            for i in range(a, b):
                run.add(seqs[i], sizes[i], 1 + i % 3, i, str(i))
            run.finish()
            rows += run.rows
        whole, parts = [], {}
        for r in rows:
            if r[8] is None:
                whole.append(r)
            else:
                parts.setdefault(r[8], []).append(r)
        for key, rs in parts.items():
            total = lambda k: sum(r[k] for r in rs)  # noqa: B023, E731
            whole.append((min(r[0] for r in rs), rs[0][1], None, total(3), total(4), total(5), total(6) - total(10), next((r[7] for r in rs if r[7]), trie.NOTHING), None, rs[0][9], None))
        least = {key: min(r[0] for r in rs) for key, rs in parts.items()}
        return sorted((r[0], r[1], r[2] if r[2] is not None else least.get(r[9], -1), *r[3:8]) for r in whole)

    one = walked([])
    assert len(one) == len({s[: d * trie.WIDTH] for s in seqs for d in range(len(s) // trie.WIDTH + 1)})
    for _ in range(200):
        assert walked(sorted(rng.sample(range(1, len(seqs)), rng.randint(1, 8)))) == one


def test_no_conversations(spark):
    empty = spark.createDataFrame([], TABLE)
    assert trie.trie(trie.rebuilt(empty)).collect() == []
    assert trie.trie(trie.rebuilt(spark.createDataFrame([(None, 1, "user", "x", 1, "", 1)], TABLE))).collect() == []


def test_conversations_as_they_are(spark):
    rows = [(c, n, "user", t, 0, "", 0) for c, ts in ((7, "ab"), (5, "ab"), (9, "a"), (8, "acd")) for n, t in enumerate(ts)]
    got = nodes_of(trie.trie(trie.plain(spark.createDataFrame(rows, TABLE))))
    assert {k: v[:5] for k, v in got.items()} == {(5, 0): (None, 4, 1, 2, 4), (5, 1): (5, 4, 2, 2, 4), (5, 2): (5, 2, 0, 1, 1), (8, 2): (5, 1, 1, 1, 0), (8, 3): (8, 1, 0, 1, 0)}
    assert got[5, 2][5] == hashlib.sha256(b"5,7").hexdigest()
