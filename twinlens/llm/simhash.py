"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint of 64 bits is 8 positional bytes. Two fingerprints that differ in at most ``max_bits`` (4) bits share at
least 8 - 4 = 4 positional bytes, the guaranteed minimum of the count filter. An index on single bytes would have
postings that grow with the corpus, so postings are keyed by three positional bytes together: the 20 position triples
below meet every set of four positions, hence every pair that passes the count filter meets in a posting. In a posting,
the shared positional bytes of each pair are tallied, pairs under the minimum are dropped and the others are verified.

Equal fingerprints are one entry of the index, so copies never form pairs. Each task links the entries of its postings
and emits a spanning forest (at most one link per entry), never all pairs. Components come from alternating star
contractions over those links, written to the shared folder between rounds; nothing is collected.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, limit_arrow_batches, spread_join

BYTES = 8
#: Entries of a posting beyond which it is dealt once more by a fourth byte.
HOT = 20_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def triples() -> list[tuple[int, int, int]]:
    """20 triples of the 8 positions such that any four positions contain one.

    Positions fall in three parts; taken are the triples inside a part and those with two in a part and one in the next.
    """
    part = [p * 3 // BYTES for p in range(BYTES)]
    out = []
    for t in combinations(range(BYTES), 3):
        seen = sorted(part[p] for p in t)
        if seen[0] == seen[2] or any(seen.count(a) == 2 and seen.count((a + 1) % 3) == 1 for a in range(3)):
            out.append(t)
    return out


def fingerprint_of(text: str | None, words: int = 4) -> int:
    """The SimHash of one whole text; 0 for a text without words."""
    import xxhash

    tokens = (text or "").encode("utf-8").translate(_LOWER).split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, 42)
    sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    stops = ends[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return majority_bits(np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=False)], dtype=np.uint64))


def majority_bits(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 for none."""
    hashes, bits = hashes.astype(">u8"), np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 14):
        bits += np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """doc_id, the fingerprint as a signed long ``fp``, and ``text_hash``, a hash of the text (null: empty) that tells texts of one id apart."""
    limit_arrow_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), text_hash(text_col).alias("text_hash"))

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint_of(t, words) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), b.column(2)], names=["doc_id", "fp", "text_hash"])

    return own.mapInArrow(run, "doc_id long, fp long, text_hash long")


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


class Forest:
    """Union-find over positions 0..n-1; the smaller root wins."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def differing(front: np.ndarray, left: np.ndarray, max_bits: int) -> np.ndarray:
    """Which of ``left`` are within ``max_bits`` of any of ``front``: bytes are tallied first, bits are counted where the tally leaves a pair."""
    x = front[:, None] ^ left[None, :]
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    equal = np.bitwise_count(~(((x & low) + low) | x | low))
    rows, cols = np.nonzero(equal >= BYTES - max_bits)
    hit = np.zeros(len(left), dtype=bool)
    hit[cols[np.bitwise_count(x[rows, cols]) <= max_bits]] = True
    return hit


def link_posting(fps: np.ndarray, node: np.ndarray, forest: Forest, max_bits: int) -> None:
    """Join the entries of one posting that pass the count filter and the verification.

    Each entry is compared once with those not yet reached, in bounded blocks, so linked entries leave the comparison early.
    """
    left = np.arange(len(node))
    while len(left) > 1:
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            step = max(1, (1 << 20) // len(left))
            front, stack = stack[:step], stack[step:]
            hit = differing(fps[front], fps[left], max_bits)
            for k in left[hit].tolist():
                forest.join(int(node[front[0]]), int(node[k]))
                stack.append(k)
            left = left[~hit]


def posting_links(entries: DataFrame, max_bits: int, hot: int | None) -> DataFrame:
    """Links (src, dst), dst the least of its part in the task, over entries (posting, fp) placed by posting.

    A posting of more than ``hot`` entries is not compared; its entries leave as rows (src, null, posting).
    """

    def run(batches):
        cols = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not cols:
            return
        group, fp = (np.concatenate(c) for c in zip(*cols, strict=True))
        fps, node = np.unique(fp, return_inverse=True)
        order = np.argsort(group, kind="stable")
        group, node = group[order], node[order]
        cuts = np.flatnonzero(np.diff(group)) + 1
        starts, stops = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(group)]])
        words = fps.view(np.uint64)
        forest = Forest(len(fps))
        pair = stops - starts == 2
        a, b = node[starts[pair]], node[starts[pair] + 1]
        x = words[a] ^ words[b]
        kept = np.flatnonzero((x.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1) >= BYTES - max_bits)
        kept = kept[np.bitwise_count(x[kept]) <= max_bits]
        for i, j in zip(a[kept].tolist(), b[kept].tolist(), strict=True):
            forest.join(i, j)
        names = ["src", "dst", "posting"]
        for s, e in zip(starts[stops - starts > 2].tolist(), stops[stops - starts > 2].tolist(), strict=True):
            if hot is not None and e - s > hot:
                own = fps[node[s:e]]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.nulls(e - s, pa.int64()), pa.array(group[s:e])], names=names)
            else:
                link_posting(words[node[s:e]], node[s:e], forest, max_bits)
        up = np.array([forest.root(i) for i in range(len(fps))])
        moved = np.flatnonzero(up != np.arange(len(fps)))
        if len(moved):
            yield pa.RecordBatch.from_arrays([pa.array(fps[moved]), pa.array(fps[up[moved]]), pa.nulls(len(moved), pa.int64())], names=names)

    return entries.select("posting", "fp").mapInArrow(run, "src long, dst long, posting long")


def _byte(p: int) -> Column:
    return F.expr(f"shiftrightunsigned(fp, {56 - 8 * p}) & 255")


def fingerprint_links(entries: DataFrame, max_bits: int, posting_rows: int, scratch: Scratch) -> DataFrame:
    """Links (src, dst) that span the parts of distinct fingerprints ``fp`` within ``max_bits`` bits of one another.

    Postings of more than ``HOT`` entries are dealt once more: two entries that share the posting's three bytes share a
    fourth, so each goes to the five postings of three bytes and one more.
    """
    spark = entries.sparkSession
    three = F.array(*(F.lit(t << 24) + F.shiftleft(_byte(a), 16) + F.shiftleft(_byte(b), 8) + _byte(c) for t, (a, b, c) in enumerate(triples())))
    keyed = entries.select("fp", F.explode(three).alias("posting"))
    n = entries.select(F.approx_count_distinct("fp")).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-len(triples()) * n // posting_rows))
    found = scratch.write(posting_links(keyed.repartition(tasks, "posting"), max_bits, HOT))
    links, hot = found.where("dst IS NOT NULL").select("src", "dst"), found.where("dst IS NULL").select(F.col("src").alias("fp"), "posting")
    if hot.isEmpty():
        return links
    more = F.lit(None).cast("array<bigint>")
    for t, own in enumerate(triples()):
        rest = [p for p in range(BYTES) if p not in own]
        more = F.when(F.shiftright("posting", 24) == t, F.array(*((F.col("posting") * 8 + p) * 256 + _byte(p) for p in rest))).otherwise(more)
    again = hot.select("fp", F.explode(more).alias("posting"))
    rest = posting_links(again.repartition(tasks, "posting"), max_bits, None).select("src", "dst")
    return scratch.write(links.union(rest))


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of the undirected links, root the least node reached.

    Alternates large-star and small-star contractions until the links repeat; each round is a written table.
    """

    def large_star(e: DataFrame) -> DataFrame:
        pairs = e.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(e.select(F.col("dst").alias("u"), F.col("src").alias("v")))
        low = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return spread_join(pairs.where("v > u"), low, "u", "v").select(F.col("v").alias("src"), F.col("m").alias("dst")).distinct()

    def small_star(e: DataFrame) -> DataFrame:
        low = e.groupBy("src").agg(F.min("dst").alias("m"))
        moved = e.join(low, "src").where("dst != m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        return moved.union(low.select("src", F.col("m").alias("dst"))).distinct()

    current, mark = links, None
    while True:
        new = scratch.write(small_star(large_star(current)))
        row = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)")).alias("h")).first()
        if mark is not None:
            scratch.drop(current)
        if (row.n, row.h) == mark:
            return new.select(F.col("src").alias("node"), F.col("dst").alias("root"))
        current, mark = new, (row.n, row.h)


def grouped(docs: DataFrame, id_col: str, text_col: str, words: int, max_bits: int, posting_rows: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, text_hash) of every document, and (own, root, component_id) of every distinct fingerprint ``own``."""
    if not 0 <= max_bits <= 4:
        raise ValueError("the position triples guarantee a meeting for at most 4 differing bits")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    marked = scratch.write(fingerprints(docs, id_col, text_col, words))
    entries = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = fingerprint_links(entries, max_bits, posting_rows, scratch)
    roots = components(links, scratch)
    # only linked fingerprints need their component's least id; the others are components of their own
    linked = roots.select(F.col("node").alias("own"), "root").union(roots.select("root", "root").distinct())
    members = linked.join(entries, linked.own == entries.fp).select("own", "root", "least")
    ids = members.groupBy("root").agg(F.min("least").alias("component_id"))
    named = spread_join(members.select("own", "root"), ids, "root", "own").select("own", "root", "component_id")
    every = entries.join(named, entries.fp == named.own, "left")
    every = every.select(F.col("fp").alias("own"), F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    # dealt otherwise than by fingerprint, so that the join with the documents deals both sides anew and may split a hot fingerprint
    return marked, every.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "component_id", "own")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_bits: int = 4, posting_rows: int = 400_000
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable).

    Null and empty texts have fingerprint zero and link like any other. Copies share a fingerprint and so a component.
    Repeated rows are returned each; a null id takes its component's least id; an empty table gives no rows; extra
    columns are not read. ``posting_rows`` sets how many index rows a task gets; no posting is capped.
    """
    marked, named = grouped(docs, id_col, text_col, words, max_bits, posting_rows)
    return marked.join(named, marked.fp == named.own).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_bits: int = 4, posting_rows: int = 400_000, similarity: float | None = None
) -> DataFrame:
    """``docs`` with one row of each component: that of the least id, of repeated rows one. Null ids are the last choice.

    Documents are linked by ``max_bits`` of their fingerprints or, where ``similarity`` is given, by a Jaccard similarity of at
    least that of their sets of shingles: pairs of near fingerprints are verified on the sets, and pairs whose fingerprints
    lie farther apart are found by ``near``. Null texts and texts without words are one group. An empty table gives no rows.
    """
    if similarity is not None:
        return _deduplicate_similar(docs, id_col, text_col, words, max_bits, posting_rows, similarity)
    marked, named = grouped(docs, id_col, text_col, words, max_bits, posting_rows)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("keep")
    least = marked.groupBy("fp").agg(first).join(named, F.col("fp") == F.col("own")).groupBy("root").agg(F.min("keep").alias("keep"))
    keep = least.select(F.col("keep.doc_id").alias("keep_id"), F.col("keep.text_hash").alias("keep_hash"))
    hold = "text_hash"
    while hold in docs.columns:
        hold += "_"
    own = docs.withColumn(hold, text_hash(text_col))
    kept = own.join(keep, own[id_col].cast("long").eqNullSafe(F.col("keep_id")) & (own[hold] == F.col("keep_hash")), "left_semi")
    return kept.dropDuplicates([id_col, hold]).select(*docs.columns)


def _deduplicate_similar(docs: DataFrame, id_col: str, text_col: str, words: int, max_bits: int, posting_rows: int, similarity: float) -> DataFrame:
    """One row of each distinct text, told apart by a 64-bit hash, then one of each component of similar texts.

    ``docs`` is read for each pass over the texts instead of being written once more, and what the passes leave is deleted.
    """
    from . import near

    limit_arrow_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    key, mark = "key", "mark"
    while key in docs.columns or mark in docs.columns:
        key, mark = key + "_", mark + "_"
    own = docs.withColumn(key, text_hash(text_col))
    own = own.withColumn(mark, F.xxhash64(F.col(id_col).isNull(), F.col(id_col).cast("long"), key))
    least = F.min(F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).cast("long").alias("id"), F.col(mark).alias("mark")))
    first = scratch.write(own.groupBy(F.col(key).alias("key")).agg(least.alias("least"), F.count("*").alias("n")))
    # only texts that are there more than once are dealt to drop the copies
    again = first.where("n > 1").select(F.col("key").alias(key), F.col("least.mark").alias("least_" + mark))
    again = scratch.write(again)
    n = scratch.rows(again)
    copies = near.joined(own, again, key, n=n).where(F.col(mark) == F.col("least_" + mark)).dropDuplicates([mark]).select(*own.columns)
    copies = scratch.write(copies)
    one = near.joined(own, again.select(key), key, "left_anti", n).select(*own.columns).unionByName(copies)
    texts = one.select(F.col(key).alias("key"), F.col(text_col).alias("text"))
    roots = near.similar_texts(texts, words, similarity, scratch, max_bits, posting_rows)
    members = roots.select(F.col("node").alias("key"), "root").union(roots.select("root", "root")).distinct()
    placed = members.join(first, "key")
    best = placed.groupBy("root").agg(F.min(F.struct("least", "key")).alias("m")).select("root", F.col("m.key").alias("best"))
    gone = scratch.write(placed.join(best, "root").where("key <> best").select(F.col("key").alias(key)))
    scratch.drop(first)
    scratch.tidy()
    return near.joined(one, gone, key, "left_anti").select(*docs.columns)
