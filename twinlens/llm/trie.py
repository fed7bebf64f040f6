"""Prefix trie of conversations, by Patricia construction over their sorted sequences.

A conversation is the sequence of its turns' digests (role and text); the texts themselves don't travel. Distinct sequences are
dealt by range and sorted, so a task sees a run of neighbours and keeps only the path it stands on: points are made where
sequences branch, end or are leaves, and an edge between two points carries the lengths of the turns on it. A point's numbers
are final when the run leaves it; then the unary nodes of the edge above it are written, with suffix sums of the edge.

Nodes on the path from one run to the next are seen by both. Each depth of that path is a point there, counts of both are added
up, and what must be counted once (a node's length, a child) is counted by the run that comes to the node first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, limit_arrow_batches

#: Hex digits of a turn's digest, and bytes of it in a sequence.
DIGITS, WIDTH = 32, 16
NOTHING = hashlib.sha256(b"").hexdigest()
#: Characters of a piece of a list of ids, and rows of a batch of nodes.
PIECE = 1 << 16
BATCH = 8192
#: Rows of nodes on the paths between runs that are sent to all tasks; more are dealt.
FEW_PATHS = 20_000
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: What a run writes: final nodes, and parts of the nodes of its outer paths, which have a key; ``above`` is the key of a parent there.
PART = f"{NODE}, key string, above string, own long"


def turn_digest(role: Column, text: Column) -> Column:
    """128 bits of a turn in hex; the role's length keeps the two apart."""
    return F.left(F.sha2(F.concat_ws("\0", F.char_length(role).cast("string"), role, text), 256), F.lit(DIGITS))


def rebuilt(conversations: DataFrame, heads: int = 6, family: int = 100) -> DataFrame:
    """(conv_id, turns): the first h turns of the first conversation of the family, then the own turns after the first h.

    h is crc32 of the decimal id, modulo ``heads``. Turns are ordered by number, null first, equal numbers by digest. Null roles
    and texts are empty; rows without a conv_id belong to no conversation. ``turns`` is array<struct<digest, size>>.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    c = F.col("conv_id").cast("long")
    turn = F.struct(F.col("turn").isNotNull().alias("k"), F.col("turn"), turn_digest(role, text).alias("digest"), F.char_length(text).alias("size"))
    rows = conversations.where("conv_id IS NOT NULL").select((c - c % family).alias("base"), c.alias("conv_id"), turn.alias("turn"))
    # one deal by family serves the grouping and both sides of the join
    listed = rows.repartition("base").groupBy("base", "conv_id").agg(F.array_sort(F.collect_list("turn")).alias("own"))
    own = listed.select("base", "conv_id", F.transform("own", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("own"))
    first = own.where("conv_id = base").select("base", F.slice("own", 1, heads - 1).alias("head")) if heads > 1 else own.limit(0).select("base", F.col("own").alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    none = F.array().cast(own.schema["own"].dataType)
    joined = own.join(first, "base", "left").withColumn("h", h)
    rest = F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), rest).alias("turns"))


def plain(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) of conversations as they are."""
    return rebuilt(conversations, heads=1)


def ends(sequences: DataFrame) -> DataFrame:
    """(sid, ends): SHA-256 of the ascending ids of each sequence (sid, conv_id), comma-joined.

    Ids are dealt by range, so those of a hot sequence lie in several tasks, which join them into pieces; a second task reads the
    pieces in order, one at a time.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, held, size = None, 0, [], 0
        rows: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["sid", "first", "piece"])
        for b in batches:
            for sid, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if sid != now or size >= PIECE:
                    if held:
                        rows.append((now, first, ",".join(held)))
                    now, first, held, size = sid, conv, [], 0
                    if len(rows) >= BATCH or len(rows) * PIECE > 8 << 20 and sum(len(r[2]) for r in rows) > 4 << 20:
                        yield batch()
                        rows = []
                held.append(str(conv))
                size += len(held[-1]) + 1
        if held:
            rows.append((now, first, ",".join(held)))
        yield batch()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, out = None, None, []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in (0, 1)], names=["sid", "ends"])
        for b in batches:
            for sid, piece in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if sid != now:
                    if now is not None:
                        out.append((now, h.hexdigest()))
                    now, h = sid, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(piece.encode())
            if len(out) >= BATCH:
                yield batch()
                out = []
        if now is not None:
            out.append((now, h.hexdigest()))
        yield batch()

    ids = sequences.select("sid", "conv_id").repartitionByRange("sid", "conv_id").sortWithinPartitions("sid", "conv_id")
    joined = ids.mapInArrow(pieces, "sid string, first long, piece string")
    return joined.repartition("sid").sortWithinPartitions("sid", "first").mapInArrow(hashed, "sid string, ends string")


def common_turns(a: bytes, b: bytes) -> int:
    """How many turns two sequences begin with alike."""
    n = min(len(a), len(b)) // WIDTH
    if a[: n * WIDTH] == b[: n * WIDTH]:
        return n
    x, y = (np.frombuffer(s, dtype=np.uint8, count=n * WIDTH) for s in (a, b))
    return int((x != y).argmax()) // WIDTH


class Point:
    """A node of the compressed trie: what its subtree holds of this run. ``path`` is its key if other runs see it too."""

    __slots__ = ("depth", "convs", "least", "children", "leaves", "with_copies", "lengths", "ends", "owned", "path", "waiting", "sizes")

    def __init__(self, depth: int, owned: bool = True, path: str | None = None):
        self.depth, self.owned, self.path = depth, owned, path
        self.convs = self.children = self.leaves = self.with_copies = self.lengths = 0
        self.least = self.ends = None
        #: Points below that wait for this one's smallest member; none wait for a node that other runs see.
        self.waiting: list[Point] = []


class Run:
    """The trie of a run of sorted sequences; ``before`` and ``after`` are turns in common with the runs around it, -1 without one."""

    def __init__(self, before: int, after: int):
        self.before, self.after, self.stack, self.seq, self.sizes, self.rows = before, after, [], b"", np.zeros(0, dtype=np.int64), []

    def key(self, depth: int) -> str:
        return hashlib.sha256(self.seq[: depth * WIDTH]).hexdigest()

    def add(self, seq: bytes, sizes: np.ndarray, convs: int, least: int, ends: str) -> None:
        first = not self.stack
        same = 0 if first else common_turns(self.seq, seq)
        if not first:
            self.leave(same)
        self.seq, self.sizes = seq, sizes
        if first:
            for d in range(self.before + 1):
                self.stack.append(Point(d, owned=False, path=self.key(d)))
            if self.before < 0:
                self.stack.append(Point(0, path=self.key(0) if self.after >= 0 else None))
        if self.stack[-1].depth < len(sizes):
            self.stack.append(Point(len(sizes)))
        top = self.stack[-1]
        top.convs, top.least, top.ends = top.convs + convs, least if top.least is None else min(least, top.least), ends

    def leave(self, depth: int, path: bool = False) -> None:
        """Close the points below ``depth`` of the current path; a point is made there. ``path``: other runs see what stays."""
        while self.stack[-1].depth > depth:
            p = self.stack.pop()
            if self.stack[-1].depth < depth:
                self.stack.append(Point(depth, path=self.key(depth) if path else None))
            self.close(p, self.stack[-1])

    def close(self, p: Point, up: Point | None) -> None:
        """Hand a point's numbers up; write it, or let it wait for its parent's smallest member."""
        own = int(self.sizes[p.depth - 1]) if p.depth else 0
        if not p.children and p.ends is not None and p.owned and not (p.path and p.depth == self.after == len(self.seq) // WIDTH):
            p.leaves = 1
        p.with_copies += p.convs * own
        p.lengths += own if p.owned else 0
        edge = self.sizes[up.depth : p.depth - 1] if up else self.sizes[:0]
        p.sizes = edge
        if up:
            total = int(edge.sum())
            up.convs += p.convs
            up.least = p.least if up.least is None else min(up.least, p.least)
            up.leaves += p.leaves
            up.children += p.owned
            up.with_copies += p.with_copies + p.convs * total
            up.lengths += p.lengths + total
            if up.path is None:
                up.waiting.append(p)
            else:
                self.write(p, None, up.path)
        else:
            self.write(p, None, None)

    def write(self, p: Point, parent: int | None, above: str | None) -> None:
        """The rows of a point and of the unary nodes above it, and those of the points that waited for it."""
        todo = [(p, parent, above)]
        while todo:
            p, parent, above = todo.pop()
            if p.path is not None:
                # a part: saved_tokens is the sum over members here, own what is taken off once
                self.rows.append((p.least, p.depth, None, p.convs, p.children, p.leaves, p.with_copies, p.ends, p.path, above, p.lengths))
            else:
                saved, top = p.with_copies - p.lengths, p.depth - len(p.sizes)
                self.rows.append((p.least, p.depth, p.least if len(p.sizes) else parent, p.convs, p.children, p.leaves, saved, p.ends or NOTHING, None, None if len(p.sizes) else above, None))
                below = (p.convs - 1) * np.cumsum(p.sizes[::-1])[::-1] + saved
                for k, s in enumerate(below.tolist()):
                    d = top + k
                    self.rows.append((p.least, d, p.least if k else parent, p.convs, 1, p.leaves, s, NOTHING, None, None if k else above, None))
            todo += [(q, p.least, None) for q in p.waiting]
            p.waiting = []

    def finish(self) -> None:
        """Close all points; those of the path to the next run are parts, a point at each depth."""
        self.leave(self.after if self.after >= 0 else 0, path=self.after >= 0)
        for d in range(self.after, -1, -1):
            p = self.stack.pop()
            p.path = p.path or self.key(d)
            for q in p.waiting:  # they have met nothing that knows the key
                self.write(q, None, p.path)
            p.waiting = []
            if d and (not self.stack or self.stack[-1].depth < d - 1):
                self.stack.append(Point(d - 1, path=self.key(d - 1)))
            if d:
                self.stack[-1].path = self.stack[-1].path or self.key(d - 1)
            self.close(p, self.stack[-1] if d else None)
        if self.stack:
            p = self.stack.pop()
            self.close(p, None)


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in PART.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in PART.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def run_ends(dealt: DataFrame) -> dict[int, tuple[int, int]]:
    """For each run (by its number) the turns that its first and last sequence have in common with their neighbours: two numbers a run."""

    def ends_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[bytes]] = {}
        for b in batches:
            for run, seq in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                least, most = found.get(run, (seq, seq))
                found[run] = [min(least, seq), max(most, seq)]
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([v[0] for v in found.values()], pa.binary()), pa.array([v[1] for v in found.values()], pa.binary())], names=["run", "first", "last"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, []
        for b in batches:
            for run, least, most in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                rows.append((run, -1 if last is None else common_turns(last, least)))
                last = most
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64())], names=["run", "before"])

    each = dealt.select("run", "seq").mapInArrow(ends_of, "run int, first binary, last binary")
    each = each.groupBy("run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    rows = sorted(each.coalesce(1).sortWithinPartitions("run").mapInArrow(compared, "run int, before long").collect())
    return {run: (before, rows[k + 1][1] if k + 1 < len(rows) else -1) for k, (run, before) in enumerate(rows)}


def trie(sequences: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of (conv_id, turns), one row each, with the columns of NODE.

    ``conv_id`` is a node's smallest member (null for no member with an id), ``depth`` 0 is the root, which conversations
    without turns end at. Equal conversations share all nodes; repeated ids are members each for itself. Without conversations
    there is no node. A sequence is held whole, 20 bytes a turn, whatever its texts.
    """
    spark = sequences.sparkSession
    limit_arrow_batches(spark, rows=4096)
    scratch = Scratch(spark)
    seq = F.unhex(F.array_join(F.col("turns.digest"), ""))
    rows = scratch.write(sequences.select("conv_id", seq.alias("seq"), F.col("turns.size").alias("sizes")).withColumn("sid", F.sha2("seq", 256)))
    distinct = rows.groupBy("sid").agg(F.first("seq").alias("seq"), F.first("sizes").alias("sizes"), F.count("*").alias("convs"), F.min("conv_id").alias("least"))
    ranged = distinct.join(ends(rows), "sid").drop("sid").repartitionByRange("seq").withColumn("run", F.spark_partition_id())
    dealt = scratch.write(ranged)
    around = spark.sparkContext.broadcast(run_ends(dealt))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for b in batches:
            runs, seqs, sizes, convs, least, ended = (b.column(k) for k in range(6))
            for k, run in enumerate(runs.to_pylist()):
                if run != now:
                    if own:
                        own.finish()
                        yield _columns(own.rows)
                    now, own = run, Run(*around.value[run])
                own.add(seqs[k].as_py(), np.asarray(sizes[k].values, dtype=np.int64), convs[k].as_py(), least[k].as_py(), ended[k].as_py())
                if len(own.rows) >= BATCH:
                    yield _columns(own.rows)
                    own.rows = []
        if own:
            own.finish()
            yield _columns(own.rows)

    runs = dealt.select("run", "seq", "sizes", "convs", "least", "ends").repartition("run").sortWithinPartitions("run", "seq")
    parts = scratch.write(runs.mapInArrow(walk, PART))
    whole = parts.where("key IS NOT NULL").groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("above").alias("above"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), (F.sum("saved_tokens") - F.sum("own")).alias("saved_tokens"), F.coalesce(F.max("ends_sha256"), F.lit(NOTHING)).alias("ends_sha256"),
    )
    whole = scratch.write(whole)
    names = [x.split()[0] for x in NODE.split(", ")]
    parents = whole.select(F.col("key").alias("above"), F.col("conv_id").alias("met"))
    parents = F.broadcast(parents) if parents.count() <= FEW_PATHS else parents
    final = parts.where("key IS NULL").select(*names, "above").unionByName(whole.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*names, "above"))
    return final.join(parents, "above", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "met")).select(*names)


#: The nodes by grouping every prefix, for whole small tables.
ORACLE = """
    WITH RECURSIVE ids AS (
        SELECT DISTINCT conv_id AS c, list_reduce(
            list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(unicode(s) AS BIGINT))),
            lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))) AS crc
        FROM conversations WHERE conv_id IS NOT NULL),
    t AS (
        SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS v
        FROM conversations WHERE conv_id IS NOT NULL),
    h AS (SELECT c, c - c % 100 AS base, CAST(xor(crc, 4294967295) % 6 AS BIGINT) AS h FROM ids),
    turns AS (
        SELECT h.c, t.k, t.v FROM h JOIN t ON t.c = h.base AND t.k <= h.h
        UNION ALL SELECT h.c, t.k, t.v FROM h JOIN t ON t.c = h.c AND t.k > h.h),
    seqs AS (SELECT h.c, coalesce(s, []) AS s FROM h LEFT JOIN (SELECT c, list(v ORDER BY k) AS s FROM turns GROUP BY c) x ON x.c = h.c),
    prefixes AS (SELECT c, s[1:d] AS p, d, len(s) = d AS ending FROM seqs, LATERAL (SELECT unnest(range(len(s) + 1)) AS d) x),
    nodes AS (
        SELECT p, min(d) AS depth, min(c) AS conv_id, count(*) AS n, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ending), '') AS ends FROM prefixes GROUP BY p),
    kids AS (SELECT p[1:depth - 1] AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
    full_nodes AS (SELECT o.*, coalesce(k.n, 0) AS children, CASE WHEN o.depth = 0 THEN 0 ELSE (o.n - 1) * length(o.p[-1].t) END AS own FROM nodes o LEFT JOIN kids k ON k.p = o.p),
    below AS (
        SELECT p[1:d] AS p, sum(own) AS saved, count_if(children = 0) AS leaves
        FROM full_nodes, LATERAL (SELECT unnest(range(depth + 1)) AS d) x GROUP BY 1)
    SELECT o.conv_id, CAST(o.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(o.n AS BIGINT) AS n_convs, CAST(o.children AS BIGINT) AS n_children, CAST(b.leaves AS BIGINT) AS n_leaves,
        CAST(b.saved AS BIGINT) AS saved_tokens, sha256(o.ends) AS ends_sha256
    FROM full_nodes o JOIN below b ON b.p = o.p LEFT JOIN nodes up ON o.depth > 0 AND up.p = o.p[1:o.depth - 1]"""
