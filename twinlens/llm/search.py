"""Blockwise top-k search over vectors: exact by dual cover trees, approximate by stable projections and a kd-tree.

Equal vectors are one entry that carries its k + 1 smallest ids, enough for any answer, so a vector that fills a third
of the table is a single entry. Entries go to the nearest of a few centres, chosen farthest first from a bounded sample,
and a centre's entries fall by hash into index and query blocks of fixed size. A query is first searched in the blocks of
its own centre; the worst kth score of a centre's queries and the covering radii of both centres then decide which other
centres its blocks have to meet at all, and the kth scores go with them. Memory is bounded by the blocks at any input size.
Each task returns k + 1 rows for a query entry, and the best of them over all index blocks are the answer.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .common import Scratch

INDEX_BLOCK = 16384
QUERY_BLOCK = 8192
LEAF = 96
#: Entries that centres are chosen from at most, and centres at most; every entry is indexed.
SAMPLE = 4096
CENTRES = 256
#: Children of a cover-tree node at most; points that no child covers within half the node's radius join the nearest.
FAN = 24
#: A node of LEAF points or fewer is only divided where so many children cover it within half its radius, as in clusters:
#: elsewhere smaller nodes cost more than their bounds save.
TIGHT = 8


# Cover trees


class Node:
    __slots__ = ("center", "norm", "radius", "start", "stop", "children")

    def __init__(self, center: np.ndarray, radius: float, start: int, stop: int):
        self.center, self.radius, self.start, self.stop = center, radius, start, stop
        self.norm = float(np.sqrt(center @ center))
        self.children: list[Node] = []


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[Node, np.ndarray]:
    """A tree over the rows of ``points`` and the order in which its nodes hold them.

    A node's centre is one of its points. Its children's centres are chosen farthest first, each covering what lies
    within half the node's radius; the stored radius is the true distance to the farthest point below, so bounds hold.
    """
    order = np.arange(len(points))

    def node(start: int, stop: int) -> tuple[Node, np.ndarray]:
        own = points[order[start:stop]]
        spread = own - own.mean(axis=0)
        center = own[int((spread * spread).sum(axis=1).argmin())]
        d = own - center
        d = np.sqrt((d * d).sum(axis=1))
        return Node(center, float(d.max()), start, stop), d

    root, dist = node(0, len(points))
    todo = [(root, dist)]
    while todo:
        n, dist = todo.pop()
        size = n.stop - n.start
        if size <= TIGHT or n.radius == 0:
            continue
        own = points[order[n.start : n.stop]]
        nearest, label = dist.copy(), np.zeros(size, dtype=np.int64)
        for c in range(1, FAN if size > leaf else TIGHT):
            far = int(nearest.argmax())
            if nearest[far] <= n.radius / 2:
                break
            d = own - own[far]
            d = np.sqrt((d * d).sum(axis=1))
            closer = d < nearest
            nearest[closer], label[closer] = d[closer], c
        if size <= leaf and nearest.max() > n.radius / 2:
            continue
        place = np.argsort(label, kind="stable")
        order[n.start : n.stop] = order[n.start : n.stop][place]
        cuts = np.flatnonzero(np.diff(label[place])) + 1
        bounds = [0, *cuts.tolist(), size]
        if len(bounds) == 2:
            continue
        for a, b in zip(bounds, bounds[1:], strict=False):
            child, d = node(n.start + a, n.start + b)
            n.children.append(child)
            todo.append((child, d))
    return root, order


def best_of(score: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores of each row with their places, ties to the smaller place."""
    order = np.lexsort((place, ~score), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(place, order, 1)


def products(a: np.ndarray, b: np.ndarray, top: int) -> np.ndarray:
    """Exact inner products of integer rows; those beyond a long are the greatest or least long."""
    if top < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if top < 1 << 63:
        return a @ b.T
    ends = np.iinfo(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, ends.min, ends.max).astype(np.int64)


def dual_tree_products(queries: np.ndarray, rows: np.ndarray, k: int, known: np.ndarray | None = None, tally: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and inner products of the k best rows of each query; ties to the smaller position; -1 where there are fewer.

    Integers. A pair of nodes is dropped when ``<a, b> + |a| rb + |b| ra + ra rb``, with centres a, b and covering radii
    ra, rb, is under the worst kth product of the queries below the first node. ``known`` are kth products that the queries
    have from elsewhere (NaN: none); rows under them may be left out. ``tally`` gets the number of products made.
    """
    top = int(np.abs(queries.astype(np.float64)).max(initial=0)) * int(np.abs(rows.astype(np.float64)).max(initial=0)) * queries.shape[1]
    q_tree, q_order = cover_tree(queries.astype(np.float64))
    r_tree, r_order = cover_tree(rows.astype(np.float64))
    q, r = queries[q_order], rows[r_order]
    if top < 1 << 53:
        q, r = q.astype(np.float64), r.astype(np.float64)
    low = np.iinfo(np.int64).min
    best, place = np.full((len(q), k), low, dtype=np.int64), np.full((len(q), k), len(rows), dtype=np.int64)
    worst = np.full(len(q), -np.inf) if known is None else np.where(np.isnan(known), -np.inf, known)[q_order]

    def bound(a: Node, b: Node) -> float:
        return (float(a.center @ b.center) + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius) + 1e-9 * (1 + a.norm + a.radius) * (1 + b.norm + b.radius)

    def visit(a: Node, b: Node) -> None:
        if bound(a, b) < worst[a.start : a.stop].min():
            return
        if not a.children and not b.children:
            own = slice(a.start, a.stop)
            score = products(q[own], r[b.start : b.stop], top)
            if tally is not None:
                tally.append(score.size)
            at = np.broadcast_to(r_order[b.start : b.stop], score.shape)
            best[own], place[own] = best_of(np.concatenate([best[own], score], axis=1), np.concatenate([place[own], at], axis=1), k)
            full = place[own, k - 1] < len(rows)
            worst[own] = np.where(full, np.maximum(worst[own], best[own, k - 1] - 1e-9 * np.abs(best[own, k - 1].astype(np.float64))), worst[own])
        elif a.children and (not b.children or a.radius > b.radius):
            for c in a.children:
                visit(c, b)
        else:
            for c in sorted(b.children, key=lambda x: -bound(a, x)):
                visit(a, c)

    visit(q_tree, r_tree)
    out_place, out_score = np.empty_like(place), np.empty_like(best)
    out_place[q_order], out_score[q_order] = np.where(place < len(rows), place, -1), best
    return out_place, out_score


# Stable projections


def chi_square_cdf(x: np.ndarray | float, even_df: int) -> np.ndarray:
    """The chi-square distribution function for an even number of degrees of freedom."""
    half = np.asarray(x, dtype=np.float64) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, even_df // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def chi_square_at(p: float, even_df: int) -> float:
    """The value whose distribution function is ``p``."""
    low, high = 0.0, 1.0
    while chi_square_cdf(high, even_df) < p:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, even_df) < p else (low, mid)
    return high


class KdTree:
    """Median splits on the widest side down to ``leaf`` points; keeps the leaves' boxes. Neighbours in ``order`` lie near one another."""

    def __init__(self, points: np.ndarray, leaf: int = 64):
        order, ranges, todo = np.arange(len(points)), [], [(0, len(points))]
        while todo:
            a, b = todo.pop()
            if b - a <= leaf:
                ranges.append((a, b))
                continue
            own = points[order[a:b]]
            side, mid = int(np.ptp(own, axis=0).argmax()), (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, side], mid)]
            todo += [(a, a + mid), (a + mid, b)]
        self.order, self.ranges = order, sorted(ranges)
        self.low = np.stack([points[order[a:b]].min(axis=0) for a, b in self.ranges])
        self.high = np.stack([points[order[a:b]].max(axis=0) for a, b in self.ranges])


#: Projections, the confidence of the stopping test, and the approximation ratio that it allows.
DIMS, CONFIDENCE, RATIO = 24, 0.98, 1.1
#: Queries that walk the leaves together, and leaves that they take in a step.
TOGETHER, STEP = 32, 8


def projection(width: int, dims: int = DIMS, seed: int = 11) -> np.ndarray:
    """Gaussian (2-stable) directions for vectors of this length."""
    return np.random.default_rng(seed).normal(size=(width, dims))


def projected_neighbours(
    queries: np.ndarray, rows: np.ndarray, k: int, known: np.ndarray | None = None, dims: int = DIMS, confidence: float = CONFIDENCE, ratio: float = RATIO, seed: int = 11, tally: list | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Positions and Euclidean distances of the k nearest rows found for each query, nearest first, ties to the smaller position.

    Rows are projected on ``dims`` Gaussian (2-stable) directions and indexed by a kd-tree. A query's own nearest leaf is
    verified first. Then leaves come in the order of projected distance to a group of neighbouring queries, and of their rows
    those are verified on the full vectors that the stopping test leaves open: a query is done with rows from the projected distance d on when
    ``P(chi2(dims) <= (ratio * d / kth distance)**2)`` reaches ``confidence``, because by 2-stability a row nearer than
    the kth distance by that ratio would have appeared before with that probability. The walk ends when all of the group
    are done with the next leaf's box. ``known`` are kth distances from elsewhere (NaN: none). ``tally`` gets (rows verified, rows read in the
    projection, all rows), over the queries.
    """
    directions = projection(rows.shape[1], dims, seed)
    tree = KdTree(rows @ directions)
    sorted_rows = rows[tree.order]
    thin = sorted_rows @ directions
    norms = (thin * thin).sum(axis=1)
    leaf_of = np.repeat(np.arange(len(tree.ranges)), [b - a for a, b in tree.ranges])
    reach = chi_square_at(confidence, dims) / ratio**2
    place, dist = np.full((len(queries), k), len(rows), dtype=np.int64), np.full((len(queries), k), np.inf)
    limit = np.full(len(queries), np.inf) if known is None else np.where(np.isnan(known), np.inf, known)
    if not len(queries):
        return place, dist
    flat = queries @ directions
    for group in np.array_split(KdTree(flat, TOGETHER).order, -(-len(queries) // TOGETHER)):
        q, p = queries[group], flat[group]
        best_d, best_i, kth = dist[group], place[group], limit[group]
        # each query's own nearest leaf gives it a first kth distance
        own_gap = np.maximum(tree.low[None] - p[:, None], 0) + np.maximum(p[:, None] - tree.high[None], 0)
        boxes = (own_gap * own_gap).sum(axis=2)
        seed_leaf = boxes.argmin(axis=1)
        nearest = boxes.min(axis=0)
        leaves = np.argsort(nearest, kind="stable")
        verified = read = 0
        for n, x in enumerate(seed_leaf.tolist()):
            a, b = tree.ranges[x]
            gap = sorted_rows[a:b] - q[n]
            d = np.sqrt((gap * gap).sum(axis=1))
            order = np.lexsort((tree.order[a:b], d))[:k]
            best_d[n, : len(order)], best_i[n, : len(order)] = d[order], tree.order[a:b][order]
            verified, read = verified + b - a, read + b - a
        kth = np.minimum(kth, best_d[:, -1])
        for at in range(0, len(leaves), STEP):
            if nearest[leaves[at]] >= reach * (kth * kth).max():
                break
            step = leaves[at : at + STEP]
            step = step[(boxes[:, step] < (reach * kth * kth)[:, None]).any(axis=0)]
            if not len(step):
                continue
            own = np.concatenate([np.arange(*tree.ranges[x]) for x in step])
            read += len(own) * len(group)
            far = (p * p).sum(axis=1)[:, None] + norms[own][None, :] - 2 * (p @ thin[own].T)
            i, j = np.nonzero((far < (reach * kth * kth)[:, None]) & (leaf_of[own][None, :] != seed_leaf[:, None]))
            if not len(i):
                continue
            verified += len(i)
            gap = sorted_rows[own[j]] - q[i]
            got = np.full((len(group), len(own)), np.inf)
            got[i, j] = np.sqrt((gap * gap).sum(axis=1))
            cols = np.flatnonzero((got <= best_d[:, -1:]).any(axis=0))
            d = np.concatenate([best_d, got[:, cols]], axis=1)
            where = np.concatenate([best_i, np.broadcast_to(tree.order[own[cols]], (len(group), len(cols)))], axis=1)
            order = np.lexsort((where, d), axis=1)[:, :k]
            best_d, best_i = np.take_along_axis(d, order, 1), np.take_along_axis(where, order, 1)
            kth = np.minimum(kth, best_d[:, -1])
        dist[group], place[group] = best_d, np.where(np.isfinite(best_d), best_i, len(rows))
        if tally is not None:
            tally.append((verified, read, len(group) * len(rows)))
    return np.where(place < len(rows), place, -1), dist


# Spark side


def entries(vectors: DataFrame, k: int) -> DataFrame:
    """(rep, ids, vec) from (id, vec), one row an id: one row per distinct vector with its k + 1 smallest ids, the least as ``rep``."""
    w = W.Window.partitionBy("vec").orderBy("id")
    first = vectors.withColumn("rn", F.row_number().over(w)).where(f"rn <= {k + 1}")
    return first.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "vec")


def centres(points: np.ndarray, n: int) -> np.ndarray:
    """Up to n of the points, farthest first."""
    chosen, nearest = [0], np.full(len(points), np.inf)
    while len(chosen) < n:
        d = points - points[chosen[-1]]
        nearest = np.minimum(nearest, (d * d).sum(axis=1))
        far = int(nearest.argmax())
        if nearest[far] == 0:
            break
        chosen.append(far)
    return points[chosen]


class Products:
    """Largest integer inner products, in the space of the vectors themselves."""

    largest, number = True, np.int64

    def points(self, vectors: np.ndarray) -> np.ndarray:
        return vectors.astype(np.float64)

    def kernel(self, queries: np.ndarray, rows: np.ndarray, k: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return dual_tree_products(queries, rows, k, known)

    def may_hold(self, a: np.ndarray, ra: float, b: np.ndarray, rb: float, worst: float) -> bool:
        """Whether a row within rb of b may beat the worst kth product of queries within ra of a."""
        na, nb = float(np.sqrt(a @ a)), float(np.sqrt(b @ b))
        return float(a @ b) + na * rb + nb * ra + ra * rb + 1e-6 * (1 + na + ra) * (1 + nb + rb) >= worst


@dataclass
class Distances:
    """Smallest Euclidean distances, in the space of the projections."""

    dims: int = DIMS
    confidence: float = CONFIDENCE
    ratio: float = RATIO
    largest, number = False, np.float64

    def points(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ projection(vectors.shape[1], self.dims)

    def kernel(self, queries: np.ndarray, rows: np.ndarray, k: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return projected_neighbours(queries, rows, k, known, self.dims, self.confidence, self.ratio)

    def may_hold(self, a: np.ndarray, ra: float, b: np.ndarray, rb: float, worst: float) -> bool:
        """Whether the stopping test leaves rows within rb of b open to queries within ra of a."""
        gap = max(0.0, float(np.sqrt(((a - b) ** 2).sum())) - ra - rb)
        return gap * gap < chi_square_at(self.confidence, self.dims) / self.ratio**2 * worst * worst * (1 + 1e-9)


def _matrix(column, number) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).astype(number).reshape(len(flat), -1)


def block_search(vectors: DataFrame, every: int, k: int, measure: Products | Distances, index_block: int = INDEX_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for the ids divisible by ``every`` against all others, from (id, vec).

    Vectors are compared with those of their own length. Of several vectors of an id the least is taken. In a block rows come
    by ascending least id, so that a kernel's ties go to the smaller id.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    one = scratch.write(vectors.groupBy("id").agg(F.min("vec").alias("vec")))
    index = scratch.write(entries(one, k))
    asked = scratch.write(one.where(F.col("id") % every == 0).join(index.select("rep", "vec"), "vec").select(F.col("id").alias("query_id"), "rep"))
    sizes = index.groupBy(F.size("vec").alias("w")).count().orderBy(F.col("count").desc(), "w").limit(1).collect()
    width, n = (sizes[0]["w"], sizes[0]["count"]) if sizes else (0, 0)
    some = index.where(F.size("vec") == width).orderBy(F.xxhash64("rep")).limit(SAMPLE).select("vec").toArrow()
    chosen = centres(measure.points(_matrix(some["vec"], measure.number)), max(1, min(CENTRES, -(-n // (index_block // 2))))) if some.num_rows else np.zeros((1, 1))

    def nearest(batches):
        for b in batches:
            widths = b.column(2).value_lengths().to_numpy()
            leaf, far = -widths.astype(np.int64), np.zeros(len(widths))
            at = np.flatnonzero(widths == width)
            if len(at):
                p = measure.points(_matrix(b.column(2).take(pa.array(at)), measure.number))
                leaf[at] = ((chosen * chosen).sum(axis=1)[None, :] - 2 * (p @ chosen.T)).argmin(axis=1)
                far[at] = np.sqrt(((p - chosen[leaf[at]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf), pa.array(far)], names=[*b.schema.names, "leaf", "far"])

    schema = T.StructType([*index.schema.fields, T.StructField("leaf", T.LongType()), T.StructField("far", T.DoubleType())])
    dealt = scratch.write(index.mapInArrow(nearest, schema))
    wanted = scratch.write(dealt.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "vec", "leaf", "far"))
    blocks = lambda df, name: df.groupBy("leaf").agg(F.count("*").alias(name), F.max("far").alias(f"{name}_radius"))
    shape = scratch.write(blocks(dealt, "rows").join(blocks(wanted, "queries"), "leaf", "left"))
    last = lambda n, size: F.floor((n - 1) / size)
    score_type = T.LongType() if measure.largest else T.DoubleType()
    arrow_type = pa.int64() if measure.largest else pa.float64()

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("side", "ascending"), ("rep", "ascending")])
        side = table.column("side").to_numpy()
        cut = int((side == 0).sum())
        names, out = ["rep", "vec_id", "score"], ([], [], [])
        if 0 < cut < len(side):
            matrix = _matrix(table.column("vec"), measure.number)
            ids = table.column("ids").to_pylist()[:cut]
            known = table.column("known").to_numpy()[cut:]
            place, score = measure.kernel(matrix[cut:], matrix[:cut], k + 1, known)
            for rep, ps, ss in zip(table.column("rep").to_pylist()[cut:], place.tolist(), score.tolist(), strict=True):
                found = [(-s if measure.largest else s, i, s) for p, s in zip(ps, ss, strict=True) if p >= 0 for i in ids[p]]
                for _, i, s in heapq.nsmallest(k + 1, found):
                    out[0].append(rep)
                    out[1].append(i)
                    out[2].append(s)
        return pa.Table.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], arrow_type)], names=names)

    def met(pairs: DataFrame, queries: DataFrame) -> DataFrame:
        """Searches the queries of each ``leaf`` in the index blocks of ``into``, for pairs with the numbers of rows of ``into`` and of its queries.

        An index block meets the queries of all leaves together, in blocks, so that its tree is made once for each of these.
        """
        pairs = pairs.select("leaf", "into", last(F.col("rows"), index_block).alias("last_r"), last(F.col("queries"), query_block).alias("last_q"))
        block = lambda n: F.pmod(F.xxhash64("rep", F.lit(7)), F.col(n) + 1)
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n)))
        r = dealt.withColumnRenamed("leaf", "into").join(F.broadcast(pairs.drop("leaf").distinct()), "into").withColumn("rb", block("last_r"))
        r = r.select(F.lit(0).alias("side"), "rep", "ids", "vec", F.lit(None).cast("double").alias("known"), "into", "rb", each("last_q").alias("qb"))
        q = queries.join(F.broadcast(pairs), "leaf").withColumn("qb", block("last_q"))
        q = q.select(F.lit(1).alias("side"), "rep", F.array().cast("array<bigint>").alias("ids"), "vec", "known", "into", each("last_r").alias("rb"), "qb")
        return r.unionByName(q).groupBy("into", "rb", "qb").applyInArrow(search, T.StructType([T.StructField("rep", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", score_type)]))

    order = F.col("score").desc() if measure.largest else F.col("score").asc()

    def best(found: DataFrame) -> DataFrame:
        w = W.Window.partitionBy("rep").orderBy(order, F.col("vec_id"))
        return found.withColumn("rn", F.row_number().over(w)).where(f"rn <= {k + 1}")

    home = shape.where("queries IS NOT NULL").select("leaf", F.col("leaf").alias("into"), "rows", "queries")
    first = scratch.write(best(met(home, wanted.withColumn("known", F.lit(None).cast("double")))))
    kth = first.where(f"rn = {k + 1}").select("rep", F.col("score").cast("double").alias("known"))
    placed = scratch.write(wanted.join(kth, "rep", "left"))
    # a row for each of at most CENTRES centres; without a kth score a query is open to all rows
    open_ = F.bool_or(F.col("known").isNull())
    worst = placed.groupBy("leaf").agg(F.when(~open_, F.min("known") if measure.largest else F.max("known")).alias("worst"))
    leaves = [r for r in shape.join(worst, "leaf", "left").where("leaf >= 0").collect()]
    none = -np.inf if measure.largest else np.inf
    into = {
        b.leaf: [a for a in leaves if a.queries is not None and a.leaf != b.leaf and measure.may_hold(chosen[a.leaf], a.queries_radius, chosen[b.leaf], b.rows_radius, none if a.worst is None else a.worst)]
        for b in leaves
    }
    pairs = [(a.leaf, b.leaf, b.rows, sum(x.queries for x in into[b.leaf])) for b in leaves for a in into[b.leaf]]
    found = first
    if pairs:
        found = best(first.drop("rn").unionByName(met(spark.createDataFrame(pairs, "leaf long, into long, rows long, queries long"), placed)))
    lists = found.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("rn", "vec_id", "score"))).alias("near"))
    own = asked.join(lists, "rep").select("query_id", F.slice(F.filter("near", lambda x: x.vec_id != F.col("query_id")), 1, k).alias("near"))
    return own.select("query_id", F.posexplode("near").alias("pos", "x")).select("query_id", (F.col("pos") + 1).alias("rank"), "x.vec_id", "x.score")


def finite(vec: Column) -> Column:
    """Whether a vector is present and all its components are present and finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vec.isNotNull() & ~F.coalesce(F.exists(vec, bad), F.lit(True))


def exact_top_products(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """The k rows of largest integer inner product for each id divisible by ``every``.

    Components become ``floor(scale * x)``. Rows with a null id, or a vector that is null, empty or has null or
    non-finite components, take no part; a vector meets those of its own length. Of several vectors of an id the least counts,
    repeated rows count once; ties go to the smaller id. Components and products beyond a long are the greatest or least long.
    """
    v = F.col(vec_col)
    rows = table.where(F.col(id_col).isNotNull() & finite(v) & (F.size(v) > 0))
    quantised = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return block_search(rows.select(F.col(id_col).cast("long").alias("id"), quantised.alias("vec")), every, k, Products())


def nearest_by_projection(
    table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, every: int = 100, dims: int = DIMS, confidence: float = CONFIDENCE, ratio: float = RATIO
) -> DataFrame:
    """The k nearest rows found by Euclidean distance for each id divisible by ``every``.

    Rows with a null id, or a vector that is null, empty, zero or has null or non-finite components, take no part; a vector
    meets those of its own length. Of several vectors of an id the least counts, repeated rows count once; ties go to the smaller
    id. Every row is indexed.
    """
    v = F.col(vec_col)
    rows = table.where(F.col(id_col).isNotNull() & finite(v) & F.exists(v, lambda x: x != 0))
    doubles = F.transform(v, lambda x: x.cast("double"))
    return block_search(rows.select(F.col(id_col).cast("long").alias("id"), doubles.alias("vec")), every, k, Distances(dims, confidence, ratio))
