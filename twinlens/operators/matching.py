"""One-to-one linkage of two sides' diagnostics: greedy, nearest first, in the sorted order of the baseline.

Only rules of one component can match, so rows are dealt once by (path, component) and sorted natively; an Arrow function
holds one group at a time and takes for each baseline row the unused candidate of least (line distance, column
distance, confidence, order). No pairs are shuffled; matches and residuals leave the same pass with their whole rows. Small
groups are compared as a matrix, large ones through an index of the free candidates by position.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import fingerprint
from ..functions.values import NO_POSITION, TOOL_DEBUG
from .mappings import Mappings, end_key, rule_key

DIAGNOSTIC = "tool string, path string, code string, severity string, message string, start_line long, start_column long, end_line long, end_column long, tie long"
FIELDS = [x.split()[0] for x in DIAGNOSTIC.split(", ")]
#: A tool's proposal, where a report has one.
FIX = "struct<start:bigint,end:bigint,replacement:string>"


def with_identity(diagnostics: DataFrame, mappings: Mappings) -> DataFrame:
    """Diagnostics with canonical_code and fingerprint."""
    return with_fingerprint(diagnostics.withColumn("canonical_code", mappings.canonical(F.col("code"))))


def with_fingerprint(d: DataFrame) -> DataFrame:
    span = F.struct("start_line", "start_column", "end_line", "end_column")
    return d.withColumn("fingerprint", fingerprint(F.col("tool"), F.col("path"), F.col("canonical_code"), F.col("severity"), F.col("message"), span))


def sort_key() -> Column:
    """The total order of a file's diagnostics; without a position a row is last, without a rule first."""
    far = F.lit(NO_POSITION)
    return F.struct(
        F.coalesce("start_line", far).alias("k_line"), F.coalesce("start_column", far).alias("k_column"), F.col("code").alias("k_code"), F.col("message").alias("k_message"),
        F.col("fingerprint").alias("k_fingerprint"), F.col("tie").alias("k_tie"),
    )


#: Components of rows without a rule begin so, and a file's are so many.
ALONE, ALONE_GROUPS = "\0", 64
#: Distances are packed into one number each side of this many bits; larger positions are compared in full.
PACKED_BITS = 30
TAKEN = np.iinfo(np.int64).max
#: Pairs of a group that are laid out at once; larger groups are compared row by row.
MATRIX = 1 << 22


def pick(b_line: np.ndarray, b_col: np.ndarray, c_line: np.ndarray, c_col: np.ndarray, confidence: np.ndarray | None) -> list[tuple[int, int]]:
    """For each baseline row in order its candidate's place, or -1, and the confidence.

    ``confidence`` (rows by candidates: 0, 1, or -1 for no match) is None where all pairs match exactly, or given by kinds as in ``pick_indexed``.
    """
    nb, nc = len(b_line), len(c_line)
    if not nb or not nc:
        return [(-1, 0)] * nb
    if isinstance(confidence, tuple):
        if nb * nc > MATRIX:
            return pick_indexed(b_line, b_col, c_line, c_col, confidence)
        confidence = confidence[2][confidence[0][:, None], confidence[1][None, :]]
    small = max(map(int, (b_line.max(), b_col.max(), c_line.max(), c_col.max()))) < (1 << PACKED_BITS) - 1
    out = []
    if small and nb * nc <= MATRIX:
        far = (1 << PACKED_BITS) - 1
        none = (b_line < 0)[:, None] != (c_line < 0)[None, :]
        both = (b_line < 0)[:, None] & (c_line < 0)[None, :]
        dl, dc = np.abs(b_line[:, None] - c_line[None, :]), np.abs(b_col[:, None] - c_col[None, :])
        dl, dc = np.where(both, 0, np.where(none, far, dl)), np.where(both, 0, np.where(none, far, dc))
        keys = (dl << (PACKED_BITS + 1)) | (dc << 1)
        if confidence is not None:
            keys = np.where(confidence < 0, TAKEN, keys | confidence)
        for i in range(nb):
            row = keys[i]
            j = int(row.argmin())
            if row[j] == TAKEN:
                out.append((-1, 0))
            else:
                out.append((j, int(row[j] & 1)))
                keys[i + 1 :, j] = TAKEN
        return out
    return pick_indexed(b_line, b_col, c_line, c_col, confidence)


class Free:
    """The unused candidates of one rule by position: nearest first by line, then column, then order."""

    def __init__(self, line: np.ndarray, col: np.ndarray, place: np.ndarray):
        self.none = [int(p) for p, x in zip(place, line, strict=True) if x < 0][::-1]
        at = np.flatnonzero(line >= 0)
        at = at[np.lexsort((place[at], col[at], line[at]))]
        self.line, self.col, self.place = line[at].tolist(), col[at].tolist(), place[at].tolist()
        self.lines = sorted(set(self.line))
        self.starts = [bisect.bisect_left(self.line, x) for x in self.lines] + [len(self.line)]
        #: Next free entry at or after, and at or before, an entry; the last and first are ends that are never taken.
        self.after, self.before = list(range(len(self.line) + 1)), list(range(len(self.line) + 1))
        #: The same over lines that have a free entry.
        self.line_after, self.line_before = list(range(len(self.lines) + 1)), list(range(len(self.lines) + 1))
        self.left = [e - s for s, e in zip(self.starts, self.starts[1:], strict=False)]
        #: Positioned entries by order, for rows without a position.
        self.by_order, self.first = sorted(range(len(self.place)), key=self.place.__getitem__), 0
        self.gone = [False] * len(self.place)

    @staticmethod
    def _end(up: list[int], i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def _in_line(self, n: int, col: int) -> tuple[int, int, int]:
        """(column distance, order, entry) of the nearest free entry of a line that has one."""
        start, stop = self.starts[n], self.starts[n + 1]
        at = bisect.bisect_left(self.col, col, start, stop)
        found = []
        right = self._end(self.after, at)
        if right < stop:
            found.append((self.col[right] - col, self.place[right], right))
        left = self._end(self.before, at) - 1  # shifted by one: 0 stands before all
        if left >= start:
            run = bisect.bisect_left(self.col, self.col[left], start, stop)
            first = self._end(self.after, run)
            found.append((col - self.col[first], self.place[first], first))
        return min(found)

    def nearest(self, line: int, col: int) -> tuple[int, int, int, int] | None:
        """(line distance, column distance, order, entry) of the best free entry; the entry is -1 for one without a position."""
        if line < 0:
            if self.none:
                return 0, 0, self.none[-1], -1
            while self.first < len(self.by_order) and self.gone[self.by_order[self.first]]:
                self.first += 1
            if self.first == len(self.by_order):
                return None
            e = self.by_order[self.first]
            return NO_POSITION, NO_POSITION, self.place[e], e
        at = bisect.bisect_left(self.lines, line)
        best = None
        for n in {self._end(self.line_after, at), self._end(self.line_before, at) - 1}:
            if 0 <= n < len(self.lines):
                own = (abs(self.lines[n] - line), *self._in_line(n, col))
                best = own if best is None or own < best else best
        if best is None and self.none:
            return NO_POSITION, NO_POSITION, self.none[-1], -1
        return best

    def take(self, entry: int) -> None:
        if entry < 0:
            self.none.pop()
            return
        self.gone[entry] = True
        self.after[entry], self.before[entry + 1] = entry + 1, entry
        n = bisect.bisect_right(self.starts, entry) - 1
        self.left[n] -= 1
        if not self.left[n]:
            self.line_after[n], self.line_before[n + 1] = n + 1, n


def pick_indexed(b_line: np.ndarray, b_col: np.ndarray, c_line: np.ndarray, c_col: np.ndarray, confidence: np.ndarray | tuple | None) -> list[tuple[int, int]]:
    """As ``pick``, through an index for each kind of candidate; time grows with the rows, not with the pairs.

    ``confidence`` is None, a matrix, or (kinds of the baseline rows, kinds of the candidates, a matrix over the kinds).
    """
    if confidence is None:
        kinds_b, kinds_c, table = np.zeros(len(b_line), dtype=np.int64), np.zeros(len(c_line), dtype=np.int64), np.zeros((1, 1), dtype=np.int64)
    elif isinstance(confidence, tuple):
        kinds_b, kinds_c, table = confidence
    else:
        columns, kinds_c = np.unique(confidence, axis=1, return_inverse=True)
        table, kinds_b = np.unique(columns, axis=0, return_inverse=True)
    order = np.arange(len(c_line))
    free = [Free(c_line[kinds_c == k], c_col[kinds_c == k], order[kinds_c == k]) for k in range(table.shape[1])]
    out = []
    for line, col, kind in zip(b_line.tolist(), b_col.tolist(), kinds_b.tolist(), strict=True):
        best = None
        for k, conf in enumerate(table[kind].tolist()):
            found = free[k].nearest(line, col) if conf >= 0 else None
            if found:
                own = (found[0], found[1], conf, found[2], k, found[3])
                best = own if best is None or own < best else best
        if best is None:
            out.append((-1, 0))
        else:
            free[best[4]].take(best[5])
            out.append((best[3], best[2]))
    return out


def match_kind(b: Column, c: Column, confidence: Column) -> Column:
    """Approximate pairs are not looked into; others by what differs first: position, severity, message."""
    same = lambda *names: F.struct(*(b[n] for n in names)).eqNullSafe(F.struct(*(c[n] for n in names)))
    return (
        F.when(confidence == 1, "approximate_rule_match")
        .when(~same("start_line", "start_column", "end_line", "end_column"), "range_changed")
        .when(~same("severity"), "severity_changed")
        .when(~same("message"), "message_changed")
        .otherwise("exact_match")
    )


def linked(diagnostics: DataFrame, mappings: Mappings, baseline_tool: str, candidate_tool: str) -> DataFrame:
    """Matches and residuals of ``diagnostics`` (a ``side`` column and the DIAGNOSTIC columns), one row each.

    Columns: bucket (match, baseline, candidate), path, kind, confidence (0 exact, 1 approximate), b, c (structs or null). Rows
    without a rule never match. A column ``fix`` goes along where there is one; other columns are dropped. An empty table gives no rows.
    """
    fix = F.col("fix").cast(FIX) if "fix" in diagnostics.columns else F.lit(None).cast(FIX)
    d = diagnostics.select("side", *FIELDS, fix.alias("fix")).withColumn("canonical_code", mappings.canonical(F.col("code")))
    # rows without a rule go through the same pass, in small groups in which nothing is matched
    alone = F.concat(F.lit(ALONE), F.pmod(F.coalesce("tie", F.lit(0)), F.lit(ALONE_GROUPS)).cast("string"))
    d = d.withColumn("component", F.coalesce(F.when(F.col("code").isNotNull(), mappings.component(F.col("tool"), F.col("code"), F.col("canonical_code"))), alone))
    # the exchange keeps what is computed before it from being computed again in the expressions after it
    dealt = with_fingerprint(d.repartition("path", "component"))
    row = F.struct("key", *FIELDS, "fix", "canonical_code", "fingerprint", end_key(F.col("tool"), F.col("code")).alias("end"))
    known = dealt.withColumn("key", sort_key()).sortWithinPartitions("path", "component", "side", "key").select("path", "component", "side", row.alias("row"))
    item = known.schema["row"].dataType
    schema = T.StructType([T.StructField("bucket", T.StringType()), T.StructField("path", T.StringType()), T.StructField("conf", T.IntegerType()), T.StructField("b", item), T.StructField("c", item)])
    explicit = mappings.explicit()

    def confidences(bs: pa.Array, cs: pa.Array) -> tuple | None:
        """Configured first, then equal names; without configured mappings all rules of a component are equal."""
        if not explicit:
            return None
        kinds, tables = [], []
        for x in (bs, cs):
            pairs = pa.compute.binary_join_element_wise(x.field("end"), x.field("canonical_code"), "\0").dictionary_encode()
            kinds.append(pairs.indices.to_numpy())
            tables.append([p.split("\0") for p in pairs.dictionary.to_pylist()])
        table = [[int(explicit.get(f"{e}|{f}", 0 if own == other else -1)) for f, other in tables[1]] for e, own in tables[0]]
        return (*kinds, np.array(table, dtype=np.int64))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finish(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            rows = table.column("row").combine_chunks() if table.num_rows else None
            rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows
            cand = np.array(table.column("side").to_pylist()) == "candidate"
            line = rows.field("start_line").fill_null(-1).to_numpy(zero_copy_only=False)
            col = rows.field("start_column").fill_null(1).to_numpy(zero_copy_only=False)
            b_at, c_at, conf = [], [], []
            component = table.column("component")
            for start, stop in zip(*bounds(table), strict=True):
                split = start + int((~cand[start:stop]).sum())
                got = [(-1, 0)] * (split - start) if component[start].as_py().startswith(ALONE) else pick(line[start:split], col[start:split], line[split:stop], col[split:stop], confidences(rows.slice(start, split - start), rows.slice(split, stop - split)) if start < split < stop else None)
                used = set()
                for i, (j, k) in enumerate(got):
                    b_at.append(start + i)
                    c_at.append(split + j if j >= 0 else None)
                    conf.append(k if j >= 0 else None)
                    used.add(j)
                left = [split + j for j in range(stop - split) if j not in used]
                b_at += [None] * len(left)
                c_at += left
                conf += [None] * len(left)
            bucket = ["candidate" if b is None else "baseline" if c is None else "match" for b, c in zip(b_at, c_at, strict=True)]
            own = table.column("path").combine_chunks().take(pa.array([c if b is None else b for b, c in zip(b_at, c_at, strict=True)], pa.int64()))
            own = own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket, pa.string()), own, pa.array(conf, pa.int32()), rows.take(pa.array(b_at, pa.int64())), rows.take(pa.array(c_at, pa.int64()))], names=["bucket", "path", "conf", "b", "c"]
            )

        def bounds(table: pa.Table) -> tuple[list[int], list[int]]:
            key = [table.column(n).combine_chunks().dictionary_encode() for n in ("path", "component")]
            key = [k.combine_chunks() if isinstance(k, pa.ChunkedArray) else k for k in key]
            a, b = (k.indices.to_numpy(zero_copy_only=False) for k in key)
            cuts = (np.flatnonzero((np.diff(a) != 0) | (np.diff(b) != 0)) + 1).tolist()
            return [0, *cuts], [*cuts, table.num_rows]

        def key(b: pa.RecordBatch, i: int) -> tuple:
            return b.column(0)[i].as_py(), b.column(1)[i].as_py()

        for b in batches:
            if not b.num_rows:
                continue
            # rows are sorted: the last group of the batch begins at its first row of the last row's key
            last = key(b, b.num_rows - 1)
            same = pa.compute.and_(pa.compute.equal(b.column(0), last[0]), pa.compute.equal(b.column(1), last[1]))
            start = pa.compute.index(same, True).as_py()
            if start or (held and key(held[0], 0) != last):
                if done := [*held, *([b.slice(0, start)] if start else [])]:
                    yield finish(pa.Table.from_batches(done))
                held = []
            held.append(b.slice(start))
        if held:
            yield finish(pa.Table.from_batches(held))

    rows = known.mapInArrow(walk, schema)
    kind = F.when(F.col("bucket") == "match", match_kind(F.col("b"), F.col("c"), F.col("conf")))
    known_rule = F.when(
        F.col("bucket") == "baseline", mappings.endpoint_confidence(F.lit(baseline_tool), F.col("b.code"), F.lit(candidate_tool), F.col("b.canonical_code")).isNotNull() & F.col("b.code").isNotNull()
    ).when(F.col("bucket") == "candidate", mappings.endpoint_confidence(F.lit(candidate_tool), F.col("c.code"), F.lit(baseline_tool), F.col("c.canonical_code")).isNotNull() & F.col("c.code").isNotNull())
    bucket = F.when(F.col("bucket") == "match", "match").when(known_rule, F.concat("bucket", F.lit("_only"))).otherwise(F.concat(F.lit("unmapped_"), F.col("bucket")))
    return rows.select(bucket.alias("bucket"), "path", kind.alias("kind"), F.col("conf").alias("confidence"), "b", "c")


def local_links(baseline: list[dict], candidate: list[dict], mappings: Mappings, baseline_tool: str, candidate_tool: str) -> list[dict]:
    """``linked`` for a few diagnostics on the driver: dicts of bucket, kind, confidence, b, c, in the order of a report."""
    sides = [sorted((local_identity(d, mappings) for d in side), key=local_key) for side in (baseline, candidate)]
    explicit, out = mappings.explicit(), []
    for path in sorted({d["path"] for side in sides for d in side}):
        bs, cs = ([d for d in side if d["path"] == path and d["code"] is not None] for side in sides)

        def confidence(b: dict, c: dict) -> int:
            listed = explicit.get(f"{b['tool']}:{rule_key(b['code'])}|{c['tool']}:{rule_key(c['code'])}")
            return int(listed) if listed is not None else 0 if b["canonical_code"] == c["canonical_code"] else -1

        table = np.array([[confidence(b, c) for c in cs] for b in bs], dtype=np.int64).reshape(len(bs), len(cs))
        place = [np.array([-1 if d["start_line"] is None else d["start_line"] for d in side], dtype=np.int64) for side in (bs, cs)]
        column = [np.array([1 if d["start_column"] is None else d["start_column"] for d in side], dtype=np.int64) for side in (bs, cs)]
        used = set()
        for b, (j, conf) in zip(bs, pick(place[0], column[0], place[1], column[1], table), strict=True):
            if j >= 0:
                used.add(id(cs[j]))
                used.add(id(b))
                out.append({"bucket": "match", "kind": local_kind(b, cs[j], conf), "confidence": conf, "b": b, "c": cs[j]})
        for side, own, other, mine in (("baseline", baseline_tool, candidate_tool, sides[0]), ("candidate", candidate_tool, baseline_tool, sides[1])):
            for d in mine:
                if d["path"] == path and id(d) not in used:
                    known = d["code"] is not None and mappings.knows(own, d["code"], other)
                    out.append({"bucket": f"{side}_only" if known else f"unmapped_{side}", "kind": None, "confidence": None, "b": d if side == "baseline" else None, "c": d if side == "candidate" else None})
    return out


def local_identity(d: dict, mappings: Mappings) -> dict:
    """A diagnostic with its canonical rule and fingerprint."""
    own = dict.fromkeys(FIELDS) | d
    own["canonical_code"] = None if own["code"] is None else mappings.canonical_name(own["code"])
    some = lambda x: "None" if x is None else f"Some({x})"
    quoted = None if own["canonical_code"] is None else '"' + own["canonical_code"].replace("\\", "\\\\").replace('"', '\\"') + '"'
    span = None if own["start_line"] is None else f"Span {{ start_line: {own['start_line']}, start_column: {own['start_column']}, end_line: {some(own['end_line'])}, end_column: {some(own['end_column'])} }}"
    parts = [TOOL_DEBUG[own["tool"]], own["path"], some(quoted), own["severity"].capitalize(), own["message"], some(span)]
    own["fingerprint"] = hashlib.sha256("\0".join(parts).encode()).hexdigest()
    return own


def local_key(d: dict) -> tuple:
    far = lambda x: NO_POSITION if x is None else x
    return d["path"], far(d["start_line"]), far(d["start_column"]), d["code"] is not None, d["code"] or "", d["message"], d["fingerprint"], d["tie"] or 0


def local_kind(b: dict, c: dict, confidence: int) -> str:
    if confidence == 1:
        return "approximate_rule_match"
    for kind, names in (("range_changed", ("start_line", "start_column", "end_line", "end_column")), ("severity_changed", ("severity",)), ("message_changed", ("message",))):
        if any(b[n] != c[n] for n in names):
            return kind
    return "exact_match"
