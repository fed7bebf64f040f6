"""Links between different texts whose sets of word shingles have a Jaccard similarity of s or more; none is lost.

Under one order of all shingles, two sets of similarity s or more share a shingle among the first n - ceil(s * n) + 1 of
each (prefix filter), so postings of those alone bring every such pair together. The order puts shingles of full slots
last: all shingles of all texts are counted in ``SLOTS`` hashed slots, a table of fixed size. Any order is right; this one
keeps shingles that many texts hold out of the prefixes. A pair whose sizes and places leave no room for the overlap is
passed over, as is one whose sketches differ too much, and the others are decided by their whole sets.

A posting is first compared by a star (one text with the others). What is still of different components after that is
linked in rounds: inside the task that holds a posting, sketches find for each component its nearest texts of others,
``NEAREST`` pairs a component at most and more in later rounds, whole sets decide these, and the components that they join leave the posting. Pairs that
were decided against aren't tried again; a posting in which no sketch leaves a pair open is done. So no group sends out all its
pairs. Postings travel as packed bytes, a row for each bucket of a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Slots that shingles are counted in, and the slots of a row of counts.
SLOTS = 1 << 18
BLOCK = 1 << 10
#: Postings' entries of a task, about, and of a batch that is dealt at once.
POSTING_ROWS = 400_000
BATCH_ROWS = 1 << 19
#: Up to so many keys (a few bytes each) are sent to all tasks instead of dealing texts or members for them.
FEW = 20_000
#: Of more keys a bitmap is sent: bits of it a key, and powers of two of its size at least and at most (4 MB).
KEY_BITS, LEAST_WIDTH, MOST_WIDTH = 16, 15, 25
#: Pairs that a component of a posting tries in the first round, and how many times as many in each round after it.
NEAREST, MORE = 4, 4
#: Words of 64 bits of a sketch that travels with the entries of postings, and texts whose such sketches are sent to all tasks.
BRIEF = 64
FEW_SKETCHES = 4_000
#: Texts of one hub that a task compares; a hub of more goes to several tasks.
HUB_ROWS = 2000
#: Rows with whole sets that Python holds at once.
SLICE = 64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MULTIPLY, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Digests(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 42)
        return h


_digests = _Digests()


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct shingles of a whole text, hashed from the digests of their words, ascending.

    A shorter text is one shingle, a text without words has none.
    """
    tokens = (text or "").encode("utf-8").translate(_LOWER).split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    own = np.fromiter(map(_digests.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    size = min(words, len(tokens))
    n = len(tokens) - size + 1
    h = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        h = h * _MULTIPLY + own[k : n + k]
        h ^= h >> np.uint64(31)
    h *= _MIX
    return np.unique(h ^ (h >> np.uint64(32)))


def prefix_size(n: int, similarity: float) -> int:
    return n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 1


def described(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(key, fp, size, sketch, block, counts): of each text (key, text) fingerprint, prefix size and sketch; of each task its counts by block of slots."""
    from .simhash import majority_bits

    names = ["key", "fp", "size", "sketch", "block", "counts"]

    def run(batches):
        slots = np.zeros(SLOTS, dtype=np.uint32)
        for b in batches:
            fps, sizes, sketches = [], [], []
            for text in b.column(1).to_pylist():
                s = shingles(text, words)
                slots += np.bincount((s & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS).astype(np.uint32) if len(s) > SLOTS // 8 else 0
                if len(s) <= SLOTS // 8:
                    np.add.at(slots, (s & np.uint64(SLOTS - 1)).astype(np.int64), 1)
                fps.append(majority_bits(s))
                sizes.append(prefix_size(len(s), similarity))
                sketches.append(sketch(s))
            none = pa.nulls(b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], names=names
            )
        rows = [(k, _narrow(slots[k * BLOCK : (k + 1) * BLOCK])) for k in range(SLOTS // BLOCK) if slots[k * BLOCK : (k + 1) * BLOCK].any()]
        none = pa.nulls(len(rows), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(rows), pa.binary()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=names)

    return texts.select("key", "text").mapInArrow(run, "key long, fp long, size long, sketch binary, block int, counts binary")


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold them; the length tells the type."""
    most = int(counts.max())
    return counts.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u8").tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype={1: "<u1", 2: "<u2", 8: "<u8"}[len(raw) // BLOCK]).astype(np.uint64)


def slot_counts(rows: DataFrame) -> np.ndarray:
    """How many shingles fell in each slot, over all tasks: SLOTS numbers, whatever the number of texts."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for block, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[block] = total.get(block, 0) + _wide(raw)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.astype("<u8").tobytes() for v in total.values()], pa.binary())], names=["block", "counts"])

    got = rows.where("block IS NOT NULL").select("block", "counts").repartition("block").mapInArrow(add, "block int, counts binary").toArrow()
    out = np.zeros(SLOTS, dtype=np.uint64)
    for block, raw in zip(got["block"].to_pylist(), got["counts"].to_pylist(), strict=True):
        out[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(raw, dtype="<u8")
    return out


#: An entry of a posting in packed form.
ENTRY = np.dtype([("shingle", "<u8"), ("key", "<i8"), ("n", "<u4"), ("pos", "<u4")])


def postings(texts: DataFrame, counts, words: int, similarity: float, tasks: int) -> DataFrame:
    """(bucket, entries): the entries of all prefixes, packed, dealt by the shingle's bucket. A text without words has the shingle 0."""
    buckets = 4 * tasks

    def run(batches):
        order, held, size = counts.value, [], 0

        def dealt():
            rows = np.concatenate(held)
            place = (rows["shingle"] % np.uint64(buckets)).astype(np.int64)
            at = np.argsort(place, kind="stable")
            rows, place = rows[at], place[at]
            starts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
            parts = [r.tobytes() for r in np.split(rows, starts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(place[starts], pa.int64()), pa.array(parts, pa.binary())], names=["bucket", "entries"])

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingles(text, words)
                n = len(s)
                s = s[np.argsort(order[(s & np.uint64(SLOTS - 1)).astype(np.int64)], kind="stable")] if n else np.zeros(1, dtype=np.uint64)
                rows = np.empty(prefix_size(n, similarity), dtype=ENTRY)
                rows["shingle"], rows["key"], rows["n"], rows["pos"] = s[: len(rows)], key, n, np.arange(len(rows))
                held.append(rows)
                size += len(rows)
                if size >= BATCH_ROWS:
                    yield dealt()
                    held, size = [], 0
        if held:
            yield dealt()

    return texts.select("key", "text").mapInArrow(run, "bucket long, entries binary").repartition(tasks, "bucket")


def _room(n1, p1, n2, p2, similarity: float):
    """Whether sets of these sizes that share the shingles at these places of the order can overlap enough."""
    top = np.minimum(p1, p2) + 1 + np.minimum(n1 - p1 - 1, n2 - p2 - 1)
    return (1 + similarity) * top >= similarity * (n1 + n2) - 1e-9


def shared(dealt: DataFrame) -> DataFrame:
    """(shingle, key, n, pos, one, two): the entries of postings that more than one text is in, and two hashes of the posting's set of texts."""

    def run(batches):
        held = [np.frombuffer(raw, dtype=ENTRY) for b in batches for raw in b.column(1).to_pylist()]
        if not held:
            return
        rows = np.concatenate(held)
        del held
        rows = rows[np.argsort(rows["shingle"], kind="stable")]
        same = rows["shingle"][1:] == rows["shingle"][:-1]
        rows = rows[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        if not len(rows):
            return
        starts = np.concatenate([[0], np.flatnonzero(np.diff(rows["shingle"])) + 1])
        sizes = np.diff(np.append(starts, len(rows)))
        key = np.ascontiguousarray(rows["key"]).view(np.uint64)
        sets = []
        for salt in (_MULTIPLY, _MIX):
            h = (key ^ (key >> np.uint64(31)) ^ salt) * salt
            sets.append(np.repeat(np.add.reduceat(h ^ (h >> np.uint64(29)), starts), sizes).view(np.int64))
        for k in range(0, len(rows), 1 << 16):
            part = rows[k : k + (1 << 16)]
            arrays = [pa.array(np.ascontiguousarray(part["shingle"]).view(np.int64)), pa.array(np.ascontiguousarray(part["key"])), pa.array(part["n"].astype(np.int64)), pa.array(part["pos"].astype(np.int64))]
            arrays += [pa.array(s[k : k + (1 << 16)]) for s in sets]
            yield pa.RecordBatch.from_arrays(arrays, names=["shingle", "key", "n", "pos", "one", "two"])

    return dealt.mapInArrow(run, "shingle long, key long, n long, pos long, one long, two long")


def different(entries: DataFrame) -> DataFrame:
    """(shingle, key, n, pos): of written postings that hold the same texts, as those of a passage do, the one of the least shingle.

    No pair is lost: each still meets in a posting, and places and sizes can rule out a similar pair at none of its shared shingles.
    """
    first = entries.groupBy("one", "two").agg(F.min("shingle").alias("shingle")).select("shingle")
    return entries.select("shingle", "key", "n", "pos").join(first, "shingle", "left_semi")


def _sorted_postings(batches, columns: int) -> tuple[list, list[int]] | None:
    """The columns of the batches by shingle and key, binary ones as lists, and where each posting begins and ends."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return None
    numbers = [np.concatenate([b.column(k).to_numpy() for b in rows]) for k in range(columns)]
    order = np.lexsort((numbers[1], numbers[0]))
    rest = [[x for b in rows for x in b.column(k).to_pylist()] for k in range(columns, rows[0].num_columns)]
    numbers, rest = [c[order] for c in numbers], [[c[i] for i in order] for c in rest]
    cuts = [0, *(np.flatnonzero(np.diff(numbers[0])) + 1).tolist(), len(numbers[0])]
    return [*numbers, *rest], cuts


def _pair_batch(found: list[np.ndarray]) -> pa.RecordBatch:
    both = np.unique(np.concatenate(found), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, k])) for k in (0, 1)], names=["a", "b"])


def star_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (a, b) of the postings (shingle, key, n, pos): the least key of a posting with the others."""

    def run(batches):
        read = _sorted_postings(batches, 4)
        if read is None:
            return
        (_, key, n, pos), cuts = read
        found = []
        for s, e in zip(cuts, cuts[1:], strict=False):
            y = np.arange(s + 1, e)
            y = y[_room(n[s], pos[s], n[y], pos[y], similarity)]
            if len(y):
                found.append(np.stack([np.full(len(y), key[s]), key[y]], axis=1))
        if found:
            yield _pair_batch(found)

    return members.select("shingle", "key", "n", "pos").mapInArrow(run, "a long, b long").distinct()


def open_postings(members: DataFrame) -> DataFrame:
    """(shingle, key, n, pos, root): the entries of postings (with a root) that hold more than one component."""

    def run(batches):
        read = _sorted_postings(batches, 5)
        if read is None:
            return
        columns, cuts = read
        starts = np.array(cuts[:-1])
        apart = np.minimum.reduceat(columns[4], starts) != np.maximum.reduceat(columns[4], starts)
        kept = np.repeat(apart, np.diff(cuts))
        yield pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in columns], names=["shingle", "key", "n", "pos", "root"])

    return members.select("shingle", "key", "n", "pos", "root").mapInArrow(run, "shingle long, key long, n long, pos long, root long")


def nearest_pairs(members: DataFrame, similarity: float, nearest: int = NEAREST) -> DataFrame:
    """(shingle, a, b): of postings (shingle, key, n, pos, root, sketch, gone) each component's nearest texts of others, by their sketches.

    Pairs that sizes, places or sketches rule out are none, nor are those with a text among the ``gone`` of the other. All
    such pairs of a posting are looked at, ``nearest`` a component at most go out.
    """

    def run(batches):
        read = _sorted_postings(batches, 5)
        if read is None:
            return
        (shingle, key, n, pos, root, raw, gone), cuts = read
        # each text's sketch once, in its own length and folded to half of it, for neighbours of the next size
        slot = {k: i for i, k in enumerate(dict.fromkeys(key.tolist()))}
        words, never = [None] * len(slot), {}
        for k, r, g in zip(key.tolist(), raw, gone, strict=True):
            if words[slot[k]] is None:
                words[slot[k]] = np.frombuffer(r, dtype=np.uint64, offset=8)
                if g:
                    never[k] = np.array(g, dtype=np.int64)
        at = np.array([slot[k] for k in key.tolist()])
        width = np.array([len(w) for w in words])
        rows = []
        for s, e in zip(cuts, cuts[1:], strict=False):
            best: dict[int, list] = {}
            for x in range(s, e - 1):
                y = np.arange(x + 1, e)
                y = y[(root[y] != root[x]) & _room(n[x], pos[x], n[y], pos[y], similarity)]
                if len(y) and int(key[x]) in never:
                    y = y[~np.isin(key[y], never[int(key[x])])]
                for w in np.unique(width[at[y]]).tolist():
                    own = y[width[at[y]] == w]
                    size = min(w, int(width[at[x]]))
                    other = _folded(np.stack([words[i] for i in at[own]]), size)
                    apart = np.bitwise_count(other ^ _folded(words[at[x]][None, :], size)).sum(axis=1, dtype=np.int64)
                    ok = (1 + similarity) * apart <= (1 - similarity) * (n[own] + n[x]) + 1e-9
                    own, apart = own[ok], apart[ok] / (n[own[ok]] + n[x])
                    # x's component meets its nearest; each other component meets x
                    order = np.argsort(apart, kind="stable")
                    for j in order[:nearest].tolist():
                        _keep(best, int(root[x]), float(apart[j]), int(key[x]), int(key[own[j]]), nearest)
                    roots, first = np.unique(root[own[order]], return_index=True)
                    for r, j in zip(roots.tolist(), order[first].tolist(), strict=True):
                        _keep(best, r, float(apart[j]), int(key[x]), int(key[own[j]]), nearest)
            rows += [(int(shingle[s]), a, b) for a, b in sorted({(a, b) for kept in best.values() for _, a, b in kept})]
            if len(rows) > BATCH_ROWS:
                yield _triples(rows)
                rows = []
        yield _triples(rows)

    return members.select("shingle", "key", "n", "pos", "root", "sketch", "gone").mapInArrow(run, "shingle long, a long, b long")


def _keep(best: dict[int, list], root: int, apart: float, a: int, b: int, most: int) -> None:
    """Note a pair of a component if it is among its nearest."""
    own = best.setdefault(root, [])
    if len(own) < most or apart < own[-1][0]:
        own.append((apart, a, b))
        own.sort()
        del own[most:]


def _triples(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["shingle", "a", "b"])


def few(keys: DataFrame, n: int | None = None, most: int | None = None) -> DataFrame:
    """Written rows, marked to be sent to all tasks where they are no more than ``most`` (FEW)."""
    return F.broadcast(keys) if (_count(keys) if n is None else n) <= (FEW if most is None else most) else keys


def _count(keys: DataFrame) -> int:
    """Rows of a table; of one that ``Scratch`` wrote they are known."""
    n = getattr(keys, "_twinlens_rows", None)
    return keys.count() if n is None else n


def may_be_key(rows: DataFrame, keys: DataFrame, key: str, n: int, out_col: str) -> DataFrame:
    """``rows`` with ``out_col``: whether the hashed ``key`` can be one of ``n`` written ``keys``; never false for one that is.

    Keys set bits of a bitmap, cut into rows of 2**15 bits, that is sent to all tasks. ``out_col`` with anything after it must be no column.
    """
    place, part, bits = (f"{out_col}_{x}" for x in ("place", "part", "bits"))
    size = F.lit(1 << min(MOST_WIDTH, max(LEAST_WIDTH, (KEY_BITS * n).bit_length())))
    placed = lambda df, *more: df.select(*more, F.pmod(F.col(key), size).alias(place)).withColumn(part, F.shiftright(place, 15))
    bitmap = placed(keys).groupBy(part).agg(F.bitmap_construct_agg(F.col(place) % (1 << 15)).alias(bits))
    held = placed(rows, *rows.columns).join(F.broadcast(bitmap), part, "left")
    byte = F.conv(F.hex(F.substr(bits, F.shiftright((F.col(place) % (1 << 15)).cast("int"), 3) + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.floor(byte / F.pow(F.lit(2), F.col(place) % 8)) % 2 == 1
    return held.select(*rows.columns, F.coalesce(is_set, F.lit(False)).alias(out_col))


def joined(rows: DataFrame, keys: DataFrame, key: str, how: str = "inner", n: int | None = None) -> DataFrame:
    """``rows`` joined with written ``keys`` by a hashed ``key`` (inner, left_semi or left_anti), where rows are large and keys aren't.

    Keys go to all tasks or, when they are many, a bitmap of them, so that only rows that can be met are dealt by key.
    """
    n = _count(keys) if n is None else n
    if n <= FEW:
        return rows.join(F.broadcast(keys), key, how)
    may = "may"
    while any(c.lower().startswith(may) for c in rows.columns):
        may += "_"
    held = may_be_key(rows, keys, key, n, may)
    met = held.where(F.col(may)).drop(may).join(keys, key, how)
    return met if how != "left_anti" else met.unionByName(held.where(~F.col(may)).drop(may))


def brief(sketches: DataFrame) -> DataFrame:
    """(key, sketch) with sketches folded once, and to BRIEF words at most, to travel with each entry of a posting.

    About a bit a shingle still tells most sets apart that aren't similar; what it leaves is held against whole sketches.
    """

    def run(batches):
        for b in batches:
            own = [np.frombuffer(r, dtype=np.uint64, offset=8)[None, :] for r in b.column(1).to_pylist()]
            out = [r[:8] + _folded(s, min(BRIEF, max(1, s.shape[1] // 2))).tobytes() for r, s in zip(b.column(1).to_pylist(), own, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["key", "sketch"])

    return sketches.mapInArrow(run, "key long, sketch binary")


def sketch(own: np.ndarray) -> bytes:
    """The size of a set and, for each of about two bits an element, whether it has an odd number of elements.

    Bits of two sketches that differ are at most the elements that only one set has, so too many of them rule a pair out.
    """
    bits = 1 << max(6, int(2 * len(own)).bit_length())
    counts = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return len(own).to_bytes(8, "little") + np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(sketches: np.ndarray, size: int) -> np.ndarray:
    """Sketches, a row each, folded to fewer words: a bit of the result is the parity of all bits that fall on it."""
    while sketches.shape[1] > size:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def may_be_similar(a: bytes, b: bytes, similarity: float) -> bool:
    """Whether sets of these sketches can be similar enough; never false for sets that are."""
    total = int.from_bytes(a[:8], "little") + int.from_bytes(b[:8], "little")
    x, y = (np.frombuffer(s, dtype=np.uint64, offset=8)[None, :] for s in (a, b))
    size = min(x.shape[1], y.shape[1])
    return (1 + similarity) * int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum()) <= (1 - similarity) * total + 1e-9


def similar(a: bytes, b: bytes, similarity: float) -> bool:
    """Whether two sets, as the bytes of their ascending hashes, are similar enough; two empty ones are."""
    x, y = (np.frombuffer(s, dtype=np.uint64) for s in (a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return (1 + similarity) * both >= similarity * (len(x) + len(y)) - 1e-9 and (len(x) > 0) == (len(y) > 0)


def _passed(pairs: DataFrame, values: DataFrame, made, test, scratch: Scratch) -> DataFrame:
    """The written pairs (a, b) whose bytes, which ``made`` makes of the values (key, value), pass a test.

    Each ``b`` travels to its hub ``a``; a hub of many goes to several tasks, so that none of them gets more than some.
    """
    ways = pairs.groupBy("a").agg(F.floor((F.count("*") - 1) / HUB_ROWS).alias("last"))
    hubs = ways.select(F.col("a").alias("key"), "a", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("way"))
    ends = pairs.join(ways, "a").select(F.col("b").alias("key"), "a", F.pmod(F.xxhash64("b"), F.col("last") + 1).alias("way"))
    wanted = scratch.write(hubs.union(ends))
    n = scratch.rows(wanted)

    def sets(batches):
        last, own = None, b""
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b, raw = whole.slice(at, SLICE), []
                for key, value in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                    if key != last:  # a text's rows follow one another
                        last, own = key, made(value)
                    raw.append(own)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(raw, pa.binary())], names=["key", "a", "way", "s"])

    def compare(batches):
        place, hub = None, None
        for b in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            one, other = [], []
            for key, a, way, raw in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if key == a:
                    place, hub = (a, way), raw
                elif place == (a, way) and test(hub, raw):
                    one.append(a)
                    other.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(other, pa.int64())], names=["a", "b"])

    tasks = max(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // (2 * HUB_ROWS))
    dealt = joined(values.toDF("key", "value"), wanted, "key", n=n).select("key", "a", "way", "value")
    if made is not None:
        dealt = dealt.mapInArrow(sets, "key long, a long, way long, value binary")
    dealt = dealt.repartition(tasks, "a", "way").sortWithinPartitions("a", "way", F.col("key") != F.col("a"))
    out = scratch.write(dealt.mapInArrow(compare, "a long, b long"))
    scratch.drop(wanted)
    return out


def verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float, scratch: Scratch) -> DataFrame:
    """The links (src, dst) among written pairs (a, b) whose whole sets are similar enough; two texts without words are."""
    links = _passed(pairs, texts, lambda t: shingles(t, words).tobytes(), lambda a, b: similar(a, b, similarity), scratch)
    return links.select(F.col("b").alias("src"), F.col("a").alias("dst"))


def similar_texts(texts: DataFrame, words: int, similarity: float, scratch: Scratch, max_bits: int, posting_rows: int) -> DataFrame:
    """(node, root) over the keys of distinct texts (key, text), for each text that is similar to another, directly or through others.

    Texts that the fingerprint index brings together are verified first, with the stars of the prefixes; then the prefixes
    complete the links, since texts of similarity s may differ in more bits than an index over bytes can guarantee to find.
    """
    from .simhash import components, fingerprint_links

    spark = texts.sparkSession
    rows = scratch.write(described(texts, words, similarity))
    marked = rows.where("key IS NOT NULL").select("key", "fp", "size", "sketch")
    entries = marked.groupBy("fp").agg(F.min("key").alias("least"))
    forest = fingerprint_links(entries, max_bits, posting_rows, scratch)
    least = lambda name: entries.select(F.col("fp").alias(name), F.col("least").alias(f"{name}_key"))
    across = forest.join(least("dst"), "dst").join(least("src"), "src").select(F.col("dst_key").alias("a"), F.col("src_key").alias("b"))
    inside = marked.join(entries, "fp").where("key <> least").select(F.col("least").alias("a"), F.col("key").alias("b"))
    counts = spark.sparkContext.broadcast(slot_counts(rows))
    total = marked.agg(F.sum("size")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // POSTING_ROWS)
    met = scratch.write(shared(postings(texts, counts, words, similarity, tasks)))
    counts.destroy()
    members = scratch.write(different(met))
    scratch.drop(met)
    scratch.tidy()
    near = scratch.write(across.union(inside).union(star_pairs(members.repartition(tasks, "shingle"), similarity)).distinct())

    def linked(pairs: DataFrame) -> DataFrame:
        passed = _passed(pairs, marked.select("key", "sketch"), None, lambda a, b: may_be_similar(a, b, similarity), scratch)
        out = verified(passed, texts, words, similarity, scratch)
        scratch.drop(passed)
        return out

    links = linked(near)
    roots = components(links, scratch)
    tried = scratch.write(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    scratch.drop(near)
    scratch.tidy()
    nearest = NEAREST
    while True:
        placed = members.join(few(roots.withColumnRenamed("node", "key")), "key", "left").withColumn("root", F.coalesce("root", "key"))
        apart = scratch.write(open_postings(placed.repartition(tasks, "shingle")))
        keys = scratch.write(apart.select("key").distinct())
        own = brief(joined(marked.select("key", "sketch"), keys, "key", "left_semi"))
        gone = tried.join(few(keys.select(F.col("key").alias("a")), scratch.rows(keys)), "a", "left_semi").groupBy(F.col("a").alias("key")).agg(F.collect_set("b").alias("gone"))
        own = scratch.write(own.join(gone, "key", "left"))
        left = scratch.write(nearest_pairs(apart.join(few(own, most=FEW_SKETCHES), "key").repartition(tasks, "shingle"), similarity, nearest))
        pairs = scratch.write(left.select("a", "b").distinct())
        scratch.drop(keys, own)
        scratch.tidy()
        if not scratch.rows(pairs):
            scratch.drop(rows, members, links, tried, apart, left, pairs)
            return roots
        more = linked(pairs)
        before, tried = tried, scratch.write(tried.union(pairs))
        scratch.drop(before, pairs)
        if not more.isEmpty():
            before, links = links, scratch.write(links.union(more))
            scratch.drop(before)
            roots = components(links, scratch)
        # what the first rounds leave is mostly dissimilar: it is tried in few more rounds
        nearest *= MORE
        # a posting in which nothing was left open stays so
        before, members = members, scratch.write(apart.drop("root").join(left.select("shingle").distinct(), "shingle", "left_semi"))
        scratch.drop(before, apart, left)
        scratch.tidy()
