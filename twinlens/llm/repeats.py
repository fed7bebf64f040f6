"""Removal of repeated substrings: bytes that a string of ``length`` bytes covers which also starts in a document of a smaller id.

Every such string (a window) has an anchor, the least hashed gram among its grams, so equal windows have equal anchors at equal
places; neighbouring windows mostly share one, and about a seventeenth of all positions are anchors of 50-byte windows.
Documents are packed into blocks. First the blocks' anchor hashes meet, by hash, to find those of several blocks. Then the
stretches of text around such anchors meet by their gram: each task sorts the suffixes at its windows (``suffixes``), whose
common extensions of ``length`` bytes make classes of equal windows, and tells each block which windows of its stretches have
an earlier document. A block sends a stretch once, however often it holds it; windows of anchors that very many places hold are
dealt by themselves, by their own hash. Texts stay where they are: a bucketed table of blocks is joined with what comes back.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, limit_arrow_batches
from .suffixes import Prefixes, classes, mixed

LENGTH = 50
#: Text of a block; a longer text is a block of its own. Bytes whose hashes are made at once.
BLOCK, CHUNK = 4 << 20, 1 << 18
#: Bytes of text behind a task of the tables of blocks, of hashes and of stretches.
TASK = 32 << 20
#: Anchors that so many places hold have their windows dealt one by one.
HOT = 20_000
#: Stretches whose suffixes a task sorts at once, but for those of one gram.
SLICE = 1 << 14
RESULT = "doc_id long, n_bytes long, kept binary, spans array<struct<start:bigint,length:bigint>>"


def gram_size(length: int) -> int:
    """Bytes of a gram: windows have 35 grams, or two thirds of a shorter length."""
    return max(length - 34, (length + 2) // 3)


def _packed(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def _unpacked(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def blocks_of(docs: DataFrame, size: int) -> DataFrame:
    """(block, ids, sizes, data): documents (doc_id, text) in blocks, their bytes one after the other and compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 36
        ids, texts, held = [], [], 0

        def block():
            nonlocal number, ids, texts, held
            out = pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([list(map(len, texts))], pa.list_(pa.int64())), pa.array([_packed(b"".join(texts))], pa.binary())],
                names=["block", "ids", "sizes", "data"],
            )
            number, ids, texts, held = number + 1, [], [], 0
            return out

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = text or b""
                if ids and held + len(raw) > size:
                    yield block()
                ids.append(doc)
                texts.append(raw)
                held += len(raw)
        if ids:
            yield block()

    return docs.mapInArrow(run, "block long, ids array<long>, sizes array<long>, data binary")


class Block:
    """A block's text and the anchors of all its windows: runs of windows that share one."""

    def __init__(self, ids: list, sizes: list[int], data: bytes, length: int):
        self.raw = _unpacked(data)
        self.text = np.frombuffer(self.raw, dtype=np.uint8)
        self.ids, self.length, self.gram = ids, length, gram_size(length)
        self.ends = np.cumsum(np.array(sizes, dtype=np.int64))
        self.starts = self.ends - sizes
        #: Documents without an id take no part.
        self.named = np.array([i is not None for i in ids], dtype=bool)
        self.doc_ids = np.array([i if i is not None else 0 for i in ids], dtype=np.int64)
        found = [self._anchors(*c) for c in self._chunks()]
        none = np.zeros(0, dtype=np.int64)
        #: Of each run: its gram's hash, its first window, the windows, the anchor's place, its document.
        self.hash, self.first, self.count, self.place, self.doc = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (none.astype(np.uint64), none, none, none, none)

    def _chunks(self) -> Iterator[tuple[int, int]]:
        """Pieces of the text, each after the first overlapping the one before by a window less a byte."""
        for start in range(0, max(1, len(self.text) - self.length + 1), CHUNK):
            yield start, min(len(self.text), start + CHUNK + self.length - 1)

    def _anchors(self, start: int, stop: int) -> tuple[np.ndarray, ...]:
        n = stop - start - self.length + 1
        if n <= 0:
            none = np.zeros(0, dtype=np.int64)
            return none.astype(np.uint64), none, none, none, none
        grams = mixed(Prefixes(self.text[start:stop]).windows(self.gram))
        bits = np.uint64(CHUNK.bit_length() + 1)
        least = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)  # the first of equal ones
        wanted, size = self.length - self.gram + 1, 1
        while 2 * size <= wanted:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        least = np.minimum(least[:n], least[wanted - size : wanted - size + n])
        # windows that lie in one named document
        doc = np.searchsorted(self.ends, np.arange(start, start + n, 1), side="right") if len(self.ends) > 1 else np.zeros(n, dtype=np.int64)
        doc = np.minimum(doc, len(self.ends) - 1)
        fits = (np.arange(start, start + n) + self.length <= self.ends[doc]) & self.named[doc]
        new = np.concatenate([[True], (least[1:] != least[:-1]) | (fits[1:] != fits[:-1]) | (doc[1:] != doc[:-1])])
        first = np.flatnonzero(new)
        count = np.diff(np.concatenate([first, [n]]))
        keep = fits[first]
        first, count = first[keep], count[keep]
        place = (least[first] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
        return grams[place], first + start, count, place + start, doc[first]

    def grams_of(self, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(bucket, hashes, places that hold each): the distinct anchors in ascending order, by bucket."""
        self.distinct, self.which, counts = np.unique(self.hash, return_inverse=True, return_counts=True)
        self.bucket = (self.distinct % np.uint64(buckets)).astype(np.int64)
        for b in np.unique(self.bucket).tolist():
            own = self.bucket == b
            yield b, self.distinct[own], np.minimum(counts[own], 65535).astype("<u2")

    def mark_shared(self, replies: dict[int, bytes], buckets: int) -> None:
        """What the hashes' tasks said: which anchors several blocks hold, and which very many places."""
        parts = list(self.grams_of(buckets))
        shared, hot = np.zeros(len(self.distinct), dtype=bool), np.zeros(len(self.distinct), dtype=bool)
        for b, own, _ in parts:
            if b in replies:
                bits = np.unpackbits(np.frombuffer(replies[b], dtype=np.uint8))
                at = np.flatnonzero(self.bucket == b)
                shared[at], hot[at] = bits[: len(own)], bits[len(own) : 2 * len(own)]
        low, high = np.full(len(self.distinct), np.iinfo(np.int64).max), np.full(len(self.distinct), np.iinfo(np.int64).min)
        np.minimum.at(low, self.which, self.doc_ids[self.doc])
        np.maximum.at(high, self.which, self.doc_ids[self.doc])
        shared |= low < high
        keep = shared[self.which]
        alone = keep & hot[self.which]
        #: Stretches: first byte, windows, anchor within, document; a hot anchor's windows are stretches of one window.
        n = self.count[alone]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first = np.repeat(self.first[alone], n) + step
        keep &= ~alone
        self.s_first = np.concatenate([self.first[keep], first])
        self.s_count = np.concatenate([self.count[keep], np.ones(len(first), dtype=np.int64)])
        self.s_anchor = np.concatenate([self.place[keep] - self.first[keep], np.repeat(self.place[alone], n) - first])
        self.s_doc = np.concatenate([self.doc_ids[self.doc[keep]], np.repeat(self.doc_ids[self.doc[alone]], n)])
        self.s_key = np.concatenate([self.hash[keep], self._window_hashes(first)])

    def _window_hashes(self, first: np.ndarray) -> np.ndarray:
        out = np.zeros(len(first), dtype=np.uint64)
        for start, stop in self._chunks():
            at = np.flatnonzero((first >= start) & (first < start + CHUNK))
            if len(at):
                out[at] = mixed(Prefixes(self.text[start:stop]).of(first[at] - start, self.length))
        return out

    def stretches(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        """(bucket, entries): each distinct stretch once, with its least document; keeps which stretch is which entry."""
        wide = self.length + self.length - self.gram
        size = self.s_count + self.length - 1
        full = np.concatenate([self.text, np.zeros(wide, dtype=np.uint8)])
        span = np.arange(wide)
        digest = np.zeros(len(size), dtype=np.uint64)
        weights = mixed(np.arange(1, wide + 1, dtype=np.uint64))
        for k in range(0, len(size), SLICE):
            rows = full[self.s_first[k : k + SLICE, None] + span]
            rows[span >= size[k : k + SLICE, None]] = 0
            digest[k : k + SLICE] = mixed(((rows + np.uint64(1)) * weights).sum(axis=1, dtype=np.uint64))
        order = np.lexsort((self.s_anchor, self.s_count, digest, self.s_key))
        same = np.zeros(len(order), dtype=bool)
        for k in range(1, len(order), SLICE):
            a, b = order[k - 1 : k - 1 + len(order[k : k + SLICE])], order[k : k + SLICE]
            alike = (self.s_key[a] == self.s_key[b]) & (digest[a] == digest[b]) & (self.s_count[a] == self.s_count[b]) & (self.s_anchor[a] == self.s_anchor[b])
            at = np.flatnonzero(alike)
            inside = span < size[b[at], None]
            alike[at] = ((full[self.s_first[a[at], None] + span] == full[self.s_first[b[at], None] + span]) | ~inside).all(axis=1)
            same[k : k + len(b)] = alike
        entry = np.cumsum(~same) - 1
        self.entry = np.empty(len(order), dtype=np.int64)
        self.entry[order] = entry
        head = order[~same]
        self.least = np.full(len(head), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.entry, self.s_doc)
        bucket = (self.s_key[head] % np.uint64(buckets)).astype(np.int64)
        self.by_bucket = {}
        for b in np.unique(bucket).tolist():
            at = np.flatnonzero(bucket == b)
            self.by_bucket[b] = at
            own = head[at]
            texts = b"".join(self.raw[s : s + n] for s, n in zip(self.s_first[own].tolist(), size[own].tolist(), strict=True))
            n = len(own).to_bytes(8, "little")
            yield b, _packed(n + self.s_key[own].astype("<u8").tobytes() + self.least[at].astype("<i8").tobytes() + self.s_count[own].astype("u1").tobytes() + self.s_anchor[own].astype("<u2").tobytes() + texts)

    def covered(self, masks: dict[int, np.ndarray]) -> np.ndarray:
        """Which bytes windows with an earlier document cover."""
        turn = np.zeros(len(self.text) + 1, dtype=np.int32)
        if len(self.s_first):
            known = np.zeros(len(self.least), dtype=np.uint64)
            for b, at in self.by_bucket.items():
                if b in masks:
                    known[at] = masks[b]
            bits = np.where(self.s_doc > self.least[self.entry], np.uint64(0xFFFFFFFFFFFFFFFF), known[self.entry])
            for k in range(int(self.s_count.max(initial=0))):
                at = self.s_first[(self.s_count > k) & ((bits >> np.uint64(k)) & np.uint64(1)).astype(bool)] + k
                turn[at] += 1  # a window starts once
                turn[at + self.length] -= 1
        return np.cumsum(turn[:-1]) > 0

    def results(self, gone: np.ndarray) -> pa.Table:
        kept, spans = [], []
        for s, e in zip(self.starts.tolist(), self.ends.tolist(), strict=True):
            own = gone[s:e]
            if not own.any():
                kept.append(self.raw[s:e])
                spans.append([])
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
            spans.append([{"start": a, "length": b - a} for a, b in edges.reshape(-1, 2).tolist()])
            kept.append(self.text[s:e][~own].tobytes())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        return pa.table([pa.array(self.ids, pa.int64()), pa.array(self.ends - self.starts, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind)], names=["doc_id", "n_bytes", "kept", "spans"])


def _per_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """(bucket, blocks, data) of rows (bucket, block, data) that come sorted by bucket."""
    now, blocks, data = None, [], []
    for b in batches:
        for bucket, block, raw in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if bucket != now:
                if blocks:
                    yield now, blocks, data
                now, blocks, data = bucket, [], []
            blocks.append(block)
            data.append(raw)
    if blocks:
        yield now, blocks, data


def _replies(kind: int, bucket: int, blocks: list[int], data: list[bytes]) -> pa.RecordBatch:
    n = len(blocks)
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array([bucket] * n, pa.int64()), pa.array(data, pa.binary())], names=["block", "kind", "bucket", "data"])


REPLY = "block long, kind int, bucket long, data binary"


def shared_grams(blobs: list[bytes], hot: int) -> list[bytes]:
    """For each block's anchors (hashes and counts) the bits of those that other blocks hold too, then of those with more than ``hot`` places."""
    parts = [_unpacked(b) for b in blobs]
    sizes = [len(p) // 10 for p in parts]
    hashes = np.concatenate([np.frombuffer(p, dtype="<u8", count=n) for p, n in zip(parts, sizes, strict=True)])
    counts = np.concatenate([np.frombuffer(p, dtype="<u2", offset=8 * n) for p, n in zip(parts, sizes, strict=True)]).astype(np.int64)
    order = np.argsort(hashes, kind="stable")
    new = np.concatenate([[True], hashes[order[1:]] != hashes[order[:-1]]])
    group = np.cumsum(new) - 1
    held = np.bincount(group)
    total = np.bincount(group, weights=counts[order])
    several, many = np.empty(len(order), dtype=bool), np.empty(len(order), dtype=bool)
    several[order], many[order] = held[group] > 1, total[group] > hot
    out, at = [], 0
    for n in sizes:
        out.append(np.packbits(np.concatenate([several[at : at + n], many[at : at + n]])).tobytes())
        at += n
    return out


def earlier_windows(blobs: list[bytes], length: int) -> list[bytes]:
    """For each block's stretches the windows, as bits, that a document before the stretch's own least one holds too."""
    wide = 2 * length - gram_size(length)
    keys, least, counts, anchors, texts, sizes = [], [], [], [], [], []
    for raw in map(_unpacked, blobs):
        n = int.from_bytes(raw[:8], "little")
        keys.append(np.frombuffer(raw, "<u8", n, 8))
        least.append(np.frombuffer(raw, "<i8", n, 8 + 8 * n))
        counts.append(np.frombuffer(raw, "u1", n, 8 + 16 * n).astype(np.int64))
        anchors.append(np.frombuffer(raw, "<u2", n, 8 + 17 * n).astype(np.int64))
        texts.append(np.frombuffer(raw, np.uint8, offset=8 + 19 * n))
        sizes.append(n)
    key, doc, count, anchor, text = (np.concatenate(x) for x in (keys, least, counts, anchors, texts))
    del keys, least, counts, anchors, texts
    size = count + length - 1
    start = np.cumsum(size) - size
    text = np.concatenate([text, np.zeros(wide, dtype=np.uint8)])
    masks = np.zeros(len(key), dtype=np.uint64)
    by_key = np.argsort(key, kind="stable")
    bounds = np.concatenate([np.flatnonzero(np.concatenate([[True], key[by_key[1:]] != key[by_key[:-1]]])), [len(key)]])
    at = 0
    while at < len(bounds) - 1:
        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE, side="right")) - 1)
        own = by_key[bounds[at] : bounds[stop]]
        at = stop
        # all windows of these stretches: their stretch, the window's number, its first byte
        n = count[own]
        which = np.repeat(np.arange(len(own)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first = start[own][which] + k
        # equal windows have equal keys, anchors, first and last words; only those can be of one class
        words = np.lib.stride_tricks.as_strided(text, (len(text) - 7, 8), (1, 1))
        one, two = (np.ascontiguousarray(words[x]).view("<u8")[:, 0] if length >= 8 else np.zeros(len(x), dtype=np.uint64) for x in (first, first + max(0, length - 8)))
        dealt = mixed(mixed(mixed(key[own][which] ^ (anchor[own][which] - k).astype(np.uint64)) ^ one) ^ two)
        order = np.argsort(dealt, kind="stable")
        new = np.concatenate([[True], dealt[order[1:]] != dealt[order[:-1]]])
        group = np.cumsum(new) - 1
        several = np.bincount(group)[group] > 1
        order, group = order[several], group[several]
        if not len(order):
            continue
        # the text of these stretches alone
        used = np.zeros(len(own), dtype=bool)
        used[which[order]] = True
        some = np.flatnonzero(used)
        offset = np.zeros(len(own), dtype=np.int64)
        offset[some] = np.cumsum(size[own[some]]) - size[own[some]]
        lengths = size[own[some]]
        local = text[np.repeat(start[own[some]] - offset[some], lengths) + np.arange(lengths.sum())]
        c = classes(local, offset[which[order]] + k[order], group, length)
        lowest = np.full(int(c.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(lowest, c, doc[own[which[order]]])
        marked = lowest[c] < doc[own[which[order]]]
        hit = order[marked]
        np.bitwise_or.at(masks, own[which[hit]], np.uint64(1) << k[hit].astype(np.uint64))
    out, at = [], 0
    for n in sizes:
        out.append(_packed(masks[at : at + n].tobytes()))
        at += n
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, kept, spans): each document's UTF-8 bytes without the repeated ones, and the removed runs as (start, length).

    A byte goes if a string of ``length`` bytes covers it that also starts in a document of a smaller id; strings are judged on the
    input and never cross documents. Null texts are empty; texts shorter than ``length`` stay whole. Of documents of one id none
    comes before the other, so repeated rows all keep what no smaller id holds. A document without an id keeps all and takes from
    none. Very long texts are blocks of their own. Other columns are not read; an empty table gives no rows. ``length`` is 3 to 16,000.
    """
    if not 3 <= length <= 16_000:
        raise ValueError("length must be 3 to 16000")
    spark = docs.sparkSession
    limit_arrow_batches(spark)
    scratch = Scratch(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TASK)
    buckets = 2 * tasks
    # bucketed, so that what comes back is joined with the blocks without dealing these again
    name = f"twinlens_blocks_{uuid.uuid4().hex}"
    blocks_of(texts, block).repartition(tasks, "block").write.bucketBy(tasks, "block").option("path", f"{scratch.base}/blocks").saveAsTable(name)
    blocks = spark.table(name)

    def opened(row: dict) -> Block:
        return Block(row["ids"], row["sizes"], row["data"], length)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                out = [(bucket, row["block"], _packed(h.astype("<u8").tobytes() + n.tobytes())) for bucket, h, n in opened(row).grams_of(buckets)]
                yield _blobs(out)

    def _blobs(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["bucket", "block", "data"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, own, data in _per_bucket(batches):
            yield _replies(0, bucket, own, shared_grams(data, hot))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, own, data in _per_bucket(batches):
            yield _replies(1, bucket, own, earlier_windows(data, length))

    def of(table: pa.Table, kind: int) -> dict[int, bytes]:
        return {r["bucket"]: r["data"] for r in table.to_pylist() if r["kind"] == kind}

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        for row in left.to_pylist():
            own = opened(row)
            own.mark_shared(of(right, 0), buckets)
            rows += [(b, row["block"], data) for b, data in own.stretches(buckets)]
        return pa.Table.from_batches([_blobs(rows)])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            own = opened(row)
            own.mark_shared(of(right, 0), buckets)
            for _ in own.stretches(buckets):
                pass
            out.append(own.results(own.covered({b: np.frombuffer(_unpacked(d), dtype="<u8") for b, d in of(right, 1).items()})))
        return pa.concat_tables(out) if out else pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))]).empty_table()

    entry = "bucket long, block long, data binary"
    dealt = lambda rows: rows.repartition(tasks, "bucket").sortWithinPartitions("bucket", "block")
    first = scratch.write(dealt(blocks.mapInArrow(grams, entry)).mapInArrow(meet, REPLY))
    sent = blocks.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(send, entry)
    second = scratch.write(dealt(sent).mapInArrow(judge, REPLY))
    return blocks.groupBy("block").cogroup(first.union(second).groupBy("block")).applyInArrow(finish, RESULT)


#: Every window of every document by its bytes (as 128-bit digests), for whole small tables.
ORACLE = """
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
    pieces AS (SELECT r, doc_id, n, 500 * j AS o, substr(x, 1000 * j + 1, 1098) AS x FROM (SELECT r, doc_id, x, len(x) // 2 AS n, unnest(range(len(x) // 1000 + 1)) AS j FROM d)),
    w AS MATERIALIZED (SELECT r, doc_id, o + k AS i, md5_number(substr(x, 2 * k + 1, 100)) AS s FROM (SELECT *, unnest(range(greatest(0, least(500, n - o - 49)))) AS k FROM pieces)),
    least AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
    hit AS MATERIALIZED (SELECT w.r, w.i, w.i - lag(w.i) OVER (PARTITION BY w.r ORDER BY w.i) AS step FROM w JOIN least l ON l.s = w.s AND w.doc_id > l.m),
    runs AS MATERIALIZED (
        SELECT r, min(i) AS a, max(i) + 50 AS z FROM (SELECT *, count_if(step IS NULL OR step > 50) OVER (PARTITION BY r ORDER BY i) AS n FROM hit) GROUP BY r, n),
    gaps AS (
        SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS z FROM runs
        UNION ALL SELECT d.r, coalesce(max(t.z), 0), max(len(d.x) // 2) FROM d LEFT JOIN runs t ON t.r = d.r GROUP BY d.r),
    kept AS (SELECT g.r, string_agg(substr(d.x, 2 * g.a + 1, 2 * (g.z - g.a)), '' ORDER BY g.a) AS x FROM gaps g JOIN d ON d.r = g.r GROUP BY g.r),
    gone AS (SELECT r, sum(z - a) AS bytes, count(*) AS n FROM runs GROUP BY r)
    SELECT d.doc_id, CAST(len(d.x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(g.bytes, 0) AS BIGINT) AS n_removed, CAST(coalesce(g.n, 0) AS BIGINT) AS n_spans, sha256(unhex(k.x)) AS kept_sha256
    FROM d JOIN kept k ON k.r = d.r LEFT JOIN gone g ON g.r = d.r"""
