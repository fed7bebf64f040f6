"""Cost-balanced packing of token sequences.

Each input partition is read once, in Arrow batches. A document becomes its token ids plus a closing id 0.
Full sequences are cut off its front at once; what is left (shorter than a sequence) waits in a bounded pool.
A full pool is packed: remainders in descending length go to the sequence of lowest estimated cost
(``alpha * n + beta * n**2`` for each piece) that still has room, and what fits nowhere whole is cut into the
free rooms. The pool's last rooms have power-of-two sizes, so no sequence needs padding.
There is no shuffle, and a lost task repeats with the same result, since it depends on its input split alone.
"""

from __future__ import annotations

import base64
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import limit_arrow_batches

CAPACITY = 1024
POOL = 4096
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Beyond this, or with a huge run of white space, texts go to the reference encoder instead of the fast one.
_ODD = re.compile(r"[^\x00-\u052f\u2010-\u2027\u20a0-\u20bf]|\s{500}")
_made: dict = {}


class ByteBpe:
    """Byte-level BPE ids of whole texts as little-endian uint32 bytes.

    ``vocab`` is a tokenizers .json; ``ranks``, where given, is the same vocabulary as a rank file, whose faster
    encoder takes texts of common scripts. Both give the same ids (tested); special strings become their ids.
    """

    def __init__(self, vocab: str, ranks: str | None = None, pattern: str | None = None):
        self.vocab, self.made, self.fast = vocab, None, None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            with open(vocab, encoding="utf-8") as f:
                special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges, special_tokens=special)
            self.special = set(special)

    @property
    def exact(self):
        """The reference encoder, read when a text first needs it."""
        if self.made is None:
            from tokenizers import Tokenizer

            self.made = Tokenizer.from_file(self.vocab)
        return self.made

    def encode(self, text: str) -> bytes:
        if self.fast is not None and not _ODD.search(text):
            try:
                return bytes(self.fast._core_bpe.encode_to_tiktoken_buffer(text, self.special))
            except UnicodeEncodeError:
                pass
        return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def encoder(vocab: str, ranks: str | None, pattern: str | None) -> ByteBpe:
    key = (vocab, ranks)
    if key not in _made:
        _made[key] = ByteBpe(vocab, ranks, pattern)
    return _made[key]


def with_token_counts(docs: DataFrame, out_col: str, vocab: str, ranks: str | None = None, pattern: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with the tokens that packing makes of each whole text, the closing one among them. ``out_col`` must not be a column of ``docs``."""
    if out_col in docs.columns:
        raise ValueError(f"{out_col} is a column already")
    limit_arrow_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        enc = encoder(vocab, ranks, pattern)
        for b in batches:
            sizes = [len(enc.encode(t or "")) // 4 + 1 for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes, pa.int64())], names=[*b.schema.names, out_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out_col, T.LongType())]))


def rooms_for(total: int, capacity: int) -> np.ndarray:
    """Sequence sizes that hold ``total`` tokens exactly: full ones, then descending powers of two."""
    full, rest = divmod(total, capacity)
    return np.array([capacity] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1], dtype=np.int64)


def assign(lengths: np.ndarray, capacity: int = CAPACITY, alpha: float = 1.0, beta: float = 1 / 512) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start within item, length, sequence, offset) for remainders of the given lengths."""
    rooms = rooms_for(int(lengths.sum()), capacity)
    free, cost = rooms.copy(), np.zeros(len(rooms))
    out, cut = [], []

    def put(i: int, start: int, n: int, s: int) -> None:
        out.append((i, start, n, s, int(rooms[s] - free[s])))
        free[s] -= n
        cost[s] += alpha * n + beta * n * n

    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        open_cost = np.where(free >= n, cost, np.inf)
        s = int(open_cost.argmin()) if len(rooms) else -1
        if s >= 0 and open_cost[s] != np.inf:
            put(int(i), 0, n, s)
        else:
            cut.append(int(i))
    left = [int(s) for s in np.argsort(-free, kind="stable") if free[s] > 0]
    at = 0
    for i in cut:
        start, n = 0, int(lengths[i])
        while n:
            while not free[left[at]]:
                at += 1
            take = int(min(n, free[left[at]]))
            put(i, start, take, left[at])
            start, n = start + take, n - take
    return out


def pack(
    docs: DataFrame,
    vocab: str,
    ranks: str | None = None,
    pattern: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    pool: int = POOL,
    alpha: float = 1.0,
    beta: float = 1 / 512,
) -> DataFrame:
    """Pack all documents; one row per piece.

    Null and empty texts are the single closing id. Repeated rows are packed each for itself; a null id is carried.
    An empty table gives no rows; other columns are not read. Very long texts are cut into full sequences as they come.
    ``sequence_id`` is unique in the result: the partition number times 2**40 plus a counter.
    """
    limit_arrow_batches(docs.sparkSession)

    def run(batches):
        enc = encoder(vocab, ranks, pattern)
        seq = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        wait: list[tuple] = []

        def flush():
            nonlocal seq, wait
            if wait:
                pieces = assign(np.array([w[2] for w in wait], dtype=np.int64), capacity, alpha, beta)
                for i, start, n, s, offset in pieces:
                    doc, first, _, total, ids = wait[i]
                    rows.append((doc, first + start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), total, seq + s, offset))
                seq += max(p[3] for p in pieces) + 1
                wait = []

        def batch():
            nonlocal rows
            cols = list(zip(*rows, strict=True)) or [()] * 7
            rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = enc.encode(text or "") + b"\0\0\0\0"
                total = len(ids) // 4
                whole = total - total % capacity
                for start in range(0, whole, capacity):
                    rows.append((doc, start, capacity, zlib.crc32(ids[4 * start : 4 * (start + capacity)]), total, seq, 0))
                    seq += 1
                if total > whole:
                    wait.append((doc, whole, total - whole, total, ids[4 * whole :]))
                if len(wait) >= pool:
                    flush()
            if len(rows) > 4096:
                yield batch()
        flush()
        yield batch()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
