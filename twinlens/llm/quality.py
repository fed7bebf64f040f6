"""Quality scores from a factorisation machine over hashed words, structure statistics and length metadata.

A text is a sparse vector: one indicator per binned statistic and the square-root counts of its hashed words, scaled
to unit length. The score is ``sigmoid(b + <w, x> + pairwise)`` where the pairwise term over rank ``k`` factors is
``(|sum_i v_i x_i|**2 - sum_i |v_i x_i|**2) / 2``, linear in the number of entries. The machine is fitted by AdaGrad on
a bounded sample of labelled rows (``max_train``, those of least hashed id) and its fixed-size weights are broadcast.
"""

from __future__ import annotations

import string
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import limit_arrow_batches

HASH_BITS = 16
RANK = 8
#: Labelled rows that a model is fitted on at most; more change the fit little and would grow the driver.
MAX_TRAIN = 4000
SHARE_EDGES = np.array([0.0005, 0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8, 0.95])
SIZE_EDGES = 2.0 ** np.arange(0, 16)
BINS = 17
SHARES = ("upper", "symbols", "bangs", "digits", "bars", "repeated_lines", "distinct_words", "top_word", "not_ascii", "symbol_ends", "capital_words")
SIZES = ("words", "lines", "bytes", "word_length", "line_words")
N_STATS = (len(SHARES) + len(SIZES)) * BINS
SIZE = N_STATS + (1 << HASH_BITS)
_UPPER = string.ascii_uppercase.encode()
_DIGITS = string.digits.encode()
_SYMBOLS = b"#$%&*+<=>@\\^_`{}~"
_slots: dict[str, int] = {}


def _without(raw: bytes, chars: bytes) -> int:
    return len(raw) - len(raw.translate(None, chars))


def statistics(text: str, raw: bytes, counts: Counter, n_words: int) -> tuple[list[float], list[float]]:
    """Shares and sizes of one text, in the order of SHARES and SIZES."""
    size, words, lines = max(1, len(raw)), max(1, n_words), text.split("\n")
    distinct_lines = len(set(lines))
    symbol_ends = sum(n for w, n in counts.items() if w[-1] in "#$%&*!|~^")
    capital = sum(n for w, n in counts.items() if len(w) > 1 and w.isupper())
    shares = [
        _without(raw, _UPPER) / size,
        _without(raw, _SYMBOLS) / size,
        raw.count(b"!") / size,
        _without(raw, _DIGITS) / size,
        raw.count(b"|") / size,
        1 - distinct_lines / len(lines),
        len(counts) / words,
        max(counts.values(), default=0) / words,
        (len(raw) - len(text)) / size,
        symbol_ends / words,
        capital / words,
    ]
    return shares, [n_words, len(lines), len(raw), len(text) / words, words / len(lines)]


def vector(text: str | None) -> tuple[list[int], np.ndarray]:
    """Entry numbers and values of one whole text."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    shares, sizes = statistics(text, text.encode("utf-8"), counts, len(words))
    bins = [*np.searchsorted(SHARE_EDGES, shares, side="right").tolist(), *np.searchsorted(SIZE_EDGES, sizes, side="right").tolist()]
    slots = [BINS * k + b for k, b in enumerate(bins)]
    n_bins = len(slots)
    if len(_slots) > 200_000:
        _slots.clear()
    for w in counts:
        s = _slots.get(w)
        if s is None:
            s = _slots[w] = N_STATS + zlib.crc32(w.encode("utf-8")) % (1 << HASH_BITS)
        slots.append(s)
    values = np.ones(len(slots), dtype=np.float64)
    if counts:
        tf = np.sqrt(np.fromiter(counts.values(), dtype=np.float64, count=len(counts)))
        values[n_bins:] = tf / np.sqrt((tf * tf).sum())
    return slots, values


def stack(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors of several texts, end to end, and where each begins; none is empty."""
    slots, values, starts, at = [], [], [], 0
    for t in texts:
        s, v = vector(t)
        slots.append(np.array(s, dtype=np.int64))
        values.append(v)
        starts.append(at)
        at += len(s)
    return np.concatenate(slots), np.concatenate(values), np.array(starts)


@dataclass
class Machine:
    """Bias, linear weights (SIZE) and factors (SIZE x RANK)."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, slots: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        vx = self.factors[slots] * values[:, None]
        total = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
        return self.bias + np.add.reduceat(self.linear[slots] * values, starts) + 0.5 * ((total * total).sum(axis=1) - squares)

    def scores(self, texts: list) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.margins(*stack(texts)), -40, 40)))


def fit(slots: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, epochs: int = 12, rate: float = 0.05, decay: float = 1e-5, seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss, in batches of 128 rows in seeded orders. Without both classes, a constant score."""
    rng = np.random.default_rng(seed)
    share = float(labels.mean()) if len(labels) else 0.5
    if not 0 < share < 1:
        return Machine(float(np.log((share + 1e-3) / (1 - share + 1e-3))), np.zeros(SIZE), np.zeros((SIZE, RANK)))
    m = Machine(float(np.log(share / (1 - share))), np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, RANK)))
    g_lin, g_fac, g_bias = np.full(SIZE, 1e-6), np.full((SIZE, RANK), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for k in range(0, len(order), 128):
            rows = order[k : k + 128]
            s, v = np.concatenate([slots[i] for i in rows]), np.concatenate([values[i] for i in rows])
            sizes = np.array([len(slots[i]) for i in rows])
            starts = np.cumsum(sizes) - sizes
            vx = m.factors[s] * v[:, None]
            total = np.add.reduceat(vx, starts, axis=0)
            z = m.bias + np.add.reduceat(m.linear[s] * v, starts) + 0.5 * ((total * total).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), starts))
            err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[rows]) / len(rows)
            each = np.repeat(err, sizes)
            own, place = np.unique(s, return_inverse=True)
            d_lin = np.bincount(place, each * v, len(own)) + decay * m.linear[own]
            d_entry = (each * v)[:, None] * (np.repeat(total, sizes, axis=0) - vx)
            d_fac = np.stack([np.bincount(place, d_entry[:, f], len(own)) for f in range(RANK)], axis=1) + decay * m.factors[own]
            g_lin[own] += d_lin**2
            g_fac[own] += d_fac**2
            g_bias += err.sum() ** 2
            m.linear[own] -= rate * d_lin / np.sqrt(g_lin[own])
            m.factors[own] -= rate * d_fac / np.sqrt(g_fac[own])
            m.bias -= rate * float(err.sum()) / np.sqrt(g_bias)
    return m


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from fitting: crc32 of its id as text leaves 2 modulo 4. Null ids never train and are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> Machine:
    """A machine fitted on at most ``max_train`` labelled documents that are not held out.

    Labels that are null or contradict each other for one id are not used; of several texts of one id that of the least hash is used.
    """
    limit_arrow_batches(docs.sparkSession)
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("id"))
    known = known.agg(F.min(label_col).alias("label"), F.max(label_col).alias("most")).where("label = most")
    sample = known.select("id", F.col("label").cast("double").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_train)

    def vectors(batches):
        for b in batches:
            pairs = [vector(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([p[0] for p in pairs], pa.list_(pa.int32())), pa.array([p[1].astype(np.float32) for p in pairs], pa.list_(pa.float32()))],
                names=["id", "label", "slots", "vals"],
            )

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    own = F.struct(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text", "label")
    one = texts.join(F.broadcast(sample), "id").groupBy("id").agg(F.min(own).alias("x")).select("id", "x.label", "x.text")
    rows = one.mapInArrow(vectors, "id long, label double, slots array<int>, vals array<float>")
    got = rows.toArrow().sort_by("id")
    slots = [x.values.to_numpy() for x in got.column("slots")]
    values = [x.values.to_numpy() for x in got.column("vals")]
    return fit(slots, values, got.column("label").to_numpy())


def score(docs: DataFrame, machine: Machine, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with a score column (0 to 1) over the whole text; null and empty texts are scored by their statistics alone.

    Rows are kept as they are, repeated ones too; ``out_col`` must not be a column of ``docs``.
    """
    if out_col in docs.columns:
        raise ValueError(f"{out_col} is a column already")
    limit_arrow_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(m.scores(b.column(at).to_pylist()), pa.float64())], names=[*b.schema.names, out_col])

    return docs.mapInArrow(run, schema)
