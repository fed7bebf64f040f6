"""Token counts of whole texts by batch encoding in Arrow functions.

Texts are gathered into batches of about equal bytes; a text over ``segment_chars`` is cut where no token can cross (by
default at white space, which the tokenizer drops, or after a digit, which is a token of its own), and its segments'
lengths are summed. Only lengths leave Python.
"""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import limit_arrow_batches

SCHEMA = "doc_id long, n_bytes long, n_tokens long"
#: Where a text may be cut. For tokenizers that drop white space, before any ASCII white space.
ANY_SPACE = r"[ \t\n\r]"
#: For word tokenizers that also take each digit for itself: before white space, and after a digit that a letter or digit follows.
WORD_CUT = r"[ \t\n\r]|(?<=[0-9])(?=[A-Za-z0-9])"
#: For byte-level tokenizers, which join one space to the next word: before a lone space between words.
LONE_SPACE = r"(?<=\S) (?=\S)"
_made: dict = {}


def segments(text: str, boundary: re.Pattern, size: int) -> list[str]:
    """``text`` in pieces of at least ``size`` characters, each cut at the first boundary after that."""
    out, start = [], 0
    while len(text) - start > size:
        m = boundary.search(text, start + size)
        if not m:
            break
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]]


def lengths_of(path: str):
    """A function from a list of texts to their token counts, by the library for the file's kind."""
    if path not in _made:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            _made[path] = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            _made[path] = lambda texts: [len(x) for x in t.encode_batch_fast(texts, add_special_tokens=False)]
    return _made[path]


def token_counts(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    boundary: str | None = WORD_CUT,
    batch_bytes: int = 1 << 20,
    segment_chars: int = 1 << 15,
    limit: int = 2048,
) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    A null text counts as empty (0, 0); a null id is carried; repeated rows are counted each; other columns are not read.
    ``boundary`` None never cuts a text, for tokenizers whose tokens may cross white space. Where a text has no boundary
    beyond ``segment_chars`` (letters without white space or digits) the rest of it is one segment, whatever its size.
    """
    limit_arrow_batches(docs.sparkSession)
    cut = re.compile(boundary) if boundary else None

    def run(batches):
        count = lengths_of(tokenizer)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        ids, sizes, totals = [], [], []
        work: list[tuple[int, str]] = []
        held = 0

        def encode():
            nonlocal work, held
            for (k, _), n in zip(work, count([s for _, s in work]) if work else [], strict=True):
                totals[k] += n
            work, held = [], 0

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = text or ""
                n = len(text.encode("utf-8"))
                ids.append(doc)
                sizes.append(n)
                totals.append(0)
                for s in segments(text, cut, segment_chars) if cut else [text]:
                    work.append((len(ids) - 1, s))
                    held += len(s) if len(s) == len(text) and n == len(text) else len(s.encode("utf-8"))
                    if held >= batch_bytes:
                        encode()
            encode()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, sizes, totals)], names=names)
            ids, sizes, totals = [], [], []

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
