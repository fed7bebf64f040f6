"""Repeated substrings against every window by its bytes, and the hash-compared suffix order against plain sorting."""

import random
import re

import numpy as np
import pytest

from twinlens.llm import repeats, suffixes

TABLE = "doc_id long, text string, kept string, spans int, block long, n_bytes long"


def plain_repeats(rows, length):
    """(doc_id, bytes, kept, spans) by a dictionary of all windows."""
    least = {}
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for k in range(len(b) - length + 1 if i is not None else 0):
            w = b[k : k + length]
            least[w] = min(least.get(w, i), i)
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1 if i is not None else 0):
            if least[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        spans = [(m.start(), m.end() - m.start()) for m in re.finditer(rb"\x01+", gone)]
        out.append((i, len(b), bytes(x for x, g in zip(b, gone, strict=True) if not g), spans))
    return out


def odd_texts(seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeä😀", k=rng.randint(2, 7))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    passage, line = prose(30), prose(9)
    texts = [None, "", "short", "a" * 400, "ab" * 300, passage, passage, passage[:49], passage[:50], "a" * 49, line, prose(40_000)]
    texts += [prose(rng.randint(1, 60)) + passage + prose(rng.randint(1, 60)) for _ in range(25)] + [prose(rng.randint(5, 90)) + line + prose(8) + line for _ in range(60)]
    texts += [texts[20][:-30] + "x" + texts[20][-30:], texts[21] + texts[22], texts[11][1000:90_000]]
    rows = [(int(k * 7 % 1009) - 300, t) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, rows[3], rows[3], (rows[8][0], passage + "tail of the same id"), (None, passage), (None, None), (10**15, texts[11])]


@pytest.mark.parametrize(("length", "block", "hot"), [(50, 1 << 22, 20_000), (50, 3000, 3), (9, 2000, 20), (120, 5000, 2)])
def test_repeats_by_all_windows(spark, length, block, hot):
    rows = odd_texts()
    got = repeats.remove_repeats(spark.createDataFrame([(i, t, "k", 1, 2, 3) for i, t in rows], TABLE).repartition(5), length=length, block=block, hot=hot).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3])
    assert sorted(((r["doc_id"], r["n_bytes"], bytes(r["kept"]), [tuple(s) for s in r["spans"]]) for r in got), key=key) == sorted(plain_repeats(rows, length), key=key)


def test_no_documents(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], TABLE)).collect() == []


def test_length_is_checked(spark):
    with pytest.raises(ValueError, match="length"):
        repeats.remove_repeats(spark.createDataFrame([], TABLE), length=2)


def test_every_window_has_an_anchor_that_depends_on_it_alone(monkeypatch):
    """Equal windows have equal anchors at equal places, whatever stands around them and however the text is cut into chunks."""
    rng = np.random.default_rng(6)
    text = rng.integers(97, 99, size=3000).astype(np.uint8).tobytes()
    sizes = [500, 0, 40, 1460, 1000]
    seen = {}
    for chunk in (1 << 18, 333):
        monkeypatch.setattr(repeats, "CHUNK", chunk)
        own = repeats.Block([1, 2, 3, 4, None], sizes, repeats._packed(text), 50)
        windows = [(int(f) + k, int(p) - int(f) - k, int(h)) for f, n, p, h in zip(own.first, own.count, own.place, own.hash, strict=True) for k in range(n)]
        assert sorted(w[0] for w in windows) == [*range(451), *range(540, 540 + 1411)]
        for start, anchor, h in windows:
            assert 0 <= anchor <= 50 - repeats.gram_size(50)
            assert seen.setdefault(text[start : start + 50], (anchor, h)) == (anchor, h)


def test_suffix_order():
    rng = np.random.default_rng(1)
    for _ in range(60):
        text = rng.integers(97, 97 + rng.integers(1, 4), size=rng.integers(60, 400)).astype(np.uint8)
        size = int(rng.integers(1, 30))
        at = rng.permutation(len(text) - size + 1)
        group = np.sort(rng.integers(0, rng.integers(1, 6), size=len(at)))
        keys = [(g, text[a : a + size].tobytes()) for g, a in zip(group.tolist(), at.tolist(), strict=True)]
        assert [keys[k] for k in suffixes.merge_sorted(suffixes.Prefixes(text), at, group, size)] == sorted(keys)
        own = suffixes.classes(text, at, group, size).tolist()
        assert len(set(zip(keys, own, strict=True))) == len(set(keys)) == len(set(own))


def test_collisions_are_found():
    """Thue-Morse strings share their polynomial hash modulo 2**64 whatever the base; the bytes decide."""
    one = np.array([bin(i).count("1") & 1 for i in range(1 << 11)], dtype=np.uint8)
    text, at = np.concatenate([one, 1 - one, one]) + np.uint8(97), np.array([0, 1 << 11, 1 << 12])
    assert suffixes.Prefixes(text).common(at[:1], at[1:2], 1 << 11)[0] == 1 << 11
    assert suffixes.classes(text, at, np.zeros(3, dtype=np.int64), 1 << 11).tolist() in ([0, 1, 0], [1, 0, 1])
