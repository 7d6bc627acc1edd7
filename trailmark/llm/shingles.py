"""Word shingles of many texts at once, as 64-bit hashes, in numpy over Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text handled at a time; a longer text is handled alone.
CHUNK = 1 << 21


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs [from, to) of rows whose texts hold about CHUNK bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + CHUNK, "right")))
        yield at, to
        at = to


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word with A-Z lower-cased, first word of each text and the end). Null texts have none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]].copy()
    off = off - off[0]
    buf[(buf >= 65) & (buf <= 90)] += 32
    solid = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    n = len(buf)
    starts, ends = solid.copy(), solid.copy()
    starts[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    edges = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < n)]  # a word ends with its text
    starts[edges] = solid[edges]
    ends[edges - 1] = solid[edges - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(n, BASE, np.uint64))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
        power = np.cumprod(np.full(n, INVERSE, np.uint64))
        return _mix((total[e] - total[s]) * power[s] if n else np.zeros(0, np.uint64)), np.searchsorted(s, off)


def shingle_sets(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct shingles of each text in ascending order, one text behind the other; where each begins, and the end).

    A text of fewer words is one shingle, an empty one has none.
    """
    w, at = word_hashes(texts)
    odd = _mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    n = np.diff(at)
    with np.errstate(over="ignore"):
        full = np.zeros(max(0, len(w) - size + 1), np.uint64)
        for j in range(size):
            full += w[j : j + len(full)] * odd[j]
        full = _mix(full)
        parts = []
        for a, k in zip(at[:-1], n, strict=True):
            if k >= size:
                parts.append(np.sort(full[a : a + k - size + 1]))
            elif k:
                parts.append(_mix((w[a : a + k] * odd[:k]).sum(dtype=np.uint64, keepdims=True) + np.uint64(k)))
    raw = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    size_of = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    begin = np.r_[0, np.cumsum(size_of)]
    fresh = np.ones(len(raw), bool)
    fresh[1:] = raw[1:] != raw[:-1]
    fresh[begin[:-1][size_of > 0]] = True
    return raw[fresh], np.r_[0, np.cumsum(fresh)][begin]


def digests(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums per set that tell sets apart."""
    with np.errstate(over="ignore"):
        sums = [np.r_[np.uint64(0), np.cumsum(_mix(h ^ np.uint64(k)), dtype=np.uint64)] for k in (0, BASE)]
        return tuple((x[begin[1:]] - x[begin[:-1]]).view(np.int64) for x in sums)
