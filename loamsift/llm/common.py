"""What the operators of this subpackage share: words, shingle sets, scratch tables."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from ..functions.tables import Scratch, remove, scratch_dir, written  # noqa: F401

WORD = re.compile(r"[^\W_]+")
#: Texts are turned into Python strings in slices of about so many bytes.
SLICE_BYTES = 4 << 20


def words(text: str) -> list[str]:
    """Maximal runs of Unicode letters and digits of the lower-cased text."""
    return WORD.findall(text.lower())


def slices(batches: Iterable[pa.RecordBatch], text: str, rows: int = 4000) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that a slice holds few rows and not much text; one very long text makes its own slice."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        sizes = np.nan_to_num(np.asarray(pc.binary_length(col).to_numpy(zero_copy_only=False), dtype=float))
        group = np.maximum.accumulate((np.cumsum(sizes) // SLICE_BYTES).astype(np.int64) + np.arange(len(sizes)) // rows)
        cuts = [0, *(np.nonzero(np.diff(group))[0] + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHash:
    """64-bit hashes of words, kept for the words seen so far; forgets them when there are too many."""

    def __init__(self, most: int = 500_000) -> None:
        self.seen: dict[str, int] = {}
        self.most = most

    def __call__(self, tokens: list[str]) -> np.ndarray:
        seen = self.seen
        if len(seen) > self.most:
            seen.clear()
        for w in set(tokens).difference(seen):
            seen[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter((seen[w] for w in tokens), dtype=np.uint64, count=len(tokens))


def shingle_sets(texts: list[str | None], hasher: WordHash, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word sequences of ``width`` words of each text, hashed to 32 bits.

    In a text of n sequences two collide with a probability of n * n / 2 ** 33. Returns the sorted hashes of all texts one after another and where each text begins (one more entry
    than texts). A NULL text and one of fewer words have none.
    """
    tokens: list[str] = []
    lengths = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        if t:
            w = words(t)
            if len(w) >= width:
                lengths[i] = len(w)
                tokens += w
    h = hasher(tokens)
    doc = np.repeat(np.arange(len(texts)), lengths)
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    s = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        s = mix64(s * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n] + np.uint64(k + 1))
    inside = doc[:n] == doc[width - 1 :]
    s, d = s[inside] >> np.uint64(32), doc[:n][inside]
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    s, d = s[new], d[new]
    return s, np.searchsorted(d, np.arange(len(texts) + 1))


def set_prints(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit print of each set: equal sets have equal prints."""
    if len(sets) == 0:
        return np.zeros(len(starts) - 1, np.uint64)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix64(sets ^ np.uint64(0xA5A5A5A55A5A5A5A)), dtype=np.uint64)])
    part = total[starts[1:]] - total[starts[:-1]]
    return mix64(part + (starts[1:] - starts[:-1]).astype(np.uint64))


def minhashes(sets: np.ndarray, starts: np.ndarray, count: int, seed: int = 1) -> np.ndarray:
    """``count`` MinHash values (32 bits) of each non-empty set; row per set, empty sets must be left out before."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, count, dtype=np.uint64)
    out = np.empty((len(starts) - 1, count), dtype=np.uint32)
    if len(starts) > 1:
        for k in range(count):
            v = ((sets * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32)
            out[:, k] = np.minimum.reduceat(v, starts[:-1])
    return out


def list_column(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values, type=kind))
