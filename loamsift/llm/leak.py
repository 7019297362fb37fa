"""Evaluation texts leaking into training text, by a distributed positional inverted index.

The corpus is indexed in blocks of documents. A block's row holds the sorted terms of the block (word hashes) and, for each, the list
of its positions in ascending order; the documents of a block lie end to end with gaps, so that no phrase reaches from one into the
next. The blocks are written once and serve any test set. A test passage is cut into anchors of half the length that counts as
a leak: a leaked run of words holds at least one anchor in full. The position lists of an anchor's terms are intersected, each moved by its
place in the anchor, from the rarest term of the whole corpus on. From every anchor found the run is followed both ways.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHash, slices, words, written

GAP = 64
#: Test passages are held in the tasks in packs of so many words; further packs are further passes over the index.
PACK_WORDS = 2_000_000
#: In a proximity match a word may lie so many positions away from where the passage has it.
SLACK = 2
SHARE = 0.8
BLOCK_ROWS = 4000


def build_index(df: DataFrame, key: str, text: str) -> DataFrame:
    """(docs, begins, terms, offsets, positions): one row per block of documents.

    ``terms`` are sorted; the positions of terms[i] are positions[offsets[i]:offsets[i + 1]]; document docs[j] begins at begins[j].
    """
    schema = T.StructType([T.StructField("docs", T.ArrayType(df.schema[key].dataType)), T.StructField("begins", T.ArrayType(T.IntegerType())), T.StructField("terms", T.ArrayType(T.LongType())), T.StructField("offsets", T.ArrayType(T.IntegerType())), T.StructField("positions", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHash()
        for b in slices(batches, "text__", BLOCK_ROWS):
            tokens: list[str] = []
            n = np.zeros(b.num_rows, dtype=np.int64)
            for i, t in enumerate(b.column(1).to_pylist()):
                if t:
                    w = words(t)
                    n[i] = len(w)
                    tokens += w
            begins = np.concatenate([[0], np.cumsum(n + GAP)])[:-1]
            pos = np.arange(len(tokens)) + np.repeat(np.arange(b.num_rows) * GAP, n)
            terms, code = np.unique(hasher(tokens).view(np.int64), return_inverse=True)
            order = np.argsort(code, kind="stable")
            offsets = np.searchsorted(code[order], np.arange(len(terms) + 1))
            one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], type=pa.int32()), pa.array(x, type=kind))
            docs = pa.ListArray.from_arrays(pa.array([0, b.num_rows], type=pa.int32()), b.column(0))
            yield pa.RecordBatch.from_arrays([docs, one(begins.astype(np.int32), pa.int32()), one(terms, pa.int64()), one(offsets.astype(np.int32), pa.int32()), one(pos[order].astype(np.int32), pa.int32())], names=[f.name for f in schema.fields])

    return df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key), F.col(text).alias("text__")).mapInArrow(run, schema)


class Passages:
    """A pack of test passages as arrays: their words one after another and the anchors with their terms from the rarest on."""

    def __init__(self, items: list[tuple[str, str]], least: int) -> None:
        self.items, self.least = items, least
        hasher = WordHash()
        each = [hasher(words(t)).view(np.int64) for _, t in items]
        self.begins = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
        self.words = np.concatenate([*each, np.zeros(0, np.int64)])
        self.size = max(1, (least + 1) // 2)
        at = [a + np.arange(0, len(x) - self.size + 1, self.size) for a, x in zip(self.begins, each) if len(x) >= least]
        self.anchors = np.concatenate([*at, np.zeros(0, np.int64)]).astype(np.int64)

    def rank(self, frequency: dict[int, int]) -> None:
        """Orders the places of each anchor by how rare its terms are in the whole corpus."""
        f = np.array([frequency.get(int(w), 0) for w in self.words], dtype=np.int64)
        places = self.anchors[:, None] + np.arange(self.size)
        self.order = np.argsort(f[places], axis=1, kind="stable")
        #: An anchor with a term that the corpus lacks can't be found.
        self.live = f[places].min(axis=1) > 0 if len(places) else np.zeros(0, bool)


def _expand(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All k with first[i] <= k < last[i], and their i."""
    n = np.maximum(last - first, 0)
    i = np.repeat(np.arange(len(n)), n)
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum())), i


class Block:
    """The index of one block, opened for searching."""

    def __init__(self, terms: np.ndarray, offsets: np.ndarray, positions: np.ndarray) -> None:
        self.terms, self.offsets, self.positions = terms, offsets.astype(np.int64), positions.astype(np.int64)
        self.span = int(self.positions.max()) + 2 * GAP if len(positions) else 1
        self.keyed = self.positions + np.repeat(np.arange(len(terms)), np.diff(self.offsets)) * self.span

    def codes(self, words: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(self.terms, words), max(len(self.terms) - 1, 0))
        return np.where(self.terms[i] == words, i, -1) if len(self.terms) else np.full(len(words), -1)

    def has(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the term stands at the position."""
        want = code * self.span + at
        i = np.minimum(np.searchsorted(self.keyed, want), len(self.keyed) - 1)
        return (code >= 0) & (at >= 0) & (at < self.span) & (self.keyed[i] == want)

    def search(self, p: Passages) -> list[tuple[int, int, int, int]]:
        """(passage, position, words, kind): the longest exact run of each passage from a position on (kind 0), and near matches (kind 1)."""
        if not len(self.keyed) or not len(p.anchors):
            return []
        code = self.codes(p.words)
        places = p.anchors[:, None] + np.arange(p.size)
        use = np.nonzero(p.live & (code[places] >= 0).all(axis=1))[0]
        if not len(use):
            return []
        rare = p.order[use, 0]
        c = code[p.anchors[use] + rare]
        k, i = _expand(self.offsets[c], self.offsets[c + 1])
        start = self.positions[k] - rare[i]
        anchor = use[i]
        for step in range(1, p.size):
            if not len(start):
                return []
            place = p.order[anchor, step]
            keep = self.has(code[p.anchors[anchor] + place], start + place)
            start, anchor = start[keep], anchor[keep]
        word = p.anchors[anchor]
        passage = np.searchsorted(p.begins, word, side="right") - 1
        low, high = p.begins[passage], p.begins[passage + 1]
        left, right = self._follow(code, word, start, low, high, -1), self._follow(code, word + p.size - 1, start + p.size - 1, low, high, 1)
        run = left + p.size + right
        found = {(int(q), int(s)): int(r) for q, s, r in zip(passage, start - left, run) if r >= p.least}
        out = [(q, s, r, 0) for (q, s), r in found.items()]
        short = run < p.least
        if short.any():
            out += self._near(p, code, word[short], start[short], passage[short], low[short], high[short])
        return out

    def _follow(self, code: np.ndarray, word: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, step: int) -> np.ndarray:
        """How many further words of the passage follow in the document."""
        n = np.zeros(len(word), dtype=np.int64)
        live = np.arange(len(word))
        k = 0
        while len(live):
            k += 1
            w = word[live] + step * k
            inside = (w >= low[live]) & (w < high[live])
            live, w = live[inside], w[inside]
            live = live[self.has(code[w], at[live] + step * k)]
            n[live] += 1
        return n

    def _near(self, p: Passages, code: np.ndarray, word: np.ndarray, start: np.ndarray, passage: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Windows of ``least`` words around an anchor of which the share ``SHARE`` stands within ``SLACK`` of its place."""
        out = {}
        for back in range(0, p.least - p.size + 1):
            first = word - back
            ok = (first >= low) & (first + p.least <= high)
            hits = np.zeros(len(word), dtype=np.int64)
            for j in range(p.least):
                w = np.minimum(np.maximum(first + j, 0), len(code) - 1)
                there = np.zeros(len(word), bool)
                for s in range(-SLACK, SLACK + 1):
                    there |= self.has(code[w], start - back + j + s)
                hits += there
            for i in np.nonzero(ok & (hits >= SHARE * p.least))[0]:
                k = (int(passage[i]), int(start[i]))
                out[k] = max(out.get(k, 0), int(hits[i]))
        return [(q, s, h, 1) for (q, s), h in out.items()]


def _packs(items: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """The passages in packs of a bounded number of words."""
    pack, n = [], 0
    for r in items.toLocalIterator():
        pack.append((r[0], r[1]))
        n += len(r[1]) // 2 + 1
        if n >= PACK_WORDS:
            yield pack
            pack, n = [], 0
    if pack:
        yield pack


def leaks(df: DataFrame, key: str, text: str, items: DataFrame, item: str, passages: list[str], least: int = 12, index: DataFrame | None = None) -> DataFrame:
    """(key, item, kind, words): documents that hold at least ``least`` consecutive words of a passage of a test item (kind exact, words:
    the longest run), or nearly so (kind proximity, words: how many of ``least`` words stand in or within two of their places).

    ``passages`` names the columns of ``items`` with text. A pair found exactly has no proximity row. NULL and short passages and NULL and
    empty documents leak nothing; repeated rows and items change nothing; empty tables give an empty result; other columns are ignored. ``index`` takes an
    index that was built before.
    """
    index = index if index is not None else written(build_index(df, key, text), "index")
    rows = reduce(DataFrame.unionByName, (items.select(F.col(item).cast("string").alias("item"), F.col(c).alias("passage")) for c in passages))
    rows = rows.where(F.col("item").isNotNull() & F.col("passage").isNotNull()).distinct()
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("item__", T.StringType()), T.StructField("kind__", T.IntegerType()), T.StructField("words", T.IntegerType())])
    found = []
    for pack in _packs(rows):
        p = Passages(pack, least)
        vocabulary = np.unique(p.words)

        def frequency(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray = vocabulary) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(vocabulary), dtype=np.int64)
            for b in batches:
                for r in range(b.num_rows):
                    terms = b.column(0).slice(r, 1).flatten().to_numpy()
                    n = np.diff(b.column(1).slice(r, 1).flatten().to_numpy())
                    if len(terms) and len(vocabulary):
                        i = np.minimum(np.searchsorted(terms, vocabulary), len(terms) - 1)
                        total += np.where(terms[i] == vocabulary, n[i], 0)
            seen = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array(vocabulary[seen]), pa.array(total[seen])], names=["term", "n"])

        counts = index.select("terms", "offsets").mapInArrow(frequency, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
        p.rank({r[0]: r[1] for r in counts})

        def search(batches: Iterator[pa.RecordBatch], p: Passages = p) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in range(b.num_rows):
                    docs, begins, terms, offsets, positions = (b.column(c).slice(r, 1).flatten() for c in range(5))
                    begins = begins.to_numpy()
                    hits = Block(terms.to_numpy(), offsets.to_numpy(), positions.to_numpy()).search(p)
                    if hits:
                        q, s, n, kind = (np.array(x) for x in zip(*hits))
                        j = np.searchsorted(begins, s, side="right") - 1
                        yield pa.RecordBatch.from_arrays([docs.take(pa.array(j)), pa.array([p.items[i][0] for i in q], type=pa.string()), pa.array(kind.astype(np.int32)), pa.array(n.astype(np.int32))], names=[f.name for f in schema.fields])

        found.append(index.select("docs", "begins", "terms", "offsets", "positions").mapInArrow(search, schema))
    spark = df.sparkSession
    every = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)
    best = every.groupBy(key, "item__").agg(F.min("kind__").alias("k"), F.max(F.when(F.col("kind__") == 0, F.col("words"))).alias("exact"), F.max("words").alias("near"))
    return best.select(key, F.col("item__").alias(item), F.when(F.col("k") == 0, "exact").otherwise("proximity").alias("kind"), F.coalesce("exact", "near").alias("words"))
