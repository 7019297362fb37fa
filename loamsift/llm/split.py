"""Splitting oversized texts at natural boundaries, by lexical cohesion.

For every position between two content words, the vocabulary of the block of ``BLOCK`` content words before it is
compared with that of the block after it. A fall of this similarity between two higher stretches is a valley: there the topic
changes. A piece is cut, within its size window, at the sentence, line or paragraph end with the deepest valley. The blocks of all
positions are counted at once from the distance of each word to its previous and next occurrence, so the cost is that of
a sort of the words, and one analysis serves all configurations of a text.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

BLOCK = 32
#: What a line or paragraph end counts beside the depth of its valley, which is between 0 and 2.
LINE, PARAGRAPH = 0.15, 0.3
#: Shorter words carry no topic.
CONTENT_CHARS = 4
#: Configurations that are held in a task; further ones are further passes.
CONFIG_PACK = 1000

_BLANK, _WORD, _STOP, _CLOSE, _LF, _CR = 1, 2, 4, 8, 16, 32
_LIMIT = 0x20000
_tables: list[np.ndarray] = []


def _char_tables() -> list[np.ndarray]:
    """By code point, the class bits and the lower case; all code points from ``_LIMIT`` count as letters."""
    if not _tables:
        kind = np.zeros(_LIMIT, np.uint8)
        low = np.arange(_LIMIT, dtype=np.uint32)
        for c in range(_LIMIT - 1):
            s = chr(c)
            if s.isalnum():
                kind[c] = _WORD
            if (x := s.lower()) != s:
                low[c] = ord(x[0])
        kind[_LIMIT - 1] = _WORD
        for marks, bit in ((" \t\r\n", _BLANK), (".!?…。！？", _STOP), ("\"')]»”’*_`", _CLOSE), ("\n", _LF), ("\r", _CR)):
            for s in marks:
                kind[ord(s)] |= bit
        _tables.extend([kind, low])
    return _tables


def _sliding_max(a: np.ndarray, length: int) -> np.ndarray:
    """The maximum of a[i : i + length] for each i."""
    have = 1
    while have < length:
        step = min(have, length - have)
        b = a.copy()
        np.maximum(a[:-step], a[step:], out=b[:-step])
        a, have = b, have + step
    return a


def _spans(lo: np.ndarray, hi: np.ndarray, size: int) -> np.ndarray:
    """How many of the intervals [lo, hi] hold each position below ``size``."""
    ok = lo <= hi
    return np.cumsum(np.bincount(lo[ok], minlength=size + 1)[: size + 1] - np.bincount(hi[ok] + 1, minlength=size + 1)[: size + 1])


def valley_depths(key: np.ndarray, doc: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Depths of the valleys of all positions; key: a number for each word of each text, doc: the text it is in, ascending.

    Returns the depth by position and the position of each word; texts lie ``block`` positions apart, so no block reaches into another text.
    """
    n = len(key)
    pos = np.arange(n, dtype=np.int64) + doc * block
    size = int(pos[-1]) + block + 2 if n else 2
    if n == 0:
        return np.zeros(size), pos
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    prev = np.full(n, -(10**9), dtype=np.int64)
    nxt = np.full(n, 10**12, dtype=np.int64)
    prev[order[1:][same]] = pos[order[:-1][same]]
    nxt[order[:-1][same]] = pos[order[1:][same]]
    shared = _spans(np.maximum(prev + 1, np.maximum(pos - block + 1, 0)), np.minimum(pos, prev + block), size)
    right = _spans(np.maximum(prev + 1, np.maximum(pos - block + 1, 0)), pos, size)
    left = _spans(pos + 1, np.minimum(nxt, pos + block), size)
    sim = (shared / np.sqrt(np.maximum(left * right, 1))).astype(np.float32)
    after = _sliding_max(sim, block)
    before = _sliding_max(sim[::-1], block)[::-1]
    return before + after - 2 * sim, pos


def analyse(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts one after another: where each begins, its strong boundaries, their scores, and for each character the last blank up to it."""
    kind_of, low_of = _char_tables()
    begins = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    small = np.minimum(cp, _LIMIT - 1)
    kind = kind_of[small]
    n = len(cp)
    first = np.zeros(n + 1, dtype=bool)
    first[begins[:-1]] = True
    first = first[:n]
    blank = (kind & _BLANK) > 0
    index = np.arange(n, dtype=np.int32)
    last_blank = np.maximum.accumulate(np.where(blank, index, -1).astype(np.int32)) if n else np.zeros(0, np.int32)

    cut = np.nonzero(blank[:-1] & ~blank[1:] & ~first[1:])[0] + 1 if n else np.zeros(0, np.int64)
    word_end = np.nonzero(~blank[:-1] & blank[1:] & ~first[1:])[0] if n else np.zeros(0, np.int64)
    at = np.searchsorted(word_end, cut) - 1
    before = word_end[np.maximum(at, 0)] if len(word_end) else np.zeros(len(cut), np.int64)
    doc_begin = begins[np.searchsorted(begins, cut, side="right") - 1]
    has = (at >= 0) & (before >= doc_begin) if len(word_end) else np.zeros(len(cut), bool)
    lf = (kind & _LF) > 0
    cr = (kind & _CR) > 0
    line = lf.copy()
    if n:
        line[:-1] |= cr[:-1] & ~lf[1:]
        line[-1] |= cr[-1]
    lines = np.concatenate([[0], np.cumsum(line)])
    breaks = lines[cut] - lines[np.where(has, before + 1, doc_begin)] if len(cut) else np.zeros(0, np.int64)
    stop = (kind & _STOP) > 0
    closed = (kind & _CLOSE) > 0
    ends = stop[before] | (closed[before] & (before > 0) & stop[np.maximum(before - 1, 0)]) if len(cut) and n else np.zeros(len(cut), bool)
    strong = has & (ends | (breaks > 0))
    cut, breaks = cut[strong], breaks[strong]

    word = (kind & _WORD) > 0
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    ws, we = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    joined = word[:-1] & word[1:] & first[1:] if n else np.zeros(0, bool)
    if joined.any():
        extra = np.nonzero(joined)[0] + 1
        ws, we = np.sort(np.concatenate([ws, extra])), np.sort(np.concatenate([we, extra]))
    long = we - ws >= CONTENT_CHARS
    ws, we = ws[long], we[long]
    doc = np.searchsorted(begins, ws, side="right") - 1
    with np.errstate(over="ignore"):
        c = low_of[small].astype(np.uint64) + np.uint64(1)
        base = np.uint64(0x100000001B3)
        if len(ws):
            c *= c * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
            begun = np.zeros(n, dtype=np.int64)
            begun[ws] = ws
            place = (np.arange(n) - np.maximum.accumulate(begun)).astype(np.uint64)
            c *= (place + np.uint64(1)) * base + (place * place) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c, dtype=np.uint64)])
            key = (total[we] - total[ws]) * np.uint64(0xD6E8FEB86659FD93) + doc.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        else:
            key = np.zeros(0, np.uint64)
    depth, pos = valley_depths(key, doc)
    if len(ws) and len(cut):
        w = np.searchsorted(ws, cut)
        cut_doc = np.searchsorted(begins, cut, side="right") - 1
        inner = (w < len(ws)) & (doc[np.minimum(w, len(ws) - 1)] == cut_doc)
        score = np.where(inner, depth[pos[np.minimum(w, len(ws) - 1)]], 0.0)
    else:
        score = np.zeros(len(cut))
    score = score + np.where(breaks > 1, PARAGRAPH, np.where(breaks == 1, LINE, 0.0))
    return begins, cut, score, last_blank


def pieces(length: int, cuts: list[int], scores: list[float], last_blank: np.ndarray, size: int, overlap: int, least: int) -> tuple[list[int], list[int], bool]:
    """Starts and ends of the pieces of a text, and whether a run without blanks was longer than a piece."""
    starts, ends, forced = [], [], False
    s = c = 0
    reach = size - overlap
    while length - s > size:
        hi = s + size
        top = min(hi, length - least) if length - least > c + reach // 2 else hi
        lo = max(s + size // 2, c + reach // 2)
        j = bisect_right(cuts, top)
        i = bisect_right(cuts, lo, 0, j)
        if i < j:
            part = scores[i:j]
            best = max(part)
            e = cuts[j - 1 - part[::-1].index(best)]
        else:
            i = bisect_right(cuts, c, 0, j)
            e = cuts[j - 1] if i < j else 0
            if e <= c:
                e = int(last_blank[hi - 1]) + 1
                if e <= c:
                    end = _run_end(last_blank, c, length, size)
                    if end - c <= size:
                        s, e = max(s, end - size), end
                    else:
                        e, forced = hi, True
        starts.append(s)
        ends.append(e)
        if e == length:
            return starts, ends, forced
        c, s = e, max(e - overlap, s + 1)
    starts.append(s)
    ends.append(length)
    return starts, ends, forced


def _run_end(last_blank: np.ndarray, c: int, length: int, size: int) -> int:
    """The first blank after ``c``, or the text's end, or just beyond ``size`` where the run goes on."""
    part = last_blank[c : min(length, c + size + 1)]
    after = np.nonzero(part >= c)[0]
    return c + int(after[0]) if len(after) else min(length, c + size + 1)


def split_texts(df: DataFrame, key: str, text: str, configs: DataFrame, with_text: bool = False) -> DataFrame:
    """(key, config_id, forced, starts, ends[, texts]): for each record and configuration whose ``chunk_size`` is less than the text's length.

    ``configs`` holds config_id, chunk_size, chunk_overlap, min_chunk_chars. Each piece is text[start:end] in code points; pieces cover
    the text, hold at most ``chunk_size`` and begin ``chunk_overlap`` before the previous one's end, later only where else a word
    would not fit. Cuts lie after blanks, at sentence, line and paragraph ends before others; ``forced`` is 1 if a run of more than
    ``chunk_size`` characters without space, tab, CR or LF made a cut inside it necessary, else 0.

    NULL and empty texts and those that fit have no row. Repeated rows come out repeated. Extra columns are ignored.
    A configuration with a NULL or non-positive size is skipped, NULL overlap and minimum count as 0, an overlap not below the size
    is an error. Configurations are taken in packs of ``CONFIG_PACK``, each a pass over the texts.
    """
    packs: list[list[tuple[int, int, int, int]]] = [[]]
    for r in configs.select("config_id", "chunk_size", "chunk_overlap", "min_chunk_chars").distinct().where("chunk_size > 0").toLocalIterator():
        if len(packs[-1]) == CONFIG_PACK:
            packs.append([])
        packs[-1].append((r[0], r[1], max(r[2] or 0, 0), max(r[3] or 0, 0)))
        if packs[-1][-1][2] >= r[1]:
            raise ValueError(f"configuration {r[0]}: the overlap {r[2]} is not below the size {r[1]}")
    return reduce(DataFrame.unionByName, (_split(df, key, text, sorted(use), with_text) for use in packs))


def _split(df: DataFrame, key: str, text: str, use: list[tuple[int, int, int, int]], with_text: bool) -> DataFrame:
    fields = [T.StructField(key, df.schema[key].dataType), T.StructField("config_id", T.IntegerType()), T.StructField("forced", T.IntegerType()), T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType()))]
    if with_text:
        fields.append(T.StructField("texts", T.ArrayType(T.StringType())))
    smallest = min((c[1] for c in use), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text__"):
            texts = b.column(1).to_pylist()
            begins, cuts, scores, last_blank = analyse(texts)
            bounds = np.searchsorted(cuts, begins)
            rows, ids, forced, starts, ends, parts, counts = [], [], [], [], [], [], []
            for i, t in enumerate(texts):
                a, z = int(begins[i]), int(begins[i + 1])
                mine = (cuts[bounds[i] : bounds[i + 1]] - a).tolist()
                score = scores[bounds[i] : bounds[i + 1]].tolist()
                blanks = last_blank[a:z] - a
                for k, size, overlap, least in use:
                    if z - a > size:
                        x, y, f = pieces(z - a, mine, score, blanks, size, overlap, least)
                        rows.append(i)
                        ids.append(k)
                        forced.append(int(f))
                        starts += x
                        ends += y
                        counts.append(len(x))
                        if with_text:
                            parts += [t[p:q] for p, q in zip(x, y)]
            at = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            cols = [b.column(0).take(pa.array(rows, type=pa.int64())), pa.array(ids, type=pa.int32()), pa.array(forced, type=pa.int32()), pa.ListArray.from_arrays(at, pa.array(starts, type=pa.int32())), pa.ListArray.from_arrays(at, pa.array(ends, type=pa.int32()))]
            if with_text:
                cols.append(pa.ListArray.from_arrays(at, pa.array(parts, type=pa.string())))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    long = df.select(F.col(key), F.col(text).alias("text__")).where(F.length("text__") > smallest) if use else df.select(F.col(key), F.col(text).alias("text__")).limit(0)
    return long.mapInArrow(run, T.StructType(fields))
