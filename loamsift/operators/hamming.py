"""Pairs of vectors with near binary codes, by multi-index hashing with neighbour probing.

A vector's code is the signs of its projections. It is cut into substrings, each with an index of its own. Two codes agree in some substring up to one bit
whenever they lie within a Hamming distance of twice the number of substrings less one (pigeonhole). A substring has as many bits as the number of
vectors has binary digits, so that a bucket holds about one vector however many there are; the number of substrings follows from the recall asked for.

The rows of an index are partitioned by the substring's first bits into groups of bounded size. A group is sorted; every one-bit neighbour of its substrings
is looked up in it by binary search. Neighbours over the first bits lie in another group, to which the row is sent as a guest. What is retrieved is checked at once on ``CHECK`` further bits, so that only near pairs leave
the group. A group that is much larger, as of a third of all rows that are near to each other, is cut into blocks, and every two of its blocks are a group of their own;
the pairs retrieved are checked in steps of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tables import written

#: Bits on which retrieved pairs are checked.
CHECK = 384
#: Rows of an index that a group holds on average at most.
GROUP_ROWS = 400_000
#: Retrieved pairs that are checked at once.
STEP = 1 << 20


def angle_share(cosine: float) -> float:
    """The probability that one bit differs."""
    return math.acos(cosine) / math.pi


def plan(rows: int, cosine: float, recall: float) -> tuple[int, int]:
    """(bits of a substring, number of substrings) for so many vectors."""
    bits = max(8, math.ceil(math.log2(max(rows, 2))))
    p = angle_share(cosine)
    hit = (1 - p) ** bits + bits * p * (1 - p) ** (bits - 1)
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit)))


def near_bits(cosine: float, deviations: float = 4.5, bits: int = CHECK) -> int:
    """The distance on ``bits`` bits of random projections that a pair of this cosine exceeds with a probability of about 3e-6 (four and a half deviations)."""
    p = angle_share(cosine)
    return math.ceil(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def near_bits_of_part(near: int, deviations: float = 4.5) -> int:
    """The distance on the first 64 of the bits checked that a pair at the limit exceeds with a probability of about 3e-6; looked at first, as it rules out nearly all."""
    # ``near`` lies 4.5 deviations above the mean, so the mean is a little lower; taking ``near`` for the mean would let more pass, never fewer.
    lowest, highest = 0.0, near / CHECK
    for _ in range(50):
        p = (lowest + highest) / 2
        if CHECK * p + deviations * math.sqrt(CHECK * p * (1 - p)) < near:
            lowest = p
        else:
            highest = p
    return math.ceil(64 * highest + deviations * math.sqrt(64 * highest * (1 - highest)))


def _codes(df: DataFrame, key: str, vector: str, planes: np.ndarray, bits: int, bands: int, top: int) -> DataFrame:
    """(key, side, part, code, guest, sketch): a row for each substring, and one as a guest for each of its first ``top`` bits."""
    dims = planes.shape[0]
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("side", T.BooleanType()), T.StructField("part", T.LongType()), T.StructField("code", T.LongType()), T.StructField("guest", T.BooleanType()), T.StructField("sketch", T.BinaryType())])
    weight = 1 << np.arange(bits, dtype=np.int64)
    low = bits - top

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                b = batch.slice(at, 2000)
                n = b.num_rows
                x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                signs = x @ planes >= 0
                code = (signs[:, CHECK : CHECK + bits * bands].reshape(n, bands, bits) * weight).sum(axis=2)
                sketch = np.packbits(signs[:, :CHECK], axis=1)
                flips = np.concatenate([[0], 1 << np.arange(low, bits, dtype=np.int64)])
                each = code[:, :, None] ^ flips
                part = (each >> low) + (np.arange(bands, dtype=np.int64) << top)[None, :, None]
                # Of two rows that differ in a first bit the one that has it set is the other's guest.
                use = np.nonzero(((flips == 0) | (code[:, :, None] & flips != 0)).reshape(-1))[0]
                row = pa.array(use // (bands * len(flips)))
                prints = pa.FixedSizeBinaryArray.from_buffers(pa.binary(CHECK // 8), n, [None, pa.py_buffer(sketch.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(part.reshape(-1)[use]), pa.array(code.reshape(-1)[use // len(flips)]), pa.array(use % len(flips) > 0), prints.take(row)], names=schema.names)

    return df.select(key, "side", F.col(vector).cast("array<double>")).mapInArrow(run, schema)


def _ranges(codes: np.ndarray, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.searchsorted(codes, probes, "left"), np.searchsorted(codes, probes, "right")


def _pairs(codes: np.ndarray, probes: np.ndarray, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places (i, j) with probes[i] == codes[j], in steps of bounded size; of an array with itself only j > i."""
    lo, hi = _ranges(codes, probes)
    if own:
        lo = np.maximum(lo, np.arange(len(probes)) + 1)
    count = np.maximum(hi - lo, 0)
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    for at in range(0, total, STEP):
        k = np.arange(at, min(at + STEP, total))
        i = np.searchsorted(ends, k, "right")
        yield i, lo[i] + k - (ends[i] - count[i])


def _cells(indexed: DataFrame, key: str, group_rows: int) -> DataFrame:
    """Adds lo, hi and block: a group of more than twice ``group_rows`` rows becomes blocks, and each row goes to the cells of its block with every block."""
    large = written(indexed.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > 2 * group_rows), "large")
    blocks = F.coalesce(F.ceil(F.col("n") / group_rows), F.lit(1)).cast("long")
    rows = indexed.join(large, "part", "left").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.withColumn("lo", F.least("block", "o")).withColumn("hi", F.greatest("block", "o")).drop("n", "blocks", "o")


def near_codes(left: DataFrame, right: DataFrame | None, key: str, vector: str, planes: np.ndarray, rows: int, bits: int, bands: int, near: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(a, b), distinct: keys of vectors that agree in a substring up to one bit and differ in at most ``near`` of ``CHECK`` bits.

    Pairs of ``left`` with ``right``, or within ``left`` where ``right`` is None (in either order, once). ``planes`` has CHECK columns, at random, for the check, and bits * bands for the substrings; ``rows``
    is how many vectors there are. Vectors must be usable and differ from each other (equal ones make a bucket that is searched pair by pair).
    """
    top = min(bits - 1, math.ceil(math.log2(rows / group_rows))) if rows > group_rows else 0
    two = right is not None
    both = left.select(key, F.lit(False).alias("side"), vector)
    if right is not None:
        both = both.unionByName(right.select(key, F.lit(True).alias("side"), vector))
    indexed = _codes(both, key, vector, planes, bits, bands, top)
    kind = left.schema[key].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    low = bits - top
    # No group can be too large where there are fewer rows.
    cells = rows > group_rows
    indexed = _cells(indexed, key, group_rows) if cells else indexed.withColumns({c: F.lit(0).cast("long") for c in ("lo", "hi", "block")})

    first = near_bits_of_part(near)

    def search(table: pa.Table) -> pa.Table:
        code, guest = table.column("code").to_numpy(), table.column("guest").to_numpy()
        # All that belongs to a row lies in the order of the codes, guests last.
        order = np.lexsort((code, guest))
        n = int((~guest).sum())
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint64).reshape(-1, CHECK // 64)[order]
        head = np.ascontiguousarray(sketch[:, 0])
        code, side, block = (table.column(k).to_numpy()[order] for k in ("code", "side", "block"))
        cross = table.column("lo")[0] != table.column("hi")[0]
        c = code[:n]
        found: list[np.ndarray] = []

        def keep(x: np.ndarray, y: np.ndarray) -> None:
            ok = np.bitwise_count(head[x] ^ head[y]) <= first
            if two:
                ok &= side[x] != side[y]
            if cross:
                ok &= block[x] != block[y]
            x, y = x[ok], y[ok]
            ok = np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1) <= near
            x, y = x[ok], y[ok]
            if two:
                x, y = np.where(side[x], y, x), np.where(side[x], x, y)
            found.append(np.stack([x, y]))

        for i, j in _pairs(c, c, True):
            keep(i, j)
        for bit in range(low):
            zero = np.nonzero((c >> bit & 1) == 0)[0]
            for i, j in _pairs(c, c[zero] | (1 << bit), False):
                keep(zero[i], j)
        if n < len(code):
            part = int(table.column("part")[0].as_py()) & ((1 << top) - 1)
            moved = (code[n:] & ((1 << low) - 1)) | (part << low)
            for i, j in _pairs(c, moved, False):
                keep(n + i, j)
        got = np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=np.int64)
        keys = table.column(key).combine_chunks()
        return pa.table([keys.take(pa.array(order[got[0]])), keys.take(pa.array(order[got[1]]))], names=["a", "b"])

    pairs = indexed.groupBy("part", "lo", "hi").applyInArrow(search, schema)
    return pairs.distinct() if two else pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
