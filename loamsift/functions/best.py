"""The k best of each query over the batches of a partition."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Candidates that are held before they are cut to the k best.
HELD = 100_000


class RunningBest:
    """Keeps, over all batches offered, the ``k`` best (score, key) of each query: the highest score first, then the smallest key."""

    def __init__(self, queries: int, k: int, key: pa.DataType) -> None:
        self.k, self.least = k, np.full(queries, -np.inf)
        self.schema = pa.schema([("query", pa.int64()), ("order", pa.float64()), ("score", pa.float64()), ("key", key)])
        self.parts: list[pa.Table] = []
        self.rows = 0

    def offer(self, keys: pa.Array, order: np.ndarray, scores: np.ndarray) -> None:
        """Scores of records by queries, and what they are ordered by; a record whose order is -inf is none for the query."""
        i, j = np.nonzero((order >= self.least) & (order > -np.inf))
        if len(i):
            self.parts.append(pa.Table.from_arrays([pa.array(j), pa.array(order[i, j]), pa.array(scores[i, j]), keys.take(pa.array(i))], schema=self.schema))
            self.rows += len(i)
            if self.rows > HELD:
                self._cut()

    def _cut(self) -> None:
        t = pa.concat_tables(self.parts)
        t = t.take(pc.sort_indices(t, [("query", "ascending"), ("order", "descending"), ("key", "ascending")]))
        q = t.column("query").to_numpy()
        new = np.ones(len(q), dtype=bool)
        new[1:] = q[1:] != q[:-1]
        nth = np.arange(len(q)) - np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))
        keep = nth < self.k
        last = nth == self.k - 1
        self.least[q[last]] = t.column("order").to_numpy()[last]
        t = t.filter(pa.array(keep)).combine_chunks()
        self.parts, self.rows = [t], t.num_rows

    def result(self) -> pa.Table | None:
        if not self.parts:
            return None
        self._cut()
        return self.parts[0]
