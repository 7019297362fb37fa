"""Vector functions; numpy over Arrow batches where an expression per element would be slow."""

from __future__ import annotations

import hashlib
import time

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine(a: str, b: str) -> Column:
    """Cosine of two array columns; 0 where one is NULL, empty, of another length or all zero."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.zeros(len(x))
        sizes = {-1 if v is None else len(v) for c in (x, y) for v in c}
        if len(sizes) == 1 and min(sizes) > 0:
            a, b = np.stack(x.to_list()).astype(np.float64), np.stack(y.to_list()).astype(np.float64)
            n = np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))
            return pd.Series(np.divide(np.einsum("ij,ij->i", a, b), n, out=out, where=n > 0))
        for i, (p, q) in enumerate(zip(x, y)):
            if p is not None and q is not None and len(p) == len(q) and len(p):
                p, q = np.asarray(p, dtype=np.float64), np.asarray(q, dtype=np.float64)
                n = np.sqrt((p @ p) * (q @ q))
                out[i] = p @ q / n if n > 0 else 0.0
        return pd.Series(out)

    return run(a, b)


def hash_embedding(text: str, dims: int) -> list[float]:
    """A stable stand-in vector: digits to the base 7 of the text's SHA-256, spread over [-1, 1) and normalised."""
    n = int.from_bytes(hashlib.sha256(text.encode()).digest(), "big")
    digits = []
    while len(digits) < dims:
        n, d = divmod(n, 7)
        digits.append(d)
    v = np.array(digits) * (2 / 7) - 1
    return (v / np.linalg.norm(v)).tolist()


class Embedder:
    """An embedding backend: ``embed`` takes a list of texts. ``name`` is mock, local or remote."""

    def __init__(self, name: str, embed, dims: int | None = None) -> None:
        self.name, self.embed, self.dims = name, embed, dims

    def column(self, text: str | Column) -> Column:
        embed = self.embed

        @F.pandas_udf("array<double>")
        def run(t: pd.Series) -> pd.Series:
            known = [x for x in dict.fromkeys(t) if x is not None]
            got = dict(zip(known, embed(known))) if known else {}
            return pd.Series([None if x is None else list(map(float, got[x])) for x in t], dtype=object)

        return run(text)


def _local(model: str):
    def embed(texts: list[str]) -> list[list[float]]:
        from sentence_transformers import SentenceTransformer

        if not hasattr(embed, "model"):
            embed.model = SentenceTransformer(model)
        return embed.model.encode(texts).tolist()

    return embed


def by_request(request, batch: int = 100, pause: float = 0.05):
    """Embeds through ``request``, which takes at most ``batch`` texts and gives (index, vector) pairs in any order, or vectors in order; waits ``pause`` seconds between requests."""

    def embed(texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for i in range(0, len(texts), batch):
            if i:
                time.sleep(pause)
            got = list(request(texts[i : i + batch]))
            out += [v for _, v in sorted(got, key=lambda x: x[0])] if got and isinstance(got[0], tuple) else got
        return out

    return embed


def create_embedder(env: dict[str, str], use_mock: bool | None = None, remote=None, model: str = "all-MiniLM-L6-v2", dims: int = 384) -> Embedder:
    """Mock if asked for or if LOCAL_EMBEDDINGS is off, remote with a real OPENAI_API_KEY and a client, else the local model."""
    if use_mock or env.get("LOCAL_EMBEDDINGS", "true").strip().lower() in ("false", "0", "no"):
        return Embedder("mock", lambda texts: [hash_embedding(t, dims) for t in texts], dims)
    key = env.get("OPENAI_API_KEY", "")
    if use_mock is None and key.startswith("sk-") and not key.startswith("sk-or-") and remote is not None:
        return Embedder("remote", by_request(remote))
    return Embedder("local", _local(model), dims)
