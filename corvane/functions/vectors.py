"""Vector expressions and the deterministic offline embeddings."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 1536
EMBED_CHARS = 8000


def cosine(a: Column, b: Column) -> Column:
    """Inner product of unit vectors, never below 0; 0 when the sizes differ."""
    dot = F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
    )
    return F.when(F.size(a) == F.size(b), F.greatest(F.lit(0.0), dot)).otherwise(0.0)


def fit_dimensions(v: Column, dimensions: int) -> Column:
    """Cut or zero-pad to ``dimensions``, scale to unit length, 6 decimals."""
    cut = F.slice(v.cast("array<double>"), 1, dimensions)
    padded = F.concat(cut, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(dimensions) - F.size(cut))))
    norm = F.sqrt(F.aggregate(padded, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm == 0, padded).otherwise(F.transform(padded, lambda x: F.round(x / norm, 6)))


def hashed_tokens_embedding(dimensions: int = DIMENSIONS, chars: int = EMBED_CHARS):
    """Signed feature hashing of tokens, unit length: an offline embedding.

    Returns an Arrow UDF ``text -> array<double>``. Slot and sign of a token come from
    its digest, so equal texts get equal vectors on every executor.
    """

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        word = re.compile("[a-z0-9]+")
        slots: dict[str, tuple[int, float]] = {}
        out = []
        for text in texts.fillna(""):
            vector = np.zeros(dimensions)
            for token in word.findall(text[:chars].lower()):
                slot = slots.get(token)
                if slot is None:
                    digest = hashlib.sha256(token.encode()).digest()
                    slot = (int.from_bytes(digest[:4], "big") % dimensions, 1.0 if digest[4] % 2 else -1.0)
                    slots[token] = slot
                vector[slot[0]] += slot[1]
            norm = np.sqrt((vector * vector).sum())
            out.append(np.round(vector / norm, 6) if norm else vector)
        return pd.Series(out)

    return embed


def digest_chain_embedding(dimensions: int = DIMENSIONS):
    """Degraded fallback: bytes of a digest chain of the whole text, unit length."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts.fillna(""):
            seed = block = hashlib.sha256(text.encode("utf-8", "replace")).digest()
            raw = bytearray()
            while len(raw) < dimensions:
                block = hashlib.sha256(block + seed).digest()
                raw += block
            vector = np.frombuffer(bytes(raw[:dimensions]), dtype=np.uint8) / 127.5 - 1.0
            norm = np.sqrt((vector * vector).sum())
            out.append(np.round(vector / norm, 6) if norm else vector)
        return pd.Series(out)

    return embed


def provider_embedding(embed_texts, dimensions: int = DIMENSIONS, batch: int = 64, chars: int = EMBED_CHARS):
    """Arrow UDF around ``embed_texts(list[str]) -> list[list[float]]``.

    The remote call gets at most ``batch`` (1-256) texts of at most ``chars``
    characters; a reply of another length than the request fails the task.
    """
    batch = max(1, min(batch, 256))

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        cut = [t[:chars] for t in texts.fillna("")]
        out = []
        for start in range(0, len(cut), batch):
            part = cut[start : start + batch]
            vectors = embed_texts(part)
            if len(vectors) != len(part):
                raise RuntimeError("embedding reply row count did not match the request")
            for vector in vectors:
                full = np.zeros(dimensions)
                full[: min(len(vector), dimensions)] = vector[:dimensions]
                norm = np.sqrt((full * full).sum())
                out.append(np.round(full / norm, 6) if norm else full)
        return pd.Series(out)

    return embed
