"""Chunk embeddings with a pluggable model."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from articleflow import constants as C
from articleflow.session import once

Embedder = Callable[[list[str]], np.ndarray]

_TOKEN = re.compile(r"[^\W_]+")
_MEMO_LIMIT = 500_000
# Texts given to a model at a time: an Arrow batch may hold ten thousand.
MODEL_ROWS = 1_000


def hash_embedder(dim: int = C.EMBEDDING_DIM) -> Callable[[], Embedder]:
    """Offline default model: signed feature hashing of the lower-cased tokens, L2-normalised.

    The token's MD5 gives the dimension (first 8 hex digits) and the sign (9th digit below 8 is plus).
    """

    class Places(dict):
        """A token's dimension; behind ``dim`` those of the tokens that count negative."""

        def __missing__(self, token: str) -> int:
            digest = hashlib.md5(token.encode("utf-8", "surrogatepass")).hexdigest()
            if len(self) >= _MEMO_LIMIT:
                self.clear()
            self[token] = place = int(digest[:8], 16) % dim + (0 if digest[8] < "8" else dim)
            return place

    def load() -> Embedder:
        places = Places()

        def embed(texts: list[str]) -> np.ndarray:
            words = [_TOKEN.findall(text.lower()) for text in texts]
            counts = np.fromiter(map(len, words), np.int64, len(words))
            spots = np.fromiter(map(places.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
            cells = np.repeat(np.arange(len(words)) * (2 * dim), counts) + spots
            both = np.bincount(cells, minlength=len(words) * 2 * dim).reshape(len(words), 2, dim)
            out = (both[:, 0] - both[:, 1]).astype(np.float64)
            norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
            return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)

        return embed

    return load


def embed_chunks(chunks: DataFrame, load: Callable[[], Embedder] | None = None, text: str = "text",
                 output: str = "embedding") -> DataFrame:
    """Adds the embedding column; the model is loaded once per task and fed up to ``MODEL_ROWS`` texts at a time."""
    loader = load or hash_embedder()

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = loader()
        for batch in batches:
            lists = []
            for start in range(0, max(1, len(batch)), MODEL_ROWS):
                texts = batch.slice(start, MODEL_ROWS).to_pylist()
                vectors = np.asarray(model([t or "" for t in texts]), dtype=np.float32)
                starts = np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1]
                lists.append(pa.ListArray.from_arrays(pa.array(starts), pa.array(vectors.ravel())))
            yield pa.concat_arrays(lists)

    return chunks.withColumn(output, once(embed)(F.col(text)))


def mock_embedding(dim: int = C.EMBEDDING_DIM) -> Column:
    """The zero vector that stands in for a missing model."""
    return F.array_repeat(F.lit(0.0).cast("float"), dim)


def embedding_or_mock(embedding: Column, dim: int = C.EMBEDDING_DIM) -> Column:
    return F.coalesce(embedding, mock_embedding(dim))


def validate_embedding_dim(chunks: DataFrame, dim: int = C.EMBEDDING_DIM,
                           column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) by vector length."""
    right_size = F.coalesce(F.size(column) == dim, F.lit(False))
    return chunks.filter(right_size), chunks.filter(~right_size)
