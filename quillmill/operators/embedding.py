"""Embedding: providers in Arrow batches, checked before and after."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT
from .publication import embedding_error

Provider = Callable[[list[str]], list[list[float]]]


def hash_provider(dimensions: int) -> Provider:
    """A deterministic stand-in for a model: unit vectors from a digest of the text."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            seed = int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "little")
            v = np.random.default_rng(seed).normal(size=dimensions)
            out.append((v / np.linalg.norm(v)).astype(np.float32).tolist())
        return out

    return embed


class EmbeddingRejected(Exception):
    """A provider's refusal of a request that no retry would mend."""


_OUT = pa.struct([("vector", pa.list_(pa.float32())), ("error", pa.string())])
_RESULT = T.StructType([T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())])


def error_code(error: Exception) -> str:
    """The code of what was raised: a refusal's own, else the class's name."""
    return "EMBEDDING_REQUEST_REJECTED" if isinstance(error, EmbeddingRejected) else type(error).__name__


def _embedded(provider: Provider, texts: list[str]) -> list[dict]:
    """A vector or an error for each text.  Where a call for all of them fails, each is asked for alone: one text's failure is its own."""
    try:
        vectors = provider(texts)
        if len(vectors) != len(texts):
            raise ValueError("a vector for each text was asked for")
        return [{"vector": v, "error": None} for v in vectors]
    except Exception as error:  # whatever a provider raises becomes data
        if len(texts) <= 1:
            return [{"vector": None, "error": error_code(error)} for _ in texts]
        return [x for text in texts for x in _embedded(provider, [text])]


def embed(df: DataFrame, provider: Provider, *, content: str = "content", out: str = "embedding", error: str = "provider_error") -> DataFrame:
    """``df`` with the provider's vector of each content, or the code of what it raised as ``error``.

    One call for each Arrow batch.  ``EmbeddingRejected`` is final; other exceptions go by
    their class's name, and are tried again by whoever reads them.
    """

    @F.arrow_udf(_RESULT)
    def vectors(texts: pa.Array) -> pa.Array:
        return pa.array(_embedded(provider, texts.to_pylist()), _OUT)

    return df.withColumn("__embedded", vectors(F.col(content))).withColumn(out, F.col("__embedded.vector")).withColumn(error, F.col("__embedded.error")).drop("__embedded")


def embed_and_validate(df: DataFrame, provider: Provider, *, dimensions: int = DEFAULT.dimensions) -> DataFrame:
    """Vectors and ``embedding_error``: the provider's error, else what is wrong with the vector."""
    return embed(df, provider).withColumn("embedding_error", F.coalesce("provider_error", embedding_error(F.col("embedding"), dimensions))).drop("provider_error")
