"""Text to vectors: a hashing default and a hook for any batch model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from saltmarsh.functions.text import TOKEN

DIMENSIONS = 768
# Components and tokens that are counted at once.
PIECE = 1 << 18


def token_digests(text: Column) -> Column:
    """First four bytes of the MD5 digest of every token of a text, one after the other."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))
    return F.unhex(F.array_join(F.transform(words, lambda w: F.substring(F.md5(w), 1, 8)), ""))


def hash_vectors(df: DataFrame, text: str = "text", dimensions: int = DIMENSIONS, name: str = "embedding", kind: str = "float") -> DataFrame:
    """Unit vectors of hashed token counts, ``float`` or ``double``.

    Tokens are found and hashed in the JVM; their components are counted in Arrow, a piece of a batch
    after the other, so that memory follows neither the batch nor its longest texts. Text without tokens gets the
    zero vector.
    """
    number = np.float32 if kind == "float" else np.float64

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch).to_numpy().astype(np.int64) // 4)
            low, most = 0, max(1, PIECE // dimensions)
            while low < len(batch):
                done = ends[low - 1] if low else 0
                high = max(min(low + most, int(np.searchsorted(ends, done + PIECE, "right"))), low + 1)
                # A component is the number in the digest's first bytes, modulo the dimensions.
                slots = np.frombuffer(b"".join(batch.slice(low, high - low).to_pylist()), ">u4").astype(np.int64) % dimensions
                rows = np.repeat(np.arange(high - low) * dimensions, np.diff(ends[low:high], prepend=done))
                counts = np.bincount(rows + slots, minlength=(high - low) * dimensions).reshape(-1, dimensions)
                length = np.sqrt(np.square(counts).sum(1).astype(float))
                values = (counts / np.maximum(length, 1)[:, None]).astype(number)
                yield pa.ListArray.from_arrays(pa.array(np.arange(high - low + 1) * dimensions, pa.int32()), pa.array(values.reshape(-1)))
                low = high

    return df.select(*df.columns, F.arrow_udf(count, f"array<{kind}>")(token_digests(F.col(text))).alias(name))


def model_vectors(
    df: DataFrame, embed: Callable[[list[str]], list[list[float]]], text: str = "text", name: str = "embedding", batch: int = 64
) -> DataFrame:
    """Vectors from a caller's batch function, called inside the tasks."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors: list[list[float]] = []
            texts = frame[text].fillna("").tolist()
            for start in range(0, len(texts), batch):
                vectors.extend(embed(texts[start : start + batch]))
            yield frame.assign(**{name: vectors})

    return df.mapInPandas(run, schema)
