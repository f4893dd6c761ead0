"""Embedders: what turns texts into vectors is a parameter.

An embedder has ``embed(rows, text, name)``, which adds the column ``name``, an array of doubles, to a DataFrame; null where there is none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import hashed_vector


class Embedder(Protocol):
    name: str

    def embed(self, rows: DataFrame, text: Column, name: str) -> DataFrame: ...


@dataclass(frozen=True)
class HashedTrigrams:
    """Counts of hashed trigrams of the lower-cased text: built in, all in Spark SQL."""

    dims: int = 64
    name: str = "trigrams"

    def embed(self, rows: DataFrame, text: Column, name: str) -> DataFrame:
        return rows.withColumn(name, F.when(text.isNotNull(), hashed_vector(F.lower(text), self.dims)))


@dataclass(frozen=True)
class Precomputed:
    """Vectors from a table (text, vector), such as an artifact of another system; texts it lacks have none."""

    vectors: DataFrame
    name: str = "precomputed"

    def embed(self, rows: DataFrame, text: Column, name: str) -> DataFrame:
        known = self.vectors.groupBy("text").agg(F.min("vector").alias(name))  # one for each text
        return rows.withColumn("_text", text).hint("merge").join(known.withColumnRenamed("text", "_text"), "_text", "left").drop("_text")


@dataclass(frozen=True)
class Model:
    """A model that ``load`` builds once in each Python worker; it maps a list of texts to a list of vectors, batch by batch."""

    load: Callable[[], Callable[[list[str]], list[list[float]]]]
    name: str = "model"

    def embed(self, rows: DataFrame, text: Column, name: str) -> DataFrame:
        load = self.load

        @F.pandas_udf("array<double>")
        def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for batch in batches:
                known = batch.notna()
                out = pd.Series([None] * len(batch), index=batch.index, dtype=object)
                if known.any():
                    out[known] = pd.Series([[float(x) for x in v] for v in model(batch[known].tolist())], index=batch.index[known], dtype=object)
                yield out

        return rows.withColumn(name, vectors(text))
