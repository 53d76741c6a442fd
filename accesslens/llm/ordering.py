"""Rows in the order of their key, in shards that fit a task."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a shard, about.
SHARD_ROWS = 8192
#: Sorts where NULL keys do: before all others.
NULL_KEY = -(1 << 63)


@dataclass(frozen=True)
class Shards:
    """Ranges of keys: shard k holds bounds[k - 1] <= key < bounds[k]."""

    bounds: np.ndarray

    @property
    def count(self) -> int:
        return len(self.bounds) + 1

    @classmethod
    def of(cls, keys: DataFrame, rows: int = SHARD_ROWS) -> Shards:
        """Cut at quantiles of the one `key` column; equal keys stay together."""
        n = -(-keys.count() // rows)
        if n <= 1:
            return cls(np.zeros(0, np.int64))
        cuts = keys.approxQuantile("key", [k / n for k in range(1, n)], 0.25 / n)
        return cls(np.unique(np.array(cuts, np.float64).astype(np.int64)))

    def column(self, key: Column) -> Column:
        bounds = self.bounds

        @F.pandas_udf("int")
        def shard(keys: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(bounds, keys.to_numpy(), side="right").astype(np.int32))

        return shard(key)


def key_column(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_KEY))
