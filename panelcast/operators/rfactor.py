"""Triangular factors per key by tall-skinny QR.

The factor R of a key's rows Z (Z = QR) is the one statistic of the model layer: as small as the
cross-product Z'Z = R'R, but its condition is that of Z, not its square, and Householder QR treats every
column at its own scale. Rows fold into a factor batch by batch in each partition; the factors of a key
are stacked and factored again after one shuffle, so no task holds a key's rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

__all__ = ["factor", "pack", "unpack", "width", "r_factors", "merge_factors"]

FLUSH_AT = 20_000  # keys whose factors a map task holds at once


def factor(z: np.ndarray) -> np.ndarray:
    """Square triangular factor of ``z`` (rows x d), zero rows below a short one. A tall skinny QR
    through one more column-scaled step is not needed: Householder reflections act per column."""
    d = z.shape[1]
    if not np.isfinite(z).all():
        return np.full((d, d), np.nan)
    r = np.zeros((d, d))
    part = np.linalg.qr(z, mode="r")
    r[: len(part)] = part
    return r


def pack(r: np.ndarray) -> np.ndarray:
    return r[np.triu_indices(len(r))]


def unpack(values, d: int) -> np.ndarray:
    r = np.zeros((d, d))
    r[np.triu_indices(d)] = np.asarray(values, float)
    return r


def width(packed) -> int:
    """Columns of a packed factor."""
    return (math.isqrt(8 * len(packed) + 1) - 1) // 2


def r_factors(df: DataFrame, key_cols: Sequence[str], d: int, rows_of: Callable[[pd.DataFrame], np.ndarray],
              counts_of: Callable[[pd.DataFrame], list[float]]) -> DataFrame:
    """(keys, counts array, r array): per key, the sums of ``counts_of`` and the packed factor of the
    rows that ``rows_of`` builds (n x d) from a key's part of an Arrow batch. NULL keys are keys."""
    key_cols = list(key_cols)

    def frame(held: dict) -> pd.DataFrame:
        keys = list(held)
        out = {c: [k[i] for k in keys] for i, c in enumerate(key_cols)}
        return pd.DataFrame(out | {"counts": [held[k][0] for k in keys], "r": [pack(held[k][1]) for k in keys]})

    def add(held: dict, key: tuple, counts, z: np.ndarray) -> None:
        if key in held:
            held[key][0] = held[key][0] + counts
            if len(z):
                held[key][1] = factor(np.vstack([held[key][1], z]))
        else:
            held[key] = [np.asarray(counts, float), factor(z) if len(z) else np.zeros((d, d))]

    def own(key) -> tuple:
        return tuple(None if pd.isna(k) else k for k in (key if isinstance(key, tuple) else (key,)))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for b in batches:
            for key, part in b.groupby(key_cols, sort=False, dropna=False):
                add(held, own(key), np.asarray(counts_of(part), float), rows_of(part))
            if len(held) >= FLUSH_AT:
                yield frame(held)
                held = {}
        if held:
            yield frame(held)

    fields = [StructField(df.schema[c].name, df.schema[c].dataType) for c in key_cols]
    numbers = ArrayType(DoubleType())
    schema = StructType([*fields, StructField("counts", numbers), StructField("r", numbers)])
    return merge_factors(df.mapInPandas(fold, schema), key_cols)


def merge_factors(parts: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """One row per key of (keys, counts, r): counts added, factors stacked and factored again. Keys may have factors
    of different widths. The rows of a key arrive sorted and are folded as they come."""
    key_cols = list(key_cols)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, counts, r = None, None, None

        def row() -> pd.DataFrame:
            return pd.DataFrame({**{c: [k] for c, k in zip(key_cols, own)}, "counts": [counts], "r": [pack(r)]})

        for b in batches:
            done = []
            for *key, more, packed in zip(*(b[c] for c in key_cols), b["counts"], b["r"]):
                key = tuple(None if pd.isna(k) else k for k in key)
                more, d = np.asarray(more, float), width(packed)
                if key == own:
                    counts, r = counts + more, factor(np.vstack([r, unpack(packed, d)]))
                    continue
                if own is not None:
                    done.append(row())
                own, counts, r = key, more, unpack(packed, d)
            if done:
                yield pd.concat(done)
        if own is not None:
            yield row()

    parts = parts.select(*key_cols, "counts", "r")
    ordered = parts.repartition(*[F.col(c) for c in key_cols]).sortWithinPartitions(*key_cols)
    return ordered.mapInPandas(merge, parts.schema)
