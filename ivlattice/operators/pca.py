"""Principal components of array columns: distributed moments, a small eigenproblem, distributed scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The driver solves a square problem of this many dimensions at most.
MOST_DIMENSIONS = 2_048


@dataclass(frozen=True)
class Components:
    mean: np.ndarray
    axes: np.ndarray
    ratio: np.ndarray

    def scores(self, vector: str | Column) -> Column:
        """Scores as a column expression (array<double>)."""
        v = F.col(vector) if isinstance(vector, str) else vector
        centred = F.zip_with(v.cast("array<double>"), F.lit(self.mean.tolist()), lambda a, b: a - b)
        dot = lambda axis: F.aggregate(F.zip_with(centred, F.lit(axis.tolist()), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        return F.array(*[dot(a) for a in self.axes])


def _dimensions(df: DataFrame, vector: str) -> int:
    size = df.filter(F.col(vector).isNotNull()).select(F.size(vector).alias("n")).limit(1).collect()
    if not size:
        raise ValueError("no vectors")
    m = size[0]["n"]
    if m > MOST_DIMENSIONS:
        raise ValueError(f"{m} dimensions; at most {MOST_DIMENSIONS}")
    return m


def moments(df: DataFrame, vector: str) -> DataFrame:
    """i, count, mean (of dimension i) and row i of the population covariance, over all non-null vectors of one length.

    Each task sums count, mean and products about its own mean, and whole rows of those
    blocks are merged by the exact rule for two parts, so large means cancel nothing.
    """
    m = _dimensions(df, vector)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, mean, products = 0, np.zeros(m), np.zeros((m, m))
        for pdf in batches:
            x = np.stack(pdf["v"].to_numpy()).astype(float)
            own = x.mean(0)
            centred, gap = x - own, own - mean
            products += centred.T @ centred + np.outer(gap, gap) * (n * len(x) / (n + len(x)))
            mean += gap * (len(x) / (n + len(x)))
            n += len(x)
        if n:
            yield pd.DataFrame({"i": np.arange(m), "n": n, "means": [mean] * m, "products": list(products)})

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for i, g in pdf.groupby("i"):
            n = g["n"].to_numpy(float)
            means = np.stack(g["means"].to_numpy())
            mean = n @ means / n.sum()
            gap = means - mean
            row = np.stack(g["products"].to_numpy()).sum(0) + (n * gap[:, i]) @ gap
            out.append((i, int(n.sum()), mean[i], row / n.sum()))
        return pd.DataFrame(out, columns=["i", "count", "mean", "covariance"])

    rows = df.filter(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    blocks = rows.mapInPandas(part, "i int, n long, means array<double>, products array<double>")
    return blocks.groupBy("i").applyInPandas(merged, "i int, count long, mean double, covariance array<double>")


def fit(df: DataFrame, vector: str, n: int) -> Components:
    """Components of all non-null vectors of one length.

    The driver gets one covariance row per dimension, MOST_DIMENSIONS at most. Signs
    are fixed so that each axis's largest entry is positive; a table without variance
    has ratio 0.
    """
    rows = moments(df, vector).orderBy("i").toPandas()
    mean, cov = rows["mean"].to_numpy(float), np.stack(rows["covariance"].to_numpy()).astype(float)
    value, axes = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(value)[::-1][:n]
    axes = axes[:, order].T
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    spread = max(float(np.trace(cov)), 0.0)
    ratio = np.maximum(value[order], 0) / spread if spread > 1e-12 else np.zeros(len(order))
    return Components(mean, axes, ratio)
