"""Estimators that learn on one table and transform another: fit() returns a small table or dict, apply() is projection."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import special

CLIP = 5.0


def _clipped(x, clip: float | None):
    return x if clip is None else F.greatest(F.lit(-clip), F.least(F.lit(clip), x))


@dataclass
class Standard:
    """(x - mean) / population deviation, clipped; a deviation of 0 counts as 1."""

    columns: list[str]
    clip: float | None = CLIP
    state: dict = field(default_factory=dict)

    def fit(self, train: DataFrame) -> "Standard":
        row = train.agg(*(f(c).alias(f"{n}{c}") for c in self.columns for n, f in (("m_", F.avg), ("s_", F.stddev_pop)))).first()
        self.state = {c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in self.columns}
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: _clipped((F.col(c) - m) / s, self.clip) for c, (m, s) in self.state.items()})


@dataclass
class Robust:
    """(x - median) / interquartile range, clipped."""

    columns: list[str]
    clip: float | None = CLIP
    state: dict = field(default_factory=dict)

    def fit(self, train: DataFrame) -> "Robust":
        row = train.agg(*(F.percentile(c, [0.25, 0.5, 0.75]).alias(c) for c in self.columns)).first()
        self.state = {c: (row[c][1], (row[c][2] - row[c][0]) or 1.0) for c in self.columns if row[c]}
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: _clipped((F.col(c) - m) / s, self.clip) for c, (m, s) in self.state.items()})


@dataclass
class Impute:
    """Missing values become the training mean or median, or 0."""

    columns: list[str]
    strategy: str = "median"
    state: dict = field(default_factory=dict)

    def fit(self, train: DataFrame) -> "Impute":
        if self.strategy == "zero":
            self.state = dict.fromkeys(self.columns, 0.0)
        else:
            how = {"mean": F.avg, "median": F.median}[self.strategy]
            row = train.agg(*(how(c).alias(c) for c in self.columns)).first()
            self.state = {c: 0.0 if row[c] is None else row[c] for c in self.columns}
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        return df.fillna(self.state)


@dataclass
class Quantiles:
    """The share of training values below, interpolated between n_quantiles points; or its normal deviate."""

    columns: list[str]
    n_quantiles: int = 100
    normal: bool = False
    state: dict = field(default_factory=dict)

    def fit(self, train: DataFrame) -> "Quantiles":
        at = [i / (self.n_quantiles - 1) for i in range(self.n_quantiles)]
        row = train.agg(*(F.percentile(c, at).alias(c) for c in self.columns)).first()
        self.state = {c: list(row[c]) for c in self.columns if row[c]}
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        made, last = {}, self.n_quantiles - 1
        for c, points in self.state.items():
            held = F.lit(points)
            k = F.least(F.greatest(F.size(_below(held, c)) - 1, F.lit(0)), F.lit(last - 1))
            lo, hi = F.get(held, k), F.get(held, k + 1)
            share = (k + F.coalesce(F.try_divide(F.col(c) - lo, hi - lo), F.lit(0.0))) / last
            share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
            made[c] = special.norm_ppf(F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), share))) if self.normal else share
        return df.withColumns(made)


def _below(points, column: str):
    return F.filter(points, lambda p: p <= F.col(column))


@dataclass
class Pca:
    """Principal components of the training covariance: a number of them, or as many as give a share of the variance."""

    columns: list[str]
    n: float = 0.95
    state: dict = field(default_factory=dict)

    def fit(self, train: DataFrame) -> "Pca":
        import numpy as np

        pairs = [(a, b) for i, a in enumerate(self.columns) for b in self.columns[i:]]
        row = train.agg(*(F.avg(c).alias(f"m_{c}") for c in self.columns), *(F.covar_samp(a, b).alias(f"c_{i}") for i, (a, b) in enumerate(pairs))).first()
        k = len(self.columns)
        m = np.zeros((k, k))
        for i, (a, b) in enumerate(pairs):
            x, y = self.columns.index(a), self.columns.index(b)
            m[x, y] = m[y, x] = row[f"c_{i}"] or 0.0
        values, vectors = np.linalg.eigh(m)
        values, vectors = values[::-1], vectors[:, ::-1]
        share = np.cumsum(values) / max(values.sum(), 1e-300)
        keep = int(self.n) if self.n >= 1 else int(np.searchsorted(share, self.n) + 1)
        # the largest loading of a component is positive, so its sign is settled
        signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(k)])
        self.state = {"mean": [row[f"m_{c}"] or 0.0 for c in self.columns], "vectors": (vectors * signs)[:, :keep].T.tolist()}
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        made = {}
        for i, v in enumerate(self.state["vectors"]):
            total = F.lit(0.0)
            for c, m, w in zip(self.columns, self.state["mean"], v, strict=True):
                total = total + (F.coalesce(F.col(c), F.lit(m)) - m) * w
            made[f"pc{i + 1}"] = total
        return df.withColumns(made).drop(*self.columns)


@dataclass
class Chain:
    """Steps one after the other, each fitted on what the ones before make of the training table."""

    steps: list

    def fit(self, train: DataFrame) -> "Chain":
        for step in self.steps:
            train = step.fit(train).apply(train)
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step.apply(df)
        return df
