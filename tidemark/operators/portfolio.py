"""Covariances, clustering and portfolio construction.

Moments come from one aggregation over long rows (t, i, x); only the matrix of the assets, whose size does not grow with
time, is handed to numpy, in one task for each group. Sizing rules are plain columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import special

MATRIX = "i long, j long, value double"


def covariance(rows: DataFrame, t: str = "t", i: str = "i", x: str = "x", ddof: int = 1) -> DataFrame:
    """i, j, value of the sample covariance; pairs meet within one t, where every asset has one row."""
    a = rows.select(F.col(t).alias("t"), F.col(i).alias("i"), F.col(x).alias("x"))
    wide = a.groupBy("t").agg(F.collect_list(F.struct("i", "x")).alias("v"))
    pairs = wide.select(F.explode("v").alias("a"), "v").select("a", F.explode("v").alias("b"))
    value = F.covar_samp("a.x", "b.x") if ddof else F.covar_pop("a.x", "b.x")
    return pairs.groupBy(F.col("a.i").alias("i"), F.col("b.i").alias("j")).agg(value.alias("value"))


def _matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    names = np.sort(pdf["i"].unique())
    return names, pdf.pivot(index="i", columns="j", values="value").loc[names, names].to_numpy()


def _apply(cov: DataFrame, fn, schema: str) -> DataFrame:
    """fn(names, matrix) -> DataFrame, in one task: the matrix of the assets."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return fn(*_matrix(pdf))

    return cov.groupBy().applyInPandas(run, schema)


def correlation(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sd = np.sqrt(np.diag(cov))
    return cov / np.outer(sd, sd), sd


def mp_edge(q: float, sigma2: float = 1.0) -> float:
    """Upper edge of the Marchenko-Pastur law for q = assets / observations."""
    return sigma2 * (1 + np.sqrt(q)) ** 2


def mp_density(x: np.ndarray, q: float, sigma2: float) -> np.ndarray:
    lo, hi = sigma2 * (1 - np.sqrt(q)) ** 2, mp_edge(q, sigma2)
    inside = np.sqrt(np.maximum((hi - x) * (x - lo), 0))
    return np.where((x > lo) & (x < hi), inside / (2 * np.pi * q * sigma2 * np.maximum(x, 1e-12)), 0.0)


def fit_sigma2(eigenvalues: np.ndarray, q: float) -> float:
    """The variance whose law is nearest to a Gaussian kernel estimate of the eigenvalues, by golden-section search."""
    h = 1.06 * max(eigenvalues.std(), 1e-6) * len(eigenvalues) ** -0.2

    def gap(s: float) -> float:
        grid = np.linspace(max(s * (1 - np.sqrt(q)) ** 2, 1e-6), mp_edge(q, s), 1000)
        kde = np.exp(-0.5 * ((grid[:, None] - eigenvalues) / h) ** 2).sum(1) / (len(eigenvalues) * h * np.sqrt(2 * np.pi))
        return float(((mp_density(grid, q, s) - kde) ** 2).sum())

    lo, hi, g = 1e-4, 1.0, (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if gap(a) < gap(b) else (a, hi)
    return (lo + hi) / 2


def _rebuilt(values: np.ndarray, vectors: np.ndarray, sd: np.ndarray) -> np.ndarray:
    c = vectors @ np.diag(values) @ vectors.T
    d = np.sqrt(np.diag(c))
    c = c / np.outer(d, d)
    return c * np.outer(sd, sd)


def _long(names: np.ndarray, m: np.ndarray) -> pd.DataFrame:
    n = len(names)
    return pd.DataFrame({"i": np.repeat(names, n), "j": np.tile(names, n), "value": m.ravel()})


def denoised(cov: DataFrame, n_obs: int, sigma2: float | None = None) -> DataFrame:
    """Eigenvalues of the correlation under the Marchenko-Pastur edge become their mean."""

    def fn(names, m):
        c, sd = correlation(m)
        values, vectors = np.linalg.eigh(c)
        q = len(names) / n_obs
        edge = mp_edge(q, fit_sigma2(values, q) if sigma2 is None else sigma2)
        noise = values <= edge
        if noise.any():
            values = np.where(noise, values[noise].mean(), values)
        return _long(names, _rebuilt(values, vectors, sd))

    return _apply(cov, fn, MATRIX)


def detoned(cov: DataFrame, n_factors: int = 1) -> DataFrame:
    """The greatest eigenvalues of the correlation become 0."""

    def fn(names, m):
        c, sd = correlation(m)
        values, vectors = np.linalg.eigh(c)
        values[len(values) - n_factors :] = 0
        return _long(names, _rebuilt(values, vectors, sd))

    return _apply(cov, fn, MATRIX)


def ledoit_wolf(rows: DataFrame, t: str = "t", i: str = "i", x: str = "x") -> DataFrame:
    """i, j, value, delta: covariance shrunk to a scaled identity. The sum of squared outer products that the intensity
    needs is the sum over t of squared row norms, so it is aggregated beside the covariance."""
    centred = rows.join(rows.groupBy(F.col(i)).agg(F.avg(x).alias("_m")), i).select(F.col(t).alias("t"), F.col(i).alias("i"), (F.col(x) - F.col("_m")).alias("x"))
    cov = covariance(centred, ddof=0)
    norms = centred.groupBy("t").agg(F.sum(F.col("x") * F.col("x")).alias("s"))
    extra = norms.agg(F.sum(F.col("s") * F.col("s")).alias("s4"), F.count(F.lit(1)).alias("n"))
    held = cov.crossJoin(F.broadcast(extra))  # one row

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, s = _matrix(pdf)
        n, p = float(pdf["n"].iloc[0]), len(names)
        mu = np.trace(s) / p
        d2 = ((s - mu * np.eye(p)) ** 2).sum() / p
        b2 = min((pdf["s4"].iloc[0] / n - (s**2).sum()) / (n * p), d2)
        delta = b2 / d2 if d2 > 0 else 0.0
        return _long(names, delta * mu * np.eye(p) + (1 - delta) * s).assign(delta=delta)

    return held.groupBy().applyInPandas(run, MATRIX + ", delta double")


def linkage_order(dist: np.ndarray, how: str = "single") -> tuple[list[int], list[tuple[set, set]]]:
    """Leaf order and merges of agglomerative clustering; 'ward' merges by the least growth of variance."""
    clusters: dict[int, list[int]] = {k: [k] for k in range(len(dist))}
    d = dist.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    merges, live = [], list(range(len(dist)))
    size = {k: 1 for k in live}
    while len(live) > 1:
        sub = d[np.ix_(live, live)]
        a, b = divmod(int(np.argmin(sub)), len(live))
        a, b = live[min(a, b)], live[max(a, b)]
        merges.append((set(clusters[a]), set(clusters[b])))
        for k in live:
            if k not in (a, b):
                if how == "ward":
                    na, nb, nk = size[a], size[b], size[k]
                    d[a, k] = d[k, a] = np.sqrt(((na + nk) * d[a, k] ** 2 + (nb + nk) * d[b, k] ** 2 - nk * d[a, b] ** 2) / (na + nb + nk))
                else:
                    d[a, k] = d[k, a] = min(d[a, k], d[b, k])
        clusters[a] = clusters[a] + clusters[b]
        size[a] += size[b]
        live.remove(b)
    return clusters[live[0]], merges


def cut(dist: np.ndarray, k: int) -> np.ndarray:
    """Labels of k clusters by Ward's criterion."""
    labels = np.arange(len(dist))
    for a, b in linkage_order(dist, "ward")[1][: len(dist) - k]:
        labels[list(b)] = labels[next(iter(a))]
    return np.unique(labels, return_inverse=True)[1]


def silhouettes(dist: np.ndarray, labels: np.ndarray) -> np.ndarray:
    out = np.zeros(len(dist))
    for i in range(len(dist)):
        own = (labels == labels[i]) & (np.arange(len(dist)) != i)
        if own.any():
            a = dist[i, own].mean()
            b = min(dist[i, labels == c].mean() for c in set(labels) - {labels[i]})
            out[i] = (b - a) / max(a, b) if max(a, b) > 0 else 0.0
    return out


def best_clusters(corr: np.ndarray) -> np.ndarray:
    """The number of clusters whose silhouettes have the greatest mean over deviation."""
    dist = np.sqrt(np.clip((1 - corr) / 2, 0, None))
    best, score = np.zeros(len(corr), int), -np.inf
    for k in range(2, max(3, len(corr) // 2 + 1)):
        if k >= len(corr):
            break
        labels = cut(dist, k)
        s = silhouettes(dist, labels)
        t = s.mean() / s.std() if s.std() > 0 else -np.inf
        if t > score:
            best, score = labels, t
    return best


def _inverse_variance(c: np.ndarray) -> np.ndarray:
    w = 1 / np.diag(c)
    return w / w.sum()


def hrp_weights(m: np.ndarray) -> np.ndarray:
    corr, _ = correlation(m)
    order, _ = linkage_order(np.sqrt(np.clip((1 - corr) / 2, 0, None)))
    w = np.ones(len(m))
    parts = [order]
    while parts:
        nxt = []
        for part in parts:
            if len(part) < 2:
                continue
            halves = part[: len(part) // 2], part[len(part) // 2 :]
            var = []
            for h in halves:
                c = m[np.ix_(h, h)]
                iv = _inverse_variance(c)
                var.append(float(iv @ c @ iv))
            share = 1 - var[0] / (var[0] + var[1])
            w[halves[0]] *= share
            w[halves[1]] *= 1 - share
            nxt += list(halves)
        parts = nxt
    return w / w.sum()


def _solved(c: np.ndarray, mu: np.ndarray) -> np.ndarray:
    w = np.linalg.pinv(c) @ mu
    return w / w.sum() if abs(w.sum()) >= 1e-12 else np.full(len(mu), 1 / len(mu))


def nco_weights(m: np.ndarray, mu: np.ndarray | None = None, n_clusters: int | None = None) -> np.ndarray:
    """Weights within clusters, then between them, by the inverse covariance."""
    mu = np.ones(len(m)) if mu is None else mu
    corr, _ = correlation(m)
    labels = best_clusters(corr) if n_clusters is None else cut(np.sqrt(np.clip((1 - corr) / 2, 0, None)), n_clusters)
    inner = np.zeros((len(m), labels.max() + 1))
    for k in range(labels.max() + 1):
        at = np.flatnonzero(labels == k)
        inner[at, k] = _solved(m[np.ix_(at, at)], mu[at])
    return inner @ _solved(inner.T @ m @ inner, inner.T @ mu)


def _weights(cov: DataFrame, fn) -> DataFrame:
    return _apply(cov, lambda names, m: pd.DataFrame({"i": names, "weight": fn(m)}), "i long, weight double")


def hrp(cov: DataFrame) -> DataFrame:
    return _weights(cov, hrp_weights)


def nco(cov: DataFrame, n_clusters: int | None = None) -> DataFrame:
    return _weights(cov, lambda m: nco_weights(m, None, n_clusters))


def clusters(cov: DataFrame, k: int | None = None) -> DataFrame:
    def fn(names, m):
        corr, _ = correlation(m)
        labels = best_clusters(corr) if k is None else cut(np.sqrt(np.clip((1 - corr) / 2, 0, None)), k)
        return pd.DataFrame({"i": names, "cluster": labels})

    return _apply(cov, fn, "i long, cluster long")


def inverse_vol(vols: DataFrame, vol: str = "vol", by: list[str] | None = None) -> DataFrame:
    from pyspark.sql.window import Window

    inv = F.when(F.col(vol) > 0, 1 / F.col(vol)).otherwise(0.0)
    rows = vols.withColumn("_i", inv)
    total = F.sum("_i").over(Window.partitionBy(*(by or [F.lit(0)])))
    return rows.withColumn("weight", F.coalesce(F.try_divide(F.col("_i"), total), F.lit(0.0))).drop("_i")


def bet_size(prob: Column, side: Column) -> Column:
    z = (prob - 0.5) / F.sqrt(prob * (1 - prob))
    return side * F.when(prob >= 1, F.lit(1.0)).when(prob <= 0, F.lit(-1.0)).otherwise(2 * special.norm_cdf(z) - 1)


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def kelly(prob: Column, odds: float = 1.0, fraction: float = 0.5, cap: float = 1.0) -> Column:
    return clip(fraction * (prob * odds - (1 - prob)) / odds, -cap, cap)


def vol_target(size: Column, vol: Column, target: float, most: float = 3.0) -> Column:
    return F.when(vol > 0, size * clip(target / vol, 0.0, most)).otherwise(0.0)


def drawdown_scaled(size: Column, drawdown: Column, floor: float = -0.2) -> Column:
    return size * clip(1 - drawdown / floor, 0.0, 1.0)


def construct(signals: DataFrame, method: str = "kelly", risk_aversion: float = 2.0, max_position: float = 0.1, max_leverage: float = 1.0, by: str = "date") -> DataFrame:
    """Weights of tradeable signals (mu, lower, upper) by date: equal, signal, kelly or risk_parity; capped by name, then
    scaled to the leverage."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(by)
    mu, half = F.col("mu"), (F.col("upper") - F.col("lower")) / 2
    tradeable = (F.col("lower") > 0) | (F.col("upper") < 0)
    sign = F.signum(mu)
    raw = {
        "equal": F.when(tradeable, sign),
        "signal": F.when(tradeable, mu),
        "kelly": F.when(tradeable & (half > 0), mu / (risk_aversion * half * half)),
        "risk_parity": F.when(tradeable & (half > 0), sign / half),
    }[method]
    rows = signals.withColumn("_w", F.coalesce(raw, F.lit(0.0)))
    if method != "kelly":
        rows = rows.withColumn("_w", F.coalesce(F.try_divide(F.col("_w"), F.sum(F.abs("_w")).over(w)), F.lit(0.0)))
    rows = rows.withColumn("_w", clip(F.col("_w"), -max_position, max_position))
    gross = F.sum(F.abs("_w")).over(w)
    return rows.withColumn("weight", F.col("_w") * F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(max_leverage), gross), F.lit(1.0)))).drop("_w")
