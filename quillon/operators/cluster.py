"""Clustering and small-matrix algebra: counts are distributed, each group's matrix is an alphabet's size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dense(pdf: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    """The square count matrix of (a, b, n) and its sorted labels."""
    labels = sorted(set(pdf["a"]) | set(pdf["b"]))
    at = {x: i for i, x in enumerate(labels)}
    m = np.zeros((len(labels), len(labels)))
    np.add.at(m, ([at[x] for x in pdf["a"]], [at[x] for x in pdf["b"]]), pdf["n"].to_numpy(dtype=float))
    return labels, m


def divergences(m: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergences of all rows from each other."""
    p = m / np.maximum(m.sum(axis=1, keepdims=True), 1e-12)
    mid = (p[:, None, :] + p[None, :, :]) / 2

    def half(x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / mid), 0.0).sum(axis=2)

    wide = np.broadcast_to(p[:, None, :], mid.shape)
    return np.maximum((half(wide) + half(np.swapaxes(wide, 0, 1))) / 2, 0)


def linkage(distance: np.ndarray, k: int, single: bool = False) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """Clusters of 0..n-1 after merging the nearest two until k are left, and the merges; ties by the smaller numbers.

    Average linkage keeps the mean distance of members, single linkage the least.
    """
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size = np.ones(len(d))
    label = np.arange(len(d))
    merges = []
    for _ in range(max(0, len(d) - k)):
        i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
        merges.append((int(i), int(j), float(d[i, j])))
        joined = np.minimum(d[i], d[j]) if single else (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        d[i], d[:, i] = joined, joined
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
    return label, merges


def agglomerate(joint: DataFrame, k: int) -> DataFrame:
    """(corpus, letter, cluster): clusters named by their first letter."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        labels, m = dense(pdf)
        found, _ = linkage(divergences(m), k)
        return pd.DataFrame({"corpus": pdf["corpus"].iloc[0], "letter": labels, "cluster": [labels[i] for i in found]})

    return joint.groupBy("corpus").applyInPandas(one, "corpus string, letter string, cluster string")


def spectral(joint: DataFrame) -> DataFrame:
    """(corpus, letter, side, gap, alternation): side by the sign of the second eigenvector, "a" holding the first letter."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        labels, m = dense(pdf)
        p = (m + 1e-9) / (m + 1e-9).sum(axis=1, keepdims=True)
        values, vectors = np.linalg.eig(p)
        order = np.argsort(-np.abs(values))
        second = np.real(vectors[:, order[1]])
        side = second >= 0 if second[0] >= 0 else second < 0
        across = m[np.ix_(side, ~side)].sum() + m[np.ix_(~side, side)].sum()
        gap = float(np.abs(values[order[0]]) - np.abs(values[order[1]]))
        return pd.DataFrame(
            {"corpus": pdf["corpus"].iloc[0], "letter": labels, "side": np.where(side, "a", "b"), "gap": round(gap, 6), "alternation": round(float(across / m.sum()), 6)}
        )

    return joint.groupBy("corpus").applyInPandas(one, "corpus string, letter string, side string, gap double, alternation double")


def sukhotin(joint: DataFrame) -> DataFrame:
    """(corpus, letter, vowel): starting from consonants, the letter with most contacts becomes a vowel while it has any.

    Contacts are symmetric, without doubles; a new vowel takes twice its contacts from every other letter. Ties go to
    the first letter.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        labels, m = dense(pdf)
        contact = m + m.T
        np.fill_diagonal(contact, 0)
        score, vowel = contact.sum(axis=1), np.zeros(len(labels), dtype=bool)
        while not vowel.all():
            i = int(np.argmax(np.where(vowel, -np.inf, score)))
            if score[i] <= 0:
                break
            vowel[i] = True
            score = score - 2 * contact[:, i]
        return pd.DataFrame({"corpus": pdf["corpus"].iloc[0], "letter": labels, "vowel": vowel})

    return joint.groupBy("corpus").applyInPandas(one, "corpus string, letter string, vowel boolean")


def ppmi_svd(joint: DataFrame, k: int) -> DataFrame:
    """(corpus, letter, axis, value) of the clipped pointwise information's singular vectors, by their singular values."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        labels, m = dense(pdf)
        expected = m.sum(axis=1, keepdims=True) * m.sum(axis=0, keepdims=True) / m.sum()
        with np.errstate(divide="ignore", invalid="ignore"):
            x = np.where(m > 0, np.maximum(np.log2(m / expected), 0), 0.0)
        u, s, _ = np.linalg.svd(x)
        rows = []
        for a in range(min(k, len(s))):
            v = u[:, a] * s[a]
            v = v if v[np.argmax(np.abs(v))] >= 0 else -v
            rows += [(pdf["corpus"].iloc[0], letter, a, round(float(y), 6)) for letter, y in zip(labels, v)]
        return pd.DataFrame(rows, columns=["corpus", "letter", "axis", "value"])

    return joint.groupBy("corpus").applyInPandas(one, "corpus string, letter string, axis int, value double")


def principal_axes(vectors: DataFrame, column: str, k: int) -> list[tuple[int, float]]:
    """(axis, share of variance): sums of products by partition, added up by Spark; only a dims x dims matrix comes back."""

    def moments(batches):
        n, s, q = 0, None, None
        for b in batches:
            x = np.stack(b[column].to_list())
            n, s, q = n + len(x), x.sum(axis=0) + (0 if s is None else s), x.T @ x + (0 if q is None else q)
        if n:
            d = len(s)
            yield pd.DataFrame({"i": np.concatenate([np.full(d, -1), np.repeat(np.arange(d), d)]), "j": np.concatenate([np.arange(d), np.tile(np.arange(d), d)]), "v": np.concatenate([s, q.ravel()]), "n": n})

    parts = vectors.select(column).mapInPandas(moments, "i int, j int, v double, n long")
    # at most dims * (dims + 1) rows
    rows = parts.groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()
    if not rows:
        return []
    d, n = max(r.j for r in rows) + 1, rows[0].n
    mean, second = np.zeros(d), np.zeros((d, d))
    for r in rows:
        if r.i < 0:
            mean[r.j] = r.v / n
        else:
            second[r.i, r.j] = r.v / n
    values = np.sort(np.linalg.eigvalsh(second - np.outer(mean, mean)))[::-1]
    return [(i, round(float(values[i] / values.sum()), 5)) for i in range(min(k, d))]
