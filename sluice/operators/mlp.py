"""A small ReLU network trained by minibatch steps in numpy on a bounded set of vectors, and its scorer."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ReluMlp:
    def __init__(self, n_features: int, hidden: int = 8, seed: int = 42):
        rng = np.random.default_rng(seed)
        draw = lambda a, b: rng.uniform(-np.sqrt(2 / b), np.sqrt(2 / b), (a, b))
        self.w1, self.b1, self.w2, self.b2, self.rng = draw(hidden, n_features), np.zeros(hidden), draw(3, hidden), np.zeros(3), rng

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(x @ self.w1.T + self.b1, 0)
        z = h @ self.w2.T + self.b2
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return h, p / p.sum(axis=1, keepdims=True)

    def loss(self, x, y, l2: float = 0.0) -> float:
        p = self.forward(x)[1][np.arange(len(y)), y]
        return float(-np.log(np.maximum(p, 1e-12)).mean() + 0.5 * l2 * ((self.w1**2).sum() + (self.w2**2).sum()))

    def fit(self, x, y, lr: float = 0.2, l2: float = 1e-3, epochs: int = 45, batch: int = 32) -> ReluMlp:
        for epoch in range(epochs):
            rate, order = lr / (1 + 0.012 * epoch), self.rng.permutation(len(y))
            for at in range(0, len(y), batch):
                k = order[at : at + batch]
                h, p = self.forward(x[k])
                e = (p - np.eye(3)[y[k]]) / len(k)
                back = (e @ self.w2) * (h > 0)
                self.w2 -= rate * (e.T @ h + l2 * self.w2)
                self.b2 -= rate * e.sum(axis=0)
                self.w1 -= rate * (back.T @ x[k] + l2 * self.w1)
                self.b1 -= rate * back.sum(axis=0)
        return self


def dense(features: DataFrame, id_col: str, size: int) -> DataFrame:
    """(id, x): arrays of size values from the long form."""
    pairs = features.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("idx", "value"))).alias("m"))
    return pairs.select(id_col, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("x"))


def train(rows: DataFrame, label: str, size: int, hidden: int = 8, limit: int = 5000, seed: int = 42, **how) -> ReluMlp:
    """Fit on at most limit labelled rows (x, label) in hash order."""
    sample = rows.filter(F.col(label).between(0, 2)).orderBy(F.xxhash64("x", F.lit(seed))).limit(limit).select("x", label).toPandas()
    model = ReluMlp(size, hidden, seed)
    return model.fit(np.array(sample["x"].tolist()).reshape(-1, size), sample[label].to_numpy(int), **how) if len(sample) else model


def predict(rows: DataFrame, model: ReluMlp, id_col: str, size: int) -> DataFrame:
    """(id, predicted_tier, p0..p2) of rows with x."""

    def run(frames):
        for pdf in frames:
            p = model.forward(np.array(pdf["x"].tolist()).reshape(-1, size))[1]
            yield pd.DataFrame({id_col: pdf[id_col], "predicted_tier": p.argmax(axis=1).astype("int32"), **{f"p{k}": p[:, k] for k in range(3)}})

    return rows.select(id_col, "x").mapInPandas(run, f"{id_col} long, predicted_tier int, p0 double, p1 double, p2 double")
