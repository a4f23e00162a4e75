"""Quality scores by naive Bayes support vectors (NB-SVM).

Indicators of n-grams in three views of a text: bytes (n = 3, hashed), words that repeat the word before (n-grams of
one symbol, n = 1 to 8), words in capitals (likewise), lines that repeat the line before. Each indicator is scaled by the log ratio of its
smoothed share in either class, then a linear support vector machine (hinge loss) is fitted by dual coordinate descent. A
logistic curve fitted on held-back rows turns margins into scores.
"""

from __future__ import annotations

from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.common import append_columns, held_out, table

HASH_BITS = 17
RUNS = 8
N_FEATURES = (1 << HASH_BITS) + 3 * RUNS
#: Labelled rows that training reads at most (whole texts), the same bound at every input size.
TRAIN_ROWS = 4000
THRESHOLD = 0.3


def ngram_indicators(text: str | None) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text; a null text has none."""
    raw = (text or "").encode("utf-8", "replace")
    data = np.frombuffer(raw, np.uint8).astype(np.uint32)
    seen = np.zeros(N_FEATURES, bool)
    if len(data) >= 3:
        code = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
        seen[(code * np.uint32(0x9E3779B1)) >> np.uint32(32 - HASH_BITS)] = True
    words = raw.split()
    lines = raw.split(b"\n")
    views = (bytes(map(eq, words, words[1:])), bytes(map(bytes.isupper, words)), bytes(map(eq, lines, lines[1:])))
    for v, marks in enumerate(views):
        for n in range(1, RUNS + 1):
            if b"\x01" * n not in marks:
                break
            seen[(1 << HASH_BITS) + v * RUNS + n - 1] = True
    return np.flatnonzero(seen)


class NbSvm:
    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def margin(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum() / np.sqrt(max(1, len(found))) + self.bias)

    def score(self, text: str | None) -> float:
        z = self.slope * self.margin(ngram_indicators(text)) + self.shift
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))))


def _descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, c: float, rounds: int, rng) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for min ½|w|² + c Σ max(0, 1 − y w·x); the bias is a constant feature.

    Each dual variable lies between 0 and c; a step sets one of them to its best value with the others held.
    """
    w, bias, alpha = np.zeros(N_FEATURES), 0.0, np.zeros(len(rows))
    norms = np.array([(v * v).sum() + 1.0 for v in values])
    for _ in range(rounds):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            g = y[i] * (w[rows[i]] @ values[i] + bias) - 1.0
            new = min(c, max(0.0, alpha[i] - g / norms[i]))
            step = (new - alpha[i]) * y[i]
            if step:
                largest = max(largest, abs(step))
                alpha[i] = new
                w[rows[i]] += step * values[i]
                bias += step
        if largest < 1e-4:
            break
    return w, bias


def fit_nbsvm(texts: list[str | None], labels: list[int], c: float = 1.0, rounds: int = 25, seed: int = 42) -> NbSvm:
    """Fit on texts in memory. One class only (or none): every score is that class's smoothed share."""
    y = np.array([1.0 if q else -1.0 for q in labels])
    share = (float((y > 0).sum()) + 1.0) / (len(y) + 2.0)
    if len(y) < 4 or abs(y.sum()) == len(y):
        return NbSvm(np.zeros(N_FEATURES), 0.0, 1.0, float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    found = [ngram_indicators(t) for t in texts]
    order = rng.permutation(len(y))
    back, fit = order[: len(y) // 4], order[len(y) // 4 :]

    def learn(rows):
        p, n = np.ones(N_FEATURES), np.ones(N_FEATURES)
        for i in rows:
            (p if y[i] > 0 else n)[found[i]] += 1.0
        common = (p + n) >= 5  # two smoothing counts and three documents
        ratio = np.where(common, np.log(p / p.sum()) - np.log(n / n.sum()), 0.0)
        values = [ratio[found[i]] / np.sqrt(max(1, len(found[i]))) for i in rows]
        w, bias = _descend([found[i] for i in rows], values, y[rows], c, rounds, rng)
        return w * ratio, bias

    if abs(y[fit].sum()) == len(fit) or not len(back):
        fit = back = order
    weights, bias = learn(fit)
    model = NbSvm(weights, bias, 1.0, 0.0)
    m = np.array([model.margin(found[i]) for i in back])
    t = (y[back] > 0).astype(float)
    hi, lo = (t.sum() + 1) / (t.sum() + 2), 1 / (len(t) - t.sum() + 2)  # Platt's targets
    t = np.where(t > 0, hi, lo)
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton's steps on two parameters
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -500, 500)))
        s = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - t) * m).sum() + 1e-3 * (a - 1), (p - t).sum()])
        h = np.array([[(s * m * m).sum() + 1e-3, (s * m).sum()], [(s * m).sum(), s.sum() + 1e-6]])
        da, db = np.linalg.solve(h, g)
        a, b = a - float(np.clip(da, -2, 2)), b - float(np.clip(db, -2, 2))
        if abs(da) + abs(db) < 1e-8:
            break
    return NbSvm(weights, bias, a, b)


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS, seed: int = 42) -> list:
    """At most limit (text, quality) rows in hash order of doc_id, from documents that are not held out.

    Labels with a null id or quality are not used; of a document's repeated labels the largest counts, of rows with one id
    the smallest text.
    """
    chosen = (labels.select("doc_id", "quality").dropna().filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(limit))
    small = [(r[0], r[1]) for r in chosen.collect()]  # at most limit pairs
    if not small:
        return []
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.createDataFrame(small, f"doc_id {kind}, quality int")
    one = docs.select("doc_id", "text").join(F.broadcast(sent), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # one row an id
    return sorted(((r["doc_id"], r["text"], r["quality"]) for r in one.collect()), key=lambda r: r[0])


def fit_quality(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS, seed: int = 42) -> NbSvm:
    """NB-SVM from a bounded sample of labelled documents; held-out documents are never learned from."""
    rows = training_rows(docs, labels, limit, seed)
    return fit_nbsvm([r[1] for r in rows], [r[2] for r in rows], seed=seed)


def score_quality(df: DataFrame, model: NbSvm, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Adds a score from 0 to 1 to every row, null and empty texts included; only the text is read.

    A column of df named like score_col is replaced, others stay; repeated rows get equal scores. A very long text is read
    whole; an empty table stays empty.
    """

    def make(part):
        return ([model.score(t) for t in part.column(text_col).to_pylist()],)

    return append_columns(df, text_col, [T.StructField(score_col, T.DoubleType())], make)


def op2_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score_quality(docs.select("doc_id", "text"), fit_quality(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))
