"""Softmax regression over long-form vectors: full-batch descent by joins, MLlib training, scores, loss."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.text import log_sum_exp, softmax3

CLASSES = 3


def class_weights(labels: DataFrame, label: str = "tier") -> DataFrame:
    """(tier, n, weight): sqrt(rows / (3 n)) of each tier, 0 rows included (weight null)."""
    counts = labels.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("tier")).agg(F.count("*").alias("n"))
    grid = labels.sparkSession.createDataFrame([(k,) for k in range(CLASSES)], "tier int")
    rows = grid.join(F.broadcast(counts), "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("n"))
    total = rows.agg(F.sum("n").alias("total"))
    return rows.join(F.broadcast(total)).select("tier", "n", F.when(F.col("n") > 0, F.sqrt(F.col("total") / (3.0 * F.col("n")))).alias("weight"))


def gradient_step(features: DataFrame, probs: DataFrame | None, labels: DataFrame, weights: DataFrame, id_col: str, lr: float) -> tuple[DataFrame, DataFrame]:
    """The move of one full-batch step: (idx, w0..w2) and one row (b0..b2).

    labels: (id, tier); weights: (tier, weight); probs: (id, p0..p2), or None at zero weights, where each is 1/3.
    """
    rows = labels.join(F.broadcast(weights.select("tier", "weight")), "tier")
    rows = rows.join(probs, id_col) if probs is not None else rows.withColumns({f"p{k}": F.lit(1.0) / 3 for k in range(CLASSES)})
    err = [(F.col("weight") * (F.col(f"p{k}") - (F.col("tier") == k).cast("int"))).alias(f"e{k}") for k in range(CLASSES)]
    rows = rows.select(id_col, *err)
    n = rows.agg(F.count("*").alias("n"), *[F.sum(f"e{k}").alias(f"s{k}") for k in range(CLASSES)])
    bias = n.select(*[(-lr * F.col(f"s{k}") / F.col("n")).alias(f"b{k}") for k in range(CLASSES)])
    sums = features.join(rows, id_col).groupBy("idx").agg(*[F.sum(F.col(f"e{k}") * F.col("value")).alias(f"g{k}") for k in range(CLASSES)])
    move = sums.join(F.broadcast(n.select("n"))).select("idx", *[(-lr * F.col(f"g{k}") / F.col("n")).alias(f"w{k}") for k in range(CLASSES)])
    return move, bias


def first_step(features: DataFrame, labels: DataFrame, weights: DataFrame, lr: float) -> tuple[DataFrame, DataFrame]:
    """gradient_step() at zero weights of features that carry their tier: (id, tier, idx, value). Nothing is moved but sums."""
    err = [F.col("weight") * (F.lit(1.0) / 3 - (F.col("tier") == k).cast("int")) for k in range(CLASSES)]
    weights = F.broadcast(weights.select("tier", "weight"))
    n = labels.join(weights, "tier").agg(F.count("*").alias("n"), *[F.sum(e).alias(f"s{k}") for k, e in enumerate(err)])
    sums = features.join(weights, "tier").groupBy("idx").agg(*[F.sum(e * F.col("value")).alias(f"g{k}") for k, e in enumerate(err)])
    move = sums.join(F.broadcast(n.select("n"))).select("idx", *[(-lr * F.col(f"g{k}") / F.col("n")).alias(f"w{k}") for k in range(CLASSES)])
    return move, n.select(*[(-lr * F.col(f"s{k}") / F.col("n")).alias(f"b{k}") for k in range(CLASSES)])


def logits(docs: DataFrame, features: DataFrame, weights: DataFrame, bias: DataFrame, id_col: str) -> DataFrame:
    """(id, z0..z2) of every row of docs; one without known tokens has the bias alone."""
    sums = features.join(F.broadcast(weights), "idx").groupBy(id_col).agg(*[F.sum(F.col(f"w{k}") * F.col("value")).alias(f"s{k}") for k in range(CLASSES)])
    return docs.select(id_col).join(sums, id_col, "left").join(F.broadcast(bias)).select(id_col, *[(F.col(f"b{k}") + F.coalesce(f"s{k}", F.lit(0.0))).alias(f"z{k}") for k in range(CLASSES)])


def probabilities(scores: DataFrame, id_col: str) -> DataFrame:
    return scores.select(id_col, *[p.alias(f"p{k}") for k, p in enumerate(softmax3([F.col(f"z{k}") for k in range(CLASSES)]))])


def cross_entropy(scores: DataFrame, labels: DataFrame, weights: DataFrame, model: DataFrame, id_col: str, l2: float = 0.0) -> DataFrame:
    """One row (loss): weighted mean over rows plus half the penalty on all weights but the bias."""
    z = [F.col(f"z{k}") for k in range(CLASSES)]
    own = F.when(F.col("tier") == 0, z[0]).when(F.col("tier") == 1, z[1]).otherwise(z[2])
    data = scores.join(labels, id_col).join(F.broadcast(weights), "tier").agg(F.avg(F.col("weight") * (log_sum_exp(z) - own)).alias("d"))
    penalty = model.agg(F.coalesce(F.sum(F.col("w0") * F.col("w0") + F.col("w1") * F.col("w1") + F.col("w2") * F.col("w2")), F.lit(0.0)).alias("p"))
    return data.join(penalty).select((F.col("d") + 0.5 * l2 * F.col("p")).alias("loss"))


def train_full_batch(features: DataFrame, labels: DataFrame, weights: DataFrame, id_col: str, lr: float = 0.5, l2: float = 1e-5, epochs: int = 1) -> tuple[DataFrame, DataFrame]:
    """Weights and bias after full-batch steps from zero at lr / (1 + 0.015 epoch); each step is a table in the shared folder."""
    from sluice.sources.shared import written

    docs = labels.select(id_col)
    w, b = None, None
    for epoch in range(epochs):
        rate = lr / (1 + 0.015 * epoch)
        probs = None if w is None else probabilities(logits(docs, features, w, b, id_col), id_col)
        move, shift = gradient_step(features, probs, labels, weights, id_col, rate)
        if w is not None:
            move = w.unionByName(move).groupBy("idx").agg(*[F.sum(f"w{k}").alias(f"w{k}") for k in range(CLASSES)]) if not l2 else (
                w.select("idx", *[(F.col(f"w{k}") * (1 - rate * l2)).alias(f"w{k}") for k in range(CLASSES)]).unionByName(move).groupBy("idx").agg(*[F.sum(f"w{k}").alias(f"w{k}") for k in range(CLASSES)]))
            shift = b.unionByName(shift).agg(*[F.sum(f"b{k}").alias(f"b{k}") for k in range(CLASSES)])
        w, b = (written(move, "weights"), written(shift, "bias")) if epochs > 1 else (move, shift)
    return w, b


def train_mllib(vectors: DataFrame, l2: float = 1e-5, max_iter: int = 100):
    """MLlib's multinomial learner on (features, label, weight); its penalty is scaled so that the objectives agree."""
    from pyspark.ml.classification import LogisticRegression

    n, total = vectors.agg(F.count("*"), F.sum("weight")).first()
    return LogisticRegression(family="multinomial", standardization=False, elasticNetParam=0.0, regParam=l2 * n / total, weightCol="weight", maxIter=max_iter).fit(vectors)


def to_vectors(features: DataFrame, id_col: str, size: int) -> DataFrame:
    """(id, features): MLlib's sparse vectors from the long form, with as many entries as a document has known tokens."""
    from pyspark.ml.linalg import SparseVector, VectorUDT

    @F.udf(VectorUDT())
    def sparse(entries):
        return SparseVector(size, [e[0] for e in entries], [e[1] for e in entries])

    return features.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("e")).select(id_col, sparse("e").alias("features"))
