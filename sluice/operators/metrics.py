"""Confusion matrix, per-class and summary metrics of three tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.sources.shared import written


def confusion(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(true_tier, pred_tier, n) for all nine cells; rows without two known tiers are not counted."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in range(3) for b in range(3)], "true_tier int, pred_tier int")
    counts = df.groupBy(F.col(truth).cast("int").alias("true_tier"), F.col(pred).cast("int").alias("pred_tier")).agg(F.count("*").alias("n"))
    return grid.join(F.broadcast(counts), ["true_tier", "pred_tier"], "left").select("true_tier", "pred_tier", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def per_class(matrix: DataFrame) -> DataFrame:
    """(tier, precision, recall, f1, support); 0 where a denominator is 0."""
    rows = matrix.sparkSession.createDataFrame([(k,) for k in range(3)], "tier int").join(matrix)
    sums = rows.groupBy("tier").agg(*[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(a) for a, c in (
        ("tp", (F.col("true_tier") == F.col("tier")) & (F.col("pred_tier") == F.col("tier"))), ("predicted", F.col("pred_tier") == F.col("tier")), ("support", F.col("true_tier") == F.col("tier")))])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    sums = sums.withColumns({"precision": ratio(F.col("tp"), F.col("predicted")), "recall": ratio(F.col("tp"), F.col("support"))})
    both = F.col("precision") + F.col("recall")
    return sums.select("tier", "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), both).alias("f1"), F.col("support").cast("long").alias("support"))


def summary(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row: rows, accuracy over all rows, plain means of the three classes' metrics. df is read once, for its counts."""
    counts = written(df.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n")), "counts")
    right = F.sum(F.when((F.col("t") == F.col("p")) & F.col("t").between(0, 2), F.col("n")).otherwise(0))
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (right / F.sum("n")).alias("accuracy"))
    grid = df.sparkSession.createDataFrame([(a, b) for a in range(3) for b in range(3)], "true_tier int, pred_tier int")
    known = counts.select(F.col("t").cast("int").alias("true_tier"), F.col("p").cast("int").alias("pred_tier"), "n").groupBy("true_tier", "pred_tier").agg(F.sum("n").alias("n"))
    matrix = grid.join(F.broadcast(known), ["true_tier", "pred_tier"], "left").select("true_tier", "pred_tier", F.coalesce("n", F.lit(0)).alias("n"))
    means = per_class(matrix).agg(*[(F.sum(c) / 3).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])
    return totals.join(means)
