"""Label statistics, top features, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    """(label, n, share): share in percent of all rows."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def top_features(weights: DataFrame, vocab: DataFrame, k: int = 10) -> DataFrame:
    """(tier, rank, token, weight): the k largest weights of each tier; weights that agree to nine digits are ties, by idx."""
    rows = weights.select("idx", F.posexplode(F.array("w0", "w1", "w2")).alias("tier", "weight"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("tier").orderBy(F.desc(F.round("weight", 9)), "idx"))).filter(F.col("rank") <= k)
    return ranked.join(F.broadcast(vocab.select("idx", "token")), "idx").select("tier", "rank", "token", "weight")


def misclassified(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.filter(F.col(truth) != F.col(pred))


def top_confusions(df: DataFrame, truth: str, pred: str, confidence: str, id_col: str, k: int = 15) -> DataFrame:
    """The k most confident wrong rows, ties by id."""
    return misclassified(df, truth, pred).orderBy(F.desc(confidence), id_col).limit(k)


def previews(df: DataFrame, cluster: str, id_col: str, text: str, first: int = 10, members: int = 3) -> DataFrame:
    """(cluster, id, preview): the first characters of the first members of the first clusters."""
    ranked = df.filter(F.col(cluster) <= first).withColumn("__k", F.row_number().over(Window.partitionBy(cluster).orderBy(id_col)))
    return ranked.filter(F.col("__k") <= members).select(cluster, id_col, F.substring(F.col(text), 1, 110).alias("preview"))
