"""Splits, caps and samples in a fixed pseudo-random order (md5 of seed and id, then id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffled(id_col: str, seed: int) -> list[Column]:
    return [F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary")), F.col(id_col)]


def split(df: DataFrame, id_col: str, strata: list[str] = [], shares=(0.70, 0.15), seed: int = 42) -> DataFrame:
    """Adds split (train, val, test): the first int(n share) rows of each stratum in shuffled order, and so on."""
    part = Window.partitionBy(*strata)
    k, n = F.row_number().over(part.orderBy(*shuffled(id_col, seed))), F.count("*").over(part)
    first, second = F.floor(n * F.lit(shares[0])), F.floor(n * F.lit(shares[1]))
    return df.withColumn("split", F.when(k <= first, "train").when(k <= first + second, "val").otherwise("test"))


def capped(df: DataFrame, id_col: str, label: str, cap: int, seed: int = 42) -> DataFrame:
    """At most cap rows of each label, in shuffled order."""
    k = F.row_number().over(Window.partitionBy(label).orderBy(*shuffled(id_col, seed)))
    return df.withColumn("__k", k).filter(F.col("__k") <= cap).drop("__k")


def audit_sample(df: DataFrame, id_col: str, label: str, n: int = 40, seed: int = 42) -> DataFrame:
    """max(1, n / labels) rows of each label in shuffled order, n in all at most (labels in order)."""
    labels = max(1, df.select(label).distinct().count())
    picked = capped(df, id_col, label, max(1, n // labels), seed)
    return picked.orderBy(label, *shuffled(id_col, seed)).limit(n)
