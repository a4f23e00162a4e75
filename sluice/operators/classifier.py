"""The decision stack over linear scores, and a classifier that fits, scores, saves and loads."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.text import TokenizerOptions, argmax3, softmax3, token_counter
from sluice.operators import features, linear

# Stems that mark the hardest tier.
HARD_STEMS = ("deadlock", "mutex", "thread-safe", "race condition", "atomic", "hazard pointer")


@dataclass(frozen=True)
class Thresholds:
    tier3_margin: float = 0.05
    tier2_margin: float = 0.05
    min_t3_prob: float = 0.30
    min_t2_prob: float = 0.30


def decide(df: DataFrame, text: str, n_tokens: str, session: str | None = None, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Adds predicted_tier, p0..p2 and confidence to rows with z0..z2, after priors, guards and promotions.

    A row without tokens takes the session's tier, else tier 0, with probability 1. session: a column of 0..2 or null.
    """
    n, t, s = F.col(n_tokens).cast("double"), F.coalesce(F.col(text), F.lit("")), F.col(session) if session else F.lit(None).cast("int")
    length = F.least(F.greatest((n - 10.0) / 40.0, F.lit(0.0)), F.lit(1.0))
    hard = F.contains(t, F.lit(HARD_STEMS[0]))
    for stem in HARD_STEMS[1:]:
        hard = hard | F.contains(t, F.lit(stem))
    syntax = F.contains(t, F.lit("std::")) & (F.startswith(t, F.lit("What does")) | F.startswith(t, F.lit("How do I")))
    known, short = s.between(0, 2), n <= 3
    shrink = F.when(known & short, 0.25).otherwise(1.0)
    boost = (F.lit(2.5) + F.when(short, 0.3 * (3 - n)).otherwise(0.0)) * F.greatest(F.lit(0.0), 1.0 - n / 15.0)
    prior = (F.when(syntax, 1.2).otherwise(0.0), 0.4 * length, 0.8 * length + F.when(hard, 2.0).otherwise(0.0))
    df = df.withColumns({f"z{k}": (F.col(f"z{k}") + prior[k]) * shrink + F.when(known & (s == k), boost).otherwise(0.0) for k in range(3)})
    df = df.withColumns({f"p{k}": p for k, p in enumerate(softmax3([F.col(f"z{k}") for k in range(3)]))})
    p = [F.col(f"p{k}") for k in range(3)]
    df = df.withColumns({"__best": argmax3(p), "__max": F.greatest(*p)})
    best, most = F.col("__best"), F.col("__max")
    third = (best != 2) & (most - p[2] <= thresholds.tier3_margin) & (p[2] >= thresholds.min_t3_prob)
    second = (best == 0) & (most - p[1] <= thresholds.tier2_margin) & (p[1] >= thresholds.min_t2_prob)
    fallback = F.when(known, s).otherwise(0).cast("int")
    empty = n == 0
    df = df.withColumn("predicted_tier", F.when(empty, fallback).when(third, 2).when(second, 1).otherwise(best).cast("int"))
    df = df.withColumn("confidence", F.when(empty, 1.0).otherwise(most))
    df = df.withColumns({f"p{k}": F.when(empty, (fallback == k).cast("double")).otherwise(p[k]) for k in range(3)})
    return df.drop("__best", "__max")


class TierClassifier:
    """Tokenize, weigh, score, decide. Fitted state: vocab (idx, token, tf, df, idf), weights, bias."""

    def __init__(self, options: TokenizerOptions = TokenizerOptions(), thresholds: Thresholds = Thresholds()):
        self.options, self.thresholds, self.vocab, self.weights, self.bias = options, thresholds, None, None, None

    def fit(self, df: DataFrame, id_col: str = "id", text_col: str = "text", label_col: str = "tier", max_vocab: int = 15000, min_df: int = 2, lr: float = 0.5, l2: float = 1e-5, epochs: int = 1) -> TierClassifier:
        rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("tier")).filter("tier between 0 and 2")
        spark, vocab = df.sparkSession, features.with_idf(features.text_vocabulary(rows, "id", "text", self.options, max_vocab, min_df), rows.count())
        self.vocab = spark.createDataFrame(vocab.toArrow())
        labels = rows.select("id", "tier")
        weights = linear.class_weights(labels)
        x = features.text_tfidf(rows, "id", self.vocab, "text", self.options, ("tier",))
        if epochs == 1:
            self.weights, self.bias = linear.first_step(x, labels, weights, lr)
        else:
            self.weights, self.bias = linear.train_full_batch(x.drop("tier"), labels, weights, "id", lr, l2, epochs)
        return self

    def _scored(self, df: DataFrame) -> DataFrame:
        """df with n_tokens and z0..z2 of its column text, made where a row lies; the model is bounded by its vocabulary."""
        weigh, options = features.Weigher(self.vocab), self.options
        w, b = np.zeros((len(weigh.idf), linear.CLASSES)), np.array(self.bias.select("b0", "b1", "b2").first(), float)
        for r in self.weights.select("idx", "w0", "w1", "w2").collect():
            w[r.idx] = r.w0, r.w1, r.w2
        schema = T.StructType([*df.schema, T.StructField("n_tokens", T.IntegerType()), *(T.StructField(f"z{k}", T.DoubleType()) for k in range(linear.CLASSES))])
        at = df.columns.index("text")

        def run(batches):
            count = token_counter(options)
            for whole in batches:
                for lo in range(0, len(whole), features.STEP):
                    batch = whole.slice(lo, features.STEP)
                    counts = [count(t) for t in batch.column(at).to_pylist()]
                    owner, idx, value = weigh(counts)
                    z = [b[k] + np.bincount(owner, w[idx, k] * value, len(counts)) for k in range(linear.CLASSES)]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([sum(c.values()) for c in counts], pa.int32()), *map(pa.array, z)], names=schema.names)

        return df.mapInArrow(run, schema)

    def transform(self, df: DataFrame, id_col: str = "id", text_col: str = "text", session_col: str | None = None) -> DataFrame:
        """id, predicted_tier, p0..p2, confidence of every row; ids are expected to be unique."""
        session = F.col(session_col).cast("int") if session_col else F.lit(None).cast("int")
        scored = self._scored(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), session.alias("session")))
        return decide(scored, "text", "n_tokens", "session", self.thresholds).select("id", "predicted_tier", "p0", "p1", "p2", "confidence")

    def transform_chain(self, df: DataFrame, id_col: str, group_col: str, order_col: str, text_col: str = "text") -> DataFrame:
        """id, predicted_tier, confidence of every row, each with the tier of its group's row before as session.

        Each row is scored once and decided for no session and for the three; then a group's rows are walked in order,
        which holds one tier. The order is by order_col (nulls first), then id.
        """
        rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(group_col).cast("string").alias("g"), F.col(order_col).alias("o"), F.col(text_col).alias("text"))
        each, z = self._scored(rows), [f"z{k}" for k in range(linear.CLASSES)]
        each = each.withColumnsRenamed({c: f"own_{c}" for c in z})
        for s in range(-1, linear.CLASSES):
            each = each.withColumns({c: F.col(f"own_{c}") for c in z} | {"session": F.lit(s if s >= 0 else None).cast("int")})
            each = decide(each, "text", "n_tokens", "session", self.thresholds).withColumnsRenamed({"predicted_tier": f"t{s + 1}", "confidence": f"c{s + 1}"})
        flat = each.select("id", F.xxhash64("g").alias("h"), "g", "o", *[F.array(*[f"{c}{k}" for k in range(linear.CLASSES + 1)]).alias(c) for c in "tc"])

        def walk(frames):
            group, tier = None, -1
            for pdf in frames:
                tiers, sure = [], []
                for g, t, c in zip(pdf["g"], pdf["t"], pdf["c"], strict=True):
                    at = tier + 1 if g == group else 0
                    tiers.append(int(t[at]))
                    sure.append(float(c[at]))
                    group, tier = g, tiers[-1]
                yield pd.DataFrame({"id": pdf["id"], "predicted_tier": pd.Series(tiers, dtype="int32"), "confidence": pd.Series(sure, dtype="float64")})

        return flat.repartition("h").sortWithinPartitions("h", "g", "o", "id").select("id", "g", "t", "c").mapInPandas(walk, "id string, predicted_tier int, confidence double")

    def save(self, path: str) -> None:
        """Tables and a versioned description below path."""
        for name in ("vocab", "weights", "bias"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        meta = json.dumps({"format": "tier-classifier", "version": 2, "options": asdict(self.options), "thresholds": asdict(self.thresholds)})
        self.vocab.sparkSession.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TierClassifier:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        if (meta.get("format"), meta.get("version")) != ("tier-classifier", 2):
            raise ValueError(f"not a classifier of version 2: {path}")
        out = cls(TokenizerOptions(**meta["options"]), Thresholds(**meta["thresholds"]))
        out.vocab, out.weights, out.bias = (spark.read.parquet(f"{path}/{n}") for n in ("vocab", "weights", "bias"))
        return out
