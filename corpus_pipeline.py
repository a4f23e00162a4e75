"""A training corpus from the documents table: filter, deduplicate, decontaminate, mix, tokenize.

Every stage is one operator of sluice.llm over all that the stage before it kept, written as Parquet and read again.
Null and empty texts pass through the stages like any others (the quality model scores them); rows with null or repeated
ids are told apart by all their columns, so none is lost for its id; an empty table stays empty; extra columns, whatever
their names, are carried to the last stage, which returns its own.

The near-dedup stage takes five words and a similarity of 0.8 or more. Fingerprints of 64 bits at that similarity differ
in about ten bits, more than eight bytes can guarantee a match for, so this stage searches its links by exact prefix
filtering of the shingle sets (neardup.similar_groups) and not by op5's byte index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import decontam, mixing, neardup, quality, tokens
from sluice.llm.common import fresh_path, remove_path, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.3; the model learns from the labelled rows of docs that aren't held out."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model, score_col="__quality").filter(F.col("__quality") >= quality.THRESHOLD).drop("__quality")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar documents (five-word similarity of 0.8 or more): of smallest id, null ids last, then by text."""
    rows = neardup.similar_groups(docs).groupBy("root", "doc_id", "th").count()
    least = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "count")).alias("x"))
    least = least.select(F.col("x.doc_id").alias("__id"), F.col("x.th").alias("__th"), F.col("x.count").alias("__count"))
    mine = F.xxhash64("text")
    kept = docs.join(least, docs["doc_id"].eqNullSafe(least["__id"]) & (mine == least["__th"]))
    row = F.struct(*docs.columns)
    twice = kept.filter("__count > 1").groupBy("__id", "__th").agg(F.min_by(row, F.to_json(row)).alias("row"))
    return kept.filter("__count = 1").select(*docs.columns).unionByName(twice.select("row.*"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or up to three times."""
    key = F.md5(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}).cast("binary"))
    plan = mixing.mix(docs, row_key=key).groupBy(F.col("row_key").alias("__key")).agg(F.sum("copies").cast("int").alias("__copies"), F.count("*").alias("__rows"))
    taken = docs.withColumn("__key", key).join(plan.filter("__copies > 0"), "__key")
    alike = taken.filter("__rows > 1").dropDuplicates(["__key"])  # equal in every column: their copies are summed
    taken = taken.filter("__rows = 1").unionByName(alike).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return taken.select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in the shared folder, read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    return tokens.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"), known_bytes=48 << 20)  # the executors hold the other stages' memory too


STAGES = [("quality", keep_quality), ("near_dedup", keep_one_of_each_group), ("decontaminate", drop_leaks), ("mix", mix_sources), ("tokens", write_tokens)]

#: No stage but the mix can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; tables between stages lie in the shared folder."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_path(spark, before)
        before = path
    return docs
