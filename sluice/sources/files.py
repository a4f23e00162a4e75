"""JSON Lines and CSV sources and sinks with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.text import decode_tier, encode_tier, normalize

ROW = "id string, text string, label string"
#: The null of CSV files; an empty text is an empty field.
MARK = "\x01"
CSV = {"quote": '"', "escape": '"', "charToEscapeQuoteEscaping": '"', "nullValue": MARK, "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
PAIR = "id_a long, id_b long, label_a string, label_b string, similarity double, text_a string, text_b string"


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, tier): tolerant and silent. Empty, malformed and unlabelled lines drop out; a missing id is item_<line>.

    Values that are no strings count as missing. Line numbers need the order of lines, so each file is read as a
    sequence: the number is the line's place in its file's order.
    """
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    from pyspark.sql import Window

    line = F.row_number().over(Window.partitionBy("file_path").orderBy("file_block_start", "at"))
    text_of = lambda k: F.when(F.get_json_object("raw", f"$.{k}").isNotNull() & F.variant_get("v", f"$.{k}", "string").isNotNull() & (F.schema_of_variant(F.variant_get("v", f"$.{k}", "variant")) == "STRING"), F.variant_get("v", f"$.{k}", "string"))
    rows = lines.withColumn("line", line).filter(F.trim("value") != "").withColumn("v", F.try_parse_json("value")).filter("v is not null").withColumn("raw", F.col("value"))
    out = rows.select(F.coalesce(text_of("id"), F.concat(F.lit("item_"), F.col("line").cast("string"))).alias("id"), text_of("text").alias("text"), encode_tier(text_of("label")).alias("tier"))
    return out.filter("text is not null and tier is not null")


def read_jsonl_with_rejects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows with id, text, label, normalized; rejected lines): invalid lines and those without text or label are rejected."""
    lines = spark.read.text(path).filter(F.trim("value") != "").withColumn("j", F.from_json("value", "text string, label string, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    good = F.col("j").isNotNull() & F.col("j._bad").isNull() & F.col("j.text").isNotNull() & F.col("j.label").isNotNull()
    rows = lines.filter(good).select(F.monotonically_increasing_id().alias("id"), "j.text", "j.label")
    return rows.withColumn("normalized", normalize(F.col("text"))), lines.filter(~good).select("value")


def read_jsonl_strict(spark: SparkSession, path: str, schema: str = ROW) -> DataFrame:
    """Blank lines are skipped; a malformed one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_problems(spark: SparkSession, path: str) -> DataFrame:
    """(problem_statement): strings that are not blank."""
    return spark.read.schema("problem_statement string").json(path).filter(F.trim("problem_statement") != "")


def write_jsonl(df: DataFrame, path: str) -> None:
    """{id, text, label} a line, labels by name."""
    label = decode_tier(F.col("tier")) if "tier" in df.columns else F.col("label")
    df.select("id", "text", label.alias("label")).write.mode("overwrite").json(path)


def read_pairs(spark: SparkSession, path: str, optional: bool = True) -> DataFrame | None:
    """Pairs from CSV with quoted line ends; None if optional and absent."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if optional and not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(PAIR).csv(path, header=True, multiLine=True, quote='"', escape='"')


def write_csv(df: DataFrame, path: str) -> None:
    """Every field quoted, white space kept. A null is MARK, and a text that begins with MARK gets another before it."""
    texts = {c: F.when(F.startswith(F.col(c), F.lit(MARK)), F.concat(F.lit(MARK), F.col(c))).otherwise(F.col(c)) for c, kind in df.dtypes if kind == "string"}
    df.withColumns(texts).write.mode("overwrite").csv(path, header=True, quoteAll=True, **CSV)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What write_csv wrote: nulls, empty texts, white space at either end and line ends within a text come back as they were."""
    df = spark.read.schema(schema).csv(path, header=True, multiLine=True, **CSV)
    return df.withColumns({c: F.when(F.startswith(F.col(c), F.lit(MARK)), F.substring(F.col(c), 2, 2**31 - 1)).otherwise(F.col(c)) for c, kind in df.dtypes if kind == "string"})


def write_summary(df: DataFrame, path: str) -> None:
    """A one-row summary as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


def check_embeddings(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """One row: vectors, least and largest dimension, vectors with a null; a valid table has one dimension and no null."""
    return df.agg(F.count("*").alias("n"), F.min(F.size(vec_col)).alias("least_dim"), F.max(F.size(vec_col)).alias("largest_dim"), F.sum(F.exists(vec_col, lambda x: x.isNull()).cast("long")).alias("with_null"))
