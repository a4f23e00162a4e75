"""Samples from templates: seeds, templates and fillers are parameters; choices come from hashes of seed and row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEEDS = {0: ["What does std::move do?", "Explain that pointer."], 1: ["Refactor this parser to use iterators.", "Add a cache to the loader."], 2: ["Design a lock-free queue.", "Find the deadlock in this scheduler."]}
TEMPLATES = {0: ["Explain {thing} in one line", "Show an example of {thing}"], 1: ["Refactor {thing} to support {need}", "Extend {thing} with {need}"], 2: ["Design {thing} that survives {need}", "Prove that {thing} is safe under {need}"]}
FILLERS = {"thing": ["a vector", "the parser", "a hash map", "the scheduler"], "need": ["many threads", "late data", "lost messages"]}
PREFIXES = ["Can you ", "Please ", "I would like to "]


def _pick(options: list[str], *salt) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64("id", *[F.lit(s) for s in salt]), F.lit(len(options))) + 1).cast("int"))


def _chance(seed: int, name: str) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(name)), F.lit(10000)) / 10000.0


def generate(spark: SparkSession, n: int, seed: int = 42, seeds=SEEDS, templates=TEMPLATES, fillers=FILLERS, prefixes=PREFIXES) -> DataFrame:
    """(id, text, tier): n rows, tiers in turn; a quarter seeds, the rest filled templates; half with a prefix and a small first letter."""
    rows = spark.range(n).withColumn("tier", F.pmod("id", F.lit(3)).cast("int"))
    text = F.lit(None).cast("string")
    for tier in seeds:
        made = _pick(templates[tier], seed, "template")
        for name, words in fillers.items():
            made = F.replace(made, F.lit("{" + name + "}"), _pick(words, seed, name))
        text = F.when(F.col("tier") == tier, F.when(_chance(seed, "seed") < 0.25, _pick(seeds[tier], seed, "seed-text")).otherwise(made)).otherwise(text)
    rows = rows.withColumn("text", text)
    first = F.element_at(F.split("text", " "), 1)
    small = F.when(first.rlike("^[A-Z][a-z]*[^A-Za-z]*$") & (first != "I"), F.concat(F.lower(F.substring("text", 1, 1)), F.substr("text", F.lit(2)))).otherwise(F.col("text"))
    return rows.select("id", F.when(_chance(seed, "talk") < 0.5, F.concat(_pick(prefixes, seed, "prefix"), small)).otherwise(F.col("text")).alias("text"), "tier")
