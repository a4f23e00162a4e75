"""Labelling and rewriting through pluggable callables, with a content-hash cache and resumption by id."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.text import content_key


def cache_split(rows: DataFrame, cache: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(hits with the cache's columns, misses) by content key; the cache has a column hash."""
    keyed = rows.withColumn("hash", content_key(F.col(text_col)))
    return keyed.join(cache.dropDuplicates(["hash"]), "hash"), keyed.join(cache, "hash", "left_anti")


def remaining(rows: DataFrame, done: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id no finished row has: where a stopped run goes on."""
    return rows.join(done.select(id_col), id_col, "left_anti")


def label_rows(rows: DataFrame, labeler: Callable[[str], str], text_col: str = "text", out_col: str = "label") -> DataFrame:
    """Adds the labeler's answer to each row; a call that fails gives ERROR for its row alone."""

    def ask(text):
        try:
            return labeler(text)
        except Exception:  # one row's failure is its label
            return "ERROR"

    def run(frames):
        for pdf in frames:
            yield pdf.assign(**{out_col: pd.Series([ask(t) for t in pdf[text_col]], index=pdf.index, dtype=object)})

    base = rows.drop(out_col)
    return base.mapInPandas(run, base.schema.add(out_col, "string"))
