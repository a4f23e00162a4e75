"""Shared plumbing: Arrow batches cut by bytes, raw UTF-8 access, sizes of shuffles, hash-ordered samples."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.sources.shared import fresh_path, remove_path, shared_folder, written  # noqa: F401

#: Bytes of text that one Python step handles at once; a longer single text forms a step of its own.
STEP_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_of(df: DataFrame, each: int) -> int:
    """Partitions for a shuffle of df: the session's number, or more where the plan's estimate of bytes over each is more."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, -(-size // each)))


def broadcast_if_few(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df of short rows, to be broadcast where a count shows that it has at most so many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5 is 0; null ids count as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def hash_order(col: Column, seed: int) -> Column:
    """A fixed pseudo-random order: unsigned enough for thresholds, equal in every run."""
    return F.xxhash64(col, F.lit(seed))


def raw_utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a string array, and n + 1 offsets; nulls are empty."""
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type)
    buf = arr.buffers()
    if len(arr) == 0 or buf[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    off = np.frombuffer(buf[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    return np.frombuffer(buf[2], np.uint8)[off[0] : off[-1]], off - off[0]


def steps(batch: pa.RecordBatch, text_col: str):
    """Slices of a batch of at most STEP_BYTES of text each, one row at least."""
    _, off = raw_utf8(batch.column(text_col))
    start = 0
    while start < len(off) - 1:
        end = max(start + 1, int(np.searchsorted(off, off[start] + STEP_BYTES, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def give_back() -> None:
    """Return free memory of this Python worker to the system: workers outlive their tasks and share an executor's bound."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def append_columns(df: DataFrame, text_col: str, fields: list[T.StructField], make) -> DataFrame:
    """df with new columns from Arrow steps; columns of df of the same names are replaced.

    make: gets an iterator-independent slice, a RecordBatch, and returns one pa.Array or sequence per field.
    It may be a factory with attribute ``per_task``; it is then called once in each task.
    """
    names = {f.name.lower() for f in fields}
    base = df.drop(*[c for c in df.columns if c.lower() in names])
    schema = T.StructType(base.schema.fields + fields)
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in fields]
    per_task = getattr(make, "per_task", False)

    def run(batches):
        step = make() if per_task else make
        for batch in batches:
            for part in steps(batch, text_col):
                cols = [c if isinstance(c, pa.Array) else pa.array(c, type=k) for c, k in zip(step(part), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=[*part.schema.names, *(f.name for f in fields)])
        give_back()

    return base.mapInArrow(run, schema)


def sampled_texts(df: DataFrame, key: str, text_col: str, per_key: int, most: int, seed: int) -> DataFrame:
    """(key, text): about per_key distinct texts of each key, chosen by a hash threshold: no sort, no window, no group in one task.

    Where the keys are so many that this exceeds most texts, each key has fewer, one text's share at least. Copies of a
    text count once, so a large group of them is one row.
    """
    keys = [(r[0], r[1]) for r in df.groupBy(key).count().orderBy(key).collect()]  # one row a key
    if not keys:
        return df.select(key, text_col).limit(0)
    each = max(1, min(per_key, most // len(keys)))
    share = F.create_map(*[F.lit(x) for k, n in keys for x in (k, min(1.0, each / n))])
    spot = F.pmod(F.xxhash64(F.col(text_col), F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    chosen = df.filter(spot < F.coalesce(F.element_at(share, F.col(key)), F.lit(0.0)))
    return chosen.groupBy(key, F.xxhash64(text_col).alias("__h")).agg(F.min(text_col).alias(text_col)).select(key, text_col)
