"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source gets a target of words: the budget shared by weight, at most three times the source, the excess reshared
until no target is above. Each document of a source, in a shuffled order, has for each of three rounds the virtual
finish time (words of the source up to and with it, all earlier rounds included) / target. All finish times are sorted
together and the sequence ends at the budget.

No window ever holds a source or the whole table: running sums come from sums of hash ranges (slices) and a window
inside each slice, so a source with a third of all rows is spread like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import table, written

WEIGHTS = (5.0, 2.0, 1.0)
MOST_ROUNDS = 3
#: Rows of a slice of the shuffled order, about.
SLICE_ROWS = 2000
SEED = "mix-42"
_RUN = r"[^\x20\x09-\x0D]+"


def words(text):
    """Number of runs of characters that are not white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(_RUN)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_ROUNDS, share: float = 1.0) -> DataFrame:
    """source, source_size, weight, target from (source, source_size): one row per source, so the windows are small.

    Sources in order of code points, null last, take the weights in turn. Sources are capped in order of size per
    weight; the first level that the next one's cap does not fall below holds for the rest.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", turn).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_cap = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    earlier, later = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rows = (rows.withColumn("budget", F.lit(share) * F.sum("source_size").over(everything))
            .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum("weight").over(later))
            .withColumn("open", F.col("cap") / F.col("weight") >= F.col("level")))
    rows = rows.withColumn("level", F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.col("cap") / F.col("weight"))).over(everything))
    return rows.select("source", "source_size", "weight", F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap")).alias("target"), "budget")


def _positions(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """docs (doc_id, source, size, h) with source columns and upto: words of the source up to and with the row."""
    small = sources.withColumn("slices", F.ceil(F.col("rows") / SLICE_ROWS).cast("long"))
    same = docs["source"].eqNullSafe(small["source"])
    rows = docs.join(F.broadcast(small) if _few(small) else small, same).drop(small["source"])
    rows = rows.withColumn("slice", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * F.col("slices") / F.lit(float(1 << 32))).cast("long"))
    sums = rows.groupBy("source", "slice").agg(F.sum("size").alias("part"))
    inner = Window.partitionBy("source", "slice").orderBy("h", F.col("doc_id").asc_nulls_first(), "size", *(["row_key"] if "row_key" in docs.columns else []))
    # sums of slices: rows / SLICE_ROWS rows, summed up source by source
    before = sums.withColumn("before", F.sum("part").over(Window.partitionBy("source").orderBy("slice")) - F.col("part"))
    inside = rows.withColumn("inside", F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    b = before.select(F.col("source").alias("b_source"), F.col("slice").alias("b_slice"), "before")
    joined = inside.join(b, inside["source"].eqNullSafe(b["b_source"]) & (inside["slice"] == b["b_slice"]))
    return joined.withColumn("upto", F.col("before") + F.col("inside")).drop("b_source", "b_slice", "before", "inside", "slice", "slices", "rows")


def _few(df: DataFrame, most: int = 100_000) -> bool:
    """A checked bound for a broadcast: at most this many short rows."""
    return df.limit(most + 1).count() <= most


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = 1.0, row_key: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every row; with a row_key also that, as row_key.

    taken is size times copies, the rounds (0 to 3) in which the mix takes the document. Null texts have size 0, a null
    source is a source of its own (last). The order is by md5 of the id, then id, then size, so reruns agree; repeated
    rows have places of their own. A row_key orders rows that are alike in these. Documents of size 0 are taken with their neighbours. An empty table gives no rows.
    """
    key = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    rows = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), key.alias("h"), *([] if row_key is None else [row_key.alias("row_key")])), "sizes")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    t = targets(per_source.select("source", "source_size"), weights, MOST_ROUNDS, share)
    t = written(per_source.join(t.withColumnsRenamed({"source": "t_source", "source_size": "t_size"}), F.col("source").eqNullSafe(F.col("t_source"))).select("source", "source_size", "rows", "target", "budget"), "targets")
    placed = written(_positions(rows, t), "places")
    times = [F.when(F.col("target") > 0, (F.lit(e) * F.col("source_size") + F.col("upto")) / F.col("target")) for e in range(MOST_ROUNDS)]
    end = _end(placed, times)
    copies = F.lit(0)
    if end is not None:
        last = F.struct(F.lit(end[0]).alias("t"), F.lit(end[1]).alias("h"))
        copies = reduce(lambda a, b: a + b, [F.when(F.struct(x.alias("t"), F.col("h").alias("h")) <= last, 1).otherwise(0) for x in times])
    return placed.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), copies.cast("int").alias("copies"), *([] if row_key is None else ["row_key"]))


def _end(placed: DataFrame, times: list):
    """The last (finish time, h) that the budget holds: sums of ranges of finish times, then one range in order."""
    whole = placed.agg(F.max("budget"), F.count("*"), F.max(F.greatest(*times))).first()
    if whole[2] is None:
        return None
    budget, ranges = whole[0], max(1, -(-whole[1] * MOST_ROUNDS // SLICE_ROWS))
    events = placed.select("h", "size", F.explode(F.array(*times)).alias("t")).filter("t is not null")
    at = F.least(F.floor(F.col("t") / F.lit(float(whole[2])) * ranges), F.lit(ranges - 1)).cast("long")
    ranged = events.withColumn("range", at)
    sums = ranged.groupBy("range").agg(F.sum("size").alias("part"))
    total = sums.withColumn("upto", F.sum("part").over(Window.orderBy("range")))  # one row a range
    cut = total.filter(F.col("upto") > F.lit(budget)).orderBy("range").limit(1).first()
    if cut is None:
        return events.agg(F.max(F.struct("t", "h"))).first()[0]
    inside = ranged.filter(F.col("range") == cut["range"])
    run = inside.groupBy("t", "h").agg(F.sum("size").alias("size"))
    run = run.withColumn("upto", F.sum("size").over(Window.orderBy("t", "h")) + F.lit(cut["upto"] - cut["part"]))
    fits = run.filter(F.col("upto") <= F.lit(budget)).agg(F.max(F.struct("t", "h"))).first()[0]
    return fits or ranged.filter(F.col("range") < cut["range"]).agg(F.max(F.struct("t", "h"))).first()[0]


def op8_mix(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).drop("copies")


ORACLE_SQL = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                  md5('mix-42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
              3.0::DOUBLE * source_size AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS budget FROM s0),
s2 AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
s3 AS (SELECT *, (SELECT level FROM s2 WHERE cap / weight >= level ORDER BY cap / weight, source NULLS LAST LIMIT 1) AS held FROM s2),
t AS (SELECT source, source_size, budget, coalesce(least(cap, held * weight), cap) AS target FROM s3),
p AS (SELECT d.doc_id, d.size, d.h, t.source_size, t.target, t.budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT p.*, (r.r * source_size + upto) / target AS vt FROM p CROSS JOIN (VALUES (0), (1), (2)) r(r) WHERE target > 0),
k AS (SELECT *, sum(size) OVER (ORDER BY vt, h RANGE UNBOUNDED PRECEDING) AS so_far FROM (SELECT vt, h, budget, sum(size) AS size FROM e GROUP BY ALL)),
c AS (SELECT max(struct_pack(vt := vt, h := h)) AS last FROM k WHERE so_far <= budget)
SELECT p.doc_id, p.size, p.source_size, p.target,
       CAST(p.size * (SELECT count(*) FROM (VALUES (0), (1), (2)) r(r) WHERE p.target > 0
            AND struct_pack(vt := (r.r * p.source_size + p.upto) / p.target, h := p.h) <= (SELECT last FROM c)) AS BIGINT) AS taken
FROM p
"""
