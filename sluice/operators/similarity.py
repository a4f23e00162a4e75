"""Cosine search and links over embeddings, exact, in blocks: numpy products in Arrow batches, never a matrix or a cross join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.operators.graph import components
from sluice.sources.shared import written

#: Query vectors of a block, and vectors of a block of all pairs, about, up to 16 blocks; more vectors make blocks longer, up to 16 times that.
BLOCK = 2048
#: Queries whose cosines with a batch are held at once.
SLICE = 128
#: Bins of a histogram of cosines.
BINS = 1 << 17


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of unit length (a zero vector stays zero), in double."""
    n = len(column)
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1) if n else np.zeros((0, 1))
    norm = np.sqrt((x * x).sum(axis=1))
    return x / np.where(norm == 0, 1.0, norm)[:, None]


def search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float | None = None, top_k: int | None = None) -> DataFrame:
    """(query_id, id, similarity): for each query its rows of at least threshold, or its top_k rows (rank added).

    Cosines are cut to [-1, 1]; a query does not find its own id. Queries go out in blocks of about BLOCK vectors, each
    against all rows, SLICE queries at a time. top_k is cut in each batch first; ties by id. Rows with a null id or vector take no part.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).dropna()
    queries = queries.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).dropna()
    blocks = max(1, -(-queries.count() // BLOCK))
    out = None
    for b in range(blocks):
        found = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        q_ids, q = found.column("id").to_numpy(), _matrix(found.column("vec").combine_chunks())

        def run(batches, q_ids=q_ids, q=q):
            for batch in batches:
                ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
                if not len(ids) or not len(q_ids):
                    continue
                for lo in range(0, len(q_ids), SLICE):
                    own = q_ids[lo : lo + SLICE]
                    sim = np.clip(q[lo : lo + SLICE] @ x.T, -1.0, 1.0)
                    sim[own[:, None] == ids[None, :]] = -np.inf
                    if threshold is not None:
                        r, c = np.nonzero(sim >= threshold)
                    elif top_k is not None and top_k < len(ids):
                        edge = np.partition(sim, len(ids) - top_k, axis=1)[:, len(ids) - top_k]
                        r, c = np.nonzero((sim >= edge[:, None]) & np.isfinite(sim))
                    else:
                        r, c = np.nonzero(np.isfinite(sim))
                    yield pa.RecordBatch.from_arrays([pa.array(own[r], pa.int64()), pa.array(ids[c], pa.int64()), pa.array(sim[r, c], pa.float64())], names=["query_id", "id", "similarity"])

        part = rows.mapInArrow(run, "query_id long, id long, similarity double")
        out = part if out is None else out.unionByName(part)
    if top_k is None:
        return out
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)


def _unit(group: pa.Table) -> tuple[np.ndarray, np.ndarray, float]:
    """Rows of unit length in double and in single precision, and how far apart their cosines can be."""
    x = _matrix(group.column("vec").combine_chunks())
    return x, x.astype(np.float32), _eps(x.shape[1])


def _eps(width: int) -> float:
    return (width + 8) * 2.0**-23


def _exact(x: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosines of these pairs in double, the same for a pair wherever and however often it is computed."""
    out = np.empty(len(r))
    for lo in range(0, len(r), 1 << 14):
        out[lo : lo + (1 << 14)] = (x[r[lo : lo + (1 << 14)]] * x[c[lo : lo + (1 << 14)]]).sum(axis=1)
    return np.clip(out, -1.0, 1.0)


def _at_least(x: np.ndarray, y: np.ndarray, eps: float, rows: np.ndarray, cols: np.ndarray, threshold: float) -> np.ndarray:
    """Which of these pairs have a cosine of threshold: by single precision, and by double where that could err."""
    sim = y[rows] @ y[cols].T
    near = sim >= np.float32(threshold - eps)
    r, c = np.divmod(np.flatnonzero((near ^ (sim >= np.float32(threshold + eps))).ravel()), len(cols))
    short = _exact(x, rows[r], cols[c]) < threshold
    near[r[short], c[short]] = False
    return near


def _tiles(cols: np.ndarray) -> list[np.ndarray]:
    """cols in pieces whose products stay in a processor's cache."""
    return [cols[lo : lo + 2048] for lo in range(0, len(cols), 2048)]


def _placed(rows: DataFrame, longest: int | None = None) -> tuple[DataFrame, int]:
    """rows (id, ...) with own, the number of their block, and the number of blocks: ranges of ids, 16 if they hold BLOCK vectors, as many as hold longest (16 BLOCK) beyond."""
    n = rows.count()
    blocks = max(1, min(16, -(-n // BLOCK)), -(-n // (longest or 16 * BLOCK)))
    bounds = rows.approxQuantile("id", [k / blocks for k in range(1, blocks)], 1 / (8 * blocks)) if blocks > 1 else []
    return rows.withColumn("own", sum(((F.col("id") >= b).cast("int") for b in bounds), F.lit(0))), blocks


def _pairs_of_blocks(dealt: DataFrame, blocks: int) -> DataFrame:
    """dealt (i, j, ...) with as many partitions as pairs of blocks, up to 1000: one that is few bytes is still much work."""
    return dealt.repartition(min(1000, blocks * (blocks + 1) // 2), "i", "j")


def _dealt(vectors: DataFrame, id_col: str, vec_col: str, *more: str, longest: int | None = None) -> DataFrame:
    """(i, j, side, id, vec) and these columns: the vectors of each pair of blocks, i before j in order of id; i = j holds one block."""
    rows, blocks = _placed(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), *more).dropna(subset=["id", "vec"]), longest)
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "id", "vec", *more)
    return _pairs_of_blocks(dealt, blocks)


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of a pair of blocks, or twice those of a block."""
    if group.column("i")[0] == group.column("j")[0]:
        return (np.arange(len(group)),) * 2
    side = group.column("side").to_numpy()
    return np.flatnonzero(side == 0), np.flatnonzero(side == 1)


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """label with the components of these links made one, and which links did it."""
    least, most = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
    _, first = np.unique(least * len(label) + most, return_index=True)
    parent, used = {}, []

    def find(v):
        while v in parent:
            parent[v], v = parent.get(parent[v], parent[v]), parent[v]
        return v

    for k in first.tolist():
        u, v = find(int(least[k])), find(int(most[k]))
        if u != v:
            parent[max(u, v)] = min(u, v)
            used.append(k)
    to = np.arange(len(label))
    for v in parent:
        to[v] = find(v)
    return to[label], used


def link_forest(vectors: DataFrame, threshold: float, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(a, b): edges that connect what all pairs with cosine >= threshold connect, about one a vector.

    Blocks of vectors are searched first; then they meet in pairs of blocks, each a task of bounded size, where only
    vectors of different components are compared. A task returns a spanning forest and not its pairs.
    """

    def forest(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, (x, y, eps) = group.column("id").to_numpy(), _unit(group)
        label = np.unique(group.column("root").to_numpy(), return_inverse=True)[1] if "root" in group.column_names else np.arange(len(ids))
        (left, right), out = _sides(group), []
        for lo in range(0, len(left), 512):
            rows = left[lo : lo + 512]
            big = np.bincount(label).argmax()
            apart = label[right] != big
            for part, others in ((rows[label[rows] == big], right[apart]), (rows[label[rows] != big], right)):
                for cols in _tiles(others) if len(part) else ():
                    r, c = np.divmod(np.flatnonzero(_at_least(x, y, eps, part, cols, threshold).ravel()), len(cols))
                    a, b = part[r], cols[c]
                    a, b = a[label[a] != label[b]], b[label[a] != label[b]]
                    if len(a):
                        label, used = _joined(label, a, b)
                        out += zip(ids[a[used]].tolist(), ids[b[used]].tolist())
        at = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": at[:, 0], "b": at[:, 1]})

    rows, blocks = _placed(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).dropna())
    own = _pairs_of_blocks(rows.withColumns({"i": F.col("own"), "j": F.col("own")}), blocks).groupBy("i", "j").applyInArrow(forest, "a long, b long")
    if blocks == 1:
        return own
    own = written(own, "forest")
    roots = components(own).withColumnRenamed("node", "id")
    named = rows.select("id", "vec").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    cross = _dealt(named, "id", "vec", "root").filter("i <> j").groupBy("i", "j").applyInArrow(forest, "a long, b long")
    return own.unionByName(cross)


def pair_drops(vectors: DataFrame, threshold: float, kind: str, first: np.ndarray, second: np.ndarray, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id): ids that a pair id_a < id_b with cosine >= threshold gives up: id_a where first[kind_a, kind_b], id_b where second[kind_a, kind_b].

    kind: a column of numbers below len(first). No pair is listed: an id that is given up in a pair of blocks is only
    compared there with ids that may still be.
    """
    may = first.any(axis=1) | second.any(axis=0)

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        group = group.take(pa.array(np.argsort(group.column("id").to_numpy(), kind="stable")))
        ids, kinds, (x, y, eps) = group.column("id").to_numpy(), group.column(kind).to_numpy(), _unit(group)
        (left, right), gone, one = _sides(group), ~may[kinds], np.eye(len(first), dtype=np.float32)[kinds]
        for lo in range(0, len(left), 512):
            for cols in _tiles(right):
                rows = left[lo : lo + 512]
                for a, b in ((rows[~gone[rows]], cols), (rows[gone[rows]], cols[~gone[cols]])):
                    if not len(a) or not len(b):
                        continue
                    near = (_at_least(x, y, eps, a, b, threshold) & (ids[a][:, None] < ids[b][None, :])).astype(np.float32)
                    gone[a] |= ((near @ one[b] > 0) & first[kinds[a]]).any(axis=1)
                    gone[b] |= ((near.T @ one[a] > 0) & second.T[kinds[b]]).any(axis=1)
        return pa.table({"id": ids[gone & may[kinds]]})

    return _dealt(vectors, id_col, vec_col, kind).groupBy("i", "j").applyInArrow(run, "id long").distinct()


def threats(vectors: DataFrame, threshold: float, asked: DataFrame | None, gone: DataFrame | None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id_a, id_b, similarity): of each asked id_b (None: all) the pair with the most similar smaller id_a, of at least threshold; ties by id_a.

    gone (id_b, similarity): where id_a is an id_b of these, only a larger similarity than there counts. A pair of blocks
    returns a row for each asked vector at most; equal vectors are compared once.
    """
    some_went = gone is not None

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        group = group.take(pa.array(np.argsort(group.column("id").to_numpy(), kind="stable")))
        ids, side, (x, y, eps) = group.column("id").to_numpy(), group.column("side").to_numpy(), _unit(group)
        left, right, out = np.flatnonzero(side == 0), np.flatnonzero(side == 1), []
        end = group.column("end").to_numpy()
        form = np.ascontiguousarray(np.column_stack([x[left] + 0.0, end[left]]))
        left = np.sort(left[np.unique(form.view(np.dtype((np.void, form.shape[1] * 8))).ravel(), return_index=True)[1]]) if len(left) else left
        for lo in range(0, len(right), 512):
            rows, got = right[lo : lo + 512], []
            least = np.full((len(rows), 1), threshold - eps, np.float32)
            for cols in _tiles(left):
                sim = y[rows] @ y[cols].T
                if ids[cols[-1]] >= ids[rows[0]]:
                    sim[ids[cols][None, :] >= ids[rows][:, None]] = -2.0
                near, sure = sim, sim
                if some_went:
                    near = np.where(sim >= (end[cols] - eps).astype(np.float32), sim, np.float32(-2.0))
                    sure = np.where(sim >= (end[cols] + eps).astype(np.float32), sim, np.float32(-2.0))
                least = np.maximum(least, sure.max(axis=1, keepdims=True) - np.float32(2 * eps))
                r, c = np.divmod(np.flatnonzero((near >= least).ravel()), len(cols))
                got.append((r, cols[c], _exact(x, cols[c], rows[r])))
            if not got:
                break
            r, c, exact = (np.concatenate([g[k] for g in got]) for k in range(3))
            keep = (exact >= threshold) & (exact > end[c])
            r, c, exact = r[keep], c[keep], exact[keep]
            order = np.lexsort((ids[c], -exact, r))
            r, c, exact = r[order], c[order], exact[order]
            top = np.flatnonzero(np.diff(r, prepend=-1))
            out.append((ids[c[top]], ids[rows[r[top]]], exact[top]))
        a, b, s = (np.concatenate([o[k] for o in out]) for k in range(3)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"id_a": a, "id_b": b, "similarity": s})

    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).dropna()
    if asked is None:
        rows = rows.withColumns({"ask": F.lit(True), "end": F.lit(-2.0)})
    else:
        rows = rows.join(asked.select("id", F.lit(True).alias("ask")), "id", "left")
        rows = rows.join(gone.select(F.col("id_b").alias("id"), F.col("similarity").alias("end")), "id", "left").withColumn("end", F.coalesce("end", F.lit(-2.0)))
    rows, blocks = _placed(rows)
    into = F.concat(F.transform(F.sequence("own", F.lit(blocks - 1)), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(0).alias("side"))),
                    F.when(F.col("ask"), F.transform(F.sequence(F.lit(0), "own"), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(1).alias("side")))).otherwise(F.array().cast("array<struct<i:int,j:int,side:int>>")))
    dealt = _pairs_of_blocks(rows.select(F.explode(into).alias("at"), "id", "vec", "end").select("at.*", "id", "vec", "end"), blocks)
    found = dealt.groupBy("i", "j").applyInArrow(run, "id_a long, id_b long, similarity double")
    best = found.groupBy("id_b").agg(F.max(F.struct("similarity", (-F.col("id_a")).alias("back"))).alias("m"))
    return best.select((-F.col("m.back")).alias("id_a"), "id_b", F.col("m.similarity").alias("similarity"))


def percentiles(pairs: DataFrame, points=(50.0, 75.0, 90.0, 95.0, 99.0, 99.5, 99.9)) -> DataFrame:
    """(percentile, similarity): exact, with linear interpolation."""
    got = pairs.agg(F.percentile("similarity", F.array(*[F.lit(p / 100) for p in points])).alias("v"))
    return got.select(F.posexplode("v").alias("k", "similarity")).select(F.element_at(F.array(*[F.lit(p) for p in points]), F.col("k") + 1).alias("percentile"), "similarity")


def threshold_counts(pairs: DataFrame, thresholds) -> DataFrame:
    """(threshold, n): pairs of at least each threshold."""
    got = pairs.agg(*[F.sum((F.col("similarity") >= t).cast("long")).alias(f"t{k}") for k, t in enumerate(thresholds)])
    return got.select(F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.coalesce(f"t{k}", F.lit(0)).alias("n")) for k, t in enumerate(thresholds)])).alias("x")).select("x.*")


def _each_tile(vectors: DataFrame, start, add, end, schema: str, id_col: str, vec_col: str) -> DataFrame:
    """end(state) of each pair of blocks, after add(state, cosines in single precision, places of rows and columns, x, eps) of its tiles.

    Every pair of different ids is in one tile; -2 stands for the pairs that are not asked for.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        group = group.take(pa.array(np.argsort(group.column("id").to_numpy(), kind="stable")))
        ids, (x, y, eps) = group.column("id").to_numpy(), _unit(group)
        (left, right), state = _sides(group), start()
        for lo in range(0, len(left), 512):
            rows = left[lo : lo + 512]
            for cols in _tiles(right):
                if ids[cols[-1]] <= ids[rows[0]]:
                    continue
                sim = y[rows] @ y[cols].T
                if ids[cols[0]] <= ids[rows[-1]]:
                    sim[ids[cols][None, :] <= ids[rows][:, None]] = -2.0
                add(state, sim, rows, cols, x, eps)
        return end(state)

    return _dealt(vectors, id_col, vec_col).groupBy("i", "j").applyInArrow(run, schema)


def _between(sim: np.ndarray, least: float, most: float, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a tile with least <= cosine < most."""
    r, c = np.divmod(np.flatnonzero(((sim >= np.float32(least)) ^ (sim >= np.float32(most))).ravel()), len(cols))
    return rows[r], cols[c]


def _each_block(vectors: DataFrame, make, schema: str, id_col: str, vec_col: str) -> DataFrame:
    """make(ids of a, ids of b, similarities) over slices of each pair of blocks; every pair of rows is in one slice.

    Blocks hold BLOCK vectors and no more, as what a pair of them returns is one table.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        group = group.take(pa.array(np.argsort(group.column("id").to_numpy(), kind="stable")))
        ids, side, x = group.column("id").to_numpy(), group.column("side").to_numpy(), _matrix(group.column("vec").combine_chunks())
        split = group.column("i")[0] != group.column("j")[0]
        left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if split else (np.arange(len(ids)),) * 2
        out = []
        for lo in range(0, len(left), 256):
            part = left[lo : lo + 256]
            sim = np.clip(x[part] @ x[right].T, -1.0, 1.0)
            r, c = np.nonzero(ids[part][:, None] != ids[right][None, :] if split else part[:, None] < right[None, :])
            out.append(make(ids[part[r]], ids[right[c]], sim[r, c]))
        return pa.concat_tables(out) if out else make(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    return _dealt(vectors, id_col, vec_col, longest=BLOCK).groupBy("i", "j").applyInArrow(run, schema)


def all_pairs(vectors: DataFrame, threshold: float, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id_a, id_b, similarity): every pair id_a < id_b with cosine >= threshold; rows with a null id or vector take no part."""

    def make(a, b, sim):
        keep = (sim >= threshold) & (a != b)
        a, b, sim = a[keep], b[keep], sim[keep]
        return pa.table({"id_a": np.minimum(a, b), "id_b": np.maximum(a, b), "similarity": sim})

    return _each_block(vectors, make, "id_a long, id_b long, similarity double", id_col, vec_col)


def all_threshold_counts(vectors: DataFrame, thresholds, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(threshold, n): pairs of at least each threshold among all pairs; a block pair returns its counts only."""
    at = np.array([float(t) for t in thresholds])

    def add(n, sim, rows, cols, x, eps):
        for k, t in enumerate(at):
            n[k] += np.count_nonzero(sim >= np.float32(t + eps)) + int((_exact(x, *_between(sim, t - eps, t + eps, rows, cols)) >= t).sum())

    counted = _each_tile(vectors, lambda: np.zeros(len(at), np.int64), add, lambda n: pa.table({"threshold": at, "n": n}), "threshold double, n long", id_col, vec_col).groupBy("threshold").agg(F.sum("n").alias("n"))
    grid = vectors.sparkSession.createDataFrame([(float(t),) for t in at], "threshold double")
    return grid.join(counted, "threshold", "left").select("threshold", F.coalesce("n", F.lit(0)).alias("n"))


def all_percentiles(vectors: DataFrame, points=(50.0, 75.0, 90.0, 95.0, 99.0, 99.5, 99.9), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(percentile, similarity) over all pairs: exact, with linear interpolation, and without the pairs in one place.

    Block pairs first return histograms of BINS bins in single precision. That tells within which bounds the value of
    each wanted rank lies; a second run counts what is below them and returns the values between, both in double. Of
    those the ones near a rank are picked by a finer histogram. No pair at all: null.
    """

    def count(n, sim, rows, cols, x, eps):
        sim = sim.ravel() if sim.min() > -1.5 else sim[sim > -1.5]
        n += np.bincount(np.clip((sim + np.float32(1)) * np.float32(BINS / 2), 0, BINS - 1).astype(np.int64), minlength=BINS)

    def filled(n):
        return pa.table({"bin": np.flatnonzero(n), "n": n[n > 0]})

    got = _each_tile(vectors, lambda: np.zeros(BINS, np.int64), count, filled, "bin long, n long", id_col, vec_col).groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").toArrow()
    bins, sizes = got.column("bin").to_numpy(), got.column("n").to_numpy()
    spark, schema, total = vectors.sparkSession, "percentile double, similarity double", int(sizes.sum())
    if not total:
        return spark.createDataFrame([(float(p), None) for p in points], schema)
    places = [(total - 1) * p / 100 for p in points]
    ranks = np.array(sorted({r for x in places for r in (int(np.floor(x)), int(np.ceil(x)))}))
    held, of = np.unique(bins[np.searchsorted(np.cumsum(sizes), ranks, side="right")], return_inverse=True)
    slack = _eps(vectors.agg(F.max(F.size(vec_col))).first()[0]) + 2.0**-20
    bounds = [(b * 2 / BINS - 1 - slack, (b + 1) * 2 / BINS - 1 + slack) for b in held.tolist()]

    def between(state, sim, rows, cols, x, eps):
        valid = sim.size if sim.min() > -1.5 else np.count_nonzero(sim > -1.5)
        for k, (low, high) in enumerate(bounds):
            exact = _exact(x, *_between(sim, low - eps, high + eps, rows, cols))
            state[0][k] += valid - np.count_nonzero(sim >= np.float32(low - eps)) + int((exact < low).sum())
            state[1].append((k, exact[(exact >= low) & (exact <= high)]))

    def kept(state):
        ks = np.concatenate([np.full(len(v), k) for k, v in state[1]] + [np.arange(len(bounds))])
        none = np.full(len(bounds), np.nan)
        values = np.concatenate([v for _, v in state[1]] + [none])
        return pa.table({"k": ks.astype(np.int64), "value": values, "below": np.concatenate([np.zeros(len(ks) - len(bounds), np.int64), state[0]])})

    rows = written(_each_tile(vectors, lambda: (np.zeros(len(bounds), np.int64), []), between, kept, "k long, value double, below long", id_col, vec_col), "values")
    below = {r.k: r.n for r in rows.groupBy("k").agg(F.sum("below").alias("n")).collect()}
    ends = F.element_at(F.array(*[F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in bounds]), F.col("k").cast("int") + 1)
    rows = rows.filter(~F.isnan("value")).select("k", "value", F.floor((F.col("value") - ends["low"]) / (ends["high"] - ends["low"]) * 4096).alias("sub"))
    fine = rows.groupBy("k", "sub").count().orderBy("k", "sub").collect()
    wanted = {}
    for rank, k in zip(ranks.tolist(), of.tolist()):
        before = below[k]
        for r in (r for r in fine if r.k == k):
            if rank < before + r["count"]:
                wanted[rank] = k, r["sub"], rank - before
                break
            before += r["count"]
    near = rows.join(F.broadcast(spark.createDataFrame(sorted({w[:2] for w in wanted.values()}), "k long, sub long")), ["k", "sub"]).collect()
    at = {rank: sorted(r.value for r in near if (r.k, r["sub"]) == w[:2])[w[2]] for rank, w in wanted.items()}
    found = [(float(p), at[int(np.floor(x))] + (at[int(np.ceil(x))] - at[int(np.floor(x))]) * (x - np.floor(x))) for p, x in zip(points, places)]
    return spark.createDataFrame([(p, float(v)) for p, v in found], schema)
