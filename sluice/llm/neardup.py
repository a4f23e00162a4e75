"""SimHash near-duplicates: byte-position inverted index with count filtering, then connected components.

A fingerprint has 64 bits, eight positional bytes. Two fingerprints within three bits differ in at most three bytes, so
five of eight positional bytes agree. The index posts each distinct fingerprint under byte triples of the positions
0 to 3 and of the positions 4 to 7: of any five agreeing positions three lie in one half, so every pair within the
radius meets under one of these eight postings. Where a posting list is met, the shared positional bytes of its pairs
are tallied, pairs below five are dropped, and the rest are verified by their Hamming distance.

Only distinct fingerprints are posted, so copies form no pairs. A long posting list is dealt out in blocks: its members
are split into chunks, and each pair of chunks is a task's own group of bounded size. Each group returns a spanning
forest of its links (fewer edges than members), which keeps every connection. Components come from alternating
large-star and small-star steps over a table in the shared folder.

Groups of documents of a similarity (similar_groups) are searched with the same index at a wider radius, where it posts
byte pairs; its edges are verified on whole shingle sets. Fingerprints guarantee no similarity, so prefix filtering then
finds the links that the index left out.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.common import append_columns, broadcast_if_few, give_back, table, written
from sluice.operators.graph import components
from sluice.sources.shared import forget

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
#: Members of a chunk of a posting list, about.
CHUNK = 1024
#: Similar documents: shingles of this many words, and tenths of the Jaccard similarity of their sets.
SIMILAR_WORDS, SIMILAR_TENTHS = 5, 8
#: Their fingerprints are met with two equal positional bytes and differ in at most so many bits (seen: 99 of 100 pairs do, 50 of 100 in 10).
SIMILAR_AGREE, SIMILAR_RADIUS = 2, 14
#: Texts of the sample that tells common shingles, about, or this share of all if that is more, and the most that are told.
SAMPLE, SAMPLE_SHARE, COMMON = 10_000, 0.2, 1_000_000
#: Members of other components, nearest by fingerprints and within so many bits, that a member of a posting list meets before all do.
NEAREST, NEAREST_RADIUS = 8, 20
#: Posting lists of so many members at most are compared all at once.
SHORT = 64
_PAIRS = list(combinations(range(8), 2))
_TRIPLES = [tuple(base + p for p in range(4) if p != out) for base in (0, 4) for out in range(4)]


def _hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of the lower-cased (A-Z) word shingles, in order."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - width].tolist()]
    stops = (ends[width - 1 :] - 1).tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash as an unsigned integer: XXH64 of lower-cased (A-Z) word shingles, repeats included.

    Fewer words than a shingle has: the whole sequence is one; none (null and empty texts): 0.
    """
    return _simhash(_hashes(text, width))


def _simhash(h: np.ndarray) -> int:
    """A bit is 1 if set in over half the hashes; no hash: 0."""
    if len(h) < 2:
        return int(h[0]) if len(h) else 0
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[lo : lo + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > len(h)).tolist()))


def add_fingerprints(df: DataFrame, text_col: str = "text", width: int = SHINGLE_WORDS, out_col: str = "fp") -> DataFrame:
    """Adds the fingerprint (as a signed long) to every row; a column of df of that name is replaced."""

    def make(part):
        return (np.array([fingerprint(t, width) for t in part.column(text_col).to_pylist()], np.uint64).view(np.int64),)

    return append_columns(df, text_col, [T.StructField(out_col, T.LongType())], make)


def forest(fps: np.ndarray, side: np.ndarray | None, radius: int = RADIUS, agree: int = 8 - RADIUS) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of the links among fps that agree in so many bytes (between the sides, where side is given)."""
    n = len(fps)
    if n == 2 and side is None:
        return [(0, 1)] if int(fps[0] ^ fps[1]).bit_count() <= radius else []
    octets = fps.view(np.uint8).reshape(-1, 8)
    label, out = np.arange(n), []
    left = np.arange(n) if side is None else np.flatnonzero(side == 0)
    right = np.arange(n) if side is None else np.flatnonzero(side == 1)
    for lo in range(0, len(left), 256):
        rows = left[lo : lo + 256]
        tally = np.zeros((len(rows), len(right)), np.uint8)
        for p in range(8):
            tally += octets[rows, p][:, None] == octets[right, p][None, :]
        r, c = np.nonzero(tally >= agree)
        near = np.bitwise_count(fps[rows[r]] ^ fps[right[c]]) <= radius
        r, c = rows[r[near]], right[c[near]]
        at = np.searchsorted(r, rows, side="left").tolist() + [len(r)]
        for k, i in enumerate(rows.tolist()):
            with_ = c[at[k] : at[k + 1]]
            with_ = with_[label[with_] != label[i]]
            if len(with_):
                labels, first = np.unique(label[with_], return_index=True)
                out += [(i, int(with_[f])) for f in first]
                label[np.isin(label, labels)] = label[i]
    return out


def _short_lists(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int, agree: int, label: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Index pairs of links within each of these short lists of fps (of different labels), and which lists are left out: of as many pairs as members."""
    if not len(starts) or sizes.max() < 2:
        return [], np.zeros(len(starts), bool)
    at = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    ends, owner = np.repeat(starts + sizes, sizes), np.repeat(np.arange(len(starts)), sizes)
    octets, found = fps.view(np.uint8).reshape(-1, 8), []
    for step in range(1, int(sizes.max())):
        inside = at + step < ends
        at, ends, owner = at[inside], ends[inside], owner[inside]
        met = (octets[at] == octets[at + step]).sum(axis=1) >= agree
        if label is not None:
            met &= label[at] != label[at + step]
        met[met] = np.bitwise_count(fps[at[met]] ^ fps[at[met] + step]) <= radius
        found.append((owner[met], at[met], at[met] + step))
    owner, x, y = (np.concatenate([f[k] for f in found]) for k in range(3))
    dense = np.bincount(owner, minlength=len(starts)) >= sizes
    return list(zip(x[~dense[owner]].tolist(), y[~dense[owner]].tolist())), dense


def links(distinct: DataFrame, radius: int = RADIUS, agree: int | None = None) -> DataFrame:
    """(a, b): edges that connect exactly what links of at most radius (3) bits among distinct fingerprints (fp) connect.

    With agree (2 at least) links are those of fingerprints that also have so many equal positional bytes, at any radius.
    """
    if agree is None and radius > 3:
        raise ValueError("the index guarantees a radius of three bits at most")
    if agree is not None and agree < 2:
        raise ValueError("the index meets fingerprints of two equal positional bytes at least")
    agree, places = (8 - radius, _TRIPLES) if agree is None else (agree, _PAIRS)
    octet = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    keys = [F.lit(f << 24).cast("long") + sum(octet(p) * (1 << 8 * k) for k, p in enumerate(reversed(t))) for f, t in enumerate(places)]
    postings = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    lengths = postings.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = postings.join(lengths, "key").withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("long"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    met = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    met = met.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "fp")
    dealt = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")

    def _edges(cur, cuts):
        fps, cuts = np.ascontiguousarray(cur["fp"]).view(np.uint64), np.array(cuts, np.int64)
        starts, sizes = cuts[:-1], np.diff(cuts)
        short = (sizes <= SHORT) & (cur["i"][starts] == cur["j"][starts])
        out, dense = _short_lists(fps, starts[short], sizes[short], radius, agree)
        short[short] = ~dense
        for a, b in zip(starts[~short].tolist(), cuts[1:][~short].tolist()):
            side = cur["side"][a:b] if cur["i"][a] != cur["j"][a] else None
            out += [(a + x, a + y) for x, y in forest(fps[a:b], side, radius, agree)]
        at = np.array(out, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(cur["fp"][at[:, k]], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return dealt.mapInArrow(lambda batches: _by_list(batches, ("key", "i", "j"), _edges), "a long, b long")


def _by_list(batches, names: tuple[str, ...], judge):
    """judge(columns, cuts) of whole lists: neighbouring rows equal in these columns, the first one first."""
    carry = None
    for batch in batches:
        cur = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        if carry is not None:
            cur = {c: np.concatenate([carry[c], v]) for c, v in cur.items()}
        if not len(cur[names[0]]):
            continue
        new = np.flatnonzero(np.any([np.diff(cur[c]) != 0 for c in names], axis=0)) + 1
        last = int(new[-1]) if len(new) else 0
        yield judge({c: v[:last] for c, v in cur.items()}, [0, *new[:-1].tolist(), last] if last else [0])
        carry = {c: v[last:] for c, v in cur.items()}
    if carry is not None:
        yield judge(carry, [0, len(carry[names[0]])])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest id reachable) of every row.

    Null and empty texts have fingerprint zero and link like any other. A null id gets the component of its text.
    Repeated rows come back as often as they came in; an empty table gives an empty result.
    """
    rows = written(add_fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", width).select("doc_id", "fp"), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    stars = components(links(distinct.select("fp")))
    roots = stars.select(F.col("node").alias("fp"), "root").union(stars.select(F.col("root").alias("fp"), "root").distinct())
    classes = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    final = classes.join(smallest, "root").select("fp", "component_id")
    return rows.join(final, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, width: int = SIMILAR_WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes; null and empty texts: none; fewer words than a shingle has: one."""
    return np.unique(_hashes(text, width))


def _common_shingles(texts: DataFrame) -> np.ndarray:
    """Shingles of three or more distinct texts of a sample; they only set an order, so a miss costs time and no pair."""
    share = min(1.0, max(SAMPLE_SHARE, SAMPLE / max(1, texts.count())))
    spot = F.pmod(F.xxhash64("text", F.lit(SEED)), F.lit(1 << 20)) < F.lit(share * (1 << 20))
    sample = texts.select("text").filter(spot).distinct()

    def run(batches):
        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t).view(np.int64))], names=["x"])

    counted = sample.mapInArrow(run, "x long").groupBy("x").count().filter("count > 2").orderBy(F.desc("count"), "x").limit(COMMON)
    return np.sort(counted.select("x").toArrow().column("x").to_numpy().view(np.uint64))


def sketch(s: np.ndarray) -> bytes:
    """How many hashes of a set begin with each value of their first bits (255: that many or more), about two a value."""
    bits = min(11, max(3, int(len(s)).bit_length() - 1))
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def most_shared(x: bytes, y: bytes) -> int:
    """No two sets with these sketches share more hashes: the longer sketch is folded, the smaller counts are summed."""
    a, b = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (x, y))
    a[a == 255], b[b == 255] = 1 << 40, 1 << 40
    n = min(len(a), len(b))
    return int(np.minimum(a.reshape(n, -1).sum(axis=1), b.reshape(n, -1).sum(axis=1)).sum())


def _alike(shared: int, n_a: int, n_b: int) -> bool:
    return 10 * shared >= SIMILAR_TENTHS * (n_a + n_b - shared)


def _fits(a: str, b: str):
    """Sizes of two sets (n_, with these endings) that allow the similarity, with a shared shingle at their places (pos_), if it is the first they share."""
    sizes = 10 * F.least(f"n_{a}", f"n_{b}") >= SIMILAR_TENTHS * F.greatest(f"n_{a}", f"n_{b}")
    after = F.least(F.col(f"n_{a}") - F.col(f"pos_{a}"), F.col(f"n_{b}") - F.col(f"pos_{b}"))
    return sizes & ((10 + SIMILAR_TENTHS) * after >= SIMILAR_TENTHS * (F.col(f"n_{a}") + F.col(f"n_{b}")))


def _verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of similarity 0.8 or more: first by sketches, which drop no such pair, then by the whole sets of what is left."""
    small = sets.select("key", "n", "sketch")
    for side in "ab":
        pairs = pairs.join(small.withColumnsRenamed({"key": side, "n": f"n_{side}", "sketch": f"s_{side}"}), side)

    def prune(batches):
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("s_a", "s_b", "n_a", "n_b")]
            keep = [_alike(most_shared(x, y), m, n) for x, y, m, n in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    likely = written(pairs.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(prune, "a long, b long"), "likely")
    wanted = likely.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    named = written(sets.select("key", "th").join(wanted, "key", "left_semi").select("th"), "wanted")

    def spell(batches):
        for batch in batches:
            got = [shingle_set(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_set_key(s) for s in got], pa.int64()), pa.array([s.tobytes() for s in got], pa.binary())], names=["key", "s"])
        give_back()

    spelled = texts.join(broadcast_if_few(named, 1_000_000), "th", "left_semi").select("text").mapInArrow(spell, "key long, s binary")
    spelled = written(spelled.dropDuplicates(["key"]), "sets")
    both = likely.join(spelled.withColumnsRenamed({"key": "a", "s": "s_a"}), "a").join(spelled.withColumnsRenamed({"key": "b", "s": "s_b"}), "b")

    def verify(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("s_a"), batch.column("s_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep.append(_alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    out = written(both.select("a", "b", "s_a", "s_b").mapInArrow(verify, "a long, b long"), "links")
    for table_ in (likely, named, spelled):
        forget(table_)
    return out


def _near_keys(sets: DataFrame) -> DataFrame:
    """(a, b): keys of sets that the index of their fingerprints connects, and keys of equal fingerprints."""
    first = sets.groupBy("fp").agg(F.min("key").alias("least"))
    edges = links(first.select("fp"), SIMILAR_RADIUS, SIMILAR_AGREE).distinct()
    for side in "ab":
        edges = edges.withColumnRenamed(side, "fp").join(first, "fp").drop("fp").withColumnRenamed("least", side)
    equal = sets.join(first, "fp").filter("key <> least").select(F.col("least").alias("a"), F.col("key").alias("b"))
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(equal).distinct()


def similar_links(sets: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links of keys of sets (key, n, prefix, sketch, fp, th) that connect what all pairs of similarity 0.8 or more connect.

    First the byte-position index of the fingerprints is searched with its count filter and Hamming check, a spanning
    forest a posting list, and its edges are verified on the whole sets of their texts (texts: text, th).

    What it left out is found by prefix filtering, exact: in one fixed order, common shingles last, two such sets share
    one of each other's first n - ceil(0.8 n) + 1 shingles, and what follows the first shared one leaves room for the
    rest. In the posting lists that hold several components a member is first compared with those of other components
    whose fingerprints are nearest, so it costs a few pairs; then, in the lists that still hold several, all pairs of
    different ones are. Long lists are dealt out in pairs of chunks. All candidates are verified alike.
    """
    judged = written(_near_keys(sets), "near")
    found = _verified(judged, sets, texts)
    label = components(found).withColumnsRenamed({"node": "key", "root": "label"})
    postings = sets.select("key", "n", "fp", F.posexplode("prefix").alias("pos", "x"))
    shared = postings.groupBy("x").agg(F.count("*").alias("held")).filter("held > 1")
    met = written(postings.join(shared, "x"), "postings")
    nearest = _nearest_pairs(_open_lists(met, label)).distinct()
    nearest = written(nearest.join(judged, ["a", "b"], "left_anti"), "nearest")
    judged, found = judged.unionByName(nearest), found.unionByName(_verified(nearest, sets, texts))
    rows = _open_lists(met, components(found).withColumnsRenamed({"node": "key", "root": "label"})).drop("fp")
    a, b = (rows.withColumnsRenamed({"key": k, **{c: f"{c}_{k}" for c in ("n", "pos", "side", "label")}}) for k in "ab")
    apart = (F.col("a") < F.col("b")) & ((F.col("i") == F.col("j")) | (F.col("side_a") != F.col("side_b"))) & (F.col("label_a") != F.col("label_b")) & _fits("a", "b")
    rest = written(a.join(b, ["x", "i", "j"]).filter(apart).select("a", "b").distinct().join(judged, ["a", "b"], "left_anti"), "candidates")
    return found.unionByName(_verified(rest, sets, texts))


def _open_lists(met: DataFrame, label: DataFrame) -> DataFrame:
    """Postings of the lists that hold several components, with the component of their key (its own without links), dealt out in pairs of chunks."""
    rows = met.join(label, "key", "left").withColumn("label", F.coalesce("label", "key"))
    still = rows.groupBy("x").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least <> most").select("x")
    rows = rows.join(still, "x").withColumn("chunks", F.ceil(F.col("held") / CHUNK).cast("long")).withColumn("own", F.pmod(F.xxhash64("key"), F.col("chunks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    return rows.select("x", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "key", "n", "pos", "label", "fp")


def nearest_others(fps: np.ndarray, label: np.ndarray, side: np.ndarray | None) -> list[tuple[int, int]]:
    """Index pairs: each member, but those of the most frequent label, with its nearest few of other labels (and of the other side)."""
    _, at, counts = np.unique(label, return_inverse=True, return_counts=True)
    few, out = np.flatnonzero(at != counts.argmax()), []
    for lo in range(0, len(few), 256):
        r = few[lo : lo + 256]
        far = np.bitwise_count(fps[r][:, None] ^ fps[None, :])
        far[at[r][:, None] == at[None, :]] = 255
        if side is not None:
            far[side[r][:, None] == side[None, :]] = 255
        for i, row in zip(r.tolist(), far):
            c = np.argpartition(row, NEAREST)[:NEAREST] if len(row) > NEAREST else np.arange(len(row))
            out += [(i, int(k)) for k in c[row[c] <= NEAREST_RADIUS]]
    return out


def _nearest_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): keys of different components in one of these lists, near by fingerprints; in lists of many such pairs the nearest few of a member."""

    def pairs(cur, cuts):
        fps, cuts = np.ascontiguousarray(cur["fp"]).view(np.uint64), np.array(cuts, np.int64)
        starts, sizes = cuts[:-1], np.diff(cuts)
        short = (sizes <= SHORT) & (cur["i"][starts] == cur["j"][starts])
        out, dense = _short_lists(fps, starts[short], sizes[short], NEAREST_RADIUS, 0, cur["label"])
        short[short] = ~dense
        for a, b in zip(starts[~short].tolist(), cuts[1:][~short].tolist()):
            out += [(a + x, a + y) for x, y in nearest_others(fps[a:b], cur["label"][a:b], cur["side"][a:b] if cur["i"][a] != cur["j"][a] else None)]
        at = cur["key"][np.array(out, np.int64).reshape(-1, 2)]
        return pa.RecordBatch.from_arrays([pa.array(at.min(axis=1), pa.int64()), pa.array(at.max(axis=1), pa.int64())], names=["a", "b"])

    dealt = rows.select("x", "i", "j", "side", "key", "label", "fp").repartition("x", "i", "j").sortWithinPartitions("x", "i", "j")
    return dealt.mapInArrow(lambda batches: _by_list(batches, ("x", "i", "j"), pairs), "a long, b long")


def _set_key(s: np.ndarray) -> int:
    """A signed 64-bit name of a shingle set; the empty set: 0."""
    return int(np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED)], np.uint64).view(np.int64)[0]) if len(s) else 0


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (hash of the text) and root of every row: rows of one root are linked by similarities of 0.8 or more.

    The similarity is the Jaccard of the sets of five-word shingles, and the fingerprints are of these sets; no pair is missed. Null and empty texts are one
    group, a null id is grouped by its text, repeated rows come back as often as they came in.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("th"))
    common = _common_shingles(texts)

    def make(part):
        keys, sizes, prefixes, sketches, fps = [], [], [], [], []
        for t in part.column("text").to_pylist():
            s = shingle_set(t)
            n = len(s)
            often = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s if len(common) else np.zeros(n, bool)
            keys.append(_set_key(s))
            sizes.append(n)
            prefixes.append(np.concatenate([s[~often], s[often]])[: n + (-SIMILAR_TENTHS * n // 10) + 1 if n else 0].view(np.int64))
            sketches.append(sketch(s))
            fps.append(_simhash(s))
        return keys, sizes, prefixes, sketches, np.array(fps, np.uint64).view(np.int64)

    fields = [T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType()), T.StructField("fp", T.LongType())]
    rows = written(append_columns(texts, "text", fields, make).drop("text"), "prefixes")
    sets = rows.groupBy("key").agg(F.min("n").alias("n"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"), F.min("fp").alias("fp"), F.min("th").alias("th"))
    stars = components(similar_links(written(sets, "distinct-sets"), texts))
    roots = stars.select(F.col("node").alias("key"), "root").union(stars.select(F.col("root").alias("key"), "root").distinct())
    return rows.select("doc_id", "th", "key").join(roots, "key", "left").select("doc_id", "th", F.coalesce("root", "key").alias("root"))


def op5_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
