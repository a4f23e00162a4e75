"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted verification.

A window has as many shingles as the item that is looked for. Its fingerprint is split into eight blocks of eight bits;
within a radius of 23 bits one block at least differs in two bits or fewer, so a table from each block's values and
their neighbours to the items finds every item whose fingerprint lies within the radius. What the table finds is checked
by its Hamming distance and then by the exact similarity: the sum of the smaller over the sum of the larger shingle
weights, where a shingle's weight is how often it occurs.

A window can reach similarity 0.8 only if eight ninths of its shingles are an item's. So windows with fewer shingles of
the benchmark (a set, not an index of items) get no fingerprint, which loses nothing. The radius can: SimHash distances
of similarity 0.8 lie near 10 bits, standard deviation 3, so about one window in 100,000 at that border is missed.
"""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import steps, table, written

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BLOCKS = 8
#: Bits that two fingerprints may differ in, and the bits that then one block at most does.
RADIUS = 23
BLOCK_BITS = RADIUS // BLOCKS
#: Text of benchmark items that one pass over the documents takes; a larger benchmark takes more passes.
ITEM_BYTES = 16 << 20
#: Windows whose fingerprints are made at once.
RUN = 2048
_VALUES = np.arange(256)
_NEAR = np.bitwise_count(_VALUES[:, None] ^ _VALUES[None, :]) <= BLOCK_BITS
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(SHINGLE_WORDS)], np.uint64)


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """A 64-bit hash of each run of width words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(crc32, words), np.uint64, len(words)) + np.uint64(1)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += h[k : k + n] * _POWERS[k]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def window_fingerprints(hashes: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each run of size hashes (of all of them, if fewer): a bit is 1 if set in over half."""
    size = min(size, len(hashes))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    total = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    return np.packbits(2 * (total[size:] - total[:-size]) > size, axis=1, bitorder="little").view(np.uint64).ravel()


def weigh(words: list[bytes], width: int) -> Counter:
    return Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def similarity(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


class BlockTable:
    """Fingerprints by block value: for each block and value the items whose block is the value or a neighbour of it."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        octets = prints.view(np.uint8).reshape(-1, BLOCKS)
        held = [np.nonzero(_NEAR[:, octets[:, b]]) for b in range(BLOCKS)]
        keys = np.concatenate([b * 256 + value for b, (value, _) in enumerate(held)])
        self.items = np.concatenate([item for _, item in held])
        self.first = np.searchsorted(keys, np.arange(BLOCKS * 256 + 1))

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of a print, number of an item) of all that lie within RADIUS, in order."""
        keys = (prints.view(np.uint8).reshape(-1, BLOCKS) + np.arange(BLOCKS) * 256).ravel()
        lo = self.first[keys]
        n = self.first[keys + 1] - lo
        ends = np.cumsum(n)
        place = np.arange(ends[-1]) + np.repeat(lo - ends + n, n)
        met = np.repeat(np.arange(len(prints)), n.reshape(-1, BLOCKS).sum(axis=1)) * len(self.prints) + self.items[place]
        which, item = np.divmod(np.unique(met), len(self.prints))
        near = np.bitwise_count(prints[which] ^ self.prints[item]) <= RADIUS
        return which[near], item[near]


class ItemIndex:
    """Items of a benchmark by width and number of shingles; each such group has a block table."""

    def __init__(self, items: list[tuple]):
        groups: dict[tuple[int, int], list] = {}
        hashes: dict[int, list[np.ndarray]] = {}
        for item_id, text in items:
            words = split_words(text)
            if not words:
                continue
            width = min(SHINGLE_WORDS, len(words))
            h = shingle_hashes(words, width)
            hashes.setdefault(width, []).append(h)
            groups.setdefault((width, len(h)), []).append((item_id, window_fingerprints(h, len(h))[0], weigh(words, width)))
        self.widths = []
        for width, rows in sorted(hashes.items()):
            keys = np.unique(np.concatenate(rows))
            maybe = np.zeros(1 << 20, bool)
            maybe[keys >> np.uint64(44)] = True
            sizes = [(size, held, BlockTable(np.array([x[1] for x in held], np.uint64))) for (w, size), held in sorted(groups.items(), key=lambda g: g[0]) if w == width]
            self.widths.append((width, keys, maybe, sizes))

    def find(self, text: str | None) -> list[tuple]:
        """(item id, similarity, first word, words) of the best window of each item that reaches SIMILARITY."""
        words, best = split_words(text), {}
        for width, keys, maybe, sizes in self.widths:
            h = shingle_hashes(words, width)
            at = np.flatnonzero(maybe[h >> np.uint64(44)])
            at = at[keys[np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)] == h[at]]
            if not len(at):
                continue
            known = np.zeros(len(h) + 1, np.int64)
            known[at + 1] = 1
            known = np.cumsum(known)
            for size, held, blocks in sizes:
                n = min(size, len(h))
                need = int(np.ceil(SIMILARITY * (n + size) / (1 + SIMILARITY) - 1e-9))
                if len(at) < need:
                    continue
                for lo, hi in _runs(np.flatnonzero(known[n:] - known[:-n] >= need)):
                    for s, k in zip(*blocks.within(window_fingerprints(h[lo : hi + n], n)), strict=True):
                        self._verify(words, lo + int(s), n + width - 1, width, held[k], best, (width, size, int(k)))
        return list(best.values())

    @staticmethod
    def _verify(words, first, n_words, width, item, best, key) -> None:
        got = similarity(weigh(words[first : first + n_words], width), item[2])
        if got >= SIMILARITY and (key not in best or got > best[key][1]):
            best[key] = (item[0], got, first, n_words)


def _runs(starts: np.ndarray):
    """First and last of each run of neighbouring windows, RUN at most."""
    if len(starts):
        for part in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
            for k in range(0, len(part), RUN):
                yield int(part[k]), int(part[min(k + RUN, len(part)) - 1])


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """Lists of items of at most ITEM_BYTES of text each (one item at least); the driver holds one list at a time."""
    block, held = [], 0
    for r in benchmark.select(id_col, text_col).dropna().distinct().toLocalIterator():
        if block and held + len(r[1]) > ITEM_BYTES:
            yield block
            block, held = [], 0
        block.append((r[0], r[1]))
        held += len(r[1])
    yield block


def _passes(benchmark: DataFrame, id_col: str, text_col: str):
    """(index, whether it is the last) of each list of items."""
    blocks = _item_blocks(benchmark, id_col, text_col)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        yield ItemIndex(block), following is None
        block = following


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item with a window of similarity 0.8 or more: doc_id, item_id, similarity, first_word, n_words.

    The best window is told, the first of equals. Null and empty texts on either side have no leak; items with a null
    id or text are not looked for; items of fewer than five words are one shingle. A text shorter than an item is one
    window; a very long one is read whole, with fingerprints of a bounded number of windows at a time. Repeated rows
    repeat their leaks; an empty table on either side gives no rows. Ids may be of any type; other columns aren't read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = [rows.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, similarity double, first_word long, n_words long"

    from pyspark.sql.pandas.types import to_arrow_type

    of_item = to_arrow_type(benchmark.schema[item_id].dataType)

    def apply(index):
        def run(batches):
            for batch in batches:
                for part in steps(batch, "text"):
                    found = [(d, *x) for d, t in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True) for x in index.find(t)]
                    types = (part.schema.field("doc_id").type, of_item, pa.float64(), pa.int64(), pa.int64())
                    cols = list(zip(*found, strict=True)) or [[]] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types, strict=True)], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

        return rows.mapInArrow(run, schema)

    out = None
    for index, last in _passes(benchmark, item_id, item_text):
        part = apply(index) if last else written(apply(index), "leaks")  # as a table its index need not stay
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, all columns, without those whose text leaks an item (find_leaks); no shuffle."""

    def apply(left, index):
        def run(batches):
            for batch in batches:
                for part in steps(batch, text_col):
                    yield part.filter(pa.array([not index.find(t) for t in part.column(text_col).to_pylist()], pa.bool_()))

        return left.mapInArrow(run, docs.schema)

    for index, last in _passes(benchmark, item_id, item_text):
        docs = apply(docs, index) if last else written(apply(docs, index), "clean")
    return docs


def op6_decontaminate(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
