"""Document fingerprints: a Merkle tree over paragraphs and sections.

A paragraph (leaf) ends at a line end or at the end of a sentence, and after 256 characters at the latest. A section
ends after a paragraph whose hash is a multiple of 8, so edits move no other section's border. A leaf's hash is that of
its text, a section's that of its leaves' hashes, the root's that of its sections' hashes. Equal roots mean equal
texts; below differing roots, equal sections are passed over and the differing ones tell where the edits are.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import table

_LEAF = re.compile(r"[^.!?\n]{1,256}(?:[.!?]+[^\S\n]*\n*|\n+)?|[.!?\n]+")
LEAF_BYTES = 8


def _hash(raw: bytes, size: int = LEAF_BYTES) -> bytes:
    return hashlib.blake2b(raw, digest_size=size).digest()


def _length(leaf: bytes) -> int:
    return int.from_bytes(leaf[LEAF_BYTES:])


class MerkleTree:
    """sections: tuples of leaves (hash and two bytes of length); names: their hashes; root: 16 bytes; size: characters."""

    def __init__(self, leaves: list[bytes]):
        self.sections, held = [], []
        for h in leaves:
            held.append(h)
            if not h[0] & 7:
                self.sections.append(tuple(held))
                held = []
        if held:
            self.sections.append(tuple(held))
        self.names = [_hash(b"".join(s)) for s in self.sections]
        self.root = _hash(b"".join(self.names), 16)
        self.size = sum(map(_length, leaves))

    @classmethod
    def of(cls, text: str | None) -> MerkleTree:
        """The tree of a whole text; null and empty texts have no leaf."""
        return cls([_hash(x.encode("utf-8", "replace")) + min(len(x), 0xFFFF).to_bytes(2) for x in _LEAF.findall(text or "")])

    @property
    def text(self) -> str:
        """The fingerprint: the root, then four bytes of hash and two of length of each leaf, sections apart."""
        return self.root.hex() + ":" + ".".join(base64.b64encode(b"".join(h[:4] + h[LEAF_BYTES:] for h in s), b"-_").decode() for s in self.sections)

    def differing(self, other: MerkleTree) -> tuple[list[int], list[int]]:
        """Numbers of the sections of either tree that the other has not."""
        if self.root == other.root:
            return [], []
        common, mine, theirs = Counter(self.names) & Counter(other.names), [], []
        for names, out in ((self.names, mine), (other.names, theirs)):
            left = common.copy()
            for i, n in enumerate(names):
                if left[n]:
                    left[n] -= 1
                else:
                    out.append(i)
        return mine, theirs

    def likeness(self, other: MerkleTree) -> float:
        """Characters in shared leaves (repeats included) over those of the larger tree; 1 for equal roots."""
        if self.root == other.root:
            return 1.0
        mine, theirs = self.differing(other)
        a, b = (Counter(h for i in numbers for h in tree.sections[i]) for tree, numbers in ((self, mine), (other, theirs)))
        same = self.size - sum(n * _length(h) for h, n in a.items()) + sum(n * _length(h) for h, n in (a & b).items())
        return same / max(self.size, other.size)


_FIRST = -(1 << 63)


def _bounds(docs: DataFrame, buckets: int) -> tuple[np.ndarray, dict[int, int], int, int]:
    """Lower bounds of id ranges, the range before each range's first id, the first id, the last range; from ids alone."""
    ids = docs.select(F.coalesce(F.col("doc_id"), F.lit(_FIRST)).alias("k"))
    cuts = np.unique(np.array(ids.stat.approxQuantile("k", [i / buckets for i in range(1, buckets)], 0.2 / buckets) if buckets > 1 else [], np.float64)).astype(np.int64)

    def least(batches):
        for b in batches:
            k = b.column(0).to_numpy()
            if len(k):
                at = np.searchsorted(cuts, k, side="right")
                order = np.lexsort((k, at))
                first = np.unique(at[order], return_index=True)[1]
                yield pa.RecordBatch.from_arrays([pa.array(at[order][first], pa.int64()), pa.array(k[order][first], pa.int64())], names=["bucket", "k"])

    rows = sorted((r[0], r[1]) for r in ids.mapInArrow(least, "bucket long, k long").groupBy("bucket").agg(F.min("k")).collect())  # one row a range
    before = {k: rows[i - 1][0] for i, (_, k) in enumerate(rows)}
    return cuts, before, len(rows), rows[-1][0] if rows else 0


def with_next(docs: DataFrame, make, schema: str) -> DataFrame:
    """Rows that make(doc_id, text, next text, state) gives for each row of docs (doc_id, text) and the row after it.

    The order is ascending by id (null first, equal ids by content); after the last row comes the first. One shuffle of
    compressed texts into id ranges; the first row of each range is also sent to the range before it.
    """
    buckets = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts, before, _, _ = _bounds(docs, buckets)

    def pack(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for b in batches:
            k = b.column(0).fill_null(_FIRST).to_numpy()
            at = np.searchsorted(cuts, k, side="right").tolist()
            k, out = k.tolist(), []
            for i, text in enumerate(b.column(1)):
                raw = packer.compress(text.as_py().encode("utf-8", "replace"))
                out.append((at[i], 0, k[i], raw))
                if k[i] in before:
                    out.append((before[k[i]], 1, k[i], raw))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "extra", "k", "packed"])

    dealt = docs.mapInArrow(pack, "bucket int, extra int, k long, packed binary").repartition(buckets, "bucket").sortWithinPartitions("bucket", "extra", "k", "packed")

    def run(batches):
        unpack, held, out, state = zstandard.ZstdDecompressor(), None, [], {}
        for batch in batches:
            for bucket, extra, k, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                if held is not None and held[0] != bucket:
                    held = None  # the range is complete: its last row met the next one's first
                if extra and held is None:
                    continue
                text = unpack.decompress(packed.as_py()).decode()
                if held is not None:
                    out.append(make(None if held[1] == _FIRST else held[1], held[2], text, state))
                held = None if extra else (bucket, k, text)
                if len(out) >= 500:
                    yield out
                    out = []
        yield out

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def batched(batches):
        for rows in run(batches):
            cols = list(zip(*rows)) or [[]] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], names=arrow.names)

    return dealt.mapInArrow(batched, schema)


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 4) code points replaced by the first as many (or all) of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each whole text and of its edited form, and their likeness: one row per row of docs.

    Null texts are empty; an empty text equals any other empty one (likeness 1). A single row follows itself. Repeated
    ids follow each other in an order of their contents; an empty table gives an empty result.
    """

    def make(doc_id, text, following, state):
        own = state["tree"] if state.get("of") == text else MerkleTree.of(text)
        new = edited(text, following)
        other, after = MerkleTree.of(new), MerkleTree.of(following)
        state["of"], state["tree"] = following, after
        return doc_id, len(text), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), own.text, other.text, own.likeness(other), own.likeness(after)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_next(rows, make, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op10_merkle(spark, sf_dir):
    return compare_with_edits(table(spark, sf_dir, "documents"))
