"""Token ids in a binary shard format: one shared zstandard dictionary, each document compressed on its own.

A shard holds the documents of one range of ids, in ascending order of id:

    magic SLTK1\\n | sha256 of the dictionary | u32 length of the header | header (JSON: documents, bytes of an id)
    offset index: per document i64 id, u8 id is null, u64 offset of its frame, u32 bytes of its frame, u64 tokens
    frames: one zstandard frame per document over its ids (little-endian u16, or u32 for larger vocabularies)

so one document is read by its index entry alone. Shards are rows of a Parquet table in the shared folder, which any
store that Spark writes to can hold and which a lost executor's retry replaces as a whole; the dictionary is a row too.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import sys
import zlib
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import broadcast_if_few, fresh_path, give_back, partitions_of, table

MAGIC = b"SLTK1\n"
END_ID = 1
LEVEL = 3
DICTIONARY_BYTES = 64 << 10
#: Documents (whole texts) whose ids train the dictionary, at most.
DICTIONARY_DOCS = 1000
#: Bytes of frames after which a shard is closed.
SHARD_BYTES = 1 << 20
#: Bytes of known pieces that a Python worker keeps at most, the longest one kept, characters of a step.
KNOWN_BYTES, KEPT_LENGTH, TEXT_STEP = 144 << 20, 64, 1 << 20
#: Input bytes of a range of ids, about: the number of ranges grows with the input.
RANGE_BYTES = 64 << 20
_INDEX = np.dtype([("id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("bytes", "<u4"), ("tokens", "<u8")])
_SPACE = re.compile(rb"[ \t-\r]")
# The normalizer and splitter of the vocabulary, and the splitter's pieces in lower-case Latin-1.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
SPLITTER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}
_L, _N = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe"
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\t-\r \x85\xa0{_L}{_N}]+".encode("latin-1"))


def _state(part) -> dict:
    return json.loads(part.__getstate__()) if part is not None else {}


def _byte_letters() -> dict[int, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stand for themselves, others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(rest)}


class Known(dict):
    """Values of make by key, bounded in bytes: a key is kept when it comes again, and where the map is full its oldest quarter goes."""

    #: Bytes of an entry besides its key and value: two objects and a place in the table (measured: 138 MB hold 428,000).
    ENTRY = 300
    DOORS = 1 << 19

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.size, self.doors, self.marked = make, most, 0, bytearray(self.DOORS), 0

    def __missing__(self, key) -> bytes:
        value = self.make(key)
        if len(key) > KEPT_LENGTH:
            return value
        door = hash(key) & (self.DOORS - 1)
        if not self.doors[door]:  # not met lately
            self.marked += 1
            if self.marked > self.DOORS // 2:
                self.doors, self.marked = bytearray(self.DOORS), 1
            self.doors[door] = 1
            return value
        if self.size > self.most:
            for old in list(islice(self, len(self) // 4)):
                self.size -= len(old) + len(self.pop(old)) + self.ENTRY
        self[key] = value
        self.size += len(key) + len(value) + self.ENTRY
        return value


class Encoder:
    """Ids of whole texts as bytes, from the tokenizers library, with a bounded map of known pieces.

    The vocabulary's normalizer works on single characters, its pieces never cross white space, and PIECES cuts
    lower-cased Latin-1 text as its splitter does. So the ids of a text are those of its pieces in turn: pieces not met
    before go to the library's model, words with other letters through its whole encode().
    """

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        #: By pieces only where the vocabulary is of the form that this is exact for.
        self.by_piece = _state(self.tokenizer.normalizer) == NORMALIZER and _state(self.tokenizer.pre_tokenizer) == SPLITTER and type(self.tokenizer.model).__name__ == "BPE"
        self.letters, self.end = _byte_letters(), np.array([end_id], self.kind).tobytes()
        self.code, self.known = "H" if self.kind.itemsize == 2 else "I", Known(self._ids, KNOWN_BYTES)

    def _pack(self, ids) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _ids(self, part: bytes | str) -> bytes:
        """Ids of a piece (bytes), or of a word whose letters' lower case or composition may be more than one character's affair."""
        if isinstance(part, str):
            return self._pack(self.tokenizer.encode(part, add_special_tokens=False).ids)
        word = part.decode("latin-1")
        shown = word if word.isalpha() and word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return self._pack([t.id for t in self.model.tokenize(shown)])

    def _latin(self, raw: bytes) -> bytes:
        """Ids of lower-case Latin-1 text, in steps that end at white space."""
        out, at = [], 0
        while at < len(raw):
            end = at + TEXT_STEP
            end = m.start() if end < len(raw) and (m := _SPACE.search(raw, end)) else len(raw)
            out.append(b"".join(map(self.known.__getitem__, PIECES.findall(raw, at, end))))
            at = end
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Serialized ids of a whole text (null: empty), the end id last."""
        text = text or ""
        if not self.by_piece:
            return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids) + self.end
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            words = [w.decode() for w in text.encode("utf-8", "replace").split()]
            return b"".join([self._latin(w.lower().encode()) if w.isascii() else self.known[w] for w in words]) + self.end
        return self._latin(text.lower().encode("latin-1")) + self.end


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str, known_bytes: int = KNOWN_BYTES) -> Encoder:
    """The encoder of this Python worker, kept from task to task with its maps, which are bounded in bytes."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    _ENCODERS[path].known.most = known_bytes
    return _ENCODERS[path]


def pack_shard(docs: list[tuple[int | None, bytes, int]], dictionary: bytes, width: int) -> bytes:
    """A shard of (id, frame, tokens) rows."""
    index = np.zeros(len(docs), _INDEX)
    index["id"], index["null"] = [d[0] or 0 for d in docs], [d[0] is None for d in docs]
    index["bytes"], index["tokens"] = [len(d[1]) for d in docs], [d[2] for d in docs]
    index["offset"] = np.concatenate([[0], np.cumsum(index["bytes"].astype(np.uint64))[:-1]]) if docs else 0
    header = json.dumps({"documents": len(docs), "width": width}).encode()
    return MAGIC + hashlib.sha256(dictionary).digest() + struct.pack("<I", len(header)) + header + index.tobytes() + b"".join(d[1] for d in docs)


class Shard:
    """Reads a shard; single documents by their place, without touching others."""

    def __init__(self, raw: bytes, dictionary: bytes):
        if raw[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token shard")
        at = len(MAGIC)
        if raw[at : at + 32] != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        (n,) = struct.unpack_from("<I", raw, at + 32)
        header = json.loads(raw[at + 36 : at + 36 + n])
        self.kind = np.dtype(f"<u{header['width']}")
        self.index = np.frombuffer(raw, _INDEX, header["documents"], at + 36 + n)
        self.frames = memoryview(raw)[at + 36 + n + self.index.nbytes :]
        self.reader = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def ids(self, place: int) -> np.ndarray:
        e = self.index[place]
        raw = self.reader.decompress(self.frames[int(e["offset"]) : int(e["offset"]) + int(e["bytes"])])
        return np.frombuffer(raw, self.kind)

    def doc_id(self, place: int):
        return None if self.index["null"][place] else int(self.index["id"][place])


def _dictionary(raw: bytes):
    return zstandard.ZstdCompressionDict(raw) if raw else None


def train_dictionary(docs: DataFrame, path: str, limit: int = DICTIONARY_DOCS, seed: int = 42) -> bytes:
    """A zstandard dictionary from the serialized ids of at most limit whole distinct texts in hash order; empty if too few.

    The texts come from a share of the hash range, so copies count once and no more than about limit rows are shuffled.
    """
    share = min(1.0, limit / max(1, docs.count()))
    rows = docs.select("text", F.xxhash64("text", F.lit(seed)).alias("h")).dropna(subset=["text"])
    rows = rows.filter(F.pmod("h", F.lit(1 << 20)) < F.lit(share * (1 << 20)))
    rows = rows.groupBy("h").agg(F.min("text").alias("text")).orderBy("h").limit(limit)

    def run(batches):
        encoder = encoder_of(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encoder.encode(t) for t in b.column(1).to_pylist()], pa.binary())], names=["h", "ids"])

    samples = [bytes(r["ids"]) for r in sorted(rows.mapInArrow(run, "h long, ids binary").collect(), key=lambda r: r["h"])]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too short samples
        return b""


SHARDS = "first_id long, no int, before long, tokens long, shard binary"


def write_shards(docs: DataFrame, path: str, out: str, known_bytes: int = KNOWN_BYTES) -> str:
    """Encode (doc_id, text) and write shards in ascending order of doc_id (null first; equal ids by hash of the text, then text) below out.

    Ranges are cut by id and hash, so the rows of an id that many rows share are dealt out as well.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    dictionary = train_dictionary(docs, path)
    spark.createDataFrame([(bytearray(dictionary),)], "dictionary binary").write.parquet(f"{out}/dictionary")
    order = [F.col("doc_id").asc_nulls_first(), F.col("h").asc()]
    ordered = docs.repartitionByRange(partitions_of(docs, RANGE_BYTES), *order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())

    def run(batches):
        encoder, packer = encoder_of(path, known_bytes), zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary))
        held, size, no, before = [], 0, 0, 0
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())

        def shard():
            named = [d[0] for d in held if d[0] is not None]
            row = (min(named, default=None), no, before, sum(d[2] for d in held), pack_shard(held, dictionary, encoder.kind.itemsize))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=["first_id", "no", "before", "tokens", "shard"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = encoder.encode(text.as_py())
                held.append((doc_id, packer.compress(raw), len(raw) // encoder.kind.itemsize))
                size += len(held[-1][1])
                if size >= SHARD_BYTES:
                    yield shard()
                    before += sum(d[2] for d in held)
                    held, size, no = [], 0, no + 1
        if held:
            yield shard()
        give_back()

    ordered.select("doc_id", "text").mapInArrow(run, SHARDS).withColumn("range", F.spark_partition_id()).write.parquet(f"{out}/shards")
    return out


def read_shards(spark, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the shards below out, which are not shuffled."""
    dictionary = bytes(spark.read.parquet(f"{out}/dictionary").first()[0])
    shards = spark.read.parquet(f"{out}/shards")
    sums = shards.groupBy("range").agg(F.sum("tokens").alias("n"))  # one row a range: as many as the writer had tasks
    starts = sums.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("start"))
    placed = shards.join(broadcast_if_few(starts), "range").select((F.col("start") + F.col("before")).alias("at"), "shard")

    def run(batches):
        _ENCODERS.clear()  # the shards are written: their encoder's memory goes
        give_back()
        for b in batches:
            for start, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                shard = Shard(raw.as_py(), dictionary)
                n = shard.index["tokens"].astype(np.int64)
                starts = start + np.concatenate([[0], np.cumsum(n)])[:-1]
                crc, counts = [], []
                for k in range(len(n)):
                    ids = shard.ids(k)
                    counts.append(len(ids))
                    crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                cols = ([shard.doc_id(k) for k in range(len(n))], starts, counts, crc)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize(docs: DataFrame, path: str, out: str | None = None, known_bytes: int = KNOWN_BYTES) -> DataFrame:
    """Write docs (doc_id, text) as shards and read them back: one row per row of docs.

    Null and empty texts hold the end id alone; repeated rows are written as often as they come; an empty table gives an
    empty result; a very long text is encoded whole, in steps of bounded size. Ids are long integers or null; other
    columns of docs are not read. out: a path below which shards are written, else a fresh one in the shared folder.
    known_bytes: memory of the known pieces of a Python worker, which changes no result.
    """
    spark = docs.sparkSession
    return read_shards(spark, write_shards(docs, path, out or fresh_path(spark, "tokens"), known_bytes))


def op4_tokens(spark, sf_dir):
    import public_tokenizers

    return tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
