"""Language identification by prediction by partial matching (PPM).

For each language the training texts give a byte context tree of orders 0 to 3: how often each byte followed each
context. A byte is coded at the longest context with escape method C: a seen byte costs -log2(c / (n + d)), where n
counts the context and d its distinct followers; else the escape costs -log2(d / (n + d)) and the next shorter context
codes it, down to 8 bits. A context that the language never had is passed over at no cost. Statistics are frozen after
training, so the length of a text is a sum over its bytes and does not depend on the order of texts. The language with
the shortest exact code wins; ties go to the smaller name.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.common import append_columns, held_out, sampled_texts

ORDER = 3
PAD = b"\n" * ORDER
#: Documents of each language that training reads, about, and of all: whole texts; where languages are many, each has fewer.
TRAIN_DOCS_PER_LANG, TRAIN_DOCS = 250, 100_000
#: Costs that the code lengths of a text look up at once, over all languages.
LOOKUPS = 1 << 21
_LETTER = re.compile(r"[^\W\d_]")


def _codes(data: np.ndarray, width: int) -> np.ndarray:
    """The big-endian code of the width bytes that end at each position from ORDER on."""
    n = len(data) - ORDER
    out = np.zeros(n, np.uint32)
    for k in range(width):
        out = (out << np.uint32(8)) | data[ORDER - width + 1 + k : ORDER - width + 1 + k + n]
    return out


class PpmModel:
    """Frozen context trees of all languages, flattened to code-length tables."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.langs = sorted(samples)
        found: list[list[tuple]] = []  # [order][lang] -> symbol codes, counts, context codes, totals, distinct
        for order in range(ORDER + 1):
            row = []
            for lang in self.langs:
                parts = [_codes(np.frombuffer(PAD + t, np.uint8), order + 1) for t in samples[lang] if t]
                code, c = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint32), return_counts=True)
                ctx, first, d = np.unique(code >> np.uint32(8), return_index=True, return_counts=True)
                n = np.add.reduceat(c, first) if len(c) else np.zeros(0, np.int64)
                row.append((code, c, ctx, n, d))
            found.append(row)
        self.symbols, self.sym_cost, self.contexts, self.esc_cost = [], [], [], []
        for row in found:
            symbols = np.unique(np.concatenate([np.zeros(0, np.uint32)] + [x[0] for x in row]))
            contexts = np.unique(np.concatenate([np.zeros(0, np.uint32)] + [x[2] for x in row]))
            sym = np.full((len(row), len(symbols)), np.nan)
            esc = np.zeros((len(row), len(contexts)))
            for k, (code, c, ctx, n, d) in enumerate(row):
                at = np.searchsorted(ctx, code >> np.uint32(8))
                sym[k, np.searchsorted(symbols, code)] = -np.log2(c / (n + d)[at]) if len(c) else 0
                esc[k, np.searchsorted(contexts, ctx)] = -np.log2(d / (n + d))
            self.symbols.append(symbols), self.sym_cost.append(sym), self.contexts.append(contexts), self.esc_cost.append(esc)
        # Two tables that make the common case two lookups: byte pairs are numbered, and a pair of pairs finds its costs.
        top = self.symbols[ORDER]
        pairs = np.unique(np.concatenate([top >> np.uint32(16), top & np.uint32(0xFFFF)])) if len(top) else np.zeros(0, np.uint32)
        pairs = pairs[:4000]  # the rest take the slower exact way; a bound on memory only
        self.pair_no = np.full(1 << 16, len(pairs), np.int32)
        self.pair_no[pairs] = np.arange(len(pairs), dtype=np.int32)
        self.width = np.int32(len(pairs) + 1)
        self.row_no = np.full(int(self.width) ** 2, -1, np.int32)
        a, b = self.pair_no[top >> np.uint32(16)], self.pair_no[top & np.uint32(0xFFFF)]
        fits = (a < len(pairs)) & (b < len(pairs))
        self.row_no[a[fits] * self.width + b[fits]] = np.flatnonzero(fits)
        self.row_cost = self.cost(top)

    def cost(self, code: np.ndarray) -> np.ndarray:
        """Bits of each four-byte code (context and byte) in each language, by the definition."""
        bits, open_ = np.zeros((len(self.langs), len(code))), np.ones((len(self.langs), len(code)), bool)
        for order in range(ORDER, -1, -1):
            mask = np.uint32((1 << (8 * (order + 1))) - 1)
            sym = code & mask
            at, hit = _find(self.symbols[order], sym)
            cost = np.where(hit, self.sym_cost[order][:, at], np.nan) if len(self.symbols[order]) else np.full(bits.shape, np.nan)
            own = open_ & ~np.isnan(cost)
            bits[own] += cost[own]
            open_ &= ~own
            at, hit = _find(self.contexts[order], sym >> np.uint32(8))
            esc = np.where(hit, self.esc_cost[order][:, at], 0.0) if len(self.contexts[order]) else np.zeros(bits.shape)
            bits += np.where(open_, esc, 0.0)
        return bits + 8.0 * open_

    def bits(self, text: bytes) -> np.ndarray:
        """Code length of a whole text in each language, summed over steps of bounded size."""
        data, total = np.frombuffer(PAD + text, np.uint8), np.zeros(len(self.langs))
        step = max(1024, LOOKUPS // max(1, len(self.langs)))
        for lo in range(0, len(text), step):
            total += self._bits(data[lo : lo + step + ORDER])
        return total

    def _bits(self, data: np.ndarray) -> np.ndarray:
        pair = self.pair_no[(data[:-1].astype(np.uint16) << np.uint16(8)) | data[1:]]
        row = self.row_no[pair[:-2] * self.width + pair[2:]]
        known = row >= 0
        if known.all():
            return self.row_cost[:, row].sum(axis=1)
        rare = ~known
        return self.row_cost[:, row[known]].sum(axis=1) + self.cost(_codes(data, 4)[rare]).sum(axis=1)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and posterior under equal priors; `und` and 0 for a null text or one without a letter."""
        if text is None or not self.langs or not _LETTER.search(text):
            return "und", 0.0
        bits = self.bits(text.encode("utf-8", "replace"))
        best = int(np.argmin(bits))
        return self.langs[best], float(1.0 / np.exp2(np.clip(bits[best] - bits, -1000, 0)).sum())


def _find(keys: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, want), max(0, len(keys) - 1))
    return at, (keys[at] == want if len(keys) else np.zeros(len(want), bool))


def fit_language_model(train: DataFrame, text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = TRAIN_DOCS_PER_LANG, seed: int = 42) -> PpmModel:
    """Learn every language from a bounded sample: about docs_per_lang whole distinct texts of each, chosen by a hash of the text.

    Null texts and null languages are not learned from; an empty table gives a model that says `und`.
    """
    rows = train.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna()
    samples: dict[str, list[bytes]] = {}
    for r in sampled_texts(rows, "lang", "text", docs_per_lang, TRAIN_DOCS, seed).collect():
        samples.setdefault(r["lang"], []).append(r["text"].encode())
    return PpmModel(samples)


def predict_language(df: DataFrame, model: PpmModel, text_col: str = "text") -> DataFrame:
    """Adds lang_pred (a learned language or `und`) and score (0 to 1) to every row; nothing is dropped.

    Null text or one without a letter: `und`, 0. A very long text is coded whole, in steps of bounded size. Columns of
    df named lang_pred or score are replaced; others stay. Repeated rows get equal results; an empty table stays empty.
    """

    def make(part):
        got = [model.predict(t) for t in part.column(text_col).to_pylist()]
        return [g[0] for g in got], [g[1] for g in got]

    return append_columns(df, text_col, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], make)


def op1_langid(spark, sf_dir):
    from sluice.llm.common import table

    docs = table(spark, sf_dir, "documents")
    model = fit_language_model(docs.filter(~held_out(F.col("doc_id"))))
    out = predict_language(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
