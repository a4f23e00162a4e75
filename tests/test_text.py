import random
import re

import pytest
from pyspark.sql import functions as F

from sluice.functions import text as tx
from sluice.functions.text import TokenizerOptions


def tokens(spark, texts, options=TokenizerOptions()):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[1] for r in rows.select("i", tx.tokenize(F.col("t"), options)).orderBy("i").collect()]


@pytest.mark.parametrize("text, options, has", [
    ("std::vector<int> and Foo::Bar::process()", TokenizerOptions(), ["std::vector", "foo::bar::process", "vector", "process"]),
    ("ParseHttpRequest and m_bufferSize", TokenizerOptions(), ["parsehttprequest", "parse", "http", "request", "buffer", "size"]),
    ("ptr->value == *ref && val != nullptr", TokenizerOptions(), ["->", "==", "*", "&&", "!="]),
    ("binary search tree", TokenizerOptions(split_camel_case=False, ngram_max=2), ["binary", "search", "tree", "binary_search", "search_tree"]),
    ("vector < int >", TokenizerOptions(split_camel_case=False, ngram_min=2, ngram_max=3), ["vector_<", "<_int", "int_>", "vector_<_int"]),
])
def test_tokenizer_cases(spark, text, options, has):
    got = tokens(spark, [text], options)[0]
    assert set(has) <= set(got)


def test_stop_words_and_empty(spark):
    got = tokens(spark, ["What does std::move do in C++?", "Explain that.", "", None, "How so?"])
    assert {"std::move", "c", "++"} <= set(got[0]) and not {"what", "does", "do", "in"} & set(got[0])
    assert got[1:] == [["explain"], [], [], []]


def scan(text):
    """A plain scanner: the tokens of the sequence, then the subwords."""
    seq, sub = [], []
    for m in re.finditer(r"[A-Za-z_](?:[A-Za-z0-9_]|::)*|::|->|==|!=|<=|>=|&&|\|\||\+\+|--|[*&~<>]|[0-9][A-Za-z0-9.]*", text):
        t = m[0]
        if not re.match("[A-Za-z_]", t):
            seq.append(t)
            continue
        if t.lower() not in tx.STOP_WORDS:
            seq.append(t.lower())
        for part in t.split("::"):
            if "::" in t and part:
                sub.append(part)
            cuts, start = [], 0
            for i in range(1, len(part)):
                if part[i] == "_" or part[i].isupper() and not part[i - 1].isupper():
                    cuts.append(part[start:i])
                    start = i + (part[i] == "_")
            if start or cuts:
                sub += [p for p in [*cuts, part[start:]] if p and p != "_"]
    return seq + [s.lower() for s in sub if s.lower() not in tx.STOP_WORDS]


def test_tokenizer_against_scanner(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aBcX_::9.<>-=&| the") for _ in range(rng.randint(0, 25))) for _ in range(2000)]
    assert tokens(spark, texts) == [scan(t) for t in texts]


def test_labels_and_shingles(spark):
    row = spark.range(1).select(
        tx.canonical_label(F.lit("[[TIER_2_REFACTOR]")).alias("a"), tx.encode_tier(F.lit("2")).alias("b"), tx.encode_tier(F.lit("x")).alias("c"), tx.decode_tier(F.lit(None).cast("int")).alias("d"),
        tx.shingles(F.lit("A b")).alias("e"), tx.shingles(F.lit("")).alias("f"), tx.jaccard(tx.shingles(F.lit("a b c d")), tx.shingles(F.lit("a b c e"))).alias("g"), tx.jaccard(tx.shingles(F.lit("")), tx.shingles(F.lit("a"))).alias("h")).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f, row.h) == ("TIER_2_MEDIUM", 2, None, "UNKNOWN", ["a b"], [], 0.0) and abs(row.g - 1 / 3) < 1e-12


@pytest.mark.parametrize("options", [TokenizerOptions(), TokenizerOptions(lowercase=False), TokenizerOptions(preserve_operators=False), TokenizerOptions(split_camel_case=False, ngram_min=2, ngram_max=3), TokenizerOptions(ngram_max=2)])
def test_token_counter_counts_what_tokenize_gives(spark, options):
    from collections import Counter

    from sluice.functions.text import token_counter, tokenize
    from sluice.plans.registry import PHRASES

    texts = [*PHRASES, None, "", "::a::B_c__D::", "_ __ _A a_ A::b::C", "Straße naïve ÉCOLE_x a.b 1.2.3e5x", "theThe THE_the The::the", "x\x01Y a\nb", "İstanbul I_İ"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    count = token_counter(options)
    for r in rows.select("id", tokenize(F.col("text"), options).alias("t")).collect():
        assert count(texts[r.id]) == Counter(r.t), texts[r.id]
