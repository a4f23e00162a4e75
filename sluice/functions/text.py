"""Text functions as columns: the code-aware tokenizer, normalization, shingles, labels, payloads."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that the tokenizer drops.
STOP_WORDS = """a about above after again all am an and any are aren as at be because been before being below between
both but by can could did didn do does doesn doing don down during each few for from further had hadn has hasn have
haven having he her here hers herself him himself his how i if in into is isn it its itself just ll m ma me might more
most must my myself need no nor not now o of off on once only or other our ours ourselves out over own re s same she
should so some such t than that the their theirs them themselves then there these they this those through to too under
until up ve very was wasn we were weren what when where which while who whom why will with won would y you your yours
yourself yourselves want implement create write optimize modify""".split()
OPERATORS = r"|::|->|==|!=|<=|>=|&&|\|\||\+\+|--|[*&~<>]"
IDENTIFIER = r"[A-Za-z_](?:[A-Za-z0-9_]|::)*"
NUMBER = r"|[0-9][A-Za-z0-9.]*"
WHITE = r"[ \t\n\r\f\x0B]+"
# Stems of concurrency texts, matched anywhere, in any case.
CONCURRENCY = r"(?i)(lock|unlock|concurren|atomic|mutex|deadlock|race|races|compare-and-swap|spurious wakeup|hazard pointer|memory_order|thread|threads|park|spin|retry loop)"
#: Distinct words whose tokens a worker remembers.
REMEMBERED = 1 << 17
TIERS = ("TIER_1_SIMPLE", "TIER_2_MEDIUM", "TIER_3_COMPLEX")


@dataclass(frozen=True)
class TokenizerOptions:
    lowercase: bool = True
    split_camel_case: bool = True
    preserve_operators: bool = True
    ngram_min: int = 1
    ngram_max: int = 1

    def pattern(self) -> str:
        return IDENTIFIER + (OPERATORS if self.preserve_operators else "") + NUMBER


def bound(col: Column, make) -> Column:
    """make(col) with col evaluated once, even where make uses it inside a lambda."""
    return F.element_at(F.transform(F.array(col), make), 1)


def _is_identifier(t: Column) -> Column:
    return t.rlike("^[A-Za-z_]")


def _kept(t: Column) -> Column:
    return ~t.isin(*STOP_WORDS)


def base_sequence(text: Column, options: TokenizerOptions = TokenizerOptions()) -> Column:
    """Identifiers (lower-cased, stop words dropped), operators and numbers of a text in order; null: an empty array."""
    fold = F.lower if options.lowercase else (lambda t: t)
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(options.pattern()), F.lit(0))
    folded = F.transform(found, lambda t: F.when(_is_identifier(t), fold(t)).otherwise(t))
    return F.filter(folded, lambda t: ~_is_identifier(t) | _kept(t))


def subwords(text: Column, options: TokenizerOptions = TokenizerOptions()) -> Column:
    """Parts of scoped identifiers, each followed by its camel-case and snake-case pieces."""
    if not options.split_camel_case:
        return F.array().cast("array<string>")
    fold = F.lower if options.lowercase else (lambda t: t)
    found = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(options.pattern()), F.lit(0)), lambda t: t.rlike("^[A-Za-z_].*(::|_|[A-Z])|^_"))

    def pieces(part):
        marked = F.regexp_replace(part, "([^A-Z])([A-Z])", "$1\x01$2")
        marked = F.concat(F.substring(marked, 1, 1), F.replace(F.substr(marked, F.lit(2)), F.lit("_"), F.lit("\x01")))
        return F.when(F.contains(marked, F.lit("\x01")), F.filter(F.split(marked, "\x01"), lambda p: (p != "") & (p != "_"))).otherwise(F.array().cast("array<string>"))

    def of(token):
        own = lambda part: F.when(F.contains(token, F.lit("::")) & (part != ""), F.array(part)).otherwise(F.array().cast("array<string>"))
        return F.flatten(F.transform(F.split(token, "::"), lambda part: F.concat(own(part), pieces(part))))

    return F.filter(F.transform(F.flatten(F.transform(found, of)), fold), _kept)


def ngrams(sequence: Column, size: int) -> Column:
    """Runs of size tokens joined by an underscore; none in shorter sequences."""
    run = F.transform(F.sequence(F.lit(1), F.size(sequence) - size + 1), lambda i: F.array_join(F.slice(sequence, i, size), "_"))
    return F.when(F.size(sequence) >= size, run).otherwise(F.array().cast("array<string>"))


def tokenize(text: Column, options: TokenizerOptions = TokenizerOptions()) -> Column:
    """All tokens of a text: the sequence (if single tokens are asked for), n-grams by size, subwords."""
    sizes = range(max(2, options.ngram_min), options.ngram_max + 1)

    def runs(seq):
        parts = [seq] if options.ngram_min <= 1 else []
        return F.concat(F.array().cast("array<string>"), *parts, *[ngrams(seq, n) for n in sizes])

    return F.concat(bound(base_sequence(text, options), runs), subwords(text, options))


def token_counter(options: TokenizerOptions = TokenizerOptions()) -> Callable[[str | None], dict[str, int]]:
    """How often each token of tokenize() is in a text, for workers: words met before cost a lookup each."""
    find, drops, fold = re.compile(options.pattern()).findall, frozenset(STOP_WORDS), str.lower if options.lowercase else str
    humps, known = re.compile("([^A-Z])([A-Z])"), {}

    def base(word: str) -> list[str]:
        if not (word[0].isalpha() or word[0] == "_"):
            return [word]
        return [fold(word)] if fold(word) not in drops else []

    def below(word: str) -> list[str]:
        if not options.split_camel_case or not (word[0].isalpha() or word[0] == "_"):
            return []
        out = []
        for part in word.split("::"):
            if "::" in word and part:
                out.append(part)
            marked = humps.sub("\\1\x01\\2", part)
            marked = marked[:1] + marked[1:].replace("_", "\x01")
            if "\x01" in marked:
                out += [p for p in marked.split("\x01") if p and p != "_"]
        return [p for p in map(fold, out) if p not in drops]

    def count(text: str | None) -> dict[str, int]:
        out: dict[str, int] = {}
        for word, n in Counter(find(text or "")).items():
            tokens = known.get(word)
            if tokens is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                tokens = known[word] = tuple(base(word) + below(word))
            for t in tokens:
                out[t] = out.get(t, 0) + n
        return out

    def count_runs(text: str | None) -> dict[str, int]:
        words = find(text or "")
        seq = [t for w in words for t in base(w)]
        out = Counter(seq if options.ngram_min <= 1 else ())
        for size in range(max(2, options.ngram_min), options.ngram_max + 1):
            out.update("_".join(seq[k : k + size]) for k in range(len(seq) - size + 1))
        out.update(t for w in words for t in below(w))
        return out

    return count if options.ngram_min <= 1 and options.ngram_max <= 1 else count_runs


def normalize(text: Column) -> Column:
    """Lower-cased, runs of white space made one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), WHITE, " "))


def shingles(text: Column, size: int = 3) -> Column:
    """Distinct runs of size lower-cased words; a shorter text is one run, one without words has none."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WHITE), lambda w: w != "")

    def runs(w):
        found = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, size), " "))
        return F.when(F.size(w) > 0, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))

    return bound(words, runs)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two distinct arrays; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def canonical_label(label: Column) -> Column:
    """Brackets stripped from either end, the older name of the middle tier replaced."""
    bare = F.btrim(label, F.lit("[]"))
    return F.when(bare == "TIER_2_REFACTOR", TIERS[1]).otherwise(bare)


def encode_tier(label: Column) -> Column:
    """0, 1 or 2 for a tier's name or digit, else null."""
    out = F.lit(None).cast("int")
    for k, name in enumerate(TIERS):
        out = F.when(label.isin(name, str(k)), k).otherwise(out)
    return out


def decode_tier(tier: Column) -> Column:
    """The tier's name; UNKNOWN for null or another number."""
    out = F.lit("UNKNOWN")
    for k, name in enumerate(TIERS):
        out = F.when(tier == k, name).otherwise(out)
    return out


def normalize_tag(raw: Column) -> Column:
    """The bracketed tier that a labeller's answer holds, else UNKNOWN."""
    up = F.upper(F.trim(raw))
    out = F.lit("UNKNOWN")
    for name in reversed(TIERS):
        out = F.when(F.contains(up, F.lit(f"[{name}]")), f"[{name}]").otherwise(out)
    return out


def payload_text(payload: Column) -> Column:
    """Text of a model's JSON answer: output_text, else the joined parts of output, else the first choice's message, else completion, response or text; empty if none."""
    parts = F.from_json(F.get_json_object(payload, "$.output"), "array<struct<content:array<struct<text:string>>>>")
    texts = F.filter(F.flatten(F.transform(F.filter(parts, lambda p: p["content"].isNotNull()), lambda p: F.transform(p["content"], lambda c: c["text"]))), lambda t: t.isNotNull())
    names = [F.get_json_object(payload, f"$.{k}") for k in ("completion", "response", "text")]
    return F.coalesce(F.get_json_object(payload, "$.output_text"), F.when(F.size(texts) > 0, F.array_join(texts, "")), F.get_json_object(payload, "$.choices[0].message.content"), *names, F.lit(""))


def content_key(text: Column) -> Column:
    """The cache key of a text: SHA-256 of a version mark, a zero byte and the text."""
    return F.sha2(F.concat(F.lit("v0"), F.lit("\x00"), text), 256)


def softmax3(z: list[Column]) -> list[Column]:
    """Stable softmax of three scores."""
    top = F.greatest(*z)
    total = sum((F.exp(x - top) for x in z[1:]), F.exp(z[0] - top))
    return [F.exp(x - top) / total for x in z]


def log_sum_exp(z: list[Column]) -> Column:
    top = F.greatest(*z)
    return top + F.log(sum((F.exp(x - top) for x in z[1:]), F.exp(z[0] - top)))


def argmax3(p: list[Column]) -> Column:
    """The place of the largest of three, the lowest of equals."""
    return F.when((p[1] > p[0]) & (p[1] >= p[2]), 1).when((p[2] > p[0]) & (p[2] > p[1]), 2).otherwise(0).cast("int")
