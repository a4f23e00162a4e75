"""URL filters: host and path rules first, then gradient-boosted trees on lexical features; DataFrame operations only.

The trees are fitted on the driver to a small labelled table (labelled_urls, made by a rule: forms of ordinary sites and
of link farms that overlap, so that no single feature decides) whose features come from the same expressions as those of
the pages, and are then written out as one sum of CASE expressions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import table

#: (verdict, rule); a rule is a host, a slash and the rest of a path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Boosting: trees, their depth, the learning rate, and the rows that a leaf holds at least.
TREES, DEPTH, RATE, LEAST = 48, 3, 0.25, 20
FEATURES = (
    "url_length", "host_length", "path_length", "query_length", "depth", "digit_ratio", "host_digits", "digit_run", "host_hyphens", "host_labels",
    "longest_label", "host_entropy", "path_entropy", "vowel_share", "parameters", "escapes", "stems", "suffix_rate",
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Stems that sites which sell clicks put into their names.
STEMS = "casino|poker|bet|slot|lotto|jackpot|pill|viagra|pharm|xxx|porn|adult|dating|loan|payday|credit|cheap|discount|deal|bonus|promo|free|win|prize|gift|click|traffic|backlink|seo|rolex|replica|crypto|coin|hack|crack|torrent|keygen"


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _entropy(text: Column) -> Column:
    """Bits a character of the text's own distribution of characters; empty: 0."""
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / F.length(text)
    distinct = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.when(F.length(text) > 0, F.aggregate(distinct, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))).otherwise(0.0)


def _longest(parts: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(parts, F.length)), F.lit(0))


def with_features(df: DataFrame, url: str, host: str, path: str, suffixes: dict[str, float], usual: float) -> DataFrame:
    """Adds the lexical features under a prefix; a null url counts as empty."""
    u, h, p = F.coalesce(F.col(url), F.lit("")), F.col(host), F.col(path)
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    rate = F.lit(usual)
    if suffixes:
        rate = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in sorted(suffixes.items()) for x in pair]), suffix_of(h)), rate)
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern))
    values = (
        F.length(u), F.length(h), F.length(p), F.length(query), count(p, "/[^/]"), count(u, "[0-9]") / F.greatest(F.length(u), F.lit(1)), count(h, "[0-9]"),
        _longest(F.regexp_extract_all(u, F.lit("[0-9]+"), F.lit(0))), count(h, "-"), F.size(F.split(h, r"\.")), _longest(F.split(h, r"\.")), _entropy(h), _entropy(p),
        count(h, "[aeiouy]") / F.greatest(count(h, "[a-z]"), F.lit(1)), count(query, "(^|&)[^&]"), count(u, "%[0-9A-Fa-f]{2}"), count(F.lower(u), STEMS), rate,
    )
    return df.withColumns({f"f__{n}": v.cast("double") for n, v in zip(FEATURES, values, strict=True)})


# Parts of the labelled URLs.
_TOPICS = "news museum garden library science travel history school weather market nature music recipe health energy forest river county harbor village film theater railway archive gallery journal tribune gazette herald observer".split()
_PLACES = "york london paris berlin madrid oslo boston vienna lisbon dublin geneva kyoto delhi quebec ohio texas norfolk leeds porto turin".split()
_PATHS = "about article story blog post archive category topic guide research people events media docs help en product review section".split()
_TEASERS = "casino poker bet slots jackpot pills pharmacy xxx adult loans payday cheap discount deals bonus promo free win prize click traffic crypto replica".split()
_FILLERS = "best top online now today super mega big fast easy new hot vip pro max zone shop store club world land 24 365 777 888".split()
_KEYS_GOOD, _KEYS_BAD = "id page q lang ref utm_source sort year".split(), "aff affid click_id sid subid src campaign ref id cid tok redirect".split()
#: Shares of the last labels of hosts, for ordinary sites and for link farms.
_SUFFIX = (
    (("com", 38), ("org", 16), ("net", 8), ("edu", 6), ("gov", 3), ("uk", 7), ("de", 6), ("fr", 4), ("es", 3), ("info", 3), ("io", 3), ("xyz", 1), ("biz", 1), ("top", 1)),
    (("com", 30), ("net", 10), ("org", 3), ("info", 10), ("biz", 12), ("xyz", 10), ("top", 9), ("click", 6), ("online", 5), ("de", 2), ("uk", 2), ("io", 1)),
)


def labelled_urls(n: int = 4000, seed: int = 42) -> list[tuple[str, int]]:
    """(url, 1 for block), half of either kind, drawn from forms of ordinary sites and of link farms.

    The forms overlap: both kinds have hyphens, digits, parameters, random paths and most suffixes, and ordinary names
    hold stems too (a topic with "free" or "win" in it), only in other shares.
    """
    rng = np.random.default_rng(seed)
    pick = lambda words: str(words[int(rng.integers(len(words)))])
    chance = lambda p: bool(rng.random() < p)
    letters = lambda k, alphabet="abcdefghijklmnopqrstuvwxyz0123456789": "".join(alphabet[i] for i in rng.integers(len(alphabet), size=k))

    def syllables(k):
        return "".join(letters(1, "bcdfghklmnprstvw") + letters(1, "aeiou") + (letters(1, "lnrst") if chance(0.3) else "") for _ in range(k))

    def suffix(kind):
        names, weights = zip(*_SUFFIX[kind], strict=True)
        return str(rng.choice(names, p=np.array(weights) / sum(weights)))

    def good_host():
        words = [pick(_TOPICS) if chance(0.5) else syllables(int(rng.integers(1, 4))) for _ in range(int(rng.choice([1, 1, 2, 2, 3])))]
        words = [pick(_PLACES), *words][: len(words)] if chance(0.3) else words
        words = ["the", *words] if chance(0.1) else words
        if chance(0.06):
            words.append(pick(("winter", "freedom", "winery", "betony", "dealers", "coinage", "discounting")))
        name = ("-" if chance(0.3) else "").join(words) + (str(int(rng.integers(1, 2030))) if chance(0.08) else "")
        return pick(("", "", "www.", "www.", "blog.", "en.", "m.", "news.")) + name

    def bad_host():
        form = rng.random()
        if form < 0.55:
            words = [pick(_TEASERS) if chance(0.6) else pick(_FILLERS) for _ in range(int(rng.integers(2, 5)))]
            name = ("-" if chance(0.5) else "").join(words) + (str(int(rng.integers(1, 9999))) if chance(0.3) else "")
        elif form < 0.8:
            name = letters(int(rng.integers(8, 22)))
        else:
            name = "-".join([syllables(int(rng.integers(1, 3))) for _ in range(int(rng.integers(2, 6)))]) + (str(int(rng.integers(1, 999))) if chance(0.4) else "")
        front = letters(int(rng.integers(2, 7))) + "." if chance(0.25) else pick(("", "", "www.", "m.", "go."))
        return front + name

    out = []
    for i in range(n):
        label = i % 2
        host = f"{bad_host() if label else good_host()}.{suffix(label)}"
        depth = int(rng.choice([0, 1, 2, 3, 4], p=[0.3, 0.35, 0.2, 0.1, 0.05] if label else [0.15, 0.25, 0.3, 0.2, 0.1]))
        strange = 0.45 if label else 0.08
        parts = [letters(int(rng.integers(4, 24))) if chance(strange) else f"{rng.integers(1, 3000)}" if chance(0.2) else "-".join(pick(_PATHS) if chance(0.5) else syllables(2) for _ in range(int(rng.integers(1, 5)))) for _ in range(depth)]
        keys = int(rng.choice([0, 1, 2, 3, 5], p=[0.4, 0.2, 0.15, 0.15, 0.1] if label else [0.75, 0.14, 0.07, 0.03, 0.01]))
        query = "&".join(f"{pick(_KEYS_BAD if label else _KEYS_GOOD)}={letters(int(rng.integers(3, 30))) if chance(strange) else rng.integers(1, 500)}" for _ in range(keys))
        if query and chance(0.3 if label else 0.05):
            query += "%3A%2F%2F" + syllables(3)
        tail = "" if not parts else pick(("", "/", ".html", ".php", "#top"))
        out.append((f"http{'s' * chance(0.6 if label else 0.85)}://{host}{'/' if parts or chance(0.5) else ''}{'/'.join(parts)}{tail if not query else ''}{'?' + query if query else ''}", label))
    return out


class BoostedTrees:
    """Logistic gradient boosting with small trees of Newton leaves; a tree is (feature, threshold, left, right) or a value."""

    def __init__(self, start: float, trees: list):
        self.start, self.trees = start, trees

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = (y.sum() + 1.0) / (len(y) + 2.0)
        model = cls(float(np.log(share / (1 - share))), [])
        z = np.full(len(y), model.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            tree = cls._grow(x, y - p, p * (1 - p), DEPTH)
            model.trees.append(tree)
            z += np.array([cls._value(tree, row) for row in x])
        return model

    def uses(self) -> dict[str, int]:
        """Splits by feature."""
        out, left = {}, list(self.trees)
        while left:
            tree = left.pop()
            if not isinstance(tree, float):
                out[FEATURES[tree[0]]] = out.get(FEATURES[tree[0]], 0) + 1
                left += tree[2:]
        return out

    @classmethod
    def _grow(cls, x, g, h, depth):
        gain = lambda a, b: a * a / (b + 1.0)
        best = None
        if depth and len(g) >= 2 * LEAST:
            for f in range(x.shape[1]):
                order = np.argsort(x[:, f], kind="stable")
                v, cg, ch = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
                cuts = np.flatnonzero(v[1:] > v[:-1])
                cuts = cuts[(cuts + 1 >= LEAST) & (len(g) - cuts - 1 >= LEAST)]
                if len(cuts):
                    s = gain(cg[cuts], ch[cuts]) + gain(cg[-1] - cg[cuts], ch[-1] - ch[cuts])
                    k = int(np.argmax(s))
                    if best is None or s[k] > best[0] + 1e-12:
                        best = (float(s[k]), f, float((v[cuts[k]] + v[cuts[k] + 1]) / 2))
        if best is None or best[0] <= gain(g.sum(), h.sum()) + 1e-9:
            return float(RATE * g.sum() / (h.sum() + 1.0))
        low = x[:, best[1]] <= best[2]
        return best[1], best[2], cls._grow(x[low], g[low], h[low], depth - 1), cls._grow(x[~low], g[~low], h[~low], depth - 1)

    @classmethod
    def _value(cls, tree, row) -> float:
        while not isinstance(tree, float):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    def margin(self, row) -> float:
        return self.start + sum(self._value(t, row) for t in self.trees)

    def expression(self) -> Column:
        """The margin as a CASE expression over the feature columns."""
        def of(tree):
            return F.lit(tree) if isinstance(tree, float) else F.when(F.col(f"f__{FEATURES[tree[0]]}") <= tree[1], of(tree[2])).otherwise(of(tree[3]))

        out = F.lit(self.start)
        for t in self.trees:
            out = out + of(t)
        return out


class UrlModel:
    def __init__(self, trees: BoostedTrees, suffixes: dict[str, float], usual: float):
        self.trees, self.suffixes, self.usual = trees, suffixes, usual


def fit_url_model(spark, labelled: list[tuple[str, int]] | None = None) -> UrlModel:
    """Trees and suffix statistics (smoothed share of blocked URLs by last label of the host) from a small labelled list."""
    rows = labelled or labelled_urls()
    df = spark.createDataFrame(rows, "url string, label int").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    usual = (sum(r[1] for r in rows) + 1.0) / (len(rows) + 2.0)
    counts = df.groupBy(suffix_of(F.col("host")).alias("s")).agg(F.sum("label").alias("bad"), F.count("*").alias("n")).collect()
    suffixes = {r["s"]: (r["bad"] + 10 * usual) / (r["n"] + 10) for r in counts}
    got = with_features(df, "url", "host", "path", suffixes, usual).orderBy("url", "label").collect()
    x = np.array([[r[f"f__{n}"] for n in FEATURES] for r in got])
    return UrlModel(BoostedTrees.fit(x, np.array([float(r["label"]) for r in got])), suffixes, usual)


def judge_urls(pages: DataFrame, model: UrlModel, url_col: str = "url", rules=RULES) -> DataFrame:
    """Adds host, path, rule, verdict and score (the trees' probability of block) to every row; nothing is dropped.

    A null url or one without :// has an empty host and path, fits no rule, and is judged by the trees like any text; so
    is a very long one, read whole. Columns of pages with these names are replaced, others stay; repeated rows get equal
    results, and an empty table stays empty.
    """
    out = pages.withColumn("__url", F.col(url_col)).withColumn("host", host_of(F.col("__url"))).withColumn("path", path_of(F.col("__url")))
    out = with_features(out, "__url", "host", "path", model.suffixes, model.usual)
    out = out.withColumn("score", 1 / (1 + F.exp(-model.trees.expression()))).withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))
    out = out.withColumn("rule", F.col("__rule.rule")).withColumn("verdict", F.coalesce(F.col("__rule.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow")))
    return out.drop("__url", "__rule", *(f"f__{n}" for n in FEATURES))


def op7_urls(spark, sf_dir):
    out = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), fit_url_model(spark))
    return out.select("page_id", "host", "path", "rule", "verdict", "score")
