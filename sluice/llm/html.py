"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: the text between two block-level tags, with its path of open elements. A bidirectional
LSTM (numpy) reads the sequence of a page's blocks, each as a vector of its hashed tag path (names and words of class,
id and role), its hashed words and a few counts, and labels every block as main text or not, so each decision uses
the whole page. It is trained, by back-propagation through time and Adam steps, on pages made by a rule (practice_page)
from public conventions of markup: elements, and words of class, id and role that many sites use.
"""

from __future__ import annotations

import html as chars
import re
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sluice.llm.common import append_columns, table

PATH_DIM, WORD_DIM, COUNTS, HIDDEN = 256, 32, 7, 16
DIM = PATH_DIM + WORD_DIM + COUNTS
PRACTICE_PAGES, ROUNDS, SEED = 500, 14, 42
#: Blocks whose vectors are held at once; a page with more is read in parts that hand on their state.
CHUNK = 4096
# Element names. Elements of no list are inline, as unknown ones are in browsers.
_BLOCK = frozenset("""address article aside audio blockquote body button caption canvas center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form
    frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe input legend li link main menu meta nav noscript ol optgroup option p pre search section select
    summary table tbody td template textarea tfoot th thead title tr ul video""".split())
_VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
_RAW = frozenset(["script", "style"])
_CLOSED_BY = {"p": frozenset("p div ul ol dl table section article aside header footer nav form h1 h2 h3 h4 h5 h6 blockquote pre figure main hr address".split()),
              "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": frozenset(["option"])}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)[^<>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def leaf_blocks(page: str | None) -> list[Block]:
    """The blocks of a page with text, in order: character references decoded, white space runs made one space."""
    page, out, stack, held = page or "", [], [], []
    linked, anchors, at = 0, 0, 0

    def close():
        nonlocal linked
        text = " ".join(chars.unescape("".join(held)).split())
        if text:
            out.append(Block(tuple(stack), text, linked))
        held.clear()
        linked = 0

    while True:
        m = _TAG.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            held.append(piece)
            linked += len(piece) * (anchors > 0)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue  # a comment or declaration joins what stands around it
        ends = m[1] or m[4]
        if name in _RAW and not ends:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name not in _BLOCK:
            if name == "a":
                anchors = max(0, anchors + (-1 if ends else 1))
            elif name in ("br", "wbr", "img"):
                held.append(" ")
            continue
        close()
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].split(".", 1)[0] == name:
                    del stack[k:]
                    break
            continue
        if stack and name in _CLOSED_BY.get(stack[-1].split(".", 1)[0], ()):
            stack.pop()
        if name not in _VOID:
            marks = " ".join(n.strip("\"'") for n in _NAMES.findall(m[3] or ""))
            stack.append(".".join([name, *re.split(r"[\s_-]+", marks.lower().strip())]) if marks else name)
    close()
    return out


def vectors(blocks: list[Block]) -> np.ndarray:
    """(blocks, DIM): hashed tag path, hashed words, counts."""
    x = np.zeros((len(blocks), DIM), np.float32)
    for i, b in enumerate(blocks):
        for element in b.path:
            for mark in element.split("."):
                x[i, crc32(mark.encode()) % PATH_DIM] = 1.0
        if b.path:
            x[i, crc32(b"leaf " + b.path[-1].split(".", 1)[0].encode()) % PATH_DIM] = 1.0
        words = b.text.lower().encode().split()
        x[i, PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount(np.fromiter(map(crc32, words), np.uint32, len(words)) % WORD_DIM, minlength=WORD_DIM) / (8.0 + len(words))
        x[i, -COUNTS:] = (min(1.0, np.log1p(len(b.text)) / 8), min(1.0, b.linked / len(b.text)), min(1.0, len(words) / 50), b.text[-1] in ".!?", "©" in b.text, min(1.0, len(b.path) / 16), 1.0)
    return x


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class BlockLabeller:
    """Two LSTMs, one from either end, and a logistic output over both."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.w = {f"{k}{d}": v for d in "fb" for k, v in (("x", draw(DIM, 4 * HIDDEN)), ("h", draw(HIDDEN, 4 * HIDDEN)), ("c", np.zeros(4 * HIDDEN, np.float32)))}
        for d in "fb":
            self.w["c" + d][HIDDEN : 2 * HIDDEN] = 1.0  # forget gates start open
        self.w |= {"o": draw(2 * HIDDEN, 1), "q": np.zeros(1, np.float32)}

    def _run(self, x, mask, d, keep=False, state=None):
        """States of one direction over x (pages, blocks, DIM), tape and last state; past a page's end the state stands still."""
        n, t_max, _ = x.shape
        pre, out, tape = x @ self.w["x" + d] + self.w["c" + d], np.zeros((n, t_max, HIDDEN), np.float32), []
        h, c = state or (np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32))
        for t in range(t_max) if d == "f" else range(t_max - 1, -1, -1):
            z = pre[:, t] + h @ self.w["h" + d]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g, live = np.tanh(z[:, 3 * HIDDEN :]), mask[:, t, None]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            if keep:
                tape.append((t, h, c, i, f, o, g, tc, live))
            h, c = np.where(live, o * tc, h), np.where(live, c2, c)
            out[:, t] = h
        return out, tape, (h, c)

    def _out(self, both):
        return _sigmoid((both @ self.w["o"])[..., 0] + self.w["q"])

    def forward(self, x, mask, keep=False):
        (a, ta, _), (b, tb, _) = self._run(x, mask, "f", keep), self._run(x, mask, "b", keep)
        both = np.concatenate([a, b], axis=2)
        return self._out(both), both, ta, tb

    def long_page(self, blocks: list[Block]) -> np.ndarray:
        """The outputs of a page of any length, with the vectors of CHUNK blocks at a time."""
        parts, both = [blocks[k : k + CHUNK] for k in range(0, len(blocks), CHUNK)], []
        for d, order in (("f", 1), ("b", -1)):
            state, got = None, []
            for part in parts[::order]:
                states, _, state = self._run(vectors(part)[None], np.ones((1, len(part)), bool), d, state=state)
                got.append(states[0])
            both.append(np.concatenate(got[::order]))
        return self._out(np.concatenate(both, axis=1))

    def gradients(self, x, mask, y):
        p, both, ta, tb = self.forward(x, mask, True)
        err = ((p - y) * mask / mask.sum()).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        g["o"][:, 0], g["q"][0] = np.einsum("nt,nth->h", err, both), err.sum()
        outer = err[..., None] * self.w["o"][:, 0]
        for d, tape, part in (("f", ta, outer[..., :HIDDEN]), ("b", tb, outer[..., HIDDEN:])):
            dh, dc, dz_all = np.zeros((len(x), HIDDEN), np.float32), np.zeros((len(x), HIDDEN), np.float32), np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            for t, h, c, i, f, o, gg, tc, live in reversed(tape):
                dh = dh + part[:, t]
                dct = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dct * gg * i * (1 - i), dct * c * f * (1 - f), dh * tc * o * (1 - o), dct * i * (1 - gg * gg)], axis=1) * live
                dz_all[:, t] = dz
                g["h" + d] += h.T @ dz
                dh, dc = np.where(live, dz @ self.w["h" + d].T, dh), np.where(live, dct * f, dc)
            g["x" + d], g["c" + d] = np.einsum("ntd,ntk->dk", x, dz_all, optimize=True), dz_all.sum(axis=(0, 1))
        return g

    def fit(self, pages, rounds: int = ROUNDS, rate: float = 0.01, seed: int = SEED):
        """pages: (vectors, labels) of each page. Batches of like length, Adam steps."""
        rng, m, v, step = np.random.default_rng(seed), {k: 0.0 for k in self.w}, {k: 0.0 for k in self.w}, 0
        order = sorted(range(len(pages)), key=lambda i: len(pages[i][0]))
        batches = [order[i : i + 16] for i in range(0, len(order), 16)]
        for _ in range(rounds):
            for b in rng.permutation(len(batches)):
                x, mask = _padded([pages[i][0] for i in batches[b]])
                y = np.zeros(mask.shape, np.float32)
                for r, i in enumerate(batches[b]):
                    y[r, : len(pages[i][1])] = pages[i][1]
                g, step = self.gradients(x, mask, y), step + 1
                for k in self.w:
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.w[k] = (self.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """A boolean per block of each page; pages of like length share a batch of bounded size."""
        out: list = [np.zeros(0, bool)] * len(pages)
        group: list[int] = []
        for i in [*sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i])), None]:
            if i is not None and len(pages[i]) > CHUNK:
                out[i] = self.long_page(pages[i]) >= 0.5
                continue
            if group and (i is None or (len(group) + 1) * len(pages[i]) > CHUNK):
                x, mask = _padded([vectors(pages[k]) for k in group])
                p = self.forward(x, mask)[0]
                for r, k in enumerate(group):
                    out[k] = p[r, : len(pages[k])] >= 0.5
                group = []
            if i is not None:
                group.append(i)
        return out


def _padded(rows: list[np.ndarray]):
    x, mask = np.zeros((len(rows), max(map(len, rows)), DIM), np.float32), np.zeros((len(rows), max(map(len, rows))), bool)
    for r, v in enumerate(rows):
        x[r, : len(v)], mask[r, : len(v)] = v, True
    return x, mask


# Parts of the practice pages. Frequent words of four languages, words of buttons and notices, and markup.
_COMMON = "the of and to in is that for was on with as it are by this from at der die das und ist von mit den auf le la les et est que pour dans une el los y en un por con del".split()
_BOILER_WORDS = "home menu login register subscribe newsletter cookie cookies accept privacy policy terms copyright rights reserved contact share follow search reply comments says posted related popular sponsored advertisement buy now sale click read more next previous archive tags sign up free trial".split()
_NEUTRAL = ("div", 'div class="container"', 'div class="row"', 'div id="wrapper"', 'div class="inner"', 'div class="col-md-8"', 'div class="grid layout"', "section", 'div id="page"', 'div class="site"', "center", 'div class="block-2"')
_MAIN_WRAPS = (
    "article", 'article class="post"', 'article class="hentry" id="post-12"', "main", 'main role="main"', 'div class="content"', 'div id="content"', 'div class="entry-content"', 'div class="post-body"',
    'div class="article-body"', 'section class="story"', 'div class="text"', 'div id="main-content" class="body"', 'div role="article"', 'div class="markdown-body"', "div", "section", "",
)
_BOILER = (
    ("links", ("nav", 'nav class="navbar"', 'ul class="menu"', 'div class="nav"', 'div id="menu"', 'div role="navigation"', 'div class="breadcrumbs"', 'div class="pagination"', 'ul class="tags"', 'div class="toolbar"')),
    ("short", ("header", 'header class="site-header"', 'div id="header"', 'div class="masthead"', 'div class="banner"', 'div role="banner"', 'div class="logo"')),
    ("foot", ("footer", 'footer class="site-footer"', 'div id="footer"', 'div class="copyright"', 'div role="contentinfo"', 'div class="legal"')),
    ("prose", ("aside", 'aside class="widget"', 'div class="sidebar"', 'div id="sidebar"', 'div role="complementary"', 'div class="author-bio"', 'div class="teaser"')),
    ("ad", ('div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'div id="ad-top"', 'div class="sponsored"', 'div class="promo"', 'aside class="ad banner"', 'div class="adsbox"')),
    ("prose", ('div class="cookie-notice"', 'div class="notice"', 'div id="cookie-banner"', 'div role="alert"', 'div class="popup modal"', 'div class="consent"', 'div class="disclaimer"', "noscript", "dialog")),
    ("form", ("form", 'form class="login"', 'form role="search"', 'div class="newsletter signup"', 'form id="subscribe"', "fieldset")),
    ("comments", ('section class="comments"', 'div id="comments"', 'ol class="comment-list"', 'div class="discussion"', 'div class="reviews comment"', 'section id="respond"', 'ul class="comments"')),
    ("links", ('div class="related"', 'div class="share social"', 'section class="recommended"', 'div class="more-links"', 'ul class="share"')),
)
#: Which of them also stand inside a main part: adverts, forms, comments, related links and sharing.
_INSIDE = (4, 6, 7, 8)


def practice_page(rng: np.random.Generator) -> tuple[str, list[int]]:
    """(html, labels of its blocks), made by a rule: a main part of prose among menus, adverts, notices and comments."""
    parts: list[str] = []
    labels: list[int] = []
    chance = lambda p: bool(rng.random() < p)
    pick = lambda options: options[int(rng.integers(len(options)))]

    def word():
        return "".join(pick("bcdfghjklmnprstvwz") + pick("aeiou") + (pick("nrslt") if chance(0.3) else "") for _ in range(int(rng.integers(1, 4))))

    def phrase(n, boiler=0.0):
        return " ".join(pick(_BOILER_WORDS) if chance(boiler) else pick(_COMMON) if chance(0.35) else word() for _ in range(n)).capitalize()

    def prose(boiler=0.0):
        if chance(0.06):  # a text of one word, again and again
            return " ".join([word()] * int(rng.integers(2, 60)))
        return " ".join(phrase(int(rng.integers(1, 18)), boiler) + pick(".....!?") for _ in range(int(rng.choice([1, 1, 2, 4, 7]))))

    def add(piece, label):
        parts.append(piece)
        labels.append(label)

    def opened(tag):
        parts.append(f"<{tag}>")
        return f"</{tag.split()[0]}>"

    def boiler(kind):
        style, tags = _BOILER[kind]
        tag = pick(tags)
        end, listed = opened(tag), tag.split()[0] in ("ul", "ol")
        if style == "links":
            inner = "" if listed else opened(pick(("ul", "ul", "ol", "div")))
            item = "div" if inner == "</div>" else "li"
            for _ in range(int(rng.integers(1, 8))):
                add(f'<{item}><a href="/{rng.integers(99)}">{phrase(int(rng.integers(1, 6)), 0.4)}</a></{item}>', 0)
            parts.append(inner)
        elif style == "foot":
            add(pick(("<p>", "", "<div>")) + pick(("&copy; ", "(c) ", "© ")) + phrase(int(rng.integers(1, 5)), 0.5) + pick((" | ", " - ", " ")) + (prose(0.3) if chance(0.6) else ""), 0)
        elif style == "short":
            add(pick(("<h1>", "<div>", "<h2>", "<p>", "")) + phrase(int(rng.integers(1, 7)), 0.3), 0)
        elif style == "form":
            if chance(0.6):
                add(f"<p>{prose(0.4)}</p>", 0)
            add(f"<label>{phrase(2, 0.6)}</label>", 0)
            parts.append("<input name=q>")
            add(pick(("<button>", "<div>")) + phrase(int(rng.integers(1, 3)), 0.8), 0)
        elif style == "comments":
            if chance(0.6):
                add(f"<h3>{phrase(2, 0.6)}</h3>", 0)
            for _ in range(int(rng.integers(1, 6))):
                inner = opened("li" if listed else pick(('div class="comment"', 'div class="reply"', "div", "article", 'p class="text"')))
                add(f"{'<p>' if inner not in ('</p>',) and chance(0.7) else ''}{prose(0.05)}", 0)
                parts.append(inner)
        elif style == "ad" and chance(0.5):
            add(prose(0.3), 0)
        else:
            if chance(0.4):
                add(f"<h3>{phrase(2, 0.3)}</h3>", 0)
            for _ in range(int(rng.integers(1, 4))):
                add(f"<p>{prose(0.15)}</p>", 0)
        parts.append(end)

    def main():
        wrap = pick(_MAIN_WRAPS)
        ends = [opened(wrap)] if wrap else []
        if chance(0.2):
            ends.append(opened(pick(("div", 'div class="body"', "section"))))
        if chance(0.85):
            add(f"<h1>{phrase(int(rng.integers(1, 14)))}</h1>", 1)
        for _ in range(int(rng.choice([1, 1, 2, 3, 6, 10, 20]))):
            k = rng.random()
            if k < 0.6:
                add(f"<p>{prose()}" + ("</p>" if chance(0.8) else ""), 1)
            elif k < 0.66:
                add(f"<{pick(('p', 'div'))}><{pick(('b', 'em', 'strong', 'i'))}>{phrase(3)}</i> {prose()}", 1)
                if parts[-1].startswith("<div"):
                    parts.append("</div>")
            elif k < 0.74:
                add(f"<h{rng.integers(2, 5)}>{phrase(int(rng.integers(1, 8)))}</h2>", 1)
                parts[-1] = parts[-1].replace("</h2>", f"</{parts[-1][1:3]}>")
            elif k < 0.78:
                add(f"<blockquote>{prose()}</blockquote>", 1)
            elif k < 0.84:
                listed = opened(pick(("ul", "ol")))
                for _ in range(int(rng.integers(1, 6))):
                    add(f"<li>{phrase(int(rng.integers(2, 12)))}</li>", 1)
                parts.append(listed)
            elif k < 0.87:
                add(f"<table><tr><td>{phrase(2)}</td>", 1)
                add(f"<td>{phrase(3)}</td></tr></table>", 1)
            elif k < 0.9:
                add(f"<figure><img src=x><figcaption>{phrase(6)}</figcaption></figure>", 1)
            elif k < 0.92:
                add(f"<pre>{phrase(5)}</pre>", 1)
            else:
                boiler(pick(_INSIDE))
        parts.extend(ends[::-1])

    parts.append("<!DOCTYPE html><html>" if chance(0.8) else "")
    if chance(0.85):
        parts.append("<head>")
        add(f"<title>{phrase(int(rng.integers(1, 9)))}</title>", 0)
        parts.append(pick(("", "<meta charset=utf-8>", "<style>.a{color:red}</style>")) + "</head><body>")
    outer = [opened(pick(_NEUTRAL)) for _ in range(int(rng.integers(0, 4)))]
    kinds = rng.integers(len(_BOILER), size=int(rng.integers(1, 8)))
    before = int(rng.integers(0, len(kinds) + 1))
    for k in kinds[:before]:
        boiler(int(k))
    nested = [opened(pick(_NEUTRAL)) for _ in range(int(rng.integers(0, 3)))]
    main()
    parts.extend(nested[::-1])
    for k in kinds[before:]:
        boiler(int(k))
    return "".join(parts) + "".join(outer[::-1]) + "</body></html>", labels


def fit_labeller(pages: int = PRACTICE_PAGES, rounds: int = ROUNDS, seed: int = SEED) -> BlockLabeller:
    rng, rows = np.random.default_rng(seed), []
    while len(rows) < pages:
        page, labels = practice_page(rng)
        blocks = leaf_blocks(page)
        if len(blocks) == len(labels):
            rows.append((vectors(blocks), np.array(labels, np.float32)))
    return BlockLabeller(seed).fit(rows, rounds)


def extract_main_text(df: DataFrame, html_col: str = "html", labeller: BlockLabeller | None = None) -> DataFrame:
    """Adds text (main blocks in page order, joined by one space; empty if none) and n_chars to every row.

    A null or empty page has an empty text. Of a page's text only scripts, styles and blocks that are labelled as other
    than main are left out; text of math, svg, object and unknown elements belongs to the block around it. A very long
    page is labelled whole, in parts that hand on their state. Columns of df named text or n_chars are replaced, others
    stay; repeated rows get equal results, and an empty table stays empty.
    """
    model = labeller or fit_labeller()

    def make(part):
        pages = [leaf_blocks(p) for p in part.column(html_col).to_pylist()]
        texts = [" ".join(b.text for b, keep in zip(bs, ks, strict=True) if keep) for bs, ks in zip(pages, model.label(pages), strict=True)]
        return texts, [len(t) for t in texts]

    return append_columns(df, html_col, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], make)


def op9_html(spark, sf_dir):
    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
