"""Personal data: exact patterns, and a linear-chain conditional random field (CRF) that adds what they miss.

Patterns (code-point spans, leftmost, non-overlapping within a kind): email, ip, card, phone. The CRF labels words as
outside, or begin/inside of one of the four kinds, from word-shape features; it is trained on a small labelled table
(labelled_table, sentences made by a rule) by gradient steps on the exact likelihood (forward-backward, numpy) and
decoded by Viterbi over batches. A decoded span is added if it holds the evidence of its kind and touches no span of the
patterns.

The model knows warm words: those within three words of a digit, an at sign or a spelled-out "at" or "dot". All others
are outside by definition, in training and decoding, and the text begins after an outside word; so decoding the runs of
warm words on their own gives the very path that decoding the whole text gives.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sluice.llm.common import append_columns, table

KINDS = ("email", "ip", "card", "phone")
STATES = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
CONTEXT = 3
HASH = 1 << 14
#: Sentences of the labelled table, and words that are decoded at once at most.
SENTENCES, PIECE = 700, 4096

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+@-]+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a match starts no run in its middle, so long runs cost linear time
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
# A spelled-out "at": in brackets, or a word before a name and a dot; a spelled-out "dot".
_AT = re.compile(r"(?i)[\[({]at[\])}]|(?<=[ \t-\r])at(?=[ \t-\r]+[^ \t-\r]{1,253}(?:[ \t-\r]+[\[({]?dot[\])}]?[ \t-\r]|\.[a-z]|[\[({]dot[\])}]))")
_DOT = re.compile(r"(?i)[\[({](?:dot|\.)[\])}]|(?<=[ \t-\r])dot(?=[ \t-\r])")


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str):
    """The email pattern in time linear in the text: its local part is all that stands between two at signs."""
    for run in _LOCAL_RUN.finditer(text):
        if "@" not in run[0]:
            continue
        start, at, end = run.start(), text.find("@", run.start(), run.end()), run.end()
        while at >= 0:
            if at > start and (m := _DOMAIN.match(text, at + 1)):
                yield start, m.end()
                start = m.end()
            else:
                start = at + 1
            at = text.find("@", start, end)


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the exact patterns, in order; a null text has none."""
    if not text or not (_DIGIT.search(text) or "@" in text):
        return []
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# Frames of the labelled table, by kind; the last ones hold numbers that are no personal data.
_FRAMES = {
    "email": "write to {} before noon|mail {}, please|reach me at {} any day|send it to {} today|contact {} for more|ask {} about 12 items|her address is {} now|{} is where I answer|e-mail: {}|you can write {} or come by|questions go to {} only|schreib an {} bitte|contactez {} pour plus|escribe a {} hoy".split("|"),
    "ip": "the server {} was down|log in from {} or not|traffic from {} was seen|host {} and gateway|block {} now|see {} in the log|ping {} first|address {} has no name|requests came from {} at night|der Rechner {} antwortet nicht|le serveur {} est en panne".split("|"),
    "card": "pay with {} today|card {} expired|number {} was used|the card {} is mine|charge {} now|use {} please|visa {} is on file|my card is {} and it works|Karte {} ist gesperrt|la carte {} est perdue".split("|"),
    "phone": "call {} now|my number is {} at home|dial {} or write|phone {} for help|ring {} soon|tel {} and fax|text {} after 5|or call {} free|mobile: {}|you reach us under {} daily|Telefon {} oder Fax|appelez le {} demain|llame al {} hoy|fax {} is busy".split("|"),
    "": "in {y} there were {n} cases|chapter {n} verse {n} of the book|it cost {n},{m} dollars and {n} cents|from {t} to {t} on {d}|version {v} and {v} came out|a total of {l} units were sold|room {m} on floor {n}|id {l} was stored|token {h} was read|the ratio {n}.{l} is near it|pages {m}-{m} and {n}-{n}|see @home and @work tags|isbn {i} is a book|key {h} and x{n}|in the {y}s and {y}s prices rose {n}%|sections {n}.{n}.{n} and {n}.{n}.{n} follow|order {m}-{m} arrived|this thing and that thing are here|serial {l} failed the test|date {d} or {d}|meet at noon or at dusk|look at example dot pattern on the dress|at {t} we left|the numbers {n} {n} {n} {n} {n} were drawn|{m} {m} {m} people came in {y}|the code is {m} {m}|population {n},{m},{m} in {y}|row {n} column {n} holds {m}.{n}|invoice {y}-{m} of {d}|sensor {n} read {n}.{n} {n}.{n} {n}.{n}".split("|"),
}
_NAMES = "anna karl lee maria tom jane ivan sofia omar lucy peter emma hugo nora".split()
_HOSTS = "example mail host school company office garden server post".split()


def _value(kind: str, rng) -> str:
    """A value of a kind in one of its written forms, those of the patterns included."""
    pick = lambda options: options[int(rng.integers(len(options)))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    if kind == "email":
        name = pick(_NAMES) + pick(("", "", "." + pick(_NAMES), "_" + pick(_NAMES), digits(2)))
        host = pick(("", "", "mail.")) + pick(_HOSTS)
        top = pick(("com", "org", "net", "de", "fr"))
        at, dot = pick((("@", "."), (" at ", " dot "), (" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" AT ", " DOT "), (" {at} ", "."), (" at ", "."), (" @ ", ".")))
        return name + at + host.replace(".", dot) + dot + top
    if kind == "ip":
        parts = [str(x) for x in rng.integers(0, 256, 4)]
        return pick((".", ".", "[.]", "[.]", "(.)", " . ", " dot ", "[dot]")).join(parts) if rng.random() < 0.85 else ".".join(parts[:3]) + "[.]" + parts[3]
    if kind == "card":
        body = pick("345") + digits(pick((13, 14, 14, 14, 17)))
        last = next(c for c in "0123456789" if luhn(body + c))
        number, mark = body + last, pick(("", " ", "-", ".", ".", "_", "_", "/", "  "))
        return mark.join(re.findall(r".{1,4}", number))
    a, b, c = digits(3), digits(3), digits(4)
    return pick((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"+44 {digits(2)} {c} {digits(4)}", f"0049 {digits(2)} {digits(6)}", f"0{digits(2)}-{c}-{digits(4)}", f"0{digits(3)} {b} {digits(4)}", f"0{digits(2)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"0{digits(3)}/{digits(7)}"))


def _filled(frame: str, rng) -> str:
    """A frame of the last list with numbers in its places."""
    made = {
        "y": lambda: rng.integers(1500, 2100), "n": lambda: rng.integers(1, 100), "m": lambda: rng.integers(100, 1000), "l": lambda: "".join(map(str, rng.integers(0, 10, int(rng.integers(5, 21))))),
        "t": lambda: f"{rng.integers(24)}:{rng.integers(10, 60)}", "d": lambda: ("{0}-{1:02}-{2:02}", "{2}.{1}.{0}", "{1:02}/{2:02}/{0}")[int(rng.integers(3))].format(*(int(rng.integers(*r)) for r in ((1990, 2030), (1, 13), (1, 29)))),
        "v": lambda: f"{rng.integers(20)}.{rng.integers(20)}.{rng.integers(20)}", "h": lambda: "".join("0123456789abcdef"[k] for k in rng.integers(0, 16, int(rng.integers(8, 41)))), "i": lambda: f"978-{rng.integers(10)}-{rng.integers(10, 100)}-{rng.integers(10**5, 10**6)}-{rng.integers(10)}",
    }
    return re.sub(r"\{(.)\}", lambda m: str(made[m[1]]()), frame)


def labelled_table(n: int = SENTENCES, seed: int = 42) -> list[tuple[list[str], list[int]]]:
    """(words, states) of n sentences, a third without personal data; some carry two values, some end in a mark."""
    rng, out = np.random.default_rng(seed), []
    for k in range(n):
        words, states = [], []
        for _ in range(1 + (rng.random() < 0.25)):
            kind = (*KINDS, "", "")[int(rng.integers(6))]
            frame = _FRAMES[kind][int(rng.integers(len(_FRAMES[kind])))]
            if not kind:
                words += _filled(frame, rng).split()
                states += [0] * (len(words) - len(states))
                continue
            before, after = frame.split("{}")
            for piece, inside in ((before, False), (_value(kind, rng), True), (after, False)):
                glued = piece and not inside and words and piece[0] in ",.;" and not piece[0].isspace()
                new = piece.split()
                if glued:
                    words[-1] += new.pop(0)
                words += new
                states += [STATES.index(("B-" if i == 0 else "I-") + kind) if inside else 0 for i in range(len(new))]
        if rng.random() < 0.3:
            words[-1] += "."
        out.append((words, states))
    return out


def shape(word: str) -> str:
    """Letters as a, capitals as A, digits as 9; runs cut to four; other characters as they are."""
    s = re.sub(r"[^\x00-\x7f]", "a", word)
    s = re.sub(r"[0-9]", "9", re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", s)))
    s = re.sub(r"a+", "a", re.sub(r"A+", "A", s))
    return re.sub(r"9{4,}", lambda m: "9999" + ("+" if len(m[0]) > 4 else "") + ("*" if len(m[0]) >= 14 else ""), s)[:24].rstrip(".,;:!?")


# Words that stand for themselves among the shapes.
_CUES = frozenset("at dot [at] [dot] (at) (dot) {at} {dot} . @ call phone tel dial ring mobile fax number text telefon appelez llame card visa pay charge carte karte host server ip log ping block mail email e-mail write contact isbn id order version page pages room serial token key invoice code com org net edu de fr es uk io info".split())
#: Shapes by word, for words seen before; emptied when full.
_SHAPES: dict[str, str] = {}
_LENGTHS = re.compile(r"9[9+*]*")
FEATURES = 11


def _shape(word: str) -> str:
    got = _SHAPES.get(word)
    if got is None:
        if len(_SHAPES) > 20_000:
            _SHAPES.clear()
        low = word.lower().rstrip(":,;")
        got = low if low in _CUES else shape(word)
        if len(word) <= 64:
            _SHAPES[word] = got
    return got


def _number(*parts: str) -> int:
    return zlib.crc32("\x00".join(parts).encode("utf-8", "replace")) % HASH


def features(words: list[str], lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Hashed feature numbers of the words lo to hi, (words, FEATURES): shapes of the word and two on either side, pairs, shapes without lengths, digits."""
    hi = len(words) if hi is None else hi
    first = max(0, lo - 2)
    s = ["<"] * (2 - (lo - first)) + [_shape(w) for w in words[first : hi + 2]] + [">", ">"]
    short = [_LENGTHS.sub("9", x) for x in s]
    out = np.empty((hi - lo, FEATURES), np.int64)
    for k in range(hi - lo):
        a, b, c, d, e = s[k : k + 5]
        w, n = words[lo + k], short[k + 1 : k + 4]
        out[k] = (
            _number("0", c), _number("-", b), _number("+", d), _number("-0", b, c), _number("0+", c, d), _number("--", a, b), _number("++", d, e),
            _number("s", n[1]), _number("s-", n[0], n[1]), _number("s+", n[1], n[2]), _number("n", str(min(20, sum(x.isdigit() for x in w))), str("@" in w)),
        )
    return out


def _log_sums(x: np.ndarray, through: np.ndarray) -> np.ndarray:
    """Logarithms of exp(x) @ through, rows of x shifted by their largest value first."""
    top = x.max(axis=1, keepdims=True)
    return np.log(np.maximum(np.exp(x - top) @ through, 1e-300)) + top


class Crf:
    """Weights of states by feature and of transitions; begin states may follow anything, inside states only their kind."""

    def __init__(self):
        k = len(STATES)
        self.emit, self.move = np.zeros((HASH, k)), np.zeros((k, k))
        self.barred = np.zeros((k, k), bool)
        for j, name in enumerate(STATES):
            if name[0] == "I":
                self.barred[:, j] = [p[2:] != name[2:] for p in STATES]

    def scores(self):
        return np.where(self.barred, -1e9, self.move)

    def emissions(self, words: list[str], lo: int = 0, hi: int | None = None, cold=None) -> np.ndarray:
        """Scores (words, states); a cold word can only be outside."""
        e = self.emit[features(words, lo, hi)].sum(axis=1)
        if cold is not None:
            e[cold, 1:] = -1e9
        return e

    def fit(self, rows, rounds: int = 120, rate: float = 0.3, decay: float = 1e-3):
        n, k = max(len(w) for w, _ in rows), len(STATES)
        f, y, mask, cold = np.zeros((len(rows), n, FEATURES), np.int64), np.zeros((len(rows), n), int), np.zeros((len(rows), n), bool), np.zeros((len(rows), n), bool)
        for i, (w, s) in enumerate(rows):
            f[i, : len(w)], y[i, : len(w)], mask[i, : len(w)] = features(w), s, True
            cold[i, : len(w)] = ~_warm(" ".join(w))[2]
        gold = np.eye(k)[y] * mask[..., None]
        flat = f[mask]
        order = np.argsort(flat, axis=None, kind="stable")
        used, first = np.unique(flat.ravel()[order], return_index=True)
        seen_e, seen_m = np.zeros_like(self.emit), np.zeros_like(self.move)
        for _ in range(rounds):  # AdaGrad on the likelihood of whole sentences
            e, m = self.emit[f].sum(axis=2), self.scores()
            e[cold, 1:] = -1e9
            through = np.exp(m)
            a = np.zeros((len(rows), n, k))
            b = np.zeros_like(a)
            a[:, 0] = m[0] + e[:, 0]
            for t in range(1, n):
                a[:, t] = np.where(mask[:, t, None], _log_sums(a[:, t - 1], through) + e[:, t], a[:, t - 1])
            for t in range(n - 2, -1, -1):
                b[:, t] = np.where(mask[:, t + 1, None], _log_sums(e[:, t + 1] + b[:, t + 1], through.T), b[:, t + 1])
            top = a[:, -1].max(axis=1)
            z = np.log(np.exp(a[:, -1] - top[:, None]).sum(axis=1)) + top
            p = np.exp(a + b - z[:, None, None]) * mask[..., None]
            ge, gm = np.zeros_like(self.emit), np.zeros_like(self.move)
            ge[used] = np.add.reduceat(np.repeat((gold - p)[mask], FEATURES, axis=0)[order], first)
            gm[0] = (gold - p)[:, 0].sum(axis=0)  # the word before the text is outside
            for t in range(1, n):
                high = a[:, t - 1].max(axis=1, keepdims=True)
                before, after = np.exp(a[:, t - 1] - high), np.exp(e[:, t] + b[:, t] + high - z[:, None]) * mask[:, t, None]
                gm += gold[:, t - 1].T @ gold[:, t] - (before.T @ after) * through
            for w, g, s in ((self.emit, ge - decay * self.emit, seen_e), (self.move, gm - decay * self.move, seen_m)):
                s += g * g
                w += rate * g / (np.sqrt(s) + 1e-8)
        return self

    def decode(self, segments: list[list[str]]) -> list[np.ndarray]:
        """Viterbi over batches of segments of like length; a segment of more than PIECE words goes in pieces."""
        out: list = [None] * len(segments)
        short = []
        for i, words in enumerate(segments):
            if len(words) > PIECE:
                out[i] = self._long(words)
            else:
                short.append(i)
        m = self.scores()
        for group in _bounded(sorted(short, key=lambda i: len(segments[i])), segments):
            n = max(len(segments[i]) for i in group)
            e, live = np.zeros((len(group), n, len(STATES))), np.zeros((len(group), n), bool)
            for r, i in enumerate(group):
                e[r, : len(segments[i])], live[r, : len(segments[i])] = self.emissions(segments[i]), True
            best, back = m[0] + e[:, 0], np.zeros(e.shape, np.int8)
            for t in range(1, n):
                s = best[:, :, None] + m[None]
                back[:, t] = np.where(live[:, t, None], s.argmax(axis=1), np.arange(len(STATES)))
                best = np.where(live[:, t, None], s.max(axis=1) + e[:, t], best)
            state = best.argmax(axis=1)
            path = np.zeros((len(group), n), np.int8)
            for t in range(n - 1, -1, -1):
                path[:, t] = state
                state = back[np.arange(len(group)), t, state] if t else state
            for r, i in enumerate(group):
                out[i] = path[r, : len(segments[i])]
        return out

    def _long(self, words: list[str]) -> np.ndarray:
        """Viterbi over one segment, with the emissions of a piece at a time; only steps back are kept for all."""
        m, best, back = self.scores(), None, np.zeros((len(words), len(STATES)), np.int8)
        for lo in range(0, len(words), PIECE):
            for t, e in enumerate(self.emissions(words, lo, min(lo + PIECE, len(words))), lo):
                if best is None:
                    best = m[0] + e
                    continue
                s = best[:, None] + m
                back[t] = s.argmax(axis=0)
                best = s.max(axis=0) + e
        path, state = np.zeros(len(words), np.int8), int(best.argmax())
        for t in range(len(words) - 1, -1, -1):
            path[t] = state
            state = back[t, state]
        return path


def _bounded(ids: list[int], segments, most: int = 50_000):
    """Groups whose padded size stays under most words (one segment at least)."""
    group: list[int] = []
    for i in ids:
        if group and (len(group) + 1) * len(segments[i]) > most:
            yield group
            group = []
        group.append(i)
    if group:
        yield group


def fit_crf() -> Crf:
    return Crf().fit(labelled_table())


def _warm(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last (exclusive) code points of all words, and which words lie within CONTEXT of a cue."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    white = (points == 32) | ((points >= 9) & (points <= 13))
    edge = np.diff(np.concatenate([[True], white, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    cue = np.flatnonzero(((points >= 48) & (points <= 57)) | (points == 64))
    spelled = [m.start() for pattern in (_AT, _DOT) for m in pattern.finditer(text)]
    hot = np.unique(np.searchsorted(starts, np.concatenate([cue, np.array(spelled, np.int64)]), side="right") - 1)
    warm = np.zeros(len(starts) + 2 * CONTEXT, bool)
    for k in range(2 * CONTEXT + 1):
        warm[hot + k] = True
    return starts, ends, warm[CONTEXT : len(starts) + CONTEXT]


def _segments(text: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """First and last code points of the words of each run of warm words."""
    starts, ends, warm = _warm(text)
    at = np.flatnonzero(np.diff(np.concatenate([[0], warm.astype(np.int8), [0]])))
    return [(starts[a:b], ends[a:b]) for a, b in zip(at[::2].tolist(), at[1::2].tolist(), strict=True)]


def _evidence(kind: int, words: str) -> bool:
    """A decoded span must hold what its kind needs."""
    digits = re.sub(r"[^0-9]", "", words)
    if kind == 0:
        return bool(re.search(r"(?i)[a-z0-9]\s*(@|[\[({]at[\])}]|\sat\s)\s*[a-z0-9]", words)) and bool(re.search(r"(?i)\.|\sdot\s|[\[({]dot[\])}]", words))
    if kind == 1:
        parts = re.findall(r"[0-9]+", words)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 and bool(re.search(r"[() .+/-]", words))


def _trimmed(text: str, s: int, e: int) -> tuple[int, int]:
    """The span without marks of the sentence around it."""
    while s < e and text[s] in "\"'<[{":
        s += 1
    while s < e and (text[e - 1] in ".,;:!?\"'>]}" or (text[e - 1] == ")" and text.count("(", s, e) < text.count(")", s, e))):
        e -= 1
    return s, e


def all_spans(texts: list[str | None], crf: Crf) -> list[tuple[list, list]]:
    """For each text the spans of the patterns, and those with what the CRF adds."""
    base = [base_spans(t) for t in texts]
    found = [(i, *seg) for i, t in enumerate(texts) if t and (_DIGIT.search(t) or "@" in t or _AT.search(t)) for seg in _segments(t)]
    added: dict[int, list] = {}
    paths = crf.decode([[texts[i][s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)] for i, starts, ends in found])
    for (i, starts, ends), path in zip(found, paths, strict=True):
        begins = np.flatnonzero((path > 0) & (path % 2 == 1)).tolist()
        for at in begins:
            kind, end = (int(path[at]) - 1) // 2, at + 1
            while end < len(path) and path[end] == 2 * kind + 2:
                end += 1
            s, e = _trimmed(texts[i], int(starts[at]), int(ends[end - 1]))
            if s < e and _evidence(kind, texts[i][s:e]):
                near = bisect.bisect_left(base[i], (s,))
                if all(e <= b[0] or s >= b[2] for b in base[i][max(0, near - len(KINDS)) : near]) and (near == len(base[i]) or base[i][near][0] >= e):
                    added.setdefault(i, []).append((s, kind, e))
    return [(b, sorted(b + added[i]) if i in added else b) for i, b in enumerate(base)]


FIELDS = [*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())]


def find_personal_data(df: DataFrame, text_col: str = "text", crf: Crf | None = None) -> DataFrame:
    """Adds n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added to every row.

    The four counts and the hash are of the patterns' spans alone; spans holds all, and n_added counts the CRF's.
    A null or empty text has no span: counts 0, the hash of the empty string, an empty list. A very long text is read
    whole, its runs of warm words in pieces. Columns of df with these names are replaced, others stay; nothing is
    dropped, repeated rows get equal results, and an empty table stays empty.
    """
    model = crf or fit_crf()

    def make(part):
        got = all_spans(part.column(text_col).to_pylist(), model)
        counts = [[sum(s[1] == k for s in b) for b, _ in got] for k in range(len(KINDS))]
        return [*counts, [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in got], [joined(a) for _, a in got], [len(a) - len(b) for b, a in got]]

    return append_columns(df, text_col, FIELDS, make)


def op3_pii(spark, sf_dir):
    out = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *(f.name for f in FIELDS))
