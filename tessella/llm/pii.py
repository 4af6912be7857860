"""Personal data by candidate gradient boosting (operator 2).

Base spans come from the four rules of the contract and always stay. Beside them, generators of high
recall propose spans that may overlap each other: written-out e-mail addresses, IPv6 addresses, card
numbers with other separators, phone numbers without a plus sign. Boosted trees over format and
context features score each proposal; a calibrated threshold for each kind selects. Of selected
proposals that overlap, the likeliest stays; one that overlaps a base span goes.

The trees are trained once on the driver from labelled samples that a seeded generator writes (valid
items in their usual surroundings; order numbers, dates, versions, prices and the like as the rest),
calibrated on samples that another generator writes, and travel to the executors as a few hundred numbers.

Defined cases: null text is empty and has no span; repeated rows are searched each; an empty table
gives an empty result; other columns are ignored. Rules that would rescan a long run from each of its
characters are written to take it once, so time is linear in the text.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm.boosting import Trees
from tessella.llm.common import arrow_pass, texts

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = sum(int(d) if k % 2 == 0 else (int(d) * 2 - 9 if d > "4" else int(d) * 2) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """A local part runs back from its @ to the first other character or the last match's end."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", free)
    return out


def _ips(text: str) -> list[Span]:
    out = []
    for m in _DOTTED.finditer(text):
        run, at = m[0].split("."), m.start()
        for k in range(0, len(run) - 3, 4):  # matches follow each other; what is left has under 4 parts
            four = run[k : k + 4]
            end = at + len(".".join(four))
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in four):
                out.append((at, end, "ip"))
            at = end + 1
    return out


def base_spans(text: str) -> list[Span]:
    out = _emails(text) if "@" in text else []
    if _DIGIT.search(text):
        out += _ips(text)
        for m in _CARD.finditer(text):
            digits = re.sub("[ -]", "", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(out, key=_order)


def _order(s: Span) -> tuple[int, int, int]:
    return s[0], KINDS.index(s[2]), s[1]


_AT = r"(?: ?[\[(]at[\])] ?| at )"
_DOT = r"(?:\.| ?[\[(]dot[\])] ?| dot )"
#: kind, what must be in the text, pattern. Repeats are bounded, so each start costs a constant.
GENERATORS = (
    ("email", re.compile(r"[\[(]at[\])]| at ", re.I), re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{2,64}}{_AT}[A-Za-z0-9-]{{2,63}}(?:{_DOT}[A-Za-z0-9-]{{2,63}}){{1,4}}", re.I)),
    ("ip", re.compile(r":[0-9A-Fa-f]{0,4}:"), re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")),
    ("card", re.compile(r"[0-9]{2}"), re.compile(r"(?<![0-9])[0-9](?:[ ._/-]{0,2}[0-9]){11,18}(?![0-9])")),
    ("phone", re.compile(r"[0-9]{2}"), re.compile(r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[ ./-]{1,2}[0-9]{2,5}){1,4}(?![0-9])")),
)
#: Words before a span that speak for each kind, and against all.
CUES = {"email": "mail contact write reach", "ip": "ip host server address client", "card": "card visa credit mastercard amex payment", "phone": "phone call tel mobile fax cell dial", "": "order invoice version page no id isbn serial ticket ref date room code item lot"}
_CUES = {k: frozenset(v.split()) for k, v in CUES.items()}
CONTEXT = 40


def candidates(text: str) -> list[Span]:
    out = []
    for kind, needed, pattern in GENERATORS:
        if needed.search(text):
            out += [(m.start(), m.end(), kind) for m in pattern.finditer(text)]
    return out


def features(text: str, span: Span) -> list[float]:
    start, end, kind = span
    s = text[start:end]
    digits = "".join(c for c in s if "0" <= c <= "9")
    groups = [len(g) for g in re.split(r"[^0-9A-Za-z]+", s) if g]
    words = set(re.findall("[a-z]+", text[max(0, start - CONTEXT) : start].lower()))
    before, after = text[start - 1 : start], text[end : end + 1]
    marks = {c for c in s if not c.isalnum()}
    year = any(re.fullmatch("(?:19|20)[0-9]{2}", g) for g in re.split("[^0-9]+", s))
    last = re.split(r"[^A-Za-z0-9]+", s)[-1]
    return [
        *(float(kind == k) for k in KINDS), len(s), len(digits), len(groups), max(groups, default=0), min(groups, default=0), len(marks),
        float(bool(digits) and luhn(digits)), float("(" in s), float("." in marks), float("/" in marks), float("-" in marks), float(year), float(last.isalpha() and 2 <= len(last) <= 6),
        float(s.count(":")), float(bool(re.search("[A-Fa-f]", s))), float(digits[:1] in tuple("3456") and len(digits) in (13, 14, 15, 16)),
        *(len(words & own) for own in (_CUES[kind], _CUES[""])), float(before.isalnum()), float(before in tuple("$€£#.,-/")), float(after.isalnum()), float(after in tuple("%€$/:")),
    ]


def _samples(n: int, seed: int) -> list[tuple[str, Span, int]]:
    """Texts with one marked span and whether it is personal data."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choices("0123456789", k=k))
    word = lambda: "".join(r.choices(["ba", "ne", "lor", "ti", "mar", "son", "ev", "ka"], k=r.randint(1, 3)))

    def card(sep: str) -> str:
        d = r.choice("3456") + num(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return sep.join(d[k : k + 4] for k in range(0, 16, 4))

    def good(kind: str) -> str:
        if kind == "email":
            at, dot = r.choice([("(at)", "(dot)"), (" [at] ", " [dot] "), (" at ", " dot "), ("[at]", "."), (" (at) ", ".")])
            return f"{word()}{r.choice(['', '.', '_'])}{word()}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'de', 'co'])}"
        if kind == "ip":
            return ":".join(f"{r.randrange(65536):x}" for _ in range(8)) if r.random() < 0.6 else f"fe80::{r.randrange(65536):x}:{r.randrange(65536):x}:{r.randrange(65536):x}"
        if kind == "card":
            return card(r.choice(["", ".", " ", "-", "_", "  "]))
        a, b, c = num(3), num(3), num(4)
        return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"0{a}/{b} {c}"])

    def bad(kind: str) -> str:
        if kind == "email":
            return f"{word()} at {word()} dot {word()}" if r.random() < 0.5 else f"{word()} at {word()}.{word()}"
        if kind == "ip":
            return r.choice([f"{r.randrange(24):02d}:{r.randrange(60):02d}:{r.randrange(60):02d}", f"{num(1)}:{num(2)}:{num(2)}:{num(2)}"])
        if kind == "card":
            return r.choice([num(r.randint(12, 19)), "-".join(num(4) for _ in range(4)), f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"{num(4)} {num(4)} {num(4)}"])
        return r.choice([f"20{num(2)}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.20{num(2)}", f"{num(2)}/{num(2)}/{num(2)}", f"{num(3)} {num(3)}", f"{num(2)}-{num(2)}", f"{num(4)}-{num(4)}", f"{num(2)} {num(3)} {num(2)}", f"20{num(2)}/{num(3)}"])

    out = []
    for _ in range(n):
        kind, real = r.choice(KINDS), r.random() < 0.5
        item = good(kind) if real else bad(kind)
        cue = r.choice(sorted(_CUES[kind if real else ""])) if r.random() < 0.6 else word()
        before = f"{word()} {word()} {cue}{r.choice([' ', ': ', ' is ', ' = '])}"
        text = f"{before}{item}{r.choice([' ', '. ', ', ', chr(10)])}{word()}"
        out.append((text, (len(before), len(before) + len(item), kind), int(real)))
    return out


def _other_samples(n: int, seed: int) -> list[tuple[str, Span, int]]:
    """Samples of another make than those that the trees learn from: other words, surroundings and
    formats, so that thresholds don't rest on what training has seen."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choices("0123456789", k=k))
    names = ["anna", "weber", "olivier", "sanchez", "m.rossi", "j_smith", "kim", "petrov", "lee2", "info", "n-o", "sales"]
    fill = ["we", "moved", "the", "files", "yesterday", "und", "dann", "pour", "que", "esta", "noted", "by", "them", "again"]

    def prose() -> str:
        return " ".join(r.choices(fill, k=r.randint(2, 6)))

    def card() -> str:
        d = r.choice(["4", "51", "55", "37", "6011"])
        d += num((14 if d == "37" else 15) - len(d))
        d += next(c for c in "0123456789" if luhn(d + c))
        cut = (4, 10) if len(d) == 15 else (4, 8, 12)
        sep = r.choice(["", "", " ", ".", "/", " - "])
        return sep.join(d[a:b] for a, b in zip((0, *cut), (*cut, len(d)), strict=True))

    def good(kind: str) -> str:
        if kind == "email":
            at, dot = r.choice([("(AT)", "(DOT)"), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" [AT] ", ".")])
            return f"{r.choice(names)}{at}{r.choice(['post', 'uni-x', 'firm', 'mailbox'])}{dot}{r.choice(['com', 'fr', 'de', 'es', 'org', 'co.uk'])}"
        if kind == "ip":
            h = lambda: f"{r.randrange(1, 65536):04x}"
            return r.choice([f"2001:db8:{h()}:{h()}::{h()}", ":".join(h() for _ in range(8)), f"fd00::{h()}:{h()}:{h()}:{h()}"])
        if kind == "card":
            return card()
        return r.choice([f"+{r.choice(['1', '44', '49'])} ({num(3)}) 555-{num(4)}", f"({num(3)}) {num(3)} {num(4)}", f"0{num(2)} {num(4)} {num(4)}", f"{num(3)}/{num(3)}-{num(4)}", f"0{num(3)}-{num(3)}-{num(3)}"])

    def bad(kind: str) -> str:
        if kind == "email":
            return r.choice(["look at figure", "arrived at noon", "stay at home"]) + r.choice([".then we", ".this is", " dot dash", ".and so"])
        if kind == "ip":
            return r.choice([":".join(f"{r.randrange(100):02d}" for _ in range(3)), ":".join(num(2) for _ in range(4)), f"{num(1)}:{num(1)}:{num(1)}"])
        if kind == "card":
            return r.choice([num(r.randint(12, 19)), f"97{r.choice('89')}{num(10)}", f"20{num(6)} {num(6)}", "/".join(num(3) for _ in range(4)), " ".join(num(2) for _ in range(7)), f"{num(8)}-{num(6)}"])
        return r.choice([f"{num(2)}.{num(2)}.19{num(2)}", f"20{num(2)}/{num(2)}/{num(2)}", f"{num(2)}-{num(3)}", f"{num(3)}.{num(3)}", f"{num(2)} {num(2)} {num(2)}", f"{num(5)}-{num(2)}", f"{num(2)}/{num(2)}"])

    out = []
    for _ in range(n):
        kind, real = r.choice(KINDS), r.random() < 0.5
        item = good(kind) if real else bad(kind)
        cue = r.choice(sorted(_CUES[kind if real else ""])) if r.random() < 0.4 else ""
        before = f"{prose()} {cue}{r.choice(['', ':', ',', ' no.'])} " if r.random() < 0.9 else ""
        text = f"{before}{item}{r.choice([' ', '; ', chr(10), ') '])}{prose()}"
        out.append((text, (len(before), len(before) + len(item), kind), int(real)))
    return out


#: Labelled samples for the trees, samples of another make for calibration, and the precision that each
#: kind's threshold holds on those.
TRAIN_SAMPLES, CALIBRATION_SAMPLES, PRECISION = 3_000, 4_000, 0.98


@lru_cache(1)
def model() -> tuple[Trees, dict[str, float]]:
    """The trees and the least probability at which each kind is taken."""
    arrays = lambda rows: (np.array([features(t, s) for t, s, _ in rows]), np.array([y for _, _, y in rows]))
    fit, rest = _samples(TRAIN_SAMPLES, 11), _other_samples(CALIBRATION_SAMPLES, 12)
    x, y = arrays(fit)
    u, v = arrays(rest)
    trees = Trees().fit(x, y).calibrate(u, v)
    p, least = trees.probability(u), {}
    for k in KINDS:
        own = np.array([s[2] == k for _, s, _ in rest])
        order = np.argsort(-p[own], kind="stable")
        right = np.cumsum(v[own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(right >= PRECISION)
        least[k] = max(0.5, float(p[own][order][good[-1]])) if len(good) else 1.1
    return trees, least


def all_spans(text: str, base: list[Span], trees: Trees, least: dict[str, float]) -> list[Span]:
    """Base spans and the likeliest of the proposals that overlap neither those nor each other."""
    proposed = clear_of(candidates(text), base)
    if not proposed:
        return base
    p = trees.probability(np.array([features(text, c) for c in proposed]))
    chosen = sorted(((-q, c) for q, c in zip(p.tolist(), proposed, strict=True) if q >= least[c[2]]), key=lambda t: (t[0], _order(t[1])))
    taken: list[Span] = []  # by start; none overlaps another, so only the neighbours can overlap a new one
    for _, c in chosen:
        k = bisect_left(taken, c)
        if not (k and taken[k - 1][1] > c[0]) and not (k < len(taken) and taken[k][0] < c[1]):
            taken.insert(k, c)
    return sorted(base + taken, key=_order)


def clear_of(spans: list[Span], base: list[Span]) -> list[Span]:
    """Those that overlap no base span; base is in order of its starts."""
    starts, reach = [b[0] for b in base], list(accumulate((b[1] for b in base), max))
    return [c for c in spans if not (k := bisect_left(starts, c[1])) or reach[k - 1] <= c[0]]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[Span]) -> str:
    """Each run of overlapping spans becomes the mark of its first."""
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


OUTPUTS = {**{f"n_{k}": "long" for k in KINDS}, "base_sha256": "string", "spans": "string", "redacted": "string"}


def detect(docs: DataFrame, outputs: tuple[str, ...] = ("spans", "redacted"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the chosen OUTPUTS for each row, in one pass without a shuffle. n_<kind> and
    base_sha256 are of base spans, spans and redacted of all."""
    trained = model()

    def make():
        trees, least = trained

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found: dict[str, list] = {x: [] for x in outputs}
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                spans = all_spans(text, base, trees, least)
                row = {f"n_{k}": sum(s[2] == k for s in base) for k in KINDS} | {"base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(), "spans": joined(spans)}
                if "redacted" in outputs:
                    row["redacted"] = redact(text, spans)
                for x in outputs:
                    found[x].append(row[x])
            return pa.record_batch([batch.column("doc_id"), *(pa.array(v, pa.int64() if k[:2] == "n_" else pa.string()) for k, v in found.items())], names=["doc_id", *outputs])

        return work

    schema = "doc_id long" + "".join(f", {x} {OUTPUTS[x]}" for x in outputs)
    return arrow_pass(texts(docs, id_col, text_col), make, schema)
