"""Personal data by candidate gradient boosting.

Fixed rules give the base spans. High-recall generators propose further, overlapping spans (obfuscated mail addresses,
phone numbers without a country code, account numbers, national ids, secrets after a keyword); boosted trees score
each by its format and its context, and a calibrated threshold for each kind selects what is redacted too.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import pick

#: The base kinds in their listed order, and the patterns of the contract.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "national_id", "secret")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can only begin where a run of digits does, so the pattern is tried there alone: long runs take linear time
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# high-recall generators
LOOSE_AT = re.compile(r" ?(?:\(at\)|\[at\]|\{at\}) ?| at | @ ?|@ ", re.I)
LOOSE_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?| dot )[A-Za-z0-9-]++)+", re.I)
#: Digit groups with up to five marks or blanks between two of them; wider gaps part numbers.
DIGIT_CHAIN = re.compile(r"[0-9]++(?:[ ().\-/]{1,5}+[0-9]++)*+")
DIGITS = re.compile(r"[0-9]+")
MOST_GROUPS = 6
GAP = " ().-/"
LOOSE_ACCOUNT = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
#: Whole words after the check digits, never given back, so a long word costs one pass.
ANY_ACCOUNT = re.compile(r"\b[A-Za-z]{2}[0-9]{2}(?: ?+[A-Za-z0-9]++){1,9}+")
LOOSE_SECRET = re.compile(r"(?:token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|credential)\s{0,3}(?:=|:|is)\s{0,3}[\"']?([^\s\"'<>]{5,}[^\s\"'<>.,;:)\]])", re.I)
#: How the keys of well-known services look.
LOOSE_KEY = re.compile(r"\b(?:(?:AKIA|ASIA)[A-Z0-9]{16}\b|gh[oprsu]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|[rs]k_(?:live|test)_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})")
SECRET_HINTS = ("token", "secret", "passw", "pwd", "key", "credential")
CONTEXT = 28
_HINTS = {
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "whatsapp", "handy", "móvil", "portable"),
    "card": ("card", "visa", "credit", "amex", "karte", "tarjeta", "carte"),
    "account": ("iban", "account", "konto", "cuenta", "compte", "bank"),
    "national_id": ("ssn", "social", "passport", "national", "dni", "tax id"),
    "mail": ("mail", "contact", "write", "reach"),
    "number": ("order", "invoice", "isbn", "part", "serial", "page", "figure", "total", "item", "issue", "ref"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def mod97(account: str) -> bool:
    s = account.replace(" ", "")
    if len(s) < 15 or len(s) > 34 or not s.isalnum() or not s.isascii():
        return False
    return int("".join(str(int(c, 36)) for c in (s[4:] + s[:4]))) % 97 == 1


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of the base kinds, in their order; leftmost and non-overlapping within a kind."""
    mail, at, free = [], text.find("@"), 0
    while at >= 0:
        m = DOMAIN.match(text, at)
        if m:
            lo = at
            while lo > free and text[lo - 1] in LOCAL:
                lo -= 1
            if lo < at:
                mail.append((lo, m.end()))
                free = m.end()
        at = text.find("@", max(at + 1, free))
    ip = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    card = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = _digits(m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                card.append(m.span())
    phone = [m.span() for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return [mail, ip, card, phone]


def digit_runs(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, digits) of every run of one to six adjacent digit groups with 7 to 19 digits, from every group on.

    A bracket that opens right before a run counts to it if it closes inside.
    """
    for chain in DIGIT_CHAIN.finditer(text):
        if chain.end() - chain.start() < 7:
            continue
        groups = [m.span() for m in DIGITS.finditer(text, *chain.span())]
        for i, (lo, _) in enumerate(groups):
            n = 0
            for k in range(i, min(i + MOST_GROUPS, len(groups))):
                a, hi = groups[k]
                n += hi - a
                if n > 19:
                    break
                if n >= 7:
                    opened = lo > 0 and text[lo - 1] == "(" and text.find(")", lo, hi) >= 0
                    yield lo - opened, hi, n


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Everything that could be personal data beyond the base rules; spans may overlap."""
    out = []
    low = text.lower()
    if ("at" in low or "@" in low) and ("." in low or "dot" in low):
        for m in LOOSE_AT.finditer(text):
            lo = m.start()
            if lo and text[lo - 1].isalnum() and (domain := LOOSE_DOMAIN.match(text, m.end())):
                while lo and (text[lo - 1] in LOCAL or text[lo - 1].isalnum()):
                    lo -= 1
                if lo < m.start():
                    out.append(("email", lo, domain.end()))
    for lo, hi, n in digit_runs(text):
        if n <= 15:
            out.append(("phone", lo, hi))
        if n >= 13:
            out.append(("card", lo, hi))
        if n == 9:
            out.append(("national_id", lo, hi))
    for m in LOOSE_ACCOUNT.finditer(text):
        out.append(("account", *m.span()))
    for m in ANY_ACCOUNT.finditer(text):  # words may follow, so every end whose check digits are right is proposed
        ends = [*(m.start() + k for k, c in enumerate(m[0]) if c == " "), m.end()]
        out += [("account", m.start(), hi) for hi in ends if mod97(text[m.start() : hi])]
    if any(h in low for h in SECRET_HINTS):
        for m in LOOSE_SECRET.finditer(text):
            out.append(("secret", *m.span(1)))
    for m in LOOSE_KEY.finditer(text):
        out.append(("secret", *m.span()))
    return list(dict.fromkeys(out))


def _side(c: str) -> float:
    return 0.0 if not c or c.isspace() else 1.0 if c.isalpha() else 2.0 if c.isdigit() else 3.0


def _beside(text: str, lo: int, hi: int) -> list[float]:
    """Of the digit groups next to a run, left and right: their digits, the gap, and whether the run has such a gap inside."""
    inside = set(re.split(r"[0-9]+", text[lo:hi].lstrip("("))[1:-1])
    left, right = text[max(0, lo - CONTEXT) : lo], text[hi : hi + CONTEXT]
    row = []
    for gap, rest in ((left[len(left.rstrip(GAP)) :], left.rstrip(GAP)[::-1]), (right[: len(right) - len(right.lstrip(GAP))], right.lstrip(GAP))):
        m = DIGITS.match(rest)
        row += [float(len(m[0])), float(len(gap)), float(gap in inside)] if m else [0.0, 0.0, 0.0]
    return row


def features(text: str, kind: str, lo: int, hi: int) -> list[float]:
    """Format of the span and words around it."""
    s = text[lo:hi]
    before = text[max(0, lo - CONTEXT) : lo].lower()
    n = len(s)
    d = _digits(s)
    letters = sum(map(str.isalpha, s))
    groups = [len(g) for g in re.split(r"[^0-9A-Za-z]+", s) if g]
    hexes = sum(c in "0123456789abcdefABCDEF" for c in s)
    row = [float(KINDS.index(kind)), n, len(d), letters, sum(map(str.isupper, s)), n - len(d) - letters, len(groups), max(groups, default=0), groups[0] if groups else 0, groups[-1] if groups else 0]
    row += [float(16 <= len(d) <= 19 and luhn(d)), float(kind == "account" and mod97(s)), hexes / max(1, n), len(set(s)) / max(1, n), _side(text[lo - 1 : lo] if lo else ""), _side(text[hi : hi + 1])]
    row += [float(s[:1] == "("), float(s.startswith("00")), float([3, 2, 4] == groups), float("at" in s.lower()), float("dot" in s.lower() or "." in s), float(" " in s), float("-" in s), float("." in s), float("/" in s)]
    row += [float(any(w in before for w in words)) for words in _HINTS.values()]
    row += [float(g) for g in (groups + [0, 0, 0])[1:3]]
    row += [float("@" in s), float(LOOSE_KEY.fullmatch(s) is not None), float(s[:1] == "0"), float(s.isascii())]
    row += _beside(text, lo, hi) if kind in ("phone", "card", "national_id") else [0.0] * 6
    return row


# ------------------------------------------------------------------------------------------------- boosted trees


class Boosted:
    """Gradient-boosted trees with a logistic loss over binned features."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.trees: list[tuple] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree, leaf = self._grow(b, y - p, p * (1 - p))
            self.trees.append(tree)
            f += tree[2][leaf]
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[tuple, np.ndarray]:
        """A complete tree as (feature, cut, leaf value) arrays in heap order, and each row's leaf.

        Level by level: one histogram over (node, feature, bin) gives the best cut of every node at once.
        """
        inner, width = (1 << self.depth) - 1, self.bins + 1
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, 1 << 20)
        node = np.zeros(len(g), dtype=np.int64)
        n_features = b.shape[1]
        place = (b + np.arange(n_features) * width).astype(np.int64)
        gs, hs = np.repeat(g, n_features), np.repeat(h, n_features)
        for level in range(self.depth):
            first, n = (1 << level) - 1, 1 << level
            at = (place + ((node - first) * (n_features * width))[:, None]).ravel()
            shape = (n, n_features, width)
            sg, sh = (np.bincount(at, v, n * n_features * width).reshape(shape).cumsum(axis=2) for v in (gs, hs))
            top_g, top_h = sg[:, :, -1:], sh[:, :, -1:]
            gain = sg[:, :, :-1] ** 2 / (sh[:, :, :-1] + self.ridge) + (top_g - sg[:, :, :-1]) ** 2 / (top_h - sh[:, :, :-1] + self.ridge) - top_g**2 / (top_h + self.ridge)
            gain = gain.reshape(n, -1)
            best = gain.argmax(axis=1)
            good = (np.bincount(node - first, minlength=n) > 8) & (gain[np.arange(n), best] > 1e-3)
            own = np.flatnonzero(good)
            feature[first + own], cut[first + own] = best[own] // self.bins, best[own] % self.bins
            node = 2 * node + 1 + (b[np.arange(len(g)), feature[node]] > cut[node])
        leaf = node - inner
        width = 1 << self.depth
        value = self.rate * np.bincount(leaf, g, width) / (np.bincount(leaf, h, width) + self.ridge)
        return (feature, cut, value), leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)
        f = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            f += value[node - len(feature)]
        return 1 / (1 + np.exp(-f))


# ------------------------------------------------------------------------------------------------- training cases


def _number(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _with_check(rng: random.Random, n: int) -> str:
    d = _number(rng, n - 1)
    return next(d + c for c in "0123456789" if luhn(d + c))


def _account(rng: random.Random, good: bool) -> str:
    body = "".join(rng.choice("0123456789") for _ in range(rng.choice((14, 18, 20))))
    land = rng.choice(("DE", "FR", "ES", "NL", "IT", "GB"))
    check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
    s = f"{land}{check if good else (check + rng.randint(1, 90)) % 97:02d}{body}"
    s = s.lower() if rng.random() < 0.25 else s
    return re.sub(r"(.{4})(?=.)", r"\1 ", s) if rng.random() < 0.5 else s


def labelled(n: int = 9000, seed: int = 11) -> list[tuple[str, str, bool]]:
    """Generated cases (text, personal part, whether it is personal): both classes in plain and in telling contexts.

    NULs enclose the part, and further personal parts of its kind beside it.
    """
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaoinshrdlucmfgypwbv") for _ in range(rng.randint(2, 9)))
    hint = lambda k: rng.choice(_HINTS[k]) + rng.choice((": ", " ", " is ", ". ", " no "))
    phone = lambda: rng.choice(("({a}) {b}-{c}", "{a}-{b}-{c}", "{a} {b} {c}", "{a}.{b}.{c}", "00{x} {a} {b}{c}", "0{a} {b} {c}")).format(a=_number(rng, 3), b=_number(rng, 3), c=_number(rng, 4), x=_number(rng, 2))
    there = lambda: rng.choice(("0{p} {p} {p} {p} {p}", "0{d}.{p}.{p}.{p}.{p}", "0{d} {p} {p} {p} {p}", "{m}{p} {t} {t}", "{m}{p} {p} {p} {p}", "{m}{t}{t}{p}", "0{p}/{t}{t}{p}", "0{t}/{t}{t}", "0{t} {t}{t}{d}", "0{p} {q} {q}", "0{q} {t}{t}", "({t}) {t} {q}", "0{p}-{t}{t}{d}")).format(p=_number(rng, 2), d=_number(rng, 1), t=_number(rng, 3), q=_number(rng, 4), m=rng.choice("679"))
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    some = lambda k: "".join(rng.choice(letters) for _ in range(k))
    key = lambda: rng.choice((lambda: rng.choice(("AKIA", "ASIA")) + some(16).upper(), lambda: f"gh{rng.choice('opsu')}_{some(36)}", lambda: f"xoxb-{_number(rng, 11)}-{some(24)}", lambda: "AIza" + some(35), lambda: f"sk_live_{some(24)}", lambda: f"eyJ{some(20)}.{some(40)}.{some(43)}"))()
    name = lambda: word() + (rng.choice("äöüéèñçå") + word() if rng.random() < 0.3 else "")
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(rng.choice("abcdefghijkABCDEFGHIJK0123456789_-!") for _ in range(k))
    case = lambda x: x.upper() if rng.random() < 0.2 else x
    mail = lambda: case(f"{name()}{rng.choice(('', '.' + word()))} {rng.choice(('(at)', '[at]', 'at', '@'))} {word()}{rng.choice((' (dot) ', ' [dot] ', ' dot ', '.', '.'))}{rng.choice(('com', 'org', 'net', 'de', 'fr', 'example.com'))}")
    day = lambda: rng.choice(("{y}-{m:02d}-{d:02d}", "{d:02d}.{m:02d}.{y}", "{m:02d}/{d:02d}/{y}")).format(y=rng.randint(1900, 2030), m=rng.randint(1, 12), d=rng.randint(1, 28))
    next_to = lambda: rng.choice((" / ", " ", ". ", " - ", "/", "  "))
    made = (
        lambda: (hint("phone") if rng.random() < 0.7 else "", phone(), True),
        lambda: ("", f"({_number(rng, 3)}) {_number(rng, 3)}-{_number(rng, 4)}", True),
        lambda: (hint("number"), rng.choice((phone(), _number(rng, rng.randint(7, 15)))), False),
        lambda: ("", _number(rng, rng.randint(7, 15)), False),
        lambda: ("", " ".join(_number(rng, rng.randint(1, 5)) for _ in range(rng.randint(2, 5))), False),
        lambda: ("", f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}" + rng.choice(("", " 10", "/2011")), False),
        lambda: ("", ".".join(_number(rng, rng.randint(1, 4)) for _ in range(rng.randint(3, 6))), False),
        lambda: (hint("card") if rng.random() < 0.5 else "", ".".join(re.findall("....", _with_check(rng, 16))), True),
        lambda: (hint("card") if rng.random() < 0.2 else "", rng.choice((_number(rng, 16), _number(rng, 13), " ".join(re.findall("....", _number(rng, 16))))), False),
        lambda: (hint("account") if rng.random() < 0.6 else "", _account(rng, True), True),
        lambda: (hint("account") if rng.random() < 0.3 else "", _account(rng, False), False),
        lambda: (hint("national_id"), f"{_number(rng, 3)}-{_number(rng, 2)}-{_number(rng, 4)}", True),
        lambda: ("", rng.choice((_number(rng, 9), f"{_number(rng, 4)}-{_number(rng, 5)}")), False),
        lambda: (rng.choice(("token = ", "api_key: ", "secret=", "access-key = ")) + rng.choice(('"', "'", "")), rng.choice((hexes(40), hexes(32), mixed(24), mixed(36))), True),
        lambda: (rng.choice(("password: ", "pwd=", "passwd = ")), mixed(rng.randint(8, 16)), True),
        lambda: (rng.choice(("the token is ", "secret: ", "a password is ", "key is ")), word() + word(), False),
        lambda: (hint("mail") if rng.random() < 0.5 else "", mail(), True),
        lambda: ("", f"{word()} at {word()}.{word()}", False),
        lambda: ("", f"{word()}. At {word()}. {word().capitalize()}", False),
        lambda: ("", f"{word()} at {word()}. {word().capitalize()} {word()}", False),
        lambda: ("", f"{word()} at {word()} dot {word()}ing", False),
        lambda: (hint("phone"), there(), True),
        lambda: (hint("phone"), there(), True),
        lambda: (hint("phone"), rng.choice((" ", ".", "-")).join(("0" + _number(rng, 1), *(_number(rng, 2) for _ in range(4)))), True),
        lambda: (hint("phone"), rng.choice((" ", ".", "-")).join(("0" + _number(rng, 1), *(_number(rng, 2) for _ in range(4)))), True),
        lambda: (hint("account"), _account(rng, True).lower(), True),
        lambda: (hint("number"), there(), False),
        lambda: (rng.choice(("", "key ", "the key: ", "id ", "use ", "Bearer ")), key(), True),
        lambda: (rng.choice(("", "key ", "id ", "use ")), rng.choice((some(20), some(20).upper(), "AKIA" + word(), "gh_" + some(12))), False),
        lambda: ("", next(s for _ in iter(int, 1) if not mod97(s := f"{word()[:2]}{_number(rng, 2)} " + " ".join(word()[:4].ljust(4, "x") for _ in range(3)))), False),
        # numbers beside each other: each personal one is marked
        lambda: (hint("phone") if rng.random() < 0.7 else "", next_to().join(("{}",) * rng.randint(2, 4)), phone),
        lambda: (hint("phone") if rng.random() < 0.7 else "", "{}" + rng.choice((" ", ". ", " - ", " (", " / ")) + day(), phone),
        lambda: (hint("phone") if rng.random() < 0.5 else "", rng.choice((day(), str(rng.randint(1900, 2030)), _number(rng, rng.randint(1, 3)) + ".", f"({rng.randint(1900, 2030)})")) + rng.choice((" ", ". ", " - ", " / ")) + "{}", phone),
        lambda: (hint("card") if rng.random() < 0.5 else "", "{}" + next_to() + rng.choice(("{}", day(), _number(rng, 3))), lambda: ".".join(re.findall("....", _with_check(rng, 16)))),
        lambda: (hint("national_id"), rng.choice(("{}" + next_to() + "{}", "{} " + day(), day() + " {}")), lambda: f"{_number(rng, 3)}-{_number(rng, 2)}-{_number(rng, 4)}"),
        lambda: ("", day() + next_to() + day(), False),
        lambda: (rng.choice(("token = ", "secret: ", "api_key=", "access_key: ")) + rng.choice(('"', "'", "")), rng.choice((hexes, mixed, lambda k: ".".join(mixed(k // 3) for _ in range(3)) + "Q"))(rng.randint(60, 1500)), True),
    )
    out = []
    for i in range(n):
        lead, span, good = made[i % len(made)]()
        if callable(good):
            shape, make = re.split(r"(\{\})", span), good
            parts = [make() if x == "{}" else x for x in shape]
            lead, span, tail = lead + parts[0], parts[1], "".join(f"\0{x}\0" if y == "{}" else x for x, y in zip(parts[2:], shape[2:], strict=True))
            good = True
        else:
            tail = ""
        out.append((" ".join(word() for _ in range(rng.randint(0, 5))) + rng.choice((" ", ". ", "\n")) + lead + "\0" + span + "\0" + tail + rng.choice((" ", ", ", ". ", "\n", '" ', ") ")) + " ".join(word() for _ in range(rng.randint(0, 4))), span, good))
    return out


def cases(rows: list[tuple[str, str, bool]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Features and truth of all candidates that the generators propose in the cases: true if the span is a personal part."""
    x, y, kinds = [], [], []
    for marked, span, good in rows:
        parts = marked.split("\0")
        text = "".join(parts)
        ends = np.cumsum([len(v) for v in parts]).tolist()
        own = list(zip(ends[::2], ends[1::2], strict=False)) if good else []
        for kind, a, b in candidates(text):
            x.append(features(text, kind, a, b))
            y.append(float(any(abs(a - lo) <= 1 and abs(b - hi) <= 1 and _right_kind(kind, text[lo:hi]) for lo, hi in own)))
            kinds.append(kind)
    return np.array(x), np.array(y), kinds


def _right_kind(kind: str, span: str) -> bool:
    d, letters = _digits(span), sum(map(str.isalpha, span))
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d) and not letters
    if kind == "phone":
        return not letters and not re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", span) and len(d) <= 15
    if kind == "national_id":
        return bool(re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", span))
    return True


class PiiModel:
    def __init__(self, trees: Boosted, threshold: dict[str, float]):
        self.trees, self.threshold = trees, threshold

    def added(self, text: str, base: list[list[tuple[int, int]]]) -> list[tuple[str, int, int]]:
        """Candidates over their kind's threshold that touch no base span; of overlapping ones the best score stays."""
        got = candidates(text)
        if not got:
            return []
        taken = bytearray(len(text))
        for spans in base:
            for a, b in spans:
                taken[a:b] = b"\1" * (b - a)
        free = [c for c in got if not any(taken[c[1] : c[2]])]
        if not free:
            return []
        p = self.trees.score(np.array([features(text, *c) for c in free]))
        keep: list[tuple[str, int, int]] = []
        for q, c in sorted(zip(p.tolist(), free, strict=True), key=lambda z: (-z[0], z[1][1], -z[1][2], z[1][0])):
            if q >= self.threshold[c[0]] and not any(taken[c[1] : c[2]]):
                keep.append(c)
                taken[c[1] : c[2]] = b"\1" * (c[2] - c[1])
        return keep


@cache
def fit(precision: float = 0.99) -> PiiModel:
    """Trees from generated cases; each kind's threshold is the least score that reaches the precision on other cases."""
    x, y, _ = cases(labelled(9000, 11))
    trees = Boosted().fit(x, y)
    x, y, kinds = cases(labelled(5000, 12))
    p = trees.score(x)
    threshold = {}
    for kind in KINDS:
        own = np.array([k == kind for k in kinds])
        order = np.argsort(-p[own]) if own.any() else np.zeros(0, int)
        q, good = p[own][order], y[own][order]
        right = np.cumsum(good) / np.arange(1, len(good) + 1)
        fine = np.flatnonzero(right >= precision)
        threshold[kind] = max(0.5, float(q[fine[-1]])) if len(fine) else 1.1
    return PiiModel(trees, threshold)


def all_spans(text: str, model: PiiModel) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base, all) spans as (kind, start, end) by kind as listed, then start."""
    base = base_spans(text)
    first = [(k, a, b) for k, spans in zip(BASE_KINDS, base, strict=True) for a, b in spans]
    more = model.added(text, base)
    both = sorted([*first, *more], key=lambda s: (KINDS.index(s[0]), s[1], s[2])) if more else first
    return first, both


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span (overlapping ones joined) replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def detect(df: DataFrame, model: PiiModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Null and empty texts have no spans (the digest of the empty string). Offsets are code points, ends exclusive. Rows
    are independent: repeated rows and null ids come back as they are, and texts of any length are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for t in b.column(1):
                first, both = all_spans(t.as_py() or "", model)
                said = [f"{k}:{x}:{y}" for k, x, y in first]
                for c, k in zip(cols, BASE_KINDS, strict=False):
                    c.append(sum(s[0] == k for s in first))
                cols[4].append(hashlib.sha256(",".join(said).encode()).hexdigest())
                cols[5].append(",".join(f"{k}:{x}:{y}" for k, x, y in both))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    schema = f"doc_id {dict(df.dtypes)[id_col]}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return pick(df, id_col, text_col).mapInArrow(run, schema)


def redact(df: DataFrame, model: PiiModel, text_col: str = "text") -> DataFrame:
    """df with every span of text_col replaced; all other columns, and null texts, stay."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = []
            for t in b.column(at):
                s = t.as_py()
                spans = all_spans(s, model)[1] if s else []
                new.append(redacted(s, spans) if spans else s)
            cols = list(b.columns)
            cols[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    return df.mapInArrow(run, df.schema)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet"), fit())
