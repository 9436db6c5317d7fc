"""Personal data: base patterns, and spans that boosted trees select among generous candidates.

Base spans follow fixed patterns and always stay. Beyond them, generators propose every span that
might be an identifier of some kind, overlapping ones included; boosted trees judge each by its
format and its surroundings; their scores are scaled to probabilities on examples that the trees have
not seen, and on these each kind's threshold is the least probability at which the spans selected
are still as precise as asked for. Of overlapping selected spans the likelier stays, of equally
likely ones the longer. The examples are made here by a seeded generator, hard negatives and cases
that cannot be told apart among them, so training needs no data and gives the same model everywhere.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import random
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows

BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "address6", "birth", "contact", "identity", "mac", "secret")
KINDS = BASE + ADDED
#: Precision that a kind's threshold must reach on held-out examples, and the examples made.
PRECISION, EXAMPLES, SEED = 0.95, 16000, 20
#: In texts, look-alikes are that many times more frequent, against identifiers, than in the examples.
ODDS = 5.0

Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails cannot succeed from a later digit, so no match starts inside one.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        if at >= end:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                out.append(("email", start, m.end()))
                end = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the four base kinds, in the order of the kinds, then of their starts."""
    out = _emails(text)
    if not _DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


_GROUPS = "[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}"
# What might be an identifier, by kind. The patterns overlap in what they match on purpose. A group,
# where a pattern has one, is the span.
_CANDIDATES: tuple[tuple[str, re.Pattern], ...] = (
    ("account", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")),
    ("account", re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){5,18}(?![0-9])")),
    ("address6", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Fa-f:])")),
    ("address6", re.compile(rf"(?<![0-9A-Za-z:])(?:{_GROUPS}::(?:{_GROUPS})?|::{_GROUPS})(?![0-9A-Za-z:])")),
    ("birth", re.compile(r"(?<![0-9./-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9/-])")),
    ("contact", re.compile(r"(?<![0-9])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    ("contact", re.compile(r"(?<![0-9])0[0-9]{1,4}[ /-][0-9]{2,8}(?:[ -][0-9]{2,4}){0,4}(?![0-9])")),
    ("identity", re.compile(r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])")),
    ("identity", re.compile(r"(?<![A-Za-z0-9])(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]{6,14}(?![A-Za-z0-9])")),
    ("mac", re.compile(r"(?<![0-9A-Fa-f:-])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:-])")),
    ("mac", re.compile(r"(?<![0-9A-Za-z.])[0-9A-Fa-f]{4}\.[0-9A-Fa-f]{4}\.[0-9A-Fa-f]{4}(?![0-9A-Za-z])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+(?:={1,2}(?![A-Za-z0-9]))?")),
    ("secret", re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]{4,}+){2}(?![A-Za-z0-9_-])")),
)
# A value after a sign of assignment, a candidate if one of the words for secrets stands before the sign.
_ASSIGNED = re.compile(r"(?:[=:]|\bis\b)[ \t]*[\"']?([^\s\"'<>,;]{6,}+)")
_KEYED = re.compile(r"(?i)(?:token|key|secret|passw|pwd|auth|bearer|credential|login|pin)[a-z0-9_]{0,12}[\"']?\s*$")

#: Words that make a kind likelier, or an innocent number, in the text before a span.
_HINTS = {
    "account": ("iban", "account", "acct", "bank", "card", "visa"),
    "address6": ("ip", "host", "address", "server", "ping"),
    "birth": ("born", "birth", "dob", "birthday", "birthdate"),
    "contact": ("phone", "tel", "call", "mobile", "fax", "reach"),
    "identity": ("ssn", "social", "passport", "licence", "license", "identity", "id"),
    "mac": ("mac", "device", "adapter", "interface"),
    "secret": ("token", "key", "secret", "password", "passwd", "api", "auth", "bearer", "credential", "pwd", "login", "pin"),
    "innocent": ("commit", "sha", "hash", "md5", "checksum", "order", "invoice", "part", "isbn", "version", "build", "page", "total", "price", "time", "color", "file", "see"),
}
_WORD = re.compile(r"[a-z]+")


def candidates(text: str) -> list[Span]:
    """All spans any generator proposes, in no order of worth."""
    out, digits, colons = {}, bool(_DIGIT.search(text)), "::" in text
    for kind, pattern in _CANDIDATES:
        # the other kinds have digits, but for addresses and devices of letters alone
        if not (digits or kind in ("secret", "mac") or kind == "address6" and colons):
            continue
        for m in pattern.finditer(text):
            out[kind, m.start(), m.end()] = None
    for m in _ASSIGNED.finditer(text):
        if _KEYED.search(text, max(0, m.start() - 30), m.start()):
            out["secret", m.start(1), m.start(1) + len(m.group(1).rstrip(".!?)]}"))] = None
    return [c for c in out if c[1] < c[2]]


def features(text: str, span: Span) -> list[float]:
    """Format of the span and context of 40 characters before and 12 after it."""
    kind, start, end = span
    s = text[start:end]
    before, after = text[max(0, start - 40) : start].lower(), text[end : end + 12]
    n = len(s)
    digits = [c for c in s if c.isdigit()]
    counts = Counter(s)
    runs = [len(x) for x in re.findall(r"[a-z]+|[A-Z][a-z]*|[0-9]+", s)]
    groups = re.split(r"[^0-9A-Za-z]+", s)
    plain = "".join(c for c in s if c.isalnum())
    iban = 15 <= len(plain) <= 34 and plain[:2].isalpha() and plain[2:4].isdigit() and plain.isascii()
    listed = _WORD.findall(before)
    words, near = set(listed), set(listed[-2:])
    hints = [float(bool(words & set(_HINTS[k]))) for k in _HINTS]
    return [
        float(KINDS.index(kind)),
        float(n),
        len(digits) / n,
        sum(c.isupper() for c in s) / n,
        sum(c in "0123456789abcdefABCDEF" for c in s) / n,
        -sum(v / n * math.log2(v / n) for v in counts.values()),
        float(len(groups)),
        float(max(map(len, groups))),
        float(len(digits)),
        float(13 <= len(digits) <= 19 and luhn("".join(digits))),
        float(iban and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1),
        float(bool(re.search(r"[a-z]", s)) + bool(re.search(r"[A-Z]", s)) + bool(digits)),
        float(sum(s[i].isdigit() != s[i + 1].isdigit() for i in range(n - 1))),
        float(before.rstrip()[-1:] in ("=", ":", '"', "'")),
        float(before[-1:] in ('"', "'")),
        float(before[-1:] in ("$", "€", "#", "/", ".", "-")),
        float(after[:1] in ('"', "'")),
        float(after[:1] in ("%", "/", "-", ".")),
        float(after[:1] == "." and after[1:2].isalnum()),
        float(s.startswith("eyJ") + 2 * ("." in s)),
        max(runs, default=0) / n,
        sum(c in "aeiouAEIOU" for c in s) / n,
        float(len(set(digits))),
        float(bool(_KEYED.search(before.rstrip(" =:\"'")))),
        *hints,
        float(bool(words & set(_HINTS.get(kind, ())))),
        float(bool(near & set(_HINTS.get(kind, ())))) - float(bool(near & set(_HINTS["innocent"]))),
    ]


class Boosted:
    """Gradient-boosted regression trees for log loss, on feature values cut at quantiles."""

    def __init__(self, trees: int = 80, depth: int = 4, rate: float = 0.2, l2: float = 1.0, least: float = 2.0):
        self.trees, self.depth, self.rate, self.l2, self.least = trees, depth, rate, l2, least

    def fit(self, x, y):
        import numpy as np

        # quantiles of the rows, and of the distinct values so that rare ones can be told apart as well
        levels = np.linspace(0, 1, 33)[1:-1]
        self.cuts = [np.unique(np.concatenate([np.quantile(c, levels), np.quantile(np.unique(c), levels, method="lower")])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)
        self.start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        score, self.forest = np.full(len(y), self.start), []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            tree: dict[int, tuple] = {}
            node = np.ones(len(y), np.int64)
            self._grow(tree, node, 1, binned, y - p, p * (1 - p), np.arange(len(y)), 0)
            self.forest.append(tree)
            score += self._walk(tree, x)
        return self

    def _grow(self, tree, node, number, binned, g, h, rows, depth):
        import numpy as np

        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        if depth < self.depth:
            for f, cuts in enumerate(self.cuts):
                if not len(cuts):
                    continue
                bins = binned[rows, f]
                lg = np.cumsum(np.bincount(bins, g[rows], len(cuts) + 1))[:-1]
                lh = np.cumsum(np.bincount(bins, h[rows], len(cuts) + 1))[:-1]
                rh = total_h - lh
                gain = lg**2 / (lh + self.l2) + (total_g - lg) ** 2 / (rh + self.l2) - total_g**2 / (total_h + self.l2)
                gain[(lh < self.least) | (rh < self.least)] = -1
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], f, at)
        if best[1] is None:
            tree[number] = (None, float(self.rate * total_g / (total_h + self.l2)))
            return
        _, f, at = best
        tree[number] = (f, float(self.cuts[f][at]))
        left = binned[rows, f] <= at
        self._grow(tree, node, 2 * number, binned, g, h, rows[left], depth + 1)
        self._grow(tree, node, 2 * number + 1, binned, g, h, rows[~left], depth + 1)

    @staticmethod
    def _walk(tree, x):
        import numpy as np

        out, todo = np.zeros(len(x)), [(1, np.arange(len(x)))]
        while todo:
            number, rows = todo.pop()
            f, value = tree[number]
            if f is None:
                out[rows] = value
            elif len(rows):
                left = x[rows, f] <= value
                todo += [(2 * number, rows[left]), (2 * number + 1, rows[~left])]
        return out

    def score(self, x):
        """The logit, before calibration."""
        return self.start + sum(self._walk(t, x) for t in self.forest)


def _example(r: random.Random) -> tuple[str, list[Span]]:
    """A text with one identifier or look-alike, and the true spans in it.

    Strong formats are true wherever they stand. Weak ones are true after a word for their kind and
    innocent elsewhere, but for one in a hundred either way: what no context tells has no certain answer.
    """
    upper, lower, ten = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    of = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    digits = lambda n: of(ten, n)
    hexes = lambda n: of("0123456789abcdef", n)
    any_of = lambda n: of(upper + lower + ten, n)
    word = lambda: of("etaoinshrdlu", r.randint(2, 9))
    short = lambda: ":".join(hexes(r.randint(1, 4)) for _ in range(r.randint(1, 4)))

    def iban() -> str:
        country, rest = r.choice(("DE", "FR", "ES", "GB", "NL")), digits(r.choice((16, 18, 20)))
        check = 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97
        plain = f"{country}{check:02d}{rest}"
        return plain if r.random() < 0.6 else " ".join(plain[i : i + 4] for i in range(0, len(plain), 4))

    def date() -> str:
        day, month, year = r.randint(1, 28), r.randint(1, 12), r.randint(1930, 2024)
        return r.choice((f"{day:02d}/{month:02d}/{year}", f"{day}.{month}.{year}", f"{year}-{month:02d}-{day:02d}"))

    def mixed() -> str:
        out = list(of(upper, r.randint(1, 4)) + digits(r.randint(4, 8)))
        if r.random() < 0.5:
            r.shuffle(out)
        return "".join(out)

    def token() -> str:
        safe = upper + lower + ten + "-_"
        return f"eyJ{any_of(r.randint(12, 40))}.{'eyJ' if r.random() < 0.7 else ''}{of(safe, r.randint(20, 120))}.{of(safe, r.randint(20, 60))}"

    def prose() -> str:
        words = [word() for _ in range(r.randint(3, 8))]
        return r.choice(("-".join(words), "_".join(words), "/".join(words), "".join(w.title() for w in words), "".join(words), ".".join(words), r.choice("-_=/x") * r.randint(16, 200), "".join(words[:3]) + digits(2), f"{words[0]}-{words[1]}-{words[2]}-{digits(4)}"))

    def password() -> str:
        return r.choice((any_of(r.randint(8, 16)), of(upper + lower, r.randint(10, 18)), word().title() + digits(r.randint(2, 4)) + r.choice("!#$%&*"), of(upper + lower + ten + "!#$%&*+-_@", r.randint(8, 20))))

    strong = {
        "account": (iban,),
        "address6": (lambda: ":".join(hexes(4) for _ in range(8)), lambda: f"fe80::{short()}", lambda: f"2001:db8:{hexes(4)}::{short()}", lambda: f"{hexes(4)}::{short()}", lambda: "::1"),
        "birth": (),
        "contact": (lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}"),
        "identity": (lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",),
        "mac": (lambda: ":".join(hexes(2) for _ in range(6)), lambda: "-".join(hexes(2).upper() for _ in range(5)) + "-A" + hexes(1).upper(), lambda: f"{hexes(4)}.{hexes(3)}c.{hexes(4)}"),
        "secret": (token, lambda: "AKIA" + any_of(16).upper(), lambda: r.choice(("sk-", "ghp_", "xoxb-")) + any_of(32), lambda: any_of(r.randint(100, 400))),
    }
    weak = {
        "account": (lambda: digits(r.randint(6, 18)), lambda: f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}", lambda: f"{digits(2)}-{digits(2)}-{digits(2)}"),
        "address6": (),
        "birth": (date,),
        "contact": (lambda: f"{digits(3)}.{digits(3)}.{digits(4)}", lambda: f"0{digits(3)} {digits(6)}", lambda: f"0{digits(2)} {digits(4)} {digits(4)}", lambda: f"00{digits(2)} {digits(2)} {digits(4)} {digits(4)}"),
        "identity": (mixed, mixed, lambda: f"{digits(3)} {digits(2)} {digits(4)}"),
        "mac": (lambda: "-".join(digits(2) for _ in range(6)),),
        "secret": (lambda: hexes(r.choice((32, 40, 64))), lambda: any_of(r.randint(20, 44)), lambda: of(upper + lower, r.randint(20, 44)), password, password),
    }
    innocent = {
        "account": (lambda: digits(r.randint(6, 18)), lambda: f"{r.randint(1, 999)} {digits(3)} {digits(3)}"),
        "address6": (lambda: f"{r.choice(('a', 'dead', 'add', 'cafe', 'face'))}::{r.choice(('b', 'beef', 'add', 'bad', 'fade'))}", lambda: f"{digits(2)}:{digits(2)}:{digits(2)}:{digits(2)}", lambda: f"{digits(1)}:{digits(2)}:{digits(2)}:{digits(3)}", lambda: f"{digits(2)}:{digits(2)}:{digits(2)}"),
        "birth": (date,),
        "contact": (lambda: f"{digits(3)} {digits(3)} {digits(4)}", lambda: f"0{digits(2)}-{digits(4)}"),
        "identity": (mixed, lambda: f"{of(upper, 3)}{digits(4)}"),
        "mac": (lambda: f"{digits(4)}.{digits(4)}.{digits(4)}", lambda: "-".join(digits(2) for _ in range(6))),
        "secret": (lambda: hexes(40), lambda: hexes(64), lambda: any_of(22), lambda: digits(16), prose, prose, prose, word),
    }
    kind = r.choice(ADDED)
    hinted = r.random() < 0.55
    hint, sure = r.choice(_HINTS[kind]), r.random() < 0.4
    if hinted:
        value, true = (r.choice(strong[kind])(), True) if sure and strong[kind] or not weak[kind] else (r.choice(weak[kind])(), True)
        if (other := r.random()) < 0.12:  # a word for the kind, but nothing of it
            value, true = r.choice(innocent[kind])(), False
            if other > 0.004 and not (kind == "secret" and value.isalpha()):
                hint = f"{r.choice(('no', 'the', 'by'))} {hint}, {r.choice(('but', 'and', 'or', 'the'))} {r.choice(_HINTS['innocent'])}"
        lead = r.choice(("{h} = \"", "{h}: ", "{h} ", "my {h} is ", "the {h} number ", "{h}=", "{h}: \"", "{h} = '")).format(h=hint)
        lead = lead.upper() if r.random() < 0.1 else lead
    else:
        value, true = (r.choice(strong[kind])(), True) if sure and strong[kind] else (r.choice(innocent[kind])(), False)
        if not true and weak[kind] and r.random() < 0.01:
            value, true = r.choice(weak[kind])(), True
        lead = r.choice(("", "{h} ", "{h}: ", "{h} number ", "{h} = ", "")).format(h=r.choice(_HINTS["innocent"])) if not true or r.random() < 0.5 else ""
    mark, unit = ("", "") if true else (r.choice(("$", "#", "", "", "", "")), r.choice(("", "", "", "%")))
    head = " ".join(word() for _ in range(r.randint(0, 8))) + " " + lead + mark
    tail = unit + (lead[-1] if lead[-1:] in ('"', "'") else "") + r.choice((" ", ".", ", ", "\n")) + " ".join(word() for _ in range(r.randint(0, 6)))
    return head + value + tail, [(kind, len(head), len(head) + len(value))] if true else []


@dataclass(frozen=True)
class Model:
    trees: Boosted
    slope: float
    offset: float
    thresholds: dict[str, float]

    def probability(self, x):
        import numpy as np

        return 1 / (1 + np.exp(-(self.slope * self.trees.score(x) + self.offset)))

    def judged(self, texts: list[str]) -> list[list[tuple[Span, float]]]:
        """Every candidate of each text with its probability."""
        import numpy as np

        found = [candidates(t) for t in texts]
        rows = [features(t, c) for t, cs in zip(texts, found, strict=True) for c in cs]
        p = iter(self.probability(np.array(rows)).tolist() if rows else ())
        return [[(c, next(p)) for c in cs] for cs in found]

    def added(self, texts: list[str], base: list[list[Span]]) -> list[list[tuple[Span, float]]]:
        """For each text, the selected spans that overlap neither base spans nor likelier ones."""
        out = []
        for cs, fixed in zip(self.judged(texts), base, strict=True):
            taken, chosen = _Taken((s, e) for _, s, e in fixed), []
            for c, p in sorted(cs, key=_worth):
                if p >= self.thresholds[c[0]] and taken.add(c[1], c[2]):
                    chosen.append((c, p))
            out.append(sorted(chosen, key=lambda x: (KINDS.index(x[0][0]), x[0][1])))
        return out


def _worth(judged: tuple[Span, float]):
    """Likelier spans first, by hundredths; then longer ones, earlier ones, and by kind."""
    (kind, start, end), p = judged
    return -round(p, 2), start - end, start, kind


class _Taken:
    """Disjoint intervals in order; intervals that overlap at the outset are merged."""

    def __init__(self, spans):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def add(self, start: int, end: int) -> bool:
        """Takes the interval if it overlaps none."""
        at = bisect.bisect_left(self.starts, end)
        if at and self.ends[at - 1] > start:
            return False
        self.starts.insert(at, start)
        self.ends.insert(at, end)
        return True


def _scale(score, truth) -> tuple[float, float]:
    """Slope and offset of the logistic fit of the truth to the trees' scores (Newton's method)."""
    import numpy as np

    x, w = np.stack([score, np.ones(len(score))], axis=1), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (truth - p))
        w = w + step
        if abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def threshold(p, truth, precision: float = PRECISION, odds: float = ODDS) -> float:
    """The least probability from which on selected spans are as precise as asked; 2 if there is none.

    A false candidate counts ``odds`` times.
    """
    import numpy as np

    order = np.argsort(-p, kind="stable")
    right = np.cumsum(truth[order])
    precise = right >= precision * (right + odds * np.cumsum(1 - truth[order]))
    last = np.append(p[order][1:] != p[order][:-1], True)  # equal probabilities are selected together
    good = np.flatnonzero(precise & last)
    return float(p[order][good[-1]]) if len(good) else 2.0


def examples(n: int, seed: int):
    """Features, truth and number of the example of each candidate in ``n`` made examples."""
    import numpy as np

    r = random.Random(seed)
    x, y, number = [], [], []
    for i in range(n):
        text, true = _example(r)
        for c in candidates(text):
            x.append(features(text, c))
            y.append(float(c in true))
            number.append(i)
    return np.array(x), np.array(y), np.array(number)


@functools.lru_cache(maxsize=1)
def model(n: int = EXAMPLES, seed: int = SEED) -> Model:
    """Trees fitted on half of the examples, probabilities and thresholds set on the other half."""
    x, y, number = examples(n, seed)
    fit = number % 2 == 0
    trees = Boosted().fit(x[fit], y[fit])
    score, truth, kinds = trees.score(x[~fit]), y[~fit], x[~fit, 0]
    slope, offset = _scale(score, truth)
    m = Model(trees, slope, offset, {})
    p = m.probability(x[~fit])
    m.thresholds.update({k: threshold(p[kinds == KINDS.index(k)], truth[kinds == KINDS.index(k)]) for k in ADDED})
    return m


def quality(m: Model, n: int = 4000, seed: int = 999) -> dict[str, tuple[float, float, int]]:
    """Precision, recall and number of true spans by kind, over fresh examples; selection included."""
    r = random.Random(seed)
    made = [_example(r) for _ in range(n)]
    said, true, hit = Counter(), Counter(), Counter()
    for (_, spans), got in zip(made, m.added([t for t, _ in made], [base_spans(t) for t, _ in made]), strict=True):
        said.update(s[0] for s, _ in got)
        true.update(s[0] for s in spans)
        hit.update(s[0] for s, _ in got if s in spans)
    return {k: (hit[k] / max(1, said[k]), hit[k] / max(1, true[k]), true[k]) for k in ADDED}


def find(texts: list[str | None], m: Model) -> list[tuple[list[Span], list[tuple[Span, float]]]]:
    """Base spans and added spans (with their probability) of each text; null counts as empty."""
    values = [t or "" for t in texts]
    base = [base_spans(t) for t in values]
    return list(zip(base, m.added(values, base), strict=True))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with counts of the base kinds, base_sha256, spans and n_added; every row is kept,
    and every column but those of these names, which are replaced.

    Null texts count as empty. Offsets are code points, ends exclusive; spans are in the order of
    KINDS, then of starts. Base spans of different kinds may overlap; added ones overlap nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model())

    def start():
        def work(texts):
            rows = []
            for base, added in find(texts, shared.value):
                counts = Counter(k for k, _, _ in base)
                rows.append([*(counts[k] for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + [s for s, _ in added]), len(added)])
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(7)]

        return work

    fields = [*(T.StructField(f"n_{k}", T.LongType()) for k in BASE), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())]
    return map_rows(docs, [text], fields, start)


def redact_text(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping spans become one."""
    out, end = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= end:
            out += [text[end:s], f"[{kind.upper()}]"]
        end = max(end, e)
    return "".join(out) + text[end:]


def redact(docs: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; null texts stay null, all columns kept.

    ``length`` names a column that holds the text's length in code points, if any, to keep true.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model())

    def start():
        def work(texts):
            return [[None if t is None else redact_text(t, base + [s for s, _ in added]) for t, (base, added) in zip(texts, find(texts, shared.value), strict=True)]]

        return work

    order = docs.columns
    out = map_rows(docs, [text], [T.StructField(text, T.StringType())], start).select(*order)
    return out.withColumn(length, F.length(text).cast(docs.schema[length].dataType)) if length else out
