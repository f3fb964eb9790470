"""Personal data in texts: fixed base patterns, and candidates selected by boosted trees.

Base spans (email, ip, card, phone) follow exact patterns and always stay.  High-recall
generators propose further, overlapping spans: spelled-out and bracketed addresses, unusual separators, national phone numbers, long bare
numbers and bank accounts (kind ``account``), keys, tokens and passwords (kind ``secret``).  Gradient-boosted trees score each by its
format and context, and those that reach their kind's calibrated threshold are added, best first, where they overlap no
chosen span.  The trees are trained here on generated prose with a fixed seed.  The thresholds are set on text that another
process makes (records: assignments, log lines, rows, notes), so that ``PRECISION`` of what passes there is right; :func:`quality`
measures both on a third part.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm._arrow import bounded, byte_texts

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "account", "secret")
PRECISION = 0.98

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can start at the start of a run of digits only: saying so keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of ``_EMAIL`` from the left, found from their ``@`` signs: each character is looked at a bounded number of times."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _EMAIL.match(text, start)):
            out.append(m.span())
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans by kind as listed, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


_GENERATORS = [
    ("email", re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?[\[({<] ?(?:at|AT|@) ?[\])}>] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[({<] ?(?:dot|DOT|\.) ?[\])}>]| dot ) ?[A-Za-z0-9-]{2,63}){1,4}")),
    ("email", re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} (?:at|AT) [A-Za-z0-9-]{1,63}(?: (?:dot|DOT) [A-Za-z0-9-]{2,63}){1,4}")),
    ("ip", re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?: ?[\[({] ?\. ?[\])}] ?| \. )[0-9]{1,3}){3}(?![0-9])")),
    ("ip", re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")),
    ("card", re.compile(r"(?<![0-9])[0-9](?:[ ._/ -]{0,2}[0-9]){12,18}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+(])(?:1[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])00[1-9][0-9]{0,2}(?:[ ().-]{1,2}[0-9]{2,4}){2,5}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])0[1-9][0-9]{0,2}(?:[ -][0-9]{2,4}){2,4}(?![0-9])")),
    ("account", re.compile(r"(?<![0-9A-Za-z.+-])[0-9]{12,19}(?![0-9A-Za-z]|[.,-][0-9])")),
    ("account", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")),
    ("account", re.compile(r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|[.-][0-9])")),
    ("secret", re.compile(r"(?<![A-Za-z0-9_./+-])eyJ[A-Za-z0-9_-]{8,4096}\.[A-Za-z0-9_-]{8,4096}\.[A-Za-z0-9_-]{0,4096}")),
    ("secret", re.compile(r"(?<![A-Za-z0-9_./+-])(?=[A-Za-z_+/-]*[0-9])[A-Za-z0-9_+/-]{16,128}={0,2}(?![A-Za-z0-9_+/-])")),
    ("secret", re.compile(r"(?i)(?<![a-z])(?:passw(?:or)?d|pwd|secret|token|key)[\"']? ?[:=] ?[\"']?([^\s\"',;]{6,128})")),
]
_ASSIGNS, _TOKEN = _GENERATORS[-1][1], _GENERATORS[-3][1]
_SPELLED = re.compile(r"[\[({<] ?(?:at|AT|@) ?[\])}>]| (?:dot|DOT) ")
_SAYS = [re.compile(p, re.I) for p in (r"mail|contact|write|reach", r"\bip\b|host|server|addr|client|login", r"card|visa|master|amex|pay|credit|debit", r"phone|tel|call|mobile|cell|fax|dial|sms")]
_SAYS += [re.compile(p, re.I) for p in (r"acc(?:oun)?t|konto|iban|cuenta|compte|bank|ssn|social", r"token|secret|passw|pwd|key|credential|auth|bearer")]
_OTHER = re.compile(r"order|version|isbn|invoice|serial|ticket|\bid\b|sku|part no|build|ref|total|date|page|chapter|tracking|commit|sha|md5|etag|digest|revision|time|file", re.I)
_ASSIGNED = re.compile(r"[:=] ?[\"']?$")
_KNOWN = re.compile(r"AKIA|ASIA|gh[pos]_|sk-|xox[bp]-|eyJ")
_SWITCH = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])")


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Proposed spans, which may overlap.

    A generator is left out where its own pattern can't match: addresses without a spelled sign, web tokens without their head, assigned secrets
    without a colon or an equals sign, and all others without a digit.
    """
    needs = {"email": bool(_SPELLED.search(text)), _ASSIGNS: ":" in text or "=" in text, _TOKEN: "eyJ" in text}
    digit = bool(_DIGIT.search(text))
    out = []
    for kind, pattern in _GENERATORS:
        if needs.get(pattern, needs.get(kind, digit)):
            out += [(kind, *m.span(m.lastindex or 0)) for m in pattern.finditer(text)]
    return out


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a span."""
    span, before, after = text[start:end], text[max(0, start - 32) : start], text[end : end + 16]
    digits = re.sub(r"[^0-9]", "", span)
    groups = re.findall(r"[0-9]+", span)
    marks = re.findall(r"[^0-9A-Za-z]+", span)
    last = re.split(r"[^A-Za-z]+", span)[-1].lower()
    return [
        ALL_KINDS.index(kind),
        len(span),
        len(digits),
        len(groups),
        max(map(len, groups), default=0) - min(map(len, groups), default=0),
        len(set(digits)),
        len({m.strip() for m in marks}),
        luhn(digits) if digits else 0,
        int(digits[:1] or 0),
        max((int(g) if len(g) < 6 else 99999 for g in groups), default=0) <= 255,
        span[:1] == "(" or "(" in span,
        ":" in span,
        "[" in span or "{" in span,
        2 <= len(last) <= 4,
        bool(before[-1:].strip()) and before[-1:] not in ":;,(\"'",
        bool(re.match(r"[0-9A-Za-z]|[.\-/][0-9]", after)),
        *(bool(p.search(before)) for p in _SAYS),
        bool(_OTHER.search(before)),
        len(digits) / len(span),
        sum(c.isupper() for c in span) / len(span),
        len(set(span)) / min(len(span), 64),
        len(_SWITCH.findall(span)) / len(span),
        bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", span)),
        bool(_ASSIGNED.search(before)),
        bool(_KNOWN.match(span)),
        "_" in span or "-" in span or "/" in span,
    ]


@dataclass
class Trees:
    """Boosted trees of depth 3 over the features: per tree 7 splits (feature, cut) and 8 leaves."""

    bias: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    threshold: dict[str, float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(3):
                at = 2 * at + 1 + (x[np.arange(len(x)), f[at]] > c[at])
            total += v[at - 7]
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.3) -> Trees:
    """Newton boosting of the logistic loss."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 18)[:-1])) for j in range(x.shape[1])]
    bias = float(np.log(y.mean() / (1 - y.mean())))
    total = np.full(len(y), bias)
    features_, cuts_, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p) + 1e-9
        f, c, leaf = np.zeros(7, np.int64), np.full(7, np.inf), np.zeros(8)
        rows = {0: np.arange(len(y))}
        for node in range(7):
            mine = rows[node]
            gs, hs = g[mine], h[mine]
            best, whole = 1e-6, gs.sum() ** 2 / (hs.sum() + 1)
            for j, some in enumerate(cuts):
                above = x[mine, j][:, None] > some
                ga, ha = gs @ above, hs @ above
                gain = ga**2 / (ha + 1) + (gs.sum() - ga) ** 2 / (hs.sum() - ha + 1) - whole
                if len(gain) and gain.max() > best:
                    best, f[node], c[node] = gain.max(), j, some[gain.argmax()]
            up = x[mine, f[node]] > c[node]
            rows[2 * node + 1], rows[2 * node + 2] = mine[~up], mine[up]
        for i in range(8):
            mine = rows[7 + i]
            leaf[i] = rate * g[mine].sum() / (h[mine].sum() + 1)
            total[mine] += leaf[i]
        features_.append(f)
        cuts_.append(c)
        leaves.append(leaf)
    return Trees(bias, np.array(features_), np.array(cuts_), np.array(leaves), {})


_SYLLABLES = ("er an th on re la de en st ou", "ung heit ge be ver ein schl tz au pf", "ement tion aux eau ou ê re ai qu", "ción los mente ado ll es la en yo")
_LEADS = {
    "email": "mail contact write reach", "ip": "ip host server login", "card": "card visa credit paid", "phone": "call phone tel mobile fax",
    "account": "account konto iban cuenta compte", "secret": "token secret password key auth",
}
_OTHERS = "order version isbn invoice serial ticket ref tracking total build"
_DIGESTS = "commit sha256 md5 etag digest revision file"


class _Maker:
    """Makes spans of each kind that are personal data or secrets, and such that only look like them."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def digits(self, k: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(k))

    def word(self) -> str:
        parts = self.r.choice(_SYLLABLES).split()
        return "".join(self.r.choice(parts) for _ in range(self.r.randint(1, 4)))

    def of(self, alphabet: str, k: int) -> str:
        out = "".join(self.r.choice(alphabet) for _ in range(k - 1))
        return out + self.r.choice("23456789")

    def email(self, good: bool) -> str:
        r = self.r
        at, dot = r.choice([("[at]", "[dot]"), (" (at) ", " (dot) "), (" at ", " dot "), ("(at)", "."), (" [AT] ", "."), ("{at}", "{dot}")])
        end = r.choice(["com", "net", "org", "de", "fr", "io"]) if good else r.choice(["production", "thingly", "eaereding"])
        return f"{self.word()}.{self.digits(2)}{at}{self.word()}{dot}{end}" if r.random() < 0.7 else f"{self.word()}{at}{self.word()}{dot}{end}"

    def ip(self, good: bool) -> str:
        r = self.r
        if r.random() < 0.3:
            return ":".join(f"{r.randint(4096, 65535):x}" for _ in range(8)) if good else ":".join(self.digits(2) for _ in range(8))
        parts = [r.randint(1, 255) for _ in range(4)]
        if not good:
            parts[r.randint(0, 3)] = r.randint(256, 999)
        return r.choice(["[.]", "(.)", " . ", " [.] "]).join(map(str, parts))

    def card(self, good: bool) -> str:
        r = self.r
        head = r.choice("3456") + self.digits(14)
        last = next(d for d in "0123456789" if luhn(head + d))
        d = head + (last if good else str((int(last) + r.randint(1, 9)) % 10))
        return r.choice([".", "_", "/", "  ", " - ", " "])[:2].join(d[i : i + 4] for i in range(0, 16, 4))

    def phone(self, good: bool) -> str:
        r, num = self.r, self.digits
        if good:
            s = r.choice([" ", "-", "."])
            return r.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{r.randint(200, 989)}{s}{num(3)}{s}{num(4)}", f"00{r.randint(1, 99)} {num(3)} {num(3)} {num(3)}", f"0{r.randint(1, 99)} {num(3)} {num(4)}", f"0{r.randint(1, 9)}-{num(3)}-{num(4)}"])
        return r.choice([f"{num(3)}.{num(3)}.{num(4)}", f"0{r.randint(1, 9)} {num(2)} {num(4)}", f"{num(3)} {num(3)} {num(4)}"])

    def account(self, good: bool) -> str:
        r, num = self.r, self.digits
        if good:
            iban = r.choice(["DE", "FR", "ES", "GB"]) + num(2) + "".join(f" {num(4)}" for _ in range(r.randint(4, 6)))
            return r.choice([num(r.choice((12, 14, 16, 16, 16, 18))), iban, iban.replace(" ", ""), f"{r.randint(100, 899)}-{num(2)}-{num(4)}"])
        return r.choice([r.choice("0123456789") * 16, "978" + num(10), f"17{num(11)}", f"2024{num(10)}", num(r.choice((12, 14, 16))), f"AB{num(2)} PAGE {num(4)} LINE", f"{num(3)}-{num(2)}-{num(4)}"])

    def secret(self, good: bool) -> str:
        r = self.r
        hexa, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
        mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
        long = self.of(hexa, r.choice((32, 40, 64)))
        if good:
            some = [long, long.upper(), self.of(mixed, r.randint(20, 44)), "AKIA" + self.of(upper, 16), "AKIA" + self.of(upper, 16), "ghp_" + self.of(mixed, 36), "sk-" + self.of(mixed, 32), self.of(mixed + "!$%_", r.randint(9, 14))]
            return r.choice(some)
        name = "_".join(self.word() for _ in range(3)) + f"_{self.digits(8)}"
        return r.choice([long, f"{self.word().upper()}{self.word().upper()}{self.word().upper()}2024", name, f"{self.word()}-{self.digits(4)}-{self.word()}-{self.digits(4)}", self.digits(20), "required", self.word() + self.word(), f"<{self.word()}{self.word()}>"])


def _prose(m: _Maker, kind: str, good: bool) -> tuple[str, str, str]:
    """(before, span, after) in running text of several languages, as clean as documents are, shouted, or full of signs."""
    r = m.r
    span = getattr(m, kind)(good)
    lead, glue = m.word(), " "
    if kind == "secret":
        if good:
            bare = span.startswith(("AKIA", "ghp_", "sk-")) and r.random() < 0.6
            lead, glue = (m.word(), " ") if bare else (r.choice(_LEADS[kind].split()), r.choice([" = \"", ": ", "=", " = ", " \""]))
        elif r.random() < 0.7:
            lead, glue = r.choice([r.choice(_DIGESTS.split()), m.word()]), r.choice([" ", ": ", "/", " "])
        else:  # an assignment of nothing secret
            span, lead, glue = r.choice(["required", m.word() + m.word() + "ing", m.word() + m.word() + "tion"]), r.choice(_LEADS[kind].split()), r.choice([": ", " = "])
    elif good:
        lead = r.choice(_LEADS[kind].split()) if r.random() < 0.5 else lead
    else:
        lead = r.choice(_OTHERS.split()) if r.random() < 0.6 or kind in ("phone", "account") else lead
        glue = r.choice([" ", " ", " ", "#", "/"])
    sign = r.choice(["", "", "", "!!", "###", "***"])
    before = "".join(f"{m.word()}{sign} " for _ in range(r.randint(2, 5))) + f"{lead}{glue}"
    after = ('"' if glue.endswith('"') else "") + sign + r.choice([" ", ". ", ", "]) + m.word() + " " + m.word()
    return (before.upper(), span.upper() if kind == "secret" else span, after.upper()) if sign == "!!" and kind in ("secret", "account", "phone") else (before, span, after)


def _records(m: _Maker, kind: str, good: bool) -> tuple[str, str, str]:
    """(before, span, after) in what programs and people note down: assignments, log lines, rows, signatures."""
    r = m.r
    span = getattr(m, kind)(good)
    field = r.choice((_LEADS[kind] if good else _DIGESTS if kind == "secret" else _OTHERS).split())
    if kind == "secret" and not good and r.random() < 0.4:
        field, span = r.choice(_LEADS[kind].split()), r.choice([m.word() + m.word() + "able", "unset!", "(hidden)"])
    stamp = f"2024-0{r.randint(1, 9)}-{r.randint(10, 28)}"
    forms = [
        (f'{{"name": "{m.word()}", "{field}": "', '", "kind": 1}'), (f"{stamp} INFO {m.word()} {field}=", f" {m.word()}=ok"), (f"{m.word()}, {m.word()}\n{field}: ", f"\n{m.word()}"),
        (f"{m.word()};{field};", f";{m.word()}"), (f"# {m.word()}\n{field} = ", "\n"), (f"- {m.word()} {field} ", f" ({m.word()})"),
    ]
    before, after = r.choice(forms)
    return before, span, after


def _examples(n: int, seed: int, make=_prose) -> Iterator[tuple[str, str, int, int, int]]:
    """(text, kind, start, end, label): what the generators propose for a made span, and what else they propose in the same text."""
    m = _Maker(seed)
    for i in range(n):
        kind, good = ALL_KINDS[i % len(ALL_KINDS)], m.r.random() < 0.5
        before, span, after = make(m, kind, good)
        text = before + span + after
        a, b = len(before), len(before) + len(span)
        for got, x, y in candidates(text):
            same = x <= a + 3 and y >= b - 3
            if same and got == kind or not same:  # the same span under another kind may be either
                yield text, got, x, y, int(good and same)


@cache
def trained(n: int = 12_000, seed: int = 11) -> Trees:
    """The trees, trained on generated prose; each kind's threshold is the lowest that ``PRECISION`` of what passes in generated records allows."""
    rows = list(_examples(n, seed))
    trees = boost(np.array([features(t, k, a, b) for t, k, a, b, _ in rows], float), np.array([label for *_, label in rows], float))
    kinds, score, y = _scored(trees, n // 2, seed + 1)
    for i, kind in enumerate(ALL_KINDS):
        mine = kinds == i
        order = np.argsort(-score[mine], kind="stable")
        right = np.cumsum(y[mine][order]) / np.arange(1, mine.sum() + 1)
        fine = np.flatnonzero(right >= PRECISION)
        trees.threshold[kind] = float(score[mine][order][fine[-1]]) if len(fine) else 1.1
    return trees


def _scored(trees: Trees, n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = list(_examples(n, seed, _records))
    x = np.array([features(t, k, a, b) for t, k, a, b, _ in rows], float)
    return x[:, 0].astype(int), trees.scores(x), np.array([label for *_, label in rows], float)


def quality(trees: Trees, n: int = 6_000, seed: int = 99) -> dict[str, tuple[float, float]]:
    """(precision, recall) of each kind's candidates in records that neither training nor calibration saw."""
    kinds, score, y = _scored(trees, n, seed)
    out = {}
    for i, kind in enumerate(ALL_KINDS):
        taken, right = score[kinds == i] >= trees.threshold[kind], y[kinds == i] > 0
        out[kind] = float((taken & right).sum() / max(1, taken.sum())), float((taken & right).sum() / max(1, right.sum()))
    return out


def find(text: str, trees: Trees) -> list[tuple[str, int, int, bool, float]]:
    """All spans ``(kind, start, end, base, score)`` by kind as listed, then start; base spans score 1."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    longest = max((b - a for a, b in taken), default=0)
    out = [(*s, True, 1.0) for s in base]
    proposed = [c for c in candidates(text) if _free(taken, c[1], c[2], longest)]
    if proposed:
        score = trees.scores(np.array([features(text, *c) for c in proposed], float))
        passed = [i for i in np.argsort(-score, kind="stable") if score[i] >= trees.threshold[proposed[i][0]]]
        whole = _outermost([proposed[i][1:] for i in passed])
        for i in passed:
            kind, a, b = proposed[i]
            if (a, b) in whole and _free(taken, a, b, longest):
                taken.insert(bisect_left(taken, (a, b)), (a, b))
                longest = max(longest, b - a)
                out.append((kind, a, b, False, float(score[i])))
    return sorted(out, key=lambda s: (ALL_KINDS.index(s[0]), s[1], s[2]))


def _outermost(spans: list[tuple[int, int]]) -> set[tuple[int, int]]:
    """Spans that no other one covers: a part of an account isn't taken for a phone where the whole account passed."""
    out, end = set(), -1
    for a, b in sorted(set(spans), key=lambda s: (s[0], -s[1])):
        if b > end:
            out.add((a, b))
            end = b
    return out


def _free(taken: list[tuple[int, int]], a: int, b: int, longest: int) -> bool:
    """Whether no taken span overlaps; ``longest`` of them tells how far before ``a`` one may begin."""
    i = bisect_left(taken, (b, -1))
    while i and taken[i - 1][0] > a - longest - 1:
        i -= 1
        if taken[i][1] > a:
            return False
    return True


def detect(docs: DataFrame, text: str = "text", keep: list[str] | None = None, redacted: str | None = None) -> DataFrame:
    """``docs``' columns ``keep`` (all by default) with ``spans``, and with the redacted text if ``redacted`` names a column for it.

    ``spans`` are ``struct<kind, start, end, base, score>`` in code points, end exclusive, by kind as
    listed, then start: first the base kinds, then ``account`` and ``secret``.  A null text counts as empty; an empty table gives no rows;
    repeated rows are searched each; of candidates that pass, one that covers another wins, then the higher score, then the first proposed; columns of the added names are replaced.
    """
    added = ["spans"] + [redacted] * bool(redacted)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    shipped = docs.sparkSession.sparkContext.broadcast(trained())
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shipped.value
        for batch in batches:
            spans, texts = [], []
            for raw in byte_texts(batch.column(batch.num_columns - 1)):
                text = raw.decode()
                found = find(text, trees)
                spans.append([dict(zip(("kind", "start", "end", "base", "score"), s)) for s in found])
                if redacted:
                    texts.append(redact(text, found))
            new = [pa.array(spans, pa.list_(span))] + [pa.array(texts, pa.string())] * bool(redacted)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[*keep, *added])

    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType()), T.StructField("score", T.DoubleType())]))
    schema = T.StructType([*docs.select(*keep).schema, T.StructField("spans", kind), *(T.StructField(c, T.StringType()) for c in added[1:])])
    return bounded(docs).select(*keep, F.col(text).alias("__leafmill_text")).mapInArrow(run, schema)


def redact(text: str, spans: list) -> str:
    """``text`` with each span (where they overlap, their union) as its kind in brackets, such as ``[EMAIL]``."""
    out, last = [], 0
    for kind, a, b, *_ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"[{kind.upper()}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])
