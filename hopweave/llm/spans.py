"""Linear-time span finders shared by the PII and secret operators.

Every finder gives the leftmost non-overlapping matches of its pattern, written
so that no text, however long or repetitive, makes it rescan a run of
characters from each of its positions.
"""

from __future__ import annotations

import hashlib
import re

Span = tuple[str, int, int]

# The character classes of the base patterns.
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[Span]:
    """From each @ back over the local part (not into the match before), then the domain."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        if at >= free:
            begin = at
            while begin > free and text[begin - 1] in EMAIL_LOCAL:
                begin -= 1
            if begin < at and (m := _DOMAIN.match(text, at + 1)):
                free = m.end()
                out.append(("email", begin, free))
        at = text.find("@", at + 1)
    return out


def ips(text: str) -> list[Span]:
    return [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    return out


def phones(text: str) -> list[Span]:
    return [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
