"""Personal data by base patterns and a linear-chain CRF over word shapes (operator 1).

Base patterns give e-mails, IPs, cards and phone numbers. The CRF adds what no
fixed pattern holds: person names (after a title or where one is introduced),
national ids, IBANs, and numbers and mail addresses written in other ways. It is
trained from a small labelled table that `labelled_table` writes out from
sentence frames, on word shapes alone (the words of FIXED CUES are shapes of
their own), by full-batch gradient steps on the likelihood (forward-backward).

Every token of every text is decoded: texts are cut into tokens and shapes in
numpy, put one after another with padding between them, and the row is decoded
by Viterbi in pieces of PIECE tokens that overlap by CONTEXT on either side, all
pieces of a batch at once. A label is the CRF's alone; only checksums (of IBANs
and cards) can take a span away again.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans as sp
from . import textkit
from .runtime import mapped, table

BASE = ("email", "ip", "card", "phone")
ADDED = ("name", "natid", "iban")
KINDS = BASE + ADDED
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Tokens of a piece, and their overlap.
PIECE, CONTEXT = 224, 16
STEPS, RATE, RIDGE, SENTENCES = 100, 0.2, 1e-3, 900

# FIXED CUES: titles before a name, words that introduce a name, words between them, words before a number or an id, and how @ and . are spoken.
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Rev", "Sir", "Herr", "Frau", "Señor", "Señora", "Madame", "Monsieur")
NAMED = ("name", "named", "called", "signed", "regards", "sincerely", "dear", "heiße", "appelle", "llamo")
LINKS = ("is", "am", "ist", "est", "es")
PHONES = ("phone", "tel", "telephone", "mobile", "cell", "call", "telefon", "teléfono", "téléphone", "fax")
CUES = {"title": TITLES, "named": NAMED, "link": LINKS, "phone": PHONES, "ssn": ("ssn",), "iban": ("iban",), "at": ("at",), "dot": ("dot",)}

_SYMBOLS = "@.-+()/:,_[]'"
_SHAPES: tuple[str, ...] = ("pad", "x", "Xx", "X", "XX", "xX", "again", "other", *(f"d{k}" for k in range(1, 13)), *(f"0d{k}" for k in range(2, 6)), *_SYMBOLS, *(f"cue:{c}" for c in CUES))
_CODE = {s: i for i, s in enumerate(_SHAPES)}
_OFFSETS = (-2, -1, 0, 1, 2)
_SPACE, _LOWER, _UPPER, _DIGIT, _OTHER = range(5)


@cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class and symbol shape of each character of the basic plane."""
    kind, symbol = np.full(1 << 16, _OTHER, dtype=np.uint8), np.full(1 << 16, _CODE["other"], dtype=np.uint8)
    for i, c in enumerate(map(chr, range(1 << 16))):
        if c.isspace():
            kind[i] = _SPACE
        elif c.isalpha():
            kind[i] = _UPPER if c.isupper() or c.istitle() else _LOWER
    kind[48:58] = _DIGIT
    for c in _SYMBOLS:
        symbol[ord(c)] = _CODE[c]
    return kind, symbol


def _hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run of characters."""
    u = textkit.U64
    code = textkit.mix(points.astype(u) + u(1))
    total = np.zeros(len(points) + 1, dtype=u)
    np.cumsum(code * textkit._power(textkit._BASE, len(points), "up"), out=total[1:])
    return textkit.mix((total[ends] - total[starts]) * textkit._power(textkit._INVERSE, max(1, len(points)), "down")[starts])


@cache
def _cues() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the cue words in lower, title and upper case (titles as they are), sorted, and their shapes."""
    out: dict[int, int] = {}
    for shape, words in CUES.items():
        for w in words:
            for form in (w,) if shape == "title" else (w, w.capitalize(), w.upper()):
                points = np.array([ord(c) for c in form])
                out[int(_hashes(points, np.array([0]), np.array([len(form)]))[0])] = _CODE[f"cue:{shape}"]
    names = np.array(sorted(out), dtype=textkit.U64)
    return names, np.array([out[int(n)] for n in names], dtype=np.uint8)


def tokens(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and shapes of a text's tokens: runs of letters, runs of digits 0-9, and every other character but white space alone.

    A word that one of the two words before it is already has the shape "again", as no entity stammers.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds, symbols = _classes()
    low = np.minimum(points, 0xFFFF)
    kind = kinds[low]
    for i in np.flatnonzero(points > 0xFFFF).tolist():
        c = chr(points[i])
        kind[i] = (_UPPER if c.isupper() else _LOWER) if c.isalpha() else _OTHER
    run = np.where(kind == _UPPER, _LOWER, kind)
    first = np.ones(len(points), dtype=bool)
    first[1:] = (run[1:] != run[:-1]) | (run[1:] == _OTHER)
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], len(points))
    real = run[begin] != _SPACE
    begin, end = begin[real], end[real]
    what, size = run[begin], end - begin
    upper = np.concatenate(([0], np.cumsum(kind == _UPPER)))
    upper = upper[end] - upper[begin]
    leads = kind[begin] == _UPPER if len(begin) else np.zeros(0, dtype=bool)
    shape = symbols[low[begin]].copy()
    letters, digits = what == _LOWER, what == _DIGIT
    case = np.where(upper == 0, _CODE["x"], np.where(upper == size, np.where(size == 1, _CODE["X"], _CODE["XX"]), np.where(leads & (upper == 1), _CODE["Xx"], _CODE["xX"])))
    shape[letters] = case[letters]
    shape[digits] = (_CODE["d1"] - 1 + np.minimum(size, 12))[digits]
    zero = digits & (size >= 2) & (size <= 5) & (points[begin] == 48)
    shape[zero] = (_CODE["0d2"] - 2 + size)[zero]
    at = np.flatnonzero(letters)
    if len(at):
        names, codes = _cues()
        h = _hashes(points, begin[at], end[at])
        k = np.minimum(np.searchsorted(names, h), len(names) - 1)
        hit = names[k] == h
        shape[at[hit]] = codes[k[hit]]
        for back in (1, 2):  # the word before, or the one before that, once more
            same = h[back:] == h[:-back]
            shape[at[back:][same & (at[back:] - at[:-back] <= 2 * back)]] = _CODE["again"]
    return begin, end, shape


def shapes(words: list[str]) -> np.ndarray:
    """The shapes of tokens that stand side by side."""
    return tokens(" ".join(words))[2].astype(np.int64)


@dataclass
class Crf:
    """Weights of shapes at each offset, of neighbouring shapes, and of label pairs."""

    unary: np.ndarray  # (offsets, shapes, labels)
    left: np.ndarray  # (shapes, shapes, labels): the shape before and this
    right: np.ndarray  # (shapes, shapes, labels): this and the shape after
    move: np.ndarray  # (labels, labels)

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        """(batch, time) shapes, 0 where padded -> (batch, time, labels)."""
        wide = np.pad(codes, ((0, 0), (2, 2)))
        t = codes.shape[1]
        out = self.left[wide[:, 1 : 1 + t], codes] + self.right[codes, wide[:, 3 : 3 + t]]
        for k, o in enumerate(_OFFSETS):
            out = out + self.unary[k, wide[:, 2 + o : 2 + o + t]]
        return out

    def viterbi(self, codes: np.ndarray) -> np.ndarray:
        """The best labels of each row."""
        e = np.ascontiguousarray(self.emissions(codes).transpose(1, 2, 0).astype(np.float32))  # time, label, row
        t, y, n = e.shape
        move = self.move.astype(np.float32)
        # an I follows its own B or I alone; every other label may follow any
        free = [j for j, name in enumerate(LABELS) if name[0] != "I"]
        own = [j for j, name in enumerate(LABELS) if name[0] == "I"]
        into = np.ascontiguousarray(move[:, free].T)[:, :, None]
        from_b, from_i = np.array([move[j - 1, j] for j in own])[:, None], np.array([move[j, j] for j in own])[:, None]
        back = np.zeros((t, y, n), dtype=np.int8)
        score = e[0].copy()
        new = np.empty_like(score)
        numbers = np.array(own, dtype=np.int8)[:, None]
        for i in range(1, t):
            every = score[None] + into
            best = every.argmax(axis=1)
            back[i, free] = best
            new[free] = np.take_along_axis(every, best[:, None], axis=1)[:, 0]
            b, c = score[[j - 1 for j in own]] + from_b, score[own] + from_i
            back[i, own] = np.where(b > c, numbers - 1, numbers)
            new[own] = np.maximum(b, c)
            score = new + e[i]
        path = np.zeros((n, t), dtype=np.int8)
        now, rows = score.argmax(axis=0), np.arange(n)
        for i in range(t - 1, -1, -1):
            path[:, i] = now
            now = back[i, now, rows]
        return path


def _allowed() -> np.ndarray:
    """I-k follows B-k or I-k alone."""
    ok = np.zeros((len(LABELS), len(LABELS)))
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            for i, a in enumerate(LABELS):
                if a[1:] != b[1:]:
                    ok[i, j] = -50.0
    return ok


def labelled_table(n: int = SENTENCES, seed: int = 7) -> list[list[tuple[str, str]]]:
    """The small labelled table: rows of (token, label), written from frames of words and entities."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    number = lambda k: str(int(rng.integers(1, 10))) + digits(k - 1)
    letters = lambda k: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, k))
    cased = lambda w: pick([w, w, w.capitalize(), w.upper()])

    def word() -> str:
        if chance(0.12):
            return cased(pick([*NAMED, *LINKS, *LINKS, *PHONES, "at", "at", "at", "dot"]))
        w = letters(int(rng.integers(2, 9)))
        r = rng.random()
        w = w.capitalize() if r < 0.2 else w.upper() if r < 0.27 else pick(["I", "A", "X"]) if r < 0.3 else w
        return w + (pick([",", ".", ".", "!!", "***", "&&&", ":", "'s"]) if chance(0.2) else "")

    def person(least: int = 1) -> str:
        parts = [letters(int(rng.integers(3, 8))).capitalize() for _ in range(int(rng.integers(least, 4)))]
        if chance(0.25):
            parts[-1] += "-" + letters(5).capitalize()
        if chance(0.1):
            parts.insert(1, letters(1).upper() + ".")
            parts.append(letters(6).capitalize())
        return " ".join(parts)

    def entity(kind: str) -> list[tuple[str, str]]:
        """Texts and their kinds, '' for what stands around the entity."""
        if kind == "email":
            if chance(0.55):
                return [(f"{letters(5)}{pick(['.', '_', '', '-', '+'])}{pick([digits(2), letters(4)])}@{letters(4)}{pick(['', '1', '-' + letters(3)])}.{letters(7)}{pick(['', '.com', '.org'])}", kind)]
            user = letters(5) + pick(["", "." + letters(4), digits(2)])
            at, dot = pick([("[at]", "[dot]"), ("(at)", "(dot)"), ("[at]", "."), ("(at)", "."), ("at", "dot"), ("AT", "DOT")])
            return [(f"{user} {at} {letters(6)} {dot} {letters(3)}", kind)]
        if kind == "ip":
            return [(".".join(str(int(x)) for x in rng.integers(0, 256, 4)), kind)]
        if kind == "card":
            return [(pick([digits(16), " ".join(digits(4) for _ in range(4)), "-".join(digits(4) for _ in range(4)), f"{digits(4)} {digits(6)} {digits(5)}"]), kind)]
        if kind == "phone":
            if chance(0.3):
                return [(cased(pick(PHONES)) + pick(["", ":", "."]), ""), (pick([digits(3) + "-" + digits(4), digits(7), f"{digits(3)} {digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}"]), kind)]
            return [(pick([f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(4)} {digits(3)}", f"{number(3)}-{digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"0{digits(2)} {digits(4)} {digits(4)}", f"0{digits(3)} {digits(6)}", f"0{digits(4)} {digits(6)}", f"0{digits(3)}/{digits(6)}"]), kind)]
        if kind == "name":
            r = rng.random()
            if r < 0.45:
                return [(pick(TITLES) + pick(["", "."]) + " " + person(), kind)]
            if r < 0.7:
                return [(f"{pick(['my', 'the', 'his', 'her', ''])} {cased('name')} {pick(LINKS)}", ""), (person(2), kind)]
            if r < 0.78:
                return [(cased(pick(["name", "signed"])) + ":", ""), (person(2), kind)]
            return [(cased(pick(["regards", "sincerely"])) + ",", ""), (person(2), kind)] if chance(0.6) else [(pick(["dear", "Dear", "named", "called", "heiße", "appelle", "llamo"]), ""), (person(2), kind)]
        if kind == "natid":
            return [(pick(["ssn:", "SSN", "ssn"]), "")] * int(chance(0.5)) + [(f"{digits(3)}-{digits(2)}-{digits(4)}", kind)]
        code = letters(2).upper() + digits(2)
        form = pick([" ".join([code, *(digits(4) for _ in range(int(rng.integers(3, 6)))), digits(2)]), code + digits(18), f"{code} {letters(4).upper()} " + " ".join(digits(4) for _ in range(3)) + " " + digits(2), code + letters(4).upper() + digits(14)])
        return [(pick(["iban:", "IBAN", "iban"]), "")] * int(chance(0.4)) + [(form, kind)]

    def plain() -> str:
        """Words, numbers and shapes that are no personal data."""
        if chance(0.12):  # the same again and again
            w = pick([cased(letters(int(rng.integers(1, 8)))), cased(pick(["at", "dot", *LINKS])), digits(int(rng.integers(1, 6)))]) + pick(["", "", ".", ",", "-"])
            return " ".join([w + pick(["", "", " " + letters(4).capitalize()])] * int(rng.integers(3, 12)))
        if chance(0.08):  # a list of headings
            return " ".join(letters(int(rng.integers(2, 7))).capitalize() + pick(["", "", "."]) for _ in range(int(rng.integers(3, 9))))
        return pick([
            digits(1), digits(2), number(4), digits(7), f"{digits(1)}.{digits(2)}", f"{digits(2)}:{digits(2)}", f"{number(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}.{digits(2)}.{number(4)}", f"{digits(3)}-{digits(4)}", f"{letters(3)}{digits(3)}", f"v{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(2)}%", f"({digits(1)})",
            f"{letters(4).upper()}{digits(4)}", f"{letters(2).upper()}-{digits(4)}", f"{digits(5)}/{digits(2)}", digits(12), digits(9), f"{number(3)} {number(4)}", f"{number(2)} {number(3)} {number(3)}", f"{number(3)}.{digits(3)}.{digits(3)}", f"{letters(5).capitalize()} {letters(6).capitalize()}", f"{letters(5)}. {letters(5).capitalize()} {letters(4)}", f"the {cased('name')} of the {letters(5).capitalize()}", f"it {pick(LINKS)} {letters(6).capitalize()}",
            f"{pick(LINKS)} {letters(6).capitalize()} {letters(4).capitalize()}", f"{pick(NAMED)} {letters(5)}", f"at {letters(6).capitalize()}", f"at {digits(2)}:{digits(2)}", f"{pick(PHONES)} {letters(5)}", f"{letters(4)}@", f"@{letters(6)}", f"{letters(5)} at {letters(5)}", f"{pick(TITLES)} {letters(5)}", f"{cased(pick(NAMED))} {letters(5).capitalize()} {letters(5)}", f"[{digits(1)}]", f"({letters(5)})", f"{letters(5)}-{letters(4)}", f"{letters(5).capitalize()}-{letters(4).capitalize()}",
        ])

    def cut(text: str) -> list[str]:
        begin, end, _ = tokens(text)
        return [text[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]

    out = []
    for _ in range(n):
        row: list[tuple[str, str]] = []
        for _ in range(int(rng.integers(1, 5))):
            for _ in range(int(rng.integers(0, 6))):
                row += [(t, "O") for t in cut(word())]
            r = rng.random()
            if r < 0.5:
                for text, kind in entity(pick(KINDS)):
                    row += [(t, f"{'I' if k else 'B'}-{kind}" if kind else "O") for k, t in enumerate(cut(text))]
                if chance(0.5):
                    row.append((pick([",", ".", ")", ":"]), "O"))
            elif r < 0.9:
                row += [(t, "O") for t in cut(plain())]
        for _ in range(int(rng.integers(1, 4))):
            row += [(t, "O") for t in cut(word())]
        out.append(row)
    return out


@cache
def trained(n: int = SENTENCES, seed: int = 7) -> Crf:
    """Fit on the labelled table: the gradient of the log-likelihood by forward-backward, all rows at once."""
    rows = [[("", "O"), *r, ("", "O")] for r in labelled_table(n, seed)]  # between pads, as texts are when they are decoded
    t = max(map(len, rows))
    codes = np.zeros((len(rows), t), dtype=np.int64)
    gold = np.zeros((len(rows), t), dtype=np.int64)
    lengths = np.array([len(r) for r in rows])
    at = {x: i for i, x in enumerate(LABELS)}
    for i, r in enumerate(rows):
        codes[i, 1 : len(r) - 1] = shapes([x for x, _ in r[1:-1]])
        gold[i, : len(r)] = [at[y] for _, y in r]
    real = np.arange(t) < lengths[:, None]
    s, y = len(_SHAPES), len(LABELS)
    crf = Crf(np.zeros((5, s, y)), np.zeros((s, s, y)), np.zeros((s, s, y)), np.zeros((y, y)))
    fixed = _allowed()
    parts = [crf.unary, crf.left, crf.right, crf.move]
    m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    wide = np.pad(codes, ((0, 0), (2, 2)))
    onehot = np.eye(y)[gold]
    flat = real.ravel()

    def summed(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        index, values = index.ravel()[flat], values.reshape(-1, y)[flat]
        order = np.argsort(index, kind="stable")
        index, values = index[order], values[order]
        first = np.flatnonzero(np.concatenate(([True], index[1:] != index[:-1])))
        g = np.zeros((size, y))
        g[index[first]] = np.add.reduceat(values, first)
        return g

    for step in range(1, STEPS + 1):
        e = crf.emissions(codes)
        move = np.exp(crf.move + fixed)
        shifted = np.exp(e - e.max(axis=2, keepdims=True))
        alpha, beta = np.zeros_like(e), np.ones_like(e)
        alpha[:, 0] = shifted[:, 0] / shifted[:, 0].sum(axis=1, keepdims=True)
        for i in range(1, t):
            a = (alpha[:, i - 1] @ move) * shifted[:, i]
            a /= a.sum(axis=1, keepdims=True)
            alpha[:, i] = np.where(real[:, i, None], a, alpha[:, i - 1])
        pairs = np.zeros((y, y))
        for i in range(t - 2, -1, -1):
            inner = shifted[:, i + 1] * beta[:, i + 1]
            b = inner @ move.T
            both = alpha[:, i, :, None] * move * inner[:, None, :]
            both /= both.sum(axis=(1, 2), keepdims=True)
            pairs += (both * real[:, i + 1, None, None]).sum(axis=0)
            beta[:, i] = np.where(real[:, i + 1, None], b / b.sum(axis=1, keepdims=True), 1.0)
        post = alpha * beta
        post /= post.sum(axis=2, keepdims=True)
        diff = (post - onehot) * real[:, :, None]
        grads = [np.stack([summed(wide[:, 2 + o : 2 + o + t], diff, s) for o in _OFFSETS]), summed(wide[:, 1 : 1 + t] * s + codes, diff, s * s).reshape(s, s, y), summed(codes * s + wide[:, 3 : 3 + t], diff, s * s).reshape(s, s, y)]
        moved = np.zeros((y, y))
        np.add.at(moved, (gold[:, :-1][real[:, 1:]], gold[:, 1:][real[:, 1:]]), 1.0)
        grads.append(pairs - moved)
        for k, (p, g) in enumerate(zip(parts, grads, strict=True)):
            g = g / len(rows) + RIDGE * p
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    crf.move = crf.move + fixed
    for w in (crf.unary, crf.left, crf.right):
        w[...] = w.astype(np.float32)
    outside = np.where(np.arange(y) == 0, 0.0, -50.0)
    crf.unary[2, 0] += outside  # padding is outside
    return crf


def _iban(text: str) -> bool:
    x = re.sub(r"\s", "", text).upper()
    return x.isalnum() and x.isascii() and 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def _checks(kind: str, text: str) -> bool:
    """Whether the checksum of a kind that has one is right."""
    if kind == "iban":
        return _iban(text)
    digits = "".join(c for c in text if "0" <= c <= "9")
    return kind != "card" or (13 <= len(digits) <= 19 and sp.luhn(digits))


def added(texts: list[str], crf: Crf) -> list[list[sp.Span]]:
    """The CRF's spans of each text, before they are held against the base spans."""
    out: list[list[sp.Span]] = [[] for _ in texts]
    held = [(n, *tokens(t)) for n, t in enumerate(texts) if t]
    held = [x for x in held if len(x[1])]
    if not held:
        return out
    gap = np.zeros(1, dtype=np.uint8)
    shapes = np.concatenate([p for x in held for p in (gap, x[3], gap)]).astype(np.int64)
    owner = np.concatenate([np.full(len(x[1]) + 2, x[0]) for x in held])
    begin = np.concatenate([np.concatenate(([0], x[1], [0])) for x in held])
    end = np.concatenate([np.concatenate(([0], x[2], [0])) for x in held])
    total = len(shapes)
    n = -(-total // PIECE)
    wide = np.zeros(n * PIECE + 2 * CONTEXT, dtype=np.int64)
    wide[CONTEXT : CONTEXT + total] = shapes
    step = max(1, 65_536 // (PIECE + 2 * CONTEXT))
    for k in range(0, n, step):
        m = min(step, n - k)
        pieces = np.lib.stride_tricks.sliding_window_view(wide, PIECE + 2 * CONTEXT)[k * PIECE : (k + m - 1) * PIECE + 1 : PIECE]
        path = crf.viterbi(pieces)
        for i, a in zip(*(x.tolist() for x in np.nonzero(path[:, CONTEXT : CONTEXT + PIECE] & 1)), strict=True):  # odd labels begin an entity
            a += CONTEXT
            b, label = a + 1, path[i, a]
            while b < path.shape[1] and path[i, b] == label + 1:
                b += 1
            at = (k + i) * PIECE + a - CONTEXT
            if at < total and b - a + at <= total:
                kind, first, last, who = LABELS[label][2:], int(begin[at]), int(end[at + b - a - 1]), int(owner[at])
                if _checks(kind, texts[who][first:last]):
                    out[who].append((kind, first, last))
    return out


def base(text: str) -> list[sp.Span]:
    """The base spans by kind, then start."""
    out = sp.emails(text) if "@" in text else []
    return out + sp.ips(text) + sp.cards(text) + (sp.phones(text) if "+" in text else [])


def find(texts: list[str], crf: Crf) -> list[tuple[list[sp.Span], list[sp.Span]]]:
    """Base spans, and all spans: an added one that touches a base span (or one added before it) is left out."""
    out = []
    for own, more in zip([base(t) for t in texts], added(texts, crf), strict=True):
        taken = sorted((a, b) for _, a, b in own)
        kept = list(own)
        for s in sorted(more, key=lambda s: (s[1], s[2])):
            if all(b <= s[1] or a >= s[2] for a, b in taken):
                kept.append(s)
                taken.append(s[1:])
        kept.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
        out.append((own, kept))
    return out


def _texts(b: pa.RecordBatch) -> list[str]:
    return [t or "" for t in b.column("text").to_pylist()]


def _finder(crf: Crf):
    def run(batches):
        for whole in batches:
            for b in textkit.slices(whole, "text", textkit.SLICE_BYTES // 2):
                found = find(_texts(b), crf)
                counts = [[sum(s[0] == k for s in own) for own, _ in found] for k in BASE]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array([sp.digest(own) for own, _ in found], pa.string()), pa.array([sp.joined(every) for _, every in found], pa.string())],
                    names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
                )

    return run


def pii_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> a row each: counts of the base kinds, the base spans' digest and all spans as kind:start:end.

    Null texts are empty; an empty text has no spans (the digest of nothing).
    Rows that repeat are kept as rows, a null doc_id stays null, an empty table
    gives no rows, other columns aren't read. Very long texts are read whole.
    One pass, no shuffle.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(docs, _finder(trained()), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str | None, spans: list[sp.Span]) -> str | None:
    """The text with each span written as [KIND]; overlapping spans become one mark, the first's."""
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def _masker(crf: Crf):
    def run(batches):
        for whole in batches:
            for b in textkit.slices(whole, "text", textkit.SLICE_BYTES // 2):
                texts = b.column("text").to_pylist()
                new = [masked(t, every) for t, (_, every) in zip(texts, find([t or "" for t in texts], crf), strict=True)]
                i = b.schema.get_field_index("text")
                yield b.set_column(i, "text", pa.array(new, pa.string()))

    return run


def mask(docs: DataFrame) -> DataFrame:
    """The rows with all found spans masked in text; every other column stays as it is (n_chars follows the new text if it is there)."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    out = mapped(docs, _masker(trained()), docs.schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
