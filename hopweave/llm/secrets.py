"""Secrets by base patterns with structural confirmation (operator 3).

Base patterns give assignments, access ids and long hex runs. On top, every
base64 or hex candidate is decoded and its structure parsed before it is
reported: keys in DER (nested lengths that fill the bytes exactly, with the
numbers a key of that kind holds), keys in the length-prefixed binary format of
SSH, and signed tokens (three base64url parts whose header is a JSON object
that names its algorithm). A candidate that doesn't parse adds nothing.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans as sp
from . import textkit
from .runtime import mapped, table

BASE = ("assign", "access", "hex")
ADDED = ("der_key", "ssh_key", "signed_token")
KINDS = BASE + ADDED
LEAST_BYTES = 24
DEPTH = 12

# The base patterns' words. The classes spell both cases out, so that no other letter folds onto them.
_WORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
_ASSIGN = re.compile(rf"""(?:{_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
# A line break as key files have them (the next line may be indented), or as a string literal writes it.
_BREAK = re.compile(r"\r?\n[\x20\t]*|(?:\\{1,2}r)?\\{1,2}n")
#: A candidate: base64 or base64url text of some length that begins as a key's bytes do, with line breaks. Its bytes say where it ends.
_B64 = re.compile(rf"(?:(?<![A-Za-z0-9+/_-])|(?<=\\n))(?=M|AAAA|b3Bl)[A-Za-z0-9+/_-]{{32,}}(?:(?:{_BREAK.pattern})[A-Za-z0-9+/_-]+)*={{0,2}}")
_HEADS = ("M", "AAAA", "b3Bl")
_HEXKEY = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{2}){24,}(?![0-9A-Za-z])|(?<![0-9A-Za-z])(?:[0-9A-F]{2}){24,}(?![0-9A-Za-z])")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_-]{12,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]{16,})(?![A-Za-z0-9_-])")
# Key types of the SSH binary format, and how many fields each has.
_SSH = {b"ssh-rsa": 3, b"ssh-dss": 5, b"ssh-ed25519": 2, b"ecdsa-sha2-nistp256": 3, b"ecdsa-sha2-nistp384": 3, b"ecdsa-sha2-nistp521": 3}
_SSH_MAGIC = b"openssh-key-v1\0"


def base(text: str) -> list[sp.Span]:
    """The base spans by start, then kind."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18] if "AKIA" in text else []
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=_order)


def _order(s: sp.Span) -> tuple[int, int]:
    return s[1], KINDS.index(s[0])


def der(data: bytes, begin: int = 0, end: int | None = None, depth: int = 0) -> list | None:
    """Nested DER values of data[begin:end] as (tag, content or list); None unless lengths nest and fill it exactly."""
    end = len(data) if end is None else end
    out, at = [], begin
    while at < end:
        if depth > DEPTH or at + 2 > end:
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n == 0x80 or n > 0x84:
            return None
        if n > 0x80:
            size = n - 0x80
            if at + size > end or data[at] == 0:
                return None
            n = int.from_bytes(data[at : at + size])
            at += size
            if n < 0x80:
                return None
        if at + n > end:
            return None
        if tag & 0x20:
            inner = der(data, at, at + n, depth + 1)
            if inner is None:
                return None
            out.append((tag, inner))
        else:
            out.append((tag, data[at : at + n]))
        at += n
    return out


def is_der_key(data: bytes) -> bool:
    """One DER sequence that is a private key (with version number) or a public key (algorithm and bit string)."""
    if len(data) < LEAST_BYTES or data[0] != 0x30 or (tree := der(data)) is None or len(tree) != 1:
        return False
    parts = tree[0][1]
    tags = [t for t, _ in parts]
    if tags[:1] == [0x02] and parts[0][1] in (b"\0", b"\1"):  # version 0 or 1
        if tags[1:3] == [0x30, 0x04] and parts[1][1][:1] and parts[1][1][0][0] == 0x06:
            return True  # private key information
        if tags[1:2] == [0x04] and len(parts[1][1]) >= 20:
            return True  # elliptic curve
        return len(tags) >= 6 and set(tags) == {0x02}  # the numbers of an RSA or DSA key
    if tags == [0x30, 0x03] and parts[0][1] and parts[0][1][0][0] == 0x06:
        return len(parts[1][1]) >= 20 and parts[1][1][0] == 0  # public key information
    if tags == [0x30, 0x04] and parts[0][1] and parts[0][1][0][0] == 0x06:
        return len(parts[1][1]) >= 32  # encrypted private key
    return tags == [0x02, 0x02] and len(parts[0][1]) >= 64  # RSA public key


def is_ssh_key(data: bytes) -> bool:
    """Length-prefixed fields that fill the bytes and begin with a known type, or the private format's head."""
    if data.startswith(_SSH_MAGIC):
        data, least = data[len(_SSH_MAGIC) :], 3
        at = 0
        for _ in range(least):
            if at + 4 > len(data):
                return False
            at += 4 + int.from_bytes(data[at : at + 4])
        return at + 4 <= len(data) and 1 <= int.from_bytes(data[at : at + 4]) <= 64
    fields, at = [], 0
    while at < len(data):
        if at + 4 > len(data):
            return False
        n = int.from_bytes(data[at : at + 4])
        at += 4
        if at + n > len(data):
            return False
        fields.append(data[at : at + n])
        at += n
    return len(fields) >= 2 and fields[0] in _SSH and all(fields[1:])


def unbase64(text: str) -> bytes | None:
    """The bytes of base64 or base64url text, line breaks taken out; None where it is neither, or the padding is wrong."""
    text = _BREAK.sub("", text)
    bare = text.rstrip("=")
    if len(bare) % 4 == 1 or (text != bare and len(text) % 4):
        return None
    url = "-" in bare or "_" in bare
    if url and ("+" in bare or "/" in bare):
        return None
    try:
        return base64.b64decode(bare + "=" * (-len(bare) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(head: str, body: str, signature: str) -> bool:
    """The header is a JSON object with an algorithm; the body and the signature decode."""
    raw = unbase64(head)
    if raw is None or raw[:1] != b"{" or unbase64(body) is None or unbase64(signature) is None:
        return False
    try:
        header = json.loads(raw)
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def _key_kind(data: bytes | None) -> str | None:
    if data is None or len(data) < LEAST_BYTES:
        return None
    return "der_key" if is_der_key(data) else "ssh_key" if is_ssh_key(data) else None


class _Reader:
    """The bytes of a candidate as far as they are asked for, and where in the text they end."""

    def __init__(self, text: str, begin: int, end: int):
        self.text, self.begin, self.end, self.at = text, begin, end, begin
        self.breaks = _BREAK.finditer(text, begin, end)
        self.lines: list[tuple[int, int, int]] = []  # characters before the line, its begin and end
        self.n = 0

    def _upto(self, chars: int) -> bool:
        """Whether there are so many characters."""
        while self.n < chars and self.at < self.end:
            m = next(self.breaks, None)
            stop = m.start() if m else self.end
            self.lines.append((self.n, self.at, stop))
            self.n += stop - self.at
            self.at = m.end() if m else self.end
        return self.n >= chars

    def read(self, size: int) -> bytes | None:
        """The first `size` bytes."""
        chars = -(-size * 4 // 3)
        if not self._upto(chars):
            return None
        data = unbase64("".join(self.text[a : min(b, a + chars - n)] for n, a, b in self.lines if n < chars))
        return None if data is None or len(data) < size else data[:size]

    def stop(self, size: int) -> int:
        """Where the first `size` bytes end in the text, padding included."""
        chars = -(-size * 4 // 3)
        n, a, _ = next(x for x in reversed(self.lines) if x[0] < chars)
        at = a + chars - n
        pad = -chars % 4
        return at + pad if self.text.startswith("=" * pad, at) else at


def _size(r: _Reader) -> int | None:
    """How many bytes the key that begins here says it has."""
    head = r.read(9)
    if head is None:
        return None
    if head[0] == 0x30:
        more = max(0, head[1] - 0x80)
        if more > 4 or head[2 + more] not in (0x02, 0x30):  # a key begins with a number or a sequence
            return None
        return 2 + more + (int.from_bytes(head[2 : 2 + more]) if more else head[1])

    def field(at: int) -> int | None:
        """The end of a length-prefixed field."""
        data = r.read(at + 4) if at is not None else None
        return None if data is None else at + 4 + int.from_bytes(data[at:])

    if head[:4] == _SSH_MAGIC[:4]:
        at = len(_SSH_MAGIC)
        for _ in range(3):
            at = field(at)
        count = r.read(at + 4) if at is not None else None
        if count is None or int.from_bytes(count[at:]) > 64:
            return None
        n, at = int.from_bytes(count[at:]), at + 4
    else:
        at = field(0)
        name = r.read(at) if at is not None and at <= 64 else None
        n = _SSH.get(name[4:], 0) - 2 if name else -1
    for _ in range(n + 1):  # the public keys and the private part, or the fields after the name
        at = field(at)
    return at if n >= 0 else None


def confirmed(text: str) -> list[sp.Span]:
    """Candidates whose structure parses."""
    out: list[sp.Span] = []
    for m in _B64.finditer(text):
        at, stop = m.span()
        breaks = [k.span() for k in _BREAK.finditer(text, at, stop)]
        for begin in (at, *(b for _, b in breaks)):  # a key may begin at any of its lines
            if begin < at or not text.startswith(_HEADS, begin):
                continue
            r = _Reader(text, begin, stop)
            size = _size(r)
            if size and size <= stop - begin and (kind := _key_kind(r.read(size))):
                at = r.stop(size)
                out.append((kind, begin, at))
            elif begin == m.start():
                # its bytes don't say: whole first, then without its last line, then its first line
                for end in dict.fromkeys((stop, *(a for a, _ in breaks[-1:]), *(a for a, _ in breaks[:1]))):
                    if kind := _key_kind(unbase64(text[begin:end])):
                        out.append((kind, begin, end))
                        at = end
                        break
    for m in _HEXKEY.finditer(text):
        if kind := _key_kind(bytes.fromhex(m[0])):
            out.append((kind, *m.span()))
    if "." in text:
        out += [("signed_token", *m.span()) for m in _TOKEN.finditer(text) if m[1].startswith("e") and is_signed_token(*m.groups())]
    return out


def find(text: str) -> tuple[list[sp.Span], list[sp.Span]]:
    """Base spans, and all spans by start, then kind."""
    own = base(text)
    return own, sorted({*own, *confirmed(text)}, key=_order)


def _run(batches):
    for whole in batches:
        for b in textkit.slices(whole, "text"):
            found = [find(t or "") for t in b.column("text").to_pylist()]
            counts = [[sum(s[0] == k for s in own) for own, _ in found] for k in BASE]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array([sp.digest(own) for own, _ in found], pa.string()), pa.array([sp.joined(every) for _, every in found], pa.string())],
                names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
            )


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> a row each: counts of the base kinds, the base spans' digest and all spans as kind:start:end.

    Null texts are empty; an empty text has no spans (the digest of nothing).
    Rows that repeat are kept as rows, a null doc_id stays null, an empty table
    gives no rows, other columns aren't read. Very long texts are read whole.
    One pass, no shuffle.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(docs, _run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
