"""Streaming SentencePiece encoding and decoding by Viterbi with bounded look-back (operator 8).

Every text goes through `Codec.stream`, which walks over its characters once. It
keeps the best piece that ends at each boundary of a window, and with it where
that piece begins. Whenever the paths of all boundaries that a later piece can
begin at run through one boundary, the ids before it are committed and
forgotten, so memory is bounded by the longest piece and the longest stretch
that is really undecided, not by the text.

Which piece may end at a position depends on the model's kind:
- unigram: the one with the largest sum of scores (ties: the longer piece);
- BPE: the one piece that the merge order leaves there. A sequence of pieces is
  what the merges give exactly if every two neighbours are what the merges give
  for the two alone, so the step takes the piece whose neighbour test against
  the piece before holds. That makes the same ids as merging, without merging a
  text that has not been seen to its end.

A boundary that no piece of the vocabulary can cross (before a space mark, after
another character) is a convergence for every text, so the stream may be started
anew there. In front of it stands a bounded table of the short stretches between
such boundaries that a task has met, as words repeat; and a stream may begin with
the lattice that another has made of the same first characters. Both only save
time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit
from .runtime import mapped, table

#: The model's path is a parameter; the file is read by the driver and its pieces go to the executors.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Stretches and pairs of pieces that a task's tables hold, and the longest stretch they hold.
REMEMBERED = 200_000
REMEMBERED_CHARS = 48
#: Characters that a stream takes at a time, and bytes of texts whose words are learned together.
CHUNK, TOGETHER = 512, 2 << 20
BPE, UNIGRAM = "bpe", "unigram"


@dataclass
class Vocabulary:
    """Pieces with ids and scores, the ids of the 256 byte pieces, the unknown id, and the kind of model."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes_: list[int]
    unknown: int
    kind: str
    text: dict[int, str] = field(default_factory=dict)
    prefix: bool = True
    rank: dict[str, int] = field(default_factory=dict)  # BPE: order of merges
    halves: dict[str, tuple[str, str]] = field(default_factory=dict)  # BPE: the two parts of a piece's own last merge

    def __post_init__(self):
        if self.kind == BPE and not self.rank:
            order = sorted(self.ids, key=lambda p: -self.scores[p])
            self.rank = {p: i for i, p in enumerate(order)}
            for p in order:
                if len(p) > 1 and (h := self._merged(p)):
                    self.halves[p] = h
            for p in order:  # a longer piece that its own merges don't make never comes about
                if len(p) > 1 and p not in self.halves:
                    del self.ids[p]

    def _merged(self, piece: str) -> tuple[str, str] | None:
        """The last merge that makes the piece from its characters, if they make it at all."""
        parts, rank = list(piece), self.rank
        while len(parts) > 2:
            r, at = min((rank.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if r == 1 << 60:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (parts[0], parts[1])

    @property
    def longest(self) -> int:
        return max(map(len, self.ids), default=1)


def load(path: str = MODEL) -> Vocabulary:
    """Read a model file whose normaliser is the identity; any other normaliser is refused."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(Path(path).read_bytes())
    if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only models with an identity normaliser are supported")
    ids, scores, by, unknown = {}, {}, [-1] * 256, 0
    for i, p in enumerate(m.pieces):
        if p.type == 1 or p.type == 4:
            ids[p.piece], scores[p.piece] = i, p.score
        elif p.type == 6:
            by[int(p.piece[3:-1], 16)] = i
        elif p.type == 2:
            unknown = i
    return Vocabulary(ids, scores, by if min(by) >= 0 else [], unknown, BPE if m.trainer_spec.model_type == 2 else UNIGRAM, {i: p.piece for i, p in enumerate(m.pieces) if p.type in (1, 4)}, m.normalizer_spec.add_dummy_prefix)


class Codec:
    """Encoder and decoder of a vocabulary. Inside, pieces go by their number in `names`; characters of no piece get one when they are met."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.longest = vocabulary.longest
        self.widest = 0
        self.names = list(vocabulary.ids)
        self.number = {p: i for i, p in enumerate(self.names)}
        self.length = [len(p) for p in self.names]
        self.packed = [np.array([i], dtype="<i4").tobytes() for i in vocabulary.ids.values()]
        self.scores = [vocabulary.scores[p] for p in self.names]
        self.floor = min(vocabulary.scores.values(), default=0.0) - 10.0
        self.apart: set[int] = set()  # pairs of pieces that stay side by side, and those that don't
        self.merge: set[int] = set()
        self.memory: dict[str, bytes] = {}  # of the last stretches, and of those before them
        self.older: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}  # the same for words that stand after one mark
        self.older_plain: dict[str, bytes] = {}
        self.inside = {p[i : i + 2] for p in vocabulary.ids for i in range(len(p) - 1)}
        # lengths of the pieces that end with three characters (and of the shorter ones that may end there, too), longest first; of those that end with two
        ends: dict[str, set[int]] = {}
        for p in vocabulary.ids:
            if len(p) > 2:
                ends.setdefault(p[-3:], {1, 2} if p[-2:] in vocabulary.ids else {1}).add(len(p))
        self.sizes = {e: tuple(sorted(n, reverse=True)) for e, n in ends.items()}
        self.pairs = {p: (2, 1) for p in vocabulary.ids if len(p) == 2}
        self.crossing = any(MARK in p.lstrip(MARK) for p in vocabulary.ids)
        self.out = [b""] * (max([*vocabulary.text, *vocabulary.bytes_, vocabulary.unknown, 0]) + 1)
        for i, p in vocabulary.text.items():
            self.out[i] = p.replace(MARK, " ").encode("utf-8", "surrogatepass")
        for b, i in enumerate(vocabulary.bytes_):
            self.out[i] = bytes([b])
        self.out[vocabulary.unknown] = " ⁇ ".encode()

    def _met(self, c: str) -> int:
        """A number for a character that is no piece: bytes, or the unknown id."""
        raw = c.encode("utf-8", "surrogatepass")
        ids = [self.v.bytes_[b] for b in raw] if self.v.bytes_ else [self.v.unknown]
        self.number[c] = len(self.names)
        self.names.append(c)
        self.length.append(1)
        self.packed.append(np.array(ids, dtype="<i4").tobytes())
        self.scores.append(self.floor)
        return self.number[c]

    def _stay(self, key: int) -> bool:
        """Whether the merge order leaves two pieces side by side as they are, remembered."""
        if len(self.apart) + len(self.merge) > REMEMBERED:
            self.apart.clear()
            self.merge.clear()
        ok = self._side_by_side(self.names[key >> 32], self.names[key & 0xFFFFFFFF])
        (self.apart if ok else self.merge).add(key)
        return ok

    def _side_by_side(self, a: str, b: str) -> bool:
        """The two are undone step by step, the later merge first; where the parts that then touch would have merged before that step, they don't stay apart."""
        rank, halves, never = self.v.rank, self.v.halves, 1 << 60
        limit = never
        while True:
            if rank.get(a + b, never) < limit:
                return False
            i = rank[a] if a in halves else -1
            j = rank[b] if b in halves else -1
            if i < 0 and j < 0:
                return True
            if i > j:
                limit, a = i, halves[a][1]
            else:  # of equal merges the left one comes first
                limit, b = j + 1, halves[b][0]

    def stream(self, chunks: Iterable[str]) -> Iterator[str]:
        """Pieces in order; each is given out as soon as no later character can change it. `widest` keeps the largest window."""
        for some in self.committed(chunks):
            for i in some:
                yield self.names[i]

    def committed(self, chunks: Iterable[str], apart: bool = False) -> Iterator[list[int]]:
        """The stream: the numbers of pieces, as many at a time as are decided.

        apart (BPE): each chunk is a stretch of its own, too short to be committed
        before its end; it is carried on from where it begins to differ from the
        one before, and all its pieces are given out at once.
        """
        number, length, scores, longest, sizes, pairs = self.number, self.length, self.scores, self.longest, self.sizes, self.pairs
        stay, merge, one, bpe = self.apart, self.merge, (1,), self.v.kind == BPE
        # what isn't committed, and the piece that ends at each boundary of it (of its begin: what was committed before, -1 for none; None where none can)
        window, last = "", [-1]
        n, due = 0, 2 * longest  # how much of it is read, and when to look for a convergence
        sums = [0.0]  # unigram: the best sum up to there
        for chunk in chunks:
            if apart:
                n, most = 0, min(len(window), len(chunk))
                while n < most and window[n] == chunk[n]:
                    n += 1
                del last[n + 1 :]
                window = chunk
            else:
                window += chunk
            while n < len(window):
                for n in range(n + 1, min(len(window), due) + 1):
                    best, top = None, 0.0
                    if bpe:
                        for size in (n > 2 and sizes.get(window[n - 3 : n])) or (n > 1 and pairs.get(window[n - 2 : n])) or one:
                            if size > n:
                                continue
                            piece = number.get(window[n - size : n])
                            if piece is None:
                                if size > 1:
                                    continue
                                piece = self._met(window[n - 1])
                            before = last[n - size]
                            if before is None:
                                continue
                            if before < 0 or (key := before << 32 | piece) in stay or (key not in merge and self._stay(key)):
                                best = piece
                                break
                    else:
                        for size in range(min(longest, n), 0, -1):
                            piece = number.get(window[n - size : n])
                            if last[n - size] is None or (piece is None and size > 1):
                                continue
                            piece = self._met(window[n - 1]) if piece is None else piece
                            s = sums[n - size] + scores[piece]
                            if best is None or s > top:
                                best, top = piece, s
                        sums.append(top)
                    last.append(best)
                if n >= due:
                    self.widest = max(self.widest, n)
                    if to := self._meeting(last, n, longest):
                        yield self._path(last, to)
                        last, window, n = last[to:], window[to:], n - to
                        sums = sums[to:]
                    due = max(2 * longest, n + longest)
            if apart:
                yield self._path(last, n)
        self.widest = max(self.widest, n)
        if not apart:
            yield self._path(last, n)

    def _meeting(self, last: list[int | None], n: int, longest: int) -> int:
        """The last boundary that the paths of all boundaries a later piece can begin at run through; 0 if there is none."""
        paths: set[int] | None = None
        for at in range(n - longest + 1, n + 1):
            if last[at] is not None:
                own = set()
                while at:
                    own.add(at)
                    at -= self.length[last[at]]
                paths = own if paths is None else paths & own
        return max(paths, default=0) if paths else 0

    def _path(self, last: list[int | None], to: int) -> list[int]:
        out = []
        while to:
            i = last[to]
            out.append(i)
            to -= self.length[i]
        return out[::-1]

    def learn(self, words: Iterable[str]) -> None:
        """Put words, each after one mark, into the table, in an order in which each begins as the one before, so that their lattices share a stem."""
        plain, old = self.plain, self.older_plain
        new = [w for w in words if w not in plain and w not in old and len(w) < REMEMBERED_CHARS]
        cut = {w: ps for w in new if len(ps := self._parts(MARK + w)) > 1}
        fresh: dict[str, bytes] = {}  # parts that no table has
        if self.v.kind == BPE:
            memory, older, packed, longest = self.memory, self.older, self.packed, 2 * self.longest
            parts = {MARK + w for w in new if w not in cut}.union(*cut.values())
            ordered = sorted(p for p in parts if p not in memory and p not in older and p[1:] not in plain and p[1:] not in old and len(p) < longest)
            del parts
            for part, found in zip(ordered, self.committed(ordered, apart=True), strict=True):
                fresh[part] = b"".join([packed[i] for i in found])
            del ordered
        if len(plain) >= REMEMBERED:
            self.older_plain, self.plain = plain, {}
        get, put = self.memory.get, self.plain
        for w in new:
            if w not in cut:  # its own entry is the only one of its one part
                part = MARK + w
                put[w] = fresh.pop(part, None) or get(part) or self._found(part)
        for w, ps in cut.items():
            put[w] = b"".join([get(p) or (self._kept(p, fresh[p]) if p in fresh else self._part(p)) for p in ps])

    def _word(self, word: str) -> bytes:
        """The ids of a word after one mark."""
        known = self.older_plain.get(word)
        if known is None:
            known = self._of(MARK + word)
        if len(word) < REMEMBERED_CHARS:
            self.plain[word] = known
        return known

    def _of(self, stretch: str) -> bytes:
        """The ids of a stretch whose ends no piece crosses: of its parts, from the table or streamed."""
        return b"".join([self.memory.get(p) or self._part(p) for p in self._parts(stretch)])

    def _part(self, part: str) -> bytes:
        if part[0] == MARK and (known := self.plain.get(part[1:]) or self.older_plain.get(part[1:])):
            return known
        return self._kept(part, self._found(part))

    def _found(self, part: str) -> bytes:
        chunks = (part,) if len(part) <= CHUNK else (part[i : i + CHUNK] for i in range(0, len(part), CHUNK))
        return self.older.get(part) or b"".join([self.packed[i] for some in self.committed(chunks) for i in some])

    def _kept(self, stretch: str, known: bytes) -> bytes:
        if len(stretch) <= REMEMBERED_CHARS:
            if len(self.memory) >= REMEMBERED:
                self.older, self.memory = self.memory, {}
            self.memory[stretch] = known
        return known

    def _parts(self, stretch: str) -> list[str]:
        """The stretch cut wherever no piece holds the two characters side by side."""
        if stretch.lstrip(MARK).isalpha():
            return [stretch]  # most words; a cut inside one would only save time
        inside, out, at = self.inside, [], 0
        for i in range(1, len(stretch)):
            if stretch[i - 1 : i + 1] not in inside:
                out.append(stretch[at:i])
                at = i
        out.append(stretch[at:])
        return out

    def stretches(self, text: str) -> list[str]:
        """What a text is cut into before space marks; marks in a row belong to the word that follows."""
        if not text:
            return []
        text = (" " if self.v.prefix else "") + text
        text = text.replace(" ", MARK)
        if self.crossing:
            return [text]
        head, *words = text.split(MARK)
        if "" not in words:
            out = [MARK + w for w in words]
        else:
            out, marks = [], MARK
            for w in words:
                if w:
                    out.append(marks + w)
                    marks = MARK
                else:
                    marks += MARK
            if not words[-1]:
                out.append(marks[:-1])  # the text's end
        return [head, *out] if head else out

    def words(self, text: str) -> list[str] | None:
        """The words of a text in which each stands after one mark; None if it is another text."""
        if self.crossing or not self.v.prefix or not text or MARK in text:
            return None
        out = text.split(" ")
        return None if "" in out else out

    def encode(self, text: str) -> np.ndarray:
        """Token ids; an empty text has none."""
        return np.frombuffer(b"".join(map(self._of, self.stretches(text))), dtype="<i4")

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        cut = [self.words(t) for t in texts]
        self.learn(set().union(*(w for w in cut if w)))
        out = []
        for text, words in zip(texts, cut, strict=True):
            if words is None:
                out.append(self.encode(text))
            else:
                get = self.plain.get
                out.append(np.frombuffer(b"".join([get(w) or self._word(w) for w in words]), dtype="<i4"))
        return out

    def decode(self, ids) -> str:
        """The text of ids: pieces joined, byte pieces as UTF-8, the prefix space taken off."""
        text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.v.prefix and text[:1] == " " else text

    def restores(self, ids: np.ndarray, text: str) -> bool:
        """Whether decoding gives the text back: by its bytes, and where they differ by the text itself."""
        raw = b"".join(map(self.out.__getitem__, ids.tolist()))
        return raw == (b" " if self.v.prefix and text else b"") + text.encode("utf-8", "surrogatepass") or self.decode(ids.tolist()) == text


def _gathered(batches, most: int):
    """Batches put together to about so many bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _encoder(v: Vocabulary, digests: bool):
    def run(batches):
        codec = Codec(v)  # a task's own, gone with it
        for whole in _gathered(batches, TOGETHER):
            for b in textkit.slices(whole, "text", TOGETHER):
                texts = [t or "" for t in b.column("text").to_pylist()]
                ids = codec.encode_all(texts)
                counts = pa.array([len(x) for x in ids], pa.int64())
                same = pa.array([codec.restores(x, t) for x, t in zip(ids, texts, strict=True)])
                if digests:
                    yield pa.RecordBatch.from_arrays([b.column("doc_id"), counts, pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()), same], names=["doc_id", "n_tokens", "ids_sha256", "round_trip"])
                else:
                    at = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*ids, np.zeros(0, dtype="<i4")]).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([b.column("doc_id"), counts, lists, same], names=["doc_id", "n_tokens", "ids", "round_trip"])

    return run


def encoded(docs: DataFrame, model: str = MODEL, digests: bool = False) -> DataFrame:
    """(doc_id, text, ...) -> a row each: doc_id, n_tokens, ids (or their SHA-256 as little-endian 32-bit), and whether decoding gives the text back.

    Null and empty texts have no tokens; a null doc_id stays null; an empty table
    gives no rows. Repeated rows are kept as rows, other columns aren't read. A
    very long text is encoded whole, its lattice in a bounded window. One pass,
    no shuffle.
    """
    kind = "ids_sha256 string" if digests else "ids array<int>"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(docs, _encoder(load(model), digests), f"doc_id long, n_tokens long, {kind}, round_trip boolean")


def _decoder(v: Vocabulary):
    def run(batches):
        codec = Codec(v)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([codec.decode(x or []) for x in b.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return run


def decoded(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids, ...) -> doc_id, text; null ids are an empty text."""
    tokens = tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return mapped(tokens, _decoder(load(model)), "doc_id long, text string")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), digests=True)
