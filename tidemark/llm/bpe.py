"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece exactly one token can be the last token of its encoding. The
encoder stores that token for each prefix length: a token that ends at position i is the
last one when the token stored where it begins may stand before it, that is, when merging
the two tokens' bytes by rank would give the same two tokens again. Reading the stored
tokens backwards gives the encoding of any prefix, so appended bytes need only new entries,
and after an edit entries are made anew only until they agree with the old ones again.

Pieces are the matches of a pattern, each encoded by itself; a piece that is a token as it
stands is that token. A task remembers pieces up to ``PIECE_BYTES``.

Defined results. Null text is empty: no tokens. Ids travel as packed little-endian unsigned
32-bit integers. Rows that repeat give repeated rows; an empty table gives an empty one.
Other columns are not read.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Remembered, small_batches

PIECE_BYTES = 64 << 20
STAND = 200_000

#: A common pattern, and one of Python's faster matcher that equals it on texts whose characters
#: ``_like`` leaves as they are; the others are replaced, one for one, by a character of their class.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_PATTERN = r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
UNICODE = "16.0.0"
#: Code points (first, last) that Unicode 16.0 made letters and numbers; Python's
#: table may be older. A newer table's additions count as unassigned.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.rank = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._stand: dict[int, bool] = {}
        self._base = max(self.token, default=0) + 1
        self._ends = None

    @classmethod
    def parse(cls, lines: bytes) -> Vocabulary:
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a})

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a byte or a token no merge reaches."""
        if token not in self._halves:
            whole = self.token[token]
            parts = [whole[i : i + 1] for i in range(len(whole))]
            while len(parts) > 2:
                best = min(((r, i) for i in range(len(parts) - 1) if (r := self.rank.get(parts[i] + parts[i + 1])) is not None and r < token), default=None)
                if best is None:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            self._halves[token] = (self.rank[parts[0]], self.rank[parts[1]]) if len(parts) == 2 and all(p in self.rank for p in parts) else None
        return self._halves[token]

    def reachable(self, token: int) -> bool:
        return len(self.token[token]) == 1 or self.halves(token) is not None

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b gives a and b. Merges are taken back in reverse
        order on both sides of the seam; a merge across it that comes before the one just taken
        back (or, left of it, at the same rank) would have happened instead."""
        if not self.reachable(b):
            return False
        x, y, before = a, b, None
        token, rank, halves = self.token, self.rank, self.halves
        while True:
            across = rank.get(token[x] + token[y])
            if across is not None and (before is None or across < before):
                return False
            hx, hy = halves(x), halves(y)
            if hx is None and hy is None:
                return True
            if hy is None or (hx is not None and x > y):
                before, x = x, hx[1]
            else:
                before, y = y + 1, hy[0]

    @property
    def ends(self):
        """An automaton that names the tokens ending at each position, the longest first."""
        if self._ends is None:
            import ahocorasick

            self._ends = ahocorasick.Automaton()
            for token, content in self.token.items():
                self._ends.add_word(content.decode("latin-1"), (token, len(content)))
            self._ends.make_automaton()
        return self._ends

    def extend(self, content: bytes, last: list[int], upto: int) -> None:
        """Give ``last`` an entry for each prefix length up to ``upto``."""
        stand, base = self._stand, self._base
        if len(stand) > STAND:
            stand.clear()
        at = max(0, len(last) - self.longest)
        if len(last) <= upto:
            for end, (token, length) in self.ends.iter(content[at:upto].decode("latin-1")):
                i = at + end + 1
                if i < len(last):
                    continue
                if i > len(last):
                    break
                if i > length:
                    key = last[i - length] * base + token
                    ok = stand.get(key)
                    if ok is None:
                        ok = stand[key] = self.may_follow(last[i - length], token)
                else:
                    ok = self.reachable(token)
                if ok:
                    last.append(token)
        if len(last) <= upto:
            raise ValueError("the vocabulary lacks a byte")


class Piece:
    """Encoding of a growing, editable byte string."""

    def __init__(self, vocabulary: Vocabulary, content: bytes = b""):
        self.v, self.content, self.last = vocabulary, b"", [-1]
        self.append(content)

    def append(self, more: bytes) -> None:
        self.content += more
        self.v.extend(self.content, self.last, len(self.content))

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replace content[start:stop]; returns how many entries were made anew."""
        old, shift = self.last, len(new) - (stop - start)
        self.content = self.content[:start] + new + self.content[stop:]
        self.last = old[: start + 1]
        agreed, made = 0, 0
        for i in range(start + 1, len(self.content) + 1):
            self.v.extend(self.content, self.last, i)
            made += 1
            agreed = agreed + 1 if i >= start + len(new) + self.v.longest and old[i - shift] == self.last[i] else 0
            if agreed >= self.v.longest:
                self.last.extend(old[i - shift + 1 :])
                break
        return made

    def ids(self, upto: int | None = None) -> list[int]:
        out, i = [], len(self.content) if upto is None else upto
        while i:
            out.append(self.last[i])
            i -= len(self.v.token[out[-1]])
        return out[::-1]


def _class(c: str) -> str:
    """L (letter), N (number), S (white space) or P by the pinned Unicode version."""
    import unicodedata

    point, kind = ord(c), unicodedata.category(c)[0]
    if any(a <= point <= b for a, b in NEW_LETTERS):
        return "L"
    if any(a <= point <= b for a, b in NEW_NUMBERS):
        return "N"
    if kind in "LN":
        return kind
    return "S" if c.isspace() and c not in "\x1c\x1d\x1e\x1f" else "P"


def _plain_class(c: str) -> str:
    """What PLAIN_PATTERN takes a character for."""
    return "N" if c.isdecimal() else "L" if c.isalnum() else "S" if c.isspace() else "P"


def _like(c: str) -> str:
    """The character itself, or where the pattern would mistake it, one of its class that stands for itself."""
    kind = _class(c)
    return c if kind == _plain_class(c) else {"L": "\u00e9", "N": "0", "S": "\t", "P": "!"}[kind]


class Encoder:
    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.v, self.packed = vocabulary, Remembered(self._pack, PIECE_BYTES)
        if pattern == WORD_PATTERN:
            plain, pieces, known = re.compile(PLAIN_PATTERN).findall, re.compile(PLAIN_PATTERN).finditer, set()

            def split(text: str) -> list[str]:
                new = set(text) - known
                odd = {ord(c): x for c in new if (x := _like(c)) != c}
                known.update(c for c in new if ord(c) not in odd)
                return [text[m.start() : m.end()] for m in pieces(text.translate(odd))] if odd else plain(text)

            self.split = split
        else:
            import regex

            self.split = regex.compile(pattern).findall

    def _pack(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "surrogatepass")
        whole = self.v.rank.get(raw)
        ids = [whole] if whole is not None else Piece(self.v, raw).ids()
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def encode_packed(self, text: str) -> bytes:
        return b"".join(map(self.packed.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        packed = self.encode_packed(text)
        return [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]

    def decode_packed(self, ids: bytes) -> bytes:
        return b"".join(map(self.v.token.__getitem__, memoryview(ids).cast("I"))) if ids else b""


_vocabularies: dict[int, Vocabulary] = {}


def _encoder(lines, pattern: str) -> Encoder:
    """A worker keeps the vocabulary, whose size is fixed; the memory of pieces ends with the task."""
    key = hash(lines.value)
    if key not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[key] = Vocabulary.parse(lines.value)
    return Encoder(_vocabularies[key], pattern)


def _vocabulary(df: DataFrame, path: str):
    with open(path, "rb") as f:  # a fixed file of the driver, about 1 MB
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", *, decoded: bool = False) -> DataFrame:
    """id, n_tokens, ids (binary: packed little-endian unsigned 32-bit integers); with ``decoded`` also
    the bytes that the ids give back, made in the same pass."""
    lines = _vocabulary(docs, path)

    def run(batches):
        e = _encoder(lines, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [e.encode_packed(x or "") for x in part.column(1).to_pylist()]
                out = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decoded:
                    out.append(pa.array(map(e.decode_packed, ids), pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names)

    names = ["id", "n_tokens", "ids", *(["decoded"] if decoded else [])]
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long, ids binary" + ", decoded binary" * decoded).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Adds ``decoded`` (binary) to the rows of ``encode``."""
    lines = _vocabulary(encoded, path)

    def run(batches):
        e = _encoder(lines, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([e.decode_packed(x) for x in part.column(2).to_pylist()], pa.binary())], ["id", "n_tokens", "ids", "decoded"])

    rows = encoded.select(F.col(id_col).alias("id"), "n_tokens", "ids")
    return rows.mapInArrow(run, "id long, n_tokens long, ids binary, decoded binary").withColumnRenamed("id", id_col)


def report(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = encode(docs, path, pattern, id_col, text_col, decoded=True)
    return rows.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
