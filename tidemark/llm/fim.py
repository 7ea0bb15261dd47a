"""Fill-in-middle examples from an index of distinct texts.

Documents of equal text share one entry of the index: the ends of its lines as an Elias-Fano
list, which holds n ascending numbers up to u in about n (2 + log2(u / n)) bits and gives the i-th
directly. Each document draws its own cut, two places between lines, from a hash of its id, and reads them from the list.

1. A task keeps one entry for each distinct text it has read, with the ids of its rows.
2. Entries are dealt by (digest, salt) and sorted, so that entries of one text follow each other. Their
   contents are compared, not digests alone: zstd packing is lossless and deterministic, so packed contents are equal exactly
   when the texts are. A text's list is computed once there and serves all its entries.
3. The ids come back with the list and the text; each takes its cut.

Texts cross the network once a task, packed. A digest that holds more than one in ``HEAVY`` of
all rows (there are fewer than ``HEAVY`` of them) has salts in proportion to its rows; a list is then computed once a salt.

Defined results. Null text counts as empty. An empty text, or one that has a sentinel in it, stays plain. A null id
hashes as an empty number. Repeated rows give a row each. Texts of any length are cut whole: a task holds
the distinct texts of its entries up to ``FLUSH_BYTES`` and one beyond. Equal draws of both places give an empty middle. An
empty table gives an empty one. Columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import HEAVY, small_batches

FLUSH_BYTES = 32 << 20
IDS_PER_ENTRY = 512
#: Bytes of text that a batch of results may hold.
BATCH_BYTES = 8 << 20

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

EXAMPLES = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
BOUNDARIES = "digest binary, n long, chars long, ends binary"


class EliasFano:
    """Ascending numbers: low bits packed, high bits in unary. ``select(i)`` gives the i-th."""

    def __init__(self, n: int, width: int, low: bytes, high: bytes):
        self.n, self.width, self.low, self.high = n, width, low, high
        self._ones = None

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"")
        values = np.asarray(values, np.int64)
        width = max(0, (int(values[-1]) // n).bit_length() - 1)
        high = np.zeros(int(values[-1] >> width) + n, np.uint8)
        high[(values >> width) + np.arange(n)] = 1
        low = (values[:, None] >> np.arange(width)) & 1
        return cls(n, width, np.packbits(low.astype(np.uint8).reshape(-1)).tobytes(), np.packbits(high).tobytes())

    def select(self, i: int) -> int:
        high = np.frombuffer(self.high, np.uint8)
        if self._ones is None:  # ones up to each byte
            self._ones = np.cumsum(np.bitwise_count(high).astype(np.int64))
        at = int(np.searchsorted(self._ones, i + 1))
        before = int(self._ones[at - 1]) if at else 0
        place = 8 * at + int(np.flatnonzero(np.unpackbits(high[at : at + 1]))[i - before])
        start = i * self.width
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8)[start // 8 : (start + self.width + 7) // 8])[start % 8 : start % 8 + self.width]
        return ((place - i) << self.width) | int((bits.astype(np.int64) << np.arange(self.width)).sum())

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.width, len(self.low)], "<u8").tobytes()
        return head + self.low + self.high

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, width, low = np.frombuffer(data[:24], "<u8").tolist()
        return cls(n, width, data[24 : 24 + low], data[24 + low :])


def line_ends(text: str) -> np.ndarray:
    """Code points up to the end of each line, its line break included."""
    if not text:
        return np.empty(0, np.int64)
    ends = np.cumsum(np.fromiter(map(len, text.split("\n")), np.int64) + 1)
    ends[-1] -= 1  # what follows the last line break ends without one
    return ends[:-1] if text[-1] == "\n" else ends


@dataclass(frozen=True)
class Rules:
    """How often and in which order texts are cut."""

    seed: int = 7
    fim_percent: int = 100
    spm_percent: int = 50
    sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)

    def draw(self, doc_id: int | None) -> tuple[int, int, int, int]:
        digits = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        return tuple(int(digits[8 * i : 8 * i + 8], 16) for i in range(4))

    def form(self, bare: bool, h3: int, h4: int) -> str:
        if bare or h3 % 100 >= self.fim_percent:
            return "plain"
        return "spm" if h4 % 100 < self.spm_percent else "psm"

    def example(self, doc_id: int | None, text: str, ends: EliasFano, bare: bool) -> tuple[str, int | None, int | None, str]:
        """Form, code points of prefix and middle, output."""
        h1, h2, h3, h4 = self.draw(doc_id)
        form = self.form(bare, h3, h4)
        if form == "plain":
            return form, None, None, text
        first, second = sorted((h1 % (ends.n + 1), h2 % (ends.n + 1)))
        a, b = (ends.select(i - 1) if i else 0 for i in (first, second))
        p, s, m = self.sentinels
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        return form, a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}" if form == "spm" else f"{p}{prefix}{s}{suffix}{m}{middle}"


def sha256(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


_entry = pa.schema([("digest", pa.binary()), ("content", pa.binary()), ("ids", pa.list_(pa.int64()))])
_example = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
_boundary = pa.schema([("digest", pa.binary()), ("n", pa.int64()), ("chars", pa.int64()), ("ends", pa.binary())])


def _combine(digest):
    """mapInArrow body: rows of (id, text) to entries of distinct texts."""

    def entries(held):
        import zstandard

        packer = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=True).compress
        out, size = [], 0
        for content, ids in held.items():
            key, tight = digest(content), packer(content)
            for at in range(0, len(ids), IDS_PER_ENTRY):
                out.append({"digest": key, "content": tight, "ids": ids[at : at + IDS_PER_ENTRY]})
                size += len(tight)
                if len(out) >= 2000 or size > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema=_entry)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_entry)

    def run(batches):
        held, size = {}, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                content = (text or "").encode("utf-8", "surrogatepass")
                ids = held.get(content)
                if ids is None:
                    held[content] = [doc_id]
                    size += len(content) + 200
                else:
                    ids.append(doc_id)
                    size += 8
                if size > FLUSH_BYTES:
                    yield from entries(held)
                    held, size = {}, 0
        yield from entries(held)

    return run


def _texts(batches):
    """Runs of one digest: for each entry its text, the text's list and whether this is the text's first entry."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    digest, known = None, {}
    for batch in batches:
        for at in range(batch.num_rows):
            key, content, ids = (batch.column(c)[at].as_py() for c in ("digest", "content", "ids"))
            if key != digest:
                digest, known = key, {}
            found = known.get(content)
            if found is None:
                text = unpack(content).decode("utf-8", "surrogatepass")
                known[content] = text, EliasFano.of(line_ends(text))
            yield key, ids, *known[content], found is None


def _examples(rules: Rules):
    def run(batches):
        out, size = [], 0
        for _, ids, text, ends, _ in _texts(batches):
            bare = not text or any(s in text for s in rules.sentinels)
            for doc_id in ids:
                form, prefix, middle, output = rules.example(doc_id, text, ends, bare)
                out.append({"doc_id": doc_id, "n": ends.n, "form": form, "prefix_chars": prefix, "middle_chars": middle, "output": output})
                size += len(output)
                if len(out) >= 1000 or size > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema=_example)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_example)

    return run


def _boundaries(batches):
    for digest, _, text, ends, new in _texts(batches):
        if new:
            yield pa.RecordBatch.from_pylist([{"digest": digest, "n": ends.n, "chars": len(text), "ends": ends.to_bytes()}], schema=_boundary)


def _grouped(docs: DataFrame, id_col: str, text_col: str, digest, salted: bool) -> DataFrame:
    """Entries of all rows, those of one text (and salt) one after the other."""
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    entries = rows.mapInArrow(_combine(digest), "digest binary, content binary, ids array<long>")
    salt = F.lit(0)
    if salted:
        key = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest")
        counts = rows.groupBy(key).agg(F.count("*").alias("n"))
        share = rows.count() / HEAVY
        heavy = counts.filter(F.col("n") > max(1, share)).select("digest", F.ceil(F.col("n") / F.lit(max(1, share))).cast("int").alias("salts"))
        entries = entries.join(F.broadcast(heavy), "digest", "left")
        salt = F.pmod(F.xxhash64("ids"), F.coalesce("salts", F.lit(1)))
    return entries.select("digest", salt.alias("salt"), "content", "ids").repartition("digest", "salt").sortWithinPartitions("digest", "salt").select("digest", "content", "ids")


def boundaries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, digest=sha256) -> DataFrame:
    """The index: for each distinct text its digest, number of lines, code points and Elias-Fano list of line ends."""
    return _grouped(docs, id_col, text_col, digest, False).mapInArrow(_boundaries, BOUNDARIES)


def transform(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", *, digest=sha256) -> DataFrame:
    """One example for each document: doc_id, n lines, form, prefix_chars, middle_chars, output."""
    return _grouped(docs, id_col, text_col, digest, True).mapInArrow(_examples(rules), EXAMPLES)


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text an output was made of."""
    p, s, m = map(F.lit, sentinels)
    lead = F.when(form == "spm", s).otherwise(p)
    mark = F.when(form == "spm", p).otherwise(s)
    body = F.substr(output, F.length(lead) + 1)
    one, rest = F.split_part(body, mark, F.lit(1)), F.split_part(body, mark, F.lit(2))
    two, middle = F.split_part(rest, m, F.lit(1)), F.split_part(rest, m, F.lit(2))
    return F.when(form == "plain", output).when(form == "spm", F.concat(two, middle, one)).otherwise(F.concat(one, middle, two))


def report(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    rows = transform(docs, rules)
    back = restore(F.col("output"), F.col("form"), rules.sentinels)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (SELECT *, len(u) AS n, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2, CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(x) AS restored_sha256
FROM p
"""
