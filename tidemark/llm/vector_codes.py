"""Product codes of vectors by Lloyd rounds over partition-local heaps.

Vectors are cut into equal consecutive parts; each part position has a codebook. An entry
keeps, in every block of ``BLOCK`` rows, a heap of the parts assigned to it. A part's key is its slack:
a lower bound of the distance to any other entry minus an upper bound of the distance to its own.
When entries move, the bounds of a part that belongs to entry e worsen by the way of e and the longest way of
another entry at most. The sum of both over the rounds is the drift of e; instead of touching every
part, keys are stored plus the drift at the time. Parts whose key is at or below
today's drift are popped, compared with the whole codebook exactly and pushed anew; all others keep their entry, for
certain. Where slack and drift are equal the part is popped, so a tie is always settled by comparison.

A round reads the blocks, pops, and writes them again with their heaps to the shared folder, so a lost executor costs
a reread. What goes to the driver is a sum and count for each entry: parts that changed entry are added here and subtracted there.

Defined results. Null vectors and those with null, NaN or infinite components are dropped; shorter vectors
count as ending in zeros, up to a multiple of ``parts``. The first codebook is made of the rows of smallest id (a null id is
the largest; equal ids by their vectors); with fewer rows it has fewer entries. Repeated rows count as often as they stand there.
Equal distances go to the lower index; an entry without parts stays as it is. Labels are equal as strings, nulls together.
An empty table gives an empty one. Components so large that a sum of squared distances would not fit a
long raise ``ValueError``. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_salted, store
from tidemark.llm.vectors import as_integers, extent, packed

BLOCK = 4096
#: Distances are square roots of integers in double precision; slack below this share of the longest is no slack.
ROUNDING = 1e-9

STATE = "ids array<long>, labels array<string>, x binary, codes binary, keys binary, rows binary, sizes binary, moved binary"
CODES = "vec_id long, label string, code string, error long"

_state = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), *((n, pa.binary()) for n in ("x", "codes", "keys", "rows", "sizes", "moved"))])
_sums = pa.schema([("at", pa.int32()), ("total", pa.int64())])
_codes = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])


def compare(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry of each part (ties to the lower), the distance to it and to the nearest other."""
    squared = (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)
    code = squared.argmin(1)
    at = np.arange(len(x))
    own = np.sqrt(squared[at, code].astype(np.float64))
    if len(book) == 1:
        return code, own, np.full(len(x), np.inf)
    squared[at, code] = np.iinfo(np.int64).max
    return code, own, np.sqrt(squared.min(1).astype(np.float64))


class Block:
    """Rows with their codes and, for each part position and entry, a heap of (key, row)."""

    def __init__(self, x: np.ndarray, codes: np.ndarray, heaps: list[list[list[tuple[float, int]]]]):
        self.x, self.codes, self.heaps = x, codes, heaps

    @classmethod
    def first(cls, x: np.ndarray, books: np.ndarray) -> Block:
        """x: (rows, positions, width); books: (positions, entries, width). No part has an entry yet: all will be popped."""
        n, positions, _ = x.shape
        start = [[[(-np.inf, row) for row in range(n)], *([] for _ in range(books.shape[1] - 1))] for _ in range(positions)]
        return cls(x, np.full((n, positions), -1, np.int16), start)

    def settle(self, books: np.ndarray, drift: np.ndarray, least: float) -> np.ndarray:
        """Pop and rescan what the drift allows to change; returns the change of (sums, count) by position and entry."""
        positions, entries, width = books.shape
        moved = np.zeros((positions, entries, width + 1), np.int64)
        for p, book in enumerate(books):
            popped = []
            for e, heap in enumerate(self.heaps[p]):
                while heap and heap[0][0] <= drift[p, e] + least:
                    popped.append(heapq.heappop(heap)[1])
            if not popped:
                continue
            rows = np.array(popped)
            parts = self.x[rows, p]
            code, own, other = compare(parts, book)
            keys = other - own + drift[p, code]
            before = self.codes[rows, p]
            change = code != before
            counted = np.hstack([parts, np.ones((len(rows), 1), np.int64)])
            np.add.at(moved[p], code[change], counted[change])
            had = change & (before >= 0)
            np.subtract.at(moved[p], before[had], counted[had])
            self.codes[rows, p] = code
            fresh = [[] for _ in range(entries)]
            for e, key, row in zip(code.tolist(), keys.tolist(), popped, strict=True):
                fresh[e].append((key, row))
            for heap, more in zip(self.heaps[p], fresh, strict=True):
                if not heap:
                    heapq.heapify(more)
                    heap.extend(more)
                else:
                    for item in more:
                        heapq.heappush(heap, item)
        return moved

    def errors(self, books: np.ndarray) -> np.ndarray:
        away = self.x - books[np.arange(books.shape[0]), self.codes]
        return (away * away).sum((1, 2))

    def dump(self, kind: str) -> dict[str, bytes]:
        flat = [item for position in self.heaps for heap in position for item in heap]
        return {
            "x": self.x.astype(kind).tobytes(), "codes": self.codes.tobytes(), "keys": np.array([k for k, _ in flat], np.float64).tobytes(),
            "rows": np.array([r for _, r in flat], np.int32).tobytes(), "sizes": np.array([[len(h) for h in position] for position in self.heaps], np.int32).tobytes(),
        }

    @classmethod
    def load(cls, row: dict, shape: tuple[int, int, int], kind: str) -> Block:
        """A heap stays one when its items are stored in their order. shape: of the codebooks."""
        positions, entries, width = shape
        x = np.frombuffer(row["x"], kind).reshape(-1, positions, width).astype(np.int64)
        items = list(zip(np.frombuffer(row["keys"], np.float64).tolist(), np.frombuffer(row["rows"], np.int32).tolist(), strict=True))
        ends = np.cumsum(np.frombuffer(row["sizes"], np.int32)).tolist()
        cut = [items[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        heaps = [cut[p * entries : (p + 1) * entries] for p in range(positions)]
        return cls(x, np.frombuffer(row["codes"], np.int16).reshape(-1, positions).copy(), heaps)


def _start(books: np.ndarray, kind: str, drift: np.ndarray, least: float, block: int):
    """mapInArrow body: rows to blocks after their first comparison."""
    positions, _, width = books.shape

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                own = Block.first(packed(part.column("v"), positions * width).reshape(-1, positions, width), books)
                moved = own.settle(books, drift, least)
                row = {"ids": part.column("id").to_pylist(), "labels": part.column("label").to_pylist(), "moved": moved.tobytes()} | own.dump(kind)
                yield pa.RecordBatch.from_pylist([row], schema=_state)

    return run


def _again(books: np.ndarray, kind: str, drift: np.ndarray, least: float, last: bool):
    """mapInArrow body: blocks after the next comparison; their rows' codes after the last."""

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                own = Block.load(row, books.shape, kind)
                moved = own.settle(books, drift, least)
                if not last:
                    yield pa.RecordBatch.from_pylist([row | {"moved": moved.tobytes()} | own.dump(kind)], schema=_state)
                    continue
                digits = "02x" if books.shape[1] <= 256 else "04x"
                codes = ["".join(format(c, digits) for c in line) for line in own.codes.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["labels"], pa.string()), pa.array(codes), pa.array(own.errors(books))], schema=_codes)

    return run


def _add_up(batches):
    total = None
    for batch in batches:
        for moved in batch.column(0).to_pylist():
            change = np.frombuffer(moved, np.int64)
            total = change.copy() if total is None else total + change
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], schema=_sums)


def _change(state: DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    """Sum of all blocks' changes; as many numbers as the codebooks have, and a count each."""
    rows = state.select("moved").mapInArrow(_add_up, "at int, total long").groupBy("at").agg(F.sum("total").alias("total")).collect()
    out = np.zeros(shape[0] * shape[1] * (shape[2] + 1), np.int64)
    for row in rows:
        out[row["at"]] = row.total
    return out.reshape(shape[0], shape[1], shape[2] + 1)


def moved_books(books: np.ndarray, sums: np.ndarray) -> np.ndarray:
    count = sums[:, :, -1:]
    return np.where(count > 0, np.floor_divide(sums[:, :, :-1], np.maximum(count, 1)), books)


def drifts(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How much the slack of a part of each entry may have shrunk: the entry's own way and the longest way of another."""
    way = np.sqrt(((new - old) ** 2).sum(2).astype(np.float64))
    if way.shape[1] == 1:
        return way
    top = np.sort(way, axis=1)[:, -2:]
    others = np.where(way == top[:, 1:], np.where((way == top[:, 1:]).sum(1, keepdims=True) > 1, top[:, 1:], top[:, :1]), top[:, 1:])
    return way + others


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """Rows of (vec_id, label as string, code, error) in a stored table, and the final codebooks (parts, entries, width)."""
    spark = vectors.sparkSession
    rows = as_integers(vectors, vector_col, scale, id=F.col(id_col).cast("long"), label=F.col(label_col).cast("string"))
    n, longest, largest = extent(rows)
    width = max(1, -(-longest // parts))
    if not n:
        return spark.createDataFrame([], CODES), np.zeros((parts, 0, width), np.int64)
    if n * parts * width * (2 * largest) ** 2 >= 1 << 63 or entries > 1 << 15:
        raise ValueError(f"{n} vectors with components up to {largest} after scaling: sums would not fit a long")
    seeds = rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()
    first = np.zeros((len(seeds), parts * width), np.int64)
    for at, row in enumerate(seeds):
        first[at, : len(row.v)] = row.v
    books = np.ascontiguousarray(first.reshape(-1, parts, width).transpose(1, 0, 2))
    kind = "int32" if largest < 1 << 31 else "int64"
    least = ROUNDING * (1 + 2 * largest * width**0.5)
    drift = np.zeros(books.shape[:2])
    sums = np.zeros((*books.shape[:2], width + 1), np.int64)
    state = None
    for r in range(rounds + 1):
        if state is None:
            step = rows.mapInArrow(_start(books, kind, drift, least, block), STATE)
        else:
            step = state.mapInArrow(_again(books, kind, drift, least, r == rounds), CODES if r == rounds else STATE)
        if r < rounds:
            state = store(step)
            sums = sums + _change(state, books.shape)
            new = moved_books(books, sums)
            drift, books = drift + drifts(books, new), new
        elif state is None:  # no rounds: the first codebooks are the final ones
            step = store(step).mapInArrow(_again(books, kind, drift, least, True), CODES)
    return store(step), books


def codes(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector that takes part."""
    rows, books = encode(vectors, **options)
    rows = rows.withColumn("_key", F.coalesce(F.concat(F.lit("="), "label"), F.lit("null")))
    labels = rows.groupBy("_key").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n"))
    out = join_salted(rows, labels, "_key", "_n", "vec_id")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle(rounds: int = 2) -> str:
    text = """
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
  SELECT vec_id, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS place
  FROM kept, (SELECT unnest(range(16)) AS p)),
book0 AS (SELECT p, place AS e, x AS c FROM parts WHERE place < 64)"""
    for r in range(rounds + 1):
        text += f""",
near{r} AS (
  SELECT vec_id, p, any_value(x) AS x, arg_min(e, d * 64 + e) AS e, min(d) AS d
  FROM (SELECT t.*, b.e, list_dot_product(t.x, t.x) - 2 * list_dot_product(t.x, b.c) + list_dot_product(b.c, b.c) AS d FROM parts t JOIN book{r} b USING (p))
  GROUP BY vec_id, p)"""
        if r < rounds:
            text += f""",
mean{r} AS (
  SELECT p, e, list(m ORDER BY i) AS c FROM (
    SELECT p, e, i, floor(sum(y) / count(*)) AS m FROM (SELECT p, e, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM near{r}) GROUP BY p, e, i)
  GROUP BY p, e),
book{r + 1} AS (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m USING (p, e))"""
    return text + f""",
digest AS (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(c) AS y, generate_subscripts(c, 1) AS i FROM book{rounds})),
coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), digest
"""


ORACLE = _oracle()
