"""Exact top-k search by inner product with a table of distances to pivots.

Inner product becomes distance: a row x gets one more coordinate sqrt(M - |x|^2), where M
bounds every squared norm, and a query gets 0 there. Then |q - x|^2 = |q|^2 + M - 2 q.x, so
the nearest rows are those of the largest inner product. The distances of each row to the
pivots are computed once and kept beside it. By the triangle inequality the largest
difference of a query's and a row's distances to a pivot is a lower bound of their distance.

1. Pivots are picked farthest first from a sample (``SAMPLE`` rows of smallest hash). They
   decide how much is eliminated, never what is found.
2. Rows are ordered by their nearest pivot and the distance to it and written in groups of about
   ``group_rows``, with their table and its ranges. A query is itself a row of a group: the k-th
   best score of its own group is a floor under its final k-th score.
3. A query goes to those groups alone whose ranges allow its floor. The ranges that are broadcast
   are those of at most ``REGIONS`` runs of groups, so their size does not grow with the table.
4. Where a query meets a group, rows are evaluated in the order of their bounds, until the next bound is
   below the k-th best score. At most ``MEET`` queries meet a group in one task; more are further tasks.
5. The best k of a query's lists are its result.

Bounds are rounded so that floating point never eliminates a row; scores are exact integers.

Defined results. Null vectors and those with null, NaN or infinite components take no part; shorter
vectors count as ending in zeros. Ties go to the smaller id, a null id last. Every row but the
query's own is a candidate: a repeated row is one more candidate, and one more query, and can find its copy.
A query with fewer than k candidates gets all. A null id is no query unless ``query`` says so.
An empty table, or one without queries, gives an empty result. Components so large that a
score would not fit a long raise ``ValueError``. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import store
from tidemark.llm.vectors import as_integers, extent, packed

SAMPLE = 2048
PIVOTS = 32
GROUP_ROWS = 8192
REGIONS = 2048
MEET = 8192
LOWEST = -(1 << 63)
#: Relative error of distances kept as 32-bit floats, with much to spare.
ROUNDING = 1e-6

RESULT = "query_id long, rank int, vec_id long, score long"


class Space:
    """Distances in the space with the added coordinate. ``pivots``: rows of integers."""

    def __init__(self, pivots: np.ndarray, bound: float):
        self.pivots, self.bound = pivots.astype(np.float64), float(bound)
        self.norms = (self.pivots**2).sum(1)
        self.extra = np.sqrt(np.maximum(self.bound - self.norms, 0))

    def _to_pivots(self, x: np.ndarray, extra) -> np.ndarray:
        x = x.astype(np.float64)
        plain = (x**2).sum(1)[:, None] + self.norms - 2 * (x @ self.pivots.T)
        return np.sqrt(np.maximum(plain + (extra - self.extra) ** 2, 0))

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        own = np.sqrt(np.maximum(self.bound - (x.astype(np.float64) ** 2).sum(1), 0))
        return self._to_pivots(x, own[:, None])

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        return self._to_pivots(q, 0.0)

    def most(self, q: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Upper bound of q.x where ``low`` is a lower bound of the distance."""
        norm = float((q.astype(np.float64) ** 2).sum())
        slack = 1 + ROUNDING * (norm**0.5 + self.bound**0.5) ** 2
        return (norm + self.bound - low.astype(np.float64) ** 2) / 2 + slack


def farthest_first(rows: np.ndarray, n: int, bound: float) -> np.ndarray:
    """At most ``n`` distinct rows, each the farthest from those before it."""
    space = Space(rows, bound)
    points = np.hstack([space.pivots, space.extra[:, None]])
    far = ((points - points.mean(0)) ** 2).sum(1)
    chosen = []
    while len(chosen) < min(n, len(rows)) and (not chosen or far.max() > 0):
        chosen.append(int(far.argmax()))
        away = ((points - points[chosen[-1]]) ** 2).sum(1)
        far = away if len(chosen) == 1 else np.minimum(far, away)
    return rows[chosen]


def ordered(scores: np.ndarray, ids: np.ndarray, nameless: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score, then smallest id, a null id last."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], nameless[some], -scores[some]))][:k]
    return np.lexsort((ids, nameless, -scores))[:k]


def evaluate(q: np.ndarray, most: np.ndarray, floor: int, x: np.ndarray, ids: np.ndarray, nameless: np.ndarray, k: int):
    """Best k rows of ``x`` for ``q`` with a score of ``floor`` at least, and how many were evaluated."""
    order = np.flatnonzero(most >= floor)
    order = order[np.argsort(-most[order], kind="stable")]
    best, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    at, step = 0, 4 * k
    while at < len(order):
        if most[order[at]] < (max(floor, scores[-1]) if len(best) == k else floor):
            break
        part = order[at : at + step]
        best, scores = np.append(best, part), np.append(scores, x[part] @ q)
        first = ordered(scores, ids[best], nameless[best], k)
        best, scores = best[first], scores[first]
        at, step = at + step, 2 * step
    stays = scores >= floor
    return best[stays], scores[stays], min(at, len(order))


GROUP = "group long, region long, ids array<long>, rows binary, distances binary, low array<float>, high array<float>, asks binary, floors binary"
VISIT = "region long, from_group long, place int, query_id long, vector binary, floor long"
FOUND = "from_group long, place int, query_id long, vec_id long, score long"


def _columns(ids) -> tuple[np.ndarray, np.ndarray]:
    """Ids without nulls, and which were null."""
    nameless = np.asarray(ids.is_null().to_numpy(zero_copy_only=False), bool)
    return ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), nameless


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<float>": pa.list_(pa.float32())}
    return pa.schema([(n, kinds[t]) for n, t in (x.split(" ", 1) for x in ddl.split(", "))])


def _home(space: Space, width: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                near = space.of_rows(packed(batch.column("v"), width))
                home = near.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32)), pa.array(near[np.arange(len(home)), home])], names=[*batch.schema.names, "home", "near"])

    return run


def _floors(x: np.ndarray, asks: np.ndarray, k: int, small: bool) -> np.ndarray:
    """The k-th best score of each asking row among the others."""
    out = np.full(len(asks), LOWEST, np.int64)
    if len(x) <= k:
        return out
    rows = x.astype(np.float64) if small else x
    for at in range(0, len(asks), 256):
        part = asks[at : at + 256]
        scores = rows[part] @ rows.T
        scores[np.arange(len(part)), part] = -np.inf if small else LOWEST
        out[at : at + 256] = np.partition(scores, len(x) - k, axis=1)[:, len(x) - k].astype(np.int64)
    return out


def _group(space: Space, width: int, k: int, kind: str, small: bool, group_rows: int, groups_a_region: int):
    """mapInArrow body: rows of one range to groups with their table of distances."""

    schema = _schema(GROUP)

    def pack(part: pa.Table, group: int, region: int):
        x = packed(part.column("v"), width)
        near = space.of_rows(x).astype(np.float32)
        asks = np.flatnonzero(part.column("asks").to_numpy()).astype(np.int32)
        out = {
            "group": [group], "region": [region], "ids": [part.column("id").to_pylist()], "rows": [x.astype(kind).tobytes()], "distances": [near.tobytes()],
            "low": [near.min(0).tolist()], "high": [near.max(0).tolist()], "asks": [asks.tobytes()], "floors": [_floors(x, asks, k, small).tobytes()],
        }
        return pa.RecordBatch.from_pydict(out, schema=schema)

    def run(batches):
        from pyspark import TaskContext

        task, part, held, n = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            held.append(batch.select(["id", "v", "asks"]))
            n += batch.num_rows
            while n >= 2 * group_rows:
                every = pa.Table.from_batches(held)
                yield pack(every.slice(0, group_rows), (task << 24) + part, task // groups_a_region)
                held, n, part = every.slice(group_rows).to_batches(), n - group_rows, part + 1
        if n:
            yield pack(pa.Table.from_batches(held), (task << 24) + part, task // groups_a_region)

    return run


def _visits(space: Space, width: int, kind: str, regions: np.ndarray, low: np.ndarray, high: np.ndarray):
    """mapInArrow body: the queries of each group, once for each region that may hold one of their best."""

    schema = _schema(VISIT)

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                group, ids, rows, asks, floors = (batch.column(c)[at] for c in ("group", "ids", "rows", "asks", "floors"))
                places, least = np.frombuffer(asks.as_py(), np.int32), np.frombuffer(floors.as_py(), np.int64)
                if not len(places):
                    continue
                x = np.frombuffer(rows.as_py(), kind).reshape(len(ids), width)
                far = space.of_queries(x[places])
                out = {n: [] for n in schema.names}
                for place, floor, away in zip(places.tolist(), least.tolist(), far, strict=True):
                    gap = np.maximum(np.maximum(low - away, away - high), 0).max(1)
                    for region in regions[space.most(x[place], gap) >= floor].tolist():
                        for name, value in zip(schema.names, (region, group.as_py(), place, ids[place].as_py(), x[place].tobytes(), floor), strict=True):
                            out[name].append(value)
                    if len(out["place"]) >= 4096:
                        yield pa.RecordBatch.from_pydict(out, schema=schema)
                        out = {n: [] for n in schema.names}
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


def _meet(space: Space, width: int, kind: str, k: int):
    """cogroup body: one group and the queries that visit it."""

    schema = _schema(FOUND)

    def run(_, visits: pa.Table, groups: pa.Table) -> pa.Table:
        out = {n: [] for n in schema.names}
        for g in range(groups.num_rows if visits.num_rows else 0):
            group = groups.column("own")[g].as_py()
            ids, nameless = _columns(groups.column("ids")[g].values)
            x = np.frombuffer(groups.column("rows")[g].as_py(), kind).reshape(len(ids), width).astype(np.int64)
            near = np.frombuffer(groups.column("distances")[g].as_py(), np.float32).reshape(len(ids), -1)
            low, high = near.min(0), near.max(0)
            for visit in visits.select(["from_group", "place", "query_id", "vector", "floor"]).to_pylist():
                q = np.frombuffer(visit["vector"], kind).astype(np.int64)
                away = space.of_queries(q[None])[0]
                if space.most(q, np.maximum(np.maximum(low - away, away - high), 0).max()) < visit["floor"]:
                    continue
                most = space.most(q, np.abs(near - away.astype(np.float32)).max(1))
                if visit["from_group"] == group:
                    most[visit["place"]] = -np.inf  # the query's own row
                best, scores, _ = evaluate(q, most, visit["floor"], x, ids, nameless, k)
                out["from_group"] += [visit["from_group"]] * len(best)
                out["place"] += [visit["place"]] * len(best)
                out["query_id"] += [visit["query_id"]] * len(best)
                out["vec_id"] += [None if nameless[b] else int(ids[b]) for b in best]
                out["score"] += scores.tolist()
        return pa.Table.from_pydict(out, schema=schema)

    return run


def search(vectors: DataFrame, query: Column, k: int = 10, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, pivots: int = PIVOTS, group_rows: int = GROUP_ROWS, regions: int = REGIONS) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best rows for every row of which ``query`` holds."""
    spark = vectors.sparkSession
    rows = as_integers(vectors, vector_col, scale, id=F.col(id_col).cast("long"), asks=F.coalesce(query, F.lit(False)))
    n, width, largest = extent(rows)
    if not n:
        return spark.createDataFrame([], RESULT)
    if width * largest**2 >= 1 << 63:
        raise ValueError(f"components up to {largest} after scaling: scores would not fit a long")
    kind, small = ("int32" if largest < 1 << 31 else "int64"), width * largest**2 < 1 << 53
    norm = F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    bound = (rows.agg(norm).head()[0] or 0.0) * (1 + 1e-9)
    sample = rows.orderBy(F.xxhash64("id", "v")).limit(SAMPLE).select("v").collect()
    points = np.zeros((len(sample), width), np.int64)
    for at, row in enumerate(sample):
        points[at, : len(row.v)] = row.v
    space = Space(farthest_first(points, pivots, bound), bound)
    ranges = -(-n // group_rows)
    placed = rows.mapInArrow(_home(space, width), "id long, asks boolean, v array<long>, home int, near double")
    placed = placed.repartitionByRange(ranges, "home", "near", F.xxhash64("id", F.monotonically_increasing_id()))
    index = store(placed.mapInArrow(_group(space, width, k, kind, small, group_rows, -(-ranges // regions)), GROUP))
    ends = [f(F.col(c)[i]) for f, c in ((F.min, "low"), (F.max, "high")) for i in range(len(space.pivots))]
    found = np.array([tuple(r) for r in index.groupBy("region").agg(*ends).collect()], np.float64)
    low, high = np.hsplit(found[:, 1:], 2)
    visits = store(index.mapInArrow(_visits(space, width, kind, found[:, 0].astype(np.int64), low, high), VISIT))
    loads = visits.groupBy("region").agg(F.ceil(F.count("*") / F.lit(float(MEET))).cast("int").alias("parts"))
    dealt = index.select("group", "region", "ids", "rows", "distances").join(loads, "region")
    dealt = dealt.select(F.col("group").alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("own_part"), "ids", "rows", "distances")
    asked = visits.join(loads, "region").withColumn("part", F.pmod(F.xxhash64("from_group", "place"), F.col("parts")).cast("int"))
    asked = asked.join(index.select(F.col("region").alias("region"), F.col("group").alias("group")), "region")
    met = asked.groupBy("group", "part").cogroup(dealt.groupBy("own", "own_part")).applyInArrow(_meet(space, width, kind, k), FOUND)
    best = Window.partitionBy("from_group", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id IS DISTINCT FROM q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
