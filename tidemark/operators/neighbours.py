"""Exact nearest rows without all pairs: pivots and the triangle inequality.

Rows are unit vectors, ordered by their nearest pivot and the distance to it and cut into blocks. A block knows the least
and largest distance of its rows to each pivot, so for a query with its own distances

* no row of the block is nearer than the largest gap between a query's distance and the block's range, and
* no row is farther than the least sum of a query's distance and the range's end.

The second bound gives a radius that holds k rows before anything is compared; meeting one run of blocks makes it the k-th
distance there. Then a query meets only those blocks that the first bound lets into its radius; queries of like distances
go together, and compare only rows whose own distances to the pivots may suit one of them. Ranges of at most ``REGIONS`` runs of blocks are held by every task, so
what is shipped does not grow with the table; which pivots are chosen (from a sample of ``SAMPLE`` rows) changes the work and not the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.dedup import _cut

SAMPLE, PIVOTS, REGIONS, MEET = 1024, 16, 4096, 4096
#: Queries that a block is compared with at once, alike ones: the rows that the distances to the pivots allow any of them.
#: Fewer than ``FEW`` alike ones go one by one.
TOGETHER, FEW = 64, 16
#: Distances are double precision; a bound within this share decides nothing.
SLACK = 1e-7


def unit(vectors):
    import numpy as np

    x = np.stack([np.asarray(v, float) for v in vectors])
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def distances(x, y):
    import numpy as np

    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T))


def pick_pivots(x, n: int):
    """Rows, each the farthest from those before it."""
    import numpy as np

    chosen = [int(((x - x.mean(0)) ** 2).sum(1).argmax())]
    far = distances(x, x[chosen])[:, 0]
    while len(chosen) < min(n, len(x)) and far.max() > 1e-6:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def _blocks(rows: DataFrame, pivots, carry: list[str], block_rows: int, n: int, regions: int) -> DataFrame:
    import numpy as np
    import pandas as pd

    kind = dict(rows.dtypes)["doc_id"]
    plain = f"doc_id {kind}, embedding array<double>" + "".join(f", {c} double" for c in carry)
    ranges = -(-n // block_rows)
    a_region = -(-ranges // regions)

    def home(batches):
        for b in batches:
            d = distances(unit(b["embedding"]), pivots)
            yield b.assign(home=d.argmin(1).astype("int32"), away=d.min(1))

    def pack(part, task: int, at: int):
        part = part.sort_values("doc_id", kind="stable")  # smaller ids first among equals
        x = unit(part["embedding"])
        d = distances(x, pivots)
        return pd.DataFrame({
            "block": [(task << 24) + at], "region": [task // a_region], "ids": [part["doc_id"].tolist()], "x": [x.tobytes()], "d": [d.tobytes()], "low": [d.min(0).tolist()], "high": [d.max(0).tolist()],
            **{c: [part[c].to_numpy(float).tobytes()] for c in carry},
        })

    def packed(batches):
        from pyspark import TaskContext

        task, at, held = TaskContext.get().partitionId(), 0, []
        for b in batches:
            held.append(b)
            while sum(map(len, held)) >= 2 * block_rows:
                every = pd.concat(held)
                yield pack(every.iloc[:block_rows], task, at)
                held, at = [every.iloc[block_rows:]], at + 1
        if held and sum(map(len, held)):
            yield pack(pd.concat(held), task, at)

    placed = rows.select("doc_id", F.col("embedding").cast("array<double>").alias("embedding"), *[F.col(c).cast("double").alias(c) for c in carry]).mapInPandas(home, f"{plain}, home int, away double")
    placed = placed.repartitionByRange(ranges, "home", "away", F.xxhash64("doc_id"))
    out = f"block long, region long, ids array<{kind}>, x binary, d binary, low array<double>, high array<double>" + "".join(f", {c} binary" for c in carry)
    return _cut(placed.drop("home", "away").mapInPandas(packed, out))


def _routed(asked: DataFrame, pivots, runs: list, k: int, first: bool) -> DataFrame:
    """Queries (doc_id, embedding, radius) for each region they meet. ``first``: only the one with the best bound, and that
    bound as radius; a query for which no region holds k rows meets all."""
    import numpy as np
    import pandas as pd

    kind = dict(asked.dtypes)["doc_id"]
    names, sizes = np.array([r[0] for r in runs]), np.array([r[1] for r in runs])
    low, high = np.array([r[2 : 2 + len(pivots)] for r in runs], float), np.array([r[2 + len(pivots) :] for r in runs], float)

    def route(batches):
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                d = distances(unit(part["embedding"]), pivots)
                rows = []
                for doc, vector, radius, own in zip(part["doc_id"].tolist(), part["embedding"].tolist(), part["radius"].tolist(), d, strict=True):
                    if first:
                        worst = np.where(sizes >= k, (own + high).min(1), np.inf)
                        best = int(worst.argmin())
                        radius = float(worst[best])
                        meets = names[[best]] if radius < np.inf else names[:0]
                    else:
                        gap = np.maximum(np.maximum(low - own, own - high), 0).max(1)
                        meets = names[gap <= radius * (1 + SLACK) + SLACK]
                    rows += [(doc, vector, radius, region) for region in meets.tolist()]
                yield pd.DataFrame(rows, columns=["doc_id", "embedding", "radius", "region"])

    return asked.select("doc_id", "embedding", "radius").mapInPandas(route, f"doc_id {kind}, embedding array<double>, radius double, region long")


def _met(routed: DataFrame, blocks: DataFrame, pivots, carry: list[str], k: int) -> DataFrame:
    """doc_id, near (at most k of a block, within the radius) and compared (rows whose distance was computed)."""
    import numpy as np
    import pandas as pd

    kinds, held = dict(routed.dtypes), dict(blocks.dtypes)
    routed = _cut(routed)
    loads = routed.groupBy("region").agg(F.ceil(F.count("*") / F.lit(float(MEET))).cast("int").alias("parts"))
    asked = routed.join(loads, "region").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).join(blocks.select(F.col("region").alias("region"), F.col("block").alias("block")), "region")
    known = blocks.join(loads, "region").select(F.col("block").alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("own_part"), "ids", "x", "d", *carry)

    def meet(_, left, right):
        out = []
        for r in right.itertuples():
            ids, table = np.asarray(r.ids), np.frombuffer(r.d).reshape(len(r.ids), -1)
            x, more = np.frombuffer(r.x).reshape(len(ids), -1), {c: np.frombuffer(getattr(r, c)) for c in carry}
            low, high, squares = table.min(0), table.max(0), (x * x).sum(1)
            q, docs = unit(left["embedding"]), left["doc_id"].tolist()
            own, limit = distances(q, pivots), left["radius"].to_numpy(float) * (1 + SLACK) + SLACK
            met = np.flatnonzero(np.maximum(np.maximum(low - own, own - high), 0).max(1) <= limit)
            # alike ones together: of one nearest pivot and of like radius
            kind = own.argmin(1) * 4096 + np.frexp(np.minimum(limit, 8))[1]
            met = met[np.lexsort((own.min(1)[met], kind[met]))]
            runs = np.split(met, np.flatnonzero(np.diff(kind[met])) + 1)
            for c in (run[at : at + step] for run in runs for step in [TOGETHER if len(run) >= FEW else 1] for at in range(0, len(run), step)):
                reach, mine = limit[c, None], q[c]
                rows = np.flatnonzero(((table >= (own[c] - reach).min(0)) & (table <= (own[c] + reach).max(0))).all(1))
                far = squares[rows] + (mine * mine).sum(1)[:, None] - 2 * mine @ x[rows].T  # squares, to choose by
                most = limit[c] ** 2
                many = np.flatnonzero((far <= most[:, None]).sum(1) > 4 * k)
                if len(many):
                    most[many] = np.minimum(most[many], np.partition(far[many], k - 1, axis=1)[:, k - 1])
                i, j = np.nonzero(far <= (most * (1 + SLACK) + SLACK)[:, None])
                d = np.sqrt(((x[rows[j]] - mine[i]) ** 2).sum(1))
                i, j, d = (v[d <= limit[c[i]]] for v in (i, j, d))
                order = np.lexsort((j, d, i))
                ends = np.searchsorted(i[order], np.arange(len(c) + 1)).tolist()
                for n, e in enumerate(c.tolist()):
                    best = order[ends[n] : min(ends[n + 1], ends[n] + k)]
                    out.append((docs[e], [{"d": float(d[b]), "id": ids[rows[j[b]]].item() if hasattr(ids[rows[j[b]]], "item") else ids[rows[j[b]]], **{t: float(v[rows[j[b]]]) for t, v in more.items()}} for b in best], len(rows)))
        return pd.DataFrame(out, columns=["doc_id", "near", "compared"])

    kind = held["ids"].removeprefix("array<")[:-1]
    fields = f"d double, id {kind}" + "".join(f", {c} double" for c in carry)
    return asked.groupBy("block", "part").cogroup(known.groupBy("own", "own_part")).applyInPandas(meet, f"doc_id {kinds['doc_id']}, near array<struct<{fields}>>, compared long")


def nearest(queries: DataFrame, rows: DataFrame, k: int, carry: tuple[str, ...] = (), *, pivots: int = PIVOTS, block_rows: int = 2048, regions: int = REGIONS) -> DataFrame:
    """doc_id, near (the ``k`` nearest ``rows``: d, id and the numbers ``carry``, the smaller id first among equals) and compared,
    how many rows were compared for it. Both sides: doc_id and embedding, neither null; a query is found among the rows if it is one of them."""
    n = rows.count()
    if not n:
        kind = dict(rows.dtypes)["doc_id"]
        fields = f"d double, id {kind}" + "".join(f", {c} double" for c in carry)
        return queries.select("doc_id", F.array().cast(f"array<struct<{fields}>>").alias("near"), F.lit(0).cast("long").alias("compared"))
    sample = [r.embedding for r in rows.orderBy(F.xxhash64("doc_id")).limit(SAMPLE).select("embedding").collect()]
    chosen = pick_pivots(unit(sample), pivots)
    blocks = _blocks(rows, chosen, list(carry), block_rows, n, regions)
    ends = [f(F.col(c)[i]) for f, c in ((F.min, "low"), (F.max, "high")) for i in range(len(chosen))]
    runs = [tuple(r) for r in blocks.groupBy("region").agg(F.sum(F.size("ids")), *ends).collect()]  # at most ``regions`` rows
    asked = _cut(queries.select("doc_id", F.col("embedding").cast("array<double>").alias("embedding"), F.lit(float("inf")).alias("radius")))
    first = _routed(asked, chosen, runs, k, True)
    kth = lambda: F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k)
    seen = _met(first, blocks, chosen, list(carry), k).groupBy("doc_id").agg(kth().alias("n"), F.sum("compared").alias("before"))
    seen = _cut(seen.select("doc_id", F.when(F.size("n") == k, F.col("n")[k - 1]["d"]).alias("found"), "before"))
    asked = _cut(asked.join(seen, "doc_id", "left").withColumn("radius", F.coalesce("found", "radius")))
    second = _met(_routed(asked, chosen, runs, k, False), blocks, chosen, list(carry), k)
    out = second.groupBy("doc_id").agg(kth().alias("near"), F.sum("compared").alias("compared"))
    return out.join(asked.select("doc_id", "before"), "doc_id").select("doc_id", "near", (F.col("compared") + F.coalesce("before", F.lit(0))).alias("compared"))
