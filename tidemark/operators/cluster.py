"""Topic clusters: aggregates, id reconciliation, online assignment, density clustering."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import ClusterConfig
from tidemark.operators import neighbours, vectors
from tidemark.operators.dedup import _cut
from tidemark.operators.ranking import ntz


#: Clusters whose ids may be broadcast.
MANY = 100_000


def enrich(members: DataFrame, now: dt.datetime, config: ClusterConfig | None = None) -> DataFrame:
    """cluster_id and its counts; ``members``: cluster_id, doc_id, author_id, source_type, reach, created_at, region."""
    c = config or ClusterConfig()
    recent, previous = ntz(now - dt.timedelta(hours=c.growth_hours)), ntz(now - dt.timedelta(hours=2 * c.growth_hours))
    t = F.col("created_at")
    return members.groupBy("cluster_id").agg(
        F.count("*").alias("size"), F.count_distinct("author_id").alias("unique_authors"), F.count_distinct("source_type").alias("unique_sources"), F.sum("reach").alias("reach_total"),
        F.min(t).alias("earliest_doc_at"), F.max(t).alias("latest_doc_at"),
        F.array_sort(F.collect_set(F.when(F.col("region") != "", F.col("region")))).alias("geo_regions"),
        (F.count_if(t >= recent) / F.greatest(F.count_if((t >= previous) & (t < recent)), F.lit(1))).alias("growth_rate"),
    )


def run_metrics(clusters: DataFrame) -> DataFrame:
    """``clusters``: size, noise, cohesion_score."""
    n = F.sum("size")
    noise = F.coalesce(F.sum(F.when(F.col("noise"), F.col("size"))), F.lit(0))
    return clusters.agg(
        n.alias("n_documents"), F.count_if(~F.col("noise")).alias("n_clusters"), noise.alias("n_noise"),
        F.when(n > 0, noise / n).otherwise(0.0).alias("noise_ratio"), F.coalesce(F.avg(F.when(~F.col("noise"), F.col("cohesion_score"))), F.lit(0.0)).alias("avg_cohesion"),
    )


def candidate_matches(new: DataFrame, old: DataFrame, threshold: float, max_old: int = 10_000) -> DataFrame:
    """(new_id, old_id, similarity) at or above the threshold; ``old`` is a list of clusters, and its size is checked."""
    if old.limit(max_old + 1).count() > max_old:
        raise ValueError(f"more than {max_old} clusters to match with: raise max_old")
    pairs = new.select(F.col("cluster_id").alias("new_id"), F.col("centroid").alias("a")).join(
        F.broadcast(old.select(F.col("cluster_id").alias("old_id"), F.col("centroid").alias("b"))), vectors.cosine(F.col("a"), F.col("b")) >= threshold
    )
    return pairs.select("new_id", "old_id", vectors.cosine(F.col("a"), F.col("b")).alias("similarity"))


def reconcile(new: DataFrame, old: DataFrame, config: ClusterConfig | None = None) -> DataFrame:
    """(new_id, old_id, similarity): greedy matching, best pair first. A pair that is the best left
    for both of its ends is the one the greedy order would take, so all such pairs are taken at
    once, round by round until none is left; the rows are clusters, so a round is small."""
    c = config or ClusterConfig()
    left = _cut(candidate_matches(new, old, c.reconcile_threshold))
    taken = None
    while True:
        key = F.struct("similarity", "new_id", "old_id")
        by_new = left.groupBy("new_id").agg(F.max(key).alias("k"))
        by_old = left.groupBy("old_id").agg(F.max(key).alias("k"))
        mutual = by_new.join(by_old, "k").select("k.new_id", "k.old_id", "k.similarity")
        mutual = _cut(mutual)
        if mutual.isEmpty():
            break
        taken = mutual if taken is None else taken.unionByName(mutual)
        left = left.join(mutual.select("new_id"), "new_id", "left_anti").join(mutual.select("old_id"), "old_id", "left_anti")
        left = _cut(left)
    return taken if taken is not None else left


def unassigned(docs: DataFrame, assigned: DataFrame, buffered: DataFrame, since=None) -> DataFrame:
    rows = docs if since is None else docs.filter(F.col("created_at") > since)
    return rows.join(assigned.select("doc_id"), "doc_id", "left_anti").join(buffered.select("doc_id"), "doc_id", "left_anti")


def assign_online(docs: DataFrame, cents: DataFrame, config: ClusterConfig | None = None, max_clusters: int = 10_000) -> DataFrame:
    """doc_id, cluster_id, strength, assigned. Strength is the cosine to the nearest centroid;
    only strictly more than the threshold assigns, the rest waits in the buffer."""
    c = config or ClusterConfig()
    if cents.limit(max_clusters + 1).count() > max_clusters:
        raise ValueError(f"more than {max_clusters} clusters to assign to: raise max_clusters")
    # all centroids are one row, so documents are neither multiplied nor shuffled
    one = cents.agg(F.collect_list(F.struct("cluster_id", "centroid")).alias("all"))
    rows = docs.select("doc_id", vectors.normalised(F.col("embedding")).alias("e")).join(F.broadcast(one)).filter(F.size("all") > 0)
    near = F.transform("all", lambda c: F.struct(vectors.dot(F.col("e"), c["centroid"]).alias("s"), (-c["cluster_id"]).alias("c")))
    best = rows.select("doc_id", F.array_max(near).alias("b"))
    strength = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("b.s")))
    return best.select("doc_id", (-F.col("b.c")).alias("cluster_id"), strength.alias("strength"), (strength > c.assignment_threshold).alias("assigned"))


def hdbscan(points, min_cluster_size: int = 10, min_samples: int = 5):
    """Labels (-1 is noise) and strengths by density: core distances, mutual reachability, its
    minimum spanning tree, the condensed tree, and the clusters with the most excess of mass."""
    import numpy as np

    x = np.asarray(points, float)
    if len(x) < max(2, min_cluster_size):
        return np.full(len(x), -1), np.zeros(len(x))
    edges, _ = spanning_tree(x, min_samples)
    found = condensed(edges, len(x), min_cluster_size)
    return found["label"], found["strength"]


def spanning_tree(x, min_samples: int):
    """(edges (distance, a, b) of the minimum spanning tree by mutual reachability, core distances)."""
    import numpy as np

    n = len(x)
    squares = (x * x).sum(1)
    row = lambda i: np.sqrt(np.maximum(0, squares + squares[i] - 2 * x @ x[i]))
    k = min(min_samples, n - 1)
    core = np.array([np.partition(row(i), k)[k] for i in range(n)])
    far, via, inside = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool)
    edges, at = [], 0
    for _ in range(n - 1):
        inside[at] = True
        d = np.maximum(np.maximum(row(at), core), core[at])
        closer = ~inside & (d < far)
        far[closer], via[closer] = d[closer], at
        nxt = int(np.argmin(np.where(inside, np.inf, far)))
        edges.append((far[nxt], via[nxt], nxt))
        at = nxt
    return edges, core


#: what a node keeps of the condensed tree: its label and strength, the density at which it leaves
#: the tree, and the densities at which its cluster is born and at which the last of it leaves
TREE = "label int, strength double, leaves double, birth double, top double"


def condensed(edges, n: int, min_cluster_size: int) -> dict:
    """The columns of ``TREE`` from the spanning tree's edges (distance, a, b) over nodes 0 to n - 1."""
    import numpy as np

    labels, strength = np.full(n, -1), np.zeros(n)
    leave, birth, tops = np.zeros(n), np.zeros(n), np.zeros(n)
    edges = sorted(edges, key=lambda e: e[0])
    # single linkage: node n + i joins two nodes at a distance
    parent = list(range(2 * n - 1))
    size = [1] * n + [0] * (n - 1)
    kids: dict[int, tuple[int, int, float]] = {}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for i, (d, a, b) in enumerate(edges):
        a, b = find(a), find(b)
        parent[a] = parent[b] = n + i
        size[n + i] = size[a] + size[b]
        kids[n + i] = (a, b, d)

    def leaves(node):
        out, stack = [], [node]
        while stack:
            v = stack.pop()
            if v < n:
                out.append(v)
            else:
                stack.extend(kids[v][:2])
        return out

    # condensed tree: clusters with their points' densities of leaving
    clusters = {0: {"birth": 0.0, "points": [], "kids": [], "size": n}}
    stack, fresh = [(2 * n - 2, 0)], 1
    while stack:
        node, c = stack.pop()
        if node < n:
            clusters[c]["points"].append((node, np.inf))
            continue
        a, b, d = kids[node]
        density = 1 / d if d > 0 else 1e12
        big = [v for v in (a, b) if size[v] >= min_cluster_size]
        if len(big) == 2:
            for v in big:
                clusters[fresh] = {"birth": density, "points": [], "kids": [], "size": size[v]}
                clusters[c]["kids"].append(fresh)
                stack.append((v, fresh))
                fresh += 1
        else:
            for v in (a, b):
                if v in big:
                    stack.append((v, c))
                else:
                    clusters[c]["points"] += [(p, density) for p in leaves(v)]
    stable, chosen = {}, {}
    for c in sorted(clusters, reverse=True):
        m = clusters[c]
        own = sum(min(d, 1e12) - m["birth"] for _, d in m["points"]) + sum((clusters[q]["birth"] - m["birth"]) * clusters[q]["size"] for q in m["kids"])
        below = sum(stable[q] for q in m["kids"])
        chosen[c] = c != 0 and own >= below
        stable[c] = own if chosen[c] else below
    label = 0
    stack = [(0, None)]
    while stack:
        c, under = stack.pop()
        if under is None and chosen[c]:
            own = [d for _, d in clusters[c]["points"]] + [clusters[q]["birth"] for q in clusters[c]["kids"]]
            under, label = (label, clusters[c]["birth"], min(max(own), 1e12)), label + 1
        for p, d in clusters[c]["points"]:
            leave[p] = min(d, 1e12)
            if under is not None:
                (labels[p], birth[p], tops[p]), strength[p] = under, d
        stack.extend((q, under) for q in clusters[c]["kids"])
    for v in range(label):
        own = labels == v
        top = min(strength[own].max(), 1e12)
        strength[own] = np.minimum(strength[own], top) / top if top > 0 else 1.0
    return {"label": labels.astype("int32"), "strength": strength, "leaves": leave, "birth": birth, "top": tops}


def _smallest(pdf, k: int):
    """Of a pair of blocks: for each block, its rows' k + 1 least squared distances to the other's rows."""
    import numpy as np

    rows = list(pdf.sort_values("block").itertuples())
    least = lambda d: np.ascontiguousarray(np.partition(np.pad(d, ((0, 0), (0, max(0, k + 1 - d.shape[1]))), constant_values=np.inf), k, axis=1)[:, : k + 1])
    here, there = [], []
    for _, d in _distances(_vectors(rows[0]), _vectors(rows[-1])):
        here.append(least(d))
        there.append(least(np.ascontiguousarray(d.T)))
    yield rows[0].block, np.concatenate(here)
    if len(rows) > 1:
        yield rows[1].block, least(np.concatenate(there, axis=1))


def _vectors(row):
    import numpy as np

    return np.frombuffer(row.vectors).reshape(row.n, -1)


def _distances(x, y, tile: int = 512):
    """(first row, squared distances of the next rows of x to all of y)."""
    import numpy as np

    sx, sy = (x * x).sum(1), (y * y).sum(1)
    for at in range(0, len(x), tile):
        yield at, np.maximum(0, sx[at : at + tile, None] + sy - 2 * x[at : at + tile] @ y.T)


def _joined(comp, at, rank, other):
    """Components after each took its edge of least rank: ``at`` are the components that edges leave, ``other`` those that they
    reach. Returns the new components of old ones, and the numbers of the edges taken; ranks are distinct for distinct edges."""
    import numpy as np

    n = int(comp.max()) + 1
    best = np.full(n, len(rank))
    order = np.argsort(rank, kind="stable")
    np.minimum.at(best, at[order], np.arange(len(order)))
    own = np.flatnonzero(best < len(order))
    took = order[best[own]]
    up = np.arange(n)
    up[own] = other[took]
    both = up[up] == np.arange(n)  # two that took the same edge: the lesser is the root
    up = np.where(both & (np.arange(n) < up), np.arange(n), up)
    while (up != up[up]).any():
        up = up[up]
    return up, took


def _block_forest(pdf):
    """Edges (distance, a, b) of a spanning forest of least weight of the mutual reachabilities between two blocks, or inside one."""
    import numpy as np

    rows = list(pdf.sort_values("block").itertuples())
    left, right = rows[0], rows[-1]
    core, other = np.frombuffer(left.core), np.frombuffer(right.core)
    nodes, far = np.frombuffer(left.nodes, "<i8"), np.frombuffer(right.nodes, "<i8")
    reach = np.empty((left.n, right.n))
    for at, d in _distances(_vectors(left), _vectors(right)):
        np.maximum(np.maximum(np.sqrt(d), core[at : at + len(d), None]), other, out=reach[at : at + len(d)])
    if len(rows) == 1:
        reach[np.tril_indices(left.n)] = np.inf
    n, base = (left.n, 0) if len(rows) == 1 else (left.n + right.n, left.n)
    comp, edges = np.arange(n), [np.empty((0, 3))]
    row, col = np.arange(left.n), np.arange(right.n)
    reach_ = np.ascontiguousarray(reach.T)
    j, i = reach.argmin(axis=1), reach_.argmin(axis=1)
    near, near_ = reach[row, j], reach_[col, i]

    def again(table, least, to, mine, its):
        """The nearest outside, of those whose nearest is inside by now; for the others it still is the nearest."""
        stale = np.flatnonzero(np.isfinite(least) & (mine == its[to]))
        for at in range(0, len(stale), 256):
            k = stale[at : at + 256]
            part = table[k]
            part[mine[k, None] == its] = np.inf
            to[k] = part.argmin(axis=1)
            least[k] = part[np.arange(len(k)), to[k]]

    while True:
        mine, its = comp[: left.n], comp[base:]
        again(reach, near, j, mine, its)
        again(reach_, near_, i, its, mine)
        x, y = np.concatenate([row, i]), np.concatenate([j, col])
        d, at = np.concatenate([near, near_]), np.concatenate([mine, its])
        to = np.concatenate([its[j], mine[i]])
        x, y, d, at, to = (v[np.isfinite(d)] for v in (x, y, d, at, to))
        if not len(d):
            break
        _, rank = np.unique(np.rec.fromarrays([d, x, y]), return_inverse=True)
        up, took = _joined(comp, at, rank, to)
        took = took[np.unique(rank[took], return_index=True)[1]]
        edges.append(np.column_stack([d[took], nodes[x[took]], far[y[took]]]))
        comp = up[comp]
    found = np.concatenate(edges)
    a, b = found[:, 1].astype("<i8"), found[:, 2].astype("<i8")
    return found[:, 0], np.minimum(a, b), np.maximum(a, b)


def _forest(d, a, b):
    """Numbers of the edges of a spanning forest of least weight, ties by the smaller nodes."""
    import numpy as np

    order = np.lexsort((b, a, d))
    ends = np.unique(np.concatenate([a, b]), return_inverse=True)[1].reshape(2, -1)
    x, y = ends[0][order], ends[1][order]
    comp, kept, live = np.arange(ends.max(initial=-1) + 1), [], np.arange(len(order))
    while True:
        live = live[comp[x[live]] != comp[y[live]]]
        if not len(live):
            return order[np.sort(np.concatenate([np.empty(0, int), *kept]))]
        p, q = comp[x[live]], comp[y[live]]
        up, took = _joined(comp, np.concatenate([p, q]), np.concatenate([live, live]), np.concatenate([q, p]))
        kept.append(np.unique(np.concatenate([live, live])[took]))
        comp = up[comp]


#: Blocks to a side of a group whose forests are joined in one task.
FAN = 8
#: Tasks at most over the pairs of blocks.
PAIR_TASKS = 4096


def _large_windows(docs: DataFrame, c: ClusterConfig, block_rows: int) -> DataFrame:
    """HDBSCAN where a window does not fit a task: rows are dealt to blocks, pairs of blocks give
    the core distances and then a spanning forest each. What is not in a pair's forest is in no tree, so
    the forests of ``FAN`` by ``FAN`` blocks, and of such groups, are joined until one is left. All
    pairs of rows are compared twice; only n - 1 edges of a window, no vectors, meet in one task.
    ``docs``: w, doc_id, embedding; returns w, doc_id, core and the columns of ``TREE``."""
    import numpy as np
    import pandas as pd

    kinds = dict(docs.dtypes)
    w = kinds["w"]
    sizes = docs.groupBy("w").agg(F.count("*").alias("size"), F.ceil(F.count("*") / block_rows).cast("long").alias("blocks"))
    dealt = docs.join(sizes, "w").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    local = F.row_number().over(Window.partitionBy("w", "block").orderBy("doc_id")) - 1
    rows = _cut(dealt.withColumn("node", local * F.col("blocks") + F.col("block")))

    def pack(pdf):
        x = np.stack([np.asarray(v, float) for v in pdf["embedding"]])
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        first = pdf.iloc[:1]
        nodes = pdf["node"].to_numpy("<i8")
        return first[["w", "block", "blocks", "size"]].assign(n=len(pdf), nodes=[nodes.tobytes()], vectors=[x.tobytes()])

    blocks = _cut(rows.groupBy("w", "block").applyInPandas(pack, f"w {w}, block long, blocks long, size long, n long, nodes binary, vectors binary"))

    most = blocks.agg(F.max("blocks")).head()[0] or 1
    tasks = max(1, min(most * (most + 1) // 2, PAIR_TASKS))

    def pairs(df):
        # numbers of blocks, not a join by window: its partitioning would leave all pairs of a window to one task
        met = df.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        return met.withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other")}).repartition(tasks, "w", "left", "right").groupBy("w", "left", "right")

    def whole(pdf):  # not a block that meets an empty one
        return len(pdf) == 2 or pdf["left"].iloc[0] == pdf["right"].iloc[0]

    def close(pdf):
        k = min(c.min_samples, int(pdf["size"].iloc[0]) - 1)
        found = [(b, out.tobytes()) for b, out in _smallest(pdf, k)] if whole(pdf) else []
        return pd.DataFrame({"w": [pdf["w"].iloc[0]] * len(found), "block": [b for b, _ in found], "least": [x for _, x in found], "k": k})

    def core(pdf):
        k = int(pdf["k"].iloc[0])
        each = np.concatenate([np.frombuffer(x).reshape(-1, k + 1) for x in pdf["least"]], axis=1)
        return pdf.iloc[:1][["w", "block"]].assign(core=[np.sqrt(np.partition(each, k, axis=1)[:, k]).tobytes()])

    cores = pairs(blocks).applyInPandas(close, f"w {w}, block long, least binary, k int").groupBy("w", "block").applyInPandas(core, f"w {w}, block long, core binary")
    blocks_ = _cut(blocks.join(cores, ["w", "block"]))

    def span(pdf):
        d, a, b = _block_forest(pdf) if whole(pdf) else ([], [], [])
        return pd.DataFrame({"w": [pdf["w"].iloc[0]] * len(d), "left": pdf["left"].iloc[0] // FAN, "right": pdf["right"].iloc[0] // FAN, "d": d, "a": a, "b": b})

    def fewer(pdf):
        kept = pdf.iloc[_forest(pdf["d"].to_numpy(), pdf["a"].to_numpy(), pdf["b"].to_numpy())]
        return kept.assign(left=kept["left"] // FAN, right=kept["right"] // FAN)

    kind = f"w {w}, left long, right long, d double, a long, b long"
    edges = pairs(blocks_).applyInPandas(span, kind)
    wide = -(-most // FAN)
    while True:
        edges = edges.groupBy("w", "left", "right").applyInPandas(fewer, kind)
        if wide == 1:
            break
        wide = -(-wide // FAN)

    def label(pdf):
        pdf = pdf.sort_values(["d", "a", "b"])
        nodes, flat = np.unique(pdf[["a", "b"]].to_numpy("<i8"), return_inverse=True)
        ends = flat.reshape(-1, 2)
        found = condensed(list(zip(pdf["d"].tolist(), ends[:, 0].tolist(), ends[:, 1].tolist(), strict=True)), len(nodes), c.min_cluster_size)
        return pd.DataFrame({"w": [pdf["w"].iloc[0]] * len(nodes), "node": nodes, **found})

    def core_of(batches):
        for b in batches:
            for r in b.itertuples():
                yield pd.DataFrame({"w": [r.w] * r.n, "node": np.frombuffer(r.nodes, "<i8"), "core": np.frombuffer(r.core)})

    labelled = edges.groupBy("w").applyInPandas(label, f"w {w}, node long, {TREE}")
    cores = blocks_.select("w", "n", "nodes", "core").mapInPandas(core_of, f"w {w}, node long, core double")
    return rows.join(labelled, ["w", "node"]).join(cores, ["w", "node"]).drop("embedding", "node", "block", "blocks", "size")


def density_clusters(docs: DataFrame, partition: str, config: ClusterConfig | None = None, max_rows: int = 20_000, block_rows: int = 4096) -> DataFrame:
    """(partition, doc_id, label, strength) of each partition (a recompute window). A window of at most
    ``max_rows`` is one task, since the algorithm looks at all of it; a larger one is dealt to blocks."""
    return density_model(docs, partition, config, max_rows, block_rows).select(partition, "doc_id", "label", "strength")


def density_model(docs: DataFrame, partition: str, config: ClusterConfig | None = None, max_rows: int = 20_000, block_rows: int = 4096) -> DataFrame:
    """What ``predict`` needs of each document: partition, doc_id, core (distance to its ``min_samples``-th
    neighbour) and the columns of ``TREE``. A window with fewer rows than a cluster needs is all noise."""
    c = config or ClusterConfig()

    def run(pdf):
        import numpy as np

        pdf = pdf.sort_values("doc_id")
        x = np.stack([np.asarray(v, float) for v in pdf["embedding"]])
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        if len(x) < max(2, c.min_cluster_size):
            return pdf[[partition, "doc_id"]].assign(core=0.0, label=-1, strength=0.0, leaves=0.0, birth=0.0, top=0.0)
        edges, core = spanning_tree(x, c.min_samples)
        return pdf[[partition, "doc_id"]].assign(core=core, **condensed(edges, len(x), c.min_cluster_size))

    kinds = dict(docs.dtypes)
    rows = docs.select(partition, "doc_id", "embedding")
    one_task = lambda df: df.groupBy(partition).applyInPandas(run, f"{partition} {kinds[partition]}, doc_id {kinds['doc_id']}, core double, {TREE}")
    sizes = rows.groupBy(partition).agg(F.count("*").alias("size"))
    # the windows as numbers, null included
    large = sizes.filter(F.col("size") > max_rows).select(F.col(partition).alias("window_key"))
    if large.isEmpty():
        return one_task(rows)
    large = _cut(large.withColumn("w", F.monotonically_increasing_id()))
    same = F.col(partition).eqNullSafe(F.col("window_key"))
    small = one_task(rows.join(large, same, "left_anti"))
    dealt = _large_windows(rows.join(large, same).select("w", "doc_id", "embedding"), c, block_rows)
    return small.unionByName(dealt.join(large, "w").withColumn(partition, F.col("window_key")).drop("w", "window_key"))


def predict(docs: DataFrame, model: DataFrame, config: ClusterConfig | None = None, block_rows: int = 2048) -> DataFrame:
    """doc_id, label, strength and assigned of documents that came after the model was made, as HDBSCAN's
    approximate prediction has it. ``model``: rows of ``density_model`` of one window with their embedding.

    A document's neighbours are its 2 * ``min_samples`` nearest model rows; its core distance is that to
    number ``min_samples`` (from 0). The neighbour at the least mutual reachability, the smallest doc_id
    among equals, gives the label if the document is dense enough to be in that neighbour's cluster. Only
    strictly more than the threshold assigns, the rest waits in the buffer. Neighbours are exact, without
    all pairs (``neighbours.nearest``); with an empty model each document has label -1. Rows without id or vector count
    for nothing in the model; a document without a vector has label -1, and of repeated ids one row is given."""
    c = config or ClusterConfig()
    traits = ("core", "label", "leaves", "birth", "top")
    whole = "doc_id IS NOT NULL AND embedding IS NOT NULL"
    fresh = docs.dropDuplicates(["doc_id"])
    known = model.filter(whole).select("doc_id", "embedding", *traits)
    rows = neighbours.nearest(fresh.filter(whole), known, 2 * c.min_samples, traits, block_rows=block_rows).filter(F.size("near") > 0).select("doc_id", F.col("near").alias("n"))
    own_core = F.try_element_at("n", F.greatest(F.lit(1), F.least(F.size("n"), F.lit(c.min_samples + 1))))["d"]
    reach = F.transform("n", lambda v: F.struct(F.greatest(v["d"], v["core"], F.col("own")).alias("reach"), v["id"].alias("id"), v.alias("v")))
    best = rows.withColumn("own", own_core).select("doc_id", F.array_min(reach).alias("b"))
    v, density = F.col("b.v"), F.when(F.col("b.reach") > 0, F.least(1 / F.col("b.reach"), F.lit(1e12))).otherwise(1e12)
    inside = (v["label"] >= 0) & ((density > v["birth"]) | (v["leaves"] <= density))
    strength = F.when(inside, F.when(v["top"] > 0, F.least(density, v["top"]) / v["top"]).otherwise(1.0)).otherwise(0.0)
    judged = best.select("doc_id", F.when(inside, v["label"]).otherwise(-1).cast("int").alias("label"), strength.alias("strength"))
    out = fresh.select("doc_id").join(judged, "doc_id", "left")
    return out.select("doc_id", F.coalesce("label", F.lit(-1)).alias("label"), F.coalesce("strength", F.lit(0.0)).alias("strength")).withColumn("assigned", F.col("strength") > c.assignment_threshold)


def latest_model(snapshots: DataFrame) -> DataFrame:
    """The model snapshot of the last run."""
    return snapshots.orderBy(F.desc("created_at"), F.desc("snapshot_id")).limit(1)


def recompute(docs: DataFrame, old: DataFrame, now: dt.datetime, config: ClusterConfig | None = None, *, hours: int = 72) -> dict[str, DataFrame]:
    """A full run over the documents of the last ``hours``: ``assignments``, ``clusters`` (of the kept ids: those of
    ``old``, cluster_id and centroid, that a new cluster is most alike to; other clusters get ids above all of them),
    ``metrics`` and ``changed`` (ids of the event), and what ``predict`` needs later: ``model`` and ``ids`` (label,
    cluster_id). ``docs`` as for ``enrich``, with embedding; noise has cluster -1."""
    c = config or ClusterConfig()
    inside = docs.filter(F.col("created_at").between(ntz(now - dt.timedelta(hours=hours)), ntz(now)))
    model = _cut(density_model(inside.withColumn("window", F.lit(0)), "window", c).drop("window"))
    labels = model.select("doc_id", F.col("label").alias("new_id"))
    found = inside.drop("cluster_id").join(labels, "doc_id")
    new = _cut(vectors.centroids(found.filter("new_id >= 0").withColumnRenamed("new_id", "cluster_id"), "cluster_id"))
    match = _cut(reconcile(new, old, c).select("new_id", "old_id"))
    above = F.broadcast(old.agg(F.coalesce(F.max("cluster_id") + 1, F.lit(0)).alias("base")))  # one row
    named = new.select(F.col("cluster_id").alias("new_id")).join(match, "new_id", "left").crossJoin(above)  # clusters, with one row on the right
    ids = _cut(named.select(F.col("new_id").alias("label"), F.coalesce("old_id", F.col("new_id") + F.col("base")).cast("long").alias("cluster_id")))
    kept = labels.join(F.broadcast(ids) if ids.count() <= MANY else ids, F.col("new_id") == F.col("label"), "left")
    assignments = _cut(kept.select("doc_id", F.coalesce("cluster_id", F.lit(-1)).cast("long").alias("cluster_id")))
    return {"assignments": assignments, **rebuild(inside.drop("cluster_id").join(assignments, "doc_id"), now, c), "model": model, "ids": ids}


def rebuild(members: DataFrame, now: dt.datetime, config: ClusterConfig | None = None, touched: DataFrame | None = None) -> dict[str, DataFrame]:
    """``clusters`` (counts, centroid, cohesion), ``metrics`` and ``changed`` from members; only of ``touched`` clusters if given."""
    rows = members if touched is None else members.join(touched.select("cluster_id").distinct(), "cluster_id", "left_semi")
    cents = vectors.centroids(rows, "cluster_id")
    clusters = enrich(rows, now, config).join(cents.select("cluster_id", "centroid"), "cluster_id").join(vectors.cohesion(rows, cents, "cluster_id"), "cluster_id").withColumn("noise", F.col("cluster_id") < 0)
    clusters = _cut(clusters)
    return {"clusters": clusters, "metrics": run_metrics(clusters), "changed": clusters.filter("NOT noise").select("cluster_id")}
