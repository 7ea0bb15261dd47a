"""Mixing overlapping sources to target weights by min-cost flow.

Documents are first added up by membership pattern (the sorted set of sources a document
belongs to). Patterns and sources form a small network: a pattern offers its tokens once
for each allowed repetition, and a later repetition costs more than an earlier one
(convex), a source takes up to its target. The cheapest maximal flow says how many tokens
of each pattern go to each source. Since all patterns share one increasing cost for a
repetition, the cheapest flow is found by opening the repetitions one after the other and
augmenting to a maximum in between.

A pattern's flow is then whole repetitions of all its documents, and for the remainder the
documents with the smallest seeded hashes. The cut is found on sums over hash bins, so no
pattern, however large, meets in one task.

Bounds: the driver holds a row for each source and each membership pattern (never for each
document); more than ``max_patterns`` patterns raise an error.

Defined results. Null and empty texts have size 0 and are never taken. A null source is a
source of its own, last in order. Rows with equal hashes go by id, then size. Of a text of any length only its size
is planned with. An empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import fresh, n_words, store

BINS = 4096
MAX_REPEATS = 3


def targets(sizes: list[tuple[str | None, int]], weights=(1, 2, 3), max_repeats: int = MAX_REPEATS) -> dict[str | None, float]:
    """Sources by code point, null last, weigh 1, 2, 3, repeating; a target above
    ``max_repeats`` times its source is cut there and the excess shared again by weight."""
    order = sorted((s for s in sizes if s[0] is not None), key=lambda s: s[0]) + [s for s in sizes if s[0] is None]
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    left, open_, out = float(sum(size.values())), list(size), {}
    while open_:
        all_weight = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / all_weight > max_repeats * size[s]]
        if not over:
            out |= {s: left * weight[s] / all_weight for s in open_}
            break
        for s in over:
            out[s] = float(max_repeats * size[s])
            left -= out[s]
            open_.remove(s)
    return out


class _Network:
    """Integer max flow (Dinic) whose capacities can be raised between runs."""

    def __init__(self, n: int):
        self.to, self.cap, self.at = [], [], [[] for _ in range(n)]

    def edge(self, a: int, b: int, cap: int) -> int:
        for x, y, c in ((a, b, cap), (b, a, 0)):
            self.at[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
        return len(self.to) - 2

    def augment(self, s: int, t: int) -> None:
        while True:
            depth, queue = {s: 0}, deque([s])
            while queue:
                x = queue.popleft()
                for e in self.at[x]:
                    if self.cap[e] and self.to[e] not in depth:
                        depth[self.to[e]] = depth[x] + 1
                        queue.append(self.to[e])
            if t not in depth:
                return
            nxt = [0] * len(self.at)
            while True:  # one blocking path at a time, without recursion
                path, x = [], s
                while x != t:
                    while nxt[x] < len(self.at[x]):
                        e = self.at[x][nxt[x]]
                        if self.cap[e] and depth.get(self.to[e], -1) == depth[x] + 1:
                            break
                        nxt[x] += 1
                    else:
                        if not path:
                            break
                        x = self.to[path.pop() ^ 1]
                        nxt[x] += 1
                        continue
                    path.append(e)
                    x = self.to[e]
                if x != t:
                    break
                push = min(self.cap[e] for e in path)
                for e in path:
                    self.cap[e] -= push
                    self.cap[e ^ 1] += push


def flow(patterns: dict[tuple, int], wanted: dict, max_repeats: int = MAX_REPEATS) -> dict[tuple, dict]:
    """pattern -> {source: tokens}: the cheapest of the largest flows."""
    names, sources = list(patterns), list(wanted)
    base = 2 + len(names)
    net = _Network(base + len(sources))
    where = {s: base + i for i, s in enumerate(sources)}
    supply = [net.edge(0, 2 + i, 0) for i in range(len(names))]
    routes = [(p, s, net.edge(2 + i, where[s], max_repeats * patterns[p])) for i, p in enumerate(names) for s in p if s in where]
    for s in sources:
        net.edge(where[s], 1, round(wanted[s]))
    for _ in range(max_repeats):  # open the next, dearer repetition of every pattern
        for i, p in enumerate(names):
            net.cap[supply[i]] += patterns[p]
        net.augment(0, 1)
    out: dict[tuple, dict] = {p: {} for p in names}
    for p, s, e in routes:
        out[p][s] = net.cap[e ^ 1]
    return out


def mix(docs: DataFrame, sources: str = "sources", id_col: str = "doc_id", size_col: str = "size", *, wanted: dict | None = None, seed: int = 0, max_repeats: int = MAX_REPEATS, max_patterns: int = 100_000) -> tuple[DataFrame, dict, dict]:
    """``docs`` has id, size and an array of sources (null elements allowed). Returns
    (id, pattern, size, taken), the sources' sizes and their targets."""
    spark = docs.sparkSession
    rows = store(
        docs.select(
            F.col(id_col).alias("id"),
            F.to_json(F.struct(F.sort_array(F.array_distinct(F.col(sources))).alias("s")), {"ignoreNullFields": "false"}).alias("pattern"),
            F.sort_array(F.array_distinct(F.col(sources))).alias("members"),
            F.col(size_col).cast("long").alias("size"),
        ).withColumn("bin", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(BINS)).cast("int"))
    )
    sums = rows.groupBy("pattern", "members").agg(F.sum("size").alias("size")).limit(max_patterns + 1).collect()
    if len(sums) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns: raise max_patterns or merge sources")
    name = {r["pattern"]: tuple(r["members"]) for r in sums}
    patterns: dict[tuple, int] = {name[r["pattern"]]: r["size"] for r in sums}
    size: dict = {}
    for p, n in patterns.items():
        for s in p:
            size[s] = size.get(s, 0) + n
    wanted = targets(list(size.items()), max_repeats=max_repeats) if wanted is None else wanted
    routed = flow(patterns, wanted, max_repeats)
    plan = []
    for key, p in name.items():
        tokens = min(sum(routed[p].values()), max_repeats * patterns[p])
        plan.append((key, tokens // patterns[p] if patterns[p] else 0, tokens % patterns[p] if patterns[p] else 0))
    plan_df = spark.createDataFrame(plan, "pattern string, repeats int, rest long")
    # The bin in which a pattern's remainder ends, from sums over bins.
    bins = rows.groupBy("pattern", "bin").agg(F.sum("size").alias("s"))
    upto = F.sum("s").over(Window.partitionBy("pattern").orderBy("bin"))
    cut = (
        bins.withColumn("upto", upto).join(plan_df, "pattern").filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("s") <= F.col("rest")))
        .groupBy("pattern").agg(F.min("bin").alias("cut_bin"), F.min_by(F.col("upto") - F.col("s"), "bin").alias("before"))
    )
    plan_df = plan_df.join(cut, "pattern", "left")
    small = len(plan) <= 10_000  # rows that are broadcast; beyond it these joins shuffle
    per_pattern = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    marked = rows.drop("members").join(per_pattern(plan_df), "pattern")
    whole = marked.filter(F.col("cut_bin").isNull() | (F.col("bin") != F.col("cut_bin"))).withColumn("extra", F.coalesce(F.col("bin") < F.col("cut_bin"), F.lit(False)).cast("int"))
    # In that bin, one of BINS, rows go by a second hash as far as they fit.
    order = Window.partitionBy("pattern").orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id", "size")
    edge = marked.filter(F.col("bin") == F.col("cut_bin")).withColumn("run", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    edge = edge.withColumn("extra", (F.col("run") <= F.col("rest") - F.col("before")).cast("int"))
    cols = ["id", "pattern", "size", "repeats", "extra"]
    both = whole.select(*cols, "rest", "before").unionByName(edge.select(*cols, "rest", "before"))
    # The one row left that closes the remaining gap best.
    full = plan_df.join(edge.groupBy("pattern").agg(F.sum(F.col("extra") * F.col("size")).alias("fitted")), "pattern")
    gap = full.select("pattern", (F.col("rest") - F.col("before") - F.col("fitted")).alias("gap"))
    left = both.filter((F.col("extra") == 0) & (F.col("size") > 0)).join(per_pattern(gap), "pattern")
    off = F.abs(F.col("size") - F.col("gap"))
    best = left.filter(off < F.col("gap")).groupBy("pattern").agg(F.min(F.struct(off.alias("off"), F.xxhash64(F.lit(seed), "id").alias("h"), "id", "size")).alias("best"))
    both = both.select(*cols).join(per_pattern(best), "pattern", "left")
    closes = F.coalesce(F.col("best.id").eqNullSafe(F.col("id")) & (F.col("best.size") == F.col("size")), F.lit(False))
    times = F.least(F.col("repeats") + F.greatest(F.col("extra"), closes.cast("int")), F.lit(max_repeats))
    return both.select("id", "pattern", "size", (times * F.col("size")).cast("long").alias("taken")), size, wanted


def mix_by_source(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken: every document belongs to its one source."""
    spark: SparkSession = docs.sparkSession
    sized = docs.select(F.col(id_col).cast("long").alias("id"), F.array(F.col(source_col).cast("string")).alias("sources"), n_words(F.col(text_col)).alias("size"))
    rows, size, wanted = mix(sized, id_col="id", seed=seed)
    known = spark.createDataFrame(
        [(s, int(n), float(wanted[s])) for s, n in size.items()],
        T.StructType([T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())]),
    ).withColumn("pattern", F.to_json(F.struct(F.array("source").alias("s")), {"ignoreNullFields": "false"})).drop("source")
    known = F.broadcast(known) if len(size) <= 10_000 else known
    return rows.join(known, "pattern").select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def resample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, seed: int = 0) -> DataFrame:
    """The mix itself: the rows of ``docs`` that it takes, each as often as it takes them. An id may stand for several texts:
    each is planned and taken for itself. Rows that repeat an id, text and source are taken equally often, as often as the most taken of them."""
    name, times, nth = (fresh(docs, c) for c in ("_id", "_times", "_nth"))
    source, text = F.col(source_col).cast("string"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(text, F.coalesce(source, F.lit(""))).alias("print"))
    sized = docs.select(key.alias("id"), F.array(source).alias("sources"), n_words(F.col(text_col)).alias("size"))
    plan = mix(sized, id_col="id", seed=seed)[0].filter("taken > 0")
    often = plan.groupBy(F.col("id").alias(name)).agg(F.max(F.expr("taken div size")).cast("int").alias(times))
    taken = docs.join(often, key["id"].eqNullSafe(F.col(name)["id"]) & (key["print"] == F.col(name)["print"])).drop(name)
    return taken.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(nth, times)
