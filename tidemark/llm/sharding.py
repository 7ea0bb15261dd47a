"""K-d tree sharding with distributed weighted medians; built-in functions only.

Each document is a point of its metadata dimensions, weighted by its bytes. A node that
stands for k shards is cut along its widest dimension where k // 2 of its k shards' bytes
lie on the left, until every leaf is one shard. All nodes of a level find their cuts at
once: the keys of each node are counted into bins, the bin that holds the wanted byte is
counted again in finer bins, until the bin holds a single key. Only (node, bin) sums reach
the driver: at most shards * BINS rows, whatever the input. Rows move once, for their slots.

The key of a dimension is its coordinate (31 bits) followed by the text's checksum, so
equal texts stay together, unless keeping them so would move a cut by more than 1 % of a shard: then
their group is cut by doc_id. In a small corpus that can be a group of two; in a large one it is one of many copies.

Defined results. Null text is empty (16 bytes of size); null metadata is coordinate 0; a
null doc_id sorts first. Rows that repeat a doc_id and text lie on the same side of every
cut. Documents of any length stay whole, so shards are as even as their largest documents allow. An empty table gives
an empty one. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import store, text_bytes

OVERHEAD = 16
BINS = 1024
SLOT_ROWS = 1_000_000


def coordinate(df: DataFrame, name: str) -> Column:
    """0 to 2**31 - 1. Numbers keep their order; strings go by their first bytes."""
    if dict(df.dtypes)[name] == "string":
        head = F.rpad(F.substring(F.hex(F.encode(F.coalesce(F.col(name), F.lit("")), "UTF-8")), 1, 8), 8, "0")
        return F.shiftright(F.conv(head, 16, 10).cast("long"), 1)
    return F.least(F.greatest(F.coalesce(F.col(name).cast("long"), F.lit(0)), F.lit(0)), F.lit(2**31 - 1)).cast("long")


def _left(node: dict) -> Column:
    key = F.col(f"k{node['dim']}")
    if node["id_cut"] is None:
        return key <= node["cut"]
    return (key < node["cut"]) | ((key == node["cut"]) & (F.col("tie") <= node["id_cut"]))


def _place(tree: dict, leaf) -> Column:
    if "cut" not in tree:
        return F.lit(leaf(tree))
    return F.when(_left(tree), _place(tree["l"], leaf)).otherwise(_place(tree["r"], leaf))


def _values(rows: DataFrame, names: str, values: list[tuple]) -> DataFrame:
    """A handful of driver-side rows (one a node, so at most ``shards``), ready to broadcast."""
    return F.broadcast(rows.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(f"({', '.join(f'{x}L' for x in v)})" for v in values) + f" AS t({names})"))


def _cuts(rows: DataFrame, wanted: dict[int, float], bounds: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int, int]]:
    """For rows of (node, key, size): node -> (key value at the wanted byte, bytes before that value, bytes of that value)."""
    found: dict[int, tuple[int, int, int]] = {}
    before = dict.fromkeys(wanted, 0)
    open_ = {n: (int(lo), int(hi)) for n, (lo, hi) in bounds.items()}
    while open_:
        ranges = _values(rows, "node, lo, hi, width", [(n, a, b, max(1, -(-(b - a + 1) // BINS))) for n, (a, b) in open_.items()])
        binned = rows.join(ranges, "node").filter(F.col("key").between(F.col("lo"), F.col("hi"))).withColumn("bin", F.expr("(key - lo) div width"))
        by: dict[int, list] = {}
        for r in binned.groupBy("node", "bin").agg(F.sum("size").alias("s"), F.min("key").alias("a"), F.max("key").alias("b")).collect():  # at most nodes * BINS rows
            by.setdefault(r["node"], []).append((r["a"], r["b"], r["s"]))
        for n in list(open_):
            total, cells = before[n], sorted(by[n])
            for a, b, s in cells:
                if total + s >= wanted[n] or (a, b, s) == cells[-1]:
                    before[n] = total
                    if a == b:
                        found[n] = (a, total, s)
                        del open_[n]
                    else:
                        open_[n] = (a, b)
                    break
                total += s
    return found


def build(rows: DataFrame, dims: int, shards: int) -> dict:
    """The tree over ``rows`` (size, tie, k0..k{dims-1}): nested dicts of cuts, leaves with shard numbers."""
    root = {"shards": shards, "id": 0}
    level, fresh = [root], 1
    while level := [n for n in level if n["shards"] > 1]:
        at = rows.withColumn("node", _place(root, lambda t: t["id"] if t["shards"] > 1 else -1).cast("long")).filter("node >= 0")
        stats = {
            r["node"]: r
            for r in at.groupBy("node").agg(
                F.sum("size").alias("bytes"),
                *[f(f"k{d}").alias(f"{f.__name__}{d}") for d in range(dims) for f in (F.min, F.max)],
            ).collect()
        }
        if not root.get("span"):
            r = stats.get(0)
            if r is None:
                break
            root["span"] = [max(1, (r[f"max{d}"] >> 32) - (r[f"min{d}"] >> 32)) for d in range(dims)]
        level = [n for n in level if n["id"] in stats]
        if not level:
            break
        for n in level:  # the widest, measured in the root's extents
            r = stats[n["id"]]
            n["dim"] = max(range(dims), key=lambda d: (((r[f"max{d}"] >> 32) - (r[f"min{d}"] >> 32)) / root["span"][d], r[f"max{d}"] > r[f"min{d}"], -d))
        dim = reduce(lambda w, d: w.when(F.col("dim") == d, F.col(f"k{d}")), range(dims), F)
        keyed = at.join(_values(rows, "node, dim", [(n["id"], n["dim"]) for n in level]), "node").select("node", "size", "tie", dim.alias("key"))
        wanted = {n["id"]: stats[n["id"]]["bytes"] * (n["shards"] // 2) / n["shards"] for n in level}
        bounds = {n["id"]: (stats[n["id"]][f"min{n['dim']}"], stats[n["id"]][f"max{n['dim']}"]) for n in level}
        cuts = _cuts(keyed, wanted, bounds)
        inside = {}
        for n in level:
            value, before, own = cuts[n["id"]]
            short, over = wanted[n["id"]] - before, before + own - wanted[n["id"]]
            share = stats[n["id"]]["bytes"] / n["shards"]
            n["cut"], n["id_cut"] = value, None
            if min(short, over) > 0.01 * share:
                inside[n["id"]] = short
            elif short < over:
                n["cut"] = value - 1
        if inside:
            at_cut = _values(rows, "node, cut", [(n["id"], n["cut"]) for n in level if n["id"] in inside])
            same = keyed.join(at_cut, "node").filter("key = cut").select("node", "size", F.col("tie").alias("key"))
            ends = {r["node"]: (r["a"], r["b"]) for r in same.groupBy("node").agg(F.min("key").alias("a"), F.max("key").alias("b")).collect()}
            ties = _cuts(same, inside, ends)
            for n in level:
                if n["id"] in ties:
                    value, before, own = ties[n["id"]]
                    n["id_cut"] = value if before + own - inside[n["id"]] <= inside[n["id"]] - before else value - 1
        deeper = []
        for n in level:
            for side, k in (("l", n["shards"] // 2), ("r", n["shards"] - n["shards"] // 2)):
                n[side] = {"shards": k, "id": fresh}
                fresh += 1
                deeper.append(n[side])
        level = deeper

    def number(t, start):
        if "cut" in t:
            number(t["l"], start)
            number(t["r"], start + t["l"]["shards"])
        else:
            t["shard"] = start

    number(root, 0)
    return root


def shard(docs: DataFrame, shards: int, dims: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard, slot for every row of ``docs``; shards of near equal bytes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    crc = F.crc32(F.encode(text, "UTF-8"))
    rows = store(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            (text_bytes(F.col(text_col)) + OVERHEAD).alias("size"),
            crc.alias("crc"),
            F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**62))).alias("tie"),
            *[(F.shiftleft(coordinate(docs, d), 32) + crc).alias(f"k{i}") for i, d in enumerate(dims)],
        )
    )
    tree = build(rows, len(dims), shards)
    placed = rows.withColumn("shard", _place(tree, lambda t: t["shard"]).cast("int"))
    # Slots: rows of a shard are dealt to buckets by id, numbered there, and moved up by the rows of earlier buckets.
    n_buckets = max(8, -(-rows.count() // (SLOT_ROWS * shards)))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(n_buckets)).cast("int"))
    counts = placed.groupBy("shard", "bucket").count()
    first = counts.select("shard", "bucket", (F.sum("count").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("count")).alias("first"))
    in_bucket = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "crc", "size"))
    return placed.withColumn("nth", in_bucket).join(first, ["shard", "bucket"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("first") + F.col("nth") - 1).cast("long").alias("slot")
    )
