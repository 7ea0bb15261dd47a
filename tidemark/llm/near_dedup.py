"""MinHash near-deduplication with sequential Bayesian verification.

1. A document's words give its set of shingles and a signature of ``BANDS * ROWS`` minima.
   Equal word sequences are one class; from here on there is one node for a class.
2. Nodes that agree on a whole band of their signatures share a bucket. Every bucket has a
   hub, its member with the most company, and every member is compared with the hub only,
   so a bucket of m near copies costs m comparisons.
3. A comparison reads the two signatures batch by batch. After each batch the posterior of
   the similarity (uniform prior, binomial likelihood) says whether the threshold is still
   credible; below the chosen miss probability the pair is dropped. Survivors are verified
   exactly, on the full shingle sets of the whole texts.
4. Links give components (minimum labels with pointer jumping). Buckets whose members then
   lie in one component are done. In the others all pairs across components that the hubs
   have not covered are compared and verified where they meet, in pairs of blocks of bounded
   size, the likeliest first; only links that join components leave the task.

Nothing is capped: a bucket of any size is dealt to blocks, a hub of any degree to chunks.
Candidates miss a pair at a threshold t itself with probability (1 - t ** ROWS) ** BANDS,
3e-6 for the defaults and t = 0.8 (8e-7 for 24 bands and t = 0.85), and less above it.

Defined results. Null and empty texts have no shingles and are linked with nothing. A row
without an id is linked with nothing and has no component. Rows that repeat an id and text
are copies; ``deduplicate`` keeps one of them. Of a component the smallest id stays. Texts of any length are read whole; a task
that verifies holds the texts of one chunk or of two blocks. An empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import math
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, join_salted, small_batches, stays, store, word_hashes

BANDS, ROWS, BATCH = 32, 5, 20
MISS = 1e-6
PRUNE_CHUNK, VERIFY_CHUNK, BLOCK = 1024, 64, 1024
SEEN = 50_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingles(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    if len(words) < n:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(n)), strict=False))


@cache
def least_matches(percent: int, hashes: int, batch: int, miss: float) -> tuple[int, ...]:
    """After each batch, the fewest matches that keep P(similarity >= threshold | matches) >= miss."""
    t, out = percent / 100, []
    for n in range(batch, hashes + 1, batch):
        m = 0
        while m < n and sum(math.comb(n + 1, i) * t**i * (1 - t) ** (n + 1 - i) for i in range(m + 1)) < miss:
            m += 1
        out.append(m)
    return tuple(out)


def _coefficients(n: int):
    import numpy as np

    r = np.random.default_rng(20240229)
    return r.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, n, dtype=np.uint64)


def signature(words: list[bytes], n: int, coefficients, word_hash):
    import numpy as np

    h = np.fromiter(map(word_hash.__getitem__, words), np.uint64, len(words))
    last = max(1, len(words) - n + 1)
    g = h[:last].copy()
    with np.errstate(over="ignore"):
        for j in range(1, min(n, len(words))):
            g = (g ^ (g >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[j : last + j]
        g = (g ^ (g >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        g ^= g >> np.uint64(29)
        a, b = coefficients
        least = np.full(len(a), np.uint64(2**64 - 1))
        for at in range(0, len(g), 512):
            np.minimum(least, (g[at : at + 512, None] * a + b).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def _describe(n: int, hashes: int):
    def run(batches):
        import hashlib

        coefficients, word_hash, seen = _coefficients(hashes), word_hashes(), set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                size, nodes, sigs = [], [], []
                for text in part.column(1).to_pylist():
                    words = words_of(text)
                    size.append(len(shingles(words, n)))
                    node = hashlib.sha256(b" ".join(words)).digest()[:16] if words else None
                    nodes.append(node)
                    sigs.append(signature(words, n, coefficients, word_hash).tobytes() if words and node not in seen else None)
                    if len(seen) >= SEEN:  # what it holds only spares work
                        seen.clear()
                    seen.add(node)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(nodes, pa.binary()), pa.array(sigs, pa.binary())], ["id", "n", "node", "sig"])

    return run


def _bands(bands: int, rows: int):
    def run(batches):
        import numpy as np

        mix = np.array([pow(0x9E3779B97F4A7C15, j + 1, 2**64) for j in range(rows)], np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                s = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u4").reshape(-1, bands, rows).astype(np.uint64)
                with np.errstate(over="ignore"):
                    key = ((s + np.uint64(1)) * mix).sum(axis=2) + np.arange(bands, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
                    key = (key ^ (key >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                    key ^= key >> np.uint64(29)
                nodes = [x for x in part.column(0).to_pylist() for _ in range(bands)]
                band = np.tile(np.arange(bands, dtype=np.int32), len(s))
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(band), pa.array(nodes, pa.binary())], ["bucket", "band", "node"])

    return run


def _pack(batches):
    """(id, node, content): the node tells apart texts under one id."""
    import hashlib

    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            joined = [b" ".join(words_of(x)) for x in part.column(1).to_pylist()]
            nodes = [hashlib.sha256(x).digest()[:16] for x in joined]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nodes, pa.binary()), pa.array([pack(x) for x in joined], pa.binary())], ["id", "node", "content"])


def _prune(sig, other, least: tuple[int, ...], batch: int):
    """Indices of the rows of ``other`` that stay credible partners of ``sig``, and their matches."""
    import numpy as np

    alive = np.arange(len(other))
    matches = np.zeros(len(other), np.int32)
    for k, need in enumerate(least):
        cols = slice(k * batch, (k + 1) * batch)
        matches[alive] += (other[alive, cols] == sig[cols]).sum(axis=1, dtype=np.int32)
        alive = alive[matches[alive] >= need]
        if not len(alive):
            break
    return alive, matches


def _prune_group(least: tuple[int, ...], batch: int):
    def run(group):
        import numpy as np

        hub = next((x for x, r in zip(group.column("sig").to_pylist(), group.column("role").to_pylist(), strict=True) if r), None)
        members = group.filter(pa.compute.equal(group.column("role"), 0))
        if hub is None or not members.num_rows:
            return pa.table({"hub": pa.array([], pa.binary()), "member": pa.array([], pa.binary())})
        other = np.frombuffer(b"".join(members.column("sig").to_pylist()), "<u4").reshape(members.num_rows, -1)
        alive, _ = _prune(np.frombuffer(hub, "<u4"), other, least, batch)
        return members.select(["hub", "member"]).take(pa.array(alive))

    return run


def _verify_group(n: int, percent: int):
    def run(group):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        hubs, members, roles, packed = (group.column(c).to_pylist() for c in ("hub", "member", "role", "content"))
        own, found = None, []
        rest = []
        for hub, member, role, content in zip(hubs, members, roles, packed, strict=True):
            joined = unpack(content)
            if role:
                own = shingles(joined.split(), n)
            else:
                rest.append((hub, member, joined))
        for hub, member, joined in rest:
            other = shingles(joined.split(), n)
            if own is not None and 100 * min(len(own), len(other)) >= percent * max(len(own), len(other)):
                both = len(own & other)
                if 100 * both >= percent * (len(own) + len(other) - both):
                    found.append((hub, member))
        found = sorted(set(found))
        return pa.table({"hub": pa.array([x[0] for x in found], pa.binary()), "member": pa.array([x[1] for x in found], pa.binary())})

    return run


def _block_group(n: int, percent: int, least: tuple[int, ...], batch: int, bands: int):
    """Links across components in one pair of blocks of a bucket. A pair is looked at in the first
    band that it shares; what the links found so far connect is not compared again."""

    def run(group):
        import numpy as np
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        node, now, left, right, packed = (group.column(c).to_pylist() for c in ("node", "now", "in_left", "in_right", "content"))
        band = group.column("band")[0].as_py()
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), "<u4").reshape(len(node), -1)
        keys = sig.reshape(len(node), bands, -1)
        names: dict[bytes, int] = {}
        comp = np.array([names.setdefault(x, len(names)) for x in now])
        parent = list(range(len(names)))

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        sets: dict[int, set] = {}

        def words(i):
            if i not in sets:
                sets[i] = shingles(unpack(packed[i]).split(), n)
            return sets[i]

        rights = np.flatnonzero(right)
        found = []
        for i in np.flatnonzero(left):
            i = int(i)
            j = rights[comp[rights] != comp[i]]
            if len(j) and right[i]:  # one block with itself: each pair once
                j = j[j > i]
            if not len(j):
                continue
            alive, matches = _prune(sig[i], sig[j], least, batch)
            if not len(alive):
                continue
            first = (keys[j[alive]] == keys[i]).all(axis=2).argmax(axis=1)
            alive = alive[first == band]
            for x in alive[np.argsort(-matches[alive], kind="stable")]:
                b = int(j[x])
                ca, cb = find(comp[i]), find(comp[b])
                if ca == cb:
                    continue
                p, q = words(i), words(b)
                if 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)):
                    both = len(p & q)
                    if 100 * both >= percent * (len(p) + len(q) - both):
                        parent[ca] = cb
                        found.append((node[i], node[b]))
        return pa.table({"a": pa.array([x[0] for x in found], pa.binary()), "b": pa.array([x[1] for x in found], pa.binary())})

    return run


def _grouped(pairs: DataFrame, nodes: DataFrame, column: str, chunk: int):
    """Pairs (hub, member) dealt to (hub, chunk) groups of bounded size, with ``column`` of ``nodes`` for each."""
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    dealt = pairs.join(sizes, "hub").select("hub", "member", F.pmod(F.xxhash64("member"), F.col("chunks")).cast("int").alias("chunk"))
    rows = dealt.withColumn("role", F.lit(0)).unionByName(
        dealt.groupBy("hub", "chunk").agg(F.first("hub").alias("member")).withColumn("role", F.lit(1))
    )
    return rows.join(nodes.select(F.col("node").alias("member"), column), "member").groupBy("hub", "chunk")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node reachable over ``edges`` (a, b), for every node of an edge."""
    both = store(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = store(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        stepped = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        via = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        fresh = store(stepped.join(via, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "old"))
        still = fresh.filter("label <> old").isEmpty()
        labels = fresh.select("node", "label")
        if still:
            return labels


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    """id, n_shingles, component_id, kept for every row of ``docs``."""
    return _linked(docs, id_col, text_col, shingle, percent, bands, rows, miss).drop("node")


def _linked(docs: DataFrame, id_col: str, text_col: str, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, miss: float = MISS) -> DataFrame:
    hashes = bands * rows
    least = least_matches(percent, hashes, BATCH, miss)
    texts = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    described = store(texts.mapInArrow(_describe(shingle, hashes), "id long, n long, node binary, sig binary"))
    named = described.filter("id IS NOT NULL AND node IS NOT NULL")
    nodes = store(
        described.filter("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("rep"), F.first("sig", ignorenulls=True).alias("sig"), F.count("id").alias("copies")).filter("rep IS NOT NULL")
    )
    in_band = nodes.select("node", "sig").mapInArrow(_bands(bands, rows), "bucket long, band int, node binary")
    in_band = store(in_band)
    shared = store(in_band.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"))
    members = store(join_salted(in_band, shared, "bucket", "size", "node"))
    degree = members.groupBy("node").agg(F.sum("size").alias("degree"))
    hubs = store(members.join(degree, "node").groupBy("bucket").agg(F.max(F.struct("degree", "node")).getField("node").alias("hub"), F.max("size").alias("held")))
    members = store(join_salted(members, hubs, "bucket", "held", "node").drop("held"))
    involved = nodes.join(members.select("node").distinct(), "node", "left_semi")
    packed = texts.filter("id IS NOT NULL").mapInArrow(_pack, "id long, node binary, content binary")
    contents = store(packed.join(involved.select("node", "sig", F.col("rep").alias("id")), ["id", "node"]).dropDuplicates(["node"]).select("node", "sig", "content"))

    def confirmed(candidates: DataFrame) -> DataFrame:
        edges = _grouped(candidates, contents, "content", VERIFY_CHUNK).applyInArrow(_verify_group(shingle, percent), "hub binary, member binary")
        return store(edges.select(F.col("hub").alias("a"), F.col("member").alias("b")))

    stars = members.filter("node <> hub").select("hub", F.col("node").alias("member")).distinct()
    credible = store(_grouped(stars, contents, "sig", PRUNE_CHUNK).applyInArrow(_prune_group(least, BATCH), "hub binary, member binary"))
    edges = confirmed(credible)
    labels = components(edges)

    # Pairs that no hub has covered, across components of shared buckets.
    start = members.filter("node <> hub").join(labels, "node", "left").select("bucket", "band", "node", F.coalesce("label", "node").alias("now"))
    torn = store(start.groupBy("bucket").agg(F.min("now").alias("lo"), F.max("now").alias("hi"), F.count("*").alias("size")).filter("lo <> hi").select("bucket", "size"))
    open_ = join_salted(start, torn, "bucket", "size", "node").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    open_ = open_.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "bucket", "band", "node", "now", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"),
        (F.col("block") <= F.col("other")).alias("in_left"), (F.col("block") >= F.col("other")).alias("in_right"),
    )
    across = dealt.join(contents, "node").groupBy("bucket", "left", "right").applyInArrow(_block_group(shingle, percent, least, BATCH, bands), "a binary, b binary")
    across = store(across.distinct())
    if not across.isEmpty():
        labels = components(edges.unionByName(across))

    least_id = nodes.join(labels, "node", "left").select("node", "rep", "copies", F.coalesce("label", "node").alias("label"))
    by_label = store(least_id.groupBy("label").agg(F.min("rep").alias("component_id"), F.count("*").alias("held")))
    of_node = store(join_salted(least_id, by_label, "label", "held", "node").select("node", "component_id", "copies"))
    linked = join_salted(named, of_node, "node", "copies", "id").select("id", "n", "component_id", "node")
    alone = described.filter("id IS NULL OR node IS NULL").select("id", "n", F.col("id").alias("component_id"), "node")
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), "node"
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each component, with all their columns; of rows that repeat an id and words, one."""
    words = F.trim(F.regexp_replace(F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, UPPER.lower()), SPACE, " "))
    node = F.substring(F.unhex(F.sha2(words, 256)), 1, 16)  # as _describe has it
    none = F.substring(F.unhex(F.sha2(F.lit(""), 256)), 1, 16)  # texts without a word
    return stays(docs, _linked(docs, id_col, text_col, **options).withColumn("node", F.coalesce("node", none)), id_col, node, "node")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return link(docs, id_col, text_col, shingle=3, percent=85, bands=24)
