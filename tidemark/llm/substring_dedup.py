"""Substring deduplication by super-k-mer partitioning.

Every window of ``K`` consecutive words has a minimiser: of its runs of ``M`` words the one
with the least hash, leftmost on ties. Consecutive windows that share a minimiser travel as
one packed string to the minimiser's bucket; equal windows have equal minimisers, so each
bucket, by itself, sorts its windows and finds every repeat exactly, words against words.

A task combines before it sends: a string that it has read before in the same chunk is a
repeat as it stands, so of equal strings only the first travels with its words, the others
as three numbers. A row of the shuffle is all that one chunk has for one bucket, zstd-packed.
The number of buckets follows the input's bytes, so a bucket fits a task at every size.

A word is removed if a window that covers it also starts earlier: in a document of smaller
id, or earlier in the same one. Defined results. Null text has no words. A null id is larger
than all others. Rows that repeat an id and words are the same document and do not make each
other repeats; different words under one id, null included, are different documents, in the
order of a 64-bit hash. An empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, word_hashes

K, M = 20, 3
CHUNK_BYTES = 12 << 20
BUCKET_BYTES = 16 << 20
NO_ID = 2**63 - 1


def print_of(content: bytes) -> int:
    """Tells apart texts under one id; ``content`` has the words joined by one space."""
    import xxhash

    return xxhash.xxh3_64_intdigest(content) - 2**63


def runs(words: list[bytes], hashes, k: int = K, m: int = M):
    """(first window, windows, minimiser hash) of each maximal run of windows with one minimiser. ``hashes``: word -> hash."""
    import numpy as np

    n = len(words) - k + 1
    if n < 1:
        return [], [], []
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    g = h[: len(words) - m + 1].copy()
    with np.errstate(over="ignore"):
        for j in range(1, m):
            g = (g ^ (g >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[j : len(words) - m + 1 + j]
        g = (g ^ (g >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        g ^= g >> np.uint64(29)
    at = np.lib.stride_tricks.sliding_window_view(g, k - m + 1).argmin(axis=1) + np.arange(n)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return first.tolist(), np.diff(np.r_[first, n]).tolist(), g[at[first]]


def pack(entries: list) -> bytes:
    """Entries (hash, windows, (id, print), start, string, others) as one string: columns, then the words.
    Of the hash 24 bits travel; they only bring together what is then compared by words."""
    import numpy as np
    import zstandard

    h, windows, ids, starts, strings, others = zip(*entries, strict=True)
    owner = [n for n, x in enumerate(others) for _ in x]
    more = [y for x in others for y in x]
    prints = np.array([(x >> 40) & 0xFFFFFF for x in h], "<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    parts = [
        np.array([len(h), len(more)], "<i8"), prints, np.array(windows, np.uint8), np.array(starts, "<i4"), np.diff(np.array([x[0] for x in ids], "<i8"), prepend=0), np.array([x[1] for x in ids], "<i8"),
        np.array(owner, "<i4"), np.array([x[0][0] for x in more], "<i8"), np.array([x[0][1] for x in more], "<i8"), np.array([x[1] for x in more], "<i4"),
    ]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(x.tobytes() for x in parts) + b"\n".join(strings))


def unpack(blob: bytes) -> list:
    import numpy as np
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, m = np.frombuffer(raw, "<i8", 2).tolist()
    at = 16

    def take(kind: str, count: int):
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out

    prints = take("u1", 3 * n).reshape(-1, 3).astype(np.int64) @ np.array([1, 1 << 8, 1 << 16])
    windows, starts, ids = take("u1", n), take("<i4", n), zip(np.cumsum(take("<i8", n)).tolist(), take("<i8", n).tolist(), strict=True)
    owner, other_ids, other_starts = take("<i4", m), zip(take("<i8", m).tolist(), take("<i8", m).tolist(), strict=True), take("<i4", m)
    others: list = [()] * n
    for k, i, s in zip(owner.tolist(), other_ids, other_starts.tolist(), strict=True):
        if not others[k]:
            others[k] = []
        others[k].append((i, s))
    return list(zip(prints.tolist(), windows.tolist(), ids, starts.tolist(), raw[at:].split(b"\n"), others, strict=True))


def _pack(chunk: dict, buckets: int):
    """(bucket, blob) of a chunk: {string: [hash, windows, (id, print), start, [(other (id, print), start)]]}."""
    by: dict[int, list] = {}
    for string, (h, windows, i, start, others) in chunk.items():
        by.setdefault(h % buckets, []).append((h, windows, i, start, string, others))
    for names in _slices(list(by), 200):
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([pack(by.pop(b)) for b in names], pa.binary())], ["bucket", "blob"])


def _slices(items: list, n: int):
    return (items[at : at + n] for at in range(0, len(items), n))


def _send(buckets: int, k: int, m: int):
    def run(batches):
        chunk: dict[bytes, list] = {}
        held, word_hash = 0, word_hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = (text or "").encode("utf-8", "surrogatepass").split()
                    first, count, hashes = runs(words, word_hash, k, m)
                    if len(first):
                        i = (i, print_of(b" ".join(words)))
                    for s, c, h in zip(first, count, hashes.tolist() if len(first) else (), strict=True):
                        string = b" ".join(words[s : s + c + k - 1])
                        known = chunk.get(string)
                        if known is None:
                            chunk[string] = [h, c, i, s, []]
                            held += len(string) + 250
                        elif (i, s) < (known[2], known[3]):
                            known[4].append((known[2], known[3]))
                            known[2], known[3] = i, s
                        elif (i, s) != (known[2], known[3]):
                            known[4].append((i, s))
                            held += 150
                    if held > 4 * CHUNK_BYTES:
                        yield from _pack(chunk, buckets)
                        chunk, held = {}, 0
        if chunk:
            yield from _pack(chunk, buckets)

    return run


def repeats(entries: list, k: int = K):
    """((id, print), first window, windows) of the windows that are not the first of their words."""
    entries.sort(key=lambda e: e[0])
    out, at = [], 0
    while at < len(entries):
        to = at + 1
        while to < len(entries) and entries[to][0] == entries[at][0]:
            to += 1
        for _, windows, _, _, _, others in entries[at:to]:
            out.extend((i, s, windows) for i, s in others)
        if to - at > 1:
            found = []
            for _, windows, i, s, string, _ in entries[at:to]:
                words = string.split()
                found.extend((words[j : j + k], i, s + j) for j in range(windows))
            found.sort()
            for before, this in zip(found, found[1:], strict=False):
                if before[0] == this[0] and before[1:] != this[1:]:
                    out.append((this[1], this[2], 1))
        at = to
    return out


def _count(k: int):
    def run(blobs):
        import numpy as np

        entries = [e for blob in blobs.column("blob").to_pylist() for e in unpack(blob)]
        spans: dict[tuple[int, int], list] = {}
        for i, s, c in repeats(entries, k):
            spans.setdefault(i, []).extend((s, c))
        return pa.table([pa.array([x[0] for x in spans], pa.int64()), pa.array([x[1] for x in spans], pa.int64()), pa.array([np.array(x, "<i4").tobytes() for x in spans.values()], pa.binary())], ["key", "print", "spans"])

    return run


def _carry(batches):
    """Texts travel packed to their spans."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [b" ".join((x or "").encode("utf-8", "surrogatepass").split()) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(print_of, texts), pa.int64()), pa.array(map(press, texts), pa.binary())], ["id", "print", "text"])


def _remove(k: int):
    def run(batches):
        import numpy as np
        import zstandard

        release = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, gone, kept, sha = [], [], [], []
                for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = release(text).split()
                    n.append(len(words))
                    if spans:
                        pairs = np.frombuffer(b"".join(spans), "<i4").reshape(-1, 2)
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, pairs[:, 0], 1)
                        np.add.at(edge, pairs[:, 0] + pairs[:, 1] + k - 1, -1)
                        stays = np.cumsum(edge[:-1]) == 0
                        words = [w for w, x in zip(words, stays.tolist(), strict=True) if x]
                    gone.append(n[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept"])

    return run


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = K, m: int = M) -> DataFrame:
    """id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("b")).head()["b"] or 0
    buckets = max(64, -(-int(size * 2.8) // BUCKET_BYTES))
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    key = F.coalesce(F.col("id"), F.lit(NO_ID)).alias("key")
    sent = rows.select(key, "text").mapInArrow(_send(buckets, k, m), "bucket long, blob binary")
    spans = sent.groupBy("bucket").applyInArrow(_count(k), "key long, print long, spans binary")
    by_doc = spans.groupBy("key", "print").agg(F.collect_list("spans").alias("spans"))  # a document's own spans
    packed = rows.mapInArrow(_carry, "id long, print long, text binary").withColumn("key", F.coalesce(F.col("id"), F.lit(NO_ID)))
    joined = packed.join(by_doc, ["key", "print"], "left").select("id", "text", "spans")
    out = joined.mapInArrow(_remove(k), "id long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", id_col)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return deduplicate(docs, id_col, text_col).select(id_col, "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
