"""Exact deduplication by skew-safe combining.

Rows are first combined where they lie: a task keeps one entry for each distinct text it
has read, with the ids of its rows. Entries meet under (digest, salt), the winners of the
salts then meet under the digest. A digest that holds a large share of all rows is salted
again where its verdict goes back to its rows. Every stage compares whole contents, not digests alone:
the content travels zstd-packed, and packing is lossless and deterministic, so packed
contents are equal exactly when the texts are.

Defined results. Null text counts as empty. Of equal texts the smallest doc_id stays; a
null doc_id is larger than any other and stays only in a group without ids. Rows that
repeat a doc_id and text are one document and share a verdict, and ``deduplicate`` keeps one of them; each text of an id has its own.
Texts of any length are compared whole: a task holds the distinct texts it has read up to ``FLUSH_BYTES`` and one beyond. An empty table
gives an empty one. Columns other than the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, join_salted, small_batches, stays, store

SALTS = 16
#: Bytes of distinct text that a task holds before it hands its entries on, and ids in one entry.
FLUSH_BYTES = 32 << 20
IDS_PER_ENTRY = 4096

_runs = re.compile(rb"[\x20\x09-\x0D]+")


def normalised(text: str | None) -> bytes:
    return _runs.sub(b" ", (text or "").encode("utf-8", "surrogatepass"))


def sha256(content: bytes) -> bytes:
    return hashlib.sha256(content).digest()


def _combine_locally(digest, with_content: bool):
    """mapInArrow body: rows of (id, text) to entries (digest, content, ids, n)."""

    schema = pa.schema([("digest", pa.binary()), *([("content", pa.binary())] if with_content else []), ("ids", pa.list_(pa.int64())), ("keep", pa.int64()), ("n", pa.int64())])

    def entries(groups, packer):
        out = {f.name: [] for f in schema}
        for (key, content), ids in groups.items():
            packed = packer(content) if with_content else None
            known = [x for x in ids if x is not None]
            least = min(known) if known else None
            for at in range(0, len(ids), IDS_PER_ENTRY):
                part = ids[at : at + IDS_PER_ENTRY]
                out["digest"].append(key)
                if with_content:
                    out["content"].append(packed)
                out["ids"].append(part)
                out["keep"].append(least)
                out["n"].append(len(part))
        n = len(out["digest"])
        for at in range(0, n, 2000):
            yield pa.RecordBatch.from_pydict({k: v[at : at + 2000] for k, v in out.items()}, schema=schema)

    def run(batches):
        import zstandard

        packer = zstandard.ZstdCompressor(level=1, write_checksum=False, write_content_size=True).compress
        groups: dict = {}
        held = 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                content = normalised(text)
                key = (digest(content), content)
                ids = groups.get(key)
                if ids is None:
                    groups[key] = [i]
                    held += len(content) + 200
                else:
                    ids.append(i)
                    held += 8
            if held > FLUSH_BYTES:
                yield from entries(groups, packer)
                groups, held = {}, 0
        yield from entries(groups, packer)

    return run


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, digest=sha256, salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, digest (binary)."""
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    local = rows.mapInArrow(_combine_locally(digest, True), "digest binary, content binary, ids array<long>, keep long, n long")
    salted = (
        local.groupBy("digest", "content", F.pmod(F.xxhash64("keep", "ids"), F.lit(salts)).alias("salt"))
        .agg(F.min("keep").alias("keep"), F.sum("n").alias("n"))
    )
    # Salt winners meet under the digest alone; the aggregate still tells contents apart.
    winners = store(
        salted.repartition("digest")
        .groupBy("digest", "content")
        .agg(F.min("keep").alias("keep"), F.sum("n").alias("n"))
        .withColumn("contents", F.count("*").over(Window.partitionBy("digest")))
        .select("digest", "keep", "n", "contents", F.when(F.col("contents") > 1, F.col("content")).alias("content"))
    )
    clash = winners.filter("contents > 1")
    clashed = not clash.isEmpty()
    entries = local if clashed else rows.mapInArrow(_combine_locally(digest, False), "digest binary, ids array<long>, keep long, n long")
    single = winners.filter("contents = 1").select("digest", F.col("keep").alias("keep_id"), F.col("n").alias("group_size"))
    out = join_salted(entries.select("digest", "ids"), single, "digest", "group_size", "ids").select("digest", "ids", "keep_id", "group_size")
    if clashed:  # different contents under one digest are told apart by content
        both = clash.select("digest", "content", F.col("keep").alias("keep_id"), F.col("n").alias("group_size"))
        out = out.unionByName(entries.select("digest", "content", "ids").join(both, ["digest", "content"]).drop("content"))
    out = out.select(F.explode("ids").alias("id"), "keep_id", "group_size", "digest")
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat an id and text, one."""
    content = F.unhex(F.sha2(F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), SPACE, " "), 256))
    return stays(docs, classes(docs, id_col, text_col), id_col, content, "digest")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return classes(docs, id_col, text_col).select(id_col, "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents),
g AS (SELECT x, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.x) AS text_sha256
FROM t JOIN g ON t.x = g.x
"""
