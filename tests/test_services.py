"""Encoding with cache and spool, typed events, and the producer."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import vectors
from tidemark.sources import events, producer, tables
from tidemark.streaming import encode

NOW = dt.datetime(2024, 1, 2)


def model(log=None, version="1"):
    inner = vectors.hashed_backend(8)

    def backend(texts):
        if log:
            with open(log, "a") as f:
                f.write("".join(f"{t}\n" for t in texts))
        return inner(texts)

    return encode.Model("m", version, 8, backend, 6, 2)


DOCS = "doc_id string, normalized_text string, source_type string"


def test_vectors_are_means_of_windows(spark):
    long = " ".join(f"w{i}" for i in range(12))
    df = spark.createDataFrame([("a", "one two", "rss"), ("b", long, "vk_post"), ("c", " ", "rss"), ("d", None, "rss"), ("a", "one two", "rss")], DOCS)
    rows, bad = encode.encoded(df, model(), now=NOW)
    got = {r.doc_id: r for r in rows.collect()}
    assert set(got) == {"a", "b"} and sorted(r.doc_id for r in bad.collect()) == ["c", "d"]
    words = f"passage: [vk_post] {long}".split()
    starts = [0, 4, 8]
    raw = vectors.hashed_backend(8)([" ".join(words[s : s + 6]) for s in starts])
    mean = [sum(v[i] for v in raw) / len(raw) for i in range(8)]
    length = sum(x * x for x in mean) ** 0.5
    assert got["b"].embedding == pytest.approx([x / length for x in mean]) and got["b"].truncated and got["b"].token_count == 14
    assert not got["a"].truncated and got["a"].token_count == 4 and got["a"].model_version == "1" and got["a"].embedded_at == NOW


def test_cache_encodes_each_text_once(spark, tmp_path):
    log, cache = f"{tmp_path}/log", f"{tmp_path}/cache"
    first = spark.createDataFrame([(str(i), f"text {i % 3}", "rss") for i in range(9)], DOCS)
    a = encode.encoded(first, model(log), cache, NOW)[0].select("doc_id", "embedding").collect()
    assert len(open(log).read().splitlines()) == 3
    b = encode.encoded(first.unionByName(spark.createDataFrame([("new", "text 77", "rss")], DOCS)), model(log), cache, NOW)[0]
    assert sorted(map(str, b.filter("doc_id <> 'new'").select("doc_id", "embedding").collect())) == sorted(map(str, a)) and len(open(log).read().splitlines()) == 4
    encode.encoded(first, model(log, "2"), cache, NOW)[0].count()
    assert len(open(log).read().splitlines()) == 7  # another version shares nothing


def test_outage_spools_and_replays(spark, tmp_path):
    """Two batches fall into an outage; the oldest rows are replayed first, and only what was saved is acknowledged."""
    table, spool, down, published = f"{tmp_path}/table", encode.Spool(spark, f"{tmp_path}/spool"), [True], []

    def save(rows):
        if down[0]:
            raise ConnectionError("the table cannot be reached")
        tables.upsert(rows, table, ("doc_id",), ("embedded_at",))

    publish = lambda rows, batch_id: published.append((batch_id, rows.count()))
    batch = lambda ids, word: spark.createDataFrame([(i, f"{word} {i}", "rss") for i in ids], DOCS)
    run = lambda docs, n, hour: encode.encode_batch(docs, n, model(), save, spool, f"{tmp_path}/letters", publish=publish, now=NOW + dt.timedelta(hours=hour))
    assert spool.size() == 0 and spool.replay(save) == 0
    assert not run(batch("bc", "old"), 0, 0) and not run(batch("ab", "new"), 1, 1) and not run(batch("ab", "new"), 1, 1)  # the second batch twice
    assert spool.size() == 3 and [r.doc_id for r in spool.peek(2).collect()] == ["b", "c"]
    with pytest.raises(ConnectionError):
        spool.replay(save)
    assert spool.size() == 3
    down[0] = False
    assert spool.replay(save, limit=2) == 2 and spool.size() == 1
    assert {r.doc_id: r.normalized_text for r in tables.rows_of(spark, table).collect()} == {"b": "new b", "c": "old c"}
    assert spool.replay(save) == 1 and spool.replay(save) == 0 and spool.size() == 0
    assert run(batch("c", "newest"), 2, 2) and spool.size() == 0
    assert {r.doc_id: r.normalized_text for r in tables.rows_of(spark, table).collect()} == {"a": "new a", "b": "new b", "c": "newest c"}
    assert published == [(0, 2), (1, 2), (1, 2), (2, 1)]


def value(kind, i):
    """A value of each kind, with nulls and empty arrays among them."""
    if isinstance(kind, T.TimestampType):
        return dt.datetime(2024, 1, 1 + i, 3, 4, 5, 678 * i)
    if isinstance(kind, T.ArrayType):
        return [] if i == 0 else [value(kind.elementType, j) for j in range(i + 1)]
    return {"string": f"s{i} é\n\"", "boolean": i % 2 == 0, "double": 0.1 * i, "long": 10**12 * i, "bigint": 10**12 * i, "int": i}[kind.simpleString()]


@pytest.mark.parametrize("schema", [events.ENRICHED, events.EMBEDDED, events.TOPICS_UPDATED, events.DESCRIPTIONS_UPDATED], ids=lambda s: s.name)
def test_events_round_trip(spark, schema):
    rows = [tuple(schema.codes[f.name][i] if f.name in schema.codes else None if i == 2 and f.name in schema.optional else value(f.dataType, i) for f in schema.fields) for i in range(3)]
    df = spark.createDataFrame(rows, T.StructType(schema.fields))
    sent = events.serialised(df, schema, schema.fields[0].name)
    said = json.loads(sent.head().value)
    assert said["schema"] == schema.name and said["schema_version"] == 1
    back, letters = events.read_back(sent, schema)
    assert back.columns == df.columns and sorted(map(str, back.collect())) == sorted(map(str, df.collect())) and letters.isEmpty()


def test_events_that_are_refused(spark):
    s = events.Schema("thing", 2, "id string, at timestamp, kind string, n int, tags array<string>", {"kind": ("a", "b")}, {"tags": ["none"], "n": 7}, ("at",), readable=(1,))
    ok = {"schema": "thing", "schema_version": 2, "id": "x", "at": "2024-01-01T03:00:00.000001+03:00", "kind": "a", "n": 1, "tags": ["t", None]}
    cases = [ok, ok | {"schema_version": 1, "more": 1}, {k: v for k, v in ok.items() if k not in ("tags", "n", "at")}, ok | {"schema_version": 3}, ok | {"schema": "other"}, ok | {"kind": "c"}, ok | {"id": None}, ok | {"at": "soon"}, ok | {"n": "many"}, [1]]
    back, letters = events.read_back(spark.createDataFrame([(json.dumps(c),) for c in [*cases]] + [("{",)], "value string"), s)
    got = sorted(map(tuple, back.select("id", F.col("at").cast("string"), "kind", "n", F.to_json("tags")).collect()), key=str)
    assert got == sorted([("x", None, "a", 7, '["none"]'), *[("x", "2024-01-01 00:00:00.000001", "a", 1, '["t",null]')] * 2], key=str)
    assert sorted(r.error for r in letters.collect()) == sorted(["version 3", "schema other", "kind: unknown code c", "id: missing", "at: not a time", "a field is of the wrong kind", "not a JSON object", "not a JSON object"])


def test_producer_flushes_and_commits(spark, tmp_path):
    topic = producer.FolderTopic(f"{tmp_path}/topic")

    class Row(dict):
        def asDict(self, recursive=False):  # noqa: N802
            return dict(self)

    sent = producer.Producer(topic, {}).write(Row(i=i) for i in range(250))
    assert (sent.rows, sent.flushes) == (250, 3) and topic.messages() == []
    aged = producer.Producer(topic, {"flush_seconds": "0"}).write(Row(i=i) for i in range(4))
    assert aged.flushes == 4
    writer = producer.Producer(topic, {})
    writer.abort([aged, None], 0)
    assert os.listdir(f"{tmp_path}/topic/staged") == [f"{sent.part}.jsonl"]
    writer.commit([sent], 0)
    assert [m["i"] for m in topic.messages()] == list(range(250))
    again = writer.write(Row(i=i) for i in range(250))  # the micro-batch once more, after its commit
    writer.commit([again], 0)
    assert len(topic.messages()) == 250 and os.listdir(f"{tmp_path}/topic/staged") == []


def test_producer_stream(spark, tmp_path):
    spark.dataSource.register(producer.topic_sink("folder_topic_test", producer.FolderTopic(f"{tmp_path}/topic")))
    for start in (0, 50):
        spark.range(start, start + 50).select(F.col("id").cast("string").alias("key"), F.to_json(F.struct("id")).alias("value")).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("key string, value string").parquet(f"{tmp_path}/in")
        stream.writeStream.format("folder_topic_test").option("flush_rows", "7").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination(120)
        got = producer.FolderTopic(f"{tmp_path}/topic").messages()
        assert sorted(int(m["key"]) for m in got) == list(range(start + 50)) and all(json.loads(m["value"])["id"] == int(m["key"]) for m in got)
    broken = spark.readStream.schema("key string, value string").parquet(f"{tmp_path}/in").withColumn("value", F.when(F.col("key") == "77", F.raise_error(F.lit("bad row"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="bad row"):
        broken.writeStream.format("folder_topic_test").option("checkpointLocation", f"{tmp_path}/other").trigger(availableNow=True).start().awaitTermination(120)
    assert len(producer.FolderTopic(f"{tmp_path}/topic").messages()) == 100
