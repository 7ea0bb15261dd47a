"""Collector, raw consumer, dead letters, upserts and generations, with restarts and failures."""

import datetime as dt
import json
import os
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tidemark.sources import collector, tables
from tidemark.streaming import raw


class Wall(BaseHTTPRequestHandler):
    """A wall service whose posts are added while it is read."""

    posts: dict[str, list[dict]] = {}
    calls: Counter = Counter()
    failing = 0

    def do_GET(self):  # noqa: N802
        url = urlparse(self.path)
        q = {k: v[0] for k, v in parse_qs(url.query).items()}
        Wall.calls[url.path] += 1
        if Wall.failing:
            Wall.failing -= 1
            said = {"error": {"error_msg": "too many requests"}}
        else:
            a, n = int(q["offset"]), int(q["count"])
            if url.path == "/wall.get":
                items = Wall.posts[q["owner_id"]][::-1]
            else:
                items = [{"id": i, "from_id": 5, "date": 2000 + i, "text": f"comment {i} of {q['post_id']}"} for i in range(int(q["post_id"]) % 4)]
            said = {"response": {"count": len(items), "items": items[a : a + n]}}
        body = json.dumps(said).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def publish(owner, *ids):
    Wall.posts.setdefault(owner, []).extend({"id": i, "owner_id": int(owner), "from_id": int(owner), "date": 1000 + i, "text": f"post {i}" if i % 7 else "  "} for i in ids)


@pytest.fixture
def wall():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Wall)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Wall.posts, Wall.failing = {}, 0
    Wall.calls.clear()
    yield f"http://127.0.0.1:{server.server_address[1]}"
    server.shutdown()


def options(**more):
    return {"owners": "-1,-2", "page_size": "5", "pages_a_task": "2", "max_items": "12"} | more


def test_reader_plans_and_reads_ranges(wall):
    publish("-1", *range(1, 41))
    publish("-2", 3)
    api = collector.WallService(wall, wait=0.01)
    reader = collector.PagedReader(api, options())
    start = reader.initialOffset()
    assert start == {"-1": 0, "-2": 0}
    end = reader.latestOffset()
    assert end == {"-1": 12, "-2": 3}
    parts = reader.partitions(start, end)
    publish("-1", *range(41, 48))  # pushes every offset on before the tasks read
    got = [json.loads(r[2])["id"] for p in parts for r in reader.read(p) if r[1] == "post"]
    assert sorted(got) == sorted([*range(1, 13), 3]) and len(parts) == 3
    assert reader.latestOffset() == {"-1": 24, "-2": 3}
    again = collector.PagedReader(api, options())  # started anew, and told the range it has to repeat
    repeated = [json.loads(r[2])["id"] for p in again.partitions(start, end) for r in again.read(p) if r[1] == "post"]
    assert sorted(repeated) == sorted(got) and again.latestOffset() == {"-1": 24, "-2": 3}
    assert collector.PagedReader(api, options(resume=json.dumps(end))).latestOffset() == {"-1": 24, "-2": 3}
    assert collector.PagedReader(api, options(since="1030")).latestOffset() == {"-1": 41, "-2": 3}
    hours = collector.PagedReader(api, options(max_hours=str(4 / 3600)))
    assert hours.latestOffset() == {"-1": 5, "-2": 3}
    comments = [r for r in reader.read(collector.Pages("-1", 0, 38, 39)) if r[1] == "comment"]
    assert len(comments) == 3 and json.loads(comments[0][3]) == {"owner_id": -1, "id": 39}
    Wall.failing = 2
    assert api.page("-1", 0, 1)[0] == 47
    Wall.failing = 3
    with pytest.raises(RuntimeError, match="too many"):
        api.page("-1", 0, 1)
    Wall.failing = 0


def test_collector_stream_across_restarts(spark, wall, tmp_path):
    """Three starts from one checkpoint, posts published in between: nothing is lost and nothing comes twice."""
    spark.dataSource.register(collector.paged_source("wall_test", collector.WallService(wall, wait=0.01)))
    out, check = f"{tmp_path}/out", f"{tmp_path}/check"
    sizes = []

    def run(batch, batch_id):
        rows = collector.messages(batch)
        rows.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        sizes.append(batch.filter("kind = 'post'").count())

    for published in (range(1, 31), range(31, 33), range(33, 50)):
        publish("-1", *published)
        publish("-2", *published)
        opts = options(resume=collector.resume_point(spark, check))
        query = spark.readStream.format("wall_test").options(**opts).load().writeStream.foreachBatch(run).option("checkpointLocation", check).trigger(processingTime="50 milliseconds").start()
        query.processAllAvailable()
        query.stop()
    assert max(sizes) <= 24 and len(sizes) > 4
    got = Counter(r.source_id for r in spark.read.parquet(out).filter("source_type = 'vk_post'").collect())
    assert got == Counter(f"{o}_{i}" for o in (-1, -2) for i in range(1, 50) if i % 7)
    under = spark.read.parquet(out).filter("source_type = 'vk_comment'")
    assert under.count() == 2 * sum(i % 4 for i in range(1, 50)) and under.filter("parent_id IS NULL").count() == 0


def message(i, **more):
    row = {"source_type": "vk_post", "source_id": f"1_{i}", "author_id": "a", "text": f"text {i}", "created_at_utc": "2024-01-01T00:00:00Z", "collected_at": "2024-01-01T01:00:00Z", "reach": i, "raw_payload": {"id": i}} | more
    return json.dumps({k: v for k, v in row.items() if v is not None})


def stream_of(spark, path):
    return spark.readStream.schema("value string, original_partition string, original_offset long").parquet(path)


def test_consumer_with_dead_letters(spark, tmp_path):
    """A batch that ends between its two sinks and is repeated leaves each row once; letters are retried and end as final."""
    lines = [message(i) for i in range(6)] + [message(2, reach=99, collected_at="2024-01-01T02:00:00Z"), message(7, text=None), message(8, odd=1), "no json", message(9, text="poison")]
    spark.createDataFrame([(v, "p0", i) for i, v in enumerate(lines)], "value string, original_partition string, original_offset long").coalesce(1).write.parquet(f"{tmp_path}/in")
    table, letters, check = f"{tmp_path}/raw", f"{tmp_path}/letters", f"{tmp_path}/check"
    poison = lambda df: df.withColumn("refused", F.when(F.col("text") == "poison", "cannot be taken"))
    fails = [True]

    def break_off(df):
        if fails.pop() if fails else False:
            raise RuntimeError("ends before anything is written")
        return poison(df)

    with pytest.raises(Exception, match="ends before"):
        raw.consume_job(stream_of(spark, f"{tmp_path}/in"), table, letters, check, break_off).awaitTermination(120)
    upsert, tables_upsert = tables.upsert, []

    def half(*args, **kwargs):
        tables_upsert.append(1)
        if len(tables_upsert) == 1:
            raise RuntimeError("ends between the sinks")
        return upsert(*args, **kwargs)

    raw.tables.upsert = half
    try:
        with pytest.raises(Exception, match="between"):
            raw.consume_job(stream_of(spark, f"{tmp_path}/in"), table, letters, check, poison).awaitTermination(120)
        for _ in range(2):
            raw.consume_job(stream_of(spark, f"{tmp_path}/in"), table, letters, check, poison).awaitTermination(120)
    finally:
        raw.tables.upsert = upsert
    got = {r.source_id: (r.reach, json.loads(r.raw_payload)["id"]) for r in tables.rows_of(spark, table).collect()}
    assert got == {f"1_{i}": (99 if i == 2 else i, i) for i in range(6)}
    bad = sorted((r.original_offset, r.kind, r.error, r.attempt) for r in spark.read.parquet(letters).collect())
    assert bad == [(7, "validation_error", "a required field is missing", 1), (8, "validation_error", "unknown fields: odd", 1), (9, "validation_error", "not a JSON object", 1), (10, "processing_error", "cannot be taken", 1)]
    # the poison is cured: a retry takes it in, the others come back with one attempt more
    for _ in range(2):
        raw.retry_job(spark, letters, table, f"{tmp_path}/second", f"{tmp_path}/check2").awaitTermination(120)
    assert tables.rows_of(spark, table).count() == 7
    assert sorted((r.original_offset, r.attempt) for r in spark.read.parquet(f"{tmp_path}/second").collect()) == [(7, 2), (8, 2), (9, 2)]
    raw.retry_job(spark, f"{tmp_path}/second", table, f"{tmp_path}/third", f"{tmp_path}/check3").awaitTermination(120)
    raw.retry_job(spark, f"{tmp_path}/third", table, f"{tmp_path}/fourth", f"{tmp_path}/check4").awaitTermination(120)
    assert {r.attempt for r in spark.read.parquet(f"{tmp_path}/third").collect()} == {3} and spark.read.schema(raw.LETTER).option("recursiveFileLookup", True).parquet(f"{tmp_path}/fourth").count() == 0


def test_upsert_touches_its_buckets_only(spark, tmp_path):
    path, key = f"{tmp_path}/t", ("a", "b")
    first = spark.range(400).select((F.col("id") % 40).cast("int").alias("a"), F.when(F.col("id") % 40 > 0, F.col("id")).alias("b"), F.lit(1).alias("v"), F.lit("x").alias("text"))
    assert tables.upsert(first, path, key, ("v",), buckets=16) == 16
    stamp = lambda: {d: sorted((f, os.path.getmtime(f"{path}/{d}/{f}")) for f in os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("bucket")}
    before = stamp()
    update = spark.createDataFrame([(3, 3, 2, "new"), (3, 43, 0, "old"), (99, None, 5, "null key"), (99, None, 4, "null key, older")], "a int, b long, v int, text string")
    n = tables.upsert(update, path, key, ("v",), buckets=16)
    after = stamp()
    assert n <= 3 and sum(before[d] != after[d] for d in before) == n
    rows = tables.rows_of(spark, path)
    assert rows.count() == 1 + 390 + 1  # the ten rows of a null key are one
    assert [tuple(r) for r in rows.filter("a = 3 AND b IN (3, 43)").orderBy("b").collect()] == [(3, 3, 2, "new"), (3, 43, 1, "x")]
    assert rows.filter("a = 99").first().text == "null key"
    assert tables.upsert(update, path, key, ("v",), buckets=16) == n and tables.rows_of(spark, path).count() == 392
    assert tables.rows_of(spark, path, update, key, buckets=16).count() == 2
    assert tables.upsert(update.limit(0), path, key, ("v",), buckets=16) == 0 and tables.rows_of(spark, f"{tmp_path}/none") is None


def test_generations_switch_at_once(spark, tmp_path):
    runs = tables.Generations(spark, f"{tmp_path}/g")
    assert runs.current() is None and runs.table("a") is None
    runs.write({"a": spark.range(3), "b": spark.range(1)}, {"period_end": "2024-01-01"})
    broken = spark.range(2).select(F.assert_true(F.lit(False)).alias("id"))
    with pytest.raises(Exception):
        runs.write({"a": spark.range(9), "b": broken})
    assert runs.table("a").count() == 3 and runs.current()["period_end"] == "2024-01-01"
    runs.write({"a": spark.range(5), "b": spark.range(1)})
    assert runs.table("a").count() == 5 and runs.current()["number"] == 2
    runs.write({"a": spark.range(6), "b": spark.range(1)})
    assert len(runs.clear(keep=2)) == 1 and runs.table("a").count() == 6


def test_channel_dump_is_read_once_and_posts_leave_their_channel(spark, tmp_path):
    """Odd channels and posts; the dump is parsed for posts and comments together, and no post carries its whole channel."""
    import re

    from tidemark.sources import files

    at = "2024-01-01T00:00:00Z"
    post = lambda i, **more: {"id": i, "text": f"t{i}", "created_at": at} | more
    lines = [
        {"id": "a", "owner_id": "o", "is_official": True, "posts": [post(1, comments=[{"id": "c", "text": "x", "created_at": at, "likes": 2}, {"id": "d", "text": " ", "created_at": at}]), post(2, text=" ", comments=[{"id": "e", "text": "y", "created_at": at}]), post(3, is_official=False, channel_id="z", author_id="w")]},
        {"id": "b", "posts": None}, {"id": "b"}, {"id": "b", "posts": []}, {"id": "b", "posts": "none"}, {"channels": [{"id": 7, "posts": [post(1, comments=None, reach=5)]}, {"id": 8, "posts": json.dumps([post(9)])}]}, {"channels": []},
    ]
    (tmp_path / "d.jsonl").write_text("\n".join(map(json.dumps, lines)))
    rows = files.channel_messages(spark, str(tmp_path / "d.jsonl"))
    got = {r.source_id: (r.source_type, r.parent_id, r.author_id, r.text, r.is_official, r.reach, r.likes) for r in rows.collect()}
    assert got == {
        "a_1": ("max_post", None, "o", "t1", True, 0, 0), "a_1_c": ("max_comment", "a_1", "unknown", "x", False, 0, 2), "a_2_e": ("max_comment", "a_2", "unknown", "y", False, 0, 0), "z_3": ("max_post", None, "w", "t3", False, 0, 0),
        "7_1": ("max_post", None, "unknown", "t1", False, 5, 0), "8_9": ("max_post", None, "unknown", "t9", False, 0, 0),
    }
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    carried = [g.split("[")[2] for g in re.findall(r"Generate explode\(posts.*", plan)]
    assert carried and not any(re.search(r"\bc#", c) for c in carried)
