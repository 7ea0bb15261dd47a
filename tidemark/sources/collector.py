"""A paged interface as a streaming source: posts of walls and their comments.

The interface gives items newest first, in pages by offset, and new items push the old ones on. A
wall's position is therefore the id of its newest item that was taken, never an offset. A micro-batch takes
the items with ids in (start, end]. The driver asks single items only, to find the
offsets between which those lie (binary search) and where pages can be cut; tasks fetch the pages. A
task knows its ids and only begins at an offset, so items that were published in between shift nothing out of
its reach, and a range that is read again gives the same ids.

Admission: at most ``max_items`` of a wall and, with ``max_hours``, items of that time at most in a micro-batch; the rest waits for the
next. ``since`` (seconds) leaves out what is older. Spark tells a restarted source its position only with the first batch, so a job that
starts again hands it on with ``resume`` (``resume_point`` reads it from the checkpoint).
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidemark.sources import files

SCHEMA = "owner string, kind string, payload string, post string"


class Interface(Protocol):
    """What a source needs of a service. Items are objects with ``id`` (rising with time) and ``date`` (seconds)."""

    def page(self, owner: str, offset: int, count: int) -> tuple[int, list[dict]]:
        """Number of all items, and ``count`` of them from ``offset`` on, newest first."""

    def comments(self, owner: str, post: dict, offset: int, count: int) -> list[dict]: ...


@dataclass
class WallService:
    """``wall.get`` and ``wall.getComments`` over HTTP: JSON {"response": {"count", "items"}} or {"error": {...}}."""

    base: str
    token: str = ""
    version: str = "5.199"
    timeout: float = 15.0
    attempts: int = 3
    wait: float = 0.5

    def _get(self, method: str, **params) -> dict:
        from urllib.parse import urlencode
        from urllib.request import urlopen

        query = urlencode(params | {"v": self.version} | ({"access_token": self.token} if self.token else {}))
        for attempt in range(1, self.attempts + 1):
            try:
                with urlopen(f"{self.base.rstrip('/')}/{method}?{query}", timeout=self.timeout) as answer:
                    said = json.load(answer)
                if "response" in said:
                    return said["response"]
                problem: Exception = RuntimeError(f"{method}: {said.get('error', {}).get('error_msg', 'no response')}")
            except (OSError, ValueError) as e:
                problem = e
            if attempt < self.attempts:
                time.sleep(self.wait * 2 ** (attempt - 1))
        raise problem

    def page(self, owner: str, offset: int, count: int) -> tuple[int, list[dict]]:
        said = self._get("wall.get", owner_id=owner, offset=offset, count=count)
        return int(said.get("count", 0)), said.get("items", [])

    def comments(self, owner: str, post: dict, offset: int, count: int) -> list[dict]:
        return self._get("wall.getComments", owner_id=owner, post_id=post["id"], offset=offset, count=count).get("items", [])


def first_offset(api: Interface, owner: str, older, low: int = 0) -> int:
    """The smallest offset from ``low`` on whose item is ``older`` (a test that holds from some item on); the number of items if none is."""
    high = api.page(owner, 0, 1)[0]
    while low < high:
        at = (low + high) // 2
        items = api.page(owner, at, 1)[1]
        if not items or older(items[0]):
            high = at
        else:
            low = at + 1
    return low


class Pages(InputPartition):
    """Items of a wall with ids in (low, high], at ``offset`` or beyond."""

    def __init__(self, owner: str, offset: int, low: int, high: int):
        super().__init__((owner, offset, low, high))


class PagedReader(DataSourceStreamReader):
    def __init__(self, api: Interface, options):
        self.api = api
        self.owners = [o for o in options["owners"].split(",") if o]
        self.page_size, self.pages = int(options.get("page_size", 20)), int(options.get("pages_a_task", 10))
        self.max_items, self.max_hours = int(options.get("max_items", 100)), float(options.get("max_hours", 0))
        self.since = float(options.get("since", 0))
        self.at: dict[str, int] = json.loads(options.get("resume") or "{}")

    def initialOffset(self) -> dict:
        out = {}
        for owner in self.owners:
            old = self.api.page(owner, first_offset(self.api, owner, lambda x: x["date"] < self.since), 1)[1] if self.since else []
            out[owner] = int(old[0]["id"]) if old else 0
        self.at = {**out, **self.at}
        return out

    def _end(self, owner: str, start: int) -> int:
        newer = first_offset(self.api, owner, lambda x: x["id"] <= start)
        if not newer:
            return start
        last = max(0, newer - self.max_items)
        if self.max_hours:
            oldest = self.api.page(owner, newer - 1, 1)[1][0]["date"]
            last = max(last, first_offset(self.api, owner, lambda x: x["date"] <= oldest + 3600 * self.max_hours))
        return max(start, int(self.api.page(owner, last, 1)[1][0]["id"]))

    def latestOffset(self) -> dict:
        if not self.at:
            self.initialOffset()
        self.at = {owner: self._end(owner, self.at.get(owner, 0)) for owner in self.owners}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        self.at = {**self.at, **{o: max(n, self.at.get(o, 0)) for o, n in end.items()}}
        out = []
        for owner, high in end.items():
            low = start.get(owner, 0)
            if high <= low:
                continue
            first = first_offset(self.api, owner, lambda x: x["id"] <= high)
            stop = first_offset(self.api, owner, lambda x: x["id"] <= low, first)
            edges = list(range(first, stop, self.page_size * self.pages))
            marks = [high, *(int(self.api.page(owner, e, 1)[1][0]["id"]) for e in edges[1:]), low]
            out += [Pages(owner, e, marks[i + 1], marks[i]) for i, e in enumerate(edges)]
        return out

    def _comments(self, owner: str, post: dict) -> Iterator[dict]:
        offset = 0
        while items := self.api.comments(owner, post, offset, self.page_size):
            yield from items
            offset += len(items)
            if len(items) < self.page_size:
                return

    def read(self, partition: Pages) -> Iterator[tuple]:
        owner, offset, low, high = partition.value
        text = lambda x: json.dumps(x, ensure_ascii=False)
        reached = high + 1  # items pushed on between two pages come twice
        while True:
            items = self.api.page(owner, offset, self.page_size)[1]
            for item in items:
                if item["id"] <= low:
                    return
                if item["id"] >= reached:
                    continue
                reached = item["id"]
                if item["date"] >= self.since:
                    yield owner, "post", text(item), None
                    for comment in self._comments(owner, item):
                        if comment["date"] >= self.since:
                            yield owner, "comment", text(comment), text({k: item[k] for k in ("owner_id", "id") if k in item})
            if not items:
                return
            offset += len(items)


def paged_source(name: str, api: Interface) -> type[DataSource]:
    """A data source to register: ``spark.dataSource.register(paged_source("wall", WallService(...)))``."""

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return SCHEMA

        def streamReader(self, schema):
            return PagedReader(api, self.options)

    return Paged


def resume_point(spark: SparkSession, checkpoint: str) -> str:
    """The position of the last micro-batch that a checkpoint has planned, for the option ``resume``; empty at the first start."""
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.text(f"{checkpoint}/offsets", wholetext=True).select(F.col("_metadata.file_name").alias("n"), "value")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return ""
    last = found.filter(F.col("n").rlike("^[0-9]+$")).orderBy(F.col("n").cast("long").desc()).limit(1).collect()  # a checkpoint keeps the last batches only
    return last[0].value.strip().split("\n")[-1] if last else ""


def messages(items: DataFrame) -> DataFrame:
    """Raw messages of collected posts and comments that have text."""
    names = [f.name for f in files.RAW.fields]

    def shaped(kind: str, fields: dict) -> DataFrame:
        rows = items.filter(F.col("kind") == kind).select(*[v.alias(k) for k, v in fields.items()]).withColumn("collected_at", F.current_timestamp())
        return rows.filter(F.trim("text") != "").select(*[F.col(f.name).cast(f.dataType) for f in files.RAW.fields if f.name in names])

    return shaped("post", files.vk_post(F.col("payload"))).unionByName(shaped("comment", files.vk_comment(F.col("payload"), F.col("post"))))
