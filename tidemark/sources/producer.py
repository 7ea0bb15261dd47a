"""A batched producer as a streaming sink.

Tasks hand rows to a sender in batches: after ``flush_rows`` rows or ``flush_seconds`` since the first unsent one, and at the
task's end. What a task sends is staged under (epoch, partition, attempt) and becomes visible when the micro-batch commits, so an aborted one, or a
task that ran twice, leaves nothing behind. ``FolderTopic`` is such a topic in a folder that driver and executors share; a
broker with transactions fits the same four calls.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage


class Topic(Protocol):
    def stage(self, part: str, messages: list[dict]) -> None:
        """Hand over one batch of messages of a part; not yet visible."""

    def publish(self, epoch: int, parts: list[str]) -> None:
        """Make all staged batches of ``parts`` visible, once for an epoch."""

    def discard(self, parts: list[str]) -> None: ...


@dataclass(frozen=True)
class FolderTopic:
    """Segments of JSON lines: ``path/segments/<epoch>/<part>.jsonl``."""

    path: str

    def _staged(self, part: str) -> str:
        return os.path.join(self.path, "staged", f"{part}.jsonl")

    def stage(self, part: str, messages: list[dict]) -> None:
        os.makedirs(os.path.join(self.path, "staged"), exist_ok=True)
        with open(self._staged(part), "a", encoding="utf-8") as f:
            f.write("".join(json.dumps(m, ensure_ascii=False) + "\n" for m in messages))
            f.flush()
            os.fsync(f.fileno())

    def publish(self, epoch: int, parts: list[str]) -> None:
        final, ready = os.path.join(self.path, "segments", f"{epoch:012d}"), os.path.join(self.path, "staged", f"{epoch:012d}-{uuid.uuid4().hex}")
        if os.path.isdir(final):  # this epoch is published: the micro-batch ran again
            self.discard(parts)
            return
        os.makedirs(ready)
        for part in parts:
            if os.path.exists(self._staged(part)):
                os.rename(self._staged(part), os.path.join(ready, f"{part}.jsonl"))
        os.makedirs(os.path.dirname(final), exist_ok=True)
        os.rename(ready, final)

    def discard(self, parts: list[str]) -> None:
        for part in parts:
            if os.path.exists(self._staged(part)):
                os.remove(self._staged(part))

    def messages(self) -> list[dict]:
        """All visible messages in order; for small topics."""
        out, top = [], os.path.join(self.path, "segments")
        for epoch in sorted(os.listdir(top)) if os.path.isdir(top) else ():
            for name in sorted(os.listdir(os.path.join(top, epoch))):
                with open(os.path.join(top, epoch, name), encoding="utf-8") as f:
                    out += [json.loads(line) for line in f]
        return out


@dataclass
class Sent(WriterCommitMessage):
    part: str
    rows: int
    flushes: int


class Producer(DataSourceStreamWriter):
    def __init__(self, topic: Topic, options):
        self.topic, self.rows, self.seconds = topic, int(options.get("flush_rows", 100)), float(options.get("flush_seconds", 2.0))

    def write(self, iterator) -> Sent:
        part, held, n, flushes, first = uuid.uuid4().hex, [], 0, 0, 0.0
        for row in iterator:
            if not held:
                first = time.monotonic()
            held.append(row.asDict(recursive=True))
            n += 1
            if len(held) >= self.rows or time.monotonic() - first >= self.seconds:
                self.topic.stage(part, held)
                held, flushes = [], flushes + 1
        if held:
            self.topic.stage(part, held)
            flushes += 1
        return Sent(part, n, flushes)

    def commit(self, messages, batchId) -> None:  # noqa: N803
        self.topic.publish(batchId, [m.part for m in messages if m is not None])

    def abort(self, messages, batchId) -> None:  # noqa: N803
        self.topic.discard([m.part for m in messages if m is not None])


def topic_sink(name: str, topic: Topic) -> type[DataSource]:
    """A sink to register: ``spark.dataSource.register(topic_sink("raw_topic", FolderTopic(path)))``, then ``writeStream.format("raw_topic")``
    with ``flush_rows`` (100) and ``flush_seconds`` (2)."""

    class Sink(DataSource):
        @classmethod
        def name(cls):
            return name

        def streamWriter(self, schema, overwrite):
            return Producer(topic, self.options)

    return Sink
