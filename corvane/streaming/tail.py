"""Tail of JSON-lines files by byte offset, a bounded number of events a batch.

A Python data source: its offset is the byte reached in each file, so a checkpoint is all that a
restart needs. ``latestOffset`` looks ahead from the byte reached until it has met ``limit``
events or the end; blank and broken lines, and lines that hold no object, move the offset without
counting. The rows themselves are read by tasks, one for each file and range of a batch.

A batch has a fixed cost and batches of one stream follow each other, so a large folder is dealt to
several streams that run side by side: each has its share of the files, its own checkpoint and batches
of at most ``limit`` events. A file stays in its share, so its events stay in order.
"""

from __future__ import annotations

import json
import logging
import re
import time
import zlib
from collections.abc import Callable, Iterator

from pyarrow import fs
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

CHUNK = 1 << 20
LIMIT = 200
# what one look ahead reads at most, so that a long run of broken lines is passed in several batches
LOOK_AHEAD = 64 << 20
# how many streams start at a time, and how often one is started before its error counts
STARTING, TRIES = 3, 3
_LOG = logging.getLogger(__name__)


class Range(InputPartition):
    """Bytes ``start`` to ``end`` of a file."""

    def __init__(self, path: str, start: int, end: int) -> None:
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


def lines_from(store: fs.FileSystem, path: str, start: int, end: int | None = None) -> Iterator[tuple[int, bytes]]:
    """Byte after each line and the line, from ``start`` up to ``end`` or the end of the file.

    A last line without a line break counts as a line.
    """
    with store.open_input_file(path) as handle:
        stop = handle.size() if end is None else min(end, handle.size())
        handle.seek(min(start, stop))
        at, rest = start, b""
        while at + len(rest) < stop:
            data = handle.read(min(CHUNK, stop - at - len(rest)))
            if not data:
                break
            parts = (rest + data).split(b"\n")
            rest = parts.pop()
            for line in parts:
                at += len(line) + 1
                yield at, line
        if rest:
            yield at + len(rest), rest


def event_of(line: bytes) -> str | None:
    """The text of a line that holds a JSON object, else None."""
    text = line.decode("utf-8", "replace").strip()
    try:
        return text if text and isinstance(json.loads(text), dict) else None
    except ValueError:
        return None


def share_of(name: str, shares: int) -> int:
    """The share of a file: numbered files are dealt in turn, others by a hash of their name."""
    number = re.search(r"\d+", name)
    return (int(number[0]) if number else zlib.crc32(name.encode())) % shares


class TailReader(DataSourceStreamReader):
    def __init__(self, folder: str, limit: int, share: int = 0, shares: int = 1) -> None:
        self.folder, self.limit, self.share, self.shares = folder, limit, share, shares
        self.reached: dict[str, int] | None = None

    def _files(self) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
        store, path = fs.FileSystem.from_uri(self.folder)
        found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
        kept = [f for f in found if f.is_file and f.size and not f.base_name.startswith(("_", ".")) and share_of(f.base_name, self.shares) == self.share]
        # in the order in which they were written
        return store, sorted(kept, key=lambda f: (f.mtime_ns or 0, f.path))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        reached = dict(self.reached or {})
        events = seen = 0
        store, files = self._files()
        for file in files:
            at = reached.get(file.path, 0)
            if at >= file.size:
                continue
            for after, line in lines_from(store, file.path, at):
                seen += after - at
                at = after
                events += event_of(line) is not None
                if events >= self.limit or seen >= LOOK_AHEAD:
                    break
            reached[file.path] = at
            if events >= self.limit or seen >= LOOK_AHEAD:
                break
        self.reached = reached
        return reached

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        # on a restart the engine plans the last batch again before it asks for the latest offset
        if self.reached is None:
            self.reached = dict(end)
        return [Range(path, start.get(path, 0), to) for path, to in sorted(end.items()) if to > start.get(path, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(self.folder)
        for after, line in lines_from(store, partition.path, partition.start, partition.end):
            text = event_of(line)
            if text is not None:
                yield partition.path, after, text


class EventTail(DataSource):
    """``format("event_tail")`` with options ``path``, ``limit``, ``share`` and ``shares``."""

    @classmethod
    def name(cls) -> str:
        return "event_tail"

    def schema(self) -> str:
        return "path string, offset bigint, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader(self.options["path"], int(self.options.get("limit", LIMIT)), int(self.options.get("share", 0)), int(self.options.get("shares", 1)))


def tail_events(spark: SparkSession, folder: str, schema: str, limit: int = LIMIT, share: int = 0, shares: int = 1) -> DataFrame:
    """Events of the JSON lines in ``folder`` as a stream of ``schema``, at most ``limit`` a batch.

    ``path`` and ``offset``, the byte after the event's line, come first. With ``shares`` the stream
    has the files of its ``share`` only; all shares together have each file once.
    """
    spark.dataSource.register(EventTail)
    rows = spark.readStream.format("event_tail").option("path", folder).options(limit=limit, share=share, shares=shares).load()
    return rows.select("path", "offset", F.from_json("value", schema).alias("_event")).select("path", "offset", "_event.*")


def drain(stream: DataFrame, each_batch, checkpoint: str) -> None:
    """Batch after batch through ``each_batch(df, batch_id)`` until nothing is left."""
    drain_all([(stream, each_batch, checkpoint)])


def drain_all(streams: list[tuple[DataFrame, Callable, str]], tries: int = TRIES) -> None:
    """The same for several ``(stream, each_batch, checkpoint)`` side by side.

    A stream starts a Python process for its source, which must answer within seconds. So ``STARTING`` of
    them start at a time. A stream that fails all the same goes on, one start at a time, from its checkpoint, once the others are
    through; after ``tries`` starts its error is raised.
    """
    for left in reversed(range(tries)):
        streams = _drain_once(streams, STARTING if left == tries - 1 else 1, last=not left)
        if not streams:
            break


def _drain_once(streams: list[tuple[DataFrame, Callable, str]], starting: int, last: bool) -> list[tuple[DataFrame, Callable, str]]:
    """Those of ``streams`` that failed; on the ``last`` try their error is raised."""
    queries, failed = [], []
    try:
        for stream, each_batch, checkpoint in streams:
            query = stream.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint).start()
            queries.append(query)
            while sum(q.isActive and q.status["message"].startswith("Initializing") for q in queries) >= starting:
                time.sleep(0.02)
        for stream, query in zip(streams, queries):
            try:
                query.processAllAvailable()
            except StreamingQueryException:
                if last:
                    raise
                _LOG.exception("a stream failed and goes on from its checkpoint")
                failed.append(stream)
    finally:
        for query in queries:
            query.stop()
    return failed
