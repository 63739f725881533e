"""A stream of items made by position, a chunk at a time: endless, or bounded by number or by clock.

    spark.dataSource.register(Chunks)
    spark.readStream.format("chunks").option("chunk", 5000).option("rows", 100000).load()

The driver only counts: a chunk is offered when the one before it is planned, and its tasks make their own rows. What
is finished is written to `state`, so a restart goes on behind it.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Items of a chunk, and tasks that make them.
CHUNK, TASKS = 5000, 8
#: Lists of words that an item takes one of each from, where no maker is named.
WORDS = (("please", "kindly", "now"), ("check", "read", "judge", "sort"), ("this", "that", "every"), ("ticket", "note", "letter", "review", "order"))


def made(position: int) -> str:
    """An item's text, the same for a position wherever it is made."""
    rest, words = position, []
    for some in WORDS:
        rest, k = divmod(rest, len(some))
        words.append(some[k])
    return f"{' '.join(words)} {position}"


class Part(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class Reader(DataSourceStreamReader):
    """Offsets are positions. rows bounds them, seconds ends the source so long after its first chunk was offered; without either it
    is endless."""

    def __init__(self, options: dict[str, str]):
        get = lambda name, default=None: options.get(name, default)
        self.chunk, self.tasks, self.maker = int(get("chunk", CHUNK)), int(get("tasks", TASKS)), get("maker")
        self.rows, self.seconds = (None if get(name) is None else kind(get(name)) for name, kind in (("rows", int), ("seconds", float)))
        if self.chunk < 1 or self.tasks < 1:
            raise ValueError("chunk and tasks must be positive")
        self.state, self.begun = get("state"), None
        self.offered = self.planned = self._finished()

    def _where(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.state)

    def _finished(self) -> int:
        """The position behind the last chunk that is finished."""
        if not self.state:
            return 0
        where, name = self._where()
        if where.get_file_info(name).type.name == "NotFound":
            return 0
        with where.open_input_stream(name) as f:
            return json.loads(f.read())["at"]

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        self.begun = self.begun or time.monotonic()
        over = self.seconds is not None and time.monotonic() - self.begun >= self.seconds
        if self.offered == self.planned and not over:
            end = self.offered + self.chunk
            self.offered = end if self.rows is None else max(self.offered, min(end, self.rows))
        return {"at": self.offered}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        a, b = start["at"], end["at"]
        self.planned, self.offered = max(self.planned, b), max(self.offered, b)
        step = max(1, -(-(b - a) // self.tasks))
        return [Part(k, min(k + step, b)) for k in range(a, b, step)]

    def read(self, partition: Part) -> Iterator[tuple[int, str]]:
        make: Callable[[int], str] = made
        if self.maker:
            module, _, name = self.maker.partition(":")
            make = getattr(importlib.import_module(module), name)
        for k in range(partition.start, partition.end):
            yield k, make(k)

    def commit(self, end: dict) -> None:
        if self.state:
            where, name = self._where()
            where.create_dir(name.rpartition("/")[0])
            with where.open_output_stream(name) as f:
                f.write(json.dumps(end).encode())


class Chunks(DataSource):
    """The data source `chunks`: pos and item. Options: chunk, rows, seconds, tasks, state (the URI of a file), maker
    (`module:function` of a position, importable on the executors)."""

    @classmethod
    def name(cls) -> str:
        return "chunks"

    def schema(self) -> str:
        return "pos long, item string"

    def streamReader(self, schema) -> Reader:
        return Reader(dict(self.options))
