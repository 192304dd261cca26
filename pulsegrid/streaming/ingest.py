"""Arriving LAS files as a stream: spark.readStream.format("las").option("path", folder).

A file is known by its name and read once, whatever its time: files that arrive late with an older time, are copied
with times kept or go away again don't move others. An offset holds the names seen so far. For folders with very many
files the option log names a folder that driver restarts keep (beside the query's checkpoint, say): the names of each
step are written there as one small file, and an offset is only the number of steps. A file that is gone when its
batch is read is left out with a warning. The schema is that of the files present at the start or the one given.
"""

from __future__ import annotations

import json
import os
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSourceStreamReader

from ..sources import las


def present(path: str) -> list[str]:
    try:
        return las.files_of(path)
    except FileNotFoundError:
        return []


class Names:
    """Offsets that hold all names seen."""

    start: dict = {"names": []}

    def next(self, before: set[str], found: list[str]) -> dict:
        return {"names": sorted(before | set(found))}

    def between(self, start: dict, end: dict) -> list[str]:
        return sorted(set(end["names"]) - set(start["names"]))

    def known(self) -> set[str]:
        return set()


class Log:
    """Offsets that count the steps of a log; step n is the file n.json in its folder."""

    start: dict = {"steps": 0}

    def __init__(self, folder: str):
        self.folder = folder.removeprefix("file://").removeprefix("file:")
        os.makedirs(self.folder, exist_ok=True)
        self.steps = 0
        while os.path.exists(self._file(self.steps + 1)):
            self.steps += 1

    def _file(self, n: int) -> str:
        return os.path.join(self.folder, f"{n}.json")

    def next(self, before: set[str], found: list[str]) -> dict:
        new = sorted(set(found) - before)
        if new:
            part = self._file(self.steps + 1)
            with open(part + ".part", "w") as out:
                json.dump(new, out)
            os.replace(part + ".part", part)
            self.steps += 1
        return {"steps": self.steps}

    def between(self, start: dict, end: dict) -> list[str]:
        out = []
        for n in range(start["steps"] + 1, end["steps"] + 1):
            with open(self._file(n)) as f:
                out += json.load(f)
        return out

    def known(self) -> set[str]:
        return set(self.between(self.start, {"steps": self.steps}))


class LasStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options, self.schema = options, schema
        self.offsets: Names | Log = Log(options["log"]) if options.get("log") else Names()
        self.seen = self.offsets.known()

    def initialOffset(self) -> dict:
        return dict(self.offsets.start)

    def latestOffset(self) -> dict:
        found = present(self.options["path"])
        out = self.offsets.next(self.seen, found)
        self.seen |= set(found)
        return out

    def partitions(self, start: dict, end: dict) -> list[las.Slice]:
        # After a restart the names of the last offset are known again from the offset itself.
        self.seen |= set(end.get("names", ()))
        new = self.offsets.between(start, end)
        here = [p for p in new if os.path.exists(p)]
        if len(here) < len(new):
            warnings.warn(f"{len(new) - len(here)} files are gone before they were read", stacklevel=2)
        return las.slices([(p, os.path.getsize(p)) for p in here], int(self.options.get("split_bytes", las.SPLIT_BYTES))) or [las.Slice()]

    def read(self, part: las.Slice) -> Iterator[pa.RecordBatch]:
        yield from las.PointReader(self.options, self.schema).read(part)

    def commit(self, end: dict) -> None:
        self.seen |= set(end.get("names", ()))
