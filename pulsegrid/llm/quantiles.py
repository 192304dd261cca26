"""Percentiles of groups by mergeable sketches with relative rank error.

A sketch is a list of levels; an item of level h stands for 2**h readings. A full level is compacted: it is sorted,
its upper tail (or lower, for accuracy="low") is kept and of the rest every second item moves one level up, so the
ranks near the protected end stay exact and errors elsewhere are in proportion to the distance from that end. How
much is kept grows with the trailing zeros of the number of compactions, as in relative-rank compactors. Which of
two items moves up is drawn anew for every second compaction and inverted for the next.

Both ends are served: a column has one sketch that protects its high tail and one that protects its low tail;
a percentile is read from the nearer one. With section size K and both ends the standard error of a rank is about
ERROR times the distance (in ranks) to the nearer end; relative_error() gives the bound that results state.

Groups are sketched inside each partition first, whatever their size, so a hot group costs each task one small
sketch and never meets in one task. Merging keeps the bound, so sketches of loads or days can be stored and
combined. Null and NaN readings are left out; groups without readings have no row.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

#: Items of a section; three sections make half of a fresh level.
SECTION = 64
SECTIONS = 3
FRACTIONS = (0.001, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999)
#: Readings of one task that are sketched at once.
CHUNK = 400_000
#: Items that the sketches of one task may hold together.
HELD = 4_000_000
#: Sketches of one group that one task merges before there is a step between.
FAN = 256


def relative_error(section: int = SECTION) -> float:
    """Three standard errors of a rank, relative to its distance from the nearer end."""
    return 3.0 * (1.0 / 8.0) ** 0.5 * 2.0 / section


def _scrambled(x: int) -> int:
    """A number of 64 bits whose every bit depends on all bits of x."""
    x = (x + 0x9E3779B97F4A7C15) % 2**64
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
    return x ^ (x >> 31)


class Sketch:
    """Levels of one tail: values are kept negated for the low one, so that the high end is the exact one."""

    __slots__ = ("section", "levels", "counts", "n", "low", "high", "coin")

    def __init__(self, section: int = SECTION, seed: int = 0):
        self.section, self.levels, self.counts, self.n = section, [np.empty(0)], [0], 0
        self.low, self.high, self.coin = np.inf, -np.inf, _scrambled(seed)

    def capacity(self, level: int) -> int:
        return 2 * self.section * (SECTIONS + max(0, int(self.counts[level]).bit_length() // 2))

    def add(self, values: np.ndarray) -> None:
        if len(values):
            self.n += len(values)
            self.low, self.high = min(self.low, float(values.min())), max(self.high, float(values.max()))
            self.levels[0] = np.concatenate([self.levels[0], values])
            self.compact()

    def compact(self) -> None:
        h = 0
        while h < len(self.levels):
            items = self.levels[h]
            while len(items) >= self.capacity(h):
                if h + 1 == len(self.levels):
                    self.levels.append(np.empty(0))
                    self.counts.append(0)
                items = np.sort(items)
                cap = self.capacity(h)
                zeros = (~self.counts[h] & (self.counts[h] + 1)).bit_length() - 1
                keep = max(cap // 2 - min(zeros, SECTIONS) * self.section, self.section)
                move = (len(items) - keep) // 2 * 2
                if self.counts[h] % 2 == 0:
                    self.coin = _scrambled(self.coin + self.n + h)
                pick = ((self.coin >> 60) & 1) ^ (self.counts[h] % 2)
                up = items[:move][pick::2]
                items = items[move:]
                self.levels[h + 1] = np.concatenate([self.levels[h + 1], up])
                self.counts[h] += 1
            self.levels[h] = items
            h += 1

    def merge(self, other: Sketch) -> None:
        while len(self.levels) < len(other.levels):
            self.levels.append(np.empty(0))
            self.counts.append(0)
        for h, items in enumerate(other.levels):
            self.levels[h] = np.concatenate([self.levels[h], items])
            self.counts[h] |= other.counts[h]
        self.n += other.n
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        self.compact()

    def weighted(self) -> tuple[np.ndarray, np.ndarray]:
        v = np.concatenate(self.levels)
        w = np.concatenate([np.full(len(x), 2**h, np.int64) for h, x in enumerate(self.levels)])
        order = np.argsort(v, kind="stable")
        return v[order], w[order]

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        out.write(struct.pack("<iiqddQ", self.section, len(self.levels), self.n, self.low, self.high, self.coin))
        for items, count in zip(self.levels, self.counts):
            out.write(struct.pack("<iq", len(items), count))
            out.write(items.astype("<f8").tobytes())
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Sketch:
        section, levels, n, low, high, coin = struct.unpack_from("<iiqddQ", data)
        s = cls(section)
        s.levels, s.counts, s.n, s.low, s.high, s.coin = [], [], n, low, high, coin
        at = 40
        for _ in range(levels):
            k, count = struct.unpack_from("<iq", data, at)
            at += 12
            s.levels.append(np.frombuffer(data, "<f8", k, at).copy())
            s.counts.append(count)
            at += 8 * k
        return s


class TwoEnded:
    """A sketch for either tail. While no level is full it is the plain list of readings, kept once."""

    __slots__ = ("high", "low")

    def __init__(self, section: int = SECTION, seed: int = 0):
        self.high, self.low = Sketch(section, seed), None

    def items(self) -> int:
        return sum(map(len, self.high.levels)) + (sum(map(len, self.low.levels)) if self.low is not None else 0)

    def _split(self) -> None:
        if self.low is None:
            self.low = Sketch(self.high.section, self.high.coin + 1)
            self.low.add(-self.high.levels[0])

    def add(self, values: np.ndarray) -> None:
        if self.low is None and self.high.n + len(values) >= self.high.capacity(0):
            self._split()
        if self.low is not None:
            self.low.add(-values)
        self.high.add(values)

    def merge(self, other: TwoEnded) -> None:
        if other.low is None:
            self.add(other.high.levels[0])
            return
        self._split()
        self.low.merge(other.low)
        self.high.merge(other.high)

    def to_bytes(self) -> bytes:
        h = self.high.to_bytes()
        return struct.pack("<i", len(h)) + h + (self.low.to_bytes() if self.low is not None else b"")

    @classmethod
    def from_bytes(cls, data: bytes) -> TwoEnded:
        (k,) = struct.unpack_from("<i", data)
        out = cls()
        out.high = Sketch.from_bytes(data[4 : 4 + k])
        out.low = Sketch.from_bytes(data[4 + k :]) if len(data) > 4 + k else None
        return out

    def quantiles(self, fractions: np.ndarray) -> np.ndarray:
        """The readings of rank ceil(f * n), at least 1, or as near as the sketch knows."""
        n = self.high.n
        rank = np.clip(np.ceil(np.asarray(fractions) * n), 1, n)

        def read(s: Sketch, from_high: np.ndarray) -> np.ndarray:
            v, w = s.weighted()
            above = np.cumsum(w[::-1])
            at = np.searchsorted(above, from_high, "left")
            return v[::-1][np.minimum(at, len(v) - 1)]

        high = read(self.high, n - rank + 1)
        if self.low is None:
            return high
        out = np.where(rank > n / 2, high, -read(self.low, rank))
        return np.clip(out, self.high.low, self.high.high)


def _sketch_partition(section: int, keys: int):
    """Sketches each group of a task's rows: key columns, then the hash of the keys and the reading.

    Sketches are held from chunk to chunk, so a task gives one for each group unless they take over HELD items.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # Coins differ from task to task and group to group, so that errors of partitions are independent.
        context = TaskContext.get()
        task = context.partitionId() + 1 if context else 0
        waiting: list[pa.RecordBatch] = []
        rows = 0
        held: dict[int, TwoEnded] = {}
        heads: list[pa.RecordBatch] = []  # the keys of the groups held, in the order of held

        def absorb() -> None:
            table = pa.Table.from_batches(waiting).combine_chunks()
            value, group = table.column("value").to_numpy(), table.column("grp").to_numpy()
            order = np.lexsort((value, group))
            group, value = group[order], value[order]
            starts = np.r_[0, np.flatnonzero(group[1:] != group[:-1]) + 1]
            fresh = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(group)]):
                s = held.get(group[a])
                if s is None:
                    s = held[group[a]] = TwoEnded(section, task * 0x1000003 ^ int(group[a]))
                    fresh.append(order[a])
                s.add(value[a:b])
            if fresh:
                heads.extend(table.select(range(keys + 1)).take(pa.array(fresh)).combine_chunks().to_batches())

        def emit() -> pa.RecordBatch:
            head = pa.Table.from_batches(heads).combine_chunks().to_batches()[0]
            out = pa.RecordBatch.from_arrays([*head.columns, pa.array([s.to_bytes() for s in held.values()], pa.binary())], [*head.schema.names, "sketch"])
            held.clear()
            heads.clear()
            return out

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                rows += batch.num_rows
            if rows >= CHUNK:
                absorb()
                waiting, rows = [], 0
                if sum(s.items() for s in held.values()) > HELD:
                    yield emit()
        if waiting:
            absorb()
        if held:
            yield emit()

    return work


def _merge_partition(keys: int):
    """Merges runs of equal grp in sorted rows; one sketch is held at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, group, row = None, None, None
        for batch in batches:
            grp = batch.column(keys).to_numpy()
            blobs = batch.column(keys + 1)
            out, rows = [], []
            for i in range(batch.num_rows):
                if grp[i] != group or current is None:
                    if current is not None:
                        out.append(current if isinstance(current, bytes) else current.to_bytes())
                        rows.append(row)
                    group, current, row = grp[i], blobs[i].as_py(), batch.slice(i, 1).select(range(keys + 1))
                else:
                    if isinstance(current, bytes):
                        current = TwoEnded.from_bytes(current)
                    current.merge(TwoEnded.from_bytes(blobs[i].as_py()))
            if rows:
                head = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([*head.columns, pa.array(out, pa.binary())], [*head.schema.names, "sketch"])
        if current is not None:
            yield pa.RecordBatch.from_arrays([*row.columns, pa.array([current if isinstance(current, bytes) else current.to_bytes()], pa.binary())], [*row.schema.names, "sketch"])

    return work


def _schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def sketch(values: DataFrame, keys: list[str], value: str = "value", section: int = SECTION) -> DataFrame:
    """keys and sketch, one row for each group that has readings."""
    v = values.select(*keys, F.xxhash64(*keys).alias("grp"), F.col(value).cast("double").alias("value")).where("value is not null and not isnan(value)")
    parts = v.mapInArrow(_sketch_partition(section, len(keys)), f"{_schema(v, keys)}, grp long, sketch binary")
    return merge(checkpoint(parts), keys)


def merge(sketches: DataFrame, keys: list[str], fan: int = FAN) -> DataFrame:
    """Combines sketches, such as those of single loads, to those of keys.

    In two steps where a group has more than fan sketches: first runs of fan by place at random, then their results,
    so that a group of n sketches takes one task n / fan of them.
    """
    kinds = f"{_schema(sketches, keys)}, grp long, sketch binary"
    s = sketches.select(*keys, F.xxhash64(*keys).alias("grp"), "sketch")
    most = s.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    if most > fan:
        runs = int(-(-most // fan))
        s = s.withColumn("run", F.pmod(F.xxhash64("sketch"), F.lit(runs))).repartition(*keys, "run").sortWithinPartitions("run", "grp", *keys)
        s = s.select(*keys, F.xxhash64("grp", "run").alias("grp"), "sketch").mapInArrow(_merge_partition(len(keys)), kinds).withColumn("grp", F.xxhash64(*keys))
    s = s.repartition(*keys).sortWithinPartitions("grp", *keys)
    return s.mapInArrow(_merge_partition(len(keys)), kinds).drop("grp")


def percentiles(sketches: DataFrame, keys: list[str], fractions: tuple[float, ...] = FRACTIONS) -> DataFrame:
    """keys, n, min_value, max_value, percentiles (an array, in the order of fractions) and error_bound.

    The rank of each percentile is off by at most error_bound times its distance to the nearer end (about three
    standard errors); a group small enough to be kept whole has the bound 0.
    """
    f = np.array(fractions)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.num_columns - 1
            got = [TwoEnded.from_bytes(b) for b in batch.column(k).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:k], pa.array([s.high.n for s in got], pa.int64()), pa.array([s.high.low for s in got], pa.float64()), pa.array([s.high.high for s in got], pa.float64()),
                    pa.array([s.quantiles(f).tolist() for s in got], pa.list_(pa.float64())), pa.array([0.0 if s.low is None else relative_error(s.high.section) for s in got]),
                ],
                [*keys, "n", "min_value", "max_value", "percentiles", "error_bound"],
            )

    s = sketches.select(*keys, "sketch")
    return s.mapInArrow(work, f"{_schema(s, keys)}, n long, min_value double, max_value double, percentiles array<double>, error_bound double")
