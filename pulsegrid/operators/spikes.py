"""Implausible readings of each source: additive outliers, stuck runs and physical limit violations.

A source is one point_source_id of one file, in order of point_index. For each source and field a robust
autoregression is fitted to a cleaned copy of the series; each reading is compared with what the readings before
it and those after it predict. A reading that departs from both in the same direction is an additive outlier. Level
shifts, found where the medians of the readings before and after a place differ by more than the limit and stay so, are
estimated and taken out of the series before it is fitted and tested again; they are ordinary and not reported.
Outliers found are replaced by the prediction and the fit is repeated until the outliers stay the same or the rounds go
in a circle. Where the autoregression explains a series far better than its level does (an oscillation), its residuals
alone decide. Outliers in runs of more than three are an excursion of the source, no spike. Runs of equal readings
and values outside the physical limits are found apart and take no part in the fit.

Sources are worked on in stretches of STRETCH readings that overlap by HALO; a source of fewer readings is one
stretch. The normal behaviour is that of the whole source at every size: where it has several stretches, their normal
equations and histograms of residuals are added up first, and all of them are tested by the one result (medians from
histograms are right to 2 %). Null and NaN readings are skipped, infinite ones are outside the limits, rows without
file, source or id belong to no source, repeated rows of one id count once. A source of fewer than MIN_READINGS is
tested for limits and runs only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint, fitting

STRETCH = 50_000
HALO = 128
MIN_READINGS = 8
SIDE = 5
#: So many times smaller must what lags leave be than what the level leaves, for lags alone to decide.
EXPLAINED = 3.0


@dataclass(frozen=True)
class Field:
    """limit: usual scatters (with by_step: usual steps) beyond which a reading is an outlier.

    floor: the least scatter; low, high: physical limits; longest: readings that an ordinary run may have.
    """

    name: str
    limit: float
    floor: float
    low: float
    high: float
    by_step: bool = False
    longest: int = 40


FIELDS = (
    Field("z", 9.0, 0.002, -500.0, 9000.0),
    Field("intensity", 10.5, 1.0, 0.0, 65535.0),
    Field("gps_time", 40.0, 1e-6, 0.0, 4e9, by_step=True),
)


def runs_of(v: np.ndarray) -> np.ndarray:
    """The length of the run of equal readings that each reading is in."""
    cut = np.flatnonzero(v[1:] != v[:-1]) + 1
    lengths = np.diff(np.r_[0, cut, len(v)])
    return np.repeat(lengths, lengths)


def _around(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Medians of the SIDE readings before and after each reading; at an end what the other side leads to."""
    n = len(v)
    windows = np.lib.stride_tricks.sliding_window_view(v, SIDE)
    med = np.partition(windows, SIDE // 2, axis=1)[:, SIDE // 2]
    left, right = np.empty(n), np.empty(n)
    left[SIDE:], right[: n - SIDE] = med[: n - SIDE], med[1:]
    for i in range(SIDE):
        left[i] = np.median(v[:i]) if i > 1 else np.nan
        right[n - 1 - i] = np.median(v[n - i :]) if i > 1 else np.nan
    near = np.diff(v[: SIDE + 3]), np.diff(v[-SIDE - 3 :])
    left[:2] = right[:2] = right[:2] - np.median(near[0]) * (SIDE + 1) / 2
    left[-2:] = right[-2:] = left[-2:] + np.median(near[1]) * (SIDE + 1) / 2
    return left, right


@dataclass
class Normal:
    """What is normal for a source: coefficients of two lags and a constant, and the usual sizes of what they leave,
    of the distance from the level on both sides, and of a step."""

    beta: np.ndarray
    scatter: float
    apart: float
    step: float


#: Bins of an octave in histograms of residuals, and the least exponent of two that they tell apart.
OCTAVE, LOWEST, BINS = 32, -40, 32 * 104


def _histogram(x: np.ndarray) -> np.ndarray:
    x = x[np.isfinite(x)]
    at = np.floor((np.log2(np.maximum(x, 2.0**LOWEST)) - LOWEST) * OCTAVE).astype(np.int64)
    return np.bincount(np.clip(at, 0, BINS - 1), minlength=BINS)


def _median(histogram: np.ndarray) -> float:
    total = histogram.sum()
    if not total:
        return 0.0
    k = int(np.searchsorted(np.cumsum(histogram), (total + 1) // 2))
    return 2.0 ** ((k + 0.5) / OCTAVE + LOWEST) if k else 0.0


def _equations(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients of two lags and a constant by Huber's weights, and the weighted normal equations they solve."""
    y = c[2:]
    x = np.empty((3, len(y)))
    x[0], x[1], x[2] = c[1:-1], c[:-2], 1.0
    w = np.ones(len(y))
    beta = np.array([1.0, 0.0, 0.0])
    a, b = np.eye(3), beta
    for _ in range(3):
        xw = x * w
        a, b = xw @ x.T, xw @ y
        beta = _solve(a, b)
        r = np.abs(y - beta @ x)
        s = 1.4826 * np.median(r)
        if s <= 0:
            break
        w = np.minimum(1.0, 1.5 * s / np.maximum(r, 1e-300))
    return beta, a, b


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    ridge = np.diag([1e-9 * (a[0, 0] + 1e-12)] * 2 + [0.0])
    try:
        return np.linalg.solve(a + ridge, b)
    except np.linalg.LinAlgError:
        return np.array([1.0, 0.0, 0.0])


def _shifts(c: np.ndarray, limit: float) -> np.ndarray:
    """The level that shifts add to each reading: a shift is where the medians of SIDE readings on either side differ
    by more than the limit, most so in their neighbourhood, and each side stays near its own."""
    n = len(c)
    level = np.zeros(n)
    if n < 2 * SIDE or not limit > 0:
        return level
    windows = np.lib.stride_tricks.sliding_window_view(c, SIDE)
    low, med, high = np.sort(windows, axis=1)[:, [0, SIDE // 2, SIDE - 1]].T
    at = np.arange(SIDE, n - SIDE + 1)
    jump = med[at] - med[at - SIDE]
    calm = np.maximum((high - low)[at], (high - low)[at - SIDE]) < np.abs(jump) / 2
    size = np.where(calm & (np.abs(jump) > limit), np.abs(jump), 0.0)
    around = np.lib.stride_tricks.sliding_window_view(np.pad(size, SIDE), 2 * SIDE + 1).max(axis=1)
    found = np.flatnonzero((size > 0) & (size == around))
    level[at[found]] = jump[found]
    return np.cumsum(level)


def _predict(c: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the two readings before and the two after predict; NaN where they are missing."""
    forth, back = np.full(len(c), np.nan), np.full(len(c), np.nan)
    forth[2:] = beta[0] * c[1:-1] + beta[1] * c[:-2] + beta[2]
    # A reversed autoregression has the same lags; its constant follows from the trend.
    drift = beta[2] if abs(1 - beta[0] - beta[1]) > 0.05 else -beta[2]
    back[:-2] = beta[0] * c[1:-1] + beta[1] * c[2:] + drift
    return forth, back


def outliers(v: np.ndarray, limit: float, floor: float, by_step: bool = False, normal: Normal | None = None, sums: list | None = None) -> np.ndarray:
    """Which readings are additive outliers, alone or in runs of up to three.

    normal: what is normal for the source that v is a stretch of; else that of v itself. sums: takes the last round's
    normal equations and histograms, for _normal_of().
    """
    n = len(v)
    flagged = np.zeros(n, bool)
    if n < MIN_READINGS:
        return flagged
    v = v - np.median(v)
    steps = np.diff(v)
    steps = steps[steps > 0] if by_step else steps[:0]
    step = normal.step if normal else np.median(steps) if len(steps) else 0.0
    left, right = _around(v)
    apart = np.where((v - left) * (v - right) > 0, np.minimum(np.abs(v - left), np.abs(v - right)), 0.0)
    middle = (left + right) / 2
    usual = 1.4826 * (normal.apart if normal else np.median(np.abs(v - middle)))
    scatter = max(usual, floor, step)
    # The first cleaned copy: whatever stands off from both sides gives way to their middle.
    c = np.where(apart > 5 * scatter, middle, v)
    shifted = np.zeros(n)
    met = set()
    while True:
        beta, a, b = _equations(c - shifted)
        if normal:
            beta = normal.beta
        forth, back = _predict(c - shifted, beta)
        e = np.abs(c - shifted - forth)
        scatter = max(1.4826 * (normal.scatter if normal else np.nanmedian(e)), floor, step)
        forth, back = forth + shifted, back + shifted
        f, r = v - forth, v - back
        # At an end only one side predicts; there the local slope has to disagree as well.
        end = np.isnan(f) | np.isnan(r)
        f, r = np.where(np.isnan(f), r, f), np.where(np.isnan(r), f, r)
        least = np.minimum(np.abs(f), np.abs(r))
        if not by_step and usual > EXPLAINED * scatter:
            # Lags explain what the level doesn't.
            wide = scatter
            stat = np.where((f * r > 0) & ~end, least, 0.0)
        else:
            both = np.where(end, f * r > 0, (f * r > 0) & ((v - left) * (v - right) > 0))
            # The scatter of what stands off from both sides by as many readings, for series that lags don't explain.
            wide = max(scatter, usual if not by_step else step)
            stat = np.where(both, np.minimum(least, np.abs(v - middle)), 0.0)
        now = stat > limit * wide
        new = np.where(now, np.where(np.isnan(forth) | np.isnan(back), middle, (forth + back) / 2), v)
        c = np.where(now, new, np.where((apart > 5 * wide) & ~now, c, v))
        same, flagged = (now == flagged).all(), now
        # Rounds that come back to an earlier cleaned copy (to a thousandth of the least scatter) go round for ever.
        state = np.round(c / floor, 3).tobytes()
        if same or state in met:
            break
        met.add(state)
        if not by_step:
            shifted = _shifts(c, limit * wide)
            if shifted.any():  # both sides of a shift at one level
                left, right = (side + shifted for side in _around(v - shifted))
                middle = (left + right) / 2
                apart = np.where((v - left) * (v - right) > 0, np.minimum(np.abs(v - left), np.abs(v - right)), 0.0)
    if sums is not None:
        sums.append(np.concatenate([a.ravel(), b, _histogram(e), _histogram(np.abs(v - middle)), _histogram(steps)]))
    lengths = runs_of(flagged)
    return flagged & (lengths <= 3)


def _normal_of(sums: np.ndarray) -> Normal:
    """The normal behaviour of a source from the sums of its stretches."""
    hist = sums[12:].reshape(3, BINS)
    return Normal(_solve(sums[:9].reshape(3, 3), sums[9:12]), *(_median(h) for h in hist))


def _normals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """source, field and the six numbers of its Normal from the sums by place."""
    for batch in batches:
        out = []
        for at, value in zip(batch.column(2), batch.column(3)):
            sums = np.zeros(12 + 3 * BINS)
            sums[at.values.to_numpy()] = value.values.to_numpy()
            n = _normal_of(sums)
            out.append([*n.beta.tolist(), n.scatter, n.apart, n.step])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float64()))], ["source", "field", "normal"])


KINDS = ("spike", "stuck", "limit")


def kinds_of(v: np.ndarray, field: Field, normal: Normal | None = None, sums: list | None = None) -> np.ndarray:
    """Which readings of a source (without nulls) are spikes (1), stuck (2) or impossible (3); 0 for ordinary ones."""
    kind = np.zeros(len(v), np.int8)
    kind[runs_of(v) > field.longest] = 2
    kind[(v < field.low) | (v > field.high)] = 3
    rest = kind == 0
    if rest.any():
        kind[np.flatnonzero(rest)[outliers(v[rest], field.limit, field.floor, field.by_step, normal, sums)]] = 1
    return kind


def implausible(v: np.ndarray, field: Field) -> np.ndarray:
    return kinds_of(v, field) > 0


def _worker(fields: tuple[Field, ...], fit: bool = False):
    """Readings by key: (point_id, field, kind) of the implausible ones, or (fit) the sums of each stretch and field."""

    def groups(part: dict[str, np.ndarray], last: bool):
        key = part["key"]
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        bounds = np.r_[0, cuts, len(key)]
        done = len(bounds) - 1 if last else len(bounds) - 2
        return [(bounds[i], bounds[i + 1]) for i in range(done)], bounds[done]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] | None = None
        for batch in _with_end(batches):
            if batch is not None:
                part = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(batch.schema.names)}
                if kept is not None:
                    part = {c: np.concatenate([kept[c], part[c]]) for c in part}
            elif kept is not None:
                part = kept
            else:
                return
            ready, rest = groups(part, batch is None)
            ids, which, kinds, sources, sums = [], [], [], [], []
            for start, stop in ready:
                own, pid = part["own"][start:stop], part["point_id"][start:stop]
                for k, field in enumerate(fields):
                    v = part[field.name][start:stop].astype("f8")
                    ok = ~np.isnan(v)
                    if not ok.any():
                        continue
                    if fit:
                        got: list = []
                        kinds_of(v[ok], field, None, got)
                        if got:
                            sources.append(part["source"][start])
                            which.append(k)
                            sums.append(got[0])
                        continue
                    packed = part[f"normal_{field.name}"][start] if f"normal_{field.name}" in part else None
                    kind = kinds_of(v[ok], field, None if packed is None else Normal(np.asarray(packed[:3], "f8"), *packed[3:]))
                    hit = np.flatnonzero(kind)
                    place = np.flatnonzero(ok)[hit]
                    mine = own[place]
                    ids.append(pid[place[mine]])
                    kinds.append(kind[hit[mine]])
                    which.append(np.full(int(mine.sum()), k, "i1"))
            kept = {c: a[rest:] for c, a in part.items()}
            if sources:
                rows = np.array(sums)
                at = [np.flatnonzero(r) for r in rows]
                flat = pa.array(np.concatenate(at).astype(np.int32))
                offsets = pa.array(np.r_[0, np.cumsum([len(a) for a in at])].astype(np.int32))
                values = pa.array(np.concatenate([r[a] for r, a in zip(rows, at)]))
                yield pa.RecordBatch.from_arrays([pa.array(sources, pa.int64()), pa.array(which, pa.int32()), pa.ListArray.from_arrays(offsets, flat), pa.ListArray.from_arrays(offsets, values)], ["source", "field", "at", "value"])
            if ids and sum(map(len, ids)):
                names = np.array([f.name for f in fields], object)[np.concatenate(which)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids), pa.int64()), pa.array(names, pa.string()), pa.array(np.array(KINDS, object)[np.concatenate(kinds) - 1], pa.string())], ["point_id", "field", "kind"])

    return work


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from (b for b in batches if b.num_rows)
    yield None


#: Long sources whose normal behaviour is sent to all tasks (each has a few numbers for a field); more are shuffled.
LONG_SOURCES = 2_000


def readings(points: DataFrame, fields: tuple[Field, ...] = FIELDS, stretch: int = STRETCH) -> DataFrame:
    """(point_id, field, kind) of all implausible readings; kind is spike, stuck or limit."""
    source = ["file_id", "point_source_id"]
    p = points.select("point_id", *source, "point_index", *[F.col(f.name).cast("double").alias(f.name) for f in fields]).dropna(subset=["point_id", *source, "point_index"])
    long = checkpoint(p.groupBy(*source).count().where(F.col("count") > stretch).select(*source))
    one = lambda rows: rows.withColumns({"stretch": F.lit(0), "own": F.lit(True)}).repartition(*source).dropDuplicates([*source, "point_id"])
    names = [f.name for f in fields]

    def worked(parted: DataFrame, fit: bool, *more: str) -> DataFrame:
        keys = [*source, "stretch"]
        rows = parted.withColumns({"key": F.xxhash64(*keys), "source": F.xxhash64(*source)}).sortWithinPartitions(*keys, "point_index", "point_id")
        kind = "source long, field int, at array<int>, value array<double>" if fit else "point_id long, field string, kind string"
        return rows.select("key", "source", "own", "point_id", *names, *more).mapInArrow(_worker(fields, fit), kind)

    if long.isEmpty():
        return worked(one(p), False)
    short = one(p.join(fitting(long, 100_000), source, "left_anti"))
    parted = _stretches(p.join(fitting(long, 100_000), source, "left_semi"), source, stretch)
    # The sums of the stretches of a source, added up: normal equations, and histograms by their bins in use.
    sums = worked(parted.where("own"), True).select("source", "field", F.explode(F.arrays_zip("at", "value")).alias("e"))
    sums = sums.groupBy("source", "field", F.col("e.at").alias("at")).agg(F.sum("e.value").alias("value"))
    listed = sums.groupBy("source", "field").agg(F.collect_list(F.struct("at", "value")).alias("s")).select("source", "field", "s.at", "s.value")  # at most some thousand bins
    normal = listed.mapInArrow(_normals, "source long, field int, normal array<double>")
    normal = checkpoint(normal.groupBy("source").agg(*[F.first(F.when(F.col("field") == k, F.col("normal")), ignorenulls=True).alias(f"normal_{n}") for k, n in enumerate(names)]))
    known = parted.withColumn("source", F.xxhash64(*source)).join(fitting(normal, LONG_SOURCES), "source", "left").drop("source")
    known = known.repartition(*source, "stretch")
    return worked(short, False).unionByName(worked(known, False, *[f"normal_{n}" for n in names]))


def found(points: DataFrame, fields: tuple[Field, ...] = FIELDS, stretch: int = STRETCH) -> DataFrame:
    """(point_id, field) of all implausible readings."""
    return readings(points, fields, stretch).select("point_id", "field")


def _stretches(p: DataFrame, source: list[str], stretch: int) -> DataFrame:
    """Rows with their stretch, those near its ends also as context (own false) of the neighbouring stretch.

    Places come from the rank within 65,536 consecutive point_index values plus the rows of earlier such blocks.
    """
    p = p.withColumn("block", F.floor(F.col("point_index") / 65536)).repartition(*source, "block").dropDuplicates([*source, "block", "point_id"])
    n = p.groupBy(*source, "block").count()
    before = n.withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy(*source).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    p = p.withColumn("rank", F.row_number().over(Window.partitionBy(*source, "block").orderBy("point_index", "point_id"))).join(before, [*source, "block"])
    place = F.col("before") + F.col("rank") - 1
    own = F.floor(place / stretch)
    copies = F.array_distinct(F.array(own, F.greatest(F.floor((place - HALO) / stretch), F.lit(0)), F.floor((place + HALO) / stretch)))
    p = p.withColumn("home", own).withColumn("stretch", F.explode(copies)).withColumn("own", F.col("stretch") == F.col("home"))
    return p.drop("block", "before", "rank", "home").repartition(*source, "stretch")
