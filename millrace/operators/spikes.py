"""Implausible readings: spikes, stuck values, impossible values.

Spikes come from phase-space thresholding: readings whose value, first and second difference
lie outside a robust ellipsoid are replaced by the level around them and the ellipsoid is fitted
again, until nothing new lies outside. Of the readings so found, the bound of the task keeps those
that stand off their neighbours by a factor. Stuck values are runs of zero difference that are
improbable in their series, and bounds catch the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.times import finite, readable_time
from millrace.sources.scratch import write_cut

#: Readings of one series that are judged together, and readings shown on either side of them.
CHUNK, HALO = 16_384, 1_024
#: Longest spike in readings; least log ratio to both neighbours ("about four", less noise).
SPIKE_READINGS, SPIKE_LOG_RATIO = 3, 1.1
#: The level around a reading is the median of so many readings on either side: more than a spike can outweigh.
AROUND = 4
#: Quantiles of absolute deviations, with those of the normal distribution, whose larger ratio is the robust spread: the
#: median alone is 0 where values repeat.
SPREADS = ((0.5, 0.6745), (0.9, 1.6449))
#: Least spread of logs.
LEAST_SPREAD = 1e-3
#: Shortest stuck run; a run is stuck if chance would give fewer such runs in the series than this.
STUCK_READINGS, STUCK_CHANCE = 8, 1e-5

#: Spread of value, first and second difference, correlation of value and second difference, readings.
Ellipsoid = tuple[float, float, float, float, int]


def _spread(z: np.ndarray) -> float:
    z = np.abs(z)
    return max(LEAST_SPREAD, *(float(np.quantile(z, q)) / normal for q, normal in SPREADS))


def _phase_space(x: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The level around each reading, and the reading's (value off the level, first difference, second difference)."""
    padded = np.pad(x, AROUND, mode="reflect")
    level = np.median(np.lib.stride_tricks.sliding_window_view(padded, 2 * AROUND + 1), axis=1)
    left, right = np.r_[x[1], x[:-1]], np.r_[x[1:], x[-2]]
    return level, (x - level, (right - left) / 2, left - 2 * x + right)


def _ellipsoid(u: np.ndarray, d1: np.ndarray, d2: np.ndarray, readings: int) -> Ellipsoid:
    su, s1, s2 = _spread(u), _spread(d1), _spread(d2)
    a, b = np.clip(u / su, -3, 3), np.clip(d2 / s2, -3, 3)
    tilt = float((a @ b) / np.sqrt((a @ a) * (b @ b) + 1e-12))
    return su, s1, s2, min(max(tilt, -0.95), 0.95), readings


def phase_space_outliers(x: np.ndarray, usual: Ellipsoid | None = None) -> tuple[np.ndarray, Ellipsoid]:
    """Mask of the readings outside the robust ellipsoid of value, first and second difference, and the last ellipsoid.

    Each round the farthest of neighbouring readings outside are replaced by the level around
    them, so that a reading beside a spike is judged without it. The ellipsoid's radius is the
    universal threshold, sqrt(2 ln n). It is fitted anew each round, unless that of the whole series (usual) is given.
    Rounds go on until nothing new lies outside; every round but the last finds a reading.
    """
    n = len(x)
    found, clean = np.zeros(n, bool), x
    while True:
        level, (u, d1, d2) = _phase_space(clean)
        shape = usual or _ellipsoid(u, d1, d2, n)
        su, s1, s2, tilt, readings = shape
        a, b = u / su, d2 / s2
        far = (a * a - 2 * tilt * a * b + b * b) / (1 - tilt * tilt) + (d1 / s1) ** 2
        far[found] = 0
        beside = np.pad(far, 1)
        new = (far > 2 * np.log(readings)) & (far >= beside[:-2]) & (far >= beside[2:])
        if not new.any():
            return found, shape
        found |= new
        clean = np.where(found, level, x)


def _logs(values: np.ndarray) -> np.ndarray | None:
    """Logs of non-negative values, zeros as a thousandth of the median; None where nothing is positive."""
    positive = values[values > 0]
    return np.log(np.maximum(values, 1e-3 * float(np.median(positive)))) if len(positive) else None


def spike_mask(values: np.ndarray, usual: Ellipsoid | None = None) -> np.ndarray:
    """Readings of a time-ordered series of non-negative values that belong to a spike.

    All readings of a spike lie outside the ellipsoid: that is what "far more than the usual
    step" means. A series of fewer readings than a level needs (2 * AROUND + 1) has no usual
    step, and the bound alone decides.
    """
    n = len(values)
    out = np.zeros(n, bool)
    x = _logs(values) if n >= 3 else None
    if x is None:
        return out
    outside = phase_space_outliers(x, usual)[0] if n > 2 * AROUND else np.ones(n, bool)
    wide = np.pad(x, 1, constant_values=np.nan)
    for length in range(1, SPIKE_READINGS + 1):
        starts = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(outside, length).all(1))
        inside = np.lib.stride_tricks.sliding_window_view(x, length)[starts]
        left, right = wide[starts], wide[starts + length + 1]
        # at the ends of a series a spike has one neighbour, which must be most of what is there
        enough = ~(np.isnan(left) | np.isnan(right)) | (n >= 4 * length)
        above = inside.min(1) - np.fmax(left, right) >= SPIKE_LOG_RATIO
        below = np.fmin(left, right) - inside.max(1) >= SPIKE_LOG_RATIO
        for i in starts[(above | below) & enough]:
            out[i : i + length] = True
    return out


def _quantile(length: np.ndarray, runs: np.ndarray, share: float) -> float:
    """Quantile of run lengths in rising order that occur so many times each."""
    upto = np.cumsum(runs)
    at = share * (upto[-1] - 1)
    low, high = (float(length[np.searchsorted(upto, k, side="right")]) for k in (np.floor(at), np.ceil(at)))
    return low + (high - low) * (at - np.floor(at))


def stuck_lengths(length: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Which run lengths (in rising order, with the number of such runs in the series) the other runs do not explain."""
    n, total = int((length * runs).sum()), int(runs.sum())
    short = length < STUCK_READINGS
    usual, readings = int(runs[short].sum()), int((length * runs)[short].sum())
    ordinary = 1 - (usual + 1) / (readings + 2) if usual else 0.0
    out = np.zeros(len(length), bool)
    for k in np.flatnonzero(~short):
        others, repeat = runs - (np.arange(len(runs)) == k), ordinary
        # where long runs are ordinary (coarse values that change slowly) the common ones tell
        for share in (0.75, 0.9) if total > 1 else ():
            common = _quantile(length, others, share)
            if common >= STUCK_READINGS:
                repeat = max(repeat, (1 - share) ** (1 / (common - 1)))
        out[k] = total * max(repeat, 1 / (n + 1)) ** (float(length[k]) - 1) <= STUCK_CHANCE
    return out


def stuck_mask(values: np.ndarray) -> np.ndarray:
    """Readings in runs of equal values that the series' ordinary repeats do not explain."""
    n = len(values)
    if n < STUCK_READINGS:
        return np.zeros(n, bool)
    start = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    length = np.diff(np.r_[start, n])
    kinds, of, runs = np.unique(length, return_inverse=True, return_counts=True)
    return np.repeat(stuck_lengths(kinds, runs)[of], length)


#: What a chunk tells: ids of spikes (edge -1); its runs by length (edge 0), with the ids of long ones; and the runs at its
#: first (edge 1) and last (edge 2) reading, which may go on in other chunks. joined: the run goes on from the chunk before.
_TOLD = "station_id string, parameter string, chunk long, edge int, joined boolean, length long, runs long, ids array<long>"


def _in_order(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(reading_id, value, own) of a chunk by rank, a reading that is there again left out."""
    r, ids = table["r"].to_numpy(), table["reading_id"].to_numpy()
    value, own = table["v"].to_numpy(), table["own"].to_numpy(zero_copy_only=False)
    order = np.argsort(r)
    ids, value, own = ids[order], value[order], own[order]
    again = np.r_[False, ids[1:] == ids[:-1]]
    return ids[~again], value[~again], own[~again]


def _shape(table: pa.Table) -> pa.Table:
    """The ellipsoid of one chunk, if it has the readings for one."""
    _, value, own = _in_order(table)
    x = _logs(value) if len(value) > 2 * AROUND else None
    shapes = [] if x is None else [(*phase_space_outliers(x)[1][:4], int(own.sum()))]
    same = {c: pa.array([table[c][0].as_py()] * len(shapes), table.schema.field(c).type) for c in ("station_id", "parameter")}
    parts = zip(*shapes, strict=True) if shapes else [[]] * 5
    return pa.table(same | dict(zip(("su", "s1", "s2", "tilt", "n"), map(pa.array, parts, [pa.float64()] * 4 + [pa.int64()]), strict=True)))


def _judge(table: pa.Table, usual: pa.Table) -> pa.Table:
    """Spikes and runs of one chunk, of its own readings; the halo is context. usual: the ellipsoid of a series of several chunks."""
    ids, value, own = _in_order(table)
    shape = tuple(usual[c][0].as_py() for c in ("su", "s1", "s2", "tilt", "n")) if len(usual) else None
    rows = [(-1, False, 0, 0, ids[own & spike_mask(value, shape)])]
    at = np.flatnonzero(own)
    if len(at):
        new = np.r_[True, value[1:] != value[:-1]][at]
        joined = not new[0]
        new[0] = True
        start = np.flatnonzero(new)
        length = np.diff(np.r_[start, len(at)])
        mine = ids[at]
        rows.append((1, joined, length[0], 1, mine[: length[0]]))
        if len(start) > 1:
            rows.append((2, False, length[-1], 1, mine[start[-1] :]))
        run = np.repeat(np.arange(len(start)), length)
        for size, count in zip(*np.unique(length[1:-1], return_counts=True), strict=True):
            inner = np.r_[False, length[1:-1] == size, False] if size >= STUCK_READINGS else np.zeros(len(start), bool)
            rows.append((0, False, size, count, mine[inner[run]]))
    edge, joined, length, runs, found = zip(*rows, strict=True)
    same = {c: pa.array([table[c][0].as_py()] * len(rows), t) for c, t in (("station_id", pa.string()), ("parameter", pa.string()), ("chunk", pa.int64()))}
    told = {"edge": pa.array(edge, pa.int32()), "joined": pa.array(joined, pa.bool_()), "length": pa.array([int(x) for x in length], pa.int64())}
    return pa.table(same | told | {"runs": pa.array([int(x) for x in runs], pa.int64()), "ids": pa.array([x.tolist() for x in found], pa.list_(pa.int64()))})


def _stuck_series(table: pa.Table) -> pa.Table:
    """Stuck run lengths of one series."""
    table = table.sort_by("length")
    stuck = stuck_lengths(table["length"].to_numpy(), table["n"].to_numpy())
    return table.select(["station_id", "parameter", "length"]).filter(pa.array(stuck))


def _stuck_readings(told: DataFrame) -> DataFrame:
    """(reading_id) of stuck runs: runs are put together over chunk borders and judged by all other runs of the series."""
    series = ["station_id", "parameter"]
    upto = Window.partitionBy(*series).orderBy("chunk", "edge").rowsBetween(Window.unboundedPreceding, 0)
    border = told.filter("edge > 0").withColumn("runs", F.when(F.col("joined"), 0).otherwise(1).cast("long"))
    border = border.withColumn("run", F.sum("runs").over(upto)).withColumn("length", F.sum("length").over(Window.partitionBy(*series, "run")))
    runs = told.filter("edge = 0").select(*series, "length", "runs", "ids").unionByName(border.select(*series, "length", "runs", "ids"))
    lengths = runs.groupBy(*series, "length").agg(F.sum("runs").alias("n"))
    stuck = lengths.groupBy(*series).applyInArrow(_stuck_series, "station_id string, parameter string, length long")
    return runs.join(stuck, [*series, "length"]).select(F.explode("ids").alias("reading_id"))


def implausible_readings(readings: DataFrame, value: str = "value_ugm3") -> DataFrame:
    """Readings that are negative, spikes or stuck: (reading_id, kind), one row per reading.

    A series is one station_id and parameter in order of time, then reading_id. Every series
    is ranked by day (counts of earlier days plus the rank within the day) and cut into
    chunks of CHUNK ranks that also show HALO readings of both neighbours, so a series with a
    third of all rows is many small groups. The ellipsoid of a series of several chunks has the
    medians of the spreads that its chunks settle on, so all of a series is judged alike; a
    stuck run is as long as it is in the series and is judged by all other runs of the series.

    Null and NaN values, infinities, unreadable times and null stations or parameters are no
    part of a series (a negative value is a case even without a readable time). Negative
    values are no neighbours. A reading delivered again counts once. Empty input: no rows.
    """
    base = readings.select("reading_id", "station_id", "parameter", readable_time("datetime_utc").alias("t"), finite(value).alias("v"))
    base = base.filter("reading_id IS NOT NULL AND v IS NOT NULL")
    below = base.filter("v < 0").select("reading_id", F.lit("negative").alias("kind"))
    series = base.filter("v >= 0 AND t IS NOT NULL AND station_id IS NOT NULL AND parameter IS NOT NULL")
    series = series.withColumn("day", F.floor(F.unix_micros("t") / 86_400_000_000))
    keys = ["station_id", "parameter", "day"]
    within = Window.partitionBy(*keys).orderBy("t", "reading_id")
    # times are read once; what follows scans this table
    ranked = write_cut(series.select(*keys, "reading_id", "v", F.row_number().over(within).alias("rn")), "readings").df
    each = Window.partitionBy("station_id", "parameter")
    earlier = each.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = ranked.groupBy(*keys).count().withColumn("offset", F.coalesce(F.sum("count").over(earlier), F.lit(0)))
    days = days.withColumn("several", F.sum("count").over(each) > CHUNK).drop("count")
    ranked = ranked.join(days, keys).withColumn("r", F.col("offset") + F.col("rn") - 1)
    lo, hi = F.floor((F.col("r") - HALO) / CHUNK), F.floor((F.col("r") + HALO) / CHUNK)
    chunk = ["station_id", "parameter", "chunk"]
    shown = ranked.select(
        "station_id", "parameter", "several", "r", "reading_id", "v", F.explode(F.sequence(F.greatest(lo, F.lit(0)), hi)).alias("chunk")
    ).withColumn("own", F.col("chunk") == F.floor(F.col("r") / CHUNK))
    large = shown.filter("several").drop("several")
    shapes = large.groupBy(*chunk).applyInArrow(_shape, "station_id string, parameter string, su double, s1 double, s2 double, tilt double, n long")
    middle = [F.percentile_approx(c, 0.5).alias(c) for c in ("su", "s1", "s2", "tilt")]
    usual = shapes.groupBy("station_id", "parameter").agg(*middle, F.sum("n").alias("n"))
    usual = large.select(*chunk).distinct().join(usual, ["station_id", "parameter"]).withColumnsRenamed({c: f"of_{c}" for c in chunk})
    # few rows, read several times
    judged = shown.drop("several").groupBy(*chunk).cogroup(usual.groupBy(*[f"of_{c}" for c in chunk])).applyInArrow(_judge, _TOLD)
    told = write_cut(judged, "spikes").df
    jumps = told.filter("edge = -1").select(F.explode("ids").alias("reading_id"), F.lit("spike").alias("kind"))
    stuck = _stuck_readings(told).withColumn("kind", F.lit("stuck"))
    return below.unionByName(jumps).unionByName(stuck).groupBy("reading_id").agg(F.min("kind").alias("kind"))


def implausible_pairs(pairs: DataFrame, ratio: float = 1.2) -> DataFrame:
    """Post-days whose finer fraction exceeds the coarser by more than ratio: (pair_id), once each.

    The two values decide, not the delivered flag; null and NaN values are no case.
    """
    x = pairs.select("pair_id", finite("pm2_5").alias("fine"), finite("pm10").alias("coarse"))
    return x.filter(F.col("pair_id").isNotNull() & (F.col("fine") > ratio * F.col("coarse"))).select("pair_id").distinct()


def found_rows(readings: DataFrame, pairs: DataFrame) -> DataFrame:
    """All cases in one table (source_table, row_id)."""
    a = implausible_readings(readings).select(F.lit("air_hourly").alias("source_table"), F.col("reading_id").alias("row_id"))
    b = implausible_pairs(pairs).select(F.lit("air_pairs").alias("source_table"), F.col("pair_id").alias("row_id"))
    return a.unionByName(b)
