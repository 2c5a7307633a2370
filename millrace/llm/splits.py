"""Splits that keep related records together.

Units are the connected components over shared attributes; whole units are then dealt to
the splits so that the splits' totals come as close to the targets as subset sums allow.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.components import hook_and_shortcut
from millrace.sources.scratch import write_cut

#: Node numbers of the three kinds lie apart: ids must be within +-2**60.
KIND = 1 << 61
#: Objects that the exact subset sums decide over; of larger tables the rest is dealt in proportion first.
MAX_BITS = 1 << 22
#: Units of each size that are left to the subset sums even then.
LEAST_PER_SIZE = 4
#: Units of one size are ranked in this many hash buckets per hundred thousand units.
UNITS_PER_BUCKET = 100_000


def split_label(column: str) -> Column:
    """A split's name without case and outer blanks; val is validation; null and blank are no split."""
    name = F.lower(F.trim(F.regexp_replace(F.col(column), r"^\s+|\s+$", "")))
    return F.when(name == "val", "validation").when(name != "", name)


def _objects(rows: DataFrame, object_id: str, image_id: str, scene: str, split: str | None) -> tuple[DataFrame, DataFrame]:
    """(objects with their anchor node, edges between attribute nodes)."""
    base = rows.select(
        F.col(object_id).cast("long").alias("o"),
        F.col(image_id).cast("long").alias("image"),
        F.when(F.col(scene) > 0, F.col(scene).cast("long") - F.lit(KIND)).alias("scene"),
        (split_label(split) if split else F.lit(None).cast("string")).alias("s"),
    ).filter("o IS NOT NULL")
    base = base.withColumn("node", F.coalesce("image", "scene"))
    objects = base.groupBy("o").agg(
        F.min("node").alias("low"), F.max("node").alias("high"), F.min("s").alias("s_min"), F.max("s").alias("s_max")
    )
    within = base.select(F.col("image").alias("u"), F.col("scene").alias("v")).filter("u IS NOT NULL AND v IS NOT NULL").distinct()
    several = objects.filter("low < high").select("o", "low")
    across = base.filter("node IS NOT NULL").select("o", "node").join(several, "o").filter("node <> low")
    across = across.select(F.col("low").alias("u"), F.col("node").alias("v")).distinct()
    anchored = objects.withColumn("anchor", F.coalesce("low", F.col("o") + F.lit(KIND)))
    return anchored, within.unionByName(across)


def _unit_table(anchored: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per anchor: root, objects, smallest object and the splits seen. Combined before any join."""
    anchors = anchored.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.min("o").alias("o"), F.min("s_min").alias("s_min"), F.max("s_max").alias("s_max")
    )
    roots = hook_and_shortcut(edges).withColumnRenamed("node", "anchor")
    return anchors.join(roots, "anchor", "left").withColumn("root", F.coalesce("root", "anchor"))


def units_across_splits(rows: DataFrame, object_id="object_id", image_id="image_id", scene="scene_group", split="split") -> DataFrame:
    """Units whose rows, as delivered, carry more than one split.

    Rows with a null object_id belong to no object and are left out; a null image_id and a
    null or non-positive scene link nothing; an object with neither is a unit of its own.
    Repeated rows of an object are one object and link all the images and scenes they name.
    Returns (unit_object_id): the smallest object_id of each such unit. Empty input: no rows.
    """
    anchored, edges = _objects(rows, object_id, image_id, scene, split)
    units = _unit_table(anchored, edges).groupBy("root").agg(
        F.min("o").alias("unit_object_id"), F.min("s_min").alias("a"), F.max("s_max").alias("b")
    )
    return units.filter("a < b").select("unit_object_id")


def closest_totals(sizes: dict[int, int], shares: list[float]) -> dict[int, list[int]]:
    """Deal units to splits: {size: [units for each split]}, given {size: number of units}.

    Up to MAX_BITS objects are dealt by subset sums alone. Of larger tables as many units of
    each size as these can hold (LEAST_PER_SIZE at least) are kept for them, and the others
    dealt in proportion to the shares (rounded down), less a part that leaves every split room
    for two units of the largest size; where a unit is that large, nothing is dealt this way.
    The units kept go split by split: a subset-sum bitset over the sizes' multiplicities (in
    powers of two) holds every total that can be reached, and the one closest to the split's
    target is taken (the smaller of two equally close). The last split gets what is left.
    Shares are scaled to sum 1.
    """
    weights = [Fraction(s).limit_denominator(10**9) for s in shares]
    weights = [w / sum(weights) for w in weights]
    total = sum(s * m for s, m in sizes.items())
    kept = dict(sizes)
    if total > MAX_BITS:
        per = LEAST_PER_SIZE
        while sum(s * min(m, 2 * per) for s, m in sizes.items()) <= MAX_BITS:
            per *= 2
        kept = {s: min(m, per) for s, m in sizes.items()}
    ahead = max(Fraction(0), 1 - Fraction(2 * max(sizes, default=0)) / (min(weights) * total)) if total else Fraction(0)
    dealt = {s: [int(ahead * (m - kept[s]) * w) for w in weights] for s, m in sizes.items()}
    rest = {s: m - sum(dealt[s]) for s, m in sizes.items()}
    order = sorted(range(len(weights)), key=lambda i: (weights[i], -i))
    for i in order[:-1]:
        want = weights[i] * total - sum(s * d[i] for s, d in dealt.items())
        for s, k in _subset(rest, want).items():
            dealt[s][i] += k
            rest[s] -= k
    for s, k in rest.items():
        dealt[s][order[-1]] += k
    return dealt


def _subset(rest: dict[int, int], want: Fraction) -> dict[int, int]:
    """Units of each size whose total is closest to want.

    Where want has more than MAX_BITS objects, a first pass in a larger grain stays below it
    by at most what its rounding can amount to, and the units it leaves fill the gap exactly.
    """
    if want <= 0 or not any(rest.values()):
        return {}
    taken: dict[int, int] = {}
    while want > MAX_BITS:
        grain = -(-int(want) // MAX_BITS) * 4
        got = _reach({s: m for s, m in rest.items() if s >= grain}, want, grain)
        part = sum(s * k for s, k in got.items())
        if not part or part > want:
            break
        taken = {s: taken.get(s, 0) + got.get(s, 0) for s in taken | got}
        rest = {s: m - got.get(s, 0) for s, m in rest.items()}
        want -= part
    if want > MAX_BITS:  # small units without number: all but the last MAX_BITS objects are taken largest first
        for s in sorted(rest, reverse=True):
            k = min(rest[s], max(0, int((want - MAX_BITS // 2) // s)))
            taken[s], rest, want = taken.get(s, 0) + k, rest | {s: rest[s] - k}, want - s * k
    for s, k in _reach(rest, want, 1).items():
        taken[s] = taken.get(s, 0) + k
    return {s: k for s, k in taken.items() if k}


def _reach(rest: dict[int, int], want: Fraction, grain: int) -> dict[int, int]:
    """Units whose total, with sizes rounded up to whole grains, is closest to want (for a grain above 1, closest from below)."""
    # a unit above twice the target is worse than none
    rest = {s: m for s, m in rest.items() if s <= 2 * want}
    top = int(want / grain) + max((-(-s // grain) for s, m in rest.items() if m), default=0) + 1
    items: list[tuple[int, int, int]] = []  # (size, count, grains)
    for s in sorted(rest, reverse=True):
        each = -(-s // grain)
        left, k = min(rest[s], top // each), 1
        while left > 0:
            k = min(k, left)
            items.append((s, k, each * k))
            left, k = left - k, k * 2
    top = min(top, sum(g for _, _, g in items))
    bits, mask = 1, (1 << (top + 1)) - 1
    first = np.full(top + 1, -1, np.int32)
    for n, (_, _, g) in enumerate(items):
        new = (bits << g) & mask & ~bits
        raw = np.frombuffer(new.to_bytes(top // 8 + 1, "little"), np.uint8)
        spots = np.flatnonzero(raw)
        for some in np.array_split(spots, len(spots) // 100_000 + 1):
            found = np.unpackbits(raw[some, None], axis=1, bitorder="little").astype(bool)
            first[(some[:, None] * 8 + np.arange(8))[found]] = n
        bits |= new
    aim = want / grain
    at = low = min(int(aim), top)
    while low and first[low] < 0:
        low -= 1
    high = at + 1
    while high <= top and first[high] < 0:
        high += 1
    sum_ = high if grain == 1 and high <= top and high - aim < aim - low else low
    taken: dict[int, int] = {}
    while sum_:
        s, k, g = items[first[sum_]]
        taken[s] = taken.get(s, 0) + k
        sum_ -= g
    return taken


def assign_splits(
    rows: DataFrame, targets: DataFrame, object_id="object_id", image_id="image_id", scene="scene_group"
) -> DataFrame:
    """A split for every object, whole units only, with totals close to the targets.

    targets: (split_name, share); rows with a null name or a share that is not positive get
    nothing; at least one row must remain. Only the table of unit sizes and their counts
    reaches the driver: at most about sqrt(2 x objects) rows. Units of one size are ranked
    within hash buckets and the buckets' counts are summed up, so no size, however common,
    is ranked in one task. Equal units are ordered by their hash: the same rows give the
    same splits. Nulls as in units_across_splits. Empty rows: no rows.
    Returns (object_id, unit_object_id, split_name).
    """
    spark = rows.sparkSession
    wanted = [(r[0], float(r[1])) for r in targets.select("split_name", "share").filter("split_name IS NOT NULL AND share > 0").orderBy("split_name").collect()]
    if not wanted:
        raise ValueError("targets has no split with a positive share")
    anchored, edges = _objects(rows, object_id, image_id, scene, None)
    # written once: read by the histogram, the ranks and the result
    anchors = write_cut(_unit_table(anchored, edges).select("anchor", "root", "n", "o"), "anchors").df
    units = write_cut(anchors.groupBy("root").agg(F.min("o").alias("unit_object_id"), F.sum("n").alias("size")), "units").df
    hist = {r["size"]: r["count"] for r in units.groupBy("size").count().collect()}
    dealt = closest_totals(hist, [w for _, w in wanted])
    marks = [
        (int(s), int(sum(d[:i])), int(sum(d[: i + 1])), wanted[i][0]) for s, d in dealt.items() for i in range(len(wanted)) if d[i]
    ]
    plan = spark.createDataFrame(marks, "size long, lo long, hi long, split_name string")
    buckets = max(1, -(-sum(hist.values()) // UNITS_PER_BUCKET))
    ranked = units.withColumn("h", F.xxhash64("unit_object_id")).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = ranked.groupBy("size", "bucket").count().withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0)))
    within = Window.partitionBy("size", "bucket").orderBy("h", "unit_object_id")
    ranked = ranked.withColumn("r", F.row_number().over(within) - 1).join(offset.drop("count"), ["size", "bucket"])
    ranked = ranked.withColumn("r", F.col("r") + F.col("offset")).select("root", "unit_object_id", "size", "r")
    chosen = ranked.join(plan, "size").filter("r >= lo AND r < hi").select("root", "unit_object_id", "split_name")
    by_anchor = anchors.select("anchor", "root").join(chosen, "root").drop("root")
    out = anchored.select(F.col("o").alias("object_id"), "anchor").join(by_anchor, "anchor")
    return out.select("object_id", "unit_object_id", "split_name")


