"""Rank correlation and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ranks import Ranges, average_rank, value_ranks

#: A 31-bit linear congruential generator, which SQL can repeat exactly.
LCG_A, LCG_C, LCG_M = 1_103_515_245, 12_345, 1 << 31


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """Spearman correlation of every pair of columns (a <= b), each over the rows that have both values.

    A column without nulls has the same ranks beside any other such column: it is ranked once
    and the ranks are joined to the rows. Pairs with nulls are ranked over the rows they
    leave. A column beside itself needs no ranks. Null where a column does not vary.
    """
    ranges = Ranges(df, columns)
    wide = df.select(*[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    n_pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    same = [i for i, j in n_pairs if i == j]
    full = [i for i, c in enumerate(columns) if ranges.complete[c]]
    sums = []
    alone = [F.struct(F.lit(i).alias("i"), F.lit(i).alias("j"), F.col(f"v{i}").alias("v")) for i in same]
    alone = wide.select(F.inline(F.array(*alone))).filter("v IS NOT NULL").groupBy("i", "j").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    sums.append(alone.select("i", "j", "n", F.when(F.col("lo") < F.col("hi"), 1.0).alias("rho")))
    pairs = [(i, j) for i, j in n_pairs if i < j and i in full and j in full]
    if pairs:
        ranked = wide
        for i in {k for p in pairs for k in p}:
            ranked = ranked.join(average_rank(wide, [], f"v{i}", f"r{i}", ranges.of(columns[i])), f"v{i}")
        terms = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), *[F.sum(t).alias(n) for n, t in _terms(F.lit(1.0), F.col(f"r{i}"), F.col(f"r{j}"))]) for i, j in pairs]
        sums.append(_rho(ranked.agg(F.array(*terms).alias("t")).select(F.inline("t"))))
    pairs = [(i, j) for i, j in n_pairs if i < j and not (i in full and j in full)]
    if pairs:
        cells = [
            F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"v{i}").alias("x"), F.col(f"v{j}").alias("y"))
            for i, j in pairs
        ]
        long = wide.select(F.inline(F.array(*cells))).filter("x IS NOT NULL AND y IS NOT NULL")
        # pairs of equal values are one row with a weight: ties, however many, cost nothing
        pooled = long.groupBy("i", "j", "x", "y").agg(F.count(F.lit(1)).alias("w"))
        both = pooled
        for v, r, k in (("x", "rx", "i"), ("y", "ry", "j")):
            both = both.join(average_rank(pooled, ["i", "j"], v, r, ranges.of_any(k, columns), "w"), ["i", "j", v])
        terms = [F.sum(t).alias(n) for n, t in _terms(F.col("w"), F.col("rx"), F.col("ry"))]
        sums.append(_rho(both.groupBy("i", "j").agg(*terms)))
    out = sums[0]
    for more in sums[1:]:
        out = out.unionByName(more)
    name = F.array(*[F.lit(c) for c in columns])
    return out.select(F.get(name, F.col("i")).alias("a"), F.get(name, F.col("j")).alias("b"), "n", "rho")


def _terms(w: Column, x: Column, y: Column) -> list[tuple[str, Column]]:
    return [("n", w), ("sx", w * x), ("sy", w * y), ("sxx", w * x * x), ("syy", w * y * y), ("sxy", w * x * y)]


def _rho(sums: DataFrame) -> DataFrame:
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    below = (n * F.col("sxx") - sx * sx) * (n * F.col("syy") - sy * sy)
    return sums.select("i", "j", n.cast("long").alias("n"), F.when(below > 0, (n * F.col("sxy") - sx * sy) / F.sqrt(below)).alias("rho"))


def block_bootstrap(daily: DataFrame, draws: DataFrame, block: int, days: int, day: str, value: str) -> DataFrame:
    """Moving-block bootstrap: the mean of each repeat, days without a value kept as gaps.

    daily: one row per day number 0..days-1; draws: (rep, blk, start). Blocks are laid end to
    end and cut at days; only draws and the days it names are joined.
    """
    offsets = F.explode(F.sequence(F.lit(0), F.lit(block - 1)))
    spread = draws.withColumn("k", offsets).select("rep", (F.col("blk") * block + F.col("k")).alias("pos"), (F.col("start") + F.col("k")).alias(day))
    picked = spread.filter(F.col("pos") < days).join(daily.select(day, value), day)
    return picked.groupBy("rep").agg(F.avg(value).alias("mean_value"))


def interval(repeats: DataFrame, value: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    return repeats.agg(F.count(value).alias("repeats"), F.percentile(value, F.lit(low)).alias("lower"), F.percentile(value, F.lit(high)).alias("upper"))


def lcg_draws(spark, repeats: int, per_repeat: int, choices: int, name: str = "start") -> DataFrame:
    """(rep, blk, name): pseudo-random choices 0..choices-1, the same in Spark and in SQL."""
    ids = spark.range(repeats * per_repeat)
    mix = F.expr(f"(id * 2654435761 + 12345) % {LCG_M}")
    mix = (mix * LCG_A + LCG_C) % LCG_M
    mix = (F.floor(mix / 7) * LCG_A + LCG_C) % LCG_M
    return ids.select(
        F.floor(F.col("id") / per_repeat).cast("int").alias("rep"),
        (F.col("id") % per_repeat).cast("int").alias("blk"),
        (F.floor(mix / 13) % choices).cast("int").alias(name),
    )


def numpy_block_draws(spark, repeats: int, days: int, block: int, seed: int = 42) -> DataFrame:
    """(rep, blk, start) drawn with numpy's default generator: repeats x blocks numbers, built on the driver."""
    import numpy as np
    import pandas as pd

    starts = np.random.default_rng(seed).integers(0, days - block + 1, size=(repeats, -(-days // block)))
    rep, blk = np.indices(starts.shape)
    return spark.createDataFrame(pd.DataFrame({"rep": rep.ravel(), "blk": blk.ravel(), "start": starts.ravel()}).astype("int32"))


def group_bootstrap(long: DataFrame, group: str, draws: DataFrame) -> DataFrame:
    """Counts of (rep, actual, predicted) after resampling whole groups: draws has (rep, group)."""
    weights = draws.groupBy("rep", group).agg(F.count(F.lit(1)).alias("times"))
    counts = long.groupBy(group, "actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    return weights.join(counts, group).groupBy("rep", "actual", "predicted").agg(F.sum(F.col("n") * F.col("times")).alias("n"))


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """Consecutive numbers from 0 in the order of a unique number column, in ranges instead of one task."""
    ranks = value_ranks(df.select(order), [], order, Ranges(df, [order]).of(order))
    return df.join(ranks.select(order, F.col("_before").cast("long").alias(name)), order)
