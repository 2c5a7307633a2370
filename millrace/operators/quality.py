"""Expectations with three states, and their roll-up.

Every expectation is one row (name, status, detail): PASS, FAIL, or NOT_VERIFIABLE where
nothing could be checked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.numbers import is_close


def _row(df: DataFrame, name: str, bad: Column, checked: Column) -> DataFrame:
    """One row from aggregates: bad rows out of checked ones."""
    one = df.agg(bad.cast("long").alias("_bad"), checked.cast("long").alias("_all"))
    status = F.when(F.coalesce("_all", F.lit(0)) == 0, "NOT_VERIFIABLE").when(F.col("_bad") == 0, "PASS").otherwise("FAIL")
    return one.select(F.lit(name).alias("name"), status.alias("status"), F.coalesce("_bad", F.lit(0).cast("long")).alias("failures"))


def unique_key(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return _row(sizes, name, F.count_if(F.col("n") > 1), F.count(F.lit(1)))


def holds(df: DataFrame, condition: Column, name: str) -> DataFrame:
    """The condition on every row; a null condition fails."""
    return _row(df, name, F.count_if(~F.coalesce(condition, F.lit(False))), F.count(F.lit(1)))


def no_nulls(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    return holds(df, reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]), name)


def group_in_one_split(df: DataFrame, group: str, split: str, name: str) -> DataFrame:
    """No group with two splits; rows without a group are not checked."""
    groups = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.min(split).alias("a"), F.max(split).alias("b"))
    return _row(groups, name, F.count_if(F.col("a") < F.col("b")), F.count(F.lit(1)))


def splits_in_order(df: DataFrame, date: str, split: str, order: list[str], least: int, name: str) -> DataFrame:
    """Every split has at least least rows and ends before the next begins."""
    ends = df.groupBy().agg(
        *[F.max(F.when(F.col(split) == s, F.col(date))).alias(f"max_{i}") for i, s in enumerate(order)],
        *[F.min(F.when(F.col(split) == s, F.col(date))).alias(f"min_{i}") for i, s in enumerate(order)],
        *[F.count_if(F.col(split) == s).alias(f"n_{i}") for i, s in enumerate(order)],
    )
    fine = [F.col(f"max_{i}") < F.col(f"min_{i + 1}") for i in range(len(order) - 1)] + [F.col(f"n_{i}") >= least for i in range(len(order))]
    return holds(ends, reduce(lambda a, b: a & b, fine), name)


def before_target(df: DataFrame, feature_date: str, target_date: str, name: str) -> DataFrame:
    """Every feature is older than its target."""
    return holds(df, F.col(feature_date) < F.col(target_date), name)


def row_count(df: DataFrame, expected: int, name: str) -> DataFrame:
    return holds(df.agg(F.count(F.lit(1)).alias("n")), F.col("n") == expected, name)


def frames_agree(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tolerance: float, name: str) -> DataFrame:
    """The same keys on both sides and values within the tolerance; nulls agree with nulls."""
    left = a.select(*keys, *[F.col(v).alias(f"a_{v}") for v in values], F.lit(True).alias("_a"))
    right = b.select(*keys, *[F.col(v).alias(f"b_{v}") for v in values], F.lit(True).alias("_b"))
    both = left.join(right, keys, "full")
    same = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    for v in values:
        x, y = F.col(f"a_{v}"), F.col(f"b_{v}")
        same = same & ((x.isNull() & y.isNull()) | F.coalesce(is_close(x, y, tolerance, tolerance), F.lit(False)))
    return holds(both, same, name)


def together(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def roll_up(checks: DataFrame) -> DataFrame:
    return checks.groupBy("status").agg(F.count(F.lit(1)).alias("checks"), F.sum("failures").alias("failures"))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Order-free hash of a table: rows, and xor and sum of row hashes; equal tables agree."""
    h = F.xxhash64(*columns)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(h).alias("xor_hash"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("sum_hash"))
