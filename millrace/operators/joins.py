"""Joins with stated guarantees, near matches of hashes, and groups of matches."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.numbers import hamming
from millrace.sources.scratch import write_cut

def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that fails if a key repeats on either side.

    Each side is reduced to one row per key with its count in the same shuffle that the join
    needs; a count above 1 raises where the row is read.
    """

    def once(df: DataFrame, name: str) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name), F.any_value(F.struct(*rest)).alias(f"{name}_row"))
        check = F.when(F.col(name) > 1, F.raise_error(F.concat(F.lit(f"{name}: key repeats: "), F.to_json(F.struct(*keys)))).cast("boolean"))
        return rows.filter(F.coalesce(check, F.lit(True))).select(*keys, f"{name}_row.*")

    return once(left, "left_side").join(once(right, "right_side"), keys)


def exact_offset(df: DataFrame, keys: list[str], date: str, value: str, days: list[int]) -> DataFrame:
    """offsetK: the value exactly k days earlier, or null; no nearest match. Dates must be unique by keys."""
    out = df
    for k in days:
        past = df.select(*keys, F.date_add(date, k).alias(date), F.col(value).alias(f"offset{k}"))
        out = out.join(past, [*keys, date], "left")
    return out


def range_lookup(df: DataFrame, keys: list[str], date: str, value: str, days: int) -> DataFrame:
    """Mean and count of the values in [date - days, date - 1], by an equi-join.

    Each row is sent to the days it counts for, so the range join is a grouping by key and
    date that combines early; it verifies the window functions independently.
    """
    past = df.filter(F.col(value).isNotNull()).select(
        *keys, F.explode(F.sequence(F.date_add(date, 1), F.date_add(date, days))).alias(date), F.col(value).alias("_v")
    )
    stats = past.groupBy(*keys, date).agg(F.avg("_v").alias("range_mean"), F.count("_v").alias("range_n"))
    out = df.join(stats, [*keys, date], "left")
    return out.withColumn("range_n", F.coalesce("range_n", F.lit(0).cast("long")))


def near_hashes(df: DataFrame, key: str, bits: str, distance: int = 6, width: int = 64, shared: int | None = None) -> DataFrame:
    """Pairs of records whose hashes of width bits differ in at most distance bits: (a, b, distance), a < b.

    Records are first reduced to distinct hashes, which are cut into distance + shared bands:
    a close pair agrees in at least shared bands, so an equi-join on every choice of that many
    bands finds it, on keys of about width * shared / (distance + shared) bits. More shared
    bands mean more keys but far fewer candidates; by default there are as many as make the
    keys as long as the count of distinct hashes asks for (2 to 5). Band values that many
    hashes have in common are split by adaptive skew handling. Equal hashes are linked
    to the smallest key of their hash instead of to each other, and close hashes through
    these representatives, so copies never become all pairs. Null keys and hashes match nothing.
    """
    rows = df.select(F.col(key).alias("k"), F.col(bits).alias("h")).filter("k IS NOT NULL AND h IS NOT NULL").distinct()
    heads = rows.groupBy("h").agg(F.min("k").alias("head"))
    copies = rows.join(heads, "h").filter("k <> head").select(F.col("head").alias("a"), F.col("k").alias("b"), F.lit(0).alias("distance"))
    if shared is None:
        asked = math.log2(max(heads.count(), 2)) - 4
        shared = next((s for s in range(2, 5) if width * s / (distance + s) >= asked), 5)
    n = distance + shared
    edges = [width * i // n for i in range(n + 1)]
    masks = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:], strict=False)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    parts = [
        F.struct(F.lit(i).alias("band"), F.col("h").bitwiseAND(F.lit(signed(sum(some)))).alias("part"))
        for i, some in enumerate(combinations(masks, shared))
    ]
    banded = heads.select("head", "h", F.inline(F.array(*parts)))
    left, right = (banded.toDF(f"head_{s}", f"h_{s}", "band", "part") for s in "xy")
    close = left.join(right, ["band", "part"]).filter("head_x < head_y").withColumn("distance", hamming(F.col("h_x"), F.col("h_y")))
    close = close.filter(F.col("distance") <= distance).select(F.col("head_x").alias("a"), F.col("head_y").alias("b"), "distance").distinct()
    return close.unionByName(copies)


def identical_groups(df: DataFrame, key: str, content: str) -> DataFrame:
    """Edges from each record to the smallest key with the same content: (a, b), a < b."""
    rows = df.filter(F.col(content).isNotNull()).select(F.col(key).alias("b"), F.sha2(F.col(content), 256).alias("h")).distinct()
    heads = rows.groupBy("h").agg(F.min("b").alias("a"))
    return rows.join(heads, "h").filter("a < b").select("a", "b")


def smallest_linked(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 200) -> DataFrame:
    """The smallest linked key of every key of an edge: (member, group_id), by label propagation.

    Each round a member takes the smallest label among itself and its neighbours; a second
    step takes the label's own label, which shortens chains. Tables are cut every round.
    """
    both = edges.select(F.expr(f"inline(array(struct({a} AS v, {b} AS u), struct({b} AS v, {a} AS u)))")).filter("v <> u").distinct()
    links = write_cut(both, "links")
    labels = write_cut(links.df.groupBy("v").agg(F.least("v", F.min("u")).alias("label")), "labels", moved="count(*)")
    for _ in range(rounds):
        if not labels.seen["moved"]:
            break
        near = links.df.join(labels.df.toDF("u", "near"), "u").groupBy("v").agg(F.min("near").alias("near"))
        step = labels.df.join(near, "v").withColumn("next", F.least("label", "near"))
        own = labels.df.toDF("next", "own")
        step = step.join(own, "next").select("v", F.least("next", "own").alias("new"), "label")
        nxt = write_cut(step.select("v", F.col("new").alias("label"), (F.col("new") < F.col("label")).alias("moved")), "labels", moved="count_if(moved)")
        labels.drop()
        labels = nxt
        labels.df = labels.df.select("v", "label")
    else:
        raise RuntimeError("labels did not settle")
    links.drop()
    return labels.df.select(F.col("v").alias("member"), F.col("label").alias("group_id"))


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on both sides, only left, only right: one row (both, only_left, only_right)."""
    a = left.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_l", F.lit(1))
    b = right.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_r", F.lit(1))
    return a.join(b, key, "full").agg(
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("both"),
        F.count_if(F.col("_r").isNull()).alias("only_left"),
        F.count_if(F.col("_l").isNull()).alias("only_right"),
    )


def against_lock(found: DataFrame, lock: DataFrame, path: str, digest: str, expected: str) -> DataFrame:
    """Locked files and whether each was found with the expected hash; a missing file fails."""
    both = lock.join(found.select(path, digest), path, "left")
    return both.withColumn("matches", F.col(digest).eqNullSafe(F.col(expected)))
