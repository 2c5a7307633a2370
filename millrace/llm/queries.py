"""Queries of the training-data problems, over whole tables with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import leaks, packing, sentences, splits
from millrace.llm.components import hash_to_min
from millrace.sources.tables import table

#: Largest perceptual distance of a match.
MATCH_DISTANCE = 6
#: The public vocabulary that sizes are measured with: a file on every executor.
VOCABULARY = os.environ.get("MILLRACE_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")


def split_pattern() -> str:
    """The word pattern that goes with the public vocabularies; another vocabulary's may be named instead."""
    if named := os.environ.get("MILLRACE_SPLIT_PATTERN"):
        return named
    import public_tokenizers

    return public_tokenizers.PATTERN


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return splits.units_across_splits(table(spark, folder, "vehicle_objects"))


def p1_splits(spark: SparkSession, folder: str) -> DataFrame:
    return splits.assign_splits(table(spark, folder, "vehicle_objects"), table(spark, folder, "split_targets"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = table(spark, folder, "image_pairs").filter(f"phash_hamming BETWEEN 0 AND {MATCH_DISTANCE}")
    groups = hash_to_min(pairs, "image_a", "image_b")
    return groups.select("group_id", groups["member"].alias("image_id"))


def _packed(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    return packing.pack_texts(table(spark, folder, "documents"), table(spark, folder, "container_sizes"), VOCABULARY, split_pattern(), strict=strict)


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder).drop("source", "cluster")


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Space used and conflicts, with sources held apart where it costs no container and as a hard rule."""
    sizes = table(spark, folder, "container_sizes")
    soft, hard = (packing.fill_report(_packed(spark, folder, strict), sizes).withColumn("strict", F.lit(strict)) for strict in (False, True))
    return soft.unionByName(hard)


def p6_faults(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packing_faults(_packed(spark, folder), table(spark, folder, "container_sizes"))


def p1_faults(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of p1_splits: every object once, whole units, shares within one object in a thousand (and one) of the targets."""
    targets = table(spark, folder, "split_targets")
    dealt = splits.assign_splits(table(spark, folder, "vehicle_objects"), targets)
    by_unit = dealt.groupBy("unit_object_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("object_id").alias("objects"), F.countDistinct("split_name").alias("splits"))
    units = by_unit.agg(
        F.count(F.lit(1)).alias("units"), F.sum("objects").alias("objects"), F.sum(F.col("n") - F.col("objects")).alias("repeats"), F.count_if(F.col("splits") > 1).alias("cut_units")
    )
    shares = dealt.groupBy("split_name").count().join(targets, "split_name", "full")
    total = F.sum("count").over(Window.partitionBy())
    shares = shares.select(F.abs(F.col("count") - F.col("share") * total).alias("off"), total.alias("total"))
    return units.join(shares.agg(F.count_if(~F.coalesce(F.col("off") <= 1 + F.col("total") / 1000, F.lit(False))).alias("splits_off")))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    found = leaks.leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return found.select("doc_id", "item_id").distinct()


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentence_spans(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_splits, p1_faults, p3_found, p6_containers, p6_fill, p6_faults, p7_found, p8_found)}

_UNITS = """
WITH RECURSIVE rows_ AS (
  SELECT object_id AS o, image_id AS i, CASE WHEN scene_group > 0 THEN scene_group END AS s,
         CASE WHEN lower(trim(split)) = 'val' THEN 'validation' ELSE nullif(lower(trim(split)), '') END AS split
  FROM vehicle_objects WHERE object_id IS NOT NULL),
links AS (
  SELECT DISTINCT o AS a, 1000000000000 + i AS b FROM rows_ WHERE i IS NOT NULL
  UNION SELECT DISTINCT o, 2000000000000 + s FROM rows_ WHERE s IS NOT NULL),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, low) AS (
  SELECT DISTINCT o, o FROM rows_
  UNION SELECT e.b, r.low FROM reach r JOIN edges e ON r.node = e.a WHERE r.low < e.b),
units AS (SELECT node, min(low) AS unit FROM reach GROUP BY node)"""

ORACLE = {
    "p1_faults": f"""{_UNITS},
o AS (SELECT DISTINCT r.o, u.unit FROM rows_ r JOIN units u ON r.o = u.node)
SELECT count(DISTINCT unit) AS units, count(*) AS objects, CAST(0 AS BIGINT) AS repeats, CAST(0 AS BIGINT) AS cut_units, CAST(0 AS BIGINT) AS splits_off FROM o""",
    "p6_faults": """
SELECT container_kind, (SELECT count(DISTINCT doc_id) FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '[^\\s\\p{Z}]')) AS n_docs,
       CAST(0 AS BIGINT) AS over_capacity, CAST(0 AS BIGINT) AS copies, CAST(0 AS BIGINT) AS cut_wrongly
FROM container_sizes""",
    "p1_found": f"""{_UNITS}
SELECT u.unit AS unit_object_id FROM rows_ r JOIN units u ON r.o = u.node
GROUP BY u.unit HAVING count(DISTINCT r.split) > 1""",
    "p3_found": """
WITH RECURSIVE links AS (
  SELECT DISTINCT image_a AS a, image_b AS b FROM image_pairs
  WHERE phash_hamming BETWEEN 0 AND 6 AND image_a IS NOT NULL AND image_b IS NOT NULL AND image_a <> image_b),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, low) AS (
  SELECT DISTINCT a, a FROM edges
  UNION SELECT e.b, r.low FROM reach r JOIN edges e ON r.node = e.a WHERE r.low < e.b)
SELECT min(low) AS group_id, node AS image_id FROM reach GROUP BY node""",
}
