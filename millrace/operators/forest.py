"""Class forests on tables of any size: all trees grow by one level in one job.

Rows are written once as blocks of bins (a byte a feature) and read again for every level. A task counts
classes by tree, node, feature and bin with numpy; only the counts are shuffled, their size is that
of the trees and not of the rows. The result is an ordinary MLlib model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.scratch import new_folder, write_cut
from millrace.sources.tables import spread

BINS = 32
#: Rows that numpy works on at once; quantiles of a feature within a class that the cuts are made of.
BLOCK_ROWS, POINTS = 32_768, 1_000
#: Tables of counts that are added up in one group.
FAN_IN = 256

#: How often a row is in a tree's sample, Poisson with mean 1, by 16 random bits.
_TIMES = np.searchsorted(np.cumsum(np.exp(-1) / np.cumprod([1, *range(1, 16)], dtype=float)), (np.arange(65_536) + 0.5) / 65_536).astype(np.uint8)

_COUNTS = "tree int, task long, width int, counts binary"
_SPLITS = "tree int, total binary, feature binary, cut binary, gain binary, left binary"


def _cuts(points: list[np.ndarray], weights: list[float]) -> np.ndarray:
    """At most BINS - 1 cuts that part the weighted points evenly, each midway between two of them."""
    x = np.concatenate(points)
    if not len(x):
        return x
    w = np.concatenate([np.full(len(p), a / len(p)) for p, a in zip(points, weights, strict=True) if len(p)])
    values, place = np.unique(x, return_inverse=True)
    if len(values) <= BINS:
        at = np.arange(len(values) - 1)
    else:
        upto = np.cumsum(np.bincount(place, weights=w))
        at = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, BINS) / BINS))
        at = at[at < len(values) - 1]
    return np.unique((values[at] + values[at + 1]) / 2)


def _blocks(data: DataFrame, columns: list[str], cuts: list[np.ndarray]) -> DataFrame:
    """(block, bins, classes): a byte a row and feature, features one after another."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, rows = TaskContext.get().partitionId() << 32, [], 0

        def out() -> pa.RecordBatch:
            x = np.concatenate(held, axis=1)
            return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "bins": [x[:-1].tobytes()], "classes": [x[-1].tobytes()]})

        for batch in batches:
            x = [np.searchsorted(c, batch.column(i).to_numpy(zero_copy_only=False)) for i, c in enumerate(cuts)]
            held.append(np.array([*x, batch.column(len(cuts)).to_numpy(zero_copy_only=False)]).astype(np.uint8))
            rows += batch.num_rows
            if rows >= BLOCK_ROWS:
                yield out()
                block, held, rows = block + 1, [], 0
        if rows:
            yield out()

    return data.select(*columns, "class_index").mapInArrow(pack, "block long, bins binary, classes binary")


def _count(level: int, chosen: np.ndarray, feature: np.ndarray, cut: np.ndarray, classes: int, seed: int):
    """Rows of every class by tree, node of the level, chosen feature and bin, as often as they are in the tree's sample."""
    trees, nodes, tried = chosen.shape
    cells = nodes * BINS * classes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((trees, tried, cells))
        for batch in batches:
            for block, bins, labels in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                y = np.frombuffer(labels, np.uint8).astype(np.int64)
                rows = np.frombuffer(bins, np.uint8).reshape(-1, len(y))
                numbers = np.arange(len(y))
                for t in range(trees):
                    # the same sample at every level
                    times = _TIMES.take(np.random.Generator(np.random.SFC64([seed, block, t])).integers(0, 65_536, len(y), np.uint16))
                    keep = np.flatnonzero(times)
                    x, n = rows.take(keep, axis=1).ravel(), numbers[: len(keep)]
                    first, at = feature[t] * len(keep), np.zeros(len(keep), np.int64)
                    for _ in range(level):
                        right = x.take(first.take(at) + n) > cut[t].take(at)
                        at = 2 * at + 1 + right
                    at -= nodes - 1
                    start, weights = at * (BINS * classes) + y.take(keep), times.take(keep).astype(float)
                    for j in range(tried):
                        bin_ = x.take((chosen[t, :, j] * len(keep)).take(at) + n)
                        counts[t, j] += np.bincount(start + bin_.astype(np.int64) * classes, weights, cells)
        task = TaskContext.get().partitionId()
        for t in range(trees):
            yield _counted(t, task, counts[t])

    return count


def _counted(tree: int, task: int, counts: np.ndarray) -> pa.RecordBatch:
    most = counts.max()
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(k).max)
    columns = [pa.array([tree], pa.int32()), pa.array([task], pa.int64()), pa.array([np.dtype(kind).itemsize], pa.int32()), pa.array([counts.astype(kind).tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["tree", "task", "width", "counts"])


def _added(table: pa.Table) -> np.ndarray:
    total = 0.0
    for width, counts in zip(table["width"].to_pylist(), table["counts"], strict=True):
        total = total + np.frombuffer(counts.as_buffer(), f"u{width}").astype(float)
    return total


def _gini(x: np.ndarray) -> np.ndarray:
    n = x.sum(axis=-1, keepdims=True)
    return 1 - np.square(np.divide(x, n, out=np.zeros_like(x), where=n > 0)).sum(axis=-1)


def best_splits(counts: np.ndarray, weights: np.ndarray, leaf: int) -> tuple[np.ndarray, ...]:
    """counts by tried feature, node, bin and class -> by node: counts of classes, the tried feature, last bin of the left side, gain of impurity (0: no split), counts of the left side.

    Both sides hold at least leaf rows; impurity is that of the weighted classes. The first of equal splits.
    """
    left = counts.cumsum(axis=2)
    total = left[:1, :, -1:]
    right = total - left
    all_, l, r = total * weights, left * weights, right * weights  # noqa: E741
    n = np.maximum(all_.sum(axis=-1), np.finfo(float).tiny)
    gain = _gini(all_) - l.sum(axis=-1) / n * _gini(l) - r.sum(axis=-1) / n * _gini(r)
    gain = np.where((left.sum(axis=-1) >= leaf) & (right.sum(axis=-1) >= leaf), gain, 0.0)
    tried, nodes, bins = gain.shape
    flat = gain.transpose(1, 0, 2).reshape(nodes, tried * bins)
    best = flat.argmax(axis=1)
    node = np.arange(nodes)
    return total[0, :, 0], best // bins, best % bins, np.maximum(flat[node, best], 0.0), left[best // bins, node, best % bins]


def _split(nodes: int, tried: int, weights: np.ndarray, leaf: int):
    def split(table: pa.Table) -> pa.Table:
        counts = _added(table).reshape(tried, nodes, BINS, len(weights))
        total, which, cut, gain, left = best_splits(counts, weights, leaf)
        found = {"total": total, "feature": which.astype(np.int64), "cut": cut.astype(np.int64), "gain": gain, "left": left}
        return pa.table({"tree": pa.array([table["tree"][0].as_py()], pa.int32())} | {k: pa.array([v.tobytes()], pa.binary()) for k, v in found.items()})

    return split


def _add(table: pa.Table) -> pa.Table:
    tree, task = table["tree"][0].as_py(), table["task"][0].as_py()
    return pa.Table.from_batches([_counted(tree, task // FAN_IN, _added(table))])


def fit(data: DataFrame, columns: list[str], classes: int, depth: int, leaf: int, trees: int, seed: int) -> RandomForestClassificationModel:
    """A forest of Poisson samples with balanced classes, as MLlib's: ceil(sqrt) features a node, Gini impurity, siblings of one class merged.

    data: the columns (no nulls) and class_index, 0 to classes - 1; a null class is an error. Cuts come from
    quantiles of all rows, the classes alike.
    """
    shares = F.lit([(i + 0.5) / POINTS for i in range(POINTS)])
    groups = data.groupBy("class_index").agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(c, shares, 10_000).alias(c) for c in columns]).collect()
    if not groups or any(g["class_index"] is None for g in groups):
        raise ValueError("a forest needs rows, and a class for each")
    weights, even = np.zeros(classes), sum(g["n"] for g in groups) / len(groups)
    for g in groups:
        weights[int(g["class_index"])] = even / g["n"]
    cuts = [_cuts([np.array(g[c] or [], float) for g in groups], [even] * len(groups)) for c in columns]
    blocks = write_cut(_blocks(spread(data.select(*columns, "class_index")), columns, cuts), "bins")
    tasks = blocks.df._jdf.queryExecution().toRdd().getNumPartitions()

    tried = int(np.ceil(np.sqrt(len(columns))))
    heap = 2 ** (depth + 1) - 1
    feature, cut = np.zeros((trees, heap), np.int64), np.full((trees, heap), BINS, np.uint8)
    total, gain = np.zeros((trees, heap, classes)), np.zeros((trees, heap))
    for level in range(depth):
        nodes, start = 2**level, 2**level - 1
        chosen = np.random.default_rng([seed, level]).random((trees, nodes, len(columns))).argsort(axis=2)[:, :, :tried]
        counts, left = blocks.df.mapInArrow(_count(level, chosen, feature[:, :start], cut[:, :start], classes, seed), _COUNTS), tasks
        while left > FAN_IN:
            counts, left = counts.groupBy("tree", F.floor(F.col("task") / FAN_IN)).applyInArrow(_add, _COUNTS), -(-left // FAN_IN)
        grown = False
        for row in counts.groupBy("tree").applyInArrow(_split(nodes, tried, weights, leaf), _SPLITS).collect():
            t, here = row["tree"], slice(start, start + nodes)
            if level == 0:
                total[t, 0] = np.frombuffer(row["total"])
            which, at, gains, lefts = (np.frombuffer(row[c], k) for c, k in (("feature", np.int64), ("cut", np.int64), ("gain", float), ("left", float)))
            # rows of a node that ended go on to the left and are not split again
            there = total[t, here].sum(axis=1) > 0
            gain[t, here] = np.where(there, gains, 0.0)
            ends = gain[t, here] <= 0
            feature[t, here] = np.where(ends, 0, np.take_along_axis(chosen[t], which[:, None], 1)[:, 0])
            cut[t, here] = np.where(ends, BINS, at)
            lefts = lefts.reshape(nodes, classes)
            below = total[t, start + nodes : start + 3 * nodes]
            below[0::2] = np.where(ends[:, None], 0, lefts)
            below[1::2] = np.where(ends[:, None], 0, total[t, here] - lefts)
            grown |= not ends.all()
        if not grown:
            break
    blocks.drop()
    every = [_tree(t, total[t], total[t] * weights, gain[t], feature[t], cut[t], cuts) for t in range(trees)]
    forest = RandomForestClassifier(
        labelCol="class_index", weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy="sqrt", seed=seed
    )
    return _model(data, forest, len(columns), classes, [n for tree in every for n in tree])


def _tree(t: int, rows: np.ndarray, stats: np.ndarray, gain: np.ndarray, feature: np.ndarray, cut: np.ndarray, cuts: list[np.ndarray]) -> list[dict]:
    """The nodes of a tree in MLlib's stored form, numbered from the root; sibling leaves of one class are merged."""
    impurity, prediction = _gini(stats), stats.argmax(axis=1)
    splits = gain > 0
    for i in range(len(gain) // 2 - 1, -1, -1):
        a, b = 2 * i + 1, 2 * i + 2
        if splits[i] and not splits[a] and not splits[b] and prediction[a] == prediction[b]:
            splits[i] = False
    out = []

    def add(i: int) -> int:
        node = {
            "id": len(out), "prediction": float(prediction[i]), "impurity": float(impurity[i]), "impurityStats": stats[i].tolist(), "rawCount": int(rows[i].sum()),
            "gain": -1.0, "leftChild": -1, "rightChild": -1, "split": {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1},
        }
        out.append({"treeID": t, "nodeData": node})
        if splits[i]:
            limit = float(cuts[feature[i]][cut[i]])
            node |= {"gain": float(gain[i]), "split": {"featureIndex": int(feature[i]), "leftCategoriesOrThreshold": [limit], "numCategories": -1}}
            node["leftChild"] = add(2 * i + 1)
            node["rightChild"] = add(2 * i + 2)
        return node["id"]

    add(0)
    return out


def _model(data: DataFrame, forest: RandomForestClassifier, features: int, classes: int, nodes: list[dict]) -> RandomForestClassificationModel:
    """An MLlib model of these nodes: one of as many trees is fitted on a row a class, saved, and read with the nodes in place of its own."""
    spark = data.sparkSession
    folder = new_folder(spark, "forest")
    rows = spark.createDataFrame([(Vectors.dense([float(i)] * features), float(i), 1.0) for i in range(classes)], ["features", "class_index", "weight"])
    forest.fit(rows.coalesce(1)).write().overwrite().save(folder)
    split = pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())])
    node = [("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())), ("rawCount", pa.int64())]
    node += [("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()), ("split", split)]
    table = pa.Table.from_pylist(nodes, pa.schema([("treeID", pa.int32()), ("nodeData", pa.struct(node))]))
    spark.createDataFrame(table).write.mode("overwrite").parquet(f"{folder}/data")
    return RandomForestClassificationModel.load(folder)
