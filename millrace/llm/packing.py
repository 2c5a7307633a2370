"""Filling fixed-capacity containers with whole texts, measured in tokens."""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.tables import spread

#: Texts packed together. Each group leaves a few containers partly empty, of about one in a thousand.
TEXTS_PER_SHARD = 20_000
#: Containers of one group are numbered within this range.
CONTAINERS_PER_SHARD = 1 << 32

_encodings: dict[tuple[str, str], object] = {}


def _encoding(vocabulary: str, pattern: str):
    """The tokenizer, loaded once per worker process."""
    key = (vocabulary, pattern)
    if key not in _encodings:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encodings[key] = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def text_sizes(documents: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """(doc_id, source, cluster, n_tokens) of every document with an id and a text that is not blank.

    vocabulary: a byte-level vocabulary in rank form, on every executor; pattern: its word pattern. cluster is a hash of the text without case and with single blanks: copies share it. The
    whole text is measured; special tokens' strings count as ordinary text.
    """
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col(text).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        encoding = _encoding(vocabulary, pattern)
        for batch in batches:
            keep, sizes, clusters = [], [], []
            for n, t in enumerate(batch.column(2).to_pylist()):
                if t and (words := t.split()):
                    keep.append(n)
                    sizes.append(len(encoding.encode_ordinary(t)))
                    clusters.append(xxhash.xxh3_64_intdigest(" ".join(words).lower().encode("utf-8", "replace")) - (1 << 63))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(clusters, pa.int64()), pa.array(sizes, pa.int64())],
                ["doc_id", "source", "cluster", "n_tokens"],
            )

    sized = spread(base.filter("doc_id IS NOT NULL AND text IS NOT NULL"))
    return sized.mapInArrow(measure, "doc_id long, source string, cluster long, n_tokens long")


def best_fit(sizes: list[int], capacity: int, clusters: list[int], sources: list[str | None], strict: bool = False) -> tuple[list[int], int]:
    """The container of every item, and how many there are; items in the order given (largest first).

    Open containers are kept in order of their free space and carry bitmaps of the sources and
    duplicate clusters they hold. An item goes into the tightest container that is
    compatible: the search starts at the first with room and goes on to the next larger until
    one has no copy of the item and no text of its source. Only where none is left a new one
    is opened. Copies never share a container. With strict, neither do two texts of a known source; otherwise a
    source gives way before a container is opened: the search is repeated for one without a copy, and a
    source with so many items that it cannot be spread (more than half of the fewest
    possible containers) is not held apart. An unknown source never is.
    """
    fewest = -(-sum(sizes) // capacity) if sizes else 0
    counts = Counter(sources)
    common = {s for s, n in counts.items() if s is None or (not strict and 2 * n > fewest)}
    bit: dict[object, int] = {}
    copies = Counter(clusters)
    free: list[tuple[int, int]] = []  # (free space, container), ascending
    held: list[int] = []  # bitmaps by container
    where = []
    for size, cluster, source in zip(sizes, clusters, sources, strict=True):
        own = copy = 0
        if copies[cluster] > 1:
            own = copy = 1 << bit.setdefault(("copy", cluster), len(bit))
        if source not in common:
            own |= 1 << bit.setdefault(("source", source), len(bit))
        start = at = bisect_left(free, (size, -1))
        while own and at < len(free) and held[free[at][1]] & own:
            at += 1
        if at == len(free) and own != copy and not strict:
            at = start
            while copy and at < len(free) and held[free[at][1]] & copy:
                at += 1
        if at < len(free):
            room, box = free.pop(at)
        else:
            room, box = capacity, len(held)
            held.append(0)
        held[box] |= own
        if room > size:
            insort(free, (room - size, box))
        where.append(box)
    return where, len(held)


def _pack(key: tuple, table: pa.Table, strict: bool) -> pa.Table:
    """All containers of one kind for one group of texts."""
    shard, kind, capacity = (k.as_py() for k in key)
    doc, size, cluster = (table[c].to_numpy() for c in ("doc_id", "n_tokens", "cluster"))
    source = table["source"].to_pylist()
    order = np.lexsort((cluster, doc, -size))
    rows: list[tuple[int, int, int, int]] = []  # (number of the text, piece, first token, tokens)
    whole: list[tuple[int, int, int, int]] = []
    for n in order.tolist():
        s = int(size[n])
        full, rest = divmod(s, capacity) if s > capacity else (0, s)
        whole += [(n, k, k * capacity, capacity) for k in range(full)]
        if rest:
            rows.append((n, full, full * capacity, rest))
    rows.sort(key=lambda r: -r[3])
    where, used = best_fit([r[3] for r in rows], capacity, [int(cluster[r[0]]) for r in rows], [source[r[0]] for r in rows], strict)
    where += range(used, used + len(whole))
    rows += whole
    n, piece, first, tokens = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.empty(0, np.int64),) * 4
    return pa.table(
        {
            "container_kind": pa.array([kind] * len(rows), pa.string()),
            "container_id": pa.array(np.array(where, np.int64) + shard * CONTAINERS_PER_SHARD, pa.int64()),
            "doc_id": pa.array(doc[n], pa.int64()),
            "piece": pa.array(piece, pa.int32()),
            "first_token": pa.array(first, pa.int64()),
            "n_tokens": pa.array(tokens, pa.int64()),
            "source": table["source"].take(pa.array(n)),
            "cluster": pa.array(cluster[n], pa.int64()),
        }
    )


def pack_texts(documents: DataFrame, kinds: DataFrame, vocabulary: str, pattern: str, text: str = "text", strict: bool = False) -> DataFrame:
    """Pack every text into containers of each kind: one row per text, or per piece of a text beyond the capacity.

    kinds: (container_kind, capacity_tokens); rows with a null kind or a capacity that is
    not positive are no kind. Texts are dealt by hash of the id to groups of about
    TEXTS_PER_SHARD (copies of one text spread over all groups), and each group is packed by
    best fit, largest first, under the conflicts of best_fit. A text above the capacity is cut
    into full containers and one rest, which is packed like an item; all others stay whole.
    Documents without an id and null or blank texts are not packed; repeated rows are packed
    each; a null source is unknown. Nothing to pack or no kind: no rows.
    strict: two texts of a known source never share a container, at the cost of more of them.
    Returns (container_kind, container_id, doc_id, piece, first_token, n_tokens, source, cluster).
    """
    shards = max(1, -(-documents.count() // TEXTS_PER_SHARD))
    sizes = text_sizes(documents, vocabulary, pattern, text).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    sorts = kinds.select("container_kind", F.col("capacity_tokens").cast("long").alias("capacity"))
    sorts = [(r[0], r[1]) for r in sorts.filter("container_kind IS NOT NULL AND capacity > 0").distinct().orderBy("container_kind", "capacity").collect()]
    schema = "container_kind string, container_id long, doc_id long, piece int, first_token long, n_tokens long, source string, cluster long"
    if not sorts:
        return documents.sparkSession.createDataFrame([], schema)
    each = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("long").alias("capacity")) for k, c in sorts])
    items = sizes.select("shard", "doc_id", "source", "cluster", "n_tokens", F.inline(each))
    return items.groupBy("shard", "container_kind", "capacity").applyInArrow(lambda key, table: _pack(key, table, strict), schema)


def fill_containers(documents: DataFrame, kinds: DataFrame, vocabulary: str, pattern: str, text: str = "text", strict: bool = False) -> DataFrame:
    """pack_texts without the conflict columns: (container_kind, container_id, doc_id, piece, first_token, n_tokens)."""
    return pack_texts(documents, kinds, vocabulary, pattern, text, strict).drop("source", "cluster")


def _boxes(packed: DataFrame) -> DataFrame:
    """One row a container: tokens used and whether it holds two texts of a known source, or two copies. Its texts are bounded by its capacity."""
    twice = lambda c: F.count(c) > F.size(F.collect_set(c))
    boxes = packed.groupBy("container_kind", "container_id")
    return boxes.agg(F.sum("n_tokens").alias("used"), twice("source").alias("source_twice"), twice("cluster").alias("copies"))


def _capacities(kinds: DataFrame) -> DataFrame:
    return kinds.groupBy("container_kind").agg(F.max("capacity_tokens").cast("long").alias("capacity"))


def fill_report(packed: DataFrame, kinds: DataFrame) -> DataFrame:
    """How well pack_texts filled containers: (container_kind, containers, tokens, fill, source_twice, copies).

    fill is the share of the space used; source_twice counts containers that hold two texts of
    a known source, copies those that hold two copies of a text (always 0).
    """
    by_kind = _boxes(packed).groupBy("container_kind").agg(
        F.count(F.lit(1)).alias("containers"),
        F.sum("used").alias("tokens"),
        F.count_if("source_twice").alias("source_twice"),
        F.count_if("copies").alias("copies"),
    )
    out = by_kind.join(_capacities(kinds), "container_kind")
    fill = F.col("tokens") / (F.col("containers") * F.col("capacity"))
    return out.select("container_kind", "containers", "tokens", fill.alias("fill"), "source_twice", "copies")


def packing_faults(packed: DataFrame, kinds: DataFrame) -> DataFrame:
    """What must hold of pack_texts: (container_kind, n_docs, over_capacity, copies, cut_wrongly).

    n_docs: documents packed. The others are 0: containers above the capacity or with copies;
    documents cut though they fit, or whose pieces overlap or leave tokens out.
    """
    capacity = _capacities(kinds)
    boxes = _boxes(packed).join(capacity, "container_kind").groupBy("container_kind")
    boxes = boxes.agg(F.count_if(F.col("used") > F.col("capacity")).alias("over_capacity"), F.count_if("copies").alias("copies"))
    pieces = packed.groupBy("container_kind", "doc_id").agg(
        F.sum("n_tokens").alias("size"),
        F.max(F.col("first_token") + F.col("n_tokens")).alias("end"),
        F.count(F.lit(1)).alias("pieces"),
        F.countDistinct("piece").alias("numbers"),
    )
    pieces = pieces.join(capacity, "container_kind")
    fine = (F.col("size") == F.col("end")) & (F.col("pieces") == F.col("numbers")) & (F.col("pieces") == F.ceil(F.col("size") / F.col("capacity")))
    docs = pieces.groupBy("container_kind").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(~fine).alias("cut_wrongly"))
    return docs.join(boxes, "container_kind").select("container_kind", "n_docs", "over_capacity", "copies", "cut_wrongly")
