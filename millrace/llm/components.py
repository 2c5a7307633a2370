"""Connected components over edge tables, in two ways that never hold a component in one task.

Both take edges as rows, keep everything in tables of the shared folder between rounds and
touch single vertices by joins whose other side has unique keys, so that a vertex with a
third of all rows is split by adaptive skew handling; all groupings combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.scratch import Written, write_cut

#: Rounds grow with the logarithm of a component's size; more than this means a fault.
ROUND_LIMIT = 200
#: Settled components are looked for in every so many rounds of hash-to-min, by two states in a row.
SETTLE = 3


def hash_to_min(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Group ids for all records linked by pairs, by hash-to-min.

    Every vertex v holds a cluster set C(v), kept as rows (v, u). In a round v sends C(v) to
    its smallest member m and {m} to every member of C(v); received sets are united. The
    state is stable when a round reproduces it; then the smallest record of a component
    holds all its records and every other record holds the smallest one. Components that are
    so already (see _whole_clusters) are laid aside every few rounds, so that a long chain
    does not carry all others through its rounds.

    pairs: one row per match; a, b: its two integer columns. Rows with a null id and pairs
    of a record with itself link nothing; repeats and either order are one link. Other
    columns are ignored, whatever their names. No pairs: no rows.
    Returns (group_id, member): one row per linked record, group_id the smallest record.
    """
    ends = pairs.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y"))
    ends = ends.filter("x IS NOT NULL AND y IS NOT NULL AND x <> y")
    ends = ends.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    both = ends.select(F.expr("inline(array(struct(x AS v, y AS u), struct(y AS v, x AS u)))"))
    stamp = {"n": "count(*)", "h": "bit_xor(xxhash64(v, u))"}
    state = write_cut(both, "h2m", **stamp)
    settled: list[DataFrame] = []
    before: Written | None = None
    for turn in range(ROUND_LIMIT):
        if not state.seen["n"]:
            break
        rows = state.df
        sets = rows.groupBy("v").agg(F.min("u").alias("low"), F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u))").alias("mark"))
        tables = []
        if turn >= SETTLE and turn % SETTLE < 2:
            tables.append(write_cut(sets, "sets"))
            sets = tables[0].df
            whole = _whole_clusters(sets)
            if before is None:
                before = write_cut(whole, "whole")
            else:
                tables.append(before)
                still = write_cut(whole.join(before.df, ["low", "n", "mark"], "left_semi").select(F.col("low").alias("g")), "settled", n="count(*)")
                before = None
                tables.append(still)
                if still.seen["n"]:
                    members = sets.filter("low < v").select(F.col("low").alias("g"), F.col("v").alias("member")).join(still.df, "g")
                    settled.append(write_cut(members.unionByName(still.df.withColumn("member", F.col("g"))), "members").df)
                    sets = sets.withColumn("g", F.least("v", "low")).join(still.df, "g", "left_anti")
        # rows of settled records find no partner here; hashing one short row a record saves sorting both sides
        sent = rows.join(sets.select("v", "low").hint("shuffle_hash"), "v").withColumn("m", F.least("v", "low"))
        # C(v) also holds v itself: that part goes out once, with the row of the lowest member.
        out = sent.select(
            F.expr(
                "inline(IF(u = low, array(struct(m AS v, u AS u), struct(u AS v, m AS u), struct(m AS v, v AS u), struct(v AS v, m AS u)),"
                " array(struct(m AS v, u AS u), struct(u AS v, m AS u))))"
            )
        )
        nxt = write_cut(out.filter("v <> u").distinct(), "h2m", **stamp)
        stable = nxt.seen == state.seen
        for t in [state, *tables]:
            t.drop()
        state = nxt
        if stable:
            break
    else:
        raise RuntimeError("hash-to-min did not settle")
    least = state.df.groupBy("v").agg(F.min("u").alias("low"))
    out = least.select(F.least("v", "low").alias("g"), F.col("v").alias("member"))
    for part in settled:
        out = out.unionByName(part)
    return out.select(F.col("g").alias("group_id"), "member")


def _whole_clusters(sets: DataFrame) -> DataFrame:
    """(low, n, mark) of the clusters that look complete, from (v, low, n, mark): the smallest member of C(v), its size and hash.

    The smallest record holds n others, each of which holds nothing but it, and nobody else
    does. Found so in two successive states, unchanged, a cluster is a whole component: had a
    record outside held one of its records, that one would have got another minimum meanwhile.
    """
    leaf, root = (F.col("low") < F.col("v")) & (F.col("n") == 1), F.col("low") > F.col("v")
    by = sets.groupBy(F.least("v", "low").alias("g")).agg(
        F.count_if(leaf).alias("leaves"),
        F.bit_xor(F.when(leaf, F.xxhash64("v"))).alias("leaf_mark"),
        F.max(F.when(root, F.col("n"))).alias("n"),
        F.max(F.when(root, F.col("mark"))).alias("mark"),
        F.bool_or(~leaf & ~root).alias("open"),
    )
    return by.filter("NOT open AND leaves = n AND leaf_mark = mark").select(F.col("g").alias("low"), "n", "mark")


def _jump(parents: Written) -> Written:
    """Shortcutting: replace every parent by its parent until all parents are roots."""
    for _ in range(ROUND_LIMIT):
        if not parents.seen["moved"]:
            return parents
        up = parents.df.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        nxt = parents.df.join(up, "parent", "left")
        nxt = nxt.select("node", F.coalesce("grand", "parent").alias("parent"), (F.col("grand") < F.col("parent")).alias("moved"))
        done = write_cut(nxt, "jump", moved="count_if(moved)")
        parents.drop()
        parents = done
    raise RuntimeError("shortcutting did not settle")


def hook_and_shortcut(edges: DataFrame) -> DataFrame:
    """Components by parallel hooking and shortcutting over a parent table.

    edges: long columns u, v; nulls and loops are ignored. Each round every node hooks onto
    its smallest neighbour if that is smaller, parents are shortcut to roots by joining the
    parent table with itself, and edges are replaced by the distinct edges between roots,
    which also shrinks the work. Ends when no edge is left.
    Returns (node, root): every node of an edge; root is one node of its component (the
    same for all of them). No edges: no rows.
    """
    clean = edges.select("u", "v").filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    live = write_cut(clean.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges", n="count(*)")
    labels: Written | None = None
    for _ in range(ROUND_LIMIT):
        if not live.seen["n"]:
            break
        hooked = live.df.select(F.expr("inline(array(struct(u AS node, v AS other), struct(v AS node, u AS other)))"))
        hooked = hooked.groupBy("node").agg(F.min("other").alias("other"))
        hooked = hooked.select("node", F.least("node", "other").alias("parent"), F.lit(True).alias("moved"))
        parents = write_cut(hooked, "hook", moved="count_if(parent < node)")
        parents = _jump(parents)
        to = parents.df.select("node", "parent")
        left = live.df.join(to.toDF("u", "a"), "u").join(to.toDF("v", "b"), "v")
        left = left.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u <> v").distinct()
        nxt = write_cut(left, "edges", n="count(*)")
        if labels is None:
            labels = parents
        else:
            old = labels.df.select("node", F.col("parent").alias("mid"))
            joined = old.join(to.toDF("mid", "parent"), "mid", "left").select("node", F.coalesce("parent", "mid").alias("parent"))
            both = write_cut(joined, "labels")
            labels.drop()
            parents.drop()
            labels = both
        live.drop()
        live = nxt
    else:
        raise RuntimeError("hooking did not settle")
    live.drop()
    if labels is None:
        return clean.select(F.col("u").alias("node"), F.col("v").alias("root")).limit(0)
    return labels.df.select("node", F.col("parent").alias("root"))
