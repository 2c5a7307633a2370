import random

import pytest

from millrace.llm.components import hash_to_min, hook_and_shortcut


def brute(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def shapes(seed):
    r = random.Random(seed)
    chain = [(i, i + 1) for i in range(40)]
    star = [(1000, 1001 + i) for i in range(60)]
    backwards = [(2999 - i, 3000 - i) for i in range(25)]
    loose = [(r.randrange(5000, 5200), r.randrange(5000, 5200)) for _ in range(150)]
    return chain + star + backwards + loose + [(b, a) for a, b in chain[:9]] + [(7, 7), (None, 3), (4, None), (None, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_match_union_find(spark, seed):
    pairs = shapes(seed)
    random.Random(seed).shuffle(pairs)
    df = spark.createDataFrame(pairs, "a long, b long").selectExpr("*", "1 AS v", "2 AS u", "'x' AS low", "3 AS m")
    want = brute(pairs)
    assert {r["member"]: r["group_id"] for r in hash_to_min(df, "a", "b").collect()} == want
    got = {r["node"]: r["root"] for r in hook_and_shortcut(df.selectExpr("a AS u", "b AS v")).collect()}
    assert set(got) == set(want)
    assert {frozenset(x for x in got if got[x] == r) for r in set(got.values())} == {frozenset(x for x in want if want[x] == r) for r in set(want.values())}


def test_no_links(spark):
    df = spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")
    assert hash_to_min(df, "a", "b").count() == 0
    assert hash_to_min(df.limit(0), "a", "b").count() == 0
    assert hook_and_shortcut(df.selectExpr("a AS u", "b AS v")).count() == 0


def test_settled_components_beside_a_long_chain(spark):
    """Small components are laid aside while a chain and a grid of links go on; nothing is lost or joined."""
    import random

    r = random.Random(4)
    pairs = [(k, k + 1) for k in range(5000, 5700)]
    pairs += [(100 * c + a, 100 * c + b) for c in range(30) for a, b in [(0, 1), (2, 1), (3, 0), (7, 3)][: 1 + c % 4]]
    pairs += [(9000 + r.randrange(60), 9000 + r.randrange(60)) for _ in range(50)] + [(20_000, 20_000 + k) for k in range(1, 200)]
    r.shuffle(pairs)
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    got = hash_to_min(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()
    assert sorted(map(tuple, got)) == sorted((root(x), x) for x in linked)
