from collections import defaultdict

import pytest

from millrace.llm import splits
from millrace.llm.splits import assign_splits, closest_totals, units_across_splits

SCHEMA = "object_id long, image_id long, scene_group long, split string, node long, root long, size int"
ROWS = [
    (10, 1, None, "train"),
    (11, 1, None, " Train "),
    (20, 2, 5, "val"),
    (21, 3, 5, "VALIDATION"),
    (30, 4, 7, "train"),
    (31, 5, 7, None),
    (31, 5, 8, ""),
    (32, 6, 8, "test"),
    (40, None, -1, "train"),
    (41, None, 0, "test"),
    (42, None, None, None),
    (50, 9, None, "train"),
    (50, None, 77, "train"),
    (51, None, 77, "test"),
    (60, 12, None, "train"),
    (60, 13, None, "train"),
    (61, 13, None, "validation"),
    (None, 1, 7, "test"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)


def test_units_with_several_splits(spark):
    assert sorted(r[0] for r in units_across_splits(frame(spark)).collect()) == [30, 50, 60]
    assert units_across_splits(frame(spark, [])).count() == 0


def test_whole_units_close_to_the_targets(spark):
    rows = ROWS + [(1000 + i, 2000 + i // (1 + i % 7), None, None) for i in range(300)]
    targets = spark.createDataFrame([("train", 0.6), ("validation", 0.2), ("test", 0.2), (None, 0.5), ("none", 0.0)], "split_name string, share double")
    got = [tuple(r) for r in assign_splits(frame(spark, rows), targets).collect()]
    objects = {r[0] for r in rows if r[0] is not None}
    assert sorted(g[0] for g in got) == sorted(objects)
    by_unit, by_split = defaultdict(set), defaultdict(int)
    for o, u, s in got:
        by_unit[u].add(s)
        by_split[s] += 1
    assert all(len(s) == 1 for s in by_unit.values())
    assert {o: u for o, u, _ in got}[32] == 30
    n = len(objects)
    assert abs(by_split["train"] - 0.6 * n) <= 1
    assert abs(by_split["test"] - 0.2 * n) <= 1
    assert sorted(got) == sorted(tuple(r) for r in assign_splits(frame(spark, rows), targets).collect())
    assert assign_splits(frame(spark, []), targets).count() == 0
    with pytest.raises(ValueError):
        assign_splits(frame(spark), targets.limit(0))


@pytest.mark.parametrize(
    "sizes", [{1: 1}, {7: 3}, {1: 1000, 5: 200, 900: 1}, {3: 5, 11: 9, 17: 40, 1000: 2}, {1000: 1, 1: 3}, {2**20: 3, 1: 5}, {}]
)
def test_totals_are_the_closest(sizes):
    shares = [0.6, 0.2, 0.2]
    dealt = closest_totals(sizes, shares)
    assert {s: sum(d) for s, d in dealt.items()} == sizes
    total = sum(s * m for s, m in sizes.items())
    got = [sum(s * d[i] for s, d in dealt.items()) for i in range(3)]
    if sizes == {1: 1000, 5: 200, 900: 1}:
        assert got == [1740, 580, 580]
    assert sum(got) == total


def test_subset_is_optimal_against_brute_force():
    import itertools
    import random

    for seed in range(30):
        r = random.Random(seed)
        sizes = [r.randrange(1, 40) for _ in range(9)]
        hist = {s: sizes.count(s) for s in sizes}
        total = sum(sizes)
        got = closest_totals(hist, [0.5, 0.5])
        first = min(abs(2 * sum(s * d[i] for s, d in got.items()) - total) for i in (0, 1))
        best = min(abs(2 * sum(c) - total) for k in range(10) for c in itertools.combinations(sizes, k))
        assert first == best


def test_large_tables_and_units(monkeypatch):
    """Beyond the bitset the totals are as close as they are with one that holds everything."""
    cases = [
        {1: 30_000, 3: 900, 40: 50},
        {60_000: 1, 1: 10_000, 2: 20_000, 7: 3_000, 1000: 70},
        {60_000: 3, 1: 5, 123: 200, 9: 7},
        {s: max(1, 40_000 // s**2) for s in range(1, 80)},
    ]
    off = lambda sizes: [
        abs(sum(s * d[i] for s, d in closest_totals(sizes, [0.6, 0.2, 0.2]).items()) - w * sum(s * m for s, m in sizes.items())) for i, w in enumerate((0.6, 0.2, 0.2))
    ]
    whole = [off(c) for c in cases]
    monkeypatch.setattr(splits, "MAX_BITS", 4_000)
    for sizes, exact in zip(cases, whole, strict=True):
        assert max(off(sizes)) <= max(exact) + 1
