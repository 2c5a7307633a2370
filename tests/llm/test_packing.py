import random
from collections import defaultdict

from millrace.llm import packing
from millrace.llm.packing import best_fit, fill_report
from millrace.llm.queries import VOCABULARY, split_pattern


def fill_containers(docs, kinds, **more):
    return packing.fill_containers(docs, kinds, VOCABULARY, split_pattern(), **more)


def pack_texts(docs, kinds, **more):
    return packing.pack_texts(docs, kinds, VOCABULARY, split_pattern(), **more)


def frames(spark, texts, kinds=(("short", 16), ("long", 64))):
    docs = spark.createDataFrame(texts, "doc_id long, source string, text string").selectExpr("*", "1 AS cluster", "2 AS n_tokens", "3 AS shard")
    return docs, spark.createDataFrame(list(kinds), "container_kind string, capacity_tokens int")


def words(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(["post", "water", "level", "gauge", "река", "су", "水位"]) for _ in range(n))


def test_whole_texts_in_full_containers(spark):
    texts = [(i, f"s{i % 9}", words(4 + i % 12, i)) for i in range(400)]
    texts += [(900, "s1", words(200, 1)), (901, None, None), (902, "s1", ""), (903, "s2", " \n\t "), (None, "s1", "lost"), (904, None, "alone")]
    docs, kinds = frames(spark, texts)
    sizes = {r["doc_id"]: r["n_tokens"] for r in packing.text_sizes(docs, VOCABULARY, split_pattern()).collect()}
    rows = fill_containers(docs, kinds).collect()
    for kind, capacity in (("short", 16), ("long", 64)):
        mine = [r for r in rows if r["container_kind"] == kind]
        by_doc, by_box = defaultdict(list), defaultdict(int)
        for r in mine:
            by_doc[r["doc_id"]].append(r)
            by_box[r["container_id"]] += r["n_tokens"]
        assert set(by_doc) == set(sizes) == {r[0] for r in texts if r[0] not in (None, 901, 902, 903)}
        assert max(by_box.values()) <= capacity
        for d, parts in by_doc.items():
            parts.sort(key=lambda r: r["piece"])
            assert sum(r["n_tokens"] for r in parts) == sizes[d]
            assert [r["first_token"] for r in parts] == [sum(p["n_tokens"] for p in parts[:k]) for k in range(len(parts))]
            assert len(parts) == 1 or sizes[d] > capacity
        assert sum(by_box.values()) / (capacity * len(by_box)) > 0.9
    assert {r["container_kind"]: r["containers"] for r in fill_report(pack_texts(docs, kinds), kinds).collect()}.keys() == {"short", "long"}


def test_copies_never_share_a_container(spark):
    texts = [(i, "a", "The same  TEXT again." if i % 3 == 0 else words(4, i)) for i in range(90)]
    docs, kinds = frames(spark, texts)
    boxes = defaultdict(list)
    for r in fill_containers(docs, kinds).collect():
        if r["doc_id"] % 3 == 0:
            boxes[r["container_kind"], r["container_id"]].append(r["doc_id"])
    assert all(len(v) == 1 for v in boxes.values())


def test_search_goes_on_to_the_tightest_compatible():
    sizes, clusters, sources = [60, 50, 30, 30], [1, 2, 2, 3], ["a", "b", "c", "d"]
    where, n = best_fit(sizes, 100, clusters, sources)
    assert n == 2
    assert where[0] != where[1]
    assert where[2] == where[0]  # 50 is tighter for it only in the container of its copy
    assert where[3] == where[1]


def test_sources_are_held_apart_where_it_costs_nothing():
    where, n = best_fit([50, 50, 50, 50, 20, 20, 20, 20], 100, list(range(8)), ["a", "b", "c", "d", "e", "f", "g", "h"])
    assert n == 3
    where, n = best_fit([40] * 12, 100, list(range(12)), [f"s{i % 6}" for i in range(12)])
    assert n == 6
    assert all(where.count(b) == 2 for b in set(where))


def test_sources_as_a_hard_rule(spark):
    texts = [(i, f"s{i % 5}", words(4 + i % 12, i)) for i in range(300)] + [(900, "s1", words(200, 1)), (901, None, words(3, 2)), (902, None, words(3, 3))]
    docs, kinds = frames(spark, texts)
    hard, soft = ({r["container_kind"]: r for r in fill_report(pack_texts(docs, kinds, strict=strict), kinds).collect()} for strict in (True, False))
    assert all(r["source_twice"] == 0 and r["copies"] == 0 for r in hard.values())
    assert soft["long"]["source_twice"] > 0
    assert soft["long"]["containers"] < hard["long"]["containers"]
    for strict in (True, False):
        for r in packing.packing_faults(pack_texts(docs, kinds, strict=strict), kinds).collect():
            assert tuple(r)[1:] == (303, 0, 0, 0)


def test_empty(spark):
    docs, kinds = frames(spark, [])
    assert fill_containers(docs, kinds).count() == 0
    docs, _ = frames(spark, [(1, "a", "x")])
    assert fill_containers(docs, kinds.filter("capacity_tokens < 0")).count() == 0
    assert best_fit([], 10, [], []) == ([], 0)
    long = spark.createDataFrame([(1, "a", "water " * 200_000)], "doc_id long, source string, text string")
    assert fill_containers(long, kinds).filter("container_kind = 'long'").selectExpr("sum(n_tokens)").first()[0] >= 200_000
