import random

import pytest

import numpy as np

from millrace.llm.leaks import SeedIndex, held_tokens, leaked_items
from millrace.llm.tokens import token_hashes

R = random.Random(5)
VOCABULARY = ["".join(R.choice("abcdefghijklmnoprstuvw") for _ in range(R.randrange(3, 9))) for _ in range(4000)]


def words(n, seed):
    r = random.Random(seed)
    return [r.choice(VOCABULARY) for _ in range(n)]


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "'x' AS held", "'y' AS t")
    i = spark.createDataFrame(items, "item_id long, item_text string").selectExpr("*", "1 AS doc_id", "'z' AS o")
    return {(r["doc_id"], r["item_id"]) for r in leaked_items(d, i).collect()}


def test_whole_partial_changed_interrupted(spark):
    item = words(60, 1)
    filler = lambda s: " ".join(words(200, s))
    changed = [w if k % 7 else "zzz" for k, w in enumerate(item)]
    dropped = [w for k, w in enumerate(item) if k % 11]
    text = " ".join
    docs = [
        (1, filler(11) + " " + text(item) + " " + filler(12)),
        (2, filler(13) + " " + text(item[:36]) + " " + filler(14)),
        (3, filler(15) + " " + text(item[:12])),
        (4, text(changed).upper()),
        (5, text(item[:20]) + ". " + text(words(30, 16)) + ". " + text(item[20:40]) + ". " + text(words(25, 17)) + " " + text(item[40:])),
        (6, text(dropped)),
        (7, text(item).replace("a", "а").replace("e", "е")),  # look-alikes
        (8, "­".join(text(item))),
        (9, text(sorted(item))),
        (10, filler(18)),
        (11, None),
        (12, ""),
        (13, text(item)),
        (None, text(item)),
    ]
    found = run(spark, docs, [(100, text(item)), (101, None), (102, " "), (103, "two words"), (None, text(item)), (100, text(item))])
    assert found == {(n, 100) for n in (1, 2, 4, 5, 6, 7, 8, 13, None)}


def test_chinese_counts_characters(spark):
    item = "桥头摄像机质疑水位二三九厘米，地点在红水河断面。按规程，巡检车司机剔除了流量七〇立方米每秒，误差不超过八点五。"
    docs = [(1, "本通报由系统自动生成。" + item[:34] + "以下略。"), (2, "本通报由系统自动生成。" + item[:12]), (3, "\n".join(item[i : i + 9] for i in range(0, len(item), 9)))]
    assert run(spark, docs, [(7, item)]) == {(1, 7), (3, 7)}


def test_shared_instruction_does_not_count(spark):
    items = [(n, "Read the passage and answer the question carefully. " + " ".join(words(12, 50 + n))) for n in range(4)]
    docs = [(1, "Read the passage and answer the question carefully. " + " ".join(words(40, 99))), (2, items[2][1])]
    assert run(spark, docs, items) == {(2, 2)}


def test_empty_tables_and_several_passes(spark, monkeypatch):
    from millrace.llm import leaks

    assert run(spark, [], []) == set()
    assert run(spark, [(1, "x")], []) == set()
    items = [(n, " ".join(words(30, 200 + n))) for n in range(6)]
    docs = [(n, items[n][1]) for n in range(6)] + [(77, " ".join(t for _, t in items))]
    want = {(n, n) for n in range(6)} | {(77, n) for n in range(6)}
    assert run(spark, docs, items) == want
    monkeypatch.setattr(leaks, "INDEX_SEEDS", 1500)
    assert run(spark, docs, items) == want


@pytest.mark.parametrize(("rate", "inserted"), [(0.1, 0.0), (0.2, 0.0), (0.3, 0.0), (0.4, 0.0), (0.2, 0.03), (0.3, 0.03)])
def test_substituted_and_inserted_words(spark, rate, inserted):
    """Of 120 items with those shares of words replaced and inserted at random, at least 0.9 of those half held are found, and no others."""
    r = random.Random(int(rate * 10))
    stock = words(4000, 800)
    weights = [1 / (k + 1) for k in range(4000)]
    some = lambda n: r.choices(stock, weights, k=n)
    items, docs, held = [], [], set()
    for n in range(120):
        item = some(60)
        changed = [some(1)[0] if r.random() < rate else w for w in item]
        items.append((n, " ".join(item)))
        between = [x for w in changed for x in ([*some(1), w] if r.random() < inserted else [w])]
        docs.append((n, " ".join(some(80) + between + some(80))))
        if 2 * sum(a == b for a, b in zip(item, changed, strict=True)) >= len(item):
            held.add((n, n))
    got = run(spark, docs, items)
    assert len(got & held) >= 0.9 * len(held)
    assert got <= {(n, n) for n in range(120)}


def test_both_joins_give_the_same_rows_on_the_tables(spark, small, monkeypatch):
    from millrace.llm import leaks, queries

    rows = lambda: sorted(map(tuple, queries.p7_found(spark, small).collect()))
    whole = rows()
    monkeypatch.setattr(leaks, "INDEX_SEEDS", 1000)
    assert rows() == whole
    assert whole


def test_long_text(spark):
    item = " ".join(words(40, 300))
    long = " ".join(words(300_000, 301))
    assert run(spark, [(1, long + " " + item), (2, long)], [(5, item)]) == {(1, 5)}


def test_tokens():
    h, o = token_hashes(["Ab c-1", "ab C 1", "", "水位", "Камы-\nстин", "камыстин"])
    parts = [h[a:b].tolist() for a, b in zip(o, o[1:], strict=False)]
    assert parts[0] == parts[1]
    assert parts[2] == []
    assert len(parts[3]) == 2
    assert parts[4] == parts[5]
    assert len(parts[5]) == 1
    assert token_hashes([])[0].size == 0


def test_held_tokens_is_in_order_and_in_one_place():
    item = np.arange(40, dtype=np.uint64)
    far = np.arange(10_000, 10_400, dtype=np.uint64)
    apart = np.concatenate([item[:15], far, item[15:]])
    assert held_tokens(item, apart, np.array([0, 400]), np.full(40, 2)) == 25
    swapped = np.concatenate([item[20:], item[:20]])
    assert held_tokens(item, swapped, np.array([-20, 20]), np.full(40, 2)) == 20
    assert SeedIndex([1], ["too short"]).keys.size == 0


def test_stock_phrases_do_not_add_up():
    item = np.arange(40, dtype=np.uint64)
    far = np.arange(10_000, 10_060, dtype=np.uint64)
    scattered = np.concatenate([item[:12], far, item[12:24], far, item[24:34]])
    diagonals = np.array([0, 60, 120])
    assert held_tokens(item, scattered, diagonals, np.zeros(40, int)) == 12
    assert held_tokens(item, scattered, diagonals, np.ones(40, int)) > 30


def test_a_passage_many_times_over(spark):
    item = " ".join(words(50, 400))
    assert run(spark, [(1, (item + " ") * 4000), (2, "water " * 200_000)], [(9, item), (10, "water " * 40)]) == {(1, 9), (2, 10)}


def test_half_of_a_short_item_and_scattered_words(spark):
    text = " ".join
    filler = lambda s: text(words(100, s))
    items = [words(n, 500 + n) for n in (5, 6, 9, 10, 12)]
    docs = [(len(w), filler(600 + len(w)) + " " + text(w[: (len(w) + 1) // 2]) + " " + filler(620 + len(w))) for w in items]
    docs.append((1, filler(640) + " " + text(items[4][3:7])))
    long = words(60, 650)
    kept = [set(random.Random(660 + n).sample(range(60), 36)) for n in range(12)]
    docs += [(100 + n, text(w if k in s else f"zz{k}" for k, w in enumerate(long))) for n, s in enumerate(kept)]
    want = {(len(w), len(w)) for w in items} | {(100 + n, 60) for n in range(12)}
    assert run(spark, docs, [(len(w), text(w)) for w in [*items, long]]) == want


def test_ordinary_sentences_whatever_the_passes(spark, monkeypatch):
    from millrace.llm import leaks

    common = words(40, 700)
    items = [random.Random(710 + n).sample(common, 40) for n in range(6)]
    text = " ".join
    apart = lambda w: ". ".join(text(w[k : k + 10]) + ". " + text(words(25, 720 + k)) for k in range(0, len(w), 10))
    docs = [(1, apart(items[0])), (2, apart(items[1][:30]))]
    given = [(n, text(w)) for n, w in enumerate(items)]
    assert run(spark, docs, given) == {(1, 0)}
    monkeypatch.setattr(leaks, "INDEX_SEEDS", 500)
    assert run(spark, docs, given) == {(1, 0)}
