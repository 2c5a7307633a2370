"""Evaluation passages inside training documents, found with spaced seeds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.sentences import END
from millrace.llm.tokens import token_hashes
from millrace.sources.scratch import write_cut
from millrace.sources.tables import spread

#: Fixed masks over token positions: 1 counts, 0 is ignored. All have weight 5.
MASKS = ("11111", "1101011", "111001001", "100110101")
#: Items of fewer than SHORT tokens, half of which may be too few for those, have lighter masks besides, of weight 3.
SHORT, LIGHT_MASKS = 16, ("111", "1101", "1011")
#: Share of an item's tokens that a document must hold, in order and in one place.
HELD = 0.5
#: Local agreement around a hit: of NEAR tokens on one diagonal at least NEAR_EQUAL agree.
NEAR, NEAR_EQUAL = 5, 3
#: A place is at most this many times the item's tokens long (foreign sentences in between).
PLACE = 3.0
#: Score that a step to another part of the document costs when segments are chained.
JUMP = 7
#: A stock phrase: a segment of up to STOCK tokens, none of them rare (in over RARE of the items) and less than two numbers; no step leads to or from it.
STOCK, RARE = 16, 0.01
#: Stock phrases that together are at least this share of the item are the item.
WHOLE = 0.9
#: Diagonals this far apart are one stretch of text with words inserted or lost.
DRIFT = 6
#: An opening sentence that at least this many items share is an instruction.
SHARED_OPENINGS = 2
#: Seeds of evaluation items that the tasks hold (a checked bound); of more items the seeds are joined by hash in a shuffle.
INDEX_SEEDS = 4_000_000
#: Candidate items of one document that are verified together.
ITEMS_AT_ONCE = 256
#: Characters worked on at once.
CHARACTERS = 1_000_000
#: Tokens compared at once when agreement on the diagonals is counted.
CELLS = 4_000_000
#: Bits of the hash that the filter of item seeds knows.
FILTER_BITS, SMALL_FILTER_BITS = 22, 12


@cache
def _numbers() -> np.ndarray:
    """Hashes of the tokens that are whole numbers up to four digits."""
    return np.unique(token_hashes([" ".join(f"{n} 0{n}" for n in range(10_000))])[0])


def opening(column: str) -> str:
    """SQL for the first sentence of a text, up to its end mark; not after a word of up to 4 letters and a full stop."""
    marks = "".join(c if c not in "." else "\\\\." for c in END)
    found = f"regexp_extract({column}, '^\\\\s*([^{marks}]{{8,200}}[{marks}])', 1)"
    return f"IF({found} RLIKE '(^|[^\\\\p{{L}}])\\\\p{{L}}{{1,4}}[.]$', '', {found})"


class SeedIndex:
    """Spaced seeds of a block of items, sorted by hash. rare: hashes of each item's rare tokens, as signed numbers."""

    def __init__(self, ids: list[int], texts: list[str], rare: list[list[int]] | None = None, bits: int = FILTER_BITS) -> None:
        self.ids = np.array(ids, np.int64)
        self.tokens, self.offsets = token_hashes(texts)
        few = np.array([h for of_item in rare or [] for h in of_item], np.int64).view(np.uint64)
        # how much a token tells: two for a rare one, one for a number
        self.telling = np.where(np.isin(self.tokens, few), 2, np.isin(self.tokens, _numbers()).astype(np.int64))
        hashes, items, places = [], [], []
        self.masks = []
        for k, mask, h, at, text in item_seeds(self.tokens, self.offsets):
            self.masks.append((k, mask))
            hashes.append(h)
            items.append(text)
            places.append(at - self.offsets[text])
        none = (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
        h, item, place = (np.concatenate(x) if x else n for x, n in zip((hashes, items, places), none, strict=True))
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.place = h[order], item[order], place[order]
        self.keys, self.first = np.unique(self.hash, return_index=True)
        self.count = np.diff(np.append(self.first, len(self.hash)))
        self.bits = np.uint64(64 - bits)
        self.filter = np.zeros(1 << bits, bool)
        self.filter[(self.keys >> self.bits).astype(np.int64)] = True


def seeds(tokens: np.ndarray, offsets: np.ndarray, k: int, mask: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first token, text) of every placement of a mask that fits into one text."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = np.full(n, 1 + k, np.uint64)
    with np.errstate(over="ignore"):
        for i, bit in enumerate(mask):
            if bit == "1":
                h = (h ^ tokens[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(32)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    fits = np.flatnonzero(text[:n] == text[len(mask) - 1 : len(mask) - 1 + n])
    return h[fits], fits, text[fits]


def item_seeds(tokens: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, str, np.ndarray, np.ndarray, np.ndarray]]:
    """(number, mask, hash, first token, item) of every mask that has seeds; the light ones only of short items."""
    short = np.diff(offsets) < SHORT
    for k, mask in enumerate(MASKS + LIGHT_MASKS):
        h, at, text = seeds(tokens, offsets, k, mask)
        if mask in LIGHT_MASKS:
            h, at, text = (x[short[text]] for x in (h, at, text))
        if len(h):
            yield k, mask, h, at, text


def held_tokens(item: np.ndarray, doc: np.ndarray, diagonals: np.ndarray, telling: np.ndarray) -> int:
    """Item tokens that the document holds in one place and in order, around hits on the diagonals.

    On each diagonal (document minus item position) tokens that agree amid agreeing ones
    form segments. Segments are chained in the order of both texts within one place; a
    step to another part of the document costs JUMP tokens of score, a shift by inserted or
    lost words one, and stock phrases (see STOCK) are left out of such steps, so they do not
    add up however many a document holds, unless they make up WHOLE of the item. telling: 2 for the item's rare tokens, 1 for
    numbers, else 0. Returns the tokens of the best chain, or of the best diagonal if more.
    """
    n = len(item)
    spot = diagonals[:, None] + np.arange(n)
    equal = (spot >= 0) & (spot < len(doc))
    equal &= doc[np.clip(spot, 0, len(doc) - 1)] == item
    # no chain can take an item token that agrees nowhere
    union = int(np.count_nonzero(equal.any(0)))
    if union < HELD * n:
        return int(np.count_nonzero(equal, 1).max())
    along = np.zeros((len(diagonals), n + 1), np.int64)
    np.cumsum(equal, 1, out=along[:, 1:])
    k = np.arange(n)
    near = along[:, np.minimum(k + NEAR // 2 + 1, n)] - along[:, np.maximum(k - NEAR // 2, 0)]
    row, at = np.nonzero(equal & (near >= NEAR_EQUAL))
    # all of one diagonal is in order and in one place, however scattered
    best, whole = int(along[:, n].max()), union >= WHOLE * n
    if not len(row):
        return best
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (at[1:] - at[:-1] > NEAR)])
    last = np.append(first[1:], len(row)) - 1
    # between its first and last agreement amid others, every agreement on the diagonal counts
    size = along[row[first], at[last] + 1] - along[row[first], at[first]]
    firm = (np.add.reduceat(telling[at], first) > 1) | (size > STOCK)
    segments = sorted(zip(diagonals[row[first]].tolist(), at[first].tolist(), at[last].tolist(), size.tolist(), firm.tolist(), strict=True))
    # a chain lies within reach of its first diagonal: two such ranges at a time hold every chain
    reach = int(PLACE * n + 20)
    a = 0
    while a < len(segments) and best < n:
        edge = segments[a][0] + reach
        b = a
        while b < len(segments) and segments[b][0] < edge + reach:
            b += 1
        best = max(best, _best_chain([(i, j, d, m, f) for d, i, j, m, f in segments[a:b]], reach))
        if whole and best < WHOLE * n:
            total = _best_chain([(i, j, d, m, True) for d, i, j, m, _ in segments[a:b]], reach)
            best = total if total >= WHOLE * n else best
        while a < len(segments) and segments[a][0] < edge:
            a += 1
    return best if best >= HELD * n else max(best, _in_a_stretch(equal, along[:, n], diagonals, telling))


def _in_a_stretch(equal: np.ndarray, agree: np.ndarray, diagonals: np.ndarray, telling: np.ndarray) -> int:
    """Most item tokens, in order, that one stretch of text holds on diagonals within DRIFT of each other.

    Between many insertions agreeing tokens stand too far apart for segments. Here each
    counts, and every step to another diagonal costs one. Tokens that tell as little as a
    stock phrase are none of it.
    """
    n, best = equal.shape[1], 0
    total = np.r_[0, np.cumsum(agree)]
    ends = np.searchsorted(diagonals, diagonals + DRIFT, side="right")
    # windows that agree often enough and are no part of the one before
    for a in np.flatnonzero((total[ends] - total[:-1] >= HELD * n) & np.r_[True, ends[1:] > ends[:-1]]):
        b = int(ends[a])
        there = np.any(equal[a:b], 0)
        if int(there.sum()) < max(HELD * n, best + 1) or telling[there].sum() < 2:
            continue
        d = diagonals[a:b]
        # after tokens 0..i: the most held by a way that ends on each diagonal; a step back by k skips k item tokens
        held = np.zeros((n + DRIFT + 1, len(d)), np.int64)
        back = np.maximum(0, d[:, None] - d[None, :])
        for i in range(n):
            before = held[i + DRIFT - back, np.arange(len(d))[:, None]] - (d[:, None] != d[None, :])
            held[i + DRIFT + 1] = before.max(0) + equal[a:b, i]
        best = max(best, int(held[-1].max()))
    return best


def _best_chain(segments: list[tuple[int, int, int, int, bool]], reach: int) -> int:
    """Tokens of the chain with the highest score: segments are (first, last, diagonal, tokens, firm)."""
    segments.sort()
    score, held, start = [], [], []
    for k, (i, j, d, m, firm_k) in enumerate(segments):
        best, tokens, origin = m, m, d
        for q in range(k):
            qi, qj, qd, _, firm_q = segments[q]
            if qi >= i or qj >= j or d < qd - 3 or d - start[q] > reach:
                continue
            if abs(d - qd) > 3 and not (firm_k and firm_q):
                continue
            overlap = max(0, qj - i + 1, qj + qd - i - d + 1)
            gain = score[q] + m - overlap - (1 if abs(d - qd) <= 3 else JUMP)
            if gain > best:
                best, tokens, origin = gain, held[q] + m - overlap, start[q]
        score.append(best)
        held.append(tokens)
        start.append(origin)
    return held[max(range(len(score)), key=score.__getitem__)]


def leaks_in(index: SeedIndex, texts: list[str]) -> list[tuple[int, int, float]]:
    """(text number, item id, share held) of every text that holds at least HELD of an item."""
    tokens, offsets = token_hashes(texts)
    docs, items, dpos, ipos = [], [], [], []
    for k, mask in index.masks:
        h, at, text = seeds(tokens, offsets, k, mask)
        maybe = np.flatnonzero(index.filter[(h >> index.bits).astype(np.int64)])
        if not len(maybe):
            continue
        spot = np.minimum(np.searchsorted(index.keys, h[maybe]), len(index.keys) - 1)
        hit = index.keys[spot] == h[maybe]
        maybe, spot = maybe[hit], spot[hit]
        count = index.count[spot]
        rows = np.repeat(np.arange(len(maybe)), count)
        seed = index.first[spot][rows] + np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
        docs.append(text[maybe][rows])
        dpos.append(at[maybe][rows] - offsets[text[maybe][rows]])
        items.append(index.item[seed])
        ipos.append(index.place[seed])
    if not docs:
        return []
    doc, item, d, i = (np.concatenate(x) for x in (docs, items, dpos, ipos))
    if not len(doc):
        return []
    pair, diagonal = doc.astype(np.int64) * len(index.ids) + item, d - i
    order = np.lexsort((diagonal, pair))
    pair, diagonal = pair[order], diagonal[order]
    once = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (diagonal[1:] != diagonal[:-1])])
    pair, diagonal = pair[once], diagonal[once]
    starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    ends = np.append(starts[1:], len(pair))
    agree = np.add.reduceat(_agreeing(index, tokens, offsets, pair, diagonal), starts)
    size = np.diff(index.offsets)[pair[starts] % len(index.ids)]
    out = []
    # what is held lies on the diagonals of the hits, so no other pair can hold enough
    for g in np.flatnonzero(agree >= HELD * size):
        a, b = starts[g], ends[g]
        t, e = divmod(int(pair[a]), len(index.ids))
        words = index.tokens[index.offsets[e] : index.offsets[e + 1]]
        held = held_tokens(words, tokens[offsets[t] : offsets[t + 1]], diagonal[a:b], index.telling[index.offsets[e] : index.offsets[e + 1]])
        if held >= HELD * len(words):
            out.append((t, int(index.ids[e]), held / len(words)))
    return out


def _agreeing(index: SeedIndex, tokens: np.ndarray, offsets: np.ndarray, pair: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    """Tokens that agree on each diagonal of a pair: at least what a chain can take from it."""
    t, e = np.divmod(pair, len(index.ids))
    low = np.maximum(0, -diagonal)
    length = np.minimum(np.diff(index.offsets)[e], np.diff(offsets)[t] - diagonal) - low
    a, b = index.offsets[e] + low, offsets[t] + diagonal + low
    # half the hash is enough for a bound
    left, right = index.tokens.astype(np.uint32), tokens.astype(np.uint32)
    total = np.cumsum(length)
    out = np.empty(len(pair), np.int64)
    x = 0
    while x < len(pair):
        y = max(x + 1, int(np.searchsorted(total, total[x] - length[x] + CELLS)))
        size = length[x:y]
        first = np.cumsum(size) - size
        cell = np.arange(int(size.sum()))
        same = left[np.repeat(a[x:y] - first, size) + cell] == right[np.repeat(b[x:y] - first, size) + cell]
        out[x:y] = np.add.reduceat(same, first, dtype=np.int64)
        x = y
    return out


def _pieces(texts: list[str | None]) -> Iterator[list[int]]:
    """Numbers of texts in groups of about CHARACTERS characters."""
    group, size = [], 0
    for n, t in enumerate(texts):
        if not t:
            continue
        group.append(n)
        size += len(t)
        if size >= CHARACTERS:
            yield group
            group, size = [], 0
    if group:
        yield group


def leaked_items(documents: DataFrame, items: DataFrame, text: str = "text", item_text: str = "item_text") -> DataFrame:
    """Documents that hold evaluation items, wholly or in part: (doc_id, item_id, held).

    held is the share of the item's tokens (characters in Chinese and Japanese) that the
    document holds in their order and in one place, at least HELD; substituted words and
    foreign sentences in between are tolerated. An opening sentence shared by at least
    SHARED_OPENINGS items is an instruction and counts for neither side.

    Training and item seeds are joined by hash, in one scan of the documents. Up to
    INDEX_SEEDS the item seeds are sent to the tasks and joined there; more are joined in a
    shuffle (see _candidates). Both give the same rows. Copies each have their rows, and a document without an id has rows
    with a null id. Null and blank texts and items, items without an id and those with fewer
    tokens than the shortest mask (3) hold nothing. Repeated item ids count once per text.
    """
    pool = items.select(F.col("item_id").cast("long").alias("item_id"), F.col(item_text).alias("t"))
    pool = pool.filter("item_id IS NOT NULL AND trim(t) <> ''").withColumn("o", F.lower(F.expr(opening("t"))))
    shared = pool.filter("o <> ''").groupBy("o").agg(F.countDistinct("item_id").alias("n")).filter(F.col("n") >= SHARED_OPENINGS)
    # an opening that is most of its item is the passage itself
    cut = "n IS NOT NULL AND 2 * length(o) < length(t)"
    pool = pool.join(shared, "o", "left").withColumn("t", F.expr(f"IF({cut}, substring(ltrim(t), length(o) + 1), t)")).select("item_id", "t")
    # few rows, read several times
    pool = write_cut(pool.join(rare_tokens(pool), "item_id", "left").select("item_id", "t", "rare"), "items", size="sum(length(t))")
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    base = spread(base.filter("text IS NOT NULL"))
    if not pool.seen["size"]:
        return base.sparkSession.createDataFrame([], _FOUND)
    if len(MASKS) * pool.seen["size"] > INDEX_SEEDS:
        return _candidates(base, pool.df).mapInArrow(_verify, _FOUND)
    rows = pool.df.orderBy("item_id", "t").collect()
    index = SeedIndex([r[0] for r in rows], [r[1] for r in rows], [r[2] or [] for r in rows])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for group in _pieces(texts):
                yield _found([(ids[group[t]], e, s) for t, e, s in leaks_in(index, [texts[n] for n in group])])

    return base.mapInArrow(search, _FOUND)


_FOUND = "doc_id long, item_id long, held double"


def _found(rows: list[tuple[int | None, int, float]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((), (), ())
    types = (pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "item_id", "held"])


def _seed_rows(owner: np.ndarray, hashes: np.ndarray, name: str) -> pa.RecordBatch:
    """Each seed once by owner."""
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    once = np.r_[True, (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])] if len(owner) else np.zeros(0, bool)
    return pa.RecordBatch.from_arrays([pa.array(hashes[once].view(np.int64)), pa.array(owner[once], pa.int64())], ["seed", name])


def _candidates(base: DataFrame, pool: DataFrame) -> DataFrame:
    """(doc_id, text, items) of the documents that share a seed with items, at most about ITEMS_AT_ONCE items a row.

    A filter of fixed size, of the first FILTER_BITS bits of the items' seeds, is all that is
    sent to the tasks. The seeds of documents that pass it are joined with those of the items
    by hash; a seed that a third of the documents hold is split by adaptive skew handling.
    """

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, offsets = token_hashes(batch.column(1).to_pylist())
            ids = batch.column(0).to_numpy()
            for _, _, h, _, text in item_seeds(tokens, offsets):
                yield _seed_rows(ids[text], h, "item_id")

    wanted = write_cut(pool.mapInArrow(of_items, "seed long, item_id long").distinct(), "seeds").df
    place = F.shiftrightunsigned("seed", 64 - FILTER_BITS)
    words = wanted.groupBy(F.shiftright(place, 6).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, CAST(shiftrightunsigned(seed, {64 - FILTER_BITS}) & 63 AS int)))").alias("bits"))
    known = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for word, bits in words.collect():  # at most 2 ** (FILTER_BITS - 6) rows
        known[word] = bits
    passes = np.unpackbits(known.view(np.uint8), bitorder="little").astype(bool)

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for group in _pieces(texts):
                tokens, offsets = token_hashes([texts[n] for n in group])
                for k, mask in enumerate(MASKS + LIGHT_MASKS):
                    h, _, text = seeds(tokens, offsets, k, mask)
                    kept = np.flatnonzero(passes[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
                    yield _seed_rows(keys[group][text[kept]], h[kept], "key")

    # by hash of the text: copies have their candidates in common, and no document needs an id
    keyed = base.withColumn("key", F.xxhash64("text"))
    pairs = keyed.select("key", "text").mapInArrow(of_texts, "seed long, key long").join(wanted, "seed").select("key", "item_id").distinct()
    sizes = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.pmod(F.xxhash64("item_id"), F.greatest(F.lit(1), F.ceil(F.col("n") / ITEMS_AT_ONCE)))
    rows = pairs.join(sizes, "key").withColumn("block", blocks).join(pool, "item_id")
    rows = rows.groupBy("key", "block").agg(F.collect_list(F.struct("item_id", "t", "rare")).alias("items"))
    return keyed.join(rows, "key").select("doc_id", "text", "items")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, text, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            items.sort(key=lambda r: (r["item_id"], r["t"]))
            index = SeedIndex([r["item_id"] for r in items], [r["t"] for r in items], [r["rare"] or [] for r in items], SMALL_FILTER_BITS)
            yield _found([(doc, e, s) for _, e, s in leaks_in(index, [text])])


def rare_tokens(items: DataFrame) -> DataFrame:
    """(item_id, rare): hashes of the tokens of each item (item_id, t) that few of all items hold, as signed numbers."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, offsets = token_hashes(batch.column(1).to_pylist())
            owner = np.repeat(batch.column(0).to_numpy(), np.diff(offsets))
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(hashes.view(np.int64))], ["item_id", "token"])

    each = items.mapInArrow(tokens, "item_id long, token long").distinct()
    limit = items.agg(F.greatest(F.lit(2.0), RARE * F.countDistinct("item_id"))).scalar()
    few = each.groupBy("token").count().filter(F.col("count") <= limit).select("token")
    return each.join(few, "token").groupBy("item_id").agg(F.collect_list("token").alias("rare"))
