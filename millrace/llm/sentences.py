"""Sentence boundaries across languages and scripts.

Candidate boundaries (end marks, line ends, blanks of scripts without end marks) are judged by
a maximum-entropy classifier over the neighbouring tokens, their case, length, digits and
script. It is trained on boundaries that the layout makes certain: the ends and beginnings of
paragraphs and list entries on one side, end marks before a small letter on the other.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.tables import spread

#: Documents the classifier is fitted on: all of them up to this number, else a sample by hash of the id.
TRAINING_DOCUMENTS = 6_000
#: Labelled candidates used for the fit.
TRAINING_ROWS = 150_000
#: Characters of all texts that it is fitted on, and of the longest of them.
TRAINING_CHARACTERS, LONGEST_TRAINING_TEXT = 30_000_000, 200_000
#: Weight of each of the few examples that stand for what is known beforehand: they decide where labels are few.
PRIOR_WEIGHT = 3.0
#: A token seen this often after or before candidates, but never at a certain boundary, marks certain non-boundaries.
CERTAIN = 15

END = ".!?…؟۔।॥。！？．"
WIDE_END = "。！？．"
CLOSERS = ")]}»”\"'’」』）"
#: Quotations hide what they hold: opening marks and what closes them.
_QUOTES = (("„", "“”"), ("“", "”"), ("«", "»"), ("「", "」"), ("『", "』"), ('"', '"'))
_CLOSING = {opening: (closing, re.compile(f"[{closing}]")) for opening, closing in _QUOTES}
#: Scripts written without blanks between words, by first and last code point.
_CJK = ((0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF))
_SOUTHEAST = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF))


def _class(ranges) -> str:
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges)


_SE, _CJ = _class(_SOUTHEAST), _class(_CJK)
#: Blank lines part paragraphs, whatever the line ends.
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
_LIST_LINE = re.compile(r"(?:^|\n)[^\S\n]*(?:[-*•–·▪]|[0-9]{1,2}\))[^\S\n]+(?=(\S)(\S?))")
#: A capital letter of the scripts that have them, for sentences that follow without a blank.
_CAPITAL = "A-ZÄÖÜÀ-ÞА-ЯЁӘҒҚҢӨҰҮҺІΑ-Ω"
_CANDIDATE = re.compile(
    f"(?P<quote>[{''.join(_CLOSING)}])"
    f"|(?P<mark>(?<![{re.escape(END)}])[{re.escape(END)}]++(?:(?<=[{WIDE_END}।॥؟۔])|(?<=[!?])(?=[^\\W_])"
    f"|(?=[{re.escape(CLOSERS)}]*+(?:\\s|[{_CJ}“「『«]|[{_CAPITAL}])))[{re.escape(CLOSERS)}]*+)"
    f"|(?P<gap>(?<=\\S)[^\\S\\n]+(?=[{_SE}]))"
)
_FLAT = np.arange(0x110000, dtype=np.uint32)
for _c in range(0x30000):
    if chr(_c).isspace():
        _FLAT[_c] = 10 if _c == 10 else 32
    elif chr(_c).isdecimal():
        _FLAT[_c] = 57


def flatten(text: str) -> str:
    """The text with blanks as ' ', line feeds kept and digits as 9; offsets stay the same."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _FLAT[codes].tobytes().decode("utf-32-le", "surrogatepass")


@cache
def _script(c: str) -> str:
    """A rough script of a character: c (CJK), s (Southeast Asian), l, g (cased), n (caseless), 9, q, p."""
    o = ord(c)
    if c == "9":
        return "9"
    if any(a <= o <= b for a, b in _CJK):
        return "c"
    if any(a <= o <= b for a, b in _SOUTHEAST):
        return "s"
    if c.isalpha():
        return "n" if c.lower() == c.upper() else "l" if o < 0x250 else "g"
    return "q" if c in "«“„\"「『'" else "p"


def _left(flat: str, lo: int, at: int) -> str:
    """The last two tokens before at, or the last characters of a run without blanks."""
    lo = max(lo, at - 64)
    q = max(flat.rfind(" ", lo, at), flat.rfind("\n", lo, at), lo - 1)
    p = max(flat.rfind(" ", lo, q), flat.rfind("\n", lo, q), lo - 1) if q > lo else q
    token = flat[q + 1 : at]
    if len(token) > 5 and _script(token.rstrip(END + CLOSERS)[-1:] or "p") in "cs":
        return token[-4:]
    before = flat[p + 1 : q] if q > lo else ""
    return f"{before[-16:]} {token[-24:]}" if before else token[-24:]


def _right(flat: str, at: int, hi: int) -> str:
    """The two tokens that start at at (2 or 5 characters in scripts without blanks)."""
    part = flat[at : min(hi, at + 48)].split(None, 2)
    kind = _script(flat[at])
    token = part[0]
    if kind == "c":
        return token[:2]
    if kind == "s":
        return token[:5]
    return f"{token[:24]} {part[1][:16]}" if len(part) > 1 else token[:24]


#: Capital and small letters that look alike in two scripts, Cyrillic to Latin.
_ALIKE = str.maketrans("АВЕКМНОРСТУХаеорсухі", "ABEKMHOPCTYXaeopcyxi")
_NUMBER = re.compile("9+")


def _plain(token: str) -> str:
    """A token as it is counted: numbers of any length alike, look-alike letters of one script."""
    if "9" in token:
        token = _NUMBER.sub("9", token)
    return token if token.isascii() else token.translate(_ALIKE)


def _in_capitals(left: str, right: str) -> tuple[str, str]:
    """The tokens around a boundary in a text in capitals, as they would be elsewhere."""
    both = left + right
    if both.isupper() and sum(map(str.isalpha, both)) > 4:
        word = _one(right, 0)
        return left.lower(), " ".join([word.capitalize(), *right.lower().split(" ")[1:]])
    return left, right


def _one(pair: str, side: int) -> str:
    """The token of a pair that touches the boundary: the last (-1) or the first (0)."""
    return pair.rsplit(" ", 1)[-1] if side else pair.split(" ", 1)[0]


def _spans(flat: str) -> Iterator[tuple[int, int]]:
    """Paragraphs without outer blanks."""
    at = 0
    for m in _PARAGRAPH.finditer(flat):
        yield at, m.start()
        at = m.end()
    yield at, len(flat)


_MARKERS = "-*•–·▪9"
_UNMARKED = re.compile(f"[{_SE}]")


def _closed(flat: str, a: int, b: int) -> bool:
    """Whether a paragraph's end shows how sentences end: by a mark, or in a script without marks."""
    return flat[b - 1] in END or _UNMARKED.search(flat, max(a, b - 40), b) is not None


def _trim(flat: str, a: int, b: int) -> tuple[int, int]:
    part = flat[a:b]
    return a + len(part) - len(part.lstrip()), b - len(part) + len(part.rstrip())


def _units(flat: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole): paragraphs cut at list lines; a list entry or a heading is whole."""
    for a, b in _spans(flat):
        a, b = _trim(flat, a, b)
        if a >= b:
            continue
        cuts = []
        if "\n" in flat[a:b] or flat[a] in _MARKERS:
            # a numbered entry does not begin with a small letter: that is a wrapped line
            lines = _LIST_LINE.finditer(flat[a:b])
            cuts = [m.start() for m in lines if not m.group(1).islower() or m.group(2).isupper() or ")" not in m.group()]
            cuts = [a + c for c in cuts if c == 0 or cuts[0] == 0 or flat[a + c - 1] in END + CLOSERS + ":;"]
        if not cuts:
            yield a, b, _is_heading(flat[a:b])
            continue
        if cuts[0] > a:
            yield a, cuts[0], False
        for x, y in zip(cuts, [*cuts[1:], b], strict=True):
            x, y = _trim(flat, x, y)
            yield x, y, True


_NUMBERED = re.compile(r"^[^.!?\n]{0,24}9[^.!?\s]{0,12}\.?\s[^.!?\n]{1,60}$")


def _is_heading(text: str) -> bool:
    """A short line with a number and no end mark but the number's own."""
    return len(text) <= 70 and text[-1] not in END + CLOSERS and _NUMBERED.match(text) is not None


def _matches(flat: str, a: int, b: int) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of quotations, end marks and gaps, in linear time: a mark that nothing closes is passed over."""
    last = {opening: max(flat.rfind(c, a, b) for c in closing) for opening, (closing, _) in _CLOSING.items()}
    at = a
    while m := _CANDIDATE.search(flat, at, b):
        at = m.end()
        if m.lastgroup == "quote":
            if last[m.group()] < at:
                continue
            at = _CLOSING[m.group()][1].search(flat, at, b).end()
        yield m.lastgroup, m.start(), at


def candidates(flat: str, a: int, b: int) -> Iterator[tuple[int, int, str, str, bool]]:
    """(end of the left sentence, start of the right one, left token, right token, at a line end)."""
    for kind, first, at in _matches(flat, a, b):
        if kind == "quote":
            # an end mark inside the closing quote may end the sentence, if no clause follows
            if flat[at - 2] not in END or at >= b or flat[at] not in " \n" or flat[at - 1] == "」":
                continue
            nxt = at
            while nxt < b and flat[nxt] in " \n":
                nxt += 1
            if nxt < b and flat[nxt].isupper():
                yield at, nxt, flat[at - 2 : at], _right(flat, nxt, b), "\n" in flat[at:nxt]
            continue
        if kind == "gap":
            left = flat[first - 1]
            if left in END:
                continue
            yield first, at, _left(flat, a, first), _right(flat, at, b), False
            continue
        if flat[first:at] == "．" and flat[first - 1 : first] == "9" == flat[at : at + 1]:
            continue  # a decimal sign
        name = flat[at : at + 1].isupper() and (flat[at + 1 : at + 2].isupper() or flat[at + 1 : at + 2] == ".")
        if name and not flat[max(a, first - 3) : first].islower():
            continue  # no blank and no word before: part of a name
        nxt = at
        while nxt < b and flat[nxt] in " \n":
            nxt += 1
        if nxt < b:
            yield at, nxt, _left(flat, a, at), _right(flat, nxt, b), "\n" in flat[at:nxt]


def _small(word: str) -> bool:
    """Whether a word begins small; pH does not."""
    return word[0].islower() and not word[1:2].isupper()


def _shape(left: str, right: str, line: bool) -> tuple[str, ...]:
    """Features that need no counts."""
    bare = left.rstrip(END + CLOSERS)
    marks = left[len(bare) :].rstrip(CLOSERS)
    mark = "0" if not marks else "e" if len(marks) > 1 and marks[0] == "." or "…" in marks else marks[0]
    kind = _script(right[0])
    case = "l" if _small(right) else "U" if right[0].isalpha() and kind in "lg" else kind
    ls = _script(bare[-1]) if bare else "-"
    size = str(min(len(bare), 4))
    return (f"m{mark}", f"c{case}", f"m{mark}c{case}", f"s{ls}", f"n{size}", f"n{size}c{case}", f"d{'9' in bare}", f"l{line}", f"i{'.' in bare}", f"u{bare[:1].isupper()}")


class BoundaryModel:
    """Maximum-entropy weights over shape features and the tokens' rates at certain boundaries."""

    BUCKETS = (-6.5, -5.0, -4.0, -3.2, -2.5, -1.9, -1.4, -0.9)

    def __init__(self) -> None:
        self.final: dict[str, float] = {}
        self.first: dict[str, float] = {}
        self.weights: dict[str, float] = {}
        self.memo: dict[tuple, bool] = {}

    def _rate(self, table: dict[str, float], token: str) -> str:
        r = table.get(token)
        return "?" if r is None else str(sum(r > x for x in self.BUCKETS))

    def features(self, left: str, right: str, line: bool) -> list[str]:
        shape = _shape(_one(left, -1), _one(right, 0), line)
        left, right = (_plain(t) for t in _in_capitals(left, right))
        l, r = _one(left, -1), _one(right, 0)
        f, s = self._rate(self.final, l), self._rate(self.first, r)
        ff = self._rate(self.final, left) if left != l else f
        ss = self._rate(self.first, right) if right != r else s
        return ["b", f"F{f}", f"S{s}", f"FF{ff}", f"SS{ss}", f"F{f}S{s}", f"FF{ff}SS{ss}", f"S{s}{shape[0]}", f"F{f}{shape[1]}", *shape]

    def fit(self, texts: list[str], l2: float = 1.0, steps: int = 60) -> BoundaryModel:
        """Fit on texts and on what is known beforehand: end marks end sentences, but not before a small letter."""
        final, first, left_all, right_all = Counter(), Counter(), Counter(), Counter()
        seen, certain = Counter(), []

        def count(table: Counter, pair: str, side: int) -> None:
            pair = _plain(pair)
            table[pair] += 1
            if (token := _one(pair, side)) != pair:
                table[token] += 1

        for text in texts:
            flat = flatten(text)
            previous = None
            for a, b, whole in _units(flat):
                words = flat[a:b]
                end = _left(flat, a, b)
                if not whole:
                    start = _right(flat, a, b)
                    count(first, start, 0)
                    count(right_all, start, 0)
                    if previous is not None:
                        certain.append((previous, start))
                previous = None
                if _closed(flat, a, b):
                    count(final, end, -1)
                    count(left_all, end, -1)
                    previous = end
                for m in re.finditer(f"(?<=[ \\n])[^ \\n]|(?<=…)[{_CJ}]", words):
                    count(right_all, _right(flat, a + m.start(), b), 0)
                if not whole:
                    for _, _, l, r, line in candidates(flat, a, b):
                        count(left_all, l, -1)
                        seen[l, r, line] += 1
        rate = lambda hit, n: float(np.log((hit + 0.3) / (n + 3.0)))
        self.final = {t: rate(final[t], n) for t, n in left_all.items() if n >= 3}
        self.first = {t: rate(first[t], n) for t, n in right_all.items() if n >= 3}
        rows: list[tuple[list[str], int, float]] = [(self.features(l, r, False), 1, 1.0) for l, r in certain]
        for (l, r, line), n in seen.items():
            pl, pr = _plain(l), _plain(r)
            ends = [(left_all[t], final[t]) for t in {pl, _one(pl, -1)}]
            starts = [(right_all[t], first[t]) for t in {pr, _one(pr, 0)}]
            never = any(k >= CERTAIN and not hit for k, hit in ends + starts)
            strong = _one(l, -1)[-1:] in "!?。！？।؟"
            if _small(r) or never and not strong:
                rows.append((self.features(l, r, line), 0, float(min(n, 20))))
            elif line and all(hit > 3 for _, hit in ends + starts):
                rows.append((self.features(l, r, True), 1, float(min(n, 20))))
        rows = rows[:: max(1, len(rows) // TRAINING_ROWS)]
        words = {"l": "Word", "g": "Слово", "n": "कखगघ", "c": "漢字"}
        for script, left in words.items():
            for mark in END:
                for right in words.values():
                    rows.append((self.features(left.lower() + mark, right, False), 1, PRIOR_WEIGHT))
                if script in "lg":
                    rows.append((self.features(left.lower() + mark, left.lower(), False), 0, 2 * PRIOR_WEIGHT))
            rows.append((self.features(left.lower(), left, False), 0, PRIOR_WEIGHT))
        index = {f: i for i, f in enumerate(sorted({f for fs, _, _ in rows for f in fs}))}
        width = max(len(fs) for fs, _, _ in rows)
        x = np.full((len(rows), width), len(index))
        for i, (fs, _, _) in enumerate(rows):
            x[i, : len(fs)] = [index[f] for f in fs]
        y, w = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows])
        theta, step = np.zeros(len(index) + 1), np.full(len(index) + 1, 1e-8)
        for _ in range(steps):  # full-batch gradient steps, scaled by what each weight has seen
            p = 1 / (1 + np.exp(-np.clip(theta[x].sum(1), -30, 30)))
            grad = np.bincount(x.ravel(), np.repeat(w * (p - y), width), len(theta)) + l2 * theta
            step += grad * grad
            theta -= 0.5 * grad / np.sqrt(step)
            theta[-1] = 0.0
        self.weights = {f: float(theta[i]) for f, i in index.items()}
        return self

    def score(self, left: str, right: str, line: bool) -> float:
        return sum(self.weights.get(f, 0.0) for f in self.features(left, right, line))

    def is_boundary(self, left: str, right: str, line: bool) -> bool:
        key = (left, right, line)
        known = self.memo.get(key)
        if known is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            known = self.memo[key] = self.score(left, right, line) > 0
        return known

    def split(self, text: str) -> list[tuple[int, int]]:
        """Code point offsets of the sentences of a text."""
        flat = flatten(text)
        out = []
        for a, b, whole in _units(flat):
            if not whole:
                start = a
                for end, nxt, left, right, line in candidates(flat, a, b):
                    if self.is_boundary(left, right, line):
                        out.append((start, end))
                        start = nxt
                a = start
            if a < b:
                out.append((a, b))
        return out


def training_texts(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> list[str]:
    """Texts the classifier is fitted on, the only rows that reach the driver: whole documents chosen by hash of id and text.

    About TRAINING_DOCUMENTS of them, of TRAINING_CHARACTERS characters together, none above
    LONGEST_TRAINING_TEXT; twice as many at most.
    """
    texts = documents.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).filter(f"length(t) BETWEEN 1 AND {LONGEST_TRAINING_TEXT}")
    n, size = texts.agg(F.count("t"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    parts = max(1, n // TRAINING_DOCUMENTS, size // TRAINING_CHARACTERS)
    kept = texts.filter(F.pmod(F.xxhash64("i", F.xxhash64("t")), F.lit(parts)) == 0) if parts > 1 else texts
    rows = kept.orderBy(F.xxhash64("i", F.xxhash64("t")), "t").limit(min(2 * TRAINING_DOCUMENTS, 2 * TRAINING_CHARACTERS // max(1, size // max(1, n)))).collect()
    return sorted(r["t"] for r in rows)


def sentence_spans(documents: DataFrame, model: BoundaryModel | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per sentence: (doc_id, sent_start, sent_end), 0-based code points, end exclusive.

    An empty line always separates; a list entry with its marker and a heading are one
    sentence; nothing inside quotation marks ends a sentence. A missing end mark at the end
    of a paragraph is no matter. Null and blank texts have no rows; copies have their own
    rows; a null doc_id keeps its rows with a null id. Whole texts are read, of any length;
    each document stands alone, so nothing is shuffled. model: a fitted BoundaryModel; by
    default one is fitted on these documents (see training_texts).
    """
    base = spread(documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    model = model or BoundaryModel().fit(training_texts(documents, text, doc_id))
    model.memo = {}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, ends = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t:
                    for a, b in model.split(t):
                        ids.append(i)
                        starts.append(a)
                        ends.append(b)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["doc_id", "sent_start", "sent_end"]
            )

    return base.mapInArrow(cut, "doc_id long, sent_start long, sent_end long")
