"""Word tokens of many texts at once, as 64-bit hashes, without a Python object per word."""

from __future__ import annotations

import unicodedata

import numpy as np

#: Letters of two scripts that look alike (small letters, Cyrillic to Latin).
LOOKALIKES = dict(zip("авеёзкмнорстухіјѕһԁԛԝ", "abee3kmhopctyxijshdqw", strict=True))
_CJK = ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(folded code point, class) of every code point: 0 separates, 1 word, 2 a word by itself, 3 dropped."""
    fold, kind = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, np.uint8)
    for o in range(0x30000):
        c = chr(o)
        cat = unicodedata.category(c)
        if cat == "Cf":
            kind[o] = 3
        elif cat[0] in "LMN":
            kind[o] = 1
            n = unicodedata.normalize("NFKD", c).lower()
            base = next((x for x in n if unicodedata.category(x)[0] != "M"), n[:1] or c)
            fold[o] = ord(LOOKALIKES.get(base, base))
            if cat[0] == "M" and 0x300 <= o < 0x370:
                kind[o] = 3
    for a, b in _CJK:
        kind[a : b + 1] = 2
    return fold, kind


_FOLD, _KIND = _tables()


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * _MIX
        return h ^ (h >> np.uint64(29))


def token_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens in order, offsets of the texts): text i has tokens offsets[i]:offsets[i + 1].

    Tokens are runs of letters, marks and digits, without case, accents and look-alikes of
    other scripts; characters of scripts without blanks are tokens by themselves (Chinese,
    Japanese). Soft hyphens and other invisible characters are dropped, and a word broken by
    a hyphen at a line end is joined.
    """
    joined = "\n\x00".join(texts)
    codes = np.frombuffer((joined + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _KIND[codes]
    # a hyphen before a line end, between letters, is no separator
    hyphen = np.flatnonzero((codes[:-2] == 45) & ((codes[1:-1] == 10) | (codes[1:-1] == 13)))
    drop = kind == 3
    if len(hyphen):
        nxt = hyphen + 1
        crlf = (codes[nxt] == 13) & (codes[np.minimum(nxt + 1, len(codes) - 1)] == 10)
        after = np.minimum(nxt + 1 + crlf, len(codes) - 1)
        ok = (hyphen > 0) & (kind[hyphen - 1] == 1) & (kind[after] == 1) & ~((codes[hyphen - 1] >= 48) & (codes[hyphen - 1] <= 57))
        hyphen, nxt, crlf = hyphen[ok], nxt[ok], crlf[ok]
        drop[hyphen] = drop[nxt] = True
        drop[nxt[crlf] + 1] = True
    keep = np.flatnonzero(~drop)
    codes, kind = codes[keep], kind[keep]
    word = kind > 0
    start = word.copy()
    start[1:] &= ~(kind[:-1] == 1) | (kind[1:] == 2)
    starts = np.flatnonzero(start)
    ends_of_text = np.flatnonzero(codes == 0)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    number = np.cumsum(start) - 1
    inside = np.flatnonzero(word)
    place = inside - starts[number[inside]]
    with np.errstate(over="ignore"):
        value = _mix(_FOLD[codes[inside]].astype(np.uint64) + np.uint64(1)) * _STEP[place % 64]
        first = np.searchsorted(inside, starts)
        hashes = _mix(np.add.reduceat(value, first))
    offsets = np.concatenate([[0], np.searchsorted(starts, ends_of_text), [len(starts)]])
    return hashes, offsets.astype(np.int64)
