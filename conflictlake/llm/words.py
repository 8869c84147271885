"""Words of UTF-8 text as 64-bit hashes, computed for a whole buffer at once.

A word is a maximal run of bytes other than space and ``\\t \\n \\v \\f \\r``, that is
``[^\\x20\\x09-\\x0D]+``; words never span two texts.
"""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
SEGMENT = 1 << 18

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (spreads low-entropy sums over all bits)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, SEGMENT + 1)
        have = np.full(size, _P if kind == "up" else _P_INV, np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size <= SEGMENT + 1:
            _powers[kind] = have
    return have


def _segment(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word of ``raw``; ``cuts`` are positions where words must end."""
    space = IS_SPACE[raw]
    before = np.empty(len(raw), bool)
    before[0], before[1:] = True, space[:-1]
    before[cuts] = True
    start = np.flatnonzero(~space & before)
    after = np.empty(len(raw), bool)
    after[-1], after[:-1] = True, space[1:]
    after[cuts[cuts > 0] - 1] = True
    end = np.flatnonzero(~space & after) + 1
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power("up", len(raw))[:len(raw)], out=total[1:])
    h = (total[end] - total[start]) * _power("down", len(raw))[start]
    return start, end, mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, hash) of every word of the texts ``raw[off[i]:off[i + 1]]``, in order.

    Work arrays are a few times SEGMENT bytes however long the buffer is: it is
    cut at white space or between texts (a longer single word stays whole).
    """
    n, lo, parts = len(raw), 0, []
    cuts_all = np.unique(off[:-1])
    while lo < n:
        hi = min(lo + SEGMENT, n)
        if hi < n:
            back = np.flatnonzero(IS_SPACE[raw[lo:hi]])
            text = cuts_all[np.searchsorted(cuts_all, lo, "right"):np.searchsorted(cuts_all, hi, "right")]
            best = max(lo + int(back[-1]) + 1 if len(back) else lo, int(text[-1]) if len(text) else lo)
            if best == lo:  # one word longer than a segment
                ahead, hi = hi, n
                while ahead < n:
                    found = np.flatnonzero(IS_SPACE[raw[ahead:ahead + SEGMENT]])
                    if len(found):
                        hi = ahead + int(found[0])
                        break
                    ahead += SEGMENT
                nxt = np.searchsorted(cuts_all, lo, "right")
                if nxt < len(cuts_all):
                    hi = min(hi, int(cuts_all[nxt]))
            else:
                hi = best
        cuts = cuts_all[np.searchsorted(cuts_all, lo):np.searchsorted(cuts_all, hi)] - lo
        s, e, h = _segment(raw[lo:hi], cuts)
        parts.append((s + lo, e + lo, h))
        lo = hi
    if not parts:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    s, e, h = (np.concatenate(x) for x in zip(*parts))
    row = np.searchsorted(off, s, "right") - 1
    return row, s, e, h


def runs(h: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """Hash of each run of ``width`` consecutive words (order matters)."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - width + 1, seed, np.uint64)
    for i in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - width + 1 + i])
    return out


def ordered(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stable sorting order, sorted values) of 64-bit numbers.

    Value and place are sorted as one number, which is several times as fast as an
    argsort.  Where both do not fit, the lowest bits of the value are left out, and
    an argsort follows if that has put any two values in the wrong order.
    """
    if len(h) < 2:
        return np.arange(len(h)), h
    least, places = h.min(), (len(h) - 1).bit_length()
    short = max(0, int(h.max() - least).bit_length() + places - 64)
    packed = h - least
    packed >>= np.uint64(short)
    packed <<= np.uint64(places)
    packed |= np.arange(len(h), dtype=np.uint64)
    packed.sort()
    packed &= np.uint64((1 << places) - 1)
    by = packed.view(np.int64)
    values = h[by]
    if short and (values[1:] < values[:-1]).any():
        by = np.argsort(h, kind="stable")
        values = h[by]
    return by, values


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct values, first place of each, number of each place's value)."""
    by, values = ordered(h)
    new = np.ones(len(h), bool)
    new[1:] = values[1:] != values[:-1]
    values, first = values[new], by[new]
    number = np.cumsum(new)
    number -= 1
    where = np.empty(len(h), np.int64)
    where[by] = number
    return values, first, where
