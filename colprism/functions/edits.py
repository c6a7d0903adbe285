"""Edit distances of many pairs of texts at once, for Arrow tasks."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

_WORD = 64
_PAIRS = 1 << 15
_CELLS = 1 << 22


def _coded(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points by text x place, zeros behind the shorter; lengths)."""
    each = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    size = np.array([len(e) for e in each], np.int64)
    table = np.zeros((len(each), int(size.max(initial=0))), np.uint32)
    table[np.arange(table.shape[1]) < size[:, None]] = np.concatenate([*each, np.zeros(0, np.uint32)])
    return table, size


def edit_distances(a: Sequence[str], b: Sequence[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Levenshtein distances, in code points, of the pairs a[i], b[j]."""
    if len(i) > len(a) * len(b):
        every = np.indices((len(a), len(b))).reshape(2, -1)
        return edit_distances(a, b, *every).reshape(len(a), len(b))[i, j]
    out = np.zeros(len(i), np.int64)
    if not len(i):
        return out
    (ta, na), (tb, nb) = _coded(a), _coded(b)
    short = na[i] <= _WORD
    _in_words(ta, na, tb, nb, i, j, np.flatnonzero(short), out)
    for at in np.flatnonzero(~short):
        out[at] = _by_table(ta[i[at], : na[i[at]]], tb[j[at], : nb[j[at]]])
    return out


def _in_words(ta, na, tb, nb, i, j, pairs, out) -> None:
    """Bit-parallel (Myers, Hyyro): a column of the table is one word, for first texts of up to 64 characters."""
    letters, codes = np.unique(ta, return_inverse=True)
    codes = codes.reshape(ta.shape)
    place = np.minimum(np.searchsorted(letters, tb), max(len(letters) - 1, 0))
    # The last number is that of all characters that no first text has.
    other = np.where(letters[place] == tb, place, len(letters)) if len(letters) else np.zeros(tb.shape, np.int64)
    step = max(1, _CELLS // (len(letters) + 1))
    first = i[pairs]
    for lo in range(0, len(ta), step):
        some = np.arange(lo, min(lo + step, len(ta)))
        bits = np.zeros((len(some), len(letters) + 1), np.uint64)
        for p in range(min(ta.shape[1], _WORD)):
            has = np.flatnonzero(na[some] > p)
            bits[has, codes[some[has], p]] |= np.uint64(1 << p)
        here = pairs if step >= len(ta) else pairs[(first >= lo) & (first < lo + step)]
        here = here[np.argsort(-nb[j[here]], kind="stable")]  # longest second texts first
        for at in range(0, len(here), _PAIRS):
            which = here[at : at + _PAIRS]
            out[which] = _scores(bits, i[which] - lo, na[i[which]], other, j[which], nb[j[which]])


def _scores(bits, x, nx, other, y, ny) -> np.ndarray:
    one = np.uint64(1)
    last = np.where(nx > 0, one << np.maximum(nx - 1, 0).astype(np.uint64), np.uint64(0))
    score = nx.copy()
    up, down = np.full(len(x), ~np.uint64(0)), np.zeros(len(x), np.uint64)
    for t in range(int(ny[0]) if len(ny) else 0):
        n = int(np.searchsorted(-ny, -t, side="left"))  # longer than t
        up, down = up[:n], down[:n]
        eq = bits[x[:n], other[y[:n], t]]
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        more, less = down | ~(h | up), up & h
        score[:n] += (more & last[:n]) != 0
        score[:n] -= (less & last[:n]) != 0
        more, less = (more << one) | one, less << one
        up, down = less | ~(v | more), more & v
    return np.where(nx > 0, score, ny)


def _by_table(x: np.ndarray, y: np.ndarray) -> int:
    place = np.arange(len(y) + 1)
    row = place.copy()
    for n, ch in enumerate(x, 1):
        new = np.empty_like(row)
        new[0] = n
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (y != ch))
        row = np.minimum.accumulate(new - place) + place
    return int(row[-1])
