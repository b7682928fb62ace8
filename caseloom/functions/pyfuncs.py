"""Row-level helpers used inside Arrow UDFs.  Plain Python; shipped by value, so executors need no installed package."""

from __future__ import annotations

import sys

import numpy as np


#: Table cells that one call holds at once.
CELLS = 1 << 21


def _padded(seqs: list, fill: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(s) for s in seqs])
    out = np.full((len(seqs), max(1, sizes.max())), fill, np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = [x for s in seqs for x in s]
    return out, sizes


def edit_distances(a: list, b: list) -> np.ndarray:
    """Unrestricted Damerau-Levenshtein distances of pairs (a[k], b[k]) of label id sequences, all pairs at once.

    The table is filled by rows, with the pairs along the last axis, so that a row is one run of memory.  Insertions
    along a row are a running minimum; shorter pairs read their cell of the padded table.
    """
    (x, n), (y, m) = _padded(a, -1), _padded(b, -2)
    count, rows, cols = len(a), x.shape[1], y.shape[1]
    x, y, wide = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T), cols + 2
    table = np.full((rows + 2, wide, count), rows + cols, np.int32)
    table[1:, 1], table[1, 1:] = np.arange(rows + 1)[:, None], np.arange(cols + 1)[:, None]
    cells, pair, at = table.reshape(-1), np.arange(count), np.arange(1, cols + 1)[:, None]
    step = at.astype(np.int32)
    above, before = np.zeros((cols, count), np.int64), np.zeros((cols, count), np.int64)  # last row above, last column before, with a match
    for i in range(1, rows + 1):
        last, row, same = table[i], table[i + 1], x[i - 1] == y
        before[1:] = np.maximum.accumulate(np.where(same, at, 0), axis=0)[:-1]
        best = np.minimum(last[1:-1] + ~same, last[2:] + 1)
        best = np.minimum(best, cells[(above * wide + before) * count + pair] + (i - 1 - above + at - before)).astype(np.int32) - step
        best[0] = np.minimum(best[0], i)
        row[2:] = np.minimum.accumulate(best, axis=0) + step
        above[same] = i
    return table[n + 1, m + 1, pair]


def similarities(pairs: list[tuple[tuple, tuple]]) -> np.ndarray:
    """1 - unrestricted Damerau-Levenshtein distance / longer length; two empty sequences are identical.

    Pairs of similar length are scored together, so that little is padded.
    """
    longer = np.array([max(len(a), len(b)) for a, b in pairs], np.int64)
    order, out, at = np.argsort(longer, kind="stable"), np.ones(len(pairs)), 0
    at = int(np.searchsorted(longer[order], 1))
    while at < len(pairs):
        size = int(longer[order[at]])
        limit = size + size // 4
        end = min(int(np.searchsorted(longer[order], limit, side="right")), at + max(1, CELLS // (limit + 2) ** 2))
        part = order[at:end]
        out[part] = 1.0 - edit_distances([pairs[k][0] for k in part], [pairs[k][1] for k in part]) / longer[part]
        at = end
    return out


def similarity(a, b) -> float:
    return float(similarities([(tuple(a), tuple(b))])[0])


def medoids(rows: list) -> list[tuple[int, float]]:
    """Per list of samples: (index most similar to the others, mean pair similarity); each pair of values is scored once."""
    lists = [[tuple(s) for s in samples] for samples in rows]
    index: dict = {}
    for ss in lists:
        for i, p in enumerate(ss):
            for q in ss[:i]:
                index.setdefault((min(p, q), max(p, q)), len(index))
    sims = similarities(list(index))
    out = []
    for ss in lists:
        k = len(ss)
        tot = [sum(float(sims[index[(min(p, q), max(p, q))]]) for j, q in enumerate(ss) if j != i) for i, p in enumerate(ss)]
        out.append((max(range(k), key=lambda i: (round(tot[i], 12), -i)), sum(tot) / (k * (k - 1)) if k > 1 else 1.0))
    return out


def by_value(fn):
    """Mark the module of a UDF body so that cloudpickle ships its code instead of an import."""
    from pyspark import cloudpickle

    for name in {fn.__module__, __name__}:
        cloudpickle.register_pickle_by_value(sys.modules[name])
    return fn

