"""DartMinHash: sparse weighted signatures of token sets.

Every element owns a plane of weight by rank into which hashed darts fall as a Poisson process
of density one. Unit cells of the plane (rank cells below one halve down to ``FINEST``) get their
number of darts, and each dart its place, from hashes of element and cell alone, so all sets see
the same darts. A set hits the darts below its element's weight; those up to rank
``t / total weight``, about ``t`` of them, are hashed to the signature's coordinates, and the
earliest of each coordinate is kept. Two signatures agree in a coordinate with the weighted
Jaccard similarity as probability. Where a coordinate has no dart the rank limit is doubled,
which leaves filled coordinates as they are.
"""

from __future__ import annotations

import math

import numpy as np

FINEST = 6
#: Pairs of an element and a cell that are worked on at once.
CHUNK = 1 << 15
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


#: Cells' starts up to 1 and widths, by number; those from 1 on have a width of 1. And the chance of at most j darts.
_STARTS = np.array([0.0, *(2.0**-i for i in range(FINEST, -1, -1))])
_WIDTHS = np.array([2.0**-FINEST, *_STARTS[1:]])


def _poisson_steps(mean: float) -> np.ndarray:
    p, total, steps = math.exp(-mean), 0.0, []
    for i in range(24):
        total += p
        steps.append(total)
        p *= mean / (i + 1)
    return np.array(steps)


_STEPS = np.array([_poisson_steps(w) for w in _WIDTHS])
#: The least hash of a cell that has a dart.
_SOME = np.ceil(_STEPS[:, 0] * 2.0**53).astype(np.uint64) << np.uint64(11)


def _n_cells(limit: np.ndarray) -> np.ndarray:
    """How many rank cells start below a limit."""
    return np.where(limit > 1, len(_STARTS) - 1 + np.ceil(limit).astype(np.int64) - 1, np.searchsorted(_STARTS, limit, side="left"))


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n_sets: int, k: int) -> np.ndarray:
    """(n_sets, k) uint64 signatures. owner: the set of each element, ascending; weights above 0.

    Sets without elements get zeros. Pairs of an element and a cell are taken ``CHUNK`` at a time, whatever
    the sets' sizes: a small set has many cells, a large one many elements."""
    sig = np.zeros(n_sets * k, np.uint64)
    best = np.full(n_sets * k, np.inf)
    total = np.bincount(owner, weight, n_sets)
    limit = np.where(total > 0, (k * math.log(k) + 2 * k) / np.maximum(total, 1e-300), 0.0)
    element = mix(element.astype(np.uint64))
    levels = np.ceil(weight).astype(np.int64)
    whole = bool((levels == weight).all())  # then every dart of a cell is below the weight
    todo = total > 0
    while todo.any():
        here = np.flatnonzero(todo[owner])
        cells = _n_cells(limit)[owner[here]]
        ends = np.cumsum(cells * levels[here])
        at = 0
        while at < len(here):
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + CHUNK, side="right")))
            _throw(here[at:end], cells[at:end], owner, element, weight, levels, limit, whole, k, best, sig)
            at = end
        todo &= (sig.reshape(n_sets, k) == 0).any(1)
        limit = np.where(todo, 2 * limit, limit)
    return sig.reshape(n_sets, k)


def _throw(here: np.ndarray, cells: np.ndarray, owner: np.ndarray, element: np.ndarray, weight: np.ndarray, levels: np.ndarray, limit: np.ndarray, whole: bool, k: int, best: np.ndarray, sig: np.ndarray) -> None:
    """Darts of some elements (``here``, with ``cells`` rank cells each), into the earliest rank and dart of each coordinate."""
    pairs = cells * levels[here]
    of = np.repeat(np.arange(len(here)), pairs)
    c = np.arange(len(of)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    level = c // cells[of] if (pairs != cells).any() else None
    if level is not None:
        c -= level * cells[of]
    number = (1 + c if level is None else 1 + c + (level << 32)).astype(np.uint64)
    cell = mix(element[here][of] + _GOLDEN * number)
    kind = np.minimum(c, len(_STARTS) - 1)
    some = np.flatnonzero(cell >= _SOME[kind])
    cell, c, kind, of = cell[some], c[some], kind[some], of[some]
    u, n = _uniform(cell), np.ones(len(some), np.int64)
    more = np.arange(len(some))
    for j in range(1, _STEPS.shape[1]):
        more = more[u[more] >= _STEPS[kind[more], j]]
        if not len(more):
            break
        n[more] += 1
    many = np.repeat(np.arange(len(some)), n)
    nth = np.arange(len(many)) - np.repeat(np.cumsum(n) - n, n)
    dart = mix(cell[many] + _GOLDEN * (nth + 1).astype(np.uint64))
    start = _STARTS[kind] + (c - kind)
    rank = start[many] + _WIDTHS[kind][many] * _uniform(mix(dart ^ np.uint64(0xA5A5A5A5)))
    who = here[of[many]]
    own = owner[who]
    hit = rank <= limit[own]
    if not whole:
        low = 0 if level is None else level[some][many]
        hit &= low + _uniform(mix(dart ^ np.uint64(0x5A5A5A5A))) < weight[who]
    own, rank, dart = own[hit], rank[hit], dart[hit]
    spot = own * k + (mix(dart) % np.uint64(k)).astype(np.int64)
    np.minimum.at(best, spot, rank)
    won = rank == best[spot]
    sig[spot[won]] = dart[won]
