"""The binary quadratic selection min p'Fp over sets of n, for one layer at a time."""

from __future__ import annotations

import numpy as np


def onto_simplex(x: np.ndarray, n: int) -> np.ndarray:
    """Nearest point with entries in [0, 1] and sum n: the shift is found between the breakpoints of a piecewise linear sum."""
    knots = np.sort(np.concatenate((x, x - 1)))
    sums = np.clip(x[None, :] - knots[:, None], 0, 1).sum(axis=1)  # falls as the shift grows
    k = int(np.clip(np.searchsorted(-sums, -float(n)), 1, len(knots) - 1))
    a, b = knots[k - 1], knots[k]
    gap = sums[k - 1] - sums[k]
    return np.clip(x - (a + (b - a) * ((sums[k - 1] - n) / gap if gap > 0 else 0.0)), 0, 1)


def swapped(f: np.ndarray, chosen: np.ndarray, allowed: np.ndarray, tolerance: float = 1e-12) -> np.ndarray:
    """Best-improvement exchanges of one member for one non-member, until none helps."""
    chosen, diagonal = chosen.copy(), np.diag(f)
    reach = f[:, chosen].sum(axis=1)
    for _ in range(50 * len(f)):
        inside, outside = np.flatnonzero(chosen), np.flatnonzero(~chosen & allowed)
        if not len(inside) or not len(outside):
            break
        gain = (diagonal[inside] - 2 * reach[inside])[:, None] + (diagonal[outside] + 2 * reach[outside])[None, :] - 2 * f[np.ix_(inside, outside)]
        at = np.unravel_index(gain.argmin(), gain.shape)
        if gain[at] >= -tolerance:
            break
        out, new = inside[at[0]], outside[at[1]]
        chosen[out], chosen[new] = False, True
        reach += f[:, new] - f[:, out]
    return chosen


def prune_set(f: np.ndarray, n: int, protected: set[int] = frozenset(), starts: int = 16, steps: int = 200, seed: int = 0) -> np.ndarray:
    """Sorted ids of the set of ``n`` unprotected experts of least total F found from ``starts`` descents.

    The first descent starts at the smallest diagonal entries, the others at random;
    each is a projected gradient descent of the relaxation, rounded and exchanged. F is
    made symmetric first. Raises if fewer than ``n`` experts are unprotected.
    """
    f = (f + f.T) / 2
    allowed = np.array([e not in protected for e in range(len(f))])
    if allowed.sum() < n:
        raise ValueError(f"{n} experts to prune, {int(allowed.sum())} are unprotected")
    free = np.flatnonzero(allowed)
    order = free[np.argsort(np.diag(f)[free], kind="stable")]
    first = np.isin(np.arange(len(f)), order[:n])
    if not n or not (f - np.diag(np.diag(f))).any():
        return np.flatnonzero(first)
    g, rng = f[np.ix_(free, free)], np.random.default_rng(seed)
    step = 1 / max(np.abs(g).sum(axis=1).max(), 1e-30)
    best, least = first, np.inf
    for start in range(starts):
        p = first[free].astype(float) if start == 0 else onto_simplex(rng.random(len(free)), n)
        for _ in range(steps):
            p = onto_simplex(p - step * 2 * (g @ p), n)
        top = np.zeros(len(f), bool)
        top[free[np.argsort(-p, kind="stable")[:n]]] = True
        for candidate in {tuple(swapped(f, x, allowed)) for x in ((first, top) if start == 0 else (top,))}:
            at = np.array(candidate)
            value = f[np.ix_(at, at)].sum()
            if value < least - 1e-15:
                best, least = at, value
    return np.flatnonzero(best)
