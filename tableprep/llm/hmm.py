"""A hidden Markov model over word classes: scaled forward pass and Baum-Welch counts.

Sequences are packed by time: sorted by length, the first steps of all come
first, then the second steps of those still running, so that one matrix
product moves all sequences a step on.
"""

from __future__ import annotations

import numpy as np


class Packed:
    """Sequences given as one class array and offsets, packed by time; each counts ``weight`` times (default: once)."""

    def __init__(self, classes: np.ndarray, offsets: np.ndarray, weight: np.ndarray | None = None):
        size = np.diff(offsets)
        self.order = np.argsort(-size, kind="stable")       # longest first
        size, begin = size[self.order], offsets[:-1][self.order]
        steps = int(size[0]) if len(size) else 0
        # running[t]: sequences with more than t symbols
        self.running = len(size) - np.searchsorted(size[::-1], np.arange(steps), "right")
        self.at = np.concatenate([[0], np.cumsum(self.running)])
        step = np.repeat(np.arange(steps), self.running)
        row = np.arange(int(self.at[-1])) - self.at[step]
        self.classes = classes[begin[row] + step]
        self.step, self.row = step, row
        self.weight = None if weight is None else np.asarray(weight, dtype=np.float64)[self.order]


def _by_state(p: Packed, emit: np.ndarray, kind) -> np.ndarray:
    """Emission probabilities of all symbols, one contiguous row for each state."""
    return np.take(np.ascontiguousarray(emit.T, dtype=kind), p.classes, axis=1)


def forward(p: Packed, start: np.ndarray, move: np.ndarray, emit: np.ndarray, keep: bool = False, kind=np.float64):
    """Natural log likelihood of each sequence (input order); with ``keep`` also the scaled states and scales.

    ``emit[k, s]`` is the probability of class k in state s. No sequence may be empty. States are rows of the working
    arrays (of type ``kind``), symbols columns, so that sums over states run over whole vectors.
    """
    n, total = len(p.order), len(p.classes)
    given = _by_state(p, emit, kind)
    back = np.ascontiguousarray(move.T, dtype=kind)
    states = np.empty((len(start), total), dtype=kind) if keep else None
    scales = np.empty(total, dtype=kind)
    a = None
    for t, m in enumerate(p.running.tolist()):
        lo = p.at[t]
        a = start.astype(kind)[:, None] * given[:, :m] if t == 0 else (back @ a[:, :m]) * given[:, lo:lo + m]
        c = a.sum(axis=0)
        a /= c
        scales[lo:lo + m] = c
        if keep:
            states[:, lo:lo + m] = a
    out = np.empty(n)
    out[p.order] = np.bincount(p.row, weights=np.log(scales.astype(np.float64)), minlength=n)
    return (out, states, scales, given) if keep else out


def expected_counts(p: Packed, start: np.ndarray, move: np.ndarray, emit: np.ndarray, kind=np.float64):
    """Baum-Welch: expected starts, moves and (class, state) emissions, and the total log likelihood.

    A sequence counts as often as its weight says (see ``Packed``). ``kind`` is the type of the recursion; counts are
    added up as doubles.
    """
    like, alpha, scale, given = forward(p, start, move, emit, keep=True, kind=kind)
    s, ahead = len(start), given       # emission times backward weight, over the scale: in place of the emissions
    gamma = alpha.copy()
    beta = np.ones((s, 0), dtype=kind)
    forth = np.ascontiguousarray(move, dtype=kind)
    ahead /= scale
    for t in range(len(p.running) - 1, -1, -1):
        lo, m = p.at[t], beta.shape[1]  # sequences that end here have a backward weight of one
        gamma[:, lo:lo + m] *= beta
        ahead[:, lo:lo + m] *= beta
        beta = forth @ ahead[:, lo:lo + int(p.running[t])]
    first = int(p.running[0]) if len(p.running) else 0
    if p.weight is not None:
        of_symbol = p.weight[p.row].astype(kind)
        gamma *= of_symbol
        ahead *= of_symbol
        like = like * p.weight[np.argsort(p.order, kind="stable")]
    # symbol pairs: a sequence's state at t with what lies ahead at t + 1
    later = np.arange(first, len(p.classes))
    before = p.at[p.step[later] - 1] + p.row[later]
    moves = (np.take(alpha, before, axis=1) @ ahead[:, first:].T).astype(np.float64) * move
    emits = np.stack([np.bincount(p.classes, weights=gamma[k], minlength=len(emit)) for k in range(s)], axis=1)
    return gamma[:, :first].sum(axis=1, dtype=np.float64), moves, emits, float(like.sum())


def picked(classes: np.ndarray, offsets: np.ndarray, most: int, weight: np.ndarray | None = None):
    """(sequence numbers, ``Packed``) groups of sequences of like length holding about ``most`` symbols each (a longer one alone)."""
    size = np.diff(offsets)
    order = np.argsort(size, kind="stable")
    i = 0
    while i < len(order):
        total = np.cumsum(size[order[i:]])
        j = i + max(1, int(np.searchsorted(total, most, "right")))
        pick = order[i:j]
        parts = [classes[offsets[x]:offsets[x + 1]] for x in pick.tolist()]
        yield pick, Packed(np.concatenate(parts), np.concatenate([[0], np.cumsum(size[pick])]), None if weight is None else weight[pick])
        i = j


def groups(classes: np.ndarray, offsets: np.ndarray, most: int, weight: np.ndarray | None = None):
    """The ``Packed`` groups of :func:`picked`."""
    for _, p in picked(classes, offsets, most, weight):
        yield p


def reestimate(starts, moves, emits, prior: np.ndarray, smooth: float):
    """Parameters from expected counts; emissions are smoothed towards ``prior`` (class probabilities)."""
    s = len(starts)
    start = (starts + 1) / (starts.sum() + s)
    move = (moves + 1) / (moves.sum(axis=1, keepdims=True) + s)
    emit = (emits + smooth * prior[:, None]) / (emits.sum(axis=0) + smooth)
    return start, move, emit


def first_guess(prior: np.ndarray, states: int, rng: np.random.Generator):
    """Persistent states whose emissions are random tilts of the class probabilities."""
    emit = prior[:, None] * rng.gamma(1.0, 1.0, (len(prior), states))
    move = np.full((states, states), 0.1 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return np.full(states, 1 / states), move, emit / emit.sum(axis=0)
