"""Linear-chain conditional random fields in numpy, over many sequences at once.

Sequences lie one after another; ``offsets`` (n + 1) bounds them. A sequence
longer than PIECE is cut into pieces whose transfer matrices are computed side
by side and chained, so that the steps that follow run over at most PIECE
positions, each for all pieces that are long enough: one sequence of a million
elements costs about as much as many short ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

PIECE = 512


def _steps(first: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For position 0, 1, ... of the pieces: (the elements at it, their pieces), of the longest piece first."""
    order = np.argsort(-size, kind="stable")
    longest = int(size.max(initial=0))
    # how many pieces are longer than t
    active = len(size) - np.searchsorted(np.sort(size), np.arange(longest), "right")
    for t in range(longest):
        own = order[: active[t]]
        yield first[own] + t, own


def _pieces(offsets: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first element, size, continues its sequence) of the pieces, in order."""
    total = np.diff(offsets)
    parts = -(-total // most)
    of = np.repeat(np.arange(len(total)), parts)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    return offsets[:-1][of] + nth * most, np.minimum(most, total[of] - nth * most), nth > 0


def forward_backward(unary: np.ndarray, trans: np.ndarray, offsets: np.ndarray, most: int = PIECE) -> tuple[np.ndarray, np.ndarray, float]:
    """(marginals of the states: N x K, expected transitions: K x K, sum of log partition functions)."""
    shift = unary.max(axis=1, keepdims=True)
    emit, move = np.exp(unary - shift), np.exp(trans - trans.max())
    k = emit.shape[1]
    first, size, goes_on = _pieces(offsets, most)
    later = np.flatnonzero(goes_on)
    matrix = np.broadcast_to(np.eye(k), (len(first), k, k)).copy()
    for at, own in _steps(first[later], size[later]):
        m = (matrix[later[own]] @ move) * emit[at][:, None, :]
        matrix[later[own]] = m / m.max(axis=(1, 2), keepdims=True)
    ahead, back, scale = np.empty_like(emit), np.ones_like(emit), np.ones(len(emit))
    enter = np.zeros((len(first), k))

    def forward(pieces: np.ndarray) -> None:
        for t, (at, own) in enumerate(_steps(first[pieces], size[pieces])):
            if t:
                now = (ahead[at - 1] @ move) * emit[at]
            else:
                own = pieces[own]
                now = np.where(goes_on[own, None], enter[own] @ move, 1) * emit[at]
            scale[at] = norm = now.sum(axis=1)
            ahead[at] = now / norm[:, None]

    last = first + size - 1
    if len(later):
        forward(np.flatnonzero(~goes_on))
        for p in later:
            enter[p] = enter[p - 1] @ matrix[p - 1] if goes_on[p - 1] else ahead[last[p - 1]]
            enter[p] /= enter[p].sum()
        forward(later)
        for p in later[::-1]:
            leave = matrix[p] @ back[last[p]]
            back[last[p - 1]] = leave / (leave @ ahead[last[p - 1]])
    else:
        forward(np.arange(len(first)))
    for at, _ in reversed(list(_steps(first, size))[1:]):
        back[at - 1] = ((emit[at] * back[at]) @ move.T) / scale[at][:, None]
    marginals = ahead * back
    begins = np.ones(len(emit), bool)
    begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = False
    follow = np.flatnonzero(begins)
    pairs = ahead[follow - 1].T @ (emit[follow] * back[follow] / scale[follow][:, None]) * move
    total = float(np.log(scale).sum() + shift.sum() + trans.max() * len(follow))
    return marginals / marginals.sum(axis=1, keepdims=True), pairs, total


def viterbi(unary: np.ndarray, trans: np.ndarray, offsets: np.ndarray, most: int = PIECE) -> np.ndarray:
    """The best state of every element; of equally good ones the smallest."""
    first, size, goes_on = _pieces(offsets, most)
    last = first + size - 1
    later = np.flatnonzero(goes_on)
    k = unary.shape[1]
    best, back = unary.copy(), np.zeros(unary.shape, np.int8)
    if len(later):
        # of every piece that goes on: the best score from each state before it to each state at its end
        matrix = np.where(np.eye(k, dtype=bool), 0, -np.inf).astype(unary.dtype)[None].repeat(len(first), axis=0)
        for at, own in _steps(first[later], size[later]):
            own = later[own]
            matrix[own] = (matrix[own][:, :, :, None] + trans).max(axis=2) + unary[at][:, None, :]
    enter = np.zeros((len(first), k), unary.dtype)

    def forward(pieces: np.ndarray) -> None:
        for t, (at, own) in enumerate(_steps(first[pieces], size[pieces])):
            before = best[at - 1] if t else enter[pieces[own]]
            if t == 0 and not goes_on[pieces].any():
                continue
            ways = before[:, :, None] + trans[None]
            back[at] = from_ = ways.argmax(axis=1)
            best[at] += np.take_along_axis(ways, from_[:, None, :], axis=1)[:, 0]

    forward(np.flatnonzero(~goes_on))
    for p in later:
        enter[p] = (enter[p - 1][:, None] + matrix[p - 1]).max(axis=0) if goes_on[p - 1] else best[last[p - 1]]
        enter[p] -= enter[p].max()
    if len(later):
        forward(later)
    out = np.empty(len(unary), np.int64)
    ends = np.append(~goes_on[1:], True)[: len(first)]
    out[last[ends]] = best[last[ends]].argmax(axis=1)
    if len(later):
        # where each state at the end of a piece comes from
        origin = np.broadcast_to(np.arange(k), (len(first), k)).copy()
        for at, own in reversed(list(_steps(first[later], size[later]))):
            own = later[own]
            origin[own] = np.take_along_axis(back[at], origin[own], axis=1)
        for p in later[::-1]:
            out[last[p - 1]] = origin[p, out[last[p]]]
    for at, _ in reversed(list(_steps(first, size))[1:]):
        out[at - 1] = back[at, out[at]]
    return out


def fit(score: Callable[[np.ndarray], np.ndarray], pull: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int], states: np.ndarray, offsets: np.ndarray, steps: int = 150, rate: float = 0.1, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(weights, transitions) of greatest penalised likelihood, by full-batch Adam from zero.

    ``score`` gives N x K unaries of the weights, ``pull`` the gradient of the
    weights from that of the unaries.
    """
    k = shape[1]
    truth = np.eye(k)[states]
    inner = np.ones(len(states), bool)
    inner[offsets[:-1][offsets[:-1] < len(states)]] = False
    later = np.flatnonzero(inner)
    seen = truth[later - 1].T @ truth[later]
    weights = [np.zeros(shape), np.zeros((k, k))]
    moment = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    for step in range(1, steps + 1):
        marginals, pairs, _ = forward_backward(score(weights[0]), weights[1], offsets)
        for w, (m, v), g in zip(weights, moment, (pull(truth - marginals), seen - pairs)):
            g = g / len(states) - l2 * w
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return weights[0], weights[1]
