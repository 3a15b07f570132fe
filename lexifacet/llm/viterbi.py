"""Viterbi decoding of many sequences at once in numpy."""

from __future__ import annotations

import numpy as np


def decode(scores: np.ndarray, first: np.ndarray, change: np.ndarray) -> np.ndarray:
    """The best label of each position; ties go to the lower label.

    scores: (positions, labels); first: where each sequence begins, and the
    end; change[i, j]: the score of label j after label i.

    A position whose best score leads by more than twice the spread of `change`
    has that label on every best path, since a swap changes at most two steps.
    Such anchors cut the sequences exactly; the pieces between them are decoded
    together, longest first, one position of all of them a step.
    """
    n, k = scores.shape
    kind = np.int8 if k < 128 else np.int32
    out = scores.argmax(1).astype(kind) if n else np.zeros(0, kind)
    if n == 0 or k == 1:
        return out
    top = np.partition(scores, k - 2, axis=1)
    anchor = top[:, k - 1] - top[:, k - 2] > 2 * (change.max() - change.min())
    begins = np.zeros(n, bool)
    begins[first[:-1][np.diff(first) > 0]] = True
    start = np.flatnonzero(begins | anchor)
    length = np.diff(np.append(start, n))
    keep = (length > 1) | ~anchor[start]
    after = start + length
    closed = keep & (after < n)
    closed[closed] = ~begins[after[closed]]  # the next piece begins with an anchor of the same sequence
    ends = np.zeros((len(start), k), scores.dtype)
    ends[closed] = change[:, out[after[closed]]].T
    start, length, ends = start[keep], length[keep], ends[keep]
    order = np.argsort(-length, kind="stable")
    start, length, ends = start[order], length[order], ends[order]
    if not len(start):
        return out
    best = scores[start].copy()
    fixed = anchor[start]
    best[fixed] = -1e9
    best[fixed, out[start[fixed]]] = scores[start[fixed], out[start[fixed]]]
    steps = int(length[0])
    live = [len(start)]
    back = []
    for t in range(1, steps):
        m = int(np.searchsorted(-length, -t, "left"))  # pieces longer than t
        live.append(m)
        paths = best[:m, :, None] + change[None]
        back.append(paths.argmax(1).astype(kind))
        best[:m] = paths.max(1) + scores[start[:m] + t]
    label = (best + ends).argmax(1).astype(kind)
    for t in range(steps - 1, 0, -1):
        m = live[t]
        out[start[:m] + t] = label[:m]
        label[:m] = back[t - 1][np.arange(m), label[:m]]
    out[start] = label
    return out


def decode_slowly(scores: np.ndarray, change: np.ndarray) -> list[int]:
    """One sequence, without shortcuts: what decode() is tested against."""
    if not len(scores):
        return []
    best, back = scores[0].astype(float), []
    for s in scores[1:]:
        paths = best[:, None] + change
        back.append(paths.argmax(0))
        best = paths.max(0) + s
    out = [int(best.argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]
