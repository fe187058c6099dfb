"""Linear-chain conditional random fields in numpy: training on a bounded sample, forward-backward and Viterbi in batches.

A position's score for a label is a weighted sum of its features; neighbouring labels add a learned transition score.
Forward-backward works on all sequences of a batch at once: they are cut into blocks, each block's transfer matrix is
built step by step for all blocks together, block borders are then combined along each sequence, and the blocks are
filled in. The result is exact, and a sequence of any length costs the same per position.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK = 48


@dataclass
class Model:
    """weights: features x labels; trans[i, j]: from i to j; start and the labels' names."""

    weights: np.ndarray
    trans: np.ndarray
    start: np.ndarray
    labels: list[str]


def _blocks(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence, number within it and length of each block; longer blocks come first."""
    n = -(-lengths // BLOCK)
    seq = np.repeat(np.arange(len(lengths)), n)
    nth = np.arange(len(seq)) - np.repeat(np.cumsum(n) - n, n)
    size = np.minimum(BLOCK, lengths[seq] - nth * BLOCK)
    order = np.argsort(-size, kind="stable")
    return seq[order], nth[order], size[order]


def _unit(x: np.ndarray, axes: tuple[int, ...] = (-1,)) -> np.ndarray:
    return x / x.sum(axis=axes, keepdims=True)


def marginals(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """P(label | sequence) at each position. scores: all sequences' positions one below the other; lengths are positive."""
    k = scores.shape[1]
    if not len(scores):
        return np.zeros((0, k))
    seq, nth, size = _blocks(lengths)
    first = np.cumsum(lengths) - lengths
    at = first[seq] + nth * BLOCK
    grown = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-30
    step = np.exp(trans - trans.max())
    begin = np.exp(start - start.max())
    opens = nth == 0
    steps = int(size[0])
    active = np.searchsorted(-size, -np.arange(steps), side="left")  # blocks longer than s are the first active[s]
    # Transfer matrices: from the label before a block (of the first block: its starting label) to the one at its end.
    move = np.broadcast_to(step, (len(seq), k, k)).copy()
    move[opens] = np.eye(k)
    for s in range(steps):
        n = active[s]
        if s:
            move[:n] = move[:n] @ step
        move[:n] *= grown[at[:n] + s][:, None, :]
        move[:n] = _unit(move[:n], (1, 2))
    # Along the blocks of each sequence.
    blocks = -(-lengths // BLOCK)
    where = np.empty(len(seq), np.int64)
    where[(np.cumsum(blocks) - blocks)[seq] + nth] = np.arange(len(seq))
    by_length = np.argsort(-blocks, kind="stable")
    base, counts = (np.cumsum(blocks) - blocks)[by_length], blocks[by_length]
    enter, leave = np.empty((len(seq), k)), np.empty((len(seq), k))
    v = np.broadcast_to(begin, (len(counts), k)).copy()
    for j in range(int(counts[0])):
        n = np.searchsorted(-counts, -j, side="left")
        b = where[base[:n] + j]
        enter[b] = v[:n]
        v[:n] = _unit((v[:n, None, :] @ move[b])[:, 0])
    u = np.ones((len(counts), k))
    for j in reversed(range(int(counts[0]))):
        n = np.searchsorted(-counts, -j, side="left")
        b = where[base[:n] + j]
        leave[b] = u[:n]
        u[:n] = _unit((move[b] @ u[:n, :, None])[:, :, 0])
    # Within the blocks.
    forward = np.empty((steps, len(seq), k))
    a = np.where(opens[:, None], enter, enter @ step)
    for s in range(steps):
        n = active[s]
        a = a[:n] if not s else a[:n] @ step
        a = _unit(a * grown[at[:n] + s])
        forward[s, :n] = a
    out = np.empty_like(grown)
    b = leave.copy()
    for s in reversed(range(steps)):
        n = active[s]
        inner = active[s + 1] if s + 1 < steps else 0
        if inner:
            b[:inner] = _unit((grown[at[:inner] + s + 1] * b[:inner]) @ step.T)
        out[at[:n] + s] = _unit(forward[s, :n] * b[:n])
    return out


def viterbi(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The best labels of all sequences; ties go to the lower label. Sequences of like length run together."""
    out = np.empty(len(scores), np.int64)
    first = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    lengths, first = lengths[order], first[order]
    if not len(lengths):
        return out
    steps = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")
    back = []
    best = start + scores[first]
    ends = best.copy()
    for s in range(1, steps):
        n = active[s]
        ways = best[:n, :, None] + trans
        back.append(ways.argmax(axis=1).astype(np.int8))
        best = ways.max(axis=1) + scores[first[:n] + s]
        ends[:n] = best
    label = ends.argmax(axis=1)
    for s in reversed(range(steps)):
        n = active[s]
        if s + 1 < steps:
            inner = active[s + 1]
            label[:inner] = back[s][np.arange(inner), label[:inner]]
        out[first[:n] + s] = label[:n]
    return out


def train(
    rows: list[tuple[np.ndarray, np.ndarray]],
    sequences: list[tuple[np.ndarray, np.ndarray]],
    features: int,
    labels: list[str],
    epochs: int = 6,
    batch: int = 64,
    rate: float = 0.05,
    decay: float = 1e-6,
    seed: int = 7,
) -> Model:
    """Maximum likelihood by Adam. rows: (feature ids, values) of each kind of position; sequences: (kinds, labels)."""
    k = len(labels)
    weights, trans, start = np.zeros((features, k)), np.zeros((k, k)), np.zeros(k)
    if not sequences or k < 2:
        return Model(weights.astype(np.float32), trans, start, labels)
    ids = np.concatenate([r[0] for r in rows])
    values = np.concatenate([r[1] for r in rows])
    size = np.array([len(r[0]) for r in rows])
    first = np.cumsum(size) - size
    params = [weights, trans, start]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    rng, t = np.random.default_rng(seed), 0
    for _ in range(epochs):
        order = rng.permutation(len(sequences))
        for lo in range(0, len(order), batch):
            own = [sequences[i] for i in order[lo : lo + batch]]
            kinds, gold = np.concatenate([s[0] for s in own]), np.concatenate([s[1] for s in own])
            lengths = np.array([len(s[0]) for s in own])
            used, slot = np.unique(kinds, return_inverse=True)
            span = np.concatenate([np.arange(first[u], first[u] + size[u]) for u in used])
            cuts = np.cumsum(size[used]) - size[used]
            table = np.add.reduceat(weights[ids[span]] * values[span][:, None], cuts, axis=0)
            scores = table[slot]
            p, pairs, heads = _expected(scores, lengths, trans, start)
            p[np.arange(len(gold)), gold] -= 1
            diff = np.zeros((len(used), k))
            np.add.at(diff, slot, p)
            per = np.repeat(diff, size[used], axis=0) * values[span][:, None]
            grad = np.stack([np.bincount(ids[span], per[:, j], features) for j in range(k)], axis=1)
            begins = np.cumsum(lengths) - lengths
            inner = np.ones(len(gold), bool)
            inner[begins] = False
            after = np.flatnonzero(inner)
            np.add.at(pairs, (gold[after - 1], gold[after]), -1)
            np.add.at(heads, gold[begins], -1)
            t += 1
            for q, g, (m, v) in zip(params, (grad, pairs, heads), moments, strict=True):
                g = g / len(own) + decay * q
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(weights.astype(np.float32), trans, start, labels)


def _expected(scores: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals, and expected counts of label pairs and of first labels over a batch."""
    k = scores.shape[1]
    order = np.argsort(-lengths, kind="stable")
    begins = (np.cumsum(lengths) - lengths)[order]
    counts = lengths[order]
    steps = int(counts[0])
    active = np.searchsorted(-counts, -np.arange(steps), side="left")
    grown = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-30
    step, begin = np.exp(trans - trans.max()), np.exp(start - start.max())
    forward = np.empty((len(scores), k))
    a = begin
    for s in range(steps):
        n = active[s]
        a = (a if not s else a[:n] @ step) * grown[begins[:n] + s]
        a = _unit(a)
        forward[begins[:n] + s] = a
    p, pairs = np.empty((len(scores), k)), np.zeros((k, k))
    b = np.ones((len(counts), k))
    for s in reversed(range(steps)):
        n = active[s]
        inner = active[s + 1] if s + 1 < steps else 0
        if inner:
            right = grown[begins[:inner] + s + 1] * b[:inner]
            joint = forward[begins[:inner] + s][:, :, None] * step * right[:, None, :]
            pairs += _unit(joint, (1, 2)).sum(axis=0)
            b[:inner] = _unit(right @ step.T)
        p[begins[:n] + s] = _unit(forward[begins[:n] + s] * b[:n])
    return p, pairs, p[begins].sum(axis=0)
