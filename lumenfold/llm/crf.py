"""A linear-chain conditional random field in numpy: sparse binary features, batched training and Viterbi."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    labels: list[str]
    index: dict[str, int]
    emit: np.ndarray  # features x labels
    move: np.ndarray  # label x next label
    first: np.ndarray

    def _scores(self, rows: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """Emission scores, sequences x longest x labels, and lengths; unknown features score nothing."""
        sizes = np.array([len(r) for r in rows])
        out = np.zeros((len(rows), int(sizes.max()), len(self.labels)))
        for i, r in enumerate(rows):
            for t, feats in enumerate(r):
                out[i, t] = self.emit[[self.index[f] for f in feats if f in self.index]].sum(0)
        return out, sizes

    def viterbi(self, rows: list[list[list[str]]], batch: int = 256) -> list[list[str]]:
        """The best labels of each sequence of feature lists; sequences of like length go together."""
        out: list[list[str]] = [[] for _ in rows]
        order = sorted((i for i in range(len(rows)) if rows[i]), key=lambda i: len(rows[i]))
        for a in range(0, len(order), batch):
            some = order[a : a + batch]
            emit, sizes = self._scores([rows[i] for i in some])
            best = emit[:, 0] + self.first
            ties = np.zeros(emit.shape, np.int32)
            for t in range(1, emit.shape[1]):
                step = best[:, :, None] + self.move
                ties[:, t] = step.argmax(1)
                live = (t < sizes)[:, None]
                best = np.where(live, step.max(1) + emit[:, t], best)
            last = best.argmax(1)
            for k, i in enumerate(some):
                path = [int(last[k])]
                for t in range(int(sizes[k]) - 1, 0, -1):
                    path.append(int(ties[k, t, path[-1]]))
                out[i] = [self.labels[p] for p in reversed(path)]
        return out


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def train(rows: list[list[list[str]]], tags: list[list[str]], steps: int = 250, rate: float = 0.15, ridge: float = 0.02) -> Chain:
    """Penalised maximum likelihood by Adam over all sequences at once, from zero: the same rows give the same model."""
    labels = sorted({t for ts in tags for t in ts} | {"O"})
    index = {f: i for i, f in enumerate(sorted({f for r in rows for fs in r for f in fs}))}
    n, longest, k = len(rows), max(map(len, rows)), len(labels)
    sizes = np.array([len(r) for r in rows])
    who, at, what = map(np.array, zip(*[(i, t, index[f]) for i, r in enumerate(rows) for t, fs in enumerate(r) for f in fs], strict=True))
    gold = np.zeros((n, longest), int)
    for i, ts in enumerate(tags):
        gold[i, : len(ts)] = [labels.index(t) for t in ts]
    mask = np.arange(longest) < sizes[:, None]
    theta = np.zeros((len(index) + k + 1, k))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    truth = np.zeros_like(theta)
    np.add.at(truth, what, np.eye(k)[gold[who, at]])
    pairs = mask[:, 1:]
    np.add.at(truth, (len(index) + gold[:, :-1][pairs], gold[:, 1:][pairs]), 1)
    np.add.at(truth[-1], gold[:, 0], 1)
    for step in range(1, steps + 1):
        emit_w, move, first = theta[: len(index)], theta[len(index) : -1], theta[-1]
        emit = np.zeros((n, longest, k))
        np.add.at(emit, (who, at), emit_w[what])
        fore, back = np.zeros_like(emit), np.zeros_like(emit)
        fore[:, 0] = emit[:, 0] + first
        for t in range(1, longest):
            fore[:, t] = np.where(mask[:, t, None], _sum(fore[:, t - 1, :, None] + move, 1) + emit[:, t], fore[:, t - 1])
        for t in range(longest - 2, -1, -1):
            back[:, t] = np.where(mask[:, t + 1, None], _sum(move + (emit[:, t + 1] + back[:, t + 1])[:, None, :], 2), 0)
        total = _sum(fore[:, -1], 1)
        share = np.exp(fore + back - total[:, None, None]) * mask[..., None]
        guess = np.zeros_like(theta)
        np.add.at(guess, what, share[who, at])
        for t in range(1, longest):
            both = np.exp(fore[:, t - 1, :, None] + move + (emit[:, t] + back[:, t])[:, None, :] - total[:, None, None]) * mask[:, t, None, None]
            guess[len(index) : -1] += both.sum(0)
        guess[-1] = share[:, 0].sum(0)
        slope = (truth - guess) / n - ridge * theta / len(rows)
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return Chain(labels, index, theta[: len(index)], theta[len(index) : -1], theta[-1])
