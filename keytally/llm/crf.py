"""A linear-chain conditional random field over lines with two labels, in numpy.

A line is a row of bins, one per feature; its score is the sum of the weights of its bins, as content
over boilerplate. Training maximises the likelihood of labelled sequences, held near given first
weights, so that without any sequence these remain.
"""

from __future__ import annotations

import numpy as np

STEPS = 100
RATE = 0.1
#: How strongly weights are held to the first ones, per sequence.
HOLD = 0.002
#: Longer sequences are trained on in parts.
LONGEST = 32


class LineModel:
    def __init__(self, weights: list[np.ndarray], moves: np.ndarray) -> None:
        self.weights = weights  # per feature, per bin
        self.moves = moves  # from label to label; 1 is content
        self.sizes = [len(w) for w in weights]
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]

    def scores(self, bins: np.ndarray) -> np.ndarray:
        """The score of each line as content, from rows of bins."""
        if not len(bins):
            return np.zeros(0)
        return np.concatenate(self.weights)[bins + self.offsets].sum(axis=1)

    def decode(self, scores: list[float]) -> list[bool]:
        """The most likely labels (Viterbi); content is True, and wins ties."""
        (bb, bc), (cb, cc) = self.moves.tolist()
        content = boiler = 0.0
        back: list[tuple[bool, bool]] = []
        for i, score in enumerate(scores):
            if i:
                from_c = (content + cb >= boiler + bb, content + cc >= boiler + bc)
                boiler, content = (
                    max(content + cb, boiler + bb),
                    max(content + cc, boiler + bc) + score,
                )
                back.append(from_c)
            else:
                content, boiler = score, 0.0
        label = content >= boiler
        out = [label]
        for from_c in reversed(back):
            label = from_c[label]
            out.append(label)
        return out[::-1] if scores else []


def _parts(sequences: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [
        (bins[at : at + LONGEST], labels[at : at + LONGEST])
        for bins, labels in sequences
        for at in range(0, len(bins), LONGEST)
    ]


def train(first: LineModel, sequences: list[tuple[np.ndarray, np.ndarray]]) -> LineModel:
    """The model for sequences of (bins, labels 0 or 1), by gradient ascent with momentum (Adam)."""
    parts = _parts(sequences)
    if not parts:
        return first
    n, length = len(parts), max(len(b) for b, _ in parts)
    width = int(sum(first.sizes))
    cells = np.zeros((n, length, len(first.sizes)), np.int64)
    labels, live = np.zeros((n, length), np.int64), np.zeros((n, length), bool)
    for i, (bins, own) in enumerate(parts):
        cells[i, : len(bins)] = bins + first.offsets
        labels[i, : len(bins)] = own
        live[i, : len(bins)] = True
    seen = np.bincount(cells[live & (labels == 1)].ravel(), minlength=width).astype(float)
    step = live[:, 1:]
    turns = np.zeros((2, 2))
    np.add.at(turns, (labels[:, :-1][step], labels[:, 1:][step]), 1)
    start = np.concatenate([np.concatenate(first.weights), first.moves.ravel()])
    x, mean, square = start.copy(), np.zeros(width + 4), np.zeros(width + 4)
    for t in range(1, STEPS + 1):
        w, moves = x[:width], x[width:].reshape(2, 2)
        emit = np.zeros((n, length, 2))
        emit[..., 1] = w[cells].sum(axis=2)
        ahead = np.zeros((n, length, 2))
        ahead[:, 0] = emit[:, 0]
        for i in range(1, length):
            go = np.logaddexp.reduce(ahead[:, i - 1, :, None] + moves, axis=1) + emit[:, i]
            ahead[:, i] = np.where(live[:, i, None], go, ahead[:, i - 1])
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        behind = np.zeros((n, length, 2))
        pairs = np.zeros((2, 2))
        for i in range(length - 1, 0, -1):
            on = emit[:, i] + behind[:, i]
            both = ahead[:, i - 1, :, None] + moves + on[:, None, :] - total[:, None, None]
            pairs += np.exp(both[live[:, i]]).sum(axis=0)
            go = np.logaddexp.reduce(moves + on[:, None, :], axis=2)
            behind[:, i - 1] = np.where(live[:, i, None], go, behind[:, i - 1])
        content = np.exp(ahead[..., 1] + behind[..., 1] - total[:, None])
        expected = np.bincount(
            cells[live].ravel(), np.repeat(content[live], cells.shape[2]), minlength=width
        )
        rise = np.concatenate([seen - expected, (turns - pairs).ravel()]) / n - HOLD * (x - start)
        mean = 0.9 * mean + 0.1 * rise
        square = 0.99 * square + 0.01 * rise**2
        x = x + RATE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    cuts = np.cumsum(first.sizes)[:-1]
    return LineModel(np.split(x[:width], cuts), x[width:].reshape(2, 2))
