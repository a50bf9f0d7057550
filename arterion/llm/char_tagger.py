"""A character tagger: bidirectional LSTM under a linear-chain CRF, trained and decoded in numpy.

All windows of a batch take a step together, in both directions.  Input and embedding are one table
(character class -> gates), so a step is one product with the recurrent weights.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Characters with a class of their own; letters of ASCII have one each, whatever their case.
_OWN = "abcdefghijklmnopqrstuvwxyz @.-+()[]_%/:=\"',\n"
PAD, OTHER, DIGIT, LETTER = 0, 1, 2, 3
CLASSES = 4 + len(_OWN)
_BY_CODE = np.full(128, OTHER, np.int64)
for _k, _c in enumerate(_OWN):
    _BY_CODE[ord(_c)] = 4 + _k
for _c in "abcdefghijklmnopqrstuvwxyz":
    _BY_CODE[ord(_c.upper())] = _BY_CODE[ord(_c)]
_BY_CODE[ord("0") : ord("9") + 1] = DIGIT
FORBIDDEN = -1e4


def classes(text: str) -> np.ndarray:
    """The class of each code point."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where(codes < 128, _BY_CODE[np.minimum(codes, 127)], LETTER)
    for k in np.flatnonzero(codes >= 128):
        c = text[k]
        out[k] = DIGIT if c.isdigit() else LETTER if c.isalpha() else OTHER
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


@dataclass
class Tagger:
    """Tag 0 is outside; 1 + 2 k begins a span of kind k, 2 + 2 k goes on with it."""

    kinds: int
    hidden: int = 16
    seed: int = 1
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.weights:
            rng, h, tags = np.random.default_rng(self.seed), self.hidden, self.tags
            self.weights["in"], self.weights["again"] = rng.normal(0, 0.3, (2, CLASSES, 4 * h)), rng.normal(0, 1 / np.sqrt(h), (2, h, 4 * h))
            self.weights["in"][..., h : 2 * h] += 1  # gates begin by keeping
            self.weights["out"] = rng.normal(0, 1 / np.sqrt(2 * h), (2 * h, tags))
            self.weights["bias"], self.weights["moves"], self.weights["first"] = np.zeros(tags), np.zeros((tags, tags)), np.zeros(tags)
            self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}

    @property
    def tags(self) -> int:
        return 1 + 2 * self.kinds

    def _moves(self) -> np.ndarray:
        """Scores of tag after tag; a span only goes on after a tag of its own."""
        out = self.weights["moves"].copy()
        for tag in range(2, self.tags, 2):
            barred = np.ones(self.tags, bool)
            barred[[tag - 1, tag]] = False
            out[barred, tag] = FORBIDDEN
        return out

    def _run(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (windows, places, 2 hidden) of both directions, which take their steps together; x: classes.
        ``keep`` gets what the way back needs."""
        n, width, h = *x.shape, self.hidden
        table, again, sides = self.weights["in"], self.weights["again"], np.arange(2)[:, None]
        ways = np.stack([x, x[:, ::-1]])
        state, cell = np.zeros((2, n, h), table.dtype), np.zeros((2, n, h), table.dtype)
        out = np.empty((2, n, width, h), table.dtype)
        for t in range(width):
            z = table[sides, ways[:, :, t]] + state @ again
            gates, new = _sigmoid(z[..., : 3 * h]), np.tanh(z[..., 3 * h :])
            i, f, o = gates[..., :h], gates[..., h : 2 * h], gates[..., 2 * h :]
            was, before = cell, state
            cell = f * cell + i * new
            squashed = np.tanh(cell)
            state = o * squashed
            out[:, :, t] = state
            if keep is not None:
                keep.append((before, was, i, f, o, new, squashed))
        return np.concatenate([out[0], out[1][:, ::-1]], axis=2)

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return self._run(x) @ self.weights["out"] + self.weights["bias"]

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tags, margins): the best sequence of each window, and by how much each emission beats "outside"."""
        score = self.emissions(x)
        n, width, tags = score.shape
        moves, back = self._moves(), np.zeros((n, width, tags), np.int8)
        best = score[:, 0] + self.weights["first"]  # a window may begin inside a span
        for t in range(1, width):
            ways = best[:, :, None] + moves
            back[:, t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + score[:, t]
        found = np.empty((n, width), np.int64)
        found[:, -1] = best.argmax(axis=1)
        for t in range(width - 1, 0, -1):
            found[:, t - 1] = back[np.arange(n), t, found[:, t]]
        picked = np.take_along_axis(score, found[:, :, None], 2)[:, :, 0] - score[:, :, 0]
        return found, picked

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """(mean negative log-likelihood, its gradient) over windows x with tags y."""
        n, width, h = *x.shape, self.hidden
        kept: list = []
        both = self._run(x, kept)
        score = both @ self.weights["out"] + self.weights["bias"]
        moves, first = self._moves(), self.weights["first"]
        ahead, behind = np.empty_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0] + first
        for t in range(1, width):
            ahead[:, t] = _logsum(ahead[:, t - 1][:, :, None] + moves, 1) + score[:, t]
        for t in range(width - 2, -1, -1):
            behind[:, t] = _logsum(moves + (score[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        total = _logsum(ahead[:, -1], 1)
        rows = np.arange(n)
        right = score[rows[:, None], np.arange(width), y].sum(1) + first[y[:, 0]] + moves[y[:, :-1], y[:, 1:]].sum(1)
        d_score = np.exp(ahead + behind - total[:, None, None])
        d_moves = np.zeros_like(moves)
        for t in range(1, width):
            d_moves += np.exp(ahead[:, t - 1][:, :, None] + moves + (score[:, t] + behind[:, t] - total[:, None])[:, None, :]).sum(0)
        np.add.at(d_moves, (y[:, :-1], y[:, 1:]), -1)
        d_first = d_score[:, 0].sum(0) - np.bincount(y[:, 0], minlength=self.tags)
        d_score[rows[:, None], np.arange(width), y] -= 1
        out = {"moves": np.where(moves <= FORBIDDEN / 2, 0, d_moves), "first": d_first, "bias": d_score.sum((0, 1)), "out": both.reshape(-1, 2 * h).T @ d_score.reshape(-1, self.tags)}
        d_both = d_score @ self.weights["out"].T
        d_out = np.stack([d_both[..., :h], d_both[:, ::-1, h:]])
        again, dzs, befores = self.weights["again"], [], []
        d_state, d_cell = np.zeros_like(kept[0][0]), np.zeros_like(kept[0][0])
        for t in range(width - 1, -1, -1):
            before, was, i, f, o, new, squashed = kept[t]
            d_state = d_state + d_out[:, :, t]
            d_cell = d_cell + d_state * o * (1 - squashed * squashed)
            dz = np.concatenate([d_cell * new * i * (1 - i), d_cell * was * f * (1 - f), d_state * squashed * o * (1 - o), d_cell * i * (1 - new * new)], axis=2)
            dzs.append(dz)
            befores.append(before)
            d_state, d_cell = dz @ again.swapaxes(1, 2), d_cell * f
        steps = np.stack(dzs[::-1], axis=2).reshape(2, n * width, 4 * h)
        out["again"] = np.stack(befores[::-1], axis=2).reshape(2, n * width, h).swapaxes(1, 2) @ steps
        hot = np.zeros((2, n * width, CLASSES), steps.dtype)
        hot[np.arange(2)[:, None], np.arange(n * width), np.stack([x, x[:, ::-1]]).reshape(2, -1)] = 1
        out["in"] = hot.swapaxes(1, 2) @ steps
        return float((total - right).mean()), {key: (g / n).astype(self.weights[key].dtype) for key, g in out.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 500, size: int = 64, rate: float = 0.04) -> list[float]:
        """Adam over shuffled batches, at least ``steps`` of them in whole epochs; the mean loss of each epoch."""
        epochs = -(-steps // -(-len(x) // size))
        rng = np.random.default_rng(self.seed)
        mean, square = ({k: np.zeros_like(w) for k, w in self.weights.items()} for _ in range(2))
        step, losses, w_kind = 0, [], self.weights["out"].dtype
        for epoch in range(epochs):
            order, sum_ = rng.permutation(len(x)), 0.0
            for start in range(0, len(x), size):
                take = order[start : start + size]
                loss, grad = self.gradient(x[take], y[take])
                sum_ += loss * len(take)
                step += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                pace = rate * (1 - epoch / epochs) * min(1.0, 5.0 / max(norm, 1e-9))
                for k, g in grad.items():
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.99 * square[k] + 0.01 * g * g
                    self.weights[k] -= (pace * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(w_kind)
            losses.append(sum_ / max(1, len(x)))
        return losses
