"""A character-level bidirectional LSTM with a linear-chain CRF on top, in numpy.

Inputs are windows of character classes (one row of small integers for each window), outputs
a tag for each character. Class 0 is padding; its tag is 0.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def lstm(x: np.ndarray, table: np.ndarray, recurrent: np.ndarray, keep: bool = False):
    """Hidden states (windows x time x units) of windows ``x``; with ``keep``, also what the gradient needs."""
    size, steps = x.shape
    units = recurrent.shape[0]
    h = c = np.zeros((size, units), table.dtype)
    out, kept = np.empty((size, steps, units), table.dtype), []
    for t in range(steps):
        z = table[x[:, t]] + h @ recurrent
        gates = _sigmoid(z[:, : 3 * units])
        new = np.tanh(z[:, 3 * units :])
        i, f, o = gates[:, :units], gates[:, units : 2 * units], gates[:, 2 * units :]
        before = c
        c = f * c + i * new
        bent = np.tanh(c)
        if keep:
            kept.append((h, before, i, f, o, new, bent))
        h = o * bent
        out[:, t] = h
    return out, kept


def lstm_gradient(x: np.ndarray, table: np.ndarray, recurrent: np.ndarray, kept, outer: np.ndarray):
    """Gradients of table and recurrent weights, given that of the hidden states."""
    size, steps = x.shape
    units = recurrent.shape[0]
    d_table, d_recurrent = np.zeros_like(table), np.zeros_like(recurrent)
    dh_next = dc_next = np.zeros((size, units), table.dtype)
    for t in range(steps - 1, -1, -1):
        h, before, i, f, o, new, bent = kept[t]
        dh = outer[:, t] + dh_next
        dc = dh * o * (1 - bent * bent) + dc_next
        dz = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), dh * bent * o * (1 - o), dc * i * (1 - new * new)], 1)
        np.add.at(d_table, x[:, t], dz)
        d_recurrent += h.T @ dz
        dh_next, dc_next = dz @ recurrent.T, dc * f
    return d_table, d_recurrent


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def crf_loss(scores: np.ndarray, moves: np.ndarray, tags: np.ndarray):
    """Mean negative log likelihood of ``tags``, and its gradients by scores and moves."""
    size, steps, kinds = scores.shape
    alpha = np.empty_like(scores)
    alpha[:, 0] = scores[:, 0]
    for t in range(1, steps):
        alpha[:, t] = _log_sum(alpha[:, t - 1][:, :, None] + moves[None], 1) + scores[:, t]
    beta = np.zeros_like(scores)
    for t in range(steps - 2, -1, -1):
        beta[:, t] = _log_sum(moves[None] + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
    total = _log_sum(alpha[:, -1], 1)
    rows = np.arange(size)[:, None]
    gold = scores[rows, np.arange(steps), tags].sum(1) + moves[tags[:, :-1], tags[:, 1:]].sum(1)
    d_scores = np.exp(alpha + beta - total[:, None, None])
    d_scores[rows, np.arange(steps), tags] -= 1
    d_moves = np.zeros_like(moves)
    for t in range(steps - 1):
        joint = alpha[:, t][:, :, None] + moves[None] + (scores[:, t + 1] + beta[:, t + 1])[:, None, :] - total[:, None, None]
        d_moves += np.exp(joint).sum(0)
    np.add.at(d_moves, (tags[:, :-1], tags[:, 1:]), -1)
    return float((total - gold).mean()), d_scores / size, d_moves / size


def viterbi(scores: np.ndarray, moves: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
    """The best tags of each sequence; ``lengths``, if given, fall from sequence to sequence, and 0 follows each end."""
    size, steps, kinds = scores.shape
    lengths = np.full(size, steps) if lengths is None else lengths
    active = np.searchsorted(-lengths, -np.arange(steps), "left")  # sequences that reach each step
    best, back = scores[:, 0].copy(), np.empty((size, steps, kinds), np.int8)
    for t in range(1, steps):
        n = active[t]
        reach = best[:n, :, None] + moves[None]
        back[:n, t] = reach.argmax(1)
        best[:n] = reach.max(1) + scores[:n, t]
    tags = np.zeros((size, steps), np.int8)
    rows = np.arange(size)
    tags[rows, lengths - 1] = best.argmax(1)
    for t in range(steps - 1, 0, -1):
        n = active[t]
        tags[:n, t - 1] = back[rows[:n], t, tags[:n, t]]
    return tags


@dataclass
class Tagger:
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, classes: int, kinds: int, units: int = 12, seed: int = 3) -> Tagger:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        weights = {"out": draw(2 * units, kinds), "bias": np.zeros(kinds, np.float32), "moves": np.zeros((kinds, kinds), np.float32)}
        for side in ("f", "b"):
            weights[f"table_{side}"] = draw(classes, 4 * units)
            weights[f"table_{side}"][:, units : 2 * units] += 1  # remember at first
            weights[f"recurrent_{side}"] = draw(units, 4 * units)
        return cls(weights)

    def scores(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        ahead, _ = lstm(x, w["table_f"], w["recurrent_f"])
        back, _ = lstm(x[:, ::-1], w["table_b"], w["recurrent_b"])
        return np.concatenate([ahead, back[:, ::-1]], 2) @ w["out"] + w["bias"]

    def all_scores(self, x: np.ndarray, block: int = 512) -> np.ndarray:
        """``scores`` of many windows, a block at a time."""
        if not len(x):
            return np.zeros((*x.shape, len(self.weights["bias"])), np.float32)
        return np.concatenate([self.scores(x[i : i + block]) for i in range(0, len(x), block)])

    def tags(self, x: np.ndarray) -> np.ndarray:
        return viterbi(self.all_scores(x), self.weights["moves"]) if len(x) else np.zeros(x.shape, np.int8)

    def gradients(self, x: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        w = self.weights
        ahead, kept_f = lstm(x, w["table_f"], w["recurrent_f"], True)
        back, kept_b = lstm(x[:, ::-1], w["table_b"], w["recurrent_b"], True)
        both = np.concatenate([ahead, back[:, ::-1]], 2)
        loss, d_scores, d_moves = crf_loss(both @ w["out"] + w["bias"], w["moves"], tags)
        d_both = d_scores @ w["out"].T
        units = w["recurrent_f"].shape[0]
        out = {"out": np.einsum("bth,btk->hk", both, d_scores), "bias": d_scores.sum((0, 1)), "moves": d_moves}
        out["table_f"], out["recurrent_f"] = lstm_gradient(x, w["table_f"], w["recurrent_f"], kept_f, d_both[:, :, :units])
        out["table_b"], out["recurrent_b"] = lstm_gradient(x[:, ::-1], w["table_b"], w["recurrent_b"], kept_b, d_both[:, ::-1, units:])
        return loss, out

    def train(self, x: np.ndarray, tags: np.ndarray, steps: int = 300, batch: int = 64, rate: float = 0.02, seed: int = 4) -> list[float]:
        """Adam on random batches; returns the losses."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        losses = []
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), batch)
            loss, grads = self.gradients(x[pick], tags[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                move = (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                self.weights[k] = (self.weights[k] - pace * move).astype(np.float32)
            losses.append(loss)
        return losses
