"""The arithmetic of the language model: a gated recurrent net with a class-factored softmax, in numpy.

Words are numbers: 0 to ``words - 1`` for the most frequent, in order, then one number for all others.
The output is a softmax over classes of words of neighbouring frequency (and one class for all
other words) times a softmax inside the class. Classes hold equal shares of the roots of the
counts, so the frequent words lie in small classes and a token costs little. The last column of an
output's weights is its bias. Training is truncated back-propagation over windows; the state goes on
from window to window.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from heapq import heapreplace

import numpy as np


@dataclass(frozen=True)
class Shape:
    """``starts``: the first word of every class, then the number of words."""

    starts: tuple[int, ...]
    hidden: int = 24

    @classmethod
    def even(cls, words: int, per_class: int, hidden: int = 24) -> Shape:
        """Classes of the same size."""
        return cls((*range(0, words, per_class), words), hidden)

    @classmethod
    def following(cls, counts: np.ndarray) -> Shape:
        """Classes for words of these (falling) counts, as many as make the work of a token least."""
        root, mass = np.cumsum(np.sqrt(np.maximum(counts, 1))), np.append(0, np.cumsum(np.maximum(counts, 1)))
        best, least = (0, len(counts)), np.inf
        for classes in np.unique(np.geomspace(1, max(1, len(counts)), 60).astype(int)):
            cuts = np.searchsorted(root, root[-1] * np.arange(1, classes) / classes) + 1
            starts = np.unique(np.concatenate(([0], cuts[cuts < len(counts)], [len(counts)])))
            sizes, shares = np.diff(starts), np.diff(mass[starts]) / mass[-1]
            work = 1.5 * len(sizes) + float((sizes * shares).sum())
            if work < least:
                best, least = tuple(starts.tolist()), work
        return cls(best)

    @property
    def words(self) -> int:
        return self.starts[-1]

    @property
    def classes(self) -> int:
        return len(self.starts) - 1

    @cached_property
    def class_of(self) -> np.ndarray:
        """Class of every word; the other words have the last one."""
        return np.repeat(np.arange(self.classes + 1, dtype=np.int32), np.append(np.diff(self.starts), 1))


Weights = dict[str, np.ndarray]

#: Numbers that an update changes at a time, so that its arrays stay in the cache.
NUMBERS_AT_ONCE = 16_384


def initial(counts: np.ndarray, other: float, shape: Shape, seed: int = 5) -> Weights:
    """Weights that begin as the word frequencies: counts of the frequent words, and of all others together."""
    rng, h = np.random.default_rng(seed), shape.hidden
    mass = np.zeros(shape.words)
    mass[:len(counts)] = counts
    by_class = np.append(np.add.reduceat(mass, shape.starts[:-1]), other) + 1e-3
    word_bias = np.where(mass > 0, np.log(np.maximum(mass, 1e-3) / by_class[shape.class_of[:-1]]), -30.0)
    return {k: v.astype(np.float32) for k, v in {
        "input": rng.normal(0, 0.3, (shape.words + 1, 3 * h)), "gate_bias": np.zeros(3 * h),
        "recur": rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)),
        "class": np.column_stack([np.zeros((shape.classes + 1, h)), np.log(by_class / by_class.sum())]),
        "word": np.column_stack([rng.normal(0, 0.01, (shape.words, h)), word_bias]),
    }.items()}


def as_vector(weights: Weights) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)]).astype(np.float32)


def from_vector(vector: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        n = like[k].size
        out[k] = vector[at:at + n].reshape(like[k].shape).astype(np.float32)
        at += n
    return out


def _exponentials(given: np.ndarray, weights: np.ndarray, target: np.ndarray, rows: np.ndarray,
                  ones: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exponentials of all logits, their sums over a row, and the log-probability of the targets.

    Logits are shifted by their largest only where they overflow or vanish without. ``rows`` counts from 0;
    it and ``ones`` are at least as long as the logits.
    """
    x = given @ weights.T
    found = x[rows[:len(target)], target]
    np.exp(x, out=x)
    sums = x @ ones[:x.shape[1]]
    if not (sums.min() > 1e-30 and sums.max() < 1e30):
        np.matmul(given, weights.T, out=x)
        shift = x.max(axis=1)
        np.exp(x - shift[:, None], out=x)
        sums = x.sum(axis=1)
        found -= shift
    found -= np.log(sums)
    return x, sums, found


def states(w: Weights, inputs: np.ndarray, fresh: np.ndarray, state: np.ndarray, keep: bool):
    """States after each step of a window (steps x lanes); ``fresh`` marks steps that begin a text."""
    h = w["recur"].shape[0]
    out = np.empty((*inputs.shape, h), w["recur"].dtype)
    given, begins = w["input"][inputs] + w["gate_bias"], fresh.any(axis=1)
    half, kept = w["recur"].dtype.type(0.5), []
    for t in range(len(inputs)):
        before = state * ~fresh[t][:, None] if begins[t] else state
        r_in, x = before @ w["recur"], given[t]
        gates = np.tanh(half * (x[:, :2 * h] + r_in[:, :2 * h]))  # sigmoid, by the tangent
        gates *= half
        gates += half
        z, r, n_in = gates[:, :h], gates[:, h:], r_in[:, 2 * h:]
        n = np.tanh(x[:, 2 * h:] + r * n_in)
        state = z * (before - n)
        state += n
        out[t] = state
        if keep:
            kept.append((before, z, r, n, n_in))
    return out, state, kept


@np.errstate(over="ignore", divide="ignore")
def log_probabilities(w: Weights, hidden: np.ndarray, target: np.ndarray, shape: Shape, grads: Weights | None = None):
    """Natural log-probability of each target word (of the other words: of their class) given its state.

    With ``grads`` also adds the gradients of the negative sum, and returns that of the states.
    The work is done in order of the targets' classes, so those of a class lie together.
    """
    classes = shape.class_of[target]
    order = np.argsort(classes.astype(np.uint16) if shape.classes < 65535 else classes, kind="stable")
    classes, target, rows, h = classes[order], target[order], np.arange(len(target)), shape.hidden
    given = np.ones((len(target), h + 1), hidden.dtype)
    given[:, :h] = hidden[order]
    ones = np.ones(max(shape.classes + 1, int(np.diff(shape.starts).max())), hidden.dtype)
    x, sums, found = _exponentials(given, w["class"], classes, rows, ones)
    slope = None
    ends = np.searchsorted(classes, np.arange(shape.classes + 2))
    if grads is not None:
        share = 1 / sums[:, None]
        grads["class"] += x.T @ (given * share)
        slope = (x @ w["class"]) * share - w["class"][classes]
        present = np.flatnonzero(np.diff(ends))
        grads["class"][present] -= np.add.reduceat(given, ends[present])
    for k in np.flatnonzero(np.diff(ends[:-1])):
        start, end = shape.starts[k], shape.starts[k + 1]
        if end - start == 1:
            continue  # the only word of its class
        own = slice(ends[k], ends[k + 1])
        weights, states_ = w["word"][start:end], given[own]
        word = target[own] - start
        x, sums, inside = _exponentials(states_, weights, word, rows, ones)
        found[own] += inside
        if grads is not None:
            x *= (1 / sums)[:, None]
            x[rows[:len(word)], word] -= 1
            grads["word"][start:end] += x.T @ states_
            slope[own] += x @ weights
    back = np.empty_like(order)
    back[order] = rows
    return found[back], slope[back, :h] if slope is not None else None


def _back(w: Weights, inputs: np.ndarray, fresh: np.ndarray, kept: list, slope: np.ndarray, grads: Weights) -> None:
    """Back-propagation through the steps of one window."""
    steps, lanes, h = slope.shape
    later = np.zeros((lanes, h), slope.dtype)
    to_input = np.empty((steps, lanes, 3 * h), slope.dtype)
    for t in range(steps - 1, -1, -1):
        before, z, r, n, n_in = kept[t]
        d = slope[t] + later
        closed, here = 1 - z, to_input[t]
        d_n = d * closed * (1 - n * n)
        here[:, :h] = d * (before - n) * z * closed
        here[:, h:2 * h] = d_n * n_in * r * (1 - r)
        here[:, 2 * h:] = d_n
        to_recur = here.copy()
        to_recur[:, 2 * h:] *= r
        grads["recur"] += before.T @ to_recur
        later = d * z
        later += to_recur @ w["recur"].T
        later[fresh[t]] = 0
    flat, ids = to_input.reshape(-1, 3 * h), inputs.ravel()
    grads["gate_bias"] += flat.sum(axis=0)
    order = np.argsort(ids, kind="stable")
    used, starts, times = np.unique(ids[order], return_index=True, return_counts=True)
    once, often = times == 1, np.repeat(times > 1, times)  # rows of a word seen once need no sum
    grads["input"][used[once]] += flat[order[starts[once]]]
    if often.any():
        again = times[~once]
        grads["input"][used[~once]] += np.add.reduceat(flat[order[often]], np.cumsum(again) - again, axis=0)


class Trainer:
    """Adam on windows of ``steps`` words of many texts side by side.

    Input rows of words and classes of outputs that a window does not have cost it nothing: their
    gradients are zero and their moments wait. The words' outputs, the largest part, are changed after every
    ``gather`` windows along their gathered gradients.
    """

    def __init__(self, weights: Weights, shape: Shape, rate: float = 0.01, steps: int = 32, gather: int = 4):
        self.weights = {k: v.copy() for k, v in weights.items()}
        self._shape, self._rate, self.steps, self._gather = shape, rate, steps, gather
        self._mean = {k: np.zeros_like(v) for k, v in weights.items()}
        self._square = {k: np.zeros_like(v) for k, v in weights.items()}
        self._grads = {k: np.zeros_like(v) for k, v in weights.items()}
        self._updates = dict.fromkeys(weights, 0)
        self._classes, self._windows, self._gathered = np.zeros(shape.classes + 1, bool), 0, 0

    def learn(self, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray) -> None:
        """Trains on laid out texts: step x lane arrays; targets are -1 where a lane has ended."""
        state = np.zeros((inputs.shape[1], self._shape.hidden), np.float32)
        for k in range(0, len(inputs), self.steps):
            x, y, new = inputs[k:k + self.steps], targets[k:k + self.steps], fresh[k:k + self.steps]
            live = (y >= 0).any(axis=0)
            x, y, new = x[:, live], y[:, live], new[:, live]
            hidden, last, kept = states(self.weights, x, new, state[live], keep=True)
            real = y >= 0
            if real.all():
                _, slope = log_probabilities(self.weights, hidden.reshape(-1, self._shape.hidden), y.ravel(), self._shape, self._grads)
                slope = slope.reshape(hidden.shape)
            else:
                slope = np.zeros_like(hidden)
                _, slope[real] = log_probabilities(self.weights, hidden[real], y[real], self._shape, self._grads)
            _back(self.weights, x, new, kept, slope, self._grads)
            n = int(real.sum())
            self._update({"input": np.unique(x), "gate_bias": slice(None), "recur": slice(None), "class": slice(None)}, n)
            self._classes[self._shape.class_of[y[real]]] = True
            self._windows, self._gathered = self._windows + 1, self._gathered + n
            if self._windows == self._gather:
                self._update_words()
            state[live] = last
        self._update_words()

    def _update_words(self) -> None:
        if self._gathered:
            touched = self._classes[self._shape.class_of[:-1]]
            self._update({"word": slice(None) if touched.all() else np.flatnonzero(touched)}, self._gathered)
        self._classes[:], self._windows, self._gathered = False, 0, 0

    def _update(self, touched: dict[str, np.ndarray | slice], n: int) -> None:
        """One step along the gathered gradients of the ``touched`` rows, which are then cleared."""
        parts = {k: self._grads[k][rows] for k, rows in touched.items()}
        size = np.sqrt(sum(float(np.vdot(g, g)) for g in parts.values())) / n
        scale = np.float32(min(1.0, 1.0 / max(size, 1e-9)) / n)
        for k, part in parts.items():
            at = touched[k]
            self._updates[k] += 1
            rate = np.float32(self._rate * np.sqrt(1 - 0.99 ** self._updates[k]) / (1 - 0.9 ** self._updates[k]))
            # a slice gives views, row numbers copies, which are put back
            mean, square, weights = self._mean[k][at], self._square[k][at], self.weights[k][at]
            some = max(1, NUMBERS_AT_ONCE * len(part) // max(1, part.size))
            for i in range(0, len(part), some):
                own = slice(i, i + some)
                _step(part[own] * scale, mean[own], square[own], weights[own], rate)
            if not isinstance(at, slice):
                self._mean[k][at], self._square[k][at], self.weights[k][at] = mean, square, weights
            self._grads[k][at] = 0


def _step(g: np.ndarray, mean: np.ndarray, square: np.ndarray, weights: np.ndarray, rate: np.float32) -> None:
    """A step of Adam in place along the gradient ``g``, which is used up."""
    change = g - mean
    change *= np.float32(0.1)
    mean += change
    np.multiply(g, g, out=change)
    change -= square
    change *= np.float32(0.01)
    square += change
    np.sqrt(square, out=change)
    change += np.float32(1e-6)
    np.multiply(mean, rate, out=g)
    g /= change
    weights -= g


def score(w: Weights, shape: Shape, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, owner: np.ndarray,
          n_texts: int, window: int = 8192) -> np.ndarray:
    """Natural log-likelihood of each whole text; ``owner`` is the text of each step and lane.

    A window has about ``window`` words: the fewer lanes are left, the more steps.
    """
    total, k = np.zeros(n_texts), 0
    state = np.zeros((inputs.shape[1], shape.hidden), np.float32)
    while k < len(inputs):
        end = k + max(1, window // max(1, int((targets[k] >= 0).sum())))
        y = targets[k:end]
        live = (y >= 0).any(axis=0)
        hidden, last, _ = states(w, inputs[k:end, live], fresh[k:end, live], state[live], keep=False)
        real = y[:, live] >= 0
        found, _ = log_probabilities(w, hidden[real], y[:, live][real], shape)
        total += np.bincount(owner[k:end, live][real], weights=found, minlength=n_texts)
        state[live] = last
        k = end
    return total


def cut(text: np.ndarray, most: int) -> tuple[list[np.ndarray], list[int]]:
    """Pieces of at most ``most`` words of a text, and the word before each (0 before the first)."""
    return ([text[i:i + most] for i in range(0, len(text), most)],
            [int(text[i - 1]) if i else 0 for i in range(0, len(text), most)])


def laid_out(texts: list[np.ndarray], most_lanes: int, before: list[int] | None = None):
    """Texts (arrays of word numbers) side by side in lanes of about equal length, one after another in a lane.

    ``before`` are the words before the texts, else 0, the end of another text.
    """
    lengths = np.array([len(t) for t in texts])
    lanes = int(max(1, min(most_lanes, lengths.sum() // max(int(lengths.max()), 16))))
    load, place = [(0, i) for i in range(lanes)], []
    for i in np.argsort(-lengths, kind="stable").tolist():
        at, lane = load[0]
        place.append((i, lane, at))
        heapreplace(load, (at + len(texts[i]), lane))
    size = (max(load)[0], lanes)
    inputs, targets = np.zeros(size, np.int32), np.full(size, -1, np.int32)
    fresh, owner = np.zeros(size, bool), np.zeros(size, np.int32)
    for i, lane, at in place:
        text, end = texts[i], at + len(texts[i])
        targets[at:end, lane], owner[at:end, lane] = text, i
        inputs[at + 1:end, lane] = text[:-1]
        fresh[at, lane] = True
        if before:
            inputs[at, lane] = before[i]
    return inputs, targets, fresh, owner
