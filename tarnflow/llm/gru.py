"""A gated recurrent network over word ids with a class-factored softmax, in numpy.

Words of the model have ids 0 to ``vocabulary - 1`` in order of frequency (0 is
the end of a text, which also starts one); id ``vocabulary`` stands for all other
words and is a class of its own. Classes hold ``class_size`` neighbouring ids, so

    log P(word | h) = log P(class | h) + log P(word | class, h).

Documents stand in lanes that advance together. The state is carried through a
whole document, across windows, and is zero where a document starts; training
cuts the gradient at window borders (truncated backpropagation).
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Shape:
    vocabulary: int = 2048
    class_size: int = 64
    hidden: int = 16

    @property
    def classes(self) -> int:
        return -(-self.vocabulary // self.class_size)

    def sizes(self) -> dict[str, tuple[int, ...]]:
        v, h, c = self.vocabulary, self.hidden, self.classes
        return {
            "inputs": (v + 1, 3 * h),
            "recur": (h, 3 * h),
            "to_class": (h, c + 1),
            "class_bias": (c + 1,),
            "to_word": (c * self.class_size, h),
            "word_bias": (c * self.class_size,),
        }


Weights = dict[str, np.ndarray]

#: Rows of a block of logits, and of a run that is added up on its own.
ROWS, LONG_RUN = 2048, 32


def initial(shape: Shape, counts: np.ndarray, seed: int = 1) -> Weights:
    """Small random weights; biases give the plain frequencies ``counts`` of the
    ids 0 to ``vocabulary``."""
    rng = np.random.default_rng(seed)
    w = {name: (rng.standard_normal(size) * 0.3 * size[-1] ** -0.5 if len(size) > 1 else np.zeros(size)).astype(np.float32) for name, size in shape.sizes().items()}
    known = np.zeros(shape.classes * shape.class_size)
    known[: shape.vocabulary] = counts[: shape.vocabulary] + 0.5
    by_class = known.reshape(shape.classes, shape.class_size)
    w["class_bias"] = np.log(np.r_[by_class.sum(axis=1), counts[shape.vocabulary] + 0.5]).astype(np.float32)
    w["class_bias"] -= w["class_bias"].mean()
    # places beyond the vocabulary have no chance
    w["word_bias"] = np.where(known > 0, np.log(np.maximum(known, 0.5)), -40.0).astype(np.float32)
    return w


def pack(w: Weights, shape: Shape) -> bytes:
    return np.concatenate([w[name].ravel() for name in shape.sizes()]).astype(np.float32).tobytes()


def unpack(raw: bytes | np.ndarray, shape: Shape) -> Weights:
    flat = np.frombuffer(raw, dtype=np.float32) if isinstance(raw, bytes) else raw.astype(np.float32)
    w, at = {}, 0
    for name, size in shape.sizes().items():
        n = int(np.prod(size))
        w[name] = flat[at : at + n].reshape(size).copy()
        at += n
    return w


@dataclass
class Lanes:
    """Documents in lanes of descending length: (step, lane) arrays."""

    inputs: np.ndarray
    targets: np.ndarray
    owner: np.ndarray
    starts: np.ndarray
    active: np.ndarray  # lanes in use at each step


def lanes_of(docs: list[np.ndarray], most: int, open_ends: set[int] = frozenset()) -> Lanes:
    """Whole documents in at most ``most`` lanes, longest first into the shortest lane.

    ``docs`` hold each document's ids without the end, which is added here (but for
    those numbered in ``open_ends``).
    """
    sizes = np.fromiter((len(d) + (k not in open_ends) for k, d in enumerate(docs)), dtype=np.int64, count=len(docs))
    order = np.argsort(-sizes, kind="stable")
    lanes = min(most, len(docs))
    heap = [(0, k) for k in range(lanes)]
    lane, row = np.empty(len(docs), dtype=np.int64), np.empty(len(docs), dtype=np.int64)
    for d in order.tolist():
        at, k = heap[0]
        lane[d], row[d] = k, at
        heapq.heapreplace(heap, (at + int(sizes[d]), k))
    length = np.zeros(lanes, dtype=np.int64)
    np.maximum.at(length, lane, row + sizes)
    rank = np.empty(lanes, dtype=np.int64)
    rank[np.argsort(-length, kind="stable")] = np.arange(lanes)
    lane = rank[lane]
    steps = int(length.max())
    targets = np.zeros((steps, lanes), dtype=np.int32)
    owner = np.zeros((steps, lanes), dtype=np.int32)
    starts = np.zeros((steps, lanes), dtype=bool)
    end = np.zeros(1, dtype=np.int32)
    flat = np.concatenate([x for k, d in enumerate(docs) for x in ((d,) if k in open_ends else (d, end))]).astype(np.int32)
    first = np.cumsum(sizes) - sizes
    place = (np.repeat(row - first, sizes) + np.arange(len(flat)), np.repeat(lane, sizes))
    targets[place] = flat
    owner[place] = np.repeat(np.arange(len(docs), dtype=np.int32), sizes)
    starts[row, lane] = True
    inputs = np.zeros_like(targets)
    inputs[1:] = targets[:-1]
    inputs[starts] = 0
    return Lanes(inputs, targets, owner, starts, lanes - np.searchsorted(np.sort(length), np.arange(steps), side="right"))


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def picked(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log-softmax of each row at one place, and the row's softmax; ``x`` is
    overwritten. The largest value is taken off only where an exponential could
    overflow: states are below one, so logits are small unless weights are huge."""
    if max(x.max(initial=0), -x.min(initial=0)) > 60:
        x -= x.max(axis=1, keepdims=True)
    value = x[np.arange(len(x)), at]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], dtype=x.dtype)
    return value - np.log(total), x / total[:, None]


def chances(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first of :func:`picked` alone."""
    if max(x.max(initial=0), -x.min(initial=0)) > 60:
        x -= x.max(axis=1, keepdims=True)
    value = x[np.arange(len(x)), at]
    np.exp(x, out=x)
    return value - np.log(x @ np.ones(x.shape[1], dtype=x.dtype))


def by_value(ids: np.ndarray) -> np.ndarray:
    """The stable order of small numbers; those of 16 bits are sorted by their digits."""
    return np.argsort(ids.astype(np.uint16) if ids.max(initial=0) < 1 << 16 else ids, kind="stable")


def by_class(targets: np.ndarray, shape: Shape) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The class of each target, and the rows of each class but the last."""
    group = targets // shape.class_size
    group[targets >= shape.vocabulary] = shape.classes
    order = by_value(group)
    found, start = np.unique(group[order], return_index=True)
    return group, [(int(g), rows) for g, rows in zip(found, np.split(order, start[1:])) if g < shape.classes]


def apart(x: np.ndarray, size: int) -> np.ndarray:
    """The columns of both gates and of the candidate as three matrices, each in one piece."""
    return np.ascontiguousarray(x.reshape(len(x), 3, size).transpose(1, 0, 2))


def cell(recur: np.ndarray, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step of the gated cell: update and reset gates, candidate, new state.
    ``recur`` and ``x``, which is overwritten, are :func:`apart`."""
    a = np.matmul(h, recur)
    gates = x[:2]
    gates += a[:2]
    gates *= np.float32(0.5)
    np.tanh(gates, out=gates)
    gates *= np.float32(0.5)
    gates += np.float32(0.5)
    z, r, inner = gates[0], gates[1], a[2]
    c = r * inner
    c += x[2]
    np.tanh(c, out=c)
    new = h - c
    new *= z
    new += c
    return z, r, inner, c, new


def step(w: Weights, h: np.ndarray, x: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """:func:`cell` for a matrix ``x`` with all columns."""
    return cell(apart(w["recur"], size), h, apart(x, size))


def score(w: Weights, docs: list[np.ndarray], shape: Shape, most_lanes: int = 512, window: int = 64) -> np.ndarray:
    """Natural log-probability of each whole document, end included; other words
    count with the chance of their class. As many lanes as are filled while the
    longest document takes its steps."""
    if not docs:
        return np.zeros(0)
    sizes = [len(d) + 1 for d in docs]
    lanes = lanes_of(docs, max(1, min(most_lanes, sum(sizes) // max(sizes))))
    total = np.zeros(len(docs))
    of_input, recur = apart(w["inputs"], shape.hidden), apart(w["recur"], shape.hidden)
    h = np.zeros((lanes.targets.shape[1], shape.hidden), dtype=np.float32)
    for low in range(0, len(lanes.active), window):
        high = min(low + window, len(lanes.active))
        states, targets, owner = [], [], []
        for t in range(low, high):
            n = lanes.active[t]
            now = h[:n]
            if lanes.starts[t, :n].any():
                now = np.where(lanes.starts[t, :n, None], np.float32(0), now)
            h = cell(recur, now, of_input.take(lanes.inputs[t, :n], axis=1))[-1]
            states.append(h)
            targets.append(lanes.targets[t, :n])
            owner.append(lanes.owner[t, :n])
        hs, target = np.concatenate(states), np.concatenate(targets)
        group, rows_of = by_class(target, shape)
        found = chances(hs @ w["to_class"] + w["class_bias"], group)
        for g, rows in rows_of:
            part = slice(g * shape.class_size, (g + 1) * shape.class_size)
            found[rows] += chances(hs[rows] @ w["to_word"][part].T + w["word_bias"][part], target[rows] - part.start)
        total += np.bincount(np.concatenate(owner), weights=found, minlength=len(docs))
    return total


def sum_of(x: np.ndarray) -> np.ndarray:
    """The sum of all rows."""
    return np.ones(len(x), dtype=x.dtype) @ x


def sums_of(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of the rows of each run, from its ``first`` row to the next run's."""
    size = np.diff(np.r_[first, len(x)])
    total = np.empty((len(first), x.shape[1]), dtype=x.dtype)
    long = size >= LONG_RUN
    for k in np.flatnonzero(long).tolist():
        total[k] = sum_of(x[first[k] : first[k] + size[k]])
    if not long.all():
        short, sizes = x[np.repeat(~long, size)], size[~long]
        total[~long] = np.add.reduceat(short, np.cumsum(sizes) - sizes, axis=0)
    return total


def gradients(w: Weights, h: np.ndarray, inputs: list, targets: list, starts: list, shape: Shape) -> tuple[float, dict, np.ndarray]:
    """Loss and gradients of one window from the carried state ``h``.

    ``inputs``, ``targets``, ``starts`` are lists over steps of arrays over the
    active lanes, which never grow. The gradient of ``inputs`` is (rows, values).
    """
    size = shape.hidden
    of_input, recur = apart(w["inputs"], size), apart(w["recur"], size)
    trace, states = [], []
    for ids, start in zip(inputs, starts):
        h = np.where(start[:, None], np.float32(0), h[: len(ids)])
        z, r, inner, c, new = cell(recur, h, of_input.take(ids, axis=1))
        trace.append((h, z, r, inner, c))
        states.append(new)
        h = new
    ends = np.cumsum([len(x) for x in inputs])
    hs = np.concatenate(states)
    target = np.concatenate(targets)
    group, rows_of = by_class(target, shape)
    n = len(hs)
    grad = {"to_class": np.zeros_like(w["to_class"]), "class_bias": np.zeros_like(w["class_bias"]), "to_word": {}, "word_bias": {}}
    dh, loss = np.empty_like(hs), 0.0
    for low in range(0, n, ROWS):  # blocks that stay in the processor's cache
        mine, at = hs[low : low + ROWS], group[low : low + ROWS]
        logp, d_class = picked(mine @ w["to_class"] + w["class_bias"], at)
        loss -= logp.sum(dtype=np.float64)
        d_class[np.arange(len(at)), at] -= 1
        grad["to_class"] += mine.T @ d_class
        grad["class_bias"] += sum_of(d_class)
        np.matmul(d_class, w["to_class"].T, out=dh[low : low + ROWS])
    for g, rows in rows_of:
        part = slice(g * shape.class_size, (g + 1) * shape.class_size)
        mine, at = hs[rows], target[rows] - part.start
        logp, d_word = picked(mine @ w["to_word"][part].T + w["word_bias"][part], at)
        loss -= logp.sum(dtype=np.float64)
        d_word[np.arange(len(rows)), at] -= 1
        grad["to_word"][g], grad["word_bias"][g] = d_word.T @ mine, sum_of(d_word)
        dh[rows] += d_word @ w["to_word"][part]
    d_next = np.zeros((len(inputs[-1]), size), dtype=np.float32)
    d_recur, back = np.zeros_like(recur), np.ascontiguousarray(recur.transpose(0, 2, 1))
    d_inputs = np.empty((n, 3, size), dtype=np.float32)
    for t in range(len(inputs) - 1, -1, -1):
        before, z, r, inner, c = trace[t]
        low, high = ends[t] - len(before), ends[t]
        d = dh[low:high]
        d[: len(d_next)] += d_next
        da = np.empty((3, len(d), size), dtype=dh.dtype)
        dz, dr, dc = da
        d_next = d * z
        np.subtract(d, d_next, out=dc)
        np.multiply(dc, z, out=dz)
        dz *= before - c
        c *= c
        np.subtract(1, c, out=c)
        dc *= c
        np.multiply(inner, dc, out=dr)
        dr *= r
        d_inputs[low:high, 2] = dc
        dc *= r
        np.subtract(1, r, out=r)
        dr *= r
        d_inputs[low:high, :2] = da[:2].transpose(1, 0, 2)
        d_recur += np.matmul(before.T, da)
        d_next += np.matmul(da, back).sum(axis=0)
        d_next[starts[t]] = 0
    grad["recur"] = d_recur.transpose(1, 0, 2).reshape(size, 3 * size)
    ids = np.concatenate(inputs)
    order = by_value(ids)
    rows, first = np.unique(ids[order], return_index=True)
    grad["inputs"] = rows, sums_of(d_inputs.reshape(n, 3 * size)[order], first)
    return loss, grad, h


class Trainer:
    """Adagrad over windows of lanes; only touched rows are updated."""

    def __init__(self, w: Weights, shape: Shape, rate: float = 0.15, lanes: int = 512, window: int = 16, stretch: int = 1024) -> None:
        self.w, self.shape, self.rate, self.lanes, self.window, self.stretch = {k: v.copy() for k, v in w.items()}, shape, rate, lanes, window, stretch
        self.square = {k: np.full_like(v, 1e-2) for k, v in w.items()}
        self.tokens, self.loss = 0, 0.0

    def update(self, name: str, at, grad: np.ndarray) -> None:
        norm = np.sqrt((grad * grad).sum())
        if norm > 5:
            grad = grad * (5 / norm)
        square = self.square[name][at] + grad * grad
        self.square[name][at] = square
        self.w[name][at] -= self.rate * grad / np.sqrt(square)

    def update_classes(self, name: str, grads: dict[int, np.ndarray], scale: np.float32) -> None:
        """:meth:`update` of the rows of each class, all at once."""
        at, grad = np.array(list(grads)), np.stack(list(grads.values())) * scale
        square, w = (x[name].reshape(-1, self.shape.class_size, *grad.shape[2:]) for x in (self.square, self.w))
        power = grad * grad
        norm = np.sqrt(power.reshape(len(at), -1).sum(axis=1))
        shrink = (np.float32(5) / np.maximum(norm, np.float32(5))).reshape(-1, *[1] * (grad.ndim - 1))
        grad *= shrink
        power *= shrink * shrink
        power += square[at]
        square[at] = power
        np.sqrt(power, out=power)
        grad *= np.float32(self.rate)
        grad /= power
        w[at] -= grad

    def learn(self, docs: list[np.ndarray]) -> None:
        """One pass over all words of the documents. Long ones are cut into stretches
        of equal use to the lanes, which start like texts; nothing is left out."""
        cuts = [(d, at) for d in docs for at in range(0, max(1, len(d)), self.stretch)]
        lanes = lanes_of([d[at : at + self.stretch] for d, at in cuts], self.lanes, {k for k, (d, at) in enumerate(cuts) if at + self.stretch < len(d)})
        h = np.zeros((lanes.targets.shape[1], self.shape.hidden), dtype=np.float32)
        for low in range(0, len(lanes.active), self.window):
            steps = range(low, min(low + self.window, len(lanes.active)))
            cut = [[x[t, : lanes.active[t]] for t in steps] for x in (lanes.inputs, lanes.targets, lanes.starts)]
            loss, grad, h = gradients(self.w, h, *cut, self.shape)
            n = sum(map(len, cut[0]))
            scale = np.float32(1 / max(1.0, n / 64))
            for name in ("recur", "to_class", "class_bias"):
                self.update(name, slice(None), grad[name] * scale)
            self.update("inputs", grad["inputs"][0], grad["inputs"][1] * scale)
            if grad["to_word"]:
                for name in ("to_word", "word_bias"):
                    self.update_classes(name, grad[name], scale)
            self.tokens += n
            self.loss += loss
