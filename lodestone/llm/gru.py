"""A small gated recurrent language model in numpy.

Words are predicted in two steps, a class and a word within it; classes are
bins of the frequency-ordered vocabulary of about equal summed square-root
counts.  Training back-propagates through windows of a fixed number of steps
and carries the state from each window to the next; scoring carries it through
the whole document.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

Parameters = dict[str, np.ndarray]
#: Parameters that are updated at a time.
BLOCK = 32_768


@dataclass(frozen=True)
class Shape:
    """Vocabulary items in order of descending count, their counts and the bounds of their classes."""

    counts: np.ndarray
    hidden: int
    bounds: np.ndarray = field(default=None)  # class k holds items bounds[k] to bounds[k + 1]
    class_of: np.ndarray = field(default=None)

    @staticmethod
    def of(counts: np.ndarray, classes: int, hidden: int, alone: int | None = None) -> Shape:
        """alone: an item that is a class by itself."""
        share = np.cumsum(np.sqrt(counts + 1.0))
        cuts = np.searchsorted(share, share[-1] * np.arange(1, classes) / classes)
        around = [] if alone is None else [alone, alone + 1]
        bounds = np.unique(np.concatenate(([0], cuts, around, [len(counts)]))).astype(np.int64)
        return Shape(counts, hidden, bounds, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)))


def initial(shape: Shape, seed: int = 0) -> Parameters:
    """Parameters with which the model is the smoothed unigram model, whatever its state."""
    rng, h, v = np.random.default_rng(seed), shape.hidden, len(shape.counts)
    smooth = shape.counts + 1.0
    mass = np.add.reduceat(smooth, shape.bounds[:-1])
    draw = lambda *size: rng.normal(0, 0.3, size).astype(np.float32)
    return {
        "input": draw(v, 3 * h),
        "gates": draw(h, 2 * h) / np.float32(np.sqrt(h)),
        "state": draw(h, h) / np.float32(np.sqrt(h)),
        "to_class": np.zeros((h, len(mass)), np.float32),
        "class_bias": np.log(mass / mass.sum()).astype(np.float32),
        "to_word": np.zeros((v, h), np.float32),
        "word_bias": np.log(smooth / mass[shape.class_of]).astype(np.float32),
    }


def _scaled(p: Parameters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, and weights to gates and candidate by unit, of sign and size as _logistic wants them."""
    n, by = len(p["state"]), p["state"].dtype.type
    inputs = p["input"] * np.repeat([by(-1), by(-2)], [2 * n, n])
    return inputs, p["gates"].T * by(-1), np.ascontiguousarray(p["state"].T) * by(-2)


def _logistic(x: np.ndarray) -> None:
    """The logistic function of -x, in place; an exponential costs half a hyperbolic tangent."""
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


def _tangent(x: np.ndarray) -> None:
    """The hyperbolic tangent of -x / 2, in place."""
    _logistic(x)
    x *= 2
    x -= 1


def _given(inputs: np.ndarray, items: np.ndarray) -> np.ndarray:
    """What items (..., width) give gates and candidate: (..., 3 hidden, width)."""
    return np.ascontiguousarray(np.swapaxes(inputs[items], -1, -2))


def _narrow(x: np.ndarray, most: int) -> np.ndarray:
    """Whole numbers below most, which sort in few passes where they fit into 16 bits."""
    return x.astype(np.uint16) if most <= 1 << 16 else x


def _steep(weights: np.ndarray) -> bool:
    """Whether an exponential over states (from -1 to 1, and a one for the bias) could grow too large."""
    return float((np.abs(weights) @ np.ones(weights.shape[1], weights.dtype)).max()) > 60


@dataclass(frozen=True)
class Softmaxes:
    """Softmaxes of many rows over parts of the weights' rows, whose values lie one after another in one array, so that most steps take all at once."""

    weights: np.ndarray
    parts: list[tuple[int, int, int, int, int]]  # first row, end row, first and end row of the weights, first place of the values
    place: np.ndarray  # of each row's target among the values; the last place is for rows that no part holds
    values: np.ndarray
    total: np.ndarray

    @staticmethod
    def of(used: np.ndarray, weights: np.ndarray, parts: list[tuple[int, int, int, int, int]], place: np.ndarray, steep: bool) -> tuple[Softmaxes, np.ndarray]:
        """Exponentials and their sums, and the log softmax of each row at its target."""
        i, j, a, b, at = parts[-1] if parts else (0, 0, 0, 0, 0)
        values, total = np.empty(at + (j - i) * (b - a) + 1, used.dtype), np.ones(len(used), used.dtype)
        values[-1] = 0
        s = Softmaxes(weights, parts, place, values, total)
        for x, (i, j, a, b, _) in zip(s.tables(), parts, strict=True):
            np.matmul(used[i:j], weights[a:b].T, out=x)
            if steep:
                x -= x.max(axis=1, keepdims=True)
        wanted = values[place]
        np.exp(values, out=values)
        ones = np.ones(max((b - a for _, _, a, b, _ in parts), default=0), used.dtype)
        for x, (i, j, a, b, _) in zip(s.tables(), parts, strict=True):
            np.matmul(x, ones[: b - a], out=total[i:j])
        return s, wanted - np.log(total)

    def tables(self) -> Iterator[np.ndarray]:
        for i, j, a, b, at in self.parts:
            yield self.values[at : at + (j - i) * (b - a)].reshape(j - i, b - a)

    def gradient(self, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the summed negative log softmax, by the weights and by used less its last column, the biases' ones; to be asked for once."""
        self.values[self.place] -= self.total
        scale = (1 / self.total)[:, None]
        scaled, n = used * scale, used.shape[1] - 1
        by_weights, by_used = np.zeros_like(self.weights), np.zeros((len(used), n), used.dtype)
        for x, (i, j, a, b, _) in zip(self.tables(), self.parts, strict=True):
            np.matmul(x.T, scaled[i:j], out=by_weights[a:b])
            np.matmul(x, self.weights[a:b, :n], out=by_used[i:j])
        by_used *= scale
        return by_weights, by_used


def _by_class(shape: Shape, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, int, int]], np.ndarray]:
    """An order by class, the classes in it, and the parts and places of the softmaxes within classes of several words."""
    classes = shape.class_of[targets]
    order = np.argsort(_narrow(classes, len(shape.bounds)), kind="stable")
    classes = classes[order]
    edges = np.searchsorted(classes, np.arange(len(shape.bounds)))
    sizes = np.diff(shape.bounds)
    cells = np.where(sizes > 1, np.diff(edges) * sizes, 0)
    starts = np.cumsum(cells) - cells
    place = (starts - shape.bounds[:-1] - edges[:-1] * sizes)[classes] + np.arange(len(order)) * sizes[classes] + targets[order]
    place[sizes[classes] == 1] = cells.sum()
    parts = zip(edges[:-1].tolist(), edges[1:].tolist(), shape.bounds[:-1].tolist(), shape.bounds[1:].tolist(), starts.tolist(), strict=True)
    return order, classes, [x for x in parts if x[0] < x[1] and x[3] - x[2] > 1], place


def _with_biases(p: Parameters) -> tuple[tuple[np.ndarray, bool], tuple[np.ndarray, bool]]:
    """Weights to classes and to words, a row each and the biases as a last column, and whether they are steep."""
    both = np.concatenate((p["to_class"].T, p["class_bias"][:, None]), axis=1), np.concatenate((p["to_word"], p["word_bias"][:, None]), axis=1)
    return tuple((w, _steep(w)) for w in both)


def _predicted(shape: Shape, weights: tuple[tuple[np.ndarray, bool], tuple[np.ndarray, bool]], states: np.ndarray, targets: np.ndarray, where: np.ndarray | None = None):
    """An order of targets, their states (all, or those at where) in it, and softmaxes over classes and within them, with their logs at the targets."""
    (to_class, steep_class), (to_word, steep_word) = weights
    order, classes, parts, place = _by_class(shape, targets)
    used = np.ones((len(order), shape.hidden + 1), states.dtype)  # the last column carries the biases
    used[:, :-1] = states[order if where is None else where[order]]
    outer = Softmaxes.of(used, to_class, [(0, len(order), 0, len(to_class), 0)], np.arange(len(order)) * len(to_class) + classes, steep_class)
    return order, used, outer, Softmaxes.of(used, to_word, parts, place, steep_word)


def log_probability(p: Parameters, shape: Shape, states: np.ndarray, targets: np.ndarray, weights: tuple[tuple[np.ndarray, bool], tuple[np.ndarray, bool]] | None = None) -> np.ndarray:
    """Natural log probability of each target after each state."""
    order, _, (_, outer), (_, inner) = _predicted(shape, weights or _with_biases(p), states, targets)
    out = np.empty_like(inner)
    out[order] = outer + inner
    return out


#: Rows of one item over which they are added up by themselves.
OFTEN = 6


def _summed(rows: np.ndarray, items: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Each item that occurs, and the sum of its rows: of items that occur seldom their first rows, their second rows and so on at once."""
    order = np.argsort(_narrow(items, most), kind="stable")
    items, rows = items[order], rows[order]
    first = np.flatnonzero(np.concatenate(([True], items[1:] != items[:-1])))
    counts = np.diff(first, append=len(items))
    falling = np.argsort(-counts, kind="stable")
    first, counts = first[falling], counts[falling]
    out, ones = rows[first], np.ones(counts[0], rows.dtype)
    more = np.searchsorted(-counts, -np.arange(OFTEN + 1)).tolist()  # items of more than so many rows
    often = more[OFTEN]
    for k, (at, n) in enumerate(zip(first[:often].tolist(), counts[:often].tolist(), strict=True)):
        np.matmul(ones[:n], rows[at : at + n], out=out[k])
    for k in range(1, OFTEN):
        out[often : more[k]] += rows[first[often : more[k]] + k]
    return items[first], out


@np.errstate(over="ignore")  # of _logistic: one by infinity is zero
def loss_gradient(p: Parameters, shape: Shape, inputs: np.ndarray, targets: np.ndarray, resets: np.ndarray, state: np.ndarray, active: np.ndarray) -> tuple[float, Parameters, np.ndarray]:
    """Summed loss of a window (steps by lanes), its gradient through the window, and the last state.

    resets: where a document begins; active: where there is a target.  Within,
    units come before lanes, so that a step's gates lie side by side.
    """
    (steps, width), n = inputs.shape, shape.hidden
    g = {"input": np.zeros_like(p["input"])}
    before, reset, c, states = (np.empty((steps, n, width), state.dtype) for _ in range(4))
    gates = np.empty((steps, 2 * n, width), state.dtype)
    table, to_gates, to_state = _scaled(p)
    given, on, new = _given(table, inputs), (~resets).astype(state.dtype), resets.any(axis=1).tolist()
    h = np.ascontiguousarray(state.T)
    for t in range(steps):
        np.multiply(h, on[t], out=before[t])
        h, a, candidate = before[t], gates[t], c[t]
        np.matmul(to_gates, h, out=a)
        a += given[t, : 2 * n]
        _logistic(a)
        np.multiply(a[n:], h, out=reset[t])
        np.matmul(to_state, reset[t], out=candidate)
        candidate += given[t, 2 * n :]
        _tangent(candidate)
        np.subtract(candidate, h, out=states[t])
        states[t] *= a[:n]
        states[t] += h
        h = states[t]
    where = np.flatnonzero(active.ravel())
    order, used, (outer, log_outer), (inner, log_inner) = _predicted(shape, _with_biases(p), states.transpose(0, 2, 1).reshape(-1, n), targets.ravel()[where], where)
    loss = -float((log_outer + log_inner).sum(dtype=np.float64))
    both, d_used = outer.gradient(used)
    g["to_class"], g["class_bias"] = np.ascontiguousarray(both[:, :n].T), both[:, n].copy()
    both, d_inner = inner.gradient(used)
    g["to_word"], g["word_bias"] = np.ascontiguousarray(both[:, :n]), both[:, n].copy()
    d_used += d_inner
    where = where[order]
    d_states = np.zeros((steps * width, n), state.dtype)
    d_states[where] = d_used
    d_states = np.ascontiguousarray(d_states.reshape(steps, width, n).transpose(0, 2, 1))
    z, r = gates[:, :n], gates[:, n:]
    keep = 1 - z
    to_z, to_c, to_r = c - before, c * c, 1 - r
    to_z *= z
    to_z *= keep
    np.subtract(1, to_c, out=to_c)
    to_c *= z
    to_r *= reset
    d_given = np.empty((steps, 3 * n, width), state.dtype)
    d_h = np.zeros((n, width), state.dtype)
    for t in range(steps - 1, -1, -1):
        d_h += d_states[t]
        here = d_given[t]
        np.multiply(d_h, to_c[t], out=here[2 * n :])
        d_rh = p["state"] @ here[2 * n :]
        np.multiply(d_h, to_z[t], out=here[:n])
        np.multiply(d_rh, to_r[t], out=here[n : 2 * n])
        d_h *= keep[t]
        d_rh *= r[t]
        d_h += d_rh
        d_h += p["gates"] @ here[: 2 * n]
        if new[t]:
            d_h *= on[t]
    g["gates"] = np.matmul(before, d_given[:, : 2 * n].transpose(0, 2, 1)).sum(axis=0)
    g["state"] = np.matmul(reset, d_given[:, 2 * n :].transpose(0, 2, 1)).sum(axis=0)
    found, sums = _summed(d_given.transpose(0, 2, 1).reshape(-1, 3 * n), inputs.ravel(), len(shape.counts))
    g["input"][found] = sums
    return loss, g, np.ascontiguousarray(h.T)


def lanes_of(documents: list[np.ndarray], most: int) -> list[list[int]]:
    """Documents dealt to lanes of about equal summed length, longest lane first."""
    count = max(1, min(most, len(documents)))
    heap = [(0, i) for i in range(count)]
    lanes: list[list[int]] = [[] for _ in range(count)]
    for i in sorted(range(len(documents)), key=lambda i: -len(documents[i])):
        length, lane = heapq.heappop(heap)
        lanes[lane].append(i)
        heapq.heappush(heap, (length + len(documents[i]), lane))
    return sorted(lanes, key=lambda lane: -sum(len(documents[i]) for i in lane))


class Unrolled:
    """Documents by step and lane, without padding: lanes are in order of length, so the active ones of a step come first."""

    def __init__(self, documents: list[np.ndarray], start: int, most: int):
        lanes = lanes_of(documents, most)
        lengths = np.array([sum(len(documents[i]) for i in lane) for lane in lanes])
        self.steps = int(lengths[0])
        self.width = np.searchsorted(-lengths, -np.arange(self.steps), side="left")
        self.first = np.concatenate(([0], np.cumsum(self.width)))
        total = int(self.first[-1])
        self.inputs, self.targets = np.full(total, start, np.int32), np.empty(total, np.int32)
        self.resets, self.owner = np.zeros(total, bool), np.empty(total, np.int32)
        for row, lane in enumerate(lanes):
            at = 0
            for i in lane:
                n = len(documents[i])
                place = self.first[at : at + n] + row
                self.targets[place] = documents[i]
                self.inputs[place[1:]] = documents[i][:-1]
                self.resets[place[0]] = True
                self.owner[place] = i
                at += n


@np.errstate(over="ignore")  # of _logistic: one by infinity is zero
def score(p: Parameters, shape: Shape, documents: list[np.ndarray], start: int, lanes: int = 512, window: int = 16) -> np.ndarray:
    """Natural log probability of each document (item numbers, end included), its state carried through all of it."""
    out = np.zeros(len(documents))
    if not documents:
        return out
    u, n = Unrolled(documents, start, lanes), shape.hidden
    table, to_gates, to_state = _scaled(p)
    h = np.zeros((n, int(u.width[0])), np.float32)
    first = u.first.tolist()
    new = set(np.searchsorted(u.first, np.flatnonzero(u.resets), side="right").tolist())  # steps in which a document begins, from 1
    begun, t, weights = 0, 0, _with_biases(p)
    while t < u.steps:
        end = min(u.steps, max(t + 1, int(np.searchsorted(u.first, begun + lanes * window))))
        states, given = np.empty((n, first[end] - begun), np.float32), _given(table, u.inputs[begun : first[end]])
        for k in range(t, end):
            a, b = first[k] - begun, first[k + 1] - begun
            h = h[:, : b - a]
            if k + 1 in new:
                h = h * ~u.resets[begun + a : begun + b]
            gates = to_gates @ h
            gates += given[: 2 * n, a:b]
            _logistic(gates)
            candidate = to_state @ (gates[n:] * h)
            candidate += given[2 * n :, a:b]
            _tangent(candidate)
            candidate -= h
            candidate *= gates[:n]
            candidate += h
            states[:, a:b] = h = candidate
        logp = log_probability(p, shape, states.T, u.targets[begun : first[end]], weights)
        out += np.bincount(u.owner[begun : first[end]], weights=logp, minlength=len(out))
        begun, t = first[end], end
    return out


class Trainer:
    """Adam over truncated back-propagation, on documents as they come.

    Every document goes whole to the lane that has least before it; lanes are
    streams of documents, and a window takes the next steps of all of them.
    As each document ends with the end item, that is also the first input of
    the next, and where the state begins anew.
    """

    def __init__(self, parameters: Parameters, shape: Shape, end: int, rate: float = 0.01, lanes: int = 256, window: int = 16, least: int = 1024):
        self.p = {k: v.copy() for k, v in parameters.items()}
        self.shape, self.end, self.rate, self.window, self.least = shape, end, rate, window, least
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.steps = self.tokens = 0
        self.loss = 0.0
        self.lanes: list[deque[np.ndarray]] = [deque() for _ in range(lanes)]
        self.given = [(0, i) for i in range(lanes)]  # a heap by all that a lane was given
        self.taken = 0  # of each lane
        self.state = np.zeros((lanes, shape.hidden), np.float32)
        self.last = np.full(lanes, end, np.int32)
        self.waiting: tuple[int, Parameters] | None = None

    def add(self, document: np.ndarray) -> None:
        """Train on a document (item numbers, end included), now or when all lanes have as much."""
        given, lane = self.given[0]
        self.lanes[lane].append(document)
        heapq.heapreplace(self.given, (given + len(document), lane))
        block = 8 * self.window
        while self.given[0][0] - self.taken >= block:
            targets = np.stack([self._next(lane, block) for lane in self.lanes], axis=1)
            self.taken += block
            inputs = np.concatenate((self.last[None], targets[:-1]))
            self.last = targets[-1]
            for at in range(0, block, self.window):
                self._learn(inputs[at : at + self.window], targets[at : at + self.window], np.ones((self.window, len(self.lanes)), bool))

    @staticmethod
    def _next(lane: deque[np.ndarray], most: int) -> np.ndarray:
        """Up to so many items of a lane, which it loses."""
        parts, size = [], 0
        while lane and size < most:
            part = lane.popleft()
            if len(part) > most - size:
                lane.appendleft(part[most - size :])
                part = part[: most - size]
            parts.append(part)
            size += len(part)
        return np.concatenate(parts) if parts else np.empty(0, np.int32)

    def finish(self) -> None:
        """Train on what the lanes still hold, the longest first, so that the active ones stay together."""
        rest = [np.concatenate(lane) if lane else np.empty(0, np.int32) for lane in self.lanes]
        order = sorted(range(len(rest)), key=lambda i: -len(rest[i]))
        lengths = np.array([len(rest[i]) for i in order])
        self.state, self.last = self.state[order], self.last[order]
        at = 0
        while at < lengths[0]:
            width = int(np.searchsorted(-lengths, -at))
            size = min(self.window * max(1, min(8, 64 // width)), int(lengths[0]) - at)  # few lanes take longer windows
            targets = np.full((size, width), self.end, np.int32)
            for k in range(width):
                part = rest[order[k]][at : at + size]
                targets[: len(part), k] = part
            inputs = np.concatenate((self.last[None, :width], targets[:-1]))
            self.state, self.last = self.state[:width], targets[-1]
            self._learn(inputs, targets, np.arange(at, at + size)[:, None] < lengths[:width])
            at += size
        if self.waiting:
            self._update(*self.waiting)
        self.lanes, self.waiting = [], None

    def _learn(self, inputs: np.ndarray, targets: np.ndarray, active: np.ndarray) -> None:
        loss, g, self.state = loss_gradient(self.p, self.shape, inputs, targets, inputs == self.end, self.state, active)
        count = int(active.sum())
        self.loss += loss
        self.tokens += count
        if self.waiting:  # few lanes are left: several windows make one step
            count += self.waiting[0]
            for k, v in self.waiting[1].items():
                g[k] += v
        self.waiting = None
        if count >= self.least:
            self._update(count, g)
        else:
            self.waiting = count, g

    def _update(self, count: int, g: Parameters) -> None:
        self.steps += 1
        a, b = 0.9, 0.99
        # the running means are kept as sums, which are 1 / (1 - a) and 1 / (1 - b) times as much
        scale = self.rate * np.sqrt(1 - b**self.steps) / (1 - a**self.steps) * (1 - a) / np.sqrt(1 - b)
        for k in self.p:
            whole = [x.reshape(-1) for x in (self.p[k], g[k], self.m[k], self.v[k])]
            for at in range(0, len(whole[0]), BLOCK):  # a block's values stay in the cache
                v, d, m, s = (x[at : at + BLOCK] for x in whole)
                d *= np.float32(1 / count)
                np.clip(d, -1, 1, out=d)
                m *= np.float32(a)
                m += d
                s *= np.float32(b)
                d *= d
                s += d
                np.sqrt(s, out=d)
                d += np.float32(1e-6 / np.sqrt(1 - b))
                np.divide(m, d, out=d)
                d *= np.float32(scale)
                v -= d


def packed(p: Parameters) -> bytes:
    return b"".join(np.ascontiguousarray(p[k], np.float32).tobytes() for k in sorted(p))


def unpacked(data: np.ndarray, like: Parameters) -> Parameters:
    out, at = {}, 0
    for k in sorted(like):
        n = like[k].size
        out[k] = data[at : at + n].reshape(like[k].shape).astype(np.float32)
        at += n
    return out
