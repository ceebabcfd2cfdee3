"""Learned partitions: a neighbour graph cut into balanced parts, and small classifiers that send vectors and queries to them.

Everything here works on a bounded sample.  Inner products become cosines by
one more component: a vector is divided by the greatest length of all and gets
what it lacks to length 1, a query has length 1 and 0 there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Neighbours of a sampled vector in the graph.
GRAPH_NEIGHBOURS = 10
#: A part may be so much larger than the mean.
SLACK = 1.05
#: Share of the sample's neighbours that the probed parts have to hold, measured on vectors that the router was not fitted to.
RECALL = 0.96
_BLOCK = 1024


def vector_features(x: np.ndarray, longest: float) -> np.ndarray:
    x = x.astype(np.float64) / longest
    return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))])


def query_features(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return np.hstack([x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300), np.zeros((len(x), 1))])


def nearest(queries: np.ndarray, rows: np.ndarray, k: int, itself: bool = True) -> np.ndarray:
    """Places of the k rows of largest inner product for each query; with itself, query i is row i and does not count."""
    out = np.empty((len(queries), k), np.int64)
    for at in range(0, len(queries), _BLOCK):
        score = queries[at : at + _BLOCK] @ rows.T
        if itself:
            score[np.arange(len(score)), np.arange(at, at + len(score))] = -np.inf
        out[at : at + _BLOCK] = np.argpartition(-score, k - 1, axis=1)[:, :k]
    return out


def _halves(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Which half of the rows each is in: two means, with the cut at the median so that both have as many."""
    a, b = x[rng.choice(len(x), 2, replace=False)]
    for _ in range(8):
        upper = np.zeros(len(x), bool)
        upper[np.argsort(x @ (a - b), kind="stable")[len(x) // 2 :]] = True
        a, b = x[upper].mean(axis=0), x[~upper].mean(axis=0)
    return upper


def balanced_parts(x: np.ndarray, graph: np.ndarray, n_parts: int, rng: np.random.Generator) -> np.ndarray:
    """Parts of about equal size that cut few edges: halved again and again, then moved along the graph while a part has room."""
    part = np.zeros(len(x), np.int64)
    for level in range(n_parts.bit_length() - 1):
        for p in range(1 << level):
            rows = np.nonzero(part == p)[0]
            part[rows[_halves(x[rows], rng)]] += 1 << level
    room, size = int(np.ceil(SLACK * len(x) / n_parts)), np.bincount(part, minlength=n_parts)
    ends = np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()
    for _ in range(10):
        links = np.zeros((len(x), n_parts))
        np.add.at(links, (ends[0], part[ends[1]]), 1)
        np.add.at(links, (ends[1], part[ends[0]]), 1)
        best = links.argmax(axis=1)
        gain = links[np.arange(len(x)), best] - links[np.arange(len(x)), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < room:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i], moved = best[i], moved + 1
        if not moved:
            break
    return part


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_softmax(x: np.ndarray, target: np.ndarray, steps: int = 200, rate: float = 0.2, decay: float = 1e-5) -> np.ndarray:
    """Weights (inputs and one constant, classes) of a softmax classifier for target distributions."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros((x.shape[1], target.shape[1]))
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        slope = x.T @ (_softmax(x @ w) - target) / len(x) + decay * w
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        w -= rate * (1 - t / (steps + 1)) * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-9)
    return w


def _scores(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def _shares(part: np.ndarray, neighbours: np.ndarray, n_parts: int) -> np.ndarray:
    """Which share of its neighbours lies in each part."""
    out = np.zeros((len(neighbours), n_parts))
    np.add.at(out, (np.repeat(np.arange(len(neighbours)), neighbours.shape[1]), part[neighbours].ravel()), 1 / neighbours.shape[1])
    return out


@dataclass
class Router:
    """Sends a vector to one part, and a query to the most probable parts until they hold enough of its neighbours."""

    longest: float
    assign: np.ndarray
    route: np.ndarray
    mass: float

    @property
    def n_parts(self) -> int:
        return self.assign.shape[1]

    def part(self, x: np.ndarray) -> np.ndarray:
        return _scores(vector_features(x, self.longest), self.assign).argmax(axis=1)

    def probes(self, x: np.ndarray, mass: float | None = None) -> np.ndarray:
        """(queries, parts): which parts a query probes."""
        p = _softmax(_scores(query_features(x), self.route))
        order = np.argsort(-p, axis=1, kind="stable")
        ranked = np.take_along_axis(p, order, axis=1)
        before = np.cumsum(ranked, axis=1) - ranked
        out = np.zeros(p.shape, bool)
        np.put_along_axis(out, order, before < (self.mass if mass is None else mass), axis=1)
        return out


def fit(sample: np.ndarray, longest: float, n_parts: int, k: int, seed: int = 11) -> Router:
    """A router fitted to a sample, its probing set so that RECALL of the sample's nearest k are found."""
    rng = np.random.default_rng(seed)
    while n_parts > 1 and len(sample) < 8 * n_parts:
        n_parts //= 2
    d = sample.shape[1] + 1
    if n_parts == 1:
        return Router(longest, np.zeros((d + 1, 1)), np.zeros((d + 1, 1)), 2.0)
    x, q = vector_features(sample, longest), query_features(sample)
    graph = nearest(x, x, min(GRAPH_NEIGHBOURS, len(x) - 1))
    part = balanced_parts(x, graph, n_parts, rng)
    own = np.hstack([np.arange(len(x))[:, None], graph])
    assign = fit_softmax(x, _shares(part, own, n_parts))
    router = Router(longest, assign, np.zeros_like(assign), 2.0)
    part = router.part(sample)
    found = nearest(q, x, min(k, len(x) - 1))
    shares, held_out = _shares(part, found, n_parts), rng.random(len(x)) < 0.25
    if not held_out.any() or held_out.all():
        return router
    router.route = fit_softmax(q[~held_out], shares[~held_out])
    for mass in (*np.arange(0.5, 1, 0.01), 0.995, 0.998, 0.999, 0.9999, 2.0):  # 2 probes all
        if (router.probes(sample[held_out], mass) * shares[held_out]).sum(axis=1).mean() >= RECALL:
            router.mass = float(mass)
            break
    return router
