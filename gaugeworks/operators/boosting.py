"""Gradient boosting on binned columns, for one cell: what a task does with a split that fits it.

Columns are codes of at most 255 bins, a byte each. A node's gradient sums by column and bin tell every split's gain; of two children only the smaller one is summed
anew. Categories are ordered by their mean gradient in the node, so that a split takes any set that lies on one side of that order. Trees grow by `depth`, level
by level, by `leaves`, best gain first, or `symmetric`, one split for all nodes of a level. The loss on rows set apart stops the boosting, and the best number of rounds is kept.

Tasks: two classes (one tree a round on the log-odds), several (a tree a class on the softmax), regression (squared error). Without columns, or with one class, the model is
its base score.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np

BINS = 255


@dataclass
class Bins:
    """How columns become codes: cuts of numeric ones, sorted values of categorical ones (code 0 is a value that training rows lack)."""

    cuts: list[np.ndarray]
    values: list[np.ndarray]

    @property
    def categorical(self) -> np.ndarray:
        return np.array([False] * len(self.cuts) + [True] * len(self.values))

    def codes(self, num: np.ndarray, cat: np.ndarray) -> np.ndarray:
        out = np.zeros((len(num), len(self.cuts) + len(self.values)), np.uint8, order="F")
        for j, c in enumerate(self.cuts):
            out[:, j] = np.searchsorted(c, num[:, j], side="left")
        for j, v in enumerate(self.values):
            at = np.minimum(np.searchsorted(v, cat[:, j]), len(v) - 1)
            out[:, len(self.cuts) + j] = np.where(v[at] == cat[:, j], np.minimum(at + 1, BINS - 1), 0)
        return out


def binned(num: np.ndarray, cat: np.ndarray, rows: np.ndarray | slice = slice(None)) -> Bins:
    """Cuts at quantiles of training rows (between all values, if they are few), and their categories; rows: which are."""

    def cuts(x: np.ndarray) -> np.ndarray:
        own = np.unique(x)
        return (own[1:] + own[:-1]) / 2 if len(own) <= BINS else np.unique(np.quantile(x, np.arange(1, BINS) / BINS))

    return Bins([cuts(num[rows, j]) for j in range(num.shape[1])], [np.unique(cat[rows, j]) for j in range(cat.shape[1])])


@dataclass
class Settings:
    grow: str = "depth"  # depth, leaves or symmetric
    depth: int = 6
    leaves: int = 31
    rate: float = 0.1
    ridge: float = 1.0
    least: int = 1  # rows in a leaf
    rows: float = 1.0  # share of rows, and of columns, that a tree sees
    columns: float = 1.0


@dataclass
class Tree:
    """Nodes by number: column (-1 for a leaf), the codes that go left, the left child (the right one follows it), value."""

    column: list[int] = field(default_factory=list)
    left: list[np.ndarray | None] = field(default_factory=list)
    child: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        self.column.append(-1)
        self.left.append(None)
        self.child.append(0)
        self.value.append(value)
        return len(self.value) - 1

    def split(self, node: int, column: int, left: np.ndarray, values: tuple[float, float]) -> tuple[int, int]:
        self.column[node], self.left[node] = column, left
        self.child[node] = self.add(values[0])
        return self.child[node], self.add(values[1])

    def predict(self, codes: np.ndarray) -> np.ndarray:
        out, todo = np.empty(len(codes)), [(0, np.arange(len(codes)))]
        while todo:
            node, rows = todo.pop()
            if self.column[node] < 0:
                out[rows] = self.value[node]
                continue
            left = self.left[node][codes[rows, self.column[node]]]
            todo += [(self.child[node], rows[left]), (self.child[node] + 1, rows[~left])]
        return out


class _Grower:
    def __init__(self, codes: np.ndarray, g: np.ndarray, h: np.ndarray, categorical: np.ndarray, s: Settings, rng: np.random.Generator):
        self.codes, self.g, self.h, self.categorical, self.s = codes, g, h, categorical, s
        f = codes.shape[1]
        self.allowed = np.ones(f, bool)
        if s.columns < 1:
            self.allowed[rng.permutation(f)[max(1, round(s.columns * f)) :]] = False

    def sums(self, rows: np.ndarray) -> np.ndarray:
        """(3, columns, bins): gradients, curvatures and rows; column by column, so that what it takes beside the codes doesn't grow with their number."""
        out = np.empty((3, self.codes.shape[1], BINS))
        g, h = self.g[rows], self.h[rows]
        for j in range(self.codes.shape[1]):
            at = self.codes[rows, j].astype(np.intp)
            out[0, j], out[1, j], out[2, j] = np.bincount(at, g, BINS), np.bincount(at, h, BINS), np.bincount(at, None, BINS)
        return out

    def value(self, hist: np.ndarray) -> float:
        g, h, _ = hist[:, 0].sum(axis=1)
        return -self.s.rate * g / (h + self.s.ridge)

    def gains(self, hist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gain of the split after each bin of each column, and the order of its bins."""
        g, h, n = hist
        order = np.tile(np.arange(BINS), (len(g), 1))
        if self.categorical.any():
            mean = np.where(n > 0, g / (h + self.s.ridge), np.inf)
            order[self.categorical] = np.argsort(mean[self.categorical], axis=1, kind="stable")
            g, h, n = (np.take_along_axis(x, order, 1) for x in (g, h, n))
        gl, hl, nl = g.cumsum(1), h.cumsum(1), n.cumsum(1)
        gt, ht, nt = gl[:, -1:], hl[:, -1:], nl[:, -1:]
        score = lambda a, b: a * a / (b + self.s.ridge)
        gain = score(gl, hl) + score(gt - gl, ht - hl) - score(gt, ht)
        fits = (nl >= self.s.least) & (nt - nl >= self.s.least) & self.allowed[:, None]
        return np.where(fits, gain, -np.inf), order

    @staticmethod
    def best(gain: np.ndarray, order: np.ndarray) -> tuple[float, int, np.ndarray]:
        at = int(gain.argmax())
        column, k = divmod(at, BINS)
        left = np.zeros(BINS, bool)
        left[order[column, : k + 1]] = True
        return float(gain.flat[at]), column, left

    def parted(self, rows: np.ndarray, hist: np.ndarray, column: int, left: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        goes = left[self.codes[rows, column]]
        sides = [rows[goes], rows[~goes]]
        small = int(len(sides[1]) < len(sides[0]))
        own = self.sums(sides[small])
        return [(sides[k], own if k == small else hist - own) for k in (0, 1)]

    def grow(self, rows: np.ndarray) -> Tree:
        tree, hist = Tree(), self.sums(rows)
        tree.add(self.value(hist))
        if self.s.grow == "symmetric":
            level = [(0, rows, hist)]
            for _ in range(self.s.depth):
                if self.categorical.any():  # one order for all nodes of the level
                    _, order = self.gains(sum(h for _, _, h in level))
                    gain = sum(self._in_order(h, order) for _, _, h in level)
                else:
                    found = [self.gains(h) for _, _, h in level]
                    gain, order = sum(np.where(np.isfinite(x), x, 0.0) for x, _ in found), found[0][1]
                gain = np.where(self.allowed[:, None], gain, -np.inf)
                best, column, left = self.best(gain, order)
                if not best > 1e-12:
                    break
                after = []
                for node, own, h in level:
                    sides = self.parted(own, h, column, left)
                    for n, (r, x) in zip(tree.split(node, column, left, tuple(self.value(x) if len(r) else tree.value[node] for r, x in sides)), sides, strict=True):
                        if len(r):  # a side without training rows is a leaf
                            after.append((n, r, x))
                level = after
            return tree
        most = self.s.leaves if self.s.grow == "leaves" else 1 << self.s.depth
        heap, leaves, tie = [], 1, 0

        def push(node: int, own: np.ndarray, h: np.ndarray, depth: int) -> None:
            nonlocal tie
            if len(own) < 2 * self.s.least or self.s.grow == "depth" and depth >= self.s.depth:
                return
            gain, column, left = self.best(*self.gains(h))
            if gain > 1e-12:
                tie += 1
                heapq.heappush(heap, (-gain if self.s.grow == "leaves" else depth, tie, node, own, h, column, left, depth))

        push(0, rows, hist, 0)
        while heap and leaves < most:
            _, _, node, own, h, column, left, depth = heapq.heappop(heap)
            sides = self.parted(own, h, column, left)
            for n, (r, x) in zip(tree.split(node, column, left, tuple(self.value(x) for _, x in sides)), sides, strict=True):
                push(n, r, x, depth + 1)
            leaves += 1
        return tree

    def _in_order(self, hist: np.ndarray, order: np.ndarray) -> np.ndarray:
        g, h, n = (np.take_along_axis(x, order, 1).cumsum(1) for x in hist)
        score = lambda a, b: a * a / (b + self.s.ridge)
        fits = (n >= self.s.least) & (n[:, -1:] - n >= self.s.least)
        return np.where(fits, score(g, h) + score(g[:, -1:] - g, h[:, -1:] - h) - score(g[:, -1:], h[:, -1:]), 0.0)


@dataclass
class Model:
    base: np.ndarray
    rounds: list[list[Tree]]
    best: int | None  # the round, from 0, whose loss on the rows set apart was least
    regression: bool

    def raw(self, codes: np.ndarray) -> np.ndarray:
        out = np.tile(self.base, (len(codes), 1))
        for trees in self.rounds:
            for k, t in enumerate(trees):
                out[:, k] += t.predict(codes)
        return out

    def predict(self, codes: np.ndarray) -> np.ndarray:
        """Means, or probabilities of all classes."""
        raw = self.raw(codes)
        return raw[:, 0] if self.regression else _probabilities(raw)


def _probabilities(raw: np.ndarray) -> np.ndarray:
    if raw.shape[1] == 1:
        p = 1 / (1 + np.exp(-np.clip(raw[:, 0], -500, 500)))
        return np.stack([1 - p, p], axis=1)
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _loss(raw: np.ndarray, y: np.ndarray, regression: bool) -> float:
    if regression:
        return float(np.sqrt(np.mean((raw[:, 0] - y) ** 2)))
    return float(-np.mean(np.log(np.maximum(_probabilities(raw)[np.arange(len(y)), y.astype(int)], 1e-15))))


def fit(codes: np.ndarray, y: np.ndarray, categorical: np.ndarray, classes: int, s: Settings, rounds: int, apart: tuple[np.ndarray, np.ndarray] | None = None, patience: int = 50, seed: int = 0) -> Model:
    """classes: 1 for regression. apart: codes and y of rows that stop the boosting after `patience` rounds without a lesser loss."""
    regression, rng, n = classes == 1, np.random.default_rng(seed), len(y)
    codes = np.asfortranarray(codes)
    width = 1 if regression or classes == 2 else classes
    if regression:
        base = np.array([y.mean()])
    else:
        share = np.clip(np.bincount(y.astype(int), minlength=classes) / n, 1e-6, 1 - 1e-6)
        base = np.log(share[1:] / share[:1]) if classes == 2 else np.log(share)
    model = Model(base, [], None, regression)
    raw = np.tile(base, (n, 1))
    other = np.tile(base, (len(apart[1]), 1)) if apart is not None and len(apart[1]) else None
    least = np.inf if other is None else _loss(other, apart[1], regression)
    for k in range(rounds if codes.shape[1] else 0):
        if regression:
            g, h = raw - y[:, None], np.ones((n, 1))
        else:
            p = _probabilities(raw)
            p = p[:, 1:] if width == 1 else p
            g = p - (y[:, None] == (np.arange(width) + (width == 1)))
            h = np.maximum(p * (1 - p), 1e-12)
            del p
        rows = np.arange(n) if s.rows >= 1 else np.sort(rng.permutation(n)[: max(1, round(s.rows * n))])
        trees = []
        for c in range(width):
            t = _Grower(codes, g[:, c], h[:, c], categorical, s, rng).grow(rows)
            raw[:, c] += t.predict(codes)
            trees.append(t)
        model.rounds.append(trees)
        if other is not None:
            for c, t in enumerate(trees):
                other[:, c] += t.predict(apart[0])
            now = _loss(other, apart[1], regression)
            if now < least - 1e-12:
                least, model.best = now, k
            elif k - (-1 if model.best is None else model.best) >= patience:
                break
    if other is not None:
        model.rounds = model.rounds[: (model.best or 0) + 1 if model.best is not None else 0]
    return model
