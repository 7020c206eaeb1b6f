"""Search over settings: a table of trials a cell, from which each round's settings are drawn.

A trial is a row (cell, trial, params, values); values has one number, to be made large, or two, an accuracy to be made large and an error to be made small. Rounds are batches: all trials of a
round, of all cells, are evaluated in one job, and the next round sees them all. What is drawn depends on the seed, the cell's trials and their numbers alone, so that a lost
task gives the same settings again.

- `parzen`: tree-structured Parzen estimators. After `startup` random trials, the best share is told from the rest; each setting has a density of either, a mixture of
  normals at the trials' values, cut at the limits, whose widths are the distances to their neighbours; of candidates drawn from the good density the one with the largest ratio is tried.
- `evolved`: generations of a population. Trials are peeled into fronts, of a front those with room around them come first; the best of them are mixed by
  tournaments, crossover and mutation.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks import session


@dataclass(frozen=True)
class Range:
    """A setting's limits; whole numbers, or on a logarithmic scale, if told so."""

    low: float
    high: float
    whole: bool = False
    log: bool = False

    @property
    def ends(self) -> tuple[float, float]:
        low, high = (self.low - 0.5, self.high + 0.5) if self.whole else (self.low, self.high)
        return (math.log(low), math.log(high)) if self.log else (low, high)

    def inside(self, x: float) -> float:
        return math.log(x) if self.log else x

    def outside(self, z: float) -> float:
        x = math.exp(z) if self.log else z
        return int(min(max(round(x), self.low), self.high)) if self.whole else float(min(max(x, self.low), self.high))


Space = dict[str, Range]


def random(space: Space, rng: np.random.Generator) -> dict:
    return {k: r.outside(rng.uniform(*r.ends)) for k, r in space.items()}


def _mixture(values: list[float], ends: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Centres and widths: the values, each as wide as the distance to its farther neighbour, and one as wide as the range."""
    low, high = ends
    at = np.sort(np.array([*values, (low + high) / 2]))
    beside = np.concatenate([[low], at, [high]])
    width = np.maximum(beside[2:] - beside[1:-1], beside[1:-1] - beside[:-2])
    width = np.clip(width, (high - low) / min(100.0, 1.0 + len(at)), high - low)
    width[int(np.searchsorted(at, (low + high) / 2))] = high - low
    return at, width


_erf = np.vectorize(math.erf)


def _log_density(x: np.ndarray, centre: np.ndarray, width: np.ndarray, ends: tuple[float, float]) -> np.ndarray:
    below = lambda v: (1 + _erf((v - centre) / width / math.sqrt(2))) / 2
    mass = np.maximum(below(ends[1]) - below(ends[0]), 1e-12)
    z = (x[:, None] - centre) / width
    return np.log(np.maximum((np.exp(-z * z / 2) / (width * mass)).mean(axis=1), 1e-300))


def parzen(space: Space, trials: list[tuple[dict, float]], rng: np.random.Generator, n: int, startup: int = 10, candidates: int = 24) -> list[dict]:
    """n settings to try next, given (settings, value) of what was tried."""
    done = [t for t in trials if t[1] is not None and math.isfinite(t[1])]
    if len(done) < startup:
        return [random(space, rng) for _ in range(n)]
    done = sorted(done, key=lambda t: -t[1])
    cut = min(math.ceil(0.1 * len(done)), 25)
    out = []
    for _ in range(n):
        params = {}
        for name, r in space.items():
            good, bad = ([r.inside(p[name]) for p, _ in part] for part in (done[:cut], done[cut:]))
            bad += [r.inside(p[name]) for p in out]  # what this round tries already is no better than the rest, as far as is known
            (gc, gw), (bc, bw) = _mixture(good, r.ends), _mixture(bad, r.ends)
            pick = rng.integers(len(gc), size=candidates)
            x = np.clip(rng.normal(gc[pick], gw[pick]), *r.ends)
            params[name] = r.outside(float(x[np.argmax(_log_density(x, gc, gw, r.ends) - _log_density(x, bc, bw, r.ends))]))
        out.append(params)
    return out


def fronts(points: np.ndarray) -> np.ndarray:
    """The front of each point (gain, loss), from 0: what no other dominates, then what no other of the rest does, and so on."""
    rank, left, k = np.full(len(points), -1), np.arange(len(points)), 0
    while len(left):
        g, e = points[left, 0], points[left, 1]
        beaten = ((g[:, None] >= g) & (e[:, None] <= e) & ((g[:, None] > g) | (e[:, None] < e))).any(axis=0)
        rank[left[~beaten]] = k
        left, k = left[beaten], k + 1
    return rank


def crowding(points: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """How much room a point has between its neighbours on its front, summed over both aims; the ends have all."""
    out = np.zeros(len(points))
    for k in np.unique(rank):
        own = np.flatnonzero(rank == k)
        for aim in (0, 1):
            o = own[np.argsort(points[own, aim], kind="stable")]
            v = points[o, aim]
            out[o[[0, -1]]] = np.inf
            if len(o) > 2 and v[-1] > v[0]:
                out[o[1:-1]] += (v[2:] - v[:-2]) / (v[-1] - v[0])
    return out


def evolved(space: Space, trials: list[tuple[dict, tuple[float, float]]], rng: np.random.Generator, n: int, population: int = 20, mutation: float | None = None) -> list[dict]:
    """n settings of the next generation."""
    done = [t for t in trials if t[1] is not None and all(map(math.isfinite, t[1]))]
    if len(done) < population:
        return [random(space, rng) for _ in range(n)]
    points = np.array([v for _, v in done], float)
    rank = fronts(points)
    room = crowding(points, rank)
    alive = sorted(range(len(done)), key=lambda k: (rank[k], -room[k], k))[:population]
    rate = 1 / len(space) if mutation is None else mutation

    def parent() -> dict:
        a, b = rng.integers(len(alive), size=2)
        return done[alive[min(a, b)]][0]  # alive is in order of merit

    out = []
    for _ in range(n):
        a, b = parent(), parent()
        child = {}
        for name, r in space.items():
            low, high = r.ends
            x, y = r.inside(a[name]), r.inside(b[name])
            z = x + rng.uniform(-0.25, 1.25) * (y - x) if rng.random() < 0.9 else x
            if rng.random() < rate:
                z += rng.normal() * (high - low) / 5
            child[name] = r.outside(float(np.clip(z, low, high)))
        out.append(child)
    return out


TRIAL = "cell string, model string, trial int, params string, value double, error double"


def proposed(cells: DataFrame, trials: DataFrame | None, spaces: dict[str, Space], first: int, n: int, two: bool = False) -> DataFrame:
    """(cell, model, trial, params): the settings of trials first to first + n - 1 of each of cells (cell, model, seed), params as JSON.

    A cell's trials are some hundreds of short rows at most, and are drawn from together.
    """
    import pandas as pd

    session.ship(cells.sparkSession)
    none = F.lit(None).cast("string")
    rows = cells.select("cell", "model", "seed", none.alias("params"), F.lit(None).cast("int").alias("trial"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("error"))
    if trials is not None:
        rows = rows.unionByName(trials.join(cells.select("cell", "seed"), "cell").select(*rows.columns))

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        cell, model, seed = rows["cell"].iloc[0], rows["model"].iloc[0], int(rows["seed"].iloc[0])
        done = rows[rows["trial"].notna()].sort_values("trial")
        known = [json.loads(p) for p in done["params"]]
        rng = np.random.default_rng([seed, first])
        if two:
            made = evolved(spaces[model], list(zip(known, zip(done["value"], done["error"], strict=True), strict=True)), rng, n)
        else:
            made = parzen(spaces[model], list(zip(known, done["value"], strict=True)), rng, n)
        return pd.DataFrame({"cell": cell, "model": model, "trial": range(first, first + n), "params": [json.dumps(p, sort_keys=True) for p in made]})

    return rows.groupBy("cell").applyInPandas(draw, "cell string, model string, trial int, params string")


def best(trials: DataFrame) -> DataFrame:
    """(cell, params, inner_score): each cell's trial of largest value, the earliest of equals; cells without a known value have none."""
    top = trials.where("value is not null and not isnan(value)").groupBy("cell").agg(F.max_by(F.struct("params", "value"), F.struct("value", -F.col("trial"))).alias("t"))
    return top.select("cell", F.col("t.params").alias("params"), F.col("t.value").alias("inner_score"))


def non_dominated(trials: DataFrame) -> DataFrame:
    """(cell, trial, params, value, error): trials that no other of the cell dominates, by the windows of pareto.front."""
    from .pareto import front

    known = trials.where("not isnan(value) and not isnan(error)").select("cell", "trial", "params", "value", "error")
    return front(known, ["cell"], "value", "error")
