"""Search for parameters that learns from finished trials, and stops weak ones early.

The space is that of models.trials: a list of choices, or (low, high), whole numbers where both are, and else by the logarithm.
Fits are distributed jobs; what is decided here are a few numbers a trial.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .models import side_by_side, trial_of, trials

#: The share of finished trials that counts as good, draws of which the most promising is tried, and trials that come first at random.
GOOD, DRAWS, AT_RANDOM = 0.25, 24, 8


class Parzen:
    """Densities of one parameter over the trials' values: a kernel at each value, and one as wide as the space so that
    nothing is ruled out."""

    def __init__(self, values: list, space):
        self.space, self.choices = space, isinstance(space, list)
        if self.choices:
            self.weights = [1 + sum(v == c for v in values) for c in space]
            return
        self.low, self.high = sorted(map(self._at, space))
        span = self.high - self.low or 1.0
        middles = sorted(map(self._at, values))
        # A kernel reaches as far as its neighbours, within bounds.
        around = [self.low, *middles, self.high]
        least = span / min(100, len(middles) + 2)
        widths = [min(span, max(least, around[i + 2] - around[i + 1], around[i + 1] - around[i])) for i in range(len(middles))]
        self.kernels = [(m, w) for m, w in zip([*middles, (self.low + self.high) / 2], [*widths, span], strict=True)]

    def _whole(self) -> bool:
        return all(isinstance(x, int) for x in self.space)

    def _at(self, value) -> float:
        return float(value) if self._whole() else math.log(value)

    def draw(self, r: random.Random):
        if self.choices:
            return r.choices(self.space, self.weights)[0]
        middle, width = r.choice(self.kernels)
        while not self.low <= (x := r.gauss(middle, width)) <= self.high:
            pass
        return round(x) if self._whole() else math.exp(x)

    def log_density(self, value) -> float:
        if self.choices:
            return math.log(self.weights[self.space.index(value)] / sum(self.weights))
        x = self._at(value)
        below = lambda z: (1 + math.erf(z / math.sqrt(2))) / 2
        inside = lambda m, w: below((self.high - m) / w) - below((self.low - m) / w)
        each = [math.exp(-((x - m) ** 2) / (2 * w * w)) / (w * inside(m, w)) for m, w in self.kernels]
        return math.log(sum(each) / len(each) / math.sqrt(2 * math.pi))


def draw(space: dict, finished: list[tuple[dict, float]], r: random.Random) -> dict:
    """The next parameters to try: of draws from where good trials lie, the one where poor trials are rarest. finished:
    (parameters, score), higher scores being better."""
    ordered = sorted(finished, key=lambda t: -t[1])
    n = max(1, math.ceil(GOOD * len(ordered)))
    good, poor = ({k: Parzen([p[k] for p, _ in part], v) for k, v in space.items()} for part in (ordered[:n], ordered[n:]))
    options = [{k: good[k].draw(r) for k in space} for _ in range(DRAWS)]
    return max(options, key=lambda o: sum(good[k].log_density(v) - poor[k].log_density(v) for k, v in o.items()))


def parzen_search(spark: SparkSession, trial: Callable[[dict], dict], space: dict, n: int, seed: int = 42, at_once: int = 4) -> list[dict]:
    """n trials, best first. The first ones are those of models.trials with that seed; then each is drawn from those that have
    finished, `at_once` at a time."""
    r, done = random.Random(seed), []
    first = trials(space, min(n, AT_RANDOM), seed)
    while len(done) < n:
        todo = first[len(done) : len(done) + at_once] or [draw(space, [(t["params"], t["score"]) for t in done], r) for _ in range(min(at_once, n - len(done)))]
        done += side_by_side(spark, trial, todo, at_once)
    return sorted(done, key=lambda t: -t["score"])


def halving_search(spark: SparkSession, trial: Callable[[dict], dict], space: dict, n: int, effort: tuple[str, int, int], factor: int = 3, seed: int = 42, at_once: int = 4) -> list[dict]:
    """n trials, those of full effort first, then by score: each starts with little of the parameter `effort` (name, low, high), trees
    say, and only the best 1 / factor of what has finished on a rung goes on to the next, with `factor` times as much.

    A trial goes up as soon as it is among the best so far, without waiting for its rung to fill; where none may, a new one
    starts, drawn from what has finished on the highest rung that has enough trials. What a trial has had, `fits`, is
    the sum of its efforts.
    """
    name, low, high = effort
    rungs = [low * factor**k for k in range(1 + math.floor(math.log(high / low, factor) + 1e-9))]
    r, begun = random.Random(seed), 0
    first = trials(space, n, seed)
    held: list[dict[int, dict]] = [{} for _ in rungs]  # finished on each rung, by trial
    up: list[set[int]] = [set() for _ in rungs]  # gone up from it
    last, fits = {}, {}

    def next_one() -> tuple[int, int, dict] | None:
        nonlocal begun
        for k in reversed(range(len(rungs) - 1)):
            best = sorted(held[k], key=lambda i: (-held[k][i]["score"], i))[: len(held[k]) // factor]
            for i in best:
                if i not in up[k]:
                    up[k].add(i)
                    return i, k + 1, last[i]
        if begun == n:
            return None
        i, begun = begun, begun + 1
        known = next((h for h in reversed(held) if len(h) >= AT_RANDOM), None)
        last[i] = draw(space, [({c: v for c, v in t["params"].items() if c != name}, t["score"]) for t in known.values()], r) if known else first[i]
        return i, 0, last[i]

    while True:
        todo = [x for x in (next_one() for _ in range(at_once)) if x]
        if not todo:
            break
        for (i, k, _), found in zip(todo, side_by_side(spark, trial, [params | {name: rungs[k]} for _, k, params in todo], at_once), strict=True):
            held[k][i] = found
            fits[i] = fits.get(i, 0) + rungs[k]
    top = {i: k for k in range(len(rungs)) for i in held[k]}
    return [held[k][i] | {"rung": k, "fits": fits[i]} for i, k in sorted(top.items(), key=lambda x: (-x[1], -held[x[1]][x[0]]["score"]))]


def tuned(df: DataFrame, key: str, features: list[str], target: str, model: str, space: dict, n: int, effort: tuple[str, int, int] | None = None, **options) -> list[dict]:
    """Parameters of a model of statistics.MODELS, best first: by parzen_search, or by halving_search if there is an effort."""
    trial = trial_of(df, key, features, target, model)
    if effort is None:
        return parzen_search(df.sparkSession, trial, space, n, **options)
    return halving_search(df.sparkSession, trial, space, n, effort, **options)
