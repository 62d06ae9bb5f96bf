"""Hyperparameter search: proposals on the driver, fits and scores on Spark, every trial recorded."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelab import SPLIT
from tablelab.operators.metrics import MAXIMIZE, classification_scores
from tablelab.operators.tasks import compatible_metrics

# Share of the trials that counts as good, random trials before the first model of them, and
# candidates compared per proposal (Bergstra et al. 2011).
GOOD_SHARE = 0.25
WARM_UP = 5
CANDIDATES = 24


@dataclass(frozen=True)
class Range:
    """Closed interval of one parameter."""

    low: float
    high: float
    integer: bool

    def put(self, x: float):
        x = min(max(x, self.low), self.high)
        return int(round(x)) if self.integer else float(x)


def resolve_parameters(parameters: dict) -> tuple[dict, dict[str, Range]]:
    """Split parameters into fixed values and ranges to search.

    A parameter is a plain value or ``{optimize, fixed_value, lower_bound, upper_bound}``. It is
    searched over whole numbers when both bounds and the fixed value are whole.
    """
    fixed, space = {}, {}
    for name, value in parameters.items():
        if not (isinstance(value, dict) and "optimize" in value):
            fixed[name] = value
        elif not value["optimize"]:
            fixed[name] = value["fixed_value"]
        else:
            low, high = value["lower_bound"], value["upper_bound"]
            if low > high:
                raise ValueError(f"{name}: lower bound {low} is above upper bound {high}")
            whole = all(isinstance(v, int) for v in (low, high, value.get("fixed_value", low)))
            space[name] = Range(low, high, whole)
    return fixed, space


def _random(space: dict[str, Range], draw: np.random.Generator) -> dict:
    return {
        name: int(draw.integers(r.low, r.high, endpoint=True)) if r.integer
        else float(draw.uniform(r.low, r.high))
        for name, r in space.items()
    }


def grid(space: dict[str, Range]) -> list[dict]:
    """Every combination of whole-number ranges; the last parameter changes fastest."""
    broken = [name for name, r in space.items() if not r.integer]
    if broken:
        raise ValueError(f"a grid needs whole-number ranges, unlike those of {', '.join(broken)}")
    return [dict(zip(space, values)) for values in product(*(range(r.low, r.high + 1) for r in space.values()))]


def _density(x: np.ndarray, centers: np.ndarray, r: Range) -> np.ndarray:
    width = max((r.high - r.low) / max(len(centers), 1), 1e-12)
    z = (x[:, None] - centers[None, :]) / width
    bumps = np.exp(-0.5 * z**2).sum(axis=1) / width
    # a flat prior keeps every value possible
    return (bumps + 1.0 / max(r.high - r.low, 1e-12)) / (len(centers) + 1)


def _tpe(space, trials: list[tuple[dict, float]], draw: np.random.Generator) -> dict:
    """Values that are likely among good trials and unlikely among the others; scores maximised."""
    if len(trials) < WARM_UP:
        return _random(space, draw)
    ranked = sorted(trials, key=lambda t: -t[1])
    n_good = max(1, int(np.ceil(GOOD_SHARE * len(ranked))))
    out = {}
    for name, r in space.items():
        good = np.array([p[name] for p, _ in ranked[:n_good]], dtype=float)
        bad = np.array([p[name] for p, _ in ranked[n_good:]], dtype=float)
        spread = max((r.high - r.low) / (len(good) + 1), 1e-12)
        x = draw.normal(draw.choice(good, CANDIDATES), spread)
        x = np.array([r.put(v) for v in x], dtype=float)
        best = np.argmax(_density(x, good, r) / _density(x, bad, r))
        out[name] = r.put(x[best])
    return out


@dataclass
class Search:
    """Outcome of a search: all trials, the best parameters and the model refitted with them."""

    trials: list[tuple[int, dict, float]]
    metric: str
    best_params: dict
    model: object = field(repr=False)

    def table(self, spark, run_id: str = "run") -> DataFrame:
        rows = [(run_id, t, {k: float(v) for k, v in p.items()}, float(s)) for t, p, s in self.trials]
        out = spark.createDataFrame(
            rows, "run_id string, trial int, params map<string,double>, score double"
        )
        return running_best(out, MAXIMIZE[self.metric])


def search(
    df: DataFrame, fit: Callable[[DataFrame, dict], object], label: str, space: dict[str, Range],
    metric: str = "Accuracy", n_trials: int = 10, sampler: str = "tpe", seed: int = 0,
    parallelism: int = 4, task: str | None = None,
) -> Search:
    """Find the parameters whose model, fitted on ``train``, scores best on ``validation``.

    ``fit(train_rows, params)`` returns a fitted model. Trials run a few at a time; every round of
    proposals sees all results so far. The sampler ``grid`` tries every combination, whatever
    ``n_trials`` is.
    """
    if sampler not in ("random", "tpe", "grid"):
        raise ValueError(f"sampler should be random, tpe or grid, got {sampler}")
    listed = grid(space) if sampler == "grid" else []
    n_trials = len(listed) or n_trials
    if task is not None and metric not in compatible_metrics(task):
        raise ValueError(f"{metric} cannot score {task}")
    sign = 1 if MAXIMIZE[metric] else -1
    draw = np.random.default_rng(seed)
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        train = df.filter(F.col(SPLIT) == "train")
        validation = df.filter(F.col(SPLIT) == "validation")

        def objective(params: dict) -> float:
            scored = fit(train, params).transform(validation)
            return float(classification_scores(scored, label, by=[]).first()[metric])

        done: list[tuple[dict, float]] = []
        with ThreadPool(parallelism) as pool:
            while len(done) < n_trials:
                count = min(parallelism, n_trials - len(done))
                signed = [(p, sign * s) for p, s in done]
                batch = listed[len(done):len(done) + count] or [
                    _random(space, draw) if sampler == "random" else _tpe(space, signed, draw)
                    for _ in range(count)
                ]
                run = inheritable_thread_target(df.sparkSession)(objective)
                done += zip(batch, pool.map(run, batch))
        best = max(range(len(done)), key=lambda i: (sign * done[i][1], -i))
        model = fit(train, done[best][0])
    finally:
        df.unpersist()
    trials = [(i, p, s) for i, (p, s) in enumerate(done)]
    return Search(trials, metric, done[best][0], model)


def running_best(trials: DataFrame, maximize: bool = True, by: str = "run_id") -> DataFrame:
    """Best score up to each trial of a run."""
    upto = Window.partitionBy(by).orderBy("trial").rowsBetween(Window.unboundedPreceding, 0)
    best = F.max("score") if maximize else F.min("score")
    return trials.withColumn("running_best", best.over(upto))


def best_trial(trials: DataFrame, maximize: bool = True, by: str = "run_id") -> DataFrame:
    """The best trial of each run, the earliest one on a tie."""
    score = F.col("score") if maximize else -F.col("score")
    others = [c for c in trials.columns if c != by]
    best = F.max_by(F.struct(*others), F.struct(score, -F.col("trial"))).alias("b")
    return trials.groupBy(by).agg(best).select(by, "b.*")
