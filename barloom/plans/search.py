"""Strategy search on the driver over distributed evaluation: folds, fitness over blocks, top-k, genetic steps, funnels."""

from __future__ import annotations

import itertools
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import HOLDS, MOST, STOPS, TARGETS, Strategy, catalogue
from ..operators.stats import RET, daily_returns



#: Every direction with every exit of the grid.
SHAPES = tuple(itertools.product((1, -1), STOPS, TARGETS, HOLDS))


def random_strategy(rng: np.random.Generator, symbol: str) -> Strategy:
    """One of the shapes, with the first one to ``MOST`` predicates of a shuffled catalogue."""
    direction, stop, target, hold = SHAPES[rng.integers(len(SHAPES))]
    shuffled = [catalogue()[i] for i in rng.permutation(len(catalogue()))[: rng.integers(1, MOST + 1)]]
    return Strategy(symbol, direction, tuple(shuffled), stop, target, hold)


def mutated(rng: np.random.Generator, s: Strategy) -> Strategy:
    """One change: a predicate in, out or swapped, another direction, or another exit."""
    ps, every = list(s.predicates), catalogue()
    new = every[int(rng.integers(len(every)))]
    kind = int(rng.integers(6))
    if kind == 0 and len(ps) < MOST:
        ps.append(new)
    elif kind == 1 and len(ps) > 1:
        ps.pop(int(rng.integers(len(ps))))
    elif kind == 2:
        ps[int(rng.integers(len(ps)))] = new
    elif kind == 3:
        return replace(s, direction=-s.direction)
    elif kind == 4:
        return replace(s, stop=float(rng.choice(STOPS)), target=float(rng.choice(TARGETS)))
    else:
        return replace(s, hold=int(rng.choice(HOLDS)))
    return replace(s, predicates=tuple(ps))


#: Generations in a row without a new strategy after which a search ends with its budget unspent.
STALE = 20


def crossed(rng: np.random.Generator, a: Strategy, b: Strategy) -> Strategy:
    """A uniform cross: what both parents have stays, every other predicate comes along by a coin; a coin each tells
    which parent gives direction, stop, target and holding time."""
    shared = set(a.predicates) & set(b.predicates)
    others = sorted(set(a.predicates) ^ set(b.predicates))
    taken = [p for p, heads in zip(others, rng.random(len(others)) < 0.5) if heads]
    pool = [*sorted(shared), *taken] or [others[rng.integers(len(others))]]
    pool = [pool[i] for i in rng.permutation(len(pool))[:MOST]]  # too many: each has the same chance to stay
    parent = [(a, b)[k] for k in rng.integers(2, size=4)]
    return Strategy(a.symbol, parent[0].direction, tuple(pool), parent[1].stop, parent[2].target, parent[3].hold)


def evolve(fitness, symbol: str, population: int, budget: int, seed: int, elites: float = 0.1, immigrants: float = 0.1) -> dict[str, tuple[Strategy, float]]:
    """An archive by hash of all strategies that were evaluated; ``fitness`` takes a list and returns their values in one
    distributed job per generation. No strategy is evaluated twice; the same seed gives the same archive."""
    rng = np.random.default_rng(seed)
    archive: dict[str, tuple[Strategy, float]] = {}
    living: list[Strategy] = [random_strategy(rng, symbol) for _ in range(population)]
    stale = 0
    while True:
        fresh = list({s.hash(): s for s in living if s.hash() not in archive}.values())[: budget - len(archive)]
        for s, f in zip(fresh, fitness(fresh) if fresh else []):
            archive[s.hash()] = s, f
        stale = 0 if fresh else stale + 1
        if len(archive) >= budget or stale > STALE:
            return archive
        if stale:  # nothing new: strangers come in until there is
            living = [*living[: population // 2], *(random_strategy(rng, symbol) for _ in range(population - population // 2))]
            continue
        ranked = sorted((s for s in living if s.hash() in archive), key=lambda s: (-archive[s.hash()][1], s.hash()))
        keep = ranked[: max(1, int(elites * population))]
        contest = lambda: ranked[min(int(rng.integers(len(ranked))) for _ in range(3))]
        living = [*keep, *(random_strategy(rng, symbol) for _ in range(int(immigrants * population)))]
        while len(living) < population:
            child = crossed(rng, contest(), contest())
            living.append(mutated(rng, child) if rng.random() < 0.7 else child)


def top_k(m: DataFrame, by: list[str], score: str, k: int, ordinal: str) -> DataFrame:
    """Stable best k of each group."""
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last(score), ordinal)
    return m.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def folds(first_year: int, last_year: int, train_years: int) -> list[tuple[int, int, int, int]]:
    """(fold, first training year, first out-of-sample year, end): rolling windows, one year out of sample each."""
    return [(i, y - train_years, y, y + 1) for i, y in enumerate(range(first_year + train_years, last_year + 1))]


def walk_forward(returns: DataFrame, spans: list[tuple[int, int, int, int]], k: int) -> DataFrame:
    """For each fold the k best symbols of its training years, and what they return out of sample."""
    year = F.year("day")
    spec = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("fold", "train", "oos", "stop"), s)]) for s in spans])
    d = returns.select("symbol", "day", "ret", F.explode(F.filter(spec, lambda s: (year >= s["train"]) & (year < s["stop"]))).alias("s")).select("symbol", "ret", "s.*", (year >= F.col("s.oos")).alias("out"))
    m = d.groupBy("fold", "symbol").agg(F.avg(F.when(~F.col("out"), F.col("ret"))).alias("train_mean"), F.count_if(F.col("out")).alias("n"), F.avg(F.when(F.col("out"), F.col("ret"))).alias("oos_mean"))
    return top_k(m, ["fold"], "train_mean", k, "symbol")


def walk_forward_top(spark, sf_dir: str) -> DataFrame:
    d = walk_forward(daily_returns(spark, sf_dir), folds(1995, 2001, 3), 2)
    return d.select("fold", "rank", "symbol", "n", F.round("train_mean", 6).alias("train_mean"), F.round("oos_mean", 6).alias("oos_mean"))


QUERIES = {"walk_forward_top": walk_forward_top}
ORACLE = {
    "walk_forward_top": f"""{RET}, f AS (SELECT i AS fold, 1995 + i AS train, 1998 + i AS oos FROM range(4) t(i)),
m AS (SELECT fold, symbol, avg(ret) FILTER (WHERE year(day) < oos) AS train_mean, count(*) FILTER (WHERE year(day) >= oos) AS n, avg(ret) FILTER (WHERE year(day) >= oos) AS oos_mean FROM r JOIN f ON year(day) >= train AND year(day) < oos + 1 GROUP BY 1, 2)
SELECT * FROM (SELECT fold, row_number() OVER (PARTITION BY fold ORDER BY train_mean DESC NULLS LAST, symbol) AS rank, symbol, n, round(train_mean, 6) AS train_mean, round(oos_mean, 6) AS oos_mean FROM m) WHERE rank <= 2"""
}
