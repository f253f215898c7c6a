"""Registries: graph measures, connectivity estimators, models and statistics by name.

A measure maps (edges, nodes) to (grp, subject, value); an estimator maps a cross-spectrum table to pair rows; a model is a pair
of an estimator with its parameter grid; a statistic maps a column to an aggregate column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURES: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}
ESTIMATORS: dict[str, Callable[[DataFrame], DataFrame]] = {}
MODELS: dict[str, Callable] = {}
STATISTICS: dict[str, Callable[[Column], Column]] = {"mean": F.avg, "median": lambda c: F.percentile(c, 0.5), "sd": F.stddev_pop, "max": F.max, "min": F.min}


def _register(table: dict, name: str, fn: Callable) -> Callable:
    if name in table:
        raise ValueError(f"{name} is registered already")
    table[name] = fn
    return fn


def register_measure(name: str, fn: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable:
    return _register(MEASURES, name, fn)


def register_estimator(name: str, fn: Callable[[DataFrame], DataFrame]) -> Callable:
    return _register(ESTIMATORS, name, fn)


def register_model(name: str, fn: Callable) -> Callable:
    return _register(MODELS, name, fn)


def register_statistic(name: str, fn: Callable[[Column], Column]) -> Callable:
    return _register(STATISTICS, name, fn)


def built_in(names: list[str]) -> bool:
    """Whether all names are those of measures that are registered from the start."""
    return all(name in _BUILT_IN and MEASURES.get(name) is _BUILT_IN[name] for name in names)


def all_measures(edges: DataFrame, nodes: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(grp, subject, measure, value) of every registered or named measure, in one plan; what several built-in ones need is found once.

    Built-in ones of graphs of few nodes come from one pass over packed graphs (`stacks`), of larger ones from joins.
    """
    from corvane.operators import measures, stacks

    shared, out = measures.Shared(edges, nodes), None
    names = names or sorted(MEASURES)
    built_in = [name for name in names if name in measures.MEASURES and MEASURES[name] is _BUILT_IN[name]]
    listed = [r["node"] for r in shared.nodes.distinct().limit(stacks.MOST_NODES + 1).collect()] if built_in else []
    few = 2 <= len(listed) <= stacks.MOST_NODES
    if few:
        out = stacks.measures(edges, sorted(listed), built_in, measures.SEED)
    for name in names:
        if few and name in built_in:
            continue
        one = (measures.MEASURES[name](shared) if name in built_in else MEASURES[name](edges, nodes)).select("grp", "subject", F.lit(name).alias("measure"), F.col("value").cast("double").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


#: The measures that are registered from the start, each by itself.
_BUILT_IN: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}


def _builtin() -> None:
    from corvane.operators import connectivity as C
    from corvane.operators import measures

    for name, fn in measures.MEASURES.items():
        _BUILT_IN[name] = register_measure(name, lambda e, n, fn=fn: fn(measures.Shared(e, n)))
    for c in ("coherence", "imcoh", "plv", "ciplv", "ppc", "pli", "dwpli2"):
        register_estimator(c, lambda x, c=c: C.undirected(x).select(*C.PAIR, F.col(c).alias("w")))
    for c in ("dpli", "dwpli", "psi"):
        register_estimator(c, lambda x, c=c: C.directed(x).select(*C.PAIR, F.col(c).alias("w")))


_builtin()
