"""Functions by name, for SQL and for callers that choose them by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

_known: dict[str, Callable] = {}


def register(name: str, function: Callable) -> Callable:
    """Makes function known under the name; a second one replaces the first."""
    _known[name] = function
    return function


def known(name: str) -> Callable:
    if name not in _known:
        raise KeyError(f"no function named {name}; there are {sorted(_known)}")
    return _known[name]


def install(spark: SparkSession) -> list[str]:
    """Registers all that are user-defined functions with the session's SQL."""
    done = []
    for name, function in sorted(_known.items()):
        if hasattr(function, "returnType") or hasattr(function, "evalType"):
            spark.udf.register(name, function)
            done.append(name)
    return done
