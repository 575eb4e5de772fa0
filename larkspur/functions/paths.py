"""Joins on prefixes as joins on equal keys: a path is taken apart into the prefixes that could match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ancestors(path: Column) -> Column:
    """Every folder above a path, the root as an empty string: /a/b/c has '', /a and /a/b. As many as the path has slashes."""
    parts = F.split(path, "/")
    return F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: k > 0), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def prefixes_of(path: Column, prefixes: DataFrame, prefix: str) -> Column:
    """The beginnings of a path that are as long as some prefix is. Only the different lengths of the prefixes are collected."""
    lengths = sorted(r[0] for r in prefixes.select(F.length(prefix)).distinct().collect() if r[0] is not None)
    some = F.array(*[F.lit(n) for n in lengths]).cast("array<int>")
    return F.transform(F.filter(some, lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
