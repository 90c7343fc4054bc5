"""Helpers that keep expression trees small and build them once."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    A Column used twice is planned and evaluated twice, which multiplies when rules nest.
    Binding it to a lambda variable keeps plans linear in the number of rules.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_per_key(items: Column, key: Callable[[Column], Column]) -> Column:
    """The first item of every key, in order; items with a null key drop out.

    Sorted by key and place, so that long arrays do not take quadratic time.
    """
    keyed = F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    ordered = F.array_sort(F.filter(keyed, lambda e: e["k"].isNotNull()))

    def firsts(es: Column) -> Column:
        return F.filter(es, lambda e, j: (j == 0) | (F.get(es, j - 1)["k"] != e["k"]))

    back = F.array_sort(
        F.transform(let(ordered, firsts), lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x")))
    )
    return F.transform(back, lambda e: e["x"])


def constant(value: object, ddl: str) -> Column:
    """A nested literal; folded once when the plan is optimised."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), F.lit(ddl))


def built_once(build: Callable) -> Callable:
    """Keep what ``build`` made for its (hashable) arguments.

    Columns belong to no DataFrame, so the expressions of a source are built once per
    JVM and used for every batch after that.
    """
    made: dict = {}

    @functools.wraps(build)
    def reuse(*args):
        key = (id(SparkContext._jvm), *args)
        if key not in made:
            made[key] = build(*args)
        return made[key]

    return reuse
