"""Places and running values within a key, of whatever size the key is.

A window over a key puts all of its rows into one task. Here rows are cut into ranges by key and order,
which Spark samples so that they are about even, and each range is numbered on its own. What earlier
ranges hold of a key is added up from one row for each key and range. So a key of any size is spread
over many tasks, and equal rows are as well: they are told apart by where they were read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut

#: Rows of a range have ids that start at a multiple of this.
_RANGE = 1 << 33


def _fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column has."""
    taken = {c.lower() for c in df.columns}
    return [next(x for x in (f"_{n}" + "_" * i for i in range(len(taken) + 1)) if x not in taken) for n in names]


def _ranges(df: DataFrame, keys: list[str], order: list[Column], at: str, tie: str) -> DataFrame:
    """The rows, range by range and sorted in each, with ``at``: the range's number times _RANGE, and the place in it."""
    by = [*(F.col(k) for k in keys), *order, F.col(tie)]
    sorted_ = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    return cut(sorted_.withColumn(at, F.monotonically_increasing_id()).drop(tie))


def _met(rows: DataFrame, per: DataFrame, names: list[str]) -> DataFrame:
    """Rows with the other columns of ``per``, by the named columns (null equals null)."""
    other = _fresh(rows, *(f"other_{n}" for n in names))
    per = per.withColumnsRenamed(dict(zip(names, other)))
    same = F.lit(True)
    for n, o in zip(names, other):
        same = same & F.col(n).eqNullSafe(F.col(o))
    return rows.join(per, same).drop(*other)


def placed(df: DataFrame, keys: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """The rows with ``name``, their place from 1 among the rows of their key (null being one) in the given order.

    Rows that are equal in the order have places next to each other, in either order. An empty table
    gives an empty one; columns of any names are kept, but for ``name``, which is replaced.
    """
    df = df.drop(name)
    at, part, tie, first, before = _fresh(df, "at", "part", "tie", "first", "before")
    rows = _ranges(df, keys, order, at, tie).withColumn(part, F.floor(F.col(at) / _RANGE).cast("bigint"))
    per = rows.groupBy(*keys, part).agg(F.min(at).alias(first), F.count("*").alias(before))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0)))
    met = _met(rows, per, [*keys, part])
    return met.select(*df.columns, (F.col(before) + F.col(at) - F.col(first) + 1).alias(name))


def running(df: DataFrame, keys: list[str], order: list[Column], made: dict[str, tuple[Callable[[str], Column], Callable[[Column, Column], Column], str]]) -> DataFrame:
    """The rows with running values of a key up to and including each row.

    ``made``: by name an aggregate, what joins two of its values (of earlier rows, of later ones), and
    its column, as in ``{"so_far": (F.sum, Column.__add__, "n")}``.
    """
    df = df.drop(*made)
    at, part, tie = _fresh(df, "at", "part", "tie")
    rows = _ranges(df, keys, order, at, tie).withColumn(part, F.floor(F.col(at) / _RANGE).cast("bigint"))
    carried = dict(zip(made, _fresh(df, *(f"carried_{n}" for n in made))))
    per = rows.groupBy(*keys, part).agg(*(f(c).alias(carried[n]) for n, (f, _, c) in made.items()))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, part, *(f(carried[n]).over(earlier).alias(carried[n]) for n, (f, _, _) in made.items()))
    here = Window.partitionBy(part, *keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({n: f(c).over(here) for n, (f, _, c) in made.items()})
    met = _met(rows, per, [*keys, part])
    before = lambda n: F.col(carried[n])
    whole = {n: F.when(before(n).isNull(), F.col(n)).when(F.col(n).isNull(), before(n)).otherwise(join(before(n), F.col(n))) for n, (_, join, _) in made.items()}
    return met.select(*df.columns, *(c.alias(n) for n, c in whole.items()))
