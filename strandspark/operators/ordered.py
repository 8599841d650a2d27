"""Sums and texts along an order, in two levels.

Positions are dealt in blocks. A block is summed, or joined up, in a task of its own; what goes
on to the next level is one row for each block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a block.
BLOCK = 4096


def _block(at: str) -> Column:
    return F.floor(F.col(at) / BLOCK)


def running_sums(df: DataFrame, at: str, values: dict[str, Column], keys: tuple[str, ...] = (), inclusive: bool = True) -> DataFrame:
    """``df`` with sums of ``values`` over the rows up to each in the order of the integer ``at``, by ``keys``.

    The row itself counts if ``inclusive``; null values count as nothing. A window sums each
    block, and totals of the blocks before it, a row for each block and key, are added.
    """
    part = {f"__v{k}": F.coalesce(v, F.lit(0)) for k, v in enumerate(values.values())}
    rows = df.withColumns(part | {"__block": _block(at)})
    own = Window.partitionBy(*keys, "__block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    totals = rows.groupBy(*keys, "__block").agg(*[F.sum(c).alias(c) for c in part])
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*[F.col(k).alias(f"__k{n}") for n, k in enumerate(keys)], F.col("__block").alias("__of"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}b") for c in part])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{n}")) for n, k in enumerate(keys)], F.col("__block") == F.col("__of"))
    inside = rows.withColumns({f"{c}s": F.coalesce(F.sum(c).over(own), F.lit(0)) for c in part})
    return inside.join(base, same).select(*df.columns, *[(F.col(f"{c}s") + F.col(f"{c}b")).cast("bigint").alias(name) for c, name in zip(part, values, strict=True)])


def texts(df: DataFrame, **values: str) -> DataFrame:
    """One row with a text for each of ``values``: its column joined up in the order of ``pos`` and ``place``.

    Blocks of positions are joined up first; the row gathers a text for each block. No rows
    give empty texts.
    """
    joined = lambda items, c: F.array_join(F.transform(items, lambda x: x[c]), "")
    items = F.sort_array(F.collect_list(F.struct("pos", "place", *dict.fromkeys(values.values()))))
    rows = df.withColumn("__block", _block("pos")).groupBy("__block").agg(items.alias("__items"))
    parts = rows.select("__block", *[joined("__items", c).alias(name) for name, c in values.items()])
    whole = parts.agg(F.sort_array(F.collect_list(F.struct("__block", *values))).alias("__parts"))
    return whole.select(*[joined("__parts", name).alias(name) for name in values])
