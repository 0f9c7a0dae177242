"""Joins that Spark SQL has no syntax for: as-of and range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str], *, strict: bool = False, forward: bool = False) -> DataFrame:
    """``left`` with the ``values`` of the nearest ``right`` row before (or after) its ``on``, among equal ``by``.

    One union, one shuffle by ``by`` and one sort, whatever the number of matches, where
    a join with a range condition would pair every row with its whole past.  A right row
    at the same time counts unless ``strict``.  Of right rows at one time the greatest
    values win.  Nulls in ``on`` or ``by`` match nothing.
    """
    keys = [*by, on]
    payload = F.struct(*[F.col(v) for v in values])
    lhs = left.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)], F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("__p"), F.struct(*left.columns).alias("__row"))
    rhs = right.where(F.col(on).isNotNull()).select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)], payload.alias("__p"), F.lit(None).cast(lhs.schema["__row"].dataType).alias("__row"))
    rows = lhs.unionByName(rhs).withColumn("__left", F.col("__row").isNotNull())
    time = F.col(f"__{len(by)}")
    # at one time: matches first if they count, else the left rows
    tie = F.col("__left").asc() if not strict else F.col("__left").desc()
    order = [time.desc_nulls_first() if forward else time.asc_nulls_first(), tie, F.col("__p").asc()]
    w = W.partitionBy(*[f"__{i}" for i in range(len(by))]).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    known = F.col(f"__{len(by)}").isNotNull()
    for i in range(len(by)):
        known = known & F.col(f"__{i}").isNotNull()
    out = rows.withColumn("__m", F.last("__p", ignorenulls=True).over(w)).where("__left")
    return out.select("__row.*", *[F.when(known, F.col(f"__m.{v}")).alias(v if v not in left.columns else f"{v}_right") for v in values])


def range_join(points: DataFrame, ranges: DataFrame, point: Column, low: Column, high: Column, width: float, how: str = "inner") -> DataFrame:
    """Pairs with ``low <= point <= high``, as an equi-join on bins of ``width``.

    A range is repeated once for each bin that it touches; ``width`` near the usual range
    keeps that small.  Without bins Spark would compare every point with every range.
    """
    p = points.withColumn("__bin", F.floor(point / F.lit(width)))
    r = ranges.withColumn("__bin", F.explode(F.sequence(F.floor(low / F.lit(width)), F.floor(high / F.lit(width)))))
    inside = (p["__bin"] == r["__bin"]) & (point >= low) & (point <= high)
    if how == "inner":
        return p.join(r, inside).drop(p["__bin"]).drop(r["__bin"])
    if how in ("left_semi", "left_anti"):
        return p.join(r, inside, how).drop("__bin")
    raise ValueError(f"range_join does not support {how}")


def union_by_name(frames: list[DataFrame], distinct: bool = False) -> DataFrame:
    """Set union by column name; absent columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.distinct() if distinct else out


def salted_join(left: DataFrame, right: DataFrame, on: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join with each key of ``left`` spread over ``salts`` tasks; ``right`` is repeated that often.

    For keys so frequent that a task that holds one of them is the bottleneck, where
    adaptive skew handling does not apply (for example below an aggregate on the key).
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salted_join does not support {how}")
    spread = left.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [on, "__salt"], how).drop("__salt")
