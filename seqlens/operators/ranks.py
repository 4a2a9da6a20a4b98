"""Running sums and exact places in ordered groups, dealt over ranges of values: no task sees a whole group.

The values of all rows are cut at PARTS approximate quantiles, so a group with a share of the rows is cut into about that share of the ranges. Sums of each group and range are added up over the ranges (PARTS + 2 rows a group at most) and start the running sum inside each. What the sums give is exact; only the sizes of the ranges are approximate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PARTS = 64


def with_ranges(rows: DataFrame, value: str, parts: int = PARTS) -> DataFrame:
    """rows with `part`, rising with the value, -1 for null. The cuts are one row, whatever the input."""
    cuts = rows.agg(F.percentile_approx(F.col(value).cast("double"), F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(100 * parts)).alias("__cuts"))
    at = F.size(F.filter(F.coalesce("__cuts", F.array().cast("array<double>")), lambda c: c <= F.col(value)))
    return rows.crossJoin(F.broadcast(cuts)).withColumn("part", F.when(F.col(value).isNull(), -1).otherwise(at)).drop("__cuts")


def running(rows: DataFrame, by: list[str], value: str, sums: dict[str, Column], descending: bool = False, then: tuple[str, ...] = (), parts: int = PARTS) -> DataFrame:
    """rows with, for each entry (name, column) of sums, name: the sum over the group's rows up to this one in order of value and `then`, and name_all: the sum over the group."""
    dealt = with_ranges(rows, value, parts)
    cells = dealt.groupBy(*by, "part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    way = F.desc if descending else F.asc
    before, whole = Window.partitionBy(*by).orderBy(way("part")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    starts = cells.select(*by, "part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__{n}") for n in sums], *[F.sum(n).over(whole).alias(f"{n}_all") for n in sums], F.lit(0).alias("__nth"))
    # a range's start is the first row of its window
    both = starts.unionByName(dealt.withColumns({f"__{n}": c for n, c in sums.items()} | {"__nth": F.lit(1)}), allowMissingColumns=True)
    inside = Window.partitionBy(*by, "part").orderBy("__nth", way(value), *then).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumns({n: F.sum(f"__{n}").over(inside) for n in sums} | {f"{n}_all": F.first(f"{n}_all").over(inside) for n in sums})
    return found.where("__nth = 1").drop("part", "__nth", *[f"__{n}" for n in sums])


def values_at(rows: DataFrame, by: list[str], value: str, places, parts: int = PARTS) -> DataFrame:
    """Of each group: n (rows with a value) and the values at `places`: {name: place from 0, as a function of n}. Equal values are counted before they are ranked."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__value")).agg(F.count("*").alias("here"))
    ranked = running(counted, by, "__value", {"upto": F.col("here")}, parts=parts)
    at = lambda place: F.max(F.when((F.col("upto") > place) & (F.col("upto") - F.col("here") <= place), F.col("__value")))
    return ranked.groupBy(*by).agg(F.coalesce(F.max("upto_all"), F.lit(0)).alias("n"), *[at(place(F.col("upto_all"))).alias(name) for name, place in places.items()])


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], parts: int = PARTS) -> DataFrame:
    """Of each group: n and the exact linear percentiles {name: share}."""
    place = lambda share: lambda n: F.floor((n - 1) * F.lit(share))
    above = lambda share: lambda n: F.ceil((n - 1) * F.lit(share))
    found = values_at(rows, by, value, {f"{k}_{side}": f(s) for k, s in shares.items() for side, f in (("low", place), ("high", above))}, parts)
    part = lambda share: (F.col("n") - 1) * F.lit(share) - F.floor((F.col("n") - 1) * F.lit(share))
    return found.select(*by, "n", *[(F.col(f"{k}_low") + part(s) * (F.col(f"{k}_high") - F.col(f"{k}_low"))).alias(k) for k, s in shares.items()])
