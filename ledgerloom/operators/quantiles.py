"""Exact interpolated quantiles of a decimal or whole-number column.

``percentile()`` keeps every distinct value of a group in one reducer.  Here the value is read as a
whole number of its smallest unit and found in two scans: the first counts rows per cell of 2**14
units (a map-side aggregate), which places every wanted rank in one cell; the second counts the
values inside those few cells only.  Running totals are taken over the cell counts in three levels,
the topmost of at most 2**17 counts whatever the values are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Units in a cell, cells in a block and blocks in a root, as powers of two.
_CELL, _BLOCK, _ROOT = 14, 16, 17


def _targets(probs: Sequence[float], n: Column) -> Column:
    """The two row ranks (0-based) each probability falls between and the weight of each."""
    out = []
    for p in probs:
        at = F.lit(float(p)) * (n - 1)
        upper = at - F.floor(at)
        for rank, weight in ((F.floor(at), 1 - upper), (F.ceil(at), upper)):
            out.append(F.struct(F.lit(float(p)).alias("prob"), rank.cast("bigint").alias("rank"), weight.alias("weight")))
    return F.array(*out)


def _inside(targets: str) -> Column:
    return F.filter(F.col(targets), lambda t: (t["rank"] >= F.col("lo")) & (t["rank"] < F.col("hi")))


def _units(df: DataFrame, value: Column) -> tuple[Column, int]:
    """The value as a whole number of its smallest unit, and the digits after the point."""
    kind = df.select(value.alias("v")).schema["v"].dataType
    if isinstance(kind, T.IntegralType):
        return value.cast("bigint"), 0
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return (value.cast("decimal(38,18)") * F.lit(10**kind.scale).cast("decimal(19,0)")).cast("bigint"), kind.scale
    raise TypeError(f"quantiles are exact for whole numbers and decimals of up to 18 digits, not {kind.simpleString()}; cast the column or use percentile_approx")


def exact_quantiles(df: DataFrame, col: Column | str, probs: Sequence[float]) -> DataFrame:
    """Rows ``(prob, value)`` as ``PERCENTILE_CONT`` defines them; nulls are ignored.

    Other types than whole numbers and decimals of up to 18 digits are refused, not rounded.
    """
    units, scale = _units(df, F.col(col) if isinstance(col, str) else col)
    rows = df.select(units.alias("u")).filter(F.col("u").isNotNull()).withColumn("cell", F.shiftright("u", _CELL))
    levels = [F.shiftright("cell", _BLOCK + _ROOT).alias("root"), F.shiftright("cell", _BLOCK).alias("block"), F.col("cell")]
    cells = rows.groupBy(*levels).agg(F.count("*").alias("k"))

    # Rows below each root, then below each block of a root, then below each cell of a block.
    blocks = cells.groupBy("root", "block").agg(F.sum("k").alias("k"))
    roots = blocks.groupBy("root").agg(F.sum("k").alias("k"))
    before = lambda w: F.coalesce(F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    roots = roots.select("root", before(Window.orderBy("root")).alias("base"), F.sum("k").over(Window.partitionBy()).alias("n"))
    blocks = blocks.join(roots, "root").select("root", "block", "n", (F.col("base") + before(Window.partitionBy("root").orderBy("block"))).alias("base"))
    spans = cells.join(blocks, ["root", "block"]).withColumn("lo", F.col("base") + before(Window.partitionBy("root", "block").orderBy("cell")))
    spans = spans.withColumn("hi", F.col("lo") + F.col("k")).withColumn("all_targets", _targets(probs, F.col("n")))
    spans = spans.withColumn("targets", _inside("all_targets"))
    held = spans.filter(F.size("targets") > 0).select("cell", "targets", F.col("lo").alias("below"))

    # Only the cells that hold a target: at most two per probability, so AQE finds them small.
    values = rows.join(held, "cell").groupBy("cell", "u", "targets", "below").agg(F.count("*").alias("k"))
    within = Window.partitionBy("cell").orderBy("u")
    values = values.withColumn("hi", F.col("below") + F.sum("k").over(within)).withColumn("lo", F.col("hi") - F.col("k"))
    found = values.select("u", F.explode(_inside("targets")).alias("t"))
    return found.groupBy(F.col("t.prob").alias("prob")).agg(
        (F.sum(F.col("u") * F.col("t.weight")) / 10**scale).alias("value")
    )


def distribution(df: DataFrame, col: str, approx: bool = False) -> DataFrame:
    """Mean, median, sample deviation, range and quartiles of one column as one row.

    ``approx=True`` answers the quartiles from a sketch in the same scan as the rest.
    """
    value = F.col(col).cast("double")
    base = [
        (F.sum(col).cast("double") / F.count(col)).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"), F.count(col).alias("n"),
    ]
    if approx:
        q = F.percentile_approx(value, [0.25, 0.5, 0.75], 10_000)
        return df.agg(*base, q.alias("q")).select(
            "mean", F.get("q", F.lit(1)).alias("median"), "std", "min", "max", F.get("q", F.lit(0)).alias("q1"),
            F.get("q", F.lit(2)).alias("q3"), "n",
        )
    quart = exact_quantiles(df, col, [0.25, 0.5, 0.75]).agg(
        F.max(F.when(F.col("prob") == 0.25, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("prob") == 0.5, F.col("value"))).alias("median"),
        F.max(F.when(F.col("prob") == 0.75, F.col("value"))).alias("q3"),
    )
    quart = quart.select(F.struct("q1", "median", "q3")).scalar()
    return df.agg(*base).withColumn("q", quart).select(
        "mean", "q.median", "std", "min", "max", "q.q1", "q.q3", "n"
    )


def fences(stats: DataFrame, k: float = 1.5) -> DataFrame:
    """Add the interquartile range and the outlier bounds."""
    iqr = F.col("q3") - F.col("q1")
    return stats.withColumns({"iqr": iqr, "lower": F.col("q1") - k * iqr, "upper": F.col("q3") + k * iqr})
