"""Comparison of two tables as multisets of rows, without sorting or joining them.

Each row has a hash; a group of rows is told by how many there are, the sum of their hashes and their exclusive or,
none of which depends on an order, and all of which are partial sums.  Both tables are stacked with a sign and
aggregated once, so one shuffle carries a row for each group and task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(columns: Sequence[str]) -> Column:
    """A hash of a row in which a null differs from every value and from a null in another column."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def fingerprints(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(by, rows, hash_sum, hash_xor) of each group."""
    h = row_hash(columns)
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(h.cast("decimal(20,0)")).alias("hash_sum"), F.bit_xor(h).alias("hash_xor"))


def differences(before: DataFrame, after: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(by, rows_before, rows_after, difference) of the groups that are not the same multiset.

    ``difference`` is ``missing`` or ``added`` for a whole group, ``fewer`` or ``more`` rows, or ``changed`` rows.  A null in
    ``by`` is a group of its own.
    """
    def side(df: DataFrame, sign: int) -> DataFrame:
        # Types of the first table, so that equal values hash alike.
        h = row_hash(columns)
        typed = df.select(*by, *[F.col(c).cast(before.schema[c].dataType).alias(c) for c in columns if c not in by])
        return typed.select(*by, F.lit(sign).alias("_sign"), h.alias("_h"))

    both = side(before, 1).unionByName(side(after, -1))
    first = F.col("_sign") == 1
    # Two sums of the hash, since one alone can be met by chance: of the hash, and of a hash of the hash.
    again = F.xxhash64("_h").cast("decimal(20,0)")
    out = both.groupBy(*by).agg(
        F.count_if(first).alias("rows_before"), F.count_if(~first).alias("rows_after"),
        F.sum(F.col("_h").cast("decimal(20,0)") * F.col("_sign")).alias("_sum"), F.sum(again * F.col("_sign")).alias("_again"), F.bit_xor("_h").alias("_xor"),
    )
    same = (F.col("rows_before") == F.col("rows_after")) & (F.col("_sum") == 0) & (F.col("_again") == 0) & (F.col("_xor") == 0)
    kind = (
        F.when(F.col("rows_after") == 0, "missing").when(F.col("rows_before") == 0, "added")
        .when(F.col("rows_after") < F.col("rows_before"), "fewer").when(F.col("rows_after") > F.col("rows_before"), "more").otherwise("changed")
    )
    return out.where(~same).select(*by, "rows_before", "rows_after", kind.alias("difference"))


def validated(history: DataFrame, target: DataFrame, by: Sequence[str], columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(by, source_rows, target_rows, match, difference) for each of ``names`` and every other group.

    The counts that a migration is checked by, made exact: a group matches if the rows are the same, not only as many.
    """
    found = differences(history, target, by, columns).withColumnsRenamed({b: f"_{b}" for b in by})
    sides = [df.select(*by, F.lit(k).alias("_k")) for k, df in enumerate((history, target))]
    counted = sides[0].unionByName(sides[1]).groupBy(*by).agg(F.count_if(F.col("_k") == 0).alias("source_rows"), F.count_if(F.col("_k") == 1).alias("target_rows"))
    if names and len(by) == 1:
        none = history.sparkSession.createDataFrame([(n, 0, 0) for n in names], f"{by[0]} string, source_rows long, target_rows long")
        counted = counted.unionByName(none).groupBy(*by).agg(F.sum("source_rows").alias("source_rows"), F.sum("target_rows").alias("target_rows"))
    on = F.lit(True)
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_{b}"))
    out = counted.join(found.drop("rows_before", "rows_after"), on, "left")
    return out.select(*by, "source_rows", "target_rows", F.col("difference").isNull().alias("match"), "difference")
