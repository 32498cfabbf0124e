"""Ranks, percentiles, running totals and medians that never hold a whole group in one task.

A season, a conference or the whole table may be one group, so ordering inside it cannot be left to
a window partitioned by the group. The rows are placed by range over (group, order) instead, which
splits a group of any size, and each piece learns how much came before it from a table with one row
per piece.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipoff.session import pinned, shuffle_width


def null_safe(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    return reduce(and_, [left[c].eqNullSafe(right[c]) for c in columns])


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    values: Sequence[str],
) -> DataFrame:
    """Add `<value>_before`: the total of the rows ordered earlier in the same group.

    `order` must be a total order inside a group. The placed rows are pinned, so that the pieces
    and the totals of the pieces agree whatever is recomputed later.
    """
    by, values = list(by), list(values)
    placed = pinned(
        df.repartitionByRange(shuffle_width(df), *[F.col(c) for c in by], *order).withColumn(
            "_piece", F.spark_partition_id()
        )
    )
    pieces = placed.groupBy("_piece", *by).agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    earlier = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        F.col("_piece").alias("_offset_piece"),
        *[F.col(c).alias(f"_offset_by_{c}") for c in by],
        *[F.coalesce(F.sum(f"_sum_{v}").over(earlier), F.lit(0)).alias(f"_start_{v}") for v in values],
    )
    inside = (
        Window.partitionBy("_piece", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    local = placed.select(
        "*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_inner_{v}") for v in values]
    )
    same = reduce(
        and_,
        [F.col(c).eqNullSafe(F.col(f"_offset_by_{c}")) for c in by],
        F.col("_piece") == F.col("_offset_piece"),
    )
    return local.join(offsets, same).select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_inner_{v}") + F.col(f"_start_{v}")).alias(f"{v}_before") for v in values],
    )


def ordinal_rank(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], rank: str = "rank", size: str | None = None
) -> DataFrame:
    """Add a rank 1..n without ties, and with `size` the number of rows of the group."""
    counted = running_totals(df.withColumn("_one", F.lit(1).cast("long")), by, order, ["_one"])
    out = counted.withColumn(rank, F.col("_one_before") + 1).drop("_one", "_one_before")
    if size is None:
        return out
    totals = df.groupBy(*by).agg(F.count("*").alias(size))
    if not by:
        return out.withColumn(size, F.lit(totals.first()[0]))
    totals = totals.select(*[F.col(c).alias(f"_size_by_{c}") for c in by], size)
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_size_by_{c}")) for c in by])
    return out.join(totals, same).drop(*[f"_size_by_{c}" for c in by])


def ordinal_percentiles(
    df: DataFrame, by: Sequence[str], keys: Sequence[str], columns: Sequence[str], suffix: str = "_percentile"
) -> DataFrame:
    """For every column the place of the row among the non-null values of its group, 0 to 1.

    Ties are ordered by `keys`, and a group with one value gives 0. All columns share one placement.
    """
    by, keys = list(by), list(keys)
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    long = (
        df.select(*by, *keys, F.expr(f"stack({len(columns)}, {pairs}) as (_column, _value)"))
        .where(F.col("_value").isNotNull())
    )
    ranked = ordinal_rank(long, [*by, "_column"], [F.col("_value"), *[F.col(k) for k in keys]], "_rank", "_n")
    share = (F.col("_rank") - 1) / F.greatest(F.col("_n") - 1, F.lit(1))
    wide = (
        ranked.withColumn("_share", share)
        .groupBy(*by, *keys)
        .agg(*[F.max(F.when(F.col("_column") == c, F.col("_share"))).alias(f"{c}{suffix}") for c in columns])
    )
    return df.join(wide, [*by, *keys], "left")


def order_statistics(
    df: DataFrame, by: Sequence[str], value: str, positions: dict[str, Column]
) -> DataFrame:
    """Values at given 0-based places of each group; a place may use `_n`, the size of the group.

    Equal values are counted first, so the placement moves one row per distinct value.
    """
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    placed = running_totals(counts, by, [F.col(value)], ["_c"])
    sizes = counts.groupBy(*by).agg(F.sum("_c").alias("_n"))
    if by:
        sizes = sizes.select(*[F.col(c).alias(f"_n_{c}") for c in by], "_n")
        placed = placed.join(sizes, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_n_{c}")) for c in by]))
    else:
        placed = placed.withColumn("_n", F.lit(sizes.first()[0]))

    def holds(place: Column) -> Column:
        return (F.col("_c_before") <= place) & (place < F.col("_c_before") + F.col("_c"))

    return placed.groupBy(*by).agg(
        *[F.max(F.when(holds(place), F.col(value))).alias(name) for name, place in positions.items()],
        F.max("_n").alias("_n"),
    )


def medians(
    df: DataFrame,
    by: Sequence[str],
    columns: Sequence[str],
    rows_bound: int | None = None,
) -> DataFrame:
    """Exact medians of finite values, one row per group, the mean of the two middle values.

    When the caller knows that no group exceeds `rows_bound` rows and that is at most a million, the
    built-in aggregate does it in one pass; otherwise the values are placed by range.
    """
    by = list(by)

    def finite(c: str) -> Column:
        v = F.col(c).cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)

    if rows_bound is not None and rows_bound <= 1_000_000:
        return df.groupBy(*by).agg(*[F.median(finite(c)).alias(c) for c in columns])
    named = df.select(*by, *[finite(c).alias(f"_v{i}") for i, c in enumerate(columns)])
    pairs = ", ".join(f"{i}, `_v{i}`" for i in range(len(columns)))
    long = named.select(*by, F.expr(f"stack({len(columns)}, {pairs}) as (_column, _value)"))
    n = F.col("_n")
    middle = order_statistics(
        long, [*by, "_column"], "_value", {"_low": F.floor((n - 1) / 2), "_high": F.floor(n / 2)}
    ).withColumn("_median", (F.col("_low") + F.col("_high")) / 2)
    wide = middle.groupBy(*by).agg(
        *[F.max(F.when(F.col("_column") == i, F.col("_median"))).alias(c) for i, c in enumerate(columns)]
    )
    if not by:
        return wide
    groups = df.select(*by).distinct()
    return groups.join(wide, null_safe(groups, wide, by), "left").select(
        *[groups[c] for c in by], *[wide[c] for c in columns]
    )


def top_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "_rank") -> DataFrame:
    """First `k` rows of each group. The bound on the rank lets Spark cut each map task to `k` rows
    per group before the shuffle, so a hot group costs no more than a small one."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def latest_per_key(df: DataFrame, by: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The row with the greatest `order` values of each key, by a combinable aggregate."""
    by = list(by)
    rest = [c for c in df.columns if c not in by]
    best = F.max_by(F.struct(*rest), F.struct(*order)) if rest else F.lit(None)
    return df.groupBy(*by).agg(best.alias("_row")).select(*by, *[F.col("_row")[c].alias(c) for c in rest])


def rating_curve(df: DataFrame, rating: str, tie: Sequence[str]) -> DataFrame:
    """One row per place on the rating list, best first: `place`, `rating`, `next_rating`."""
    ranked = ordinal_rank(
        df.where(F.col(rating).isNotNull()).select(rating, *tie),
        [],
        [F.col(rating).desc(), *[F.col(t) for t in tie]],
        "place",
    ).select("place", F.col(rating).alias("rating"))
    after = ranked.select((F.col("place") - 1).alias("place"), F.col("rating").alias("next_rating"))
    return ranked.join(after, "place", "left").withColumn(
        "next_rating", F.coalesce("next_rating", "rating")
    )


def rating_at_rank(df: DataFrame, rank: str, curve: DataFrame, out: str, last_place: int) -> DataFrame:
    """Rating at a fractional rank, read off the curve between two places, to two decimals."""
    inside = F.greatest(F.least(F.col(rank).cast("double"), F.lit(float(last_place))), F.lit(1.0))
    placed = df.withColumn("_at", F.when(F.col(rank).isNotNull(), inside)).withColumn(
        "place", F.floor("_at")
    )
    step = F.col("rating") + (F.col("next_rating") - F.col("rating")) * (F.col("_at") - F.col("place"))
    return placed.join(curve, "place", "left").withColumn(out, F.bround(step, 2)).drop(
        "_at", "place", "rating", "next_rating"
    )
