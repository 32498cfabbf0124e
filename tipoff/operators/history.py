"""Leak-safe histories: what was known about an entity before a period.

Rows are first folded to one row per (entity, period). That fold combines on the map side, so a hot
entity does not matter, and what is left per entity is bounded by the number of periods. Windows run
over that grain only, with a range frame that ends one period back, so two rows of an entity in one
period never see each other.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipoff.operators.ranking import latest_per_key, null_safe, top_rows


@dataclass(frozen=True)
class Stat:
    """One output column: `kind` is rows, count, sum, mean, rate, min or max of `value`."""

    name: str
    kind: str
    value: Column | None = None

    def partials(self) -> dict[str, Column]:
        v = self.value
        if self.kind == "rows":
            return {"n": F.count("*")}
        if self.kind == "count":
            return {"n": F.count(v)}
        if self.kind == "sum":
            return {"s": F.sum(v)}
        if self.kind == "mean":
            return {"s": F.sum(v.cast("double")), "n": F.count(v)}
        if self.kind == "rate":
            return {"s": F.sum(v.cast("int")), "n": F.count(v)}
        if self.kind == "min":
            return {"lo": F.min(v)}
        if self.kind == "max":
            return {"hi": F.max(v)}
        raise ValueError(self.kind)

    def final(self, part) -> Column:
        if self.kind in ("rows", "count"):
            return F.coalesce(part("n"), F.lit(0))
        if self.kind == "sum":
            return F.coalesce(part("s"), F.lit(0))
        if self.kind in ("mean", "rate"):
            return part("s") / F.nullif(part("n"), F.lit(0))
        return part("lo") if self.kind == "min" else part("hi")


_MERGE = {"n": F.sum, "s": F.sum, "lo": F.min, "hi": F.max}


def period_grain(df: DataFrame, keys: Sequence[str], stats: Sequence[Stat]) -> DataFrame:
    """Partial aggregates per (entity, period)."""
    aggs = [
        column.alias(f"_{i}_{part}") for i, s in enumerate(stats) for part, column in s.partials().items()
    ]
    return df.groupBy(*keys).agg(*aggs)


def _with_grid(grain: DataFrame, grid: DataFrame | None, keys: list[str]) -> DataFrame:
    if grid is None:
        return grain
    wanted = grid.select(*keys).distinct().withColumn("_wanted", F.lit(True))
    return grain.join(wanted, keys, "full_outer")


def prior_stats(
    df: DataFrame,
    entity: Sequence[str],
    period: str,
    stats: Sequence[Stat],
    grid: DataFrame | None = None,
) -> DataFrame:
    """Statistics over all rows of the entity with a smaller period, one row per (entity, period).

    With `grid`, the output has exactly the (entity, period) pairs of the grid, which may include
    periods without rows.
    """
    keys = [*entity, period]
    grain = _with_grid(period_grain(df, keys, stats), grid, keys)
    before = Window.partitionBy(*entity).orderBy(period).rangeBetween(Window.unboundedPreceding, -1)

    def over(i: int):
        return lambda part: _MERGE[part](f"_{i}_{part}").over(before)

    columns = [s.final(over(i)).alias(s.name) for i, s in enumerate(stats)]
    marked = grain.select(*keys, *columns, *(["_wanted"] if grid is not None else []))
    return marked if grid is None else marked.where("_wanted").drop("_wanted")


def total_stats(df: DataFrame, entity: Sequence[str], stats: Sequence[Stat]) -> DataFrame:
    """The same statistics over the whole history, one row per entity."""
    grain = period_grain(df, entity, stats)

    def part_of(i: int):
        return lambda part: F.col(f"_{i}_{part}")

    return grain.select(*entity, *[s.final(part_of(i)).alias(s.name) for i, s in enumerate(stats)])


def prior_last_rows(
    df: DataFrame,
    entity: Sequence[str],
    period: str,
    tie: Sequence[str],
    payload: Sequence[str],
    k: int,
    out: str = "last_rows",
    grid: DataFrame | None = None,
) -> DataFrame:
    """The last `k` earlier rows of the entity, oldest first, as an array of structs.

    Each (entity, period) keeps at most `k` rows. The last rows up to a period lie in its last `k` periods with
    rows, so a window gathers `k` times `k` rows at most; what a period without rows sees is carried forward.
    """
    keys = [*entity, period]
    kept = top_rows(df.select(*dict.fromkeys([*keys, *tie, *payload])), keys, [F.col(t).desc() for t in tie], k)
    fields = [period, *[c for c in dict.fromkeys([*tie, *payload]) if c != period]]
    grain = kept.groupBy(*keys).agg(F.collect_list(F.struct(*fields)).alias("_rows"))
    kind = grain.schema["_rows"].dataType
    order = Window.partitionBy(*entity).orderBy(period)
    gathered = F.sort_array(F.flatten(F.collect_list("_rows").over(order.rowsBetween(1 - k, 0))))
    grain = grain.withColumn("_last", F.slice(gathered, F.greatest(F.size(gathered) - (k - 1), F.lit(1)), k)).drop("_rows")
    grain = _with_grid(grain, grid, keys)
    before = F.last("_last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    last = F.coalesce(before, F.array().cast(kind))
    marked = grain.select(*keys, last.alias(out), *(["_wanted"] if grid is not None else []))
    return marked if grid is None else marked.where("_wanted").drop("_wanted")


def last_rows(
    df: DataFrame, entity: Sequence[str], order: Sequence[str], payload: Sequence[str], k: int, out: str = "last_rows"
) -> DataFrame:
    """The last `k` rows of each entity, oldest first."""
    kept = top_rows(
        df.select(*dict.fromkeys([*entity, *order, *payload])), entity, [F.col(c).desc() for c in order], k
    )
    fields = list(dict.fromkeys([*order, *payload]))
    return kept.groupBy(*entity).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(out))


def tail_mean(array: str, field: str, k: int) -> Column:
    """Mean of a field over the last `k` array entries; null entries are skipped, not replaced."""
    a = F.col(array)
    tail = F.filter(
        F.transform(
            F.slice(a, F.greatest(F.size(a) - (k - 1), F.lit(1)), k), lambda r: r[field].cast("double")
        ),
        lambda v: v.isNotNull(),
    )
    total = F.aggregate(tail, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(tail) > 0, total / F.size(tail))


def from_end(array: str, back: int = 1) -> Column:
    """The entry `back` places from the end, or null."""
    return F.try_element_at(F.col(array), F.lit(-back))


def prior_distinct(df: DataFrame, entity: Sequence[str], period: str, item: str, out: str) -> DataFrame:
    """Number of different items seen before each period: an item counts from its first period on."""
    keys = [*entity, period]
    firsts = df.where(F.col(item).isNotNull()).groupBy(*entity, item).agg(F.min(period).alias(period))
    grain = (
        df.select(*keys).distinct().join(firsts.groupBy(*keys).agg(F.count("*").alias("_new")), keys, "left")
    )
    before = Window.partitionBy(*entity).orderBy(period).rangeBetween(Window.unboundedPreceding, -1)
    return grain.select(*keys, F.coalesce(F.sum("_new").over(before), F.lit(0)).alias(out))


def season_grid(df: DataFrame, entity: Sequence[str], period: str, through: int | None = None) -> DataFrame:
    """Every period after an entity's first one, up to one past the last seen (or `through`)."""
    last = through if through is not None else df.agg(F.max(period)).first()[0] + 1
    firsts = df.groupBy(*entity).agg((F.min(period) + 1).alias("_from")).where(F.col("_from") <= last)
    return firsts.select(*entity, F.explode(F.sequence("_from", F.lit(last).cast("int"))).alias(period))


def current_tenure(df: DataFrame, entity: str, period: str, person: str, out: str = "tenure") -> DataFrame:
    """Length of the unbroken run, back from the entity's latest period, with the same person.

    A gap in the periods or another person ends the run. Two rows of an entity in one period count
    once (the greater person name).
    """
    yearly = df.groupBy(entity, period).agg(F.max(person).alias(person))
    run = Window.partitionBy(entity, person).orderBy(period)
    runs = (
        yearly.withColumn("_run", F.col(period) - F.row_number().over(run))
        .groupBy(entity, person, "_run")
        .agg(F.count("*").alias(out), F.max(period).alias(period))
    )
    latest = latest_per_key(runs.drop("_run"), [entity], [period])
    return latest.where(F.col(person).isNotNull() & (F.col(person) != ""))


def join_history(df: DataFrame, history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach history columns; the history side has one row per key."""
    return df.join(history, null_safe(df, history, list(keys)), "left").select(
        df["*"], *[history[c] for c in history.columns if c not in keys]
    )
