"""Keyed assembly: lookups, lagged lookups, supplements, merges and overrides."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tipoff.operators.graph import components
from tipoff.operators.ranking import latest_per_key, top_rows
from tipoff.session import pinned


def prefixed(df: DataFrame, prefix: str, keep: Sequence[str] = (), drop: Sequence[str] = ()) -> DataFrame:
    """Prefix every column except the kept ones; dropped ones go."""
    return df.select(
        *[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns if c not in drop]
    )


def lookup(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column] | None = None,
    prefix: str = "",
    drop: Sequence[str] = (),
    lag: Mapping[str, int] | None = None,
    how: str = "left",
) -> DataFrame:
    """Left equi join against one row per key.

    `order` names what decides between rows of one key (the greatest wins); without it the right
    side must be unique. `lag` shifts integer keys of the right side, so `{"season": 1}` attaches
    the row of the season before.
    """
    side = right if order is None else latest_per_key(right, keys, order)
    side = prefixed(side, prefix, keep=keys, drop=drop)
    for key, step in (lag or {}).items():
        side = side.withColumn(key, F.col(key) + step)
    return left.join(side, list(keys), how)


def attach_children(
    left: DataFrame, children: DataFrame, keys: Sequence[str], fields: Sequence[str], out: str
) -> DataFrame:
    """Rows of a child table beside their parent, one row per child and one for a childless parent.

    The children stay long: no group is gathered into an array.
    """
    side = children.select(*keys, F.struct(*fields).alias(out))
    return left.join(side, list(keys), "left")


def both_seasons(
    games: DataFrame,
    features: DataFrame,
    columns: Sequence[str],
    season: str = "season",
    home: str = "home_key",
    away: str = "away_key",
    team: str = "team_key",
    prior: str = "left",
) -> DataFrame:
    """Features of both sides of a game, for its season (inner) and the season before (`prior`).

    Output columns are `<side>_<now|prior>_<column>`.
    """
    out = games
    for side, key in (("home", home), ("away", away)):
        for when, step, how in (("now", 0, "inner"), ("prior", 1, prior)):
            right = features.select(
                (F.col(season) + step).alias(season),
                F.col(team).alias(key),
                *[F.col(c).alias(f"{side}_{when}_{c}") for c in columns],
                F.lit(True).alias(f"{side}_{when}_found"),
            )
            out = out.join(right, [season, key], how)
    return out


def merge_sources(sources: Sequence[DataFrame], keys: Sequence[str], shared: Sequence[str] = ()) -> DataFrame:
    """Full outer merge of feeds that are unique per key.

    A `shared` column comes from the first feed that has a value. One grouping of the stacked feeds
    does it, instead of a chain of outer joins that shuffle the growing result again and again.
    """
    stacked = [
        df.select(*keys, F.lit(i).alias("_feed"), F.struct(*[c for c in df.columns if c not in keys]).alias(f"_f{i}"))
        for i, df in enumerate(sources)
    ]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stacked)
    rows = union.groupBy(*keys).agg(
        *[F.max_by(f"_f{i}", F.when(F.col("_feed") == i, F.lit(1))).alias(f"_f{i}") for i in range(len(sources))]
    )
    own = [
        F.col(f"_f{i}")[c].alias(c)
        for i, df in enumerate(sources)
        for c in df.columns
        if c not in keys and c not in shared
    ]
    common = [
        F.coalesce(*[F.col(f"_f{i}")[c] for i, df in enumerate(sources) if c in df.columns]).alias(c)
        for c in shared
    ]
    return rows.select(*keys, *common, *own)


def override(
    left: DataFrame, changes: DataFrame, keys: Sequence[str], column: str, new_value: str, apply_when: Column
) -> DataFrame:
    """Replace `column` by `new_value` of the change row where `apply_when` holds."""
    joined = left.join(changes, list(keys), "left")
    use = F.coalesce(apply_when, F.lit(False)) & F.col(new_value).isNotNull()
    return joined.withColumn(column, F.when(use, F.col(new_value)).otherwise(F.col(column)))


def missing_rows(base: DataFrame, extra: DataFrame, key_sets: Sequence[Sequence[str]]) -> DataFrame:
    """Rows of `extra` whose keys do not occur in `base` under any of the key sets.

    A key set with a null or blank part never matches.
    """
    out = extra
    for keys in key_sets:
        known = base.select(*keys).where(_filled(keys)).distinct()
        out = out.join(known, list(keys), "left_anti")
    return out


def _filled(keys: Sequence[str]) -> Column:
    return reduce(and_, [F.col(k).isNotNull() & (F.col(k).cast("string") != "") for k in keys])


def _decide_in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Places of the rows a sequential pass keeps; rows come sorted by component, then order."""
    root, taken = None, set()
    for pdf in batches:
        kept = []
        for place, mine, keys in zip(pdf["_place"], pdf["_root"], pdf["_keys"]):
            if mine != root:
                root, taken = mine, set()
            if taken.isdisjoint(keys):
                taken.update(keys)
                kept.append(place)
        yield pd.DataFrame({"_place": pd.Series(kept, dtype=pdf["_place"].dtype)})


def _free(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows that share no key with a kept one and are not kept themselves."""
    gone = rows.select("_place", F.explode("_keys").alias("_key")).join(
        kept.select(F.explode("_keys").alias("_key")).distinct(), "_key", "left_semi"
    )
    return rows.join(gone.select("_place").union(kept.select("_place")).distinct(), "_place", "left_anti")


def first_rows_greedy(
    df: DataFrame, key_sets: Sequence[Sequence[str]], order: str, block: int = 1_000_000
) -> DataFrame:
    """Keep a row, going down by the unique `order`, unless it shares a key with a row already kept.

    Only rows connected by shared keys depend on each other. Rows that come first under all their keys are
    kept at once. The others fall into connected components, found in about log n rounds of joins, and tasks
    go through the components in order. A component of more than `block` rows is decided by its first `block`
    rows at a time: no later row bears on them. So no task holds more than `block` rows of a component, and
    the steps are at most the rows of the largest component over `block`, rounded up, however long its chains are.
    Key sets with a null or blank part join nothing.
    """
    source = pinned(df)
    keys = [F.when(_filled(k), F.to_json(F.struct(F.lit(i).alias("_set"), *k))) for i, k in enumerate(key_sets)]
    open_rows = source.select(F.col(order).alias("_place"), F.array_compact(F.array(*keys)).alias("_keys"))
    kept = open_rows.where(F.size("_keys") == 0).select("_place")
    open_rows = open_rows.where(F.size("_keys") > 0)
    while True:
        uses = open_rows.select("_place", "_keys", F.explode("_keys").alias("_key"))
        leads = uses.groupBy("_key").agg(F.min("_place").alias("_lead"))
        first = uses.join(leads, "_key").groupBy("_place").agg(
            F.min(F.col("_lead") == F.col("_place")).alias("_first"), F.collect_list("_key").alias("_keys")
        )
        first = pinned(first.where("_first").select("_place", "_keys"))
        kept = kept.union(first.select("_place"))
        open_rows = pinned(_free(open_rows, first))
        uses = open_rows.select("_place", F.explode("_keys").alias("_key"))
        leads = uses.groupBy("_key").agg(F.min("_place").alias("_lead"))
        roots = components(uses.join(leads, "_key").select(F.col("_lead").alias("a"), F.col("_place").alias("b")))
        roots = roots.select(F.col("node").alias("_place"), F.col("root").alias("_root"))
        placed = open_rows.join(roots, "_place", "left").withColumn("_root", F.coalesce("_root", "_place"))
        placed = pinned(placed)
        head = top_rows(placed, ["_root"], [F.col("_place")], block).drop("_rank")
        sorted_head = head.repartition("_root").sortWithinPartitions("_root", "_place")
        schema = StructType([placed.schema["_place"]])
        accepted = pinned(sorted_head.mapInPandas(_decide_in_order, schema))
        kept = kept.union(accepted)
        large = placed.groupBy("_root").agg(F.count("*").alias("_n")).where(F.col("_n") > block)
        rest = placed.join(large, "_root", "left_semi").drop("_root")
        if rest.isEmpty():
            break
        last = head.groupBy("_root").agg(F.max("_place").alias("_last"))
        rest = placed.join(large, "_root", "left_semi").join(last, "_root").where("_place > _last")
        chosen = placed.join(accepted, "_place", "left_semi").select("_place", "_keys")
        open_rows = pinned(_free(rest.select("_place", "_keys"), chosen))
    return source.join(kept.withColumnRenamed("_place", order), order, "left_semi").select(*df.columns)


def supplement(
    base: DataFrame, extra: DataFrame, key_sets: Sequence[Sequence[str]], order: str, fill: Mapping[str, Column]
) -> DataFrame:
    """Add placeholder rows for entries absent from `base` under every key set.

    Within the extra rows an entry also counts once. `fill` gives the placeholder columns.
    """
    fresh = first_rows_greedy(missing_rows(base, extra, key_sets), key_sets, order)
    rows = fresh.select(*[c for c in fresh.columns if c in base.columns and c not in fill], *[v.alias(k) for k, v in fill.items()])
    return base.unionByName(rows, allowMissingColumns=True)


def keep_complete(df: DataFrame, keys: Sequence[str], item: str, items: Sequence[str], value: str) -> DataFrame:
    """One row per key with one column per item; keys that lack an item or a value are dropped."""
    wide = (
        df.where(F.col(item).isin(*items))
        .groupBy(*keys)
        .agg(*[F.max(F.when(F.col(item) == i, F.col(value))).alias(i) for i in items])
    )
    return wide.dropna(subset=list(items))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first by `order`."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def any_of(*tests: Column) -> Column:
    return reduce(or_, tests)


def window_counts(df: DataFrame, by: Sequence[str], out: str) -> DataFrame:
    """Group sizes attached by a join with the combined counts."""
    sizes = df.groupBy(*by).agg(F.count("*").alias(out))
    return df.join(sizes, list(by), "left")


