"""Group summaries: wide status roll-ups, weighted means, back-off calibration, strength of schedule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipoff import fixed_values as fixed
from tipoff.functions.scalar import ratio, share
from tipoff.operators.ranking import latest_per_key, null_safe, top_rows


def weighted_mean(value: Column, weight: Column, null_as_zero: bool = False) -> Column:
    """Aggregate: mean under positive weights. A null value is skipped, or counts as 0."""
    w = F.coalesce(weight, F.lit(0.0))
    v = F.coalesce(value, F.lit(0.0)) if null_as_zero else value
    use = (w > 0) & v.isNotNull()
    return F.sum(F.when(use, v * w)) / F.nullif(F.sum(F.when(use, w)), F.lit(0.0))


def number(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0)).cast("double")


# Groups of statuses of the roster summary.
STATUS_GROUPS = {
    "expected_returning": fixed.RETURNING_STATUSES,
    "lost_or_uncertain": fixed.LOST_STATUSES,
    "confirmed_unavailable": (
        "transferred_out_committed",
        "draft_prospect_review",
        "senior_eligibility_review",
    ),
    "portal_pending": ("in_portal_uncommitted_or_pending",),
}
# Totals that the roster summary reports.
TOTAL_STATS = (
    "minutes", "possessions", "points", "games_started", "field_goal_attempts", "free_throw_attempts",
    "assists", "rebounds", "steals", "blocks", "turnovers", "warp", "win_shares",
)
CORE_MEASURES = ("minutes", "possessions", "points", "warp", "win_shares")


def status_summary(
    rows: DataFrame,
    keys: Sequence[str],
    status: str = "status",
    weight: str = "minutes",
    statuses: Sequence[str] = fixed.STATUS_LABELS,
    groups: Mapping[str, Sequence[str]] = STATUS_GROUPS,
    counting: Sequence[str] = fixed.ROSTER_COUNTING_STATS,
    rates: Sequence[str] = fixed.ROSTER_RATE_STATS,
    status_stats: Sequence[str] = ("minutes", "possessions", "points"),
    totals: Sequence[str] = TOTAL_STATS,
    flags: Mapping[str, Column] | None = None,
    net: tuple[str, str, str] | None = ("net_rating", "ortg_player", "drtg_player"),
) -> DataFrame:
    """Sums, shares of the total, weighted means and threshold counts per status and status group.

    The big table is folded once to (keys, status); the wide columns are built on that grain, which
    has at most one row per status.
    """
    keys = list(keys)
    w = number(weight)
    flags = flags if flags is not None else {
        "high_usage_players": (w >= 200) & (number("usage_pct") >= 0.20),
        "double_digit_per_players": (w >= 200) & (number("per") >= 10),
        "positive_warp_players": number("warp") >= 0.01,
        "plus_one_warp_players": number("warp") >= 1.0,
    }
    sums = list(dict.fromkeys([*counting, *status_stats, *totals]))
    grain = rows.groupBy(*keys, status).agg(
        F.count("*").alias("_rows"),
        *[F.sum(number(c)).alias(f"_s_{c}") for c in sums],
        *[F.sum(F.when(w > 0, number(c) * w)).alias(f"_w_{c}") for c in rates],
        F.sum(F.when(w > 0, w)).alias("_weight"),
        *[F.count_if(test).alias(f"_f_{name}") for name, test in flags.items()],
    )
    needed = ["_rows", "_weight", *[f"_s_{c}" for c in sums], *[f"_w_{c}" for c in rates], *[f"_f_{f}" for f in flags]]

    def inside(labels: Sequence[str], c: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col(status).isin(*labels), F.col(c))), F.lit(0))

    aggs = [F.sum("_rows").alias("players")]
    aggs += [F.sum(f"_s_{c}").alias(f"total_{c}") for c in sums]
    for label in statuses:
        aggs.append(inside([label], "_rows").alias(f"{label}_players"))
        aggs += [inside([label], f"_s_{c}").alias(f"{label}_{c}") for c in status_stats]
    for name, labels in groups.items():
        aggs += [inside(labels, c).alias(f"_{name}{c}") for c in needed if c.startswith(("_s_", "_w_", "_f_")) or c in ("_rows", "_weight")]
    wide = grain.groupBy(*keys).agg(*aggs)

    out = [*keys, "players", *[f"total_{c}" for c in totals]]
    for label in statuses:
        out.append(f"{label}_players")
        for c in status_stats:
            out += [f"{label}_{c}", share(F.col(f"{label}_{c}"), F.col(f"total_{c}")).alias(f"{label}_{c}_pct")]
    for name in groups:
        part = lambda c, name=name: F.col(f"_{name}{c}")
        mean = lambda c, part=part: part(f"_w_{c}") / F.nullif(part("_weight").cast("double"), F.lit(0.0))
        out.append(part("_rows").alias(f"{name}_players"))
        for c in counting:
            out += [
                part(f"_s_{c}").alias(f"{name}_{c}"),
                share(part(f"_s_{c}"), F.col(f"total_{c}")).alias(f"{name}_{c}_pct"),
            ]
        out += [mean(c).alias(f"{name}_{weight}_weighted_{c}") for c in rates]
        out += [part(f"_f_{flag}").alias(f"{name}_{flag}") for flag in flags]
        if net:
            out.append((mean(net[1]) - mean(net[2])).alias(f"{name}_{weight}_weighted_{net[0]}"))
    return wide.select(*out)


def core_shares(
    rows: DataFrame,
    keys: Sequence[str],
    tie: str,
    returning: Column,
    measures: Sequence[str] = CORE_MEASURES,
    cutoffs: Sequence[int] = (3, 5, 7),
    weight: str = "minutes",
) -> DataFrame:
    """How much of the top-k production by each measure is returning, and of all minutes in the top 7."""
    keys = list(keys)
    pairs = ", ".join(f"'{m}', cast(coalesce(`{m}`, 0) as double)" for m in measures)
    long = rows.select(
        *keys, tie, returning.alias("_back"), F.expr(f"stack({len(measures)}, {pairs}) as (_measure, _value)")
    )
    top = top_rows(long, [*keys, "_measure"], [F.col("_value").desc(), F.col(tie)], max(cutoffs))
    value, back, at = F.col("_value"), F.col("_back"), F.col("_rank")

    def named(m: str, k: int) -> list[Column]:
        mine = (F.col("_measure") == m) & (at <= k)
        kept = F.sum(F.when(mine & back, value).when(mine, 0.0))
        return [
            F.count_if(mine & back).alias(f"returning_top_{k}_{m}_players"),
            share(kept, F.sum(F.when(mine, value))).alias(f"returning_top_{k}_{m}_share"),
        ]

    last = max(cutoffs)
    kept_minutes = F.sum(F.when((F.col("_measure") == weight) & back, value))
    wide = top.groupBy(*keys).agg(
        *[c for m in measures for k in cutoffs for c in named(m, k)],
        F.coalesce(kept_minutes, F.lit(0.0)).alias("_kept"),
    )
    totals = rows.groupBy(*keys).agg(F.sum(number(weight)).alias("_all"))
    joined = wide.join(totals, null_safe(wide, totals, keys)).select(wide["*"], totals["_all"])
    name = f"expected_returning_top_{last}_{weight}_roster_share"
    return joined.withColumn(name, share(F.col("_kept"), F.col("_all"))).drop("_kept", "_all")


def floor_total(rows: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Group totals where a negative or missing value counts as 0."""
    return rows.groupBy(*keys).agg(F.sum(F.greatest(number(value), F.lit(0.0))).alias(out))


def greatest_row(rows: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str | Column]) -> DataFrame:
    """The row with the greatest value per key; `tie` decides between equals (greatest wins)."""
    return latest_per_key(rows, keys, [number(value), *tie])


def class_summary(
    rows: DataFrame,
    keys: Sequence[str],
    percentile: str,
    rank: str,
    name: str,
    rating: str,
    position: str,
    carry: Sequence[str] = (),
    prefix: str = "on3_hs_player_",
) -> DataFrame:
    """Recruiting-class summary with decaying weights by place.

    Only the leading rows need an order; everything after them has one weight, so their part comes
    from plain sums.
    """
    keys = list(keys)
    lead = len(fixed.CLASS_WEIGHTS)
    p = F.col(percentile)
    order = [F.coalesce(p, F.lit(-1.0)).desc(), F.coalesce(F.nullif(F.col(rank), F.lit(0.0)), F.lit(9999.0)), F.col(name)]
    head = top_rows(rows.where(p.isNotNull()), keys, order, lead)
    extra = F.element_at(F.array(*[F.lit(w - fixed.CLASS_TAIL_WEIGHT) for w in fixed.CLASS_WEIGHTS]), F.col("_rank").cast("int"))
    first = F.min_by(F.struct(percentile, rank, *carry), F.col("_rank"))
    heads = head.groupBy(*keys).agg(
        F.sum(p * extra).alias("_extra"), F.sum(extra).alias("_extra_w"), first.alias("_first")
    )
    pos = F.col(position)
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias(f"{prefix}count"),
        *[
            F.count_if((F.floor(rank) > 0) & (F.floor(rank) <= n)).alias(f"{prefix}top_{n}_count")
            for n in (25, 50, 100)
        ],
        F.sum(p).alias("_sum"),
        F.count(p).alias("_n"),
        F.avg(rating).alias(f"{prefix}avg_rating"),
        F.count_if(pos == "pg").alias(f"{prefix}pg_count"),
        F.count_if(pos.isin("pg", "guard")).alias(f"{prefix}guard_count"),
        F.count_if(pos.isin("forward", "wing")).alias(f"{prefix}forward_count"),
        F.count_if(pos == "big").alias(f"{prefix}big_count"),
    )
    tail = F.lit(fixed.CLASS_TAIL_WEIGHT)
    joined = sums.join(heads, keys)
    plain = [c for c in sums.columns if not c.startswith("_") and c not in keys]
    return joined.select(
        *keys,
        *[F.col("_first")[c].alias(c) for c in carry],
        *plain,
        F.col("_first")[rank].alias(f"{prefix}best_rank"),
        F.col("_first")[percentile].alias(f"{prefix}top_percentile"),
        (F.col("_sum") / F.col("_n")).alias(f"{prefix}avg_percentile"),
        ((F.col("_sum") * tail + F.col("_extra")) / (F.col("_n") * tail + F.col("_extra_w"))).alias(
            f"{prefix}weighted_percentile"
        ),
    )


def backoff_table(rows: DataFrame, bucket: str, position: str, value: str) -> DataFrame:
    """Sample size and mean at four levels: bucket and position, bucket, position, all.

    One pass; a level a row does not use is null there and named by `level` (0, 1, 2, 3).
    """
    level = F.grouping_id()
    return rows.groupingSets(
        [[F.col(bucket), F.col(position)], [F.col(bucket)], [F.col(position)], []], bucket, position
    ).agg(level.cast("int").alias("level"), F.count(value).alias("sample"), F.avg(value).alias("mean"))


def backoff_lookup(
    df: DataFrame,
    table: DataFrame,
    bucket: str,
    position: str,
    minimum: int,
    out: str,
    levels: Sequence[str] = ("both", "bucket", "position"),
    fallback: Column | float = 0.06,
    last_positive: bool = True,
) -> DataFrame:
    """Mean at the finest level with enough samples, else the overall mean, else the fallback.

    The table holds one row per label combination; whether it is small enough to broadcast is left to Spark.
    """
    ids = {"both": 0, "bucket": 1, "position": 2}
    on = {"both": [bucket, position], "bucket": [bucket], "position": [position]}
    out_df = df
    picks = []
    for name in levels:
        side = table.where(F.col("level") == ids[name]).select(
            *on[name], F.when(F.col("sample") >= minimum, F.col("mean")).alias(f"_at_{name}")
        )
        out_df = out_df.join(side, on[name], "left")
        picks.append(F.col(f"_at_{name}"))
    overall = table.where(F.col("level") == 3).select("mean", "sample").first()
    if overall is not None and overall["mean"] is not None and (overall["mean"] != 0 or not last_positive):
        picks.append(F.lit(float(overall["mean"])))
    picks.append(fallback if isinstance(fallback, Column) else F.lit(float(fallback)))
    return out_df.withColumn(out, F.coalesce(*picks)).drop(*[f"_at_{n}" for n in levels])


def incoming_summary(
    rows: DataFrame,
    keys: Sequence[str],
    source: str,
    counts: Mapping[str, Column],
    sums: Mapping[str, Column],
    means: Mapping[str, Column],
    weight: str,
    prefix: str,
) -> DataFrame:
    """Summary of arrivals: head count, distinct sources, threshold counts, sums and weighted means."""
    per_source = rows.groupBy(*keys, source).agg(
        F.count("*").alias("_n"),
        *[F.count_if(test).alias(f"_c_{n}") for n, test in counts.items()],
        *[F.sum(number(v)).alias(f"_s_{n}") for n, v in sums.items()],
        *[
            F.sum(F.when((number(weight) > 0) & v.isNotNull(), v * number(weight))).alias(f"_w_{n}")
            for n, v in means.items()
        ],
        *[
            F.sum(F.when((number(weight) > 0) & v.isNotNull(), number(weight))).alias(f"_d_{n}")
            for n, v in means.items()
        ],
    )
    return per_source.groupBy(*keys).agg(
        F.sum("_n").alias(f"{prefix}players"),
        F.count(source).alias(f"{prefix}source_teams"),
        *[F.sum(f"_c_{n}").alias(f"{prefix}{n}") for n in counts],
        *[F.sum(f"_s_{n}").alias(f"{prefix}{n}") for n in sums],
        *[
            (F.sum(f"_w_{n}") / F.nullif(F.sum(f"_d_{n}"), F.lit(0.0))).alias(f"{prefix}{weight}_weighted_{n}")
            for n in means
        ],
    )


def rank_targets(rows: DataFrame, group: Sequence[str], rank: str, bands: Sequence[int] = fixed.LABEL_BANDS) -> DataFrame:
    """Percentile, field size and band flags of ranked rows, per file or season."""
    ranked = rows.where(F.col(rank).isNotNull())
    sizes = ranked.groupBy(*group).agg(F.count("*").alias("teams_ranked"))
    r, n = F.col(rank), F.col("teams_ranked")
    return ranked.join(sizes, list(group)).withColumns(
        {
            "net_percentile": F.when(n > 1, 1 - (r - 1) / F.nullif(n - 1, F.lit(0))),
            **{f"top_{b}": r <= b for b in bands},
            "below_200": r > 200,
        }
    )


def both_sides(
    games: DataFrame,
    season: str,
    home: str,
    away: str,
    home_rating: str,
    away_rating: str,
    neutral: Column,
    advantage: float = fixed.HOME_ADVANTAGE,
) -> DataFrame:
    """Schedule strength of each team and season: every game is seen from both of its sides.

    The opponent counts less at home and more away; the shares of home and neutral games go along.
    """
    shift = F.when(neutral, 0.0).otherwise(advantage)
    sides = F.array(
        F.struct(
            F.col(home).alias("team"),
            (F.col(away_rating) - shift).alias("opponent"),
            F.when(neutral, 0).otherwise(1).alias("at_home"),
        ),
        F.struct(
            F.col(away).alias("team"), (F.col(home_rating) + shift).alias("opponent"), F.lit(0).alias("at_home")
        ),
    )
    rated = games.where(F.col(home_rating).isNotNull() & F.col(away_rating).isNotNull())
    long = rated.select(season, neutral.cast("int").alias("_neutral"), F.inline(sides))
    return long.groupBy(season, "team").agg(
        F.avg("opponent").alias("avg_adj_em"),
        F.avg("at_home").alias("home_share"),
        F.avg("_neutral").alias("neutral_share"),
        F.count("*").alias("games"),
    )


def game_record(prefix: str, allowed: bool = False) -> Mapping[str, tuple[str, Column | None]]:
    """Statistics of a coach's games as (kind, value) for a history; see `finish_record`."""
    margin = F.col("margin_over_expected_for_away")
    return {
        f"{prefix}_games": ("rows", None),
        f"{prefix}_upset{'_allowed' if allowed else ''}_rate": ("rate", F.col("upset") == 1),
        f"{prefix}_close{'_allowed' if allowed else ''}_rate": (
            "rate",
            F.coalesce(F.col("score_margin_for_away") >= -10, F.lit(False)),
        ),
        f"{prefix}_{'under' if allowed else 'over'}_expected_rate": ("rate", margin > 0),
        f"{prefix}_avg_margin{'_allowed' if allowed else ''}_over_expected": ("mean", margin),
    }


def label_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts of every label of several columns, as (column, label, rows)."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as string)" for c in columns)
    return (
        df.select(F.expr(f"stack({len(columns)}, {pairs}) as (column, label)"))
        .groupBy("column", "label")
        .agg(F.count("*").alias("rows"))
    )


def range_means(curve: DataFrame, ranges: Mapping[str, tuple[int, int | None]]) -> DataFrame:
    """Mean rating of places lo..hi of a rating curve, to two decimals; ranges may overlap."""
    rows = F.array(
        *[
            F.when(
                (F.col("place") >= lo) & (F.lit(True) if hi is None else F.col("place") <= hi), F.lit(name)
            )
            for name, (lo, hi) in ranges.items()
        ]
    )
    return (
        curve.select("rating", F.explode(F.filter(rows, lambda n: n.isNotNull())).alias("tier"))
        .groupBy("tier")
        .agg(F.bround(F.avg("rating"), 2).alias("mean_rating"))
    )


def placeholders(df: DataFrame, tier: str, score: str, rating: str) -> DataFrame:
    """One stand-in row per tier with the mean score and rating of its members."""
    known = df.where(F.col(tier).isin(*fixed.BAND_LABELS))
    return (
        known.groupBy(F.col(tier).alias("tier"))
        .agg(F.bround(F.avg(score), 1).alias("schedule_score"), F.bround(F.avg(rating), 2).alias("projected_adj_em"))
        .where(F.col("schedule_score").isNotNull() & F.col("projected_adj_em").isNotNull())
    )


def schedule_rollup(
    games: DataFrame,
    keys: Sequence[str],
    rank: str,
    rating: str,
    host_rating: Column,
    site: str = "site",
) -> DataFrame:
    """Games, expected wins, mean opponent and counts by site, quadrant and rank range per schedule."""
    from tipoff.functions.scalar import quadrant, site_adjustment, win_probability

    s = F.col(site)
    chance = win_probability(host_rating, F.col(rating), s)
    opponent = F.col(rating) - site_adjustment(s)
    r = F.col(rank)
    rows = games.select(*keys, s.alias("_site"), r.alias("_r"), chance.alias("_p"), opponent.alias("_o"), quadrant(r, s).alias("_q"))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("games"),
        F.sum("_p").alias("expected_wins"),
        F.avg("_p").alias("win_pct"),
        F.avg("_o").alias("avg_opponent"),
        *[F.count_if(F.col("_site") == name).alias(name.lower()) for name in ("Home", "Neutral", "Away")],
        *[F.count_if(F.col("_q") == q).alias(q.lower()) for q in ("Q1", "Q2", "Q3", "Q4")],
        F.count_if(F.col("_r") <= 100).alias("top100"),
        F.count_if(F.col("_r") <= 200).alias("top200"),
        F.count_if(F.col("_r") > 250).alias("buy251"),
        F.count_if(F.col("_r") > 300).alias("buy301"),
    )
    return out.withColumn("expected_losses", F.col("games") - F.col("expected_wins"))


def difficulty_rank(avg_opponent: Column, home: Column, neutral: Column, games: Column, coefficients: Sequence[float]) -> Column:
    """Estimated strength-of-schedule rank from a fitted calibration, kept within 1..365."""
    b0, b1, b2, b3 = [float(c) for c in coefficients]
    estimate = b0 + b1 * avg_opponent + b2 * ratio(home, games) + b3 * ratio(neutral, games)
    return F.greatest(F.lit(1), F.least(F.lit(365), F.floor(estimate + 0.5))).cast("int")
