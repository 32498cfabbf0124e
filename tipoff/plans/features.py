"""Feature tables: coaches, programs, rosters, transfers, recruiting, targets, crosswalk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipoff import fixed_values as fixed
from tipoff.functions import labels as L
from tipoff.functions.casts import blank_to_null, first_non_empty, first_non_zero, is_true, to_int
from tipoff.functions.scalar import mean_existing, rank_delta, rank_percentile, ratio, strength_multiplier
from tipoff.functions.text import (
    coach_name,
    is_name_match,
    is_unknown_coach,
    name_keys,
    player_key,
    team_key,
    with_name_match,
)
from tipoff.operators import aggregates as A
from tipoff.operators import history as H
from tipoff.operators import joins as J
from tipoff.operators import matching as X
from tipoff.operators import ranking as R

KEYS = ["season", "team_key"]

# Source columns of the style feeds and the names they get here.
FOUR_FACTORS = {
    "efg_pct": "eFG_Pct", "to_pct": "TO_Pct", "or_pct": "OR_Pct", "ft_rate": "FT_Rate",
    "def_efg_pct": "DeFG_Pct", "def_to_pct": "DTO_Pct", "def_or_pct": "DOR_Pct", "def_ft_rate": "DFT_Rate",
}
MISC_STATS = {
    "fg3_pct": "FG3Pct", "fg2_pct": "FG2Pct", "ft_pct": "FTPct", "block_pct": "BlockPct", "steal_rate": "StlRate",
    "non_steal_turnover_rate": "NSTRate", "assist_rate": "ARate", "three_point_attempt_rate": "F3GRate",
    "opp_fg3_pct": "OppFG3Pct", "opp_fg2_pct": "OppFG2Pct", "opp_steal_rate": "OppStlRate",
    "opp_non_steal_turnover_rate": "OppNSTRate", "opp_assist_rate": "OppARate",
    "opp_three_point_attempt_rate": "OppF3GRate",
}
HEIGHT = {"avg_height": "AvgHgt", "effective_height": "HgtEff", "experience": "Exp", "bench": "Bench", "continuity": "Continuity"}
POINT_SHARES = {"off_points_from_three_pct": "OffFg3", "def_points_from_three_pct": "DefFg3"}
RATINGS = {
    "adj_em": "AdjEM", "rank_adj_em": "RankAdjEM", "adj_oe": "AdjOE", "rank_adj_oe": "RankAdjOE", "adj_de": "AdjDE",
    "rank_adj_de": "RankAdjDE", "adj_tempo": "AdjTempo", "rank_adj_tempo": "RankAdjTempo", "tempo": "Tempo", "luck": "Luck",
    "sos": "SOS", "ncsos": "NCSOS", "apl_off": "APL_Off", "apl_def": "APL_Def",
}


def _keyed(df: DataFrame, name: str = "TeamName") -> DataFrame:
    known = blank_to_null(F.col(name)).isNotNull() & F.col("Season").isNotNull()
    return df.where(known).withColumns({"season": F.col("Season").cast("int"), "team_key": team_key(F.col(name))})


def _numbers(mapping: dict[str, str], df: DataFrame) -> list[Column]:
    return [F.col(s).cast("double").alias(n) for n, s in mapping.items() if s in df.columns]


def _feed(df: DataFrame, mapping: dict[str, str], extra: Sequence[Column] = (), names: Sequence[str] = ()) -> DataFrame:
    keyed = _keyed(df)
    rows = keyed.select(*KEYS, F.col("TeamName").alias("team"), *extra, *_numbers(mapping, keyed))
    return R.latest_per_key(rows, KEYS, ["team", *names])


def team_ratings(
    ratings: DataFrame, four_factors: DataFrame, misc: DataFrame, height: DataFrame, points: DataFrame
) -> DataFrame:
    """One row per season and team from the five rating feeds."""
    feeds = [
        _feed(ratings, RATINGS, [blank_to_null("ConfShort").alias("conference"), blank_to_null("Coach").alias("coach")]),
        _feed(four_factors, FOUR_FACTORS),
        _feed(misc, MISC_STATS),
        _feed(height, HEIGHT),
        _feed(points, POINT_SHARES),
    ]
    return J.merge_sources(feeds, KEYS, shared=["team"])


def team_styles(four_factors: DataFrame, misc: DataFrame, points: DataFrame) -> DataFrame:
    """Playing style per season and team; conference-only rows are left out."""
    style_misc = {k: MISC_STATS[k] for k in ("fg3_pct", "three_point_attempt_rate", "opp_fg3_pct", "opp_three_point_attempt_rate")}

    def overall(df: DataFrame) -> DataFrame:
        if "ConfOnly" not in df.columns:
            return df
        return df.where(~is_true(F.col("ConfOnly"), ("true",)))

    feeds = [
        _feed(overall(four_factors), FOUR_FACTORS),
        _feed(overall(misc), style_misc),
        _feed(overall(points), POINT_SHARES),
    ]
    return J.merge_sources(feeds, KEYS, shared=["team"]).drop("team")


def coach_seasons(ratings: DataFrame, teams: DataFrame, preseason: DataFrame, styles: DataFrame) -> DataFrame:
    """One row per rated team season with its coach, expectation and outcome.

    Final values come from the preseason archive if it has them, else from the ratings.
    """
    rated = _keyed(ratings).where(blank_to_null("Coach").isNotNull())
    ids = R.latest_per_key(
        _keyed(teams).select(*KEYS, F.col("TeamID").cast("string").alias("team_id"), F.col("ConfShort").alias("team_conference"), F.col("TeamName").alias("_n")),
        KEYS, ["_n"],
    ).drop("_n")
    fields = ["AdjEM", "RankAdjEM", "AdjOE", "AdjDE", "AdjEMFinal", "RankAdjEMFinal", "AdjOEFinal", "AdjDEFinal", "AdjEMChg", "RankChg"]
    archive = R.latest_per_key(
        _keyed(preseason).select(*KEYS, F.col("TeamName").alias("_n"), *[F.col(c).cast("double").alias(f"p_{c}") for c in fields]),
        KEYS, ["_n"],
    ).drop("_n")
    rows = J.lookup(J.lookup(J.lookup(rated, ids, KEYS), archive, KEYS), styles, KEYS)

    def d(name: str) -> Column:
        return F.col(name).cast("double")

    def i(name: str) -> Column:
        return F.col(name).cast("int")

    em = F.coalesce(d("p_AdjEMFinal"), d("AdjEM"))
    rank = F.coalesce(i("p_RankAdjEMFinal"), i("RankAdjEM"))
    offence = first_non_zero(d("p_AdjOEFinal"), d("AdjOE"))
    defence = first_non_zero(d("p_AdjDEFinal"), d("AdjDE"))
    games = F.coalesce(i("Wins"), F.lit(0)) + F.coalesce(i("Losses"), F.lit(0))
    style = [c for c in fixed.STYLE_COLUMNS if c not in ("tempo", "rank_tempo")]
    return rows.select(
        "season",
        "team_id",
        F.col("TeamName").alias("team_name"),
        "team_key",
        first_non_empty("ConfShort", "team_conference").alias("conference"),
        F.col("Coach").alias("coach"),
        coach_name(F.col("Coach")).alias("coach_key"),
        i("Wins").alias("wins"),
        i("Losses").alias("losses"),
        ratio(i("Wins"), games).alias("win_pct"),
        d("p_AdjEM").alias("preseason_adj_em"),
        i("p_RankAdjEM").alias("preseason_rank_adj_em"),
        em.alias("final_adj_em"),
        rank.alias("final_rank_adj_em"),
        F.coalesce(d("p_AdjEMChg"), em - d("p_AdjEM")).alias("adj_em_over_expected"),
        F.coalesce(i("p_RankChg"), rank_delta(rank, i("p_RankAdjEM"))).alias("rank_over_expected"),
        d("p_AdjOE").alias("preseason_adj_oe"),
        offence.alias("final_adj_oe"),
        (offence - d("p_AdjOE")).alias("adj_oe_over_expected"),
        d("p_AdjDE").alias("preseason_adj_de"),
        defence.alias("final_adj_de"),
        (d("p_AdjDE") - defence).alias("adj_de_over_expected"),
        em.alias("adj_em"),
        rank.alias("rank_adj_em"),
        d("AdjOE").alias("adj_oe"),
        i("RankAdjOE").alias("rank_adj_oe"),
        d("AdjDE").alias("adj_de"),
        i("RankAdjDE").alias("rank_adj_de"),
        d("AdjTempo").alias("tempo"),
        i("RankAdjTempo").alias("rank_tempo"),
        *[F.col(c) for c in style],
        d("SOS").alias("sos"),
        i("RankSOS").alias("rank_sos"),
        d("NCSOS").alias("ncsos"),
        i("RankNCSOS").alias("rank_ncsos"),
        i("Seed").alias("seed"),
        F.col("Event").alias("event"),
        F.col("DataThrough").alias("data_through"),
    )


def _coach_stats() -> list[H.Stat]:
    em, over, rank = F.col("adj_em"), F.col("adj_em_over_expected"), F.col("rank_adj_em")
    p = "coach_prior_"
    return [
        H.Stat(f"{p}seasons", "rows"),
        H.Stat("_wins", "sum", F.col("wins")),
        H.Stat("_losses", "sum", F.col("losses")),
        H.Stat(f"{p}avg_adj_em", "mean", em),
        H.Stat(f"{p}best_adj_em", "max", em),
        H.Stat(f"{p}avg_adj_em_over_expected", "mean", over),
        H.Stat(f"{p}best_adj_em_over_expected", "max", over),
        H.Stat(f"{p}worst_adj_em_over_expected", "min", over),
        H.Stat(f"{p}positive_adj_em_over_expected_rate", "rate", over > 0),
        H.Stat(f"{p}big_overperform_rate", "rate", over >= 5),
        H.Stat(f"{p}big_underperform_rate", "rate", over <= -5),
        H.Stat(f"{p}avg_rank_over_expected", "mean", F.col("rank_over_expected")),
        H.Stat(f"{p}avg_rank_adj_em", "mean", rank),
        H.Stat(f"{p}best_rank_adj_em", "min", rank),
        *[H.Stat(f"{p}top{n}_rate", "rate", rank <= n) for n in (25, 50, 100)],
        H.Stat(f"{p}ncaa_bid_rate", "rate", F.coalesce(F.col("event") == "NCAA", F.lit(False))),
        H.Stat(f"{p}avg_seed", "mean", F.col("seed")),
        H.Stat(f"{p}avg_sos", "mean", F.col("sos")),
        H.Stat(f"{p}avg_ncsos", "mean", F.col("ncsos")),
        *[H.Stat(f"{p}avg_{c}", "mean", F.col(c)) for c in fixed.STYLE_COLUMNS],
    ]


_LAST_FIELDS = ["adj_em", "adj_em_over_expected", "rank_adj_em", "rank_over_expected", "team_id", "conference", *fixed.STYLE_COLUMNS]


def _recent_columns() -> dict[str, Column]:
    end = H.from_end("last_rows")
    p = "coach_prior_"
    out = {
        f"{p}last_season": end["season"],
        f"{p}last_team_id": end["team_id"],
        f"{p}last_team_name": end["team_name"],
        f"{p}last_conference": end["conference"],
        **{f"{p}last_{c}": end[c] for c in ("adj_em", "rank_adj_em", "adj_em_over_expected", "rank_over_expected")},
    }
    for c in ("adj_em", "adj_em_over_expected", *fixed.STYLE_COLUMNS):
        out[f"{p}last3_avg_{c}"] = H.tail_mean("last_rows", c, 3)
        out[f"{p}last5_avg_{c}"] = H.tail_mean("last_rows", c, 5)
    for c in fixed.STYLE_COLUMNS:
        out[f"{p}last_{c}"] = end[c]
    return out


def _win_pct() -> Column:
    return ratio(F.col("_wins"), F.col("_wins") + F.col("_losses"))


def coach_history(seasons: DataFrame) -> DataFrame:
    """What was known about every coach before each of their seasons, and (as `observed_*`) what came.

    The same-school part uses the school id and falls back to the school key when the id has no
    earlier row.
    """
    rows = seasons.withColumn("_program", F.coalesce("team_id", "team_key"))
    coach = ["coach_key"]
    p = "coach_prior_"
    prior = H.prior_stats(rows, coach, "season", _coach_stats())
    programs = H.prior_distinct(rows, coach, "season", "_program", f"{p}program_count")
    recent = H.prior_last_rows(rows, coach, "season", ["team_name"], _LAST_FIELDS, 5)
    keyed = prior.join(programs, [*coach, "season"]).join(recent, [*coach, "season"])
    keyed = keyed.withColumns({f"{p}win_pct": _win_pct(), **_recent_columns()}).drop("_wins", "_losses", "last_rows")

    def same_school(key: str, tag: str) -> DataFrame:
        stats = [
            H.Stat(f"{tag}n", "rows"),
            H.Stat(f"{tag}em", "mean", F.col("adj_em")),
            H.Stat(f"{tag}over", "mean", F.col("adj_em_over_expected")),
            H.Stat(f"{tag}last", "max", F.struct("season", "team_name", "adj_em", "adj_em_over_expected")),
        ]
        return H.prior_stats(rows.where(F.col(key).isNotNull()), [*coach, key], "season", stats)

    out = J.lookup(rows, same_school("team_id", "_i_"), [*coach, "team_id", "season"])
    out = J.lookup(out, same_school("team_key", "_k_"), [*coach, "team_key", "season"])
    by_id = F.coalesce(F.col("_i_n"), F.lit(0)) > 0

    def pick(name: str) -> Column:
        return F.when(by_id, F.col(f"_i_{name}")).otherwise(F.col(f"_k_{name}"))

    n = F.coalesce(pick("n"), F.lit(0))
    out = out.withColumns(
        {
            f"{p}same_school_seasons": n,
            f"{p}same_school_avg_adj_em": pick("em"),
            f"{p}same_school_avg_adj_em_over_expected": pick("over"),
            f"{p}same_school_last_adj_em": pick("last")["adj_em"],
            f"{p}same_school_last_adj_em_over_expected": pick("last")["adj_em_over_expected"],
            "coach_first_year_at_school": n == 0,
        }
    )
    out = H.join_history(out, keyed, [*coach, "season"])
    out = out.withColumn(f"{p}last_season_gap", F.col("season") - F.col(f"{p}last_season"))
    observed = {
        "observed_preseason_adj_em": "preseason_adj_em", "observed_preseason_rank_adj_em": "preseason_rank_adj_em",
        "observed_final_adj_em": "adj_em", "observed_final_rank_adj_em": "rank_adj_em",
        "observed_adj_em_over_expected": "adj_em_over_expected", "observed_rank_over_expected": "rank_over_expected",
        "observed_adj_oe_over_expected": "adj_oe_over_expected", "observed_adj_de_over_expected": "adj_de_over_expected",
        "observed_final_wins": "wins", "observed_final_losses": "losses", "observed_final_event": "event",
        "observed_final_seed": "seed",
    }
    known = [c for c in out.columns if c.startswith("coach_prior_")]
    return out.select(
        "season", "team_id", "team_name", "team_key", "conference", "coach", "coach_key", *known,
        "coach_first_year_at_school", *[F.col(s).alias(n) for n, s in observed.items()],
    )


def coach_latest_summary(seasons: DataFrame) -> DataFrame:
    """The whole history of every coach, without a cut-off."""
    p = "coach_prior_"
    rows = seasons.withColumn("_program", F.coalesce("team_id", "team_key"))
    totals = H.total_stats(rows, ["coach_key"], _coach_stats())
    programs = rows.groupBy("coach_key", "_program").agg(F.lit(1)).groupBy("coach_key").agg(F.count("*").alias(f"{p}program_count"))
    last = H.last_rows(rows, ["coach_key"], ["season", "team_name"], ["coach", *_LAST_FIELDS], 5)
    out = totals.join(programs, "coach_key").join(last, "coach_key")
    end = H.from_end("last_rows")
    out = out.withColumns(
        {
            "coach": end["coach"],
            "last_seen_season": end["season"],
            "last_seen_team_id": end["team_id"],
            "last_seen_team_name": end["team_name"],
            "last_seen_conference": end["conference"],
            f"{p}win_pct": _win_pct(),
            **_recent_columns(),
            f"{p}same_school_seasons": F.lit(0),
            f"{p}same_school_avg_adj_em": F.lit(None).cast("double"),
            f"{p}same_school_avg_adj_em_over_expected": F.lit(None).cast("double"),
            f"{p}same_school_last_adj_em": F.lit(None).cast("double"),
            f"{p}same_school_last_adj_em_over_expected": F.lit(None).cast("double"),
            "coach_first_year_at_school": F.lit(False),
            f"{p}last_season_gap": F.lit(None).cast("int"),
        }
    )
    return out.drop("_wins", "_losses", "last_rows")


def program_history(ratings: DataFrame, through: int | None = None) -> DataFrame:
    """Program features for every season after a team's first one, gaps included."""
    keyed = _keyed(ratings)
    rows = keyed.select(
        *KEYS,
        F.col("TeamName").alias("team"),
        F.col("ConfShort").alias("conference"),
        *[F.col(s).cast("double").alias(n) for n, s in RATINGS.items() if s in keyed.columns and n not in ("tempo", "adj_tempo")],
        F.col("RankSOS").cast("double").alias("rank_sos"),
        F.col("Wins").cast("int").alias("wins"),
        F.col("Losses").cast("int").alias("losses"),
        F.col("Seed").cast("int").alias("seed"),
        F.col("Event").alias("event"),
    )
    grid = H.season_grid(rows, ["team_key"], "season", through)
    em, rank = F.col("adj_em"), F.col("rank_adj_em")
    stats = [
        H.Stat("prior_seasons", "rows"),
        H.Stat("_wins", "sum", F.col("wins")),
        H.Stat("_losses", "sum", F.col("losses")),
        H.Stat("prior_avg_adj_em", "mean", em),
        H.Stat("prior_best_adj_em", "max", em),
        H.Stat("prior_worst_adj_em", "min", em),
        H.Stat("prior_avg_rank_adj_em", "mean", rank),
        H.Stat("prior_best_rank_adj_em", "min", rank),
        *[H.Stat(f"prior_top{n}_rate", "rate", rank <= n) for n in (25, 50, 75, 100, 135)],
        H.Stat("prior_ncaa_bid_rate", "rate", F.coalesce(F.col("event") == "NCAA", F.lit(False))),
        H.Stat("prior_avg_seed", "mean", F.col("seed")),
        H.Stat("prior_avg_sos", "mean", F.col("sos")),
        H.Stat("prior_avg_ncsos", "mean", F.col("ncsos")),
    ]
    fields = ["conference", "adj_em", "rank_adj_em", "adj_oe", "rank_adj_oe", "adj_de", "rank_adj_de", "sos", "rank_sos"]
    prior = H.prior_stats(rows, ["team_key"], "season", stats, grid)
    recent = H.prior_last_rows(rows, ["team_key"], "season", ["team"], fields, 5, grid=grid)
    out = prior.join(recent, KEYS)
    end, before = H.from_end("last_rows"), H.from_end("last_rows", 2)
    return out.withColumns(
        {
            "team": end["team"],
            "conference": end["conference"],
            "prior_win_pct": _win_pct(),
            **{f"prior_last_{c}": end[c] for c in fields[1:]},
            "prior_last3_avg_adj_em": H.tail_mean("last_rows", "adj_em", 3),
            "prior_last5_avg_adj_em": H.tail_mean("last_rows", "adj_em", 5),
            "prior_adj_em_one_year_change": end["adj_em"] - before["adj_em"],
            "prior_rank_adj_em_one_year_change": before["rank_adj_em"] - end["rank_adj_em"],
        }
    ).drop("_wins", "_losses", "last_rows")


def coach_changes(teams: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Coach-change features per team, and the change rows no team took."""
    rows = teams.withColumns(
        {
            "team_id": F.coalesce(F.col("TeamID").cast("string"), F.col("TeamName")),
            "season": F.col("Season").cast("int"),
            "coach_key": coach_name(F.col("Coach")),
        }
    )
    latest = R.latest_per_key(rows, ["team_id"], ["season", -F.xxhash64("TeamName")]).withColumn(
        "key", team_key(F.col("TeamName"))
    )
    tenure = H.current_tenure(rows, "team_id", "season", "coach_key").select(
        "team_id", F.col("tenure").alias("kenpom_coach_tenure_years_available")
    )
    listed = changes.withColumn("key", team_key(F.col("school"))).where(F.col("key") != "")
    first = R.latest_per_key(listed, ["key"], [-F.xxhash64("hoopdirt_row_id")]).withColumnRenamed("key", "change_key")
    found = X.best_matches(latest, listed, "key", floor=0.94, below=False)
    joined = (
        latest.join(found, "key", "left")
        .join(first.select(F.col("change_key").alias("other"), "school", F.col("conference").alias("change_conference"), "former_coach", "new_coach", "hoopdirt_row_id", "source_url", "captured_at"), "other", "left")
        .join(tenure, "team_id", "left")
    )
    changed = F.col("other").isNotNull()
    joined = with_name_match(joined, "Coach", "former_coach", "_former")
    joined = joined.withColumn("former_coach_match_type", F.when(changed, F.col("_former")).otherwise("not_applicable"))
    known = changed & ~is_unknown_coach(F.col("new_coach"))
    jobs = rows.select(
        name_keys(F.col("Coach")).alias("keys"), "team_id", "season", F.col("TeamName").alias("team_name"), F.col("ConfShort").alias("conference")
    )
    asked = joined.where(changed).select("team_id", F.col("team_id").alias("_asked"), name_keys(F.col("new_coach")).alias("keys"))
    seen = X.latest_by_any_key(
        asked.withColumnRenamed("_asked", "asked_id"), jobs, "asked_id", "keys", "team_id", "season", ["team_name", "conference"]
    ).withColumnRenamed("asked_id", "team_id")
    seen = seen.select("team_id", *[F.col(c).alias(f"new_coach_{c}") for c in seen.columns if c != "team_id"])
    out = joined.join(seen, "team_id", "left")
    features = out.select(
        F.col("TeamID").cast("string").alias("team_id"),
        F.col("TeamName").alias("team_name"),
        F.col("key").alias("team_key"),
        "season",
        F.col("ConfShort").alias("conference"),
        F.col("Coach").alias("kenpom_coach"),
        "kenpom_coach_tenure_years_available",
        changed.alias("coach_changed"),
        F.when(changed & ~known, "changed_tbd").when(changed, "changed_known_new_coach").otherwise("no_change_listed").alias("coach_change_status"),
        F.when(F.col("score") == 1.0, "canonical_team_name").when(changed, "fuzzy_team_name").otherwise("no_match").alias("team_match_type"),
        F.col("score").alias("team_match_score"),
        F.col("school").alias("hoopdirt_school"),
        F.col("change_conference").alias("hoopdirt_conference"),
        "former_coach",
        "new_coach",
        is_name_match(F.col("former_coach_match_type")).alias("former_coach_matches_kenpom"),
        "former_coach_match_type",
        known.alias("new_coach_known"),
        F.col("new_coach_last_seen_season").isNotNull().alias("new_coach_seen_in_kenpom_history"),
        "new_coach_last_seen_team_id",
        "new_coach_last_seen_team_name",
        "new_coach_last_seen_conference",
        "new_coach_last_seen_season",
        "hoopdirt_row_id",
        "source_url",
        "captured_at",
    )
    taken = features.where(blank_to_null("hoopdirt_row_id").isNotNull()).select("hoopdirt_row_id").distinct()
    left = changes.withColumn("key", team_key(F.col("school"))).join(taken, "hoopdirt_row_id", "left_anti")
    best = X.best_matches(left, latest, "key")
    names = latest.groupBy(F.col("key").alias("other")).agg(F.max("TeamName").alias("best_kenpom_team_name"))
    unmatched = (
        left.join(best, "key", "left").join(names, "other", "left").select(
            *changes.columns,
            F.col("key").alias("canonical_school_key"),
            "best_kenpom_team_name",
            F.col("score").alias("best_kenpom_team_score"),
        )
    )
    return features, unmatched


# Player feed columns and the names they get in the status table.
PLAYER_FIELDS = {
    "competition_id": "competitionId", "team_id": "teamId", "team_market": "teamMarket", "team_name": "teamName",
    "conference_id": "conferenceId", "player_id": "playerId", "player_name": "fullName", "class_year": "classYr",
    "position": "position", "height": "height", "next_team_id": "nextTeamId", "next_team_market": "nextTeamMarket",
    "prior_team_id": "priorTeamId", "prior_team_market": "priorTeamMarket", "is_transfer": "isTransfer",
    "is_draft_prospect": "isDraftProspect", "will_transfer": "willTransfer", "in_portal_after_season": "inPortalAfterSeason",
}
PLAYER_STATS = {
    "games_played": "gp", "games_started": "gs", "minutes": "mins", "possessions": "poss", "points": "ptsScored",
    "field_goal_attempts": "fga", "free_throw_attempts": "fta", "assists": "ast", "offensive_rebounds": "orb",
    "defensive_rebounds": "drb", "rebounds": "reb", "steals": "stl", "blocks": "blk", "turnovers": "tov",
    "personal_fouls": "pf", "usage_pct": "usagePct", "ortg_player": "ortgPlayer", "drtg_player": "drtgPlayer",
    "effective_fg_pct": "efgPct", "true_shooting_pct": "tsPct", "assist_pct": "astPct", "offensive_rebound_pct": "orbPct",
    "defensive_rebound_pct": "drbPct", "rebound_pct": "rebPct", "steal_pct": "stlPct", "block_pct": "blkPct",
    "turnover_pct": "tovPct", "per": "per", "warp": "warp", "warp_per_40": "warpP40", "win_shares": "ws",
    "offensive_win_shares": "ows", "defensive_win_shares": "dws", "win_shares_per_40": "wsP40", "rapm": "rapm",
    "offensive_rapm": "orapm", "defensive_rapm": "drapm",
}


def player_status(players: DataFrame) -> DataFrame:
    """Status of every player beside their statistics; minutes, possessions and points default to 0."""

    def stat(name: str, source: str) -> Column:
        value = F.col(source).cast("double")
        return (F.coalesce(value, F.lit(0.0)) if name in ("minutes", "possessions", "points") else value).alias(name)

    status = L.roster_status(
        F.col("teamId").cast("string"), F.col("nextTeamId").cast("string"), F.col("inPortalAfterSeason"),
        F.col("willTransfer"), F.col("isDraftProspect"), F.col("classYr"),
    )
    return players.select(
        *[F.col(s).alias(n) for n, s in PLAYER_FIELDS.items()],
        status.alias("status"),
        *[stat(n, s) for n, s in PLAYER_STATS.items()],
    )


def with_season_keys(df: DataFrame, seasons: DataFrame) -> DataFrame:
    """Stamp the season of the competition and the team key; unknown competitions are dropped."""
    keyed = df.withColumn("team_key", team_key(F.col("team_market")))
    return keyed.join(F.broadcast(seasons) if seasons.count() <= 100_000 else seasons, "competition_id")


def roster_summary(status: DataFrame) -> DataFrame:
    """The wide summary per competition and team."""
    keys = ["competition_id", "team_id"]
    names = status.groupBy(*keys).agg(
        F.min(F.struct("team_market", "team_name", "conference_id")).alias("_n")
    ).select(*keys, "_n.*")
    back = F.col("status").isin(*fixed.RETURNING_STATUSES)
    return (
        names.join(A.status_summary(status, keys), keys).join(A.core_shares(status, keys, "player_id", back), keys)
    )


def source_context(ratings: DataFrame) -> DataFrame:
    """Strength of every team season a transfer may come from."""
    rows = _keyed(ratings).select(
        F.col("season").alias("source_season"),
        F.col("team_key").alias("source_team_key"),
        F.col("AdjEM").cast("double").alias("source_kenpom_adj_em"),
        F.col("RankAdjEM").cast("double").alias("source_kenpom_rank_adj_em"),
        F.col("SOS").cast("double").alias("source_kenpom_sos"),
        F.col("RankSOS").cast("double").alias("source_kenpom_rank_sos"),
        F.col("ConfShort").alias("source_kenpom_conference"),
    )
    return R.latest_per_key(rows, ["source_season", "source_team_key"], ["source_kenpom_adj_em"])


_TRANSFER_PERSON = ["player_id", "player_name", "class_year", "position", "height"]
_TRANSFER_STATS = [*fixed.TRANSFER_COUNTING_STATS, *fixed.TRANSFER_RATE_STATS]


def _with_context(rows: DataFrame, context: DataFrame) -> DataFrame:
    out = J.lookup(rows, context, ["source_season", "source_team_key"])
    multiplier = strength_multiplier(
        F.col("source_kenpom_adj_em"), F.col("source_kenpom_rank_adj_em"), F.col("source_kenpom_conference")
    )
    out = out.withColumn("source_context_multiplier", multiplier)
    return out.withColumns(
        {f"context_adjusted_{c}": F.coalesce(c, F.lit(0.0)) * F.col("source_context_multiplier") for c in fixed.ADJUSTED_STATS}
    )


def transfer_moves(players: DataFrame, context: DataFrame, current_roster: bool = False) -> DataFrame:
    """Players whose next team differs, and with `current_roster` those who came from another team."""
    next_id = blank_to_null(F.col("next_team_id").cast("string"))
    leaves = next_id.isNotNull() & (next_id != F.coalesce(F.col("team_id").cast("string"), F.lit("")))
    prior, here = blank_to_null("prior_team_market"), blank_to_null("team_market")
    arrived = (
        ~leaves & F.lit(current_roster) & is_true(F.col("is_transfer"), ("true",)) & prior.isNotNull() & here.isNotNull()
        & (team_key(prior) != team_key(here))
    )
    arrived = F.coalesce(arrived, F.lit(False))
    leaves = F.coalesce(leaves, F.lit(False))
    own_key = first_non_empty(F.col("team_key"), team_key(F.col("team_market")))
    rows = players.where(F.col("season").isNotNull() & (F.col("season") != 0)).select(
        F.col("season").alias("source_season"),
        (F.col("season") + 1).alias("season"),
        F.when(leaves, blank_to_null("next_team_market")).when(arrived, here).alias("team"),
        F.when(leaves, F.col("team_market")).otherwise(prior).alias("source_team"),
        F.when(leaves, own_key).otherwise(team_key(prior)).alias("source_team_key"),
        *_TRANSFER_PERSON,
        *[F.col(c).cast("double").alias(c) for c in _TRANSFER_STATS],
        (leaves | arrived).alias("_moved"),
    )
    rows = rows.where(F.col("_moved") & F.col("team").isNotNull()).drop("_moved")
    return _with_context(rows.withColumn("team_key", team_key(F.col("team"))), context)


def transfers_from_ledger(
    ledger: DataFrame, players: DataFrame, context: DataFrame, columns: dict[str, str | None], season: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Transfers a portal ledger lists, matched to last season's players, and the rows without a match.

    `columns` tells which header holds what (see `ledger_columns`).
    """
    if not (columns["player"] and columns["source"] and columns["destination"]):
        raise ValueError("the ledger needs player, source and destination columns")

    def text(role: str) -> Column:
        name = columns[role]
        return F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) if name else F.lit("")

    from tipoff.sources.nested import ledger_status_ok

    rows = ledger.select(
        text("player").alias("ledger_player_name"),
        text("source").alias("ledger_source_team"),
        text("destination").alias("ledger_destination_team"),
        text("player_id").alias("player_id"),
        text("status").alias("portal_status"),
        text("source_division").alias("source_division"),
        text("destination_division").alias("destination_division"),
    )
    rows = rows.where(
        (F.col("ledger_player_name") != "") & (F.col("ledger_source_team") != "") & (F.col("ledger_destination_team") != "")
        & ledger_status_ok(F.col("portal_status"))
    ).withColumns(
        {
            "player_key": player_key(F.col("ledger_player_name")),
            "source_team_key": team_key(F.col("ledger_source_team")),
            "team_key": team_key(F.col("ledger_destination_team")),
        }
    ).where(F.col("source_team_key") != F.col("team_key"))
    payload = ["season", *_TRANSFER_PERSON, *_TRANSFER_STATS]
    people = players.select(
        F.col("season").cast("int").alias("season"),
        *[F.col(c).cast("string").alias(c) for c in _TRANSFER_PERSON],
        *[F.col(c).cast("double").alias(c) for c in _TRANSFER_STATS],
        player_key(F.col("player_name")).alias("player_key"),
        team_key(first_non_empty("team_market", "team_name")).alias("source_team_key"),
    )
    matched = X.cascade_match(rows, people, payload=payload)
    person_season = F.col("person.season")
    usable = F.col("person").isNotNull() & F.coalesce(person_season != 0, F.lit(False))
    unmatched = matched.where(~usable).select(
        "ledger_player_name",
        "ledger_source_team",
        "ledger_destination_team",
        F.nullif("player_id", F.lit("")).alias("ledger_player_id"),
        F.nullif("portal_status", F.lit("")).alias("portal_status"),
        F.nullif("source_division", F.lit("")).alias("source_division"),
        F.nullif("destination_division", F.lit("")).alias("destination_division"),
        F.when(F.col("person").isNull(), "no_match").otherwise("matched_row_missing_season").alias("reason"),
    )
    out = matched.where(usable).select(
        person_season.alias("source_season"),
        (F.lit(season) if season else person_season + 1).alias("season"),
        F.col("ledger_destination_team").alias("team"),
        "team_key",
        F.col("ledger_source_team").alias("source_team"),
        "source_team_key",
        *[F.col("person")[c].alias(c) for c in payload[1:]],
        F.col("match_method").alias("transfer_match_method"),
        "ledger_player_name",
        "ledger_source_team",
        "ledger_destination_team",
    )
    return _with_context(out, context), unmatched


def supplement_players(players: DataFrame, roster: DataFrame, season: int | None) -> DataFrame:
    """Zero-minute rows for rostered people the statistics feed lacks."""
    base = players.withColumns(
        {
            "player_key": player_key(F.col("player_name")),
            "source_team_key": team_key(first_non_empty("team_market", "team_name")),
            "player_id": blank_to_null(F.trim(F.col("player_id").cast("string"))),
        }
    )
    named = blank_to_null("fullName").isNotNull() & blank_to_null("teamMarket").isNotNull()
    extra = roster.where(named).select(
        F.col("competitionId").alias("competition_id"),
        F.col("teamId").alias("team_id"),
        F.col("teamMarket").alias("team_market"),
        F.col("teamName").alias("team_name"),
        F.col("conferenceId").alias("conference_id"),
        blank_to_null(F.trim(F.col("playerId").cast("string"))).alias("player_id"),
        F.col("fullName").alias("player_name"),
        F.col("classYr").alias("class_year"),
        "position",
        "height",
        player_key(F.col("fullName")).alias("player_key"),
        team_key(F.col("teamMarket")).alias("source_team_key"),
    ).withColumn("_entry", F.concat_ws("|", F.coalesce("player_id", F.lit("~")), "player_key", "source_team_key", "player_name", "position"))
    extra = R.latest_per_key(extra, ["_entry"], ["competition_id", "team_id"])
    zero = [c for c in (*fixed.ROSTER_COUNTING_STATS,) if c in players.columns]
    fill = {
        **{c: F.lit(0.0) for c in zero},
        "season": F.lit(season).cast("int"),
        "source_row_type": F.lit("competition_team_players_placeholder"),
    }
    if "source_row_type" not in base.columns:
        base = base.withColumn("source_row_type", F.lit(None).cast("string"))
    out = J.supplement(base, extra, [["player_id"], ["player_key", "source_team_key"]], "_entry", fill)
    return out.drop("player_key", "source_team_key")


def transfer_summary(transfers: DataFrame) -> DataFrame:
    """Arrivals per season and team, with the place of each number in its season."""
    minutes, rank = A.number("minutes"), A.number("source_kenpom_rank_adj_em")
    p = "cbb_transfer_"
    counts = {
        "500_minute_players": minutes >= 500,
        "200_minute_players": minutes >= 200,
        "high_usage_players": (minutes >= 200) & (A.number("usage_pct") >= 0.20),
        "positive_warp_players": A.number("warp") > 0,
        "plus_one_warp_players": A.number("warp") >= 1.0,
        "top_50_source_players": (rank > 0) & (rank <= 50),
        "top_100_source_players": (rank > 0) & (rank <= 100),
    }
    sums = {
        **{c: F.col(c) for c in fixed.TRANSFER_COUNTING_STATS},
        **{f"source_adjusted_{c}": F.col(f"context_adjusted_{c}") for c in fixed.ADJUSTED_STATS},
    }
    means = {
        **{c: F.col(c) for c in fixed.TRANSFER_RATE_STATS},
        "source_adj_em": F.col("source_kenpom_adj_em"),
        "source_rank_adj_em": F.col("source_kenpom_rank_adj_em"),
        "source_sos": F.col("source_kenpom_sos"),
        "source_context_multiplier": F.col("source_context_multiplier"),
    }
    out = A.incoming_summary(transfers, KEYS, "source_team_key", counts, sums, means, "minutes", p)
    names = transfers.groupBy(*KEYS).agg(F.min("team").alias("team"))
    out = names.join(out, KEYS).withColumn(
        f"{p}minutes_weighted_net_rating",
        F.col(f"{p}minutes_weighted_ortg_player") - F.col(f"{p}minutes_weighted_drtg_player"),
    )
    out = R.ordinal_percentiles(out, ["season"], ["team_key"], fixed.TRANSFER_PERCENTILE_COLUMNS)
    # Percentiles that make up the production percentile.
    parts = (
        "source_adjusted_warp", "source_adjusted_win_shares", "minutes", "500_minute_players", "minutes_weighted_per",
        "minutes_weighted_net_rating", "minutes_weighted_source_adj_em",
    )
    return out.withColumn(f"{p}production_percentile", mean_existing(*[f"{p}{c}_percentile" for c in parts]))


def recruiting_features(recruiting: DataFrame, transfers: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Team rankings of both kinds side by side per season, with the class summaries where there are any."""

    def side(df: DataFrame, prefix: str, fields: Sequence[str]) -> DataFrame:
        sizes = df.groupBy("ranking_year").agg(F.count("*").alias("_n"))
        name = first_non_empty("team", "team_full_name")
        rows = df.join(sizes, "ranking_year").select(
            (F.col("ranking_year") + 1).alias("season"),
            team_key(name).alias("team_key"),
            name.alias("team"),
            "ranking_year",
            F.col("_n").alias(f"{prefix}teams_ranked"),
            rank_percentile(F.col("rank").cast("int"), F.col("_n")).alias(f"{prefix}rank_percentile"),
            *[F.col(c).alias(f"{prefix}{c}") for c in ("source_url", "captured_at", "ranking_date_updated") if c in df.columns],
            *[F.col(c).cast("double").alias(f"{prefix}{c}") for c in fields if c in df.columns],
        )
        return R.latest_per_key(rows, KEYS, ["team"])

    out = J.merge_sources(
        [
            side(recruiting, "on3_hs_", fixed.RECRUIT_RANKING_FIELDS),
            side(transfers, "on3_transfer_", fixed.TRANSFER_RANKING_FIELDS),
        ],
        KEYS,
        shared=["team", "ranking_year"],
    )
    return out if classes is None else J.lookup(out, classes.drop("team"), KEYS)


def class_features(recruits: DataFrame) -> DataFrame:
    """Recruiting-class summary per season and team from rated recruits (see `recruit_players`)."""
    rows = recruits.select(
        *KEYS,
        "team",
        "percentile",
        F.col("industry_rank").cast("double").alias("industry_rank"),
        F.col("player_name"),
        F.col("industry_rating").cast("double").alias("industry_rating"),
        L.position_class(first_non_empty("position_abbr", "position")).alias("position"),
    )
    return A.class_summary(rows, KEYS, "percentile", "industry_rank", "player_name", "industry_rating", "position", carry=["team"])


def recruit_players_frame(rows: DataFrame) -> DataFrame:
    """Rated recruits of a landed table."""
    from tipoff.sources.nested import recruit_players

    return recruit_players(rows)


def net_targets(rows: DataFrame) -> DataFrame:
    """Target table per source file: rank, percentile, field size and band flags."""

    def text(*names: str) -> Column:
        present = [F.col(n).cast("string") for n in names if n in rows.columns]
        return first_non_empty(*present) if present else F.lit(None).cast("string")

    rank = F.coalesce(*[to_int(F.col(n).cast("string")) for n in ("net_rank", "rank") if n in rows.columns])
    through = text("selection_thru_games", "through_games", "data_through")
    season = F.coalesce(to_int(text("season")), to_int(F.left(text("selection_thru_games", "through_games"), F.lit(4))))
    team = text("team", "school")
    keyed = rows.select(
        season.alias("season"),
        text("season_label").alias("season_label"),
        team.alias("team"),
        team_key(team).alias("team_key"),
        text("conference", "conf").alias("conference"),
        through.alias("selection_thru_games"),
        rank.alias("net_rank"),
        text("source_url").alias("source_url"),
        text("source_file").alias("source_file"),
    )
    return A.rank_targets(keyed.withColumn("_file", F.coalesce("source_file", F.lit(""))), ["_file"], "net_rank").drop("_file")


def source_teams(df: DataFrame, source: str | Column, name: Column, team_id: Column, season: Column, extra: Column) -> DataFrame:
    """One feed as (source, source_team_id, source_team_name, key, source_season, source_extra), listed once."""
    rows = df.select(
        (source if isinstance(source, Column) else F.lit(source)).alias("source"),
        team_id.cast("string").alias("source_team_id"),
        name.alias("source_team_name"),
        team_key(name).alias("key"),
        season.cast("int").alias("source_season"),
        extra.cast("string").alias("source_extra"),
    ).where(blank_to_null("source_team_name").isNotNull())
    return J.distinct_first(
        rows, ["source", "key", "source_team_id"], ["source_season", "source_team_name", "source_extra"]
    )


def team_crosswalk(sources: DataFrame, teams: DataFrame) -> DataFrame:
    """Every source team with its best team of the universe (latest row per team id)."""
    universe = teams.select(
        F.col("TeamName").alias("team_name"),
        F.col("TeamID").cast("string").alias("team_id"),
        F.col("Season").cast("int").alias("season"),
        F.col("ConfShort").alias("extra"),
        team_key(F.col("TeamName")).alias("key"),
    )
    with_id = R.latest_per_key(universe.where(F.col("team_id").isNotNull()), ["team_id"], ["season", "team_name"])
    latest = with_id.unionByName(universe.where(F.col("team_id").isNull()))
    return X.crosswalk(sources, latest, "key", ["team_name", "team_id", "season", "extra"], "kenpom", fixed.KNOWN_UNMATCHED_KEYS)


