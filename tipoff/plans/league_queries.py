"""The domain plans over the season feeds derived from the order tables."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from tipoff.plans import features as P
from tipoff.plans import model_table as T
from tipoff.plans import planner as N
from tipoff.plans import predict as C
from tipoff.plans import risk as K
from tipoff.plans.backtest import run_backtest
from tipoff.plans.league import League
from tipoff.plans.registry import SUPPLIER_YEARS, query, r6
from tipoff.session import pinned


@lru_cache(maxsize=4)
def _league(spark, folder) -> League:
    return League(spark, folder)


def _rounded(df, digits: int = 6):
    return df.select(*[(F.round(c, digits).alias(c) if t == "double" else F.col(c)) for c, t in df.dtypes])


class _Tables(dict):
    """Feature tables of the league; each is made when it is first asked for and written once to the shared checkpoint folder."""

    def __init__(self, league: League):
        super().__init__()
        g = self._g = league
        self._make = {
            "ratings": lambda t: P.team_ratings(g.ratings, g.four_factors, g.misc, g.height, g.points),
            "coach_seasons": lambda t: P.coach_seasons(g.ratings, g.teams, g.preseason_by_name, P.team_styles(g.four_factors, g.misc, g.points)),
            "coach_history": lambda t: P.coach_history(t["coach_seasons"]),
            "status": lambda t: P.with_season_keys(P.player_status(g.players()), g.competitions()),
            "roster": lambda t: P.with_season_keys(P.roster_summary(t["status"].drop("season", "team_key")), g.competitions()),
            "moves": lambda t: P.transfer_moves(t["status"], P.source_context(g.ratings)),
            "transfers": lambda t: P.transfer_summary(t["moves"]),
            "recruiting": lambda t: P.recruiting_features(*g.ranked_feeds(), P.class_features(t["recruits"])),
            "programs": lambda t: P.program_history(g.ratings),
            "targets": lambda t: P.net_targets(g.net_rows()),
        }

    def __missing__(self, name: str):
        made = P.recruit_players_frame(self._g.recruits()) if name == "recruits" else pinned(self._make[name](self))
        self[name] = made
        return made


@lru_cache(maxsize=4)
def _tables(spark, folder) -> _Tables:
    return _Tables(_league(spark, folder))


@lru_cache(maxsize=4)
def _model_table(spark, folder):
    t, g = _tables(spark, folder), _league(spark, folder)
    return pinned(
        T.build_model_table(
            T.preseason_rows(g.preseason), t["coach_history"], t["targets"], t["roster"], t["status"], t["recruiting"],
            t["transfers"], t["moves"], t["recruits"], t["programs"],
        )
    )


@query(
    "program_history",
    f"""
WITH {SUPPLIER_YEARS},
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY season ORDER BY revenue DESC, entity) AS rank FROM sy),
firsts AS (SELECT entity, MIN(season) AS f FROM r GROUP BY 1),
grid AS (SELECT entity, CAST(UNNEST(GENERATE_SERIES(f + 1, (SELECT MAX(season) + 1 FROM sy))) AS INTEGER) AS season FROM firsts)
SELECT g.season, lower(replace(s_name, '#', ' ')) AS team_key, COUNT(*) AS prior_seasons,
  ROUND(CAST(SUM(n_lines - n_returned) AS DOUBLE) / SUM(n_lines), 6) AS prior_win_pct, ROUND(AVG(rank), 6) AS prior_avg_rank_adj_em,
  CAST(MIN(rank) AS DOUBLE) AS prior_best_rank_adj_em, ROUND(AVG(CASE WHEN rank <= 25 THEN 1.0 ELSE 0 END), 6) AS prior_top25_rate,
  CAST(ARG_MAX(rank, r.season) AS DOUBLE) AS prior_last_rank_adj_em,
  ROUND(AVG(CASE WHEN rank <= 64 THEN 1.0 ELSE 0 END), 6) AS prior_ncaa_bid_rate
FROM grid g JOIN r ON r.entity = g.entity AND r.season < g.season JOIN supplier ON s_suppkey = g.entity GROUP BY 1, 2
""",
)
def program_history(spark, folder):
    out = _tables(spark, folder)["programs"]
    return out.select(
        "season", "team_key", "prior_seasons", r6("prior_win_pct").alias("prior_win_pct"),
        r6("prior_avg_rank_adj_em").alias("prior_avg_rank_adj_em"), "prior_best_rank_adj_em",
        r6("prior_top25_rate").alias("prior_top25_rate"), "prior_last_rank_adj_em", r6("prior_ncaa_bid_rate").alias("prior_ncaa_bid_rate"),
    )


@query("coach_season_facts")
def coach_season_facts(spark, folder):
    return _rounded(_tables(spark, folder)["coach_seasons"])


_COACHES = f"""
{SUPPLIER_YEARS},
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY season ORDER BY revenue DESC, entity) AS rank,
  'mike name' || ((entity * 7 + CAST(FLOOR(season / 3) AS INTEGER) * 3) % 97) AS coach_key FROM sy)"""


@query(
    "coach_history",
    f"""
WITH {_COACHES}
SELECT season, lower(replace(s_name, '#', ' ')) AS team_key, coach_key, COUNT(*) OVER w AS coach_prior_seasons,
  ROUND(CAST(SUM(n_lines - n_returned) OVER w AS DOUBLE) / SUM(n_lines) OVER w, 6) AS coach_prior_win_pct,
  ROUND(AVG(rank) OVER w, 6) AS coach_prior_avg_rank_adj_em, MIN(rank) OVER w AS coach_prior_best_rank_adj_em,
  COUNT(DISTINCT entity) OVER w AS coach_prior_program_count, COUNT(*) OVER s AS coach_prior_same_school_seasons,
  COUNT(*) OVER s = 0 AS coach_first_year_at_school, season - MAX(season) OVER w AS coach_prior_last_season_gap, rank AS observed_final_rank_adj_em
FROM r JOIN supplier ON s_suppkey = entity
WINDOW w AS (PARTITION BY coach_key ORDER BY season RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  s AS (PARTITION BY coach_key, entity ORDER BY season RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""",
)
def coach_history(spark, folder):
    out = _tables(spark, folder)["coach_history"]
    return out.select(
        "season", "team_key", "coach_key", "coach_prior_seasons", r6("coach_prior_win_pct").alias("coach_prior_win_pct"),
        r6("coach_prior_avg_rank_adj_em").alias("coach_prior_avg_rank_adj_em"), "coach_prior_best_rank_adj_em",
        "coach_prior_program_count", "coach_prior_same_school_seasons", "coach_first_year_at_school",
        "coach_prior_last_season_gap", F.col("observed_final_rank_adj_em").cast("long").alias("observed_final_rank_adj_em"),
    )


@query("coach_latest_summary")
def coach_latest_summary(spark, folder):
    return _rounded(P.coach_latest_summary(_tables(spark, folder)["coach_seasons"]))


@query("coach_changes")
def coach_changes(spark, folder):
    g = _league(spark, folder)
    features, _ = P.coach_changes(g.teams, g.changes())
    return _rounded(features)


@query("coach_changes_unmatched")
def coach_changes_unmatched(spark, folder):
    g = _league(spark, folder)
    _, unmatched = P.coach_changes(g.teams, g.changes())
    return _rounded(unmatched)


@query("roster_summary")
def roster_summary(spark, folder):
    return _rounded(_tables(spark, folder)["roster"])


@query("transfer_players")
def transfer_players(spark, folder):
    return _rounded(_tables(spark, folder)["moves"])


@query("transfer_features")
def transfer_features(spark, folder):
    return _rounded(_tables(spark, folder)["transfers"])


@query("recruiting_features")
def recruiting_features(spark, folder):
    return _rounded(_tables(spark, folder)["recruiting"])


@query("net_targets")
def net_targets(spark, folder):
    return _rounded(_tables(spark, folder)["targets"])


@query("team_crosswalk")
def team_crosswalk(spark, folder):
    g = _league(spark, folder)
    feeds = [
        P.source_teams(g.changes(), "changes", F.col("school"), F.col("hoopdirt_row_id"), F.lit(2002), F.col("conference")),
        P.source_teams(g.net_rows(), "net", F.col("team"), F.lit(None), F.col("season"), F.col("conference")),
    ]
    return _rounded(P.team_crosswalk(P.J.union_all(feeds), g.teams))


@query("modeling_table")
def modeling_table(spark, folder):
    return _rounded(_model_table(spark, folder))


@lru_cache(maxsize=4)
def _backtest(spark, folder):
    """All models and blends over every season that has earlier ones."""
    return run_backtest(_model_table(spark, folder), first_test_season=None)


@query("backtest_metrics")
def backtest_metrics(spark, folder):
    return _rounded(_backtest(spark, folder)["metrics"], 3)


@query("backtest_slices")
def backtest_slices(spark, folder):
    return _rounded(_backtest(spark, folder)["slice_metrics"], 3)


@lru_cache(maxsize=4)
def _current(spark, folder):
    t, g = _tables(spark, folder), _league(spark, folder)
    last = g.ratings.agg(F.max("Season")).first()[0]
    teams = g.teams.where(F.col("Season") == last)
    features, _ = P.coach_changes(g.teams, g.changes())
    coaches = C.projected_coaches(teams, features, P.coach_latest_summary(t["coach_seasons"]), last + 1)
    rows = C.current_rows(
        teams, last + 1, coaches, t["roster"].where(F.col("season") == last), t["status"], t["recruiting"], t["transfers"],
        t["moves"], t["recruits"], t["programs"],
    )
    rolling = pinned(_backtest(spark, folder)["predictions"])
    return last, pinned(C.predict_current(pinned(rows), _model_table(spark, folder), rolling))


@query("current_predictions")
def current_predictions(spark, folder):
    return _rounded(_current(spark, folder)[1], 4)


@lru_cache(maxsize=4)
def _games(spark, folder):
    t, g = _tables(spark, folder), _league(spark, folder)
    road = pinned(K.road_games(g.schedule(), t["ratings"]))
    return road, pinned(K.training_games(g.schedule(), t["ratings"], t["coach_history"], _model_table(spark, folder), road))


@query("guarantee_games")
def guarantee_games(spark, folder):
    return _rounded(_games(spark, folder)[1])


@query("risk_board")
def risk_board(spark, folder):
    t = _tables(spark, folder)
    last, predictions = _current(spark, folder)
    road, games = _games(spark, folder)
    model = K.fit_risk(games)
    board = K.candidate_board(
        model, t["ratings"], predictions, P.coach_latest_summary(t["coach_seasons"]), games, road, last
    )
    return _rounded(board, 3)


@query("planner_board")
def planner_board(spark, folder):
    g = _league(spark, folder)
    last, predictions = _current(spark, folder)
    curve, _, bubble = N.benchmarks(g.ratings.where(F.col("Season") == last))
    chosen = predictions.where(F.col("model") == "direct_ridge_schedule_building")
    rows = N.planner_rows(chosen, curve, bubble if bubble is not None else 16.0)
    return rows.unionByName(N.placeholder_rows(rows, bubble if bubble is not None else 16.0).drop("is_placeholder"), allowMissingColumns=True)


@query("team_lineups")
def team_lineups(spark, folder):
    t, g = _tables(spark, folder), _league(spark, folder)
    last = g.ratings.agg(F.max("Season")).first()[0]
    players = N.lineup_players(t["status"], t["moves"], t["recruits"], last)
    first, rest = N.lineups(players)
    return _rounded(first.unionByName(rest.select("team", "name", "position", "score", F.col("bench_order").alias("slot_order")), allowMissingColumns=True))


@query("schedule_strength")
def schedule_strength(spark, folder):
    g = _league(spark, folder)
    return _rounded(N.schedule_strength(g.schedule(), g.ratings, g.net_rows()))
