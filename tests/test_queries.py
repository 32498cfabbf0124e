"""Named queries against their SQL on the smallest scale, and the schedule planner."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from check import compare, duck
from tipoff.plans import planner as N
from tipoff.plans.catalog import ORACLES, QUERIES

# quick ones of every kind; `check.py` runs them all
NAMES = (
    "prior_history", "season_grid", "tenure", "status_summary", "class_summary", "cascade_match", "merged_sources",
    "threshold_sweep", "probability_scores", "page_links", "safe_casts", "lineup_starters",
)


@pytest.fixture(scope="module")
def tables(sf):
    return duck(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, tables, name):
    verdict, _ = compare(spark, tables, name, sf)
    assert verdict.startswith("ok"), verdict


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_planner(spark):
    opponents = spark.createDataFrame(
        [("St. Al", 20.0, 18.0), ("Bo", 320.0, -5.0)], "team string, projected_net_rank double, projected_adj_em double"
    )
    games = spark.createDataFrame(
        [("s", "12/1", "Bo", "Home"), ("s", "11/2", "st al", "Away"), ("s", "x", "Nobody", "Home")],
        "schedule_id string, date string, opponent string, site string",
    )
    rows = N.slate(games, opponents, 10.0)
    assert [r["opponent"] for r in rows.collect()] == ["st al", "Bo", "Nobody"]
    total = N.slate_rollup(rows, 10.0)
    first = N.with_slate_notes(total).first()
    assert first["games"] == 2 and first["q1"] == 1 and first["buy301"] == 1 and first["quality"] == "1 top-100 | 1 top-200"
    assert abs(first["avg_opponent"] - (21.5 - 8.5) / 2) < 1e-9
    marks = spark.createDataFrame([(30.0,), (6.5,), (6.5,), (2.0,)], "rating double")
    ranked = N.benchmark_rank(total, "avg_opponent", "schedule_id", marks, "rating").first()
    assert ranked["difficulty_rank"] == 2
    ordered = N.search_board(opponents, "o", ["team"], {"team": []}, "projected_net_rank", "team").collect()
    assert [r["team"] for r in ordered] == ["Bo"]
    assert opponents.where(F.col("team") == "Bo").count() == 1


def test_entry_without_the_optional_part():
    """A library that only the training-data operators need is missing: all other queries stay."""
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert int(said[0]) > 100 and said[1] == "False"


def test_feature_tables_are_made_when_asked(spark, sf):
    from tipoff.plans.league import League
    from tipoff.plans.league_queries import _Tables

    tables = _Tables(League(spark, sf))
    assert tables["targets"].count() > 0 and set(tables) == {"targets"}


def test_archive_of_repeated_names(spark, sf, tmp_path):
    """Coach seasons take one archive row a name, however many teams bear it."""
    from tipoff.plans.league import League

    for name in ("lineitem", "orders", "part"):
        os.symlink(f"{sf}/{name}.parquet", tmp_path / f"{name}.parquet")
    suppliers = spark.read.parquet(f"{sf}/supplier.parquet").withColumn("s_name", F.lit("Same"))
    suppliers.write.parquet(str(tmp_path / "supplier.parquet"))
    league = League(spark, str(tmp_path))
    seasons = league.ratings.select("Season").distinct().count()
    assert league.preseason_by_name.count() == seasons
    known = ["Season", "TeamName", "AdjEMFinal", "AdjEM"]
    assert league.preseason_by_name.select(known).exceptAll(league.preseason.select(known)).count() == 0


def test_final_games_key_every_name(spark):
    from tipoff.functions.text import schedule_key
    from tipoff.plans.risk import final_games

    game = ("2001-11-05T00:00Z", "FALSE", "FALSE", "true", "2", 2001, 70, 60, 100.0)
    names = [("St. Al", "Bo St"), ("Bo St", None), ("", "St. Al"), ("St. Al", "Bo St")]
    fields = "date string, neutral_site string, conference_competition string, status_type_completed string, season_type string, season int, "
    fields += "home_score int, away_score int, venue_capacity double, game_id string, home_location string, away_location string"
    schedule = spark.createDataFrame([(*game, str(i), *n) for i, n in enumerate(names)], fields)
    want = schedule.select("game_id", *[schedule_key(F.col(f"{s}_location")).alias(s) for s in ("home", "away")])
    got = final_games(schedule).select("game_id", "home_team_key", "away_team_key")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
