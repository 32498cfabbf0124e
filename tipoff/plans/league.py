"""Season feeds derived from the order tables, so that the domain plans can run on any scale.

Suppliers stand for teams, years for seasons, revenue for strength, customers for players, parts
for recruits, and order lines for games.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tipoff.operators.ranking import latest_per_key, ordinal_rank
from tipoff.plans.registry import money, table

_CONFERENCES = ("ACC", "B10", "B12", "BE", "SEC", "A10", "MAC", "WCC", "Ivy", "SoCon")
_POSITIONS = ("PG", "SG", "SF", "F", "C")


def _pick(values: tuple[str, ...], key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def _coach(team: Column, season: Column) -> Column:
    """A coach stays three seasons and then moves on to a neighbour."""
    return F.concat(F.lit("Coach Mike Name"), F.pmod(team * 7 + F.floor(season / 3) * 3, F.lit(97)).cast("string"))


def _conference(team: Column) -> Column:
    return _pick(_CONFERENCES, team)


class League:
    """All feeds of one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.lines = table(spark, folder, "lineitem")
        self.orders = table(spark, folder, "orders")
        self.parts = table(spark, folder, "part")
        self.suppliers = table(spark, folder, "supplier").select(
            F.col("s_suppkey").alias("team"), F.col("s_name").alias("TeamName")
        )
        self.team_count = self.suppliers.count()
        yearly = self.lines.groupBy(F.col("l_suppkey").alias("team"), F.year("l_shipdate").alias("Season")).agg(
            money("l_extendedprice").alias("revenue"),
            F.count("*").alias("n"),
            F.count_if(F.col("l_returnflag") == "R").alias("returned"),
            F.avg("l_quantity").alias("quantity"),
            F.avg("l_discount").alias("discount"),
            F.avg("l_tax").alias("tax"),
        )
        ranked = ordinal_rank(yearly, ["Season"], [F.col("revenue").desc(), F.col("team")], "RankAdjEM")
        self.ratings = ranked.join(self.suppliers, "team").select(
            "team",
            "Season",
            "TeamName",
            _conference(F.col("team")).alias("ConfShort"),
            _coach(F.col("team"), F.col("Season")).alias("Coach"),
            (F.log("revenue") * 10 - 100).alias("AdjEM"),
            F.col("RankAdjEM").cast("int").alias("RankAdjEM"),
            (F.col("quantity") * 4).alias("AdjOE"),
            F.col("RankAdjEM").cast("int").alias("RankAdjOE"),
            (110 - F.col("discount") * 100).alias("AdjDE"),
            F.col("RankAdjEM").cast("int").alias("RankAdjDE"),
            (60 + F.col("tax") * 100).alias("AdjTempo"),
            F.col("RankAdjEM").cast("int").alias("RankAdjTempo"),
            (60 + F.col("tax") * 90).alias("Tempo"),
            F.col("discount").alias("Luck"),
            (F.col("quantity") - 25).alias("SOS"),
            F.col("RankAdjEM").cast("int").alias("RankSOS"),
            (F.col("quantity") - 24).alias("NCSOS"),
            F.col("RankAdjEM").cast("int").alias("RankNCSOS"),
            F.col("tax").alias("APL_Off"),
            F.col("discount").alias("APL_Def"),
            (F.col("n") - F.col("returned")).cast("int").alias("Wins"),
            F.col("returned").cast("int").alias("Losses"),
            F.when(F.col("RankAdjEM") <= 64, F.ceil(F.col("RankAdjEM") / 4).cast("int")).alias("Seed"),
            F.when(F.col("RankAdjEM") <= 64, "NCAA").alias("Event"),
            F.lit("final").alias("DataThrough"),
        )
        self.teams = self.ratings.select("Season", F.col("team").cast("string").alias("TeamID"), "TeamName", "ConfShort", "Coach")
        before = self.ratings.select(
            (F.col("Season") + 1).alias("Season"), "TeamName", "AdjEM", "RankAdjEM", "AdjOE", "RankAdjOE", "AdjDE", "RankAdjDE",
            "AdjTempo", "RankAdjTempo",
        )
        final = self.ratings.select(
            "Season", "TeamName", "ConfShort", F.col("AdjEM").alias("AdjEMFinal"), F.col("RankAdjEM").alias("RankAdjEMFinal"),
            F.col("AdjOE").alias("AdjOEFinal"), F.col("AdjDE").alias("AdjDEFinal"),
        )
        self.preseason = final.join(before, ["Season", "TeamName"], "left").withColumns(
            {"AdjEMChg": F.lit(None).cast("double"), "RankChg": F.lit(None).cast("int")}
        )
        # the archive with one row a name and season: both sides are cut before they meet, as names may repeat
        one = lambda rows: latest_per_key(rows, ["Season", "TeamName"], [c for c in rows.columns if c not in ("Season", "TeamName")])
        self.preseason_by_name = one(final).join(one(before), ["Season", "TeamName"], "left").withColumns(
            {"AdjEMChg": F.lit(None).cast("double"), "RankChg": F.lit(None).cast("int")}
        )
        shape = ranked.join(self.suppliers, "team")
        style = lambda names, base: shape.select(
            "Season", "TeamName", F.lit("false").alias("ConfOnly"),
            *[(F.col(base) * (i + 2) + F.col("tax") * i).alias(n) for i, n in enumerate(names)],
        )
        self.four_factors = style(("eFG_Pct", "TO_Pct", "OR_Pct", "FT_Rate", "DeFG_Pct", "DTO_Pct", "DOR_Pct", "DFT_Rate"), "quantity")
        self.misc = style(
            ("FG3Pct", "FG2Pct", "FTPct", "BlockPct", "StlRate", "NSTRate", "ARate", "F3GRate", "OppFG3Pct", "OppFG2Pct",
             "OppStlRate", "OppNSTRate", "OppARate", "OppF3GRate"), "discount")
        self.height = style(("AvgHgt", "HgtEff", "Exp", "Bench", "Continuity"), "quantity")
        self.points = style(("OffFg3", "DefFg3"), "discount")

    def players(self) -> DataFrame:
        """Customers on the team they bought most from, with the team of the next year."""
        bought = (
            self.lines.join(self.orders, self.lines.l_orderkey == self.orders.o_orderkey)
            .groupBy(F.year("l_shipdate").alias("season"), F.col("o_custkey").alias("player"), F.col("l_suppkey").alias("team"))
            .agg(
                F.sum("l_quantity").alias("mins"), F.sum(F.floor(F.col("l_extendedprice") / 1000)).alias("pts"),
                F.count("*").alias("gp"), F.max("l_discount").alias("disc"), F.max("l_tax").alias("tax"),
            )
        )
        own = latest_per_key(bought, ["season", "player"], ["mins", "team"])
        after = own.select((F.col("season") - 1).alias("season"), "player", F.col("team").alias("next_team"))
        rows = own.join(after, ["season", "player"], "left")
        named = self.suppliers.select("team", F.col("TeamName").alias("teamMarket"))
        to = self.suppliers.select(F.col("team").alias("next_team"), F.col("TeamName").alias("nextTeamMarket"))
        rows = rows.join(named, "team").join(to, "next_team", "left")
        text = lambda c: F.col(c).cast("string")
        n = F.col("gp").cast("double")
        stats = {
            "gp": n, "gs": n, "mins": F.col("mins") * 10, "poss": F.col("mins") * 12, "ptsScored": F.col("pts").cast("double"),
            "fga": n * 3, "fta": n, "ast": n * 2, "orb": n, "drb": n * 2, "reb": n * 3, "stl": n, "blk": n / 2, "tov": n, "pf": n * 2,
            "usagePct": F.col("disc") * 3, "ortgPlayer": 90 + F.col("disc") * 200, "drtgPlayer": 110 - F.col("tax") * 100,
            "efgPct": F.col("disc") * 5, "tsPct": F.col("disc") * 6, "astPct": F.col("tax") * 2, "orbPct": F.col("tax"),
            "drbPct": F.col("tax") * 2, "rebPct": F.col("tax") * 3, "stlPct": F.col("tax"), "blkPct": F.col("tax"),
            "tovPct": F.col("disc"), "per": F.col("disc") * 200, "warp": F.col("disc") * n / 2, "warpP40": F.col("disc"),
            "ws": F.col("tax") * n, "ows": F.col("tax") * n / 2, "dws": F.col("tax") * n / 2, "wsP40": F.col("tax"),
            "rapm": F.col("disc") - 0.05, "orapm": F.col("disc"), "drapm": F.when(F.col("tax") > 0.02, F.col("tax")),
        }
        leaves = F.col("next_team").isNotNull() & (F.pmod(F.col("player"), F.lit(3)) != 0)
        return rows.select(
            text("season").alias("competitionId"), text("team").alias("teamId"), "teamMarket", F.lit("Team").alias("teamName"),
            F.lit("1").alias("conferenceId"), text("player").alias("playerId"),
            F.concat(F.lit("Player "), text("player")).alias("fullName"),
            _pick(("Freshman", "Sophomore", "Junior", "Senior"), F.col("player") + F.col("season")).alias("classYr"),
            _pick(_POSITIONS, F.col("player")).alias("position"), F.lit("6-5").alias("height"),
            F.when(leaves, text("next_team")).alias("nextTeamId"), F.when(leaves, F.col("nextTeamMarket")).alias("nextTeamMarket"),
            F.lit(None).cast("string").alias("priorTeamId"), F.lit(None).cast("string").alias("priorTeamMarket"),
            F.lit("false").alias("isTransfer"),
            F.when(F.pmod("player", F.lit(11)) == 0, "1").alias("isDraftProspect"),
            F.when(F.pmod("player", F.lit(7)) == 0, "yes").alias("willTransfer"), F.lit("false").alias("inPortalAfterSeason"),
            *[v.cast("double").alias(k) for k, v in stats.items()],
        )

    def competitions(self) -> DataFrame:
        years = self.ratings.select("Season").distinct()
        return years.select(F.col("Season").cast("string").alias("competition_id"), F.col("Season").alias("season"))

    def net_rows(self) -> DataFrame:
        """End-of-season ranks: strength disturbed by returns."""
        score = F.col("AdjEM") - F.col("Losses") / (F.col("Wins") + F.col("Losses") + 1)
        ranked = ordinal_rank(
            self.ratings.withColumn("_s", score).select("Season", "TeamName", "ConfShort", "_s"), ["Season"],
            [F.col("_s").desc(), F.col("TeamName")], "net_rank",
        )
        return ranked.select(
            F.col("Season").alias("season"), F.col("TeamName").alias("team"), F.col("ConfShort").alias("conference"), "net_rank",
            F.col("net_rank").alias("net_nonconference_sos"),
            F.concat(F.lit("net_"), "Season").alias("source_file"),
        )

    def recruits(self) -> DataFrame:
        """Parts as recruits of the supplier their key falls to, one class a year."""
        season = 1996 + F.pmod(F.col("p_size"), F.lit(6))
        rows = self.parts.select(
            F.pmod("p_partkey", F.lit(self.team_count)).alias("team"), season.alias("season"), (season - 1).alias("ranking_year"),
            (season - 1).alias("class_year"), F.concat(F.lit("Player "), F.col("p_partkey").cast("string")).alias("player_name"),
            _pick(_POSITIONS, F.col("p_partkey")).alias("position_abbr"), F.lit(None).cast("string").alias("position"),
            F.when(F.pmod("p_partkey", F.lit(4)) != 0, F.pmod("p_partkey", F.lit(400)) + 1).cast("double").alias("industry_rank"),
            (70 + F.pmod("p_partkey", F.lit(30))).cast("double").alias("industry_rating"),
            F.lit(None).cast("double").alias("on3_rating"), F.col("p_brand").alias("high_school"),
        )
        return rows.join(self.suppliers.withColumnRenamed("TeamName", "_n"), "team").drop("team").withColumnRenamed("_n", "team")

    def ranked_feeds(self) -> tuple[DataFrame, DataFrame]:
        """Recruiting and transfer team rankings of the year before each season."""
        shared = [
            (F.col("Season") - 1).alias("ranking_year"), F.col("TeamName").alias("team"), F.lit(None).cast("string").alias("team_full_name"),
            F.col("RankAdjEM").alias("rank"), F.lit("x").alias("source_url"),
        ]
        recruiting = self.ratings.select(*shared, F.col("AdjOE").alias("score"), (F.col("RankAdjEM") % 5).alias("commits"))
        transfers = self.ratings.select(*shared, F.col("AdjDE").alias("index_score"), (F.col("RankAdjEM") % 4).alias("transfers_in"))
        return recruiting, transfers

    def schedule(self) -> DataFrame:
        """Order lines as games between two suppliers."""
        away = F.pmod(F.col("l_partkey"), F.lit(self.team_count))
        games = self.lines.where(away != F.col("l_suppkey")).select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")).alias("game_id"),
            F.year("l_shipdate").alias("season"), F.col("l_suppkey").alias("team"), away.alias("away"),
            F.date_format("l_shipdate", "yyyy-MM-dd'T'00:00'Z'").alias("date"),
            F.when(F.col("l_linenumber") == 7, "TRUE").otherwise("FALSE").alias("neutral_site"),
            (60 + F.col("l_quantity")).cast("int").alias("home_score"), (60 + F.col("l_discount") * 400 + F.col("l_tax") * 100).cast("int").alias("away_score"),
            (F.col("l_extendedprice") / 10).cast("int").alias("venue_capacity"),
        )
        home = self.suppliers.select("team", F.col("TeamName").alias("home_location"))
        visitor = self.suppliers.select(F.col("team").alias("away"), F.col("TeamName").alias("away_location"))
        rows = games.join(home, "team").join(visitor, "away")
        return rows.select(
            "game_id", "season", F.lit("2").alias("season_type"), "date", "neutral_site",
            F.when(_conference(F.col("team")) == _conference(F.col("away")), "TRUE").otherwise("FALSE").alias("conference_competition"),
            F.lit("true").alias("status_type_completed"), F.lit("Final").alias("status_type_description"),
            "home_location", F.col("home_location").alias("home_short_display_name"), "home_score",
            "away_location", F.col("away_location").alias("away_short_display_name"), "away_score", "venue_capacity",
        )

    def changes(self) -> DataFrame:
        """Listed coaching changes after the last season, some schools misspelled."""
        last = self.ratings.agg(F.max("Season")).first()[0]
        rows = self.ratings.where(F.col("Season") == last)
        third = F.pmod(F.col("team"), F.lit(5))
        name = F.when(third == 1, F.concat(F.col("TeamName"), F.lit("a"))).otherwise(F.col("TeamName"))
        return rows.where(third < 3).select(
            name.alias("school"), F.col("ConfShort").alias("conference"), F.col("Coach").alias("former_coach"),
            F.when(third == 2, "TBD").otherwise(_coach(F.col("team") + 1, F.lit(last))).alias("new_coach"),
            F.concat(F.lit("row"), F.col("team").cast("string")).alias("hoopdirt_row_id"), F.lit("u").alias("source_url"),
            F.lit("2002-01-01").alias("captured_at"),
        )
