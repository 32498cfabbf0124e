"""Nested payloads: envelopes, ranked team lists, commit lists, coaching changes, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipoff import fixed_values as fixed
from tipoff.functions.casts import first_non_empty, to_int_via_double
from tipoff.functions.scalar import recruit_percentile
from tipoff.functions.text import clean_cell, epoch_to_iso, header_name, normalize_text, team_key

# Field names of the ranking pages.
_ORGANIZATION = "organization STRUCT<key STRING, name STRING, fullName STRING, slug STRING, urlSlug STRING, abbreviation STRING>, organizationKey STRING"
_RANKING = "relatedModel STRUCT<year INT, key STRING, dateUpdated DOUBLE, dateScheduled DOUBLE, status STRING, staleness STRING, averageCommits DOUBLE>"
_RECRUITING = {
    "on3_rank": "overallRank",
    "industry_rank": "overallConsensusRank",
    "score": "dispayConsensusScore",
    "on3_score": "dispayOn3Score",
    "commits": "commits",
    "applied_commits": "appliedCommits",
    "avg_rating": "appliedAverageConsensusRating",
    "on3_avg_rating": "appliedAverageRating",
    "total_rating": "appliedTotalConsensusRating",
    "on3_total_rating": "appliedTotalRating",
    "five_stars": "consensusFiveStars",
    "on3_five_stars": "fiveStars",
    "four_stars": "consensusFourStars",
    "on3_four_stars": "fourStars",
    "three_stars": "consensusThreeStars",
    "on3_three_stars": "threeStars",
    "avg_nil_value": "averageNilValue",
    "conference_rank": "conferenceConsensusRank",
}
_TRANSFER = {
    "rank": "overallRank",
    "index_score": "overallScore",
    "raw_score": "rawScore",
    "transfers_in": "totalIn",
    "transfers_in_avg_rating": "totalInAverageRating",
    "raw_score_in": "rawScoreIn",
    "transfers_out": "totalOut",
    "transfers_out_avg_rating": "totalOutAverageRating",
    "raw_score_out": "rawScoreOut",
    "five_stars_net": "fiveStarsNet",
    "five_stars_in": "fiveStarsIn",
    "five_stars_out": "fiveStarsOut",
    "four_stars_net": "fourStarsNet",
    "four_stars_in": "fourStarsIn",
    "four_stars_out": "fourStarsOut",
    "three_stars_net": "threeStarsNet",
    "three_stars_in": "threeStarsIn",
    "three_stars_out": "threeStarsOut",
    "original_nil_valuation": "originalNilValuation",
    "adjusted_nil_valuation": "adjustedNilValuation",
    "nil_valuation_change": "nilValuationChange",
}


def _list_schema(root: str, numbers: list[str], extra: str = "") -> str:
    fields = ", ".join(f"{n} DOUBLE" for n in dict.fromkeys(numbers))
    item = f"STRUCT<{_ORGANIZATION}, {fields}{extra}>"
    return f"props STRUCT<pageProps: STRUCT<{root}: STRUCT<{_RANKING}, list ARRAY<{item}>>>>"


def _organization(item: Column) -> list[Column]:
    org = item["organization"]
    return [
        F.coalesce(org["key"], item["organizationKey"]).alias("organization_key"),
        org["name"].alias("team"),
        org["fullName"].alias("team_full_name"),
        F.coalesce(org["slug"], org["urlSlug"]).alias("team_slug"),
        org["abbreviation"].alias("team_abbreviation"),
    ]


def _items(pages: DataFrame, json: str, schema: str, root: str) -> DataFrame:
    body = F.from_json(json, schema)["props"]["pageProps"][root]
    return pages.withColumn("_body", body).select(
        *[c for c in pages.columns if c != json], F.col("_body.relatedModel").alias("_ranking"), F.explode("_body.list").alias("_item")
    )


def recruiting_rankings(pages: DataFrame, json: str = "json") -> DataFrame:
    """Team rows of recruiting pages; other columns of the page (url, capture time) go along."""
    rows = _items(pages, json, _list_schema("teamData", list(_RECRUITING.values())), "teamData")
    item, ranking = F.col("_item"), F.col("_ranking")
    overall = F.coalesce(F.nullif(item["overallConsensusRank"], F.lit(0.0)), item["overallRank"])
    return rows.select(
        F.lit("on3_hs_recruiting").alias("source"),
        *[c for c in pages.columns if c != json],
        ranking["year"].alias("ranking_year"),
        ranking["key"].alias("ranking_key"),
        epoch_to_iso(ranking["dateUpdated"]).alias("ranking_date_updated"),
        ranking["status"].alias("ranking_status"),
        ranking["averageCommits"].alias("average_commits_used"),
        *_organization(item),
        overall.alias("rank"),
        *[item[field].alias(name) for name, field in _RECRUITING.items()],
    )


def transfer_rankings(pages: DataFrame, json: str = "json") -> DataFrame:
    """Team rows of transfer-portal pages."""
    extra = ", date STRING, dateModified DOUBLE"
    rows = _items(pages, json, _list_schema("teamRankings", list(_TRANSFER.values()), extra), "teamRankings")
    item, ranking = F.col("_item"), F.col("_ranking")
    return rows.select(
        F.lit("on3_transfer_portal").alias("source"),
        *[c for c in pages.columns if c != json],
        ranking["year"].alias("ranking_year"),
        ranking["key"].alias("ranking_key"),
        epoch_to_iso(ranking["dateUpdated"]).alias("ranking_date_updated"),
        epoch_to_iso(ranking["dateScheduled"]).alias("ranking_date_scheduled"),
        ranking["status"].alias("ranking_status"),
        ranking["staleness"].alias("ranking_staleness"),
        *_organization(item),
        item["date"].alias("date"),
        epoch_to_iso(item["dateModified"]).alias("date_modified"),
        *[item[field].alias(name) for name, field in _TRANSFER.items()],
    )


# Field names of a commit list.
_COMMITS = """props STRUCT<pageProps: STRUCT<playerList: STRUCT<list: ARRAY<STRUCT<recKey: STRING,
  player: STRUCT<key: STRING, recruitmentKey: STRING, fullName: STRING, slug: STRING, highSchoolName: STRING, classYear: STRING,
    height: STRING, weight: STRING, position: STRUCT<abbr: STRING, name: STRING>, hometown: STRUCT<abbr: STRING, name: STRING>,
    state: STRUCT<abbr: STRING, name: STRING>>,
  status: STRUCT<type: STRING, transfer: BOOLEAN, date: STRING, committedAsset: STRUCT<slug: STRING, urlSlug: STRING>>,
  rating: STRUCT<consensusRating: DOUBLE, consensusStars: INT, consensusNationalRank: DOUBLE, consensusPositionRank: DOUBLE,
    consensusStateRank: DOUBLE, rating: DOUBLE, stars: INT, nationalRank: DOUBLE, positionRank: DOUBLE, stateRank: DOUBLE,
    positionAbbr: STRING>,
  nilValue: STRUCT<rank: DOUBLE, totalValue: DOUBLE>>>>>>"""


def commit_rows(pages: DataFrame, json: str = "json") -> DataFrame:
    """Committed recruits of team pages.

    Pages carry `team_slug`, `team_name` and `ranking_year`. Transfers, other classes, open
    recruitments and commitments to another team are left out.
    """
    rows = pages.withColumn("_i", F.explode(F.from_json(json, _COMMITS)["props"]["pageProps"]["playerList"]["list"]))
    p, s, r, n = (F.col("_i")[k] for k in ("player", "status", "rating", "nilValue"))
    to = first_non_empty(s["committedAsset"]["slug"], s["committedAsset"]["urlSlug"])
    kept = rows.where(
        ~F.coalesce(s["transfer"], F.lit(False))
        & (to_int_via_double(p["classYear"]) == F.col("ranking_year"))
        & s["type"].isin("Committed", "Signed", "Enrolled")
        & (to.isNull() | (to == F.col("team_slug")))
    )
    carried = [c for c in pages.columns if c not in (json, "team_name", "team_slug", "ranking_year")]
    return kept.select(
        F.lit("on3_hs_commits").alias("source"),
        *carried,
        "ranking_year",
        (F.col("ranking_year") + 1).alias("season"),
        F.col("team_name").alias("team"),
        "team_slug",
        team_key(F.col("team_name")).alias("team_key"),
        p["key"].alias("player_key"),
        F.coalesce(p["recruitmentKey"], F.col("_i.recKey")).alias("recruitment_key"),
        p["fullName"].alias("player_name"),
        p["slug"].alias("player_slug"),
        p["highSchoolName"].alias("high_school"),
        F.coalesce(p["hometown"]["abbr"], p["hometown"]["name"]).alias("hometown"),
        F.coalesce(p["state"]["abbr"], p["state"]["name"]).alias("state"),
        to_int_via_double(p["classYear"]).alias("class_year"),
        F.coalesce(p["position"]["abbr"], p["position"]["name"]).alias("position"),
        p["height"].alias("height"),
        p["weight"].alias("weight"),
        s["type"].alias("status_type"),
        s["date"].alias("status_date"),
        r["consensusRating"].alias("industry_rating"),
        r["consensusStars"].alias("industry_stars"),
        r["consensusNationalRank"].alias("industry_rank"),
        r["consensusPositionRank"].alias("industry_position_rank"),
        r["consensusStateRank"].alias("industry_state_rank"),
        r["rating"].alias("on3_rating"),
        r["stars"].alias("on3_stars"),
        r["nationalRank"].alias("on3_rank"),
        r["positionRank"].alias("on3_position_rank"),
        r["stateRank"].alias("on3_state_rank"),
        F.coalesce(r["positionAbbr"], p["position"]["abbr"]).alias("position_abbr"),
        n["rank"].alias("nil_rank"),
        n["totalValue"].alias("nil_value"),
    )


def unwrap_envelope(df: DataFrame, json: str, item_schema: str, keys: tuple[str, ...] = ("data", "results", "items", "rows")) -> DataFrame:
    """Rows of a response that is a list, an object holding a list, or one bare row."""
    text = F.col(json)
    listed = F.when(F.ltrim(text).startswith("["), F.from_json(text, f"array<struct<{item_schema}>>"))
    held = [F.from_json(F.get_json_object(text, f"$.{k}"), f"array<struct<{item_schema}>>") for k in keys]
    bare = F.array(F.from_json(text, f"struct<{item_schema}>"))
    rows = F.coalesce(listed, *held, bare)
    return df.withColumn("_row", F.explode(rows)).where(F.col("_row").isNotNull()).select(
        *[c for c in df.columns if c != json], "_row.*"
    )


def coaching_changes(payloads: DataFrame, json: str = "json") -> DataFrame:
    """Change rows of tracker payloads with `season`, `source_url` and `captured_at`; no school, no row."""
    schema = "array<struct<value: struct<school: string, conference: string, old_coach: string, new_coach: string, `___id___`: string>>>"
    rows = payloads.withColumn("_v", F.explode(F.from_json(json, schema))).withColumn("_v", F.col("_v.value"))
    out = rows.select(
        F.lit("hoopdirt_coaching_changes").alias("source"),
        "source_url",
        "captured_at",
        "season",
        F.lit("D-I").alias("division"),
        clean_cell(F.col("_v.school")).alias("school"),
        clean_cell(F.col("_v.conference")).alias("conference"),
        clean_cell(F.col("_v.old_coach")).alias("former_coach"),
        clean_cell(F.col("_v.new_coach")).alias("new_coach"),
        F.col("_v.___id___").alias("hoopdirt_row_id"),
    )
    return out.where(F.col("school").isNotNull())


# Columns of a portal export and the feed field each one comes from.
_LEDGER = {
    "updatedWhen": "updatedWhen", "portalStatus": "status", "playerId": "playerId",
    "competitionId": "competitionId", "conferenceId": "conferenceIdFrom", "teamId": "teamIdFrom",
    "teamMarket": "teamMarketFrom", "source_team": "teamMarketFrom", "divisionIdTo": "divisionIdTo",
    "conferenceIdTo": "conferenceIdTo", "teamIdTo": "teamIdTo", "teamMarketTo": "teamMarketTo",
    "destination_team": "teamMarketTo", "eligibilityYear": "eligibilityYear", "createdWhen": "createdWhen",
    "updated": "updated", "activeFlag": "activeFlag", "redshirtFlag": "redshirtFlag",
    "portalRecency": "portalRecency", "vcPlayerId": "vcPlayerId", "vcFirstName": "vcFirstName",
    "vcLastName": "vcLastName", "vcTeamMarketFrom": "vcTeamMarketFrom", "vcTeamMarketTo": "vcTeamMarketTo",
    "noMatch": "noMatch", "rawStatus": "status",
}


def portal_ledger(rows: DataFrame) -> DataFrame:
    """Ledger columns of a portal feed; fields the feed lacks are null."""

    def field(name: str) -> Column:
        return F.col(name) if name in rows.columns else F.lit(None).cast("string")

    def part(name: str) -> Column:
        return F.nullif(F.trim(F.coalesce(field(name).cast("string"), F.lit(""))), F.lit(""))

    joined = F.concat_ws(" ", part("firstName"), part("lastName"))
    full = F.coalesce(F.nullif(joined, F.lit("")), field("fullName"))
    division = F.coalesce(F.nullif(field("divisionIdFrom").cast("string"), F.lit("")), field("divisionId").cast("string"))
    return rows.select(
        *[field(source).alias(name) for name, source in _LEDGER.items()],
        full.alias("fullName"),
        full.alias("player_name"),
        division.alias("divisionId"),
    )


def ledger_columns(columns: list[str]) -> dict[str, str | None]:
    """Which header stands for which ledger field; the first known spelling wins."""
    by_name = {header_name(c).replace("_", " "): c for c in columns}
    return {
        role: next((by_name[h.replace("_", " ")] for h in spellings if h.replace("_", " ") in by_name), None)
        for role, spellings in fixed.LEDGER_HEADERS.items()
    }


def recruit_players(rows: DataFrame) -> DataFrame:
    """Recruits of a snapshot with `ranking_year` (the year of the file): own class only, keyed and rated."""
    year = F.col("ranking_year")
    season = F.coalesce(to_int_via_double(F.col("season").cast("string")), year + 1)
    return rows.where(to_int_via_double(F.col("class_year").cast("string")) == year).withColumns(
        {
            "season": season,
            "team_key": team_key(F.col("team")),
            "percentile": recruit_percentile(
                F.col("industry_rank").cast("double"), F.col("industry_rating").cast("double"), F.col("on3_rating").cast("double")
            ),
        }
    )


def ledger_status_ok(status: Column) -> Column:
    """A ledger row counts when its status is blank or says transferred."""
    word = normalize_text(status)
    return (word == "") | (word == "transferred")
