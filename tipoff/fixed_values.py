"""Word lists, lookup tables and column formats the results depend on."""

# School spellings and the key they stand for.
TEAM_ALIASES = {
    "a and m corpus christi": "texas a and m corpus chris",
    "alcorn": "alcorn state",
    "app state": "appalachian state",
    "arkansas little rock": "little rock",
    "ark pine bluff": "arkansas pine bluff",
    "army west point": "army",
    "belmont university": "belmont",
    "binghamton university": "binghamton",
    "boston u": "boston university",
    "bryant university": "bryant",
    "california baptist": "cal baptist",
    "california baptist university": "cal baptist",
    "csun": "cal state northridge",
    "charleston so": "charleston southern",
    "california state university fullerton": "cal state fullerton",
    "california state university long beach": "long beach state",
    "california state university northridge": "cal state northridge",
    "canisius university": "canisius",
    "cleveland state university": "cleveland state",
    "college of charleston": "charleston",
    "col of charleston": "charleston",
    "central ark": "central arkansas",
    "central conn state": "central connecticut",
    "central mich": "central michigan",
    "denver university": "denver",
    "eastern ill": "eastern illinois",
    "eastern ky": "eastern kentucky",
    "eastern mich": "eastern michigan",
    "eastern wash": "eastern washington",
    "etsu": "east tennessee state",
    "detroit mercy": "detroit",
    "east texas a and m": "texas a and m commerce",
    "east texas a and m commerce": "texas a and m commerce",
    "fairfield university": "fairfield",
    "fdu": "fairleigh dickinson",
    "fgcu": "florida gulf coast",
    "fla atlantic": "florida atlantic",
    "florida gulf coast university": "florida gulf coast",
    "ga southern": "georgia southern",
    "george washington university": "george washington",
    "gonzaga university": "gonzaga",
    "grand canyon university": "grand canyon",
    "grambling": "grambling state",
    "houston christian": "houston baptist",
    "indiana university indianapolis": "iupui",
    "iu indy": "iupui",
    "kansas city": "umkc",
    "lamar university": "lamar",
    "le moyne college": "le moyne",
    "lindenwood university": "lindenwood",
    "lmu ca": "loyola marymount",
    "loyola chi": "loyola chicago",
    "loyola maryland": "loyola md",
    "manhattan college": "manhattan",
    "mcneese": "mcneese state",
    "miami": "miami fl",
    "middle tenn": "middle tennessee",
    "middle tennessee state": "middle tennessee",
    "mississippi val": "mississippi valley state",
    "missouri kansas city": "umkc",
    "missouri state university": "missouri state",
    "n c a and t": "north carolina a and t",
    "n c central": "north carolina central",
    "new jersey institute of technology": "njit",
    "niagara university": "niagara",
    "njit": "njit",
    "niu": "northern illinois",
    "northern ariz": "northern arizona",
    "northern colo": "northern colorado",
    "northern ky": "northern kentucky",
    "nicholls": "nicholls state",
    "ole miss": "mississippi",
    "omaha": "nebraska omaha",
    "pennsylvania": "penn",
    "prairie view": "prairie view a and m",
    "purdue university fort wayne": "purdue fort wayne",
    "queens nc": "queens",
    "queens university of charlotte": "queens",
    "saint marys ca": "saint marys",
    "sam houston": "sam houston state",
    "seattle u": "seattle",
    "sfa": "stephen f austin",
    "siue": "siu edwardsville",
    "southeast missouri": "southeast missouri state",
    "southeast mo state": "southeast missouri state",
    "southeastern la": "southeastern louisiana",
    "south fla": "south florida",
    "southern ca": "usc",
    "southern california": "usc",
    "southern ill": "southern illinois",
    "southern ind": "southern indiana",
    "southern u": "southern",
    "st johns ny": "saint johns",
    "saint johns ny": "saint johns",
    "saint josephs university": "saint josephs",
    "saint bonaventure university": "saint bonaventure",
    "saint marys college of california": "saint marys",
    "st francis brooklyn": "saint francis ny",
    "saint francis brooklyn": "saint francis ny",
    "saint francis": "saint francis pa",
    "st thomas mn": "saint thomas",
    "saint thomas mn": "saint thomas",
    "santa clara university": "santa clara",
    "southern university": "southern",
    "north carolina state": "nc state",
    "north ala": "north alabama",
    "n c state": "nc state",
    "nc state": "nc state",
    "uconn": "connecticut",
    "ualbany": "albany",
    "uic": "illinois chicago",
    "uiw": "incarnate word",
    "ulm": "louisiana monroe",
    "umes": "maryland eastern shore",
    "uncw": "unc wilmington",
    "uni": "northern iowa",
    "university of california irvine": "uc irvine",
    "university of california riverside": "uc riverside",
    "university of california san diego": "uc san diego",
    "university of california santa barbara": "uc santa barbara",
    "university of maryland baltimore county": "umbc",
    "university of nebraska at omaha": "nebraska omaha",
    "university of north carolina asheville": "unc asheville",
    "university of north carolina wilmington": "unc wilmington",
    "university of san francisco": "san francisco",
    "university of south carolina upstate": "usc upstate",
    "utah tech": "dixie state",
    "ut martin": "tennessee martin",
    "utrgv": "ut rio grande valley",
    "the university of texas at arlington": "ut arlington",
    "the university of texas rio grande valley": "ut rio grande valley",
    "usf": "south florida",
    "utah valley university": "utah valley",
    "virginia military institute": "vmi",
    "west ga": "west georgia",
    "western caro": "western carolina",
    "western ill": "western illinois",
    "western ky": "western kentucky",
    "western mich": "western michigan",
    "wisconsin milwaukee": "milwaukee",
    "wisconsin green bay": "green bay",
    "cal state bakersfield": "cal state bakersfield",
    "csu bakersfield": "cal state bakersfield",
    "st marys": "saint marys",
    "saint marys": "saint marys",
    "texas a and m university corpus christi": "texas a and m corpus chris",
}

# Second alias layer used for schedule feeds.
SCHEDULE_ALIASES = {
    "american university": "american",
    "iu indianapolis": "iupui",
    "iu indy": "iupui",
    "long island": "liu",
    "long island university": "liu",
    "queens nc": "queens",
    "queens university": "queens",
    "queens university of charlotte": "queens",
    "se louisiana": "southeastern louisiana",
    "s carolina upstate": "usc upstate",
    "sc upstate": "usc upstate",
    "south carolina upstate": "usc upstate",
    "saint thomas minnesota": "saint thomas",
    "st thomas minnesota": "saint thomas",
    "texas a and m corpus christi": "texas a and m corpus chris",
    "texas a and m cc": "texas a and m corpus chris",
}

# First names that stand for one another.
FIRST_NAME_ALIASES = {
    "bill": ["billy", "william"],
    "billy": ["bill", "william"],
    "bob": ["bobby", "robert"],
    "bobby": ["bob", "robert"],
    "chris": ["christopher"],
    "dave": ["david"],
    "david": ["dave"],
    "jim": ["james"],
    "james": ["jim"],
    "joe": ["joseph"],
    "john": ["johnny", "jon"],
    "jon": ["john", "johnny"],
    "mike": ["michael"],
    "michael": ["mike"],
    "rick": ["richard"],
    "richard": ["rick"],
    "steve": ["steven"],
    "steven": ["steve"],
}

# Keys known to be outside the universe.
KNOWN_UNMATCHED_KEYS = (
    "augusta",
    "concordia university",
    "hampden sydney",
    "lane college",
    "lincoln memorial",
    "north central college",
    "professional",
    "rollins college",
    "saint john fisher",
    "saint thomas university",
    "wayne state college",
    "west florida",
)

# Playing-style columns carried through a history.
STYLE_COLUMNS = (
    "tempo",
    "rank_tempo",
    "efg_pct",
    "to_pct",
    "or_pct",
    "ft_rate",
    "def_efg_pct",
    "def_to_pct",
    "def_or_pct",
    "def_ft_rate",
    "fg3_pct",
    "three_point_attempt_rate",
    "opp_fg3_pct",
    "opp_three_point_attempt_rate",
    "off_points_from_three_pct",
    "def_points_from_three_pct",
)

# Numeric rating columns of one team season.
RATING_FEATURES = (
    "adj_em",
    "rank_adj_em",
    "adj_oe",
    "rank_adj_oe",
    "adj_de",
    "rank_adj_de",
    "adj_tempo",
    "rank_adj_tempo",
    "tempo",
    "luck",
    "sos",
    "ncsos",
    "apl_off",
    "apl_def",
    "efg_pct",
    "to_pct",
    "or_pct",
    "ft_rate",
    "def_efg_pct",
    "def_to_pct",
    "def_or_pct",
    "def_ft_rate",
    "fg3_pct",
    "fg2_pct",
    "ft_pct",
    "block_pct",
    "steal_rate",
    "non_steal_turnover_rate",
    "assist_rate",
    "three_point_attempt_rate",
    "opp_fg3_pct",
    "opp_fg2_pct",
    "opp_steal_rate",
    "opp_non_steal_turnover_rate",
    "opp_assist_rate",
    "opp_three_point_attempt_rate",
    "avg_height",
    "effective_height",
    "experience",
    "bench",
    "continuity",
    "off_points_from_three_pct",
    "def_points_from_three_pct",
)

# Roster-talent columns used by the risk model.
ROSTER_TALENT_FEATURES = (
    "roster_talent_returning_production_pct_avg",
    "roster_talent_returning_quality_index",
    "roster_talent_returning_core_continuity",
    "roster_talent_known_roster_players",
    "roster_talent_returner_impact_share",
    "roster_talent_hs_newcomer_impact_share",
    "roster_talent_transfer_newcomer_impact_share",
    "roster_talent_newcomer_impact_share",
    "roster_talent_cbb_transfer_quality_index",
    "roster_talent_incoming_hs_score",
    "roster_talent_incoming_transfer_score",
    "roster_talent_incoming_hs_rank_percentile",
    "roster_talent_incoming_transfer_rank_percentile",
    "roster_talent_incoming_transfer_production_percentile",
    "roster_talent_weighted_returning_core_continuity",
    "roster_talent_weighted_hs_rank_percentile",
    "roster_talent_weighted_transfer_rank_percentile",
    "roster_talent_continuity_plus_incoming",
)

# Inputs of the upset-risk model.
RISK_MODEL_FEATURES = (
    "days_from_nov_1",
    "venue_capacity_log",
    "away_roster_talent_continuity_plus_incoming",
    "away_roster_talent_returning_quality_index",
    "away_roster_talent_returning_core_continuity",
    "away_roster_talent_cbb_transfer_quality_index",
    "away_roster_talent_incoming_transfer_score",
    "away_roster_talent_incoming_transfer_production_percentile",
    "away_roster_talent_incoming_hs_score",
    "away_roster_talent_incoming_hs_rank_percentile",
    "away_roster_talent_weighted_returning_core_continuity",
    "away_roster_talent_weighted_transfer_rank_percentile",
    "away_roster_talent_weighted_hs_rank_percentile",
    "home_roster_talent_continuity_plus_incoming",
    "roster_talent_gap",
    "away_roster_talent_x_coach_three_rate",
    "away_adj_em",
    "away_rank_adj_em",
    "away_adj_oe",
    "away_adj_de",
    "away_adj_tempo",
    "away_luck",
    "away_apl_off",
    "away_efg_pct",
    "away_to_pct",
    "away_or_pct",
    "away_ft_rate",
    "away_def_efg_pct",
    "away_def_to_pct",
    "away_def_or_pct",
    "away_fg3_pct",
    "away_three_point_attempt_rate",
    "away_opp_three_point_attempt_rate",
    "away_experience",
    "away_bench",
    "away_continuity",
    "away_off_points_from_three_pct",
    "home_adj_em",
    "home_rank_adj_em",
    "home_adj_oe",
    "home_adj_de",
    "home_adj_tempo",
    "home_def_efg_pct",
    "home_def_to_pct",
    "home_def_or_pct",
    "home_def_ft_rate",
    "home_opp_fg3_pct",
    "home_opp_three_point_attempt_rate",
    "home_experience",
    "home_continuity",
    "adj_em_gap",
    "adj_oe_gap",
    "adj_de_gap",
    "tempo_gap",
    "three_point_attempt_matchup",
    "three_point_make_matchup",
    "turnover_pressure_matchup",
    "off_rebound_matchup",
    "pace_shrink_signal",
    "away_quality_x_three_rate",
    "away_quality_x_experience",
    "home_vulnerability_index",
    "away_coach_prior_seasons",
    "away_coach_prior_win_pct",
    "away_coach_prior_avg_adj_em_over_expected",
    "away_coach_prior_last3_avg_adj_em_over_expected",
    "away_coach_prior_positive_adj_em_over_expected_rate",
    "away_coach_prior_big_overperform_rate",
    "away_coach_prior_avg_tempo",
    "away_coach_prior_last3_avg_tempo",
    "away_coach_prior_avg_three_point_attempt_rate",
    "away_coach_prior_last3_avg_three_point_attempt_rate",
    "away_coach_prior_avg_off_points_from_three_pct",
    "away_coach_prior_avg_to_pct",
    "away_coach_prior_avg_or_pct",
    "away_coach_prior_avg_ft_rate",
    "away_coach_prior_avg_def_to_pct",
    "away_coach_prior_avg_def_or_pct",
    "home_coach_prior_seasons",
    "home_coach_prior_win_pct",
    "home_coach_prior_avg_adj_em_over_expected",
    "home_coach_prior_last3_avg_adj_em_over_expected",
    "home_coach_prior_big_underperform_rate",
    "home_coach_prior_avg_tempo",
    "home_coach_prior_avg_opp_three_point_attempt_rate",
    "home_coach_prior_avg_def_efg_pct",
    "home_coach_prior_avg_def_to_pct",
    "home_coach_prior_avg_def_or_pct",
    "home_coach_prior_avg_def_ft_rate",
    "home_coach_first_year_at_school",
    "coach_overperformance_gap",
    "coach_positive_over_expected_gap",
    "coach_experience_gap",
    "coach_style_tempo_gap",
    "away_coach_style_three_rate_x_quality",
    "away_coach_style_threes_vs_home_allow",
    "away_coach_overperformance_x_quality",
    "home_coach_underperformance_x_vulnerability",
    "away_coach_hm_guarantee_games_log",
    "away_coach_hm_guarantee_upset_rate",
    "away_coach_hm_guarantee_close_rate",
    "away_coach_hm_guarantee_over_expected_rate",
    "away_coach_hm_guarantee_avg_margin_over_expected",
    "away_coach_road_hm_games_log",
    "away_coach_road_hm_upset_rate",
    "away_coach_road_hm_close_rate",
    "away_coach_road_hm_over_expected_rate",
    "away_coach_road_hm_avg_margin_over_expected",
    "home_coach_hm_guarantee_games_log",
    "home_coach_hm_guarantee_upset_allowed_rate",
    "home_coach_hm_guarantee_close_allowed_rate",
    "home_coach_hm_guarantee_under_expected_rate",
    "home_coach_hm_guarantee_avg_margin_allowed_over_expected",
    "coach_guarantee_upset_rate_gap",
    "coach_guarantee_over_expected_gap",
    "away_coach_guarantee_pest_index",
    "home_coach_guarantee_vulnerability_index",
    "away_coach_road_hm_pest_index",
)

# Numeric fields of a recruiting team ranking.
RECRUIT_RANKING_FIELDS = (
    "rank",
    "score",
    "on3_score",
    "commits",
    "applied_commits",
    "avg_rating",
    "on3_avg_rating",
    "total_rating",
    "on3_total_rating",
    "five_stars",
    "on3_five_stars",
    "four_stars",
    "on3_four_stars",
    "three_stars",
    "on3_three_stars",
    "avg_nil_value",
    "conference_rank",
)

# Numeric fields of a transfer team ranking.
TRANSFER_RANKING_FIELDS = (
    "rank",
    "index_score",
    "raw_score",
    "transfers_in",
    "transfers_in_avg_rating",
    "raw_score_in",
    "transfers_out",
    "transfers_out_avg_rating",
    "raw_score_out",
    "five_stars_net",
    "five_stars_in",
    "five_stars_out",
    "four_stars_net",
    "four_stars_in",
    "four_stars_out",
    "three_stars_net",
    "three_stars_in",
    "three_stars_out",
    "original_nil_valuation",
    "adjusted_nil_valuation",
    "nil_valuation_change",
)

# Summed player statistics of the roster summary.
ROSTER_COUNTING_STATS = (
    "games_started",
    "minutes",
    "possessions",
    "points",
    "field_goal_attempts",
    "free_throw_attempts",
    "assists",
    "offensive_rebounds",
    "defensive_rebounds",
    "rebounds",
    "steals",
    "blocks",
    "turnovers",
    "personal_fouls",
    "warp",
    "win_shares",
    "offensive_win_shares",
    "defensive_win_shares",
)

# Minutes-weighted player statistics of the roster summary.
ROSTER_RATE_STATS = (
    "usage_pct",
    "ortg_player",
    "drtg_player",
    "per",
    "warp_per_40",
    "win_shares_per_40",
    "effective_fg_pct",
    "true_shooting_pct",
    "assist_pct",
    "offensive_rebound_pct",
    "defensive_rebound_pct",
    "rebound_pct",
    "steal_pct",
    "block_pct",
    "turnover_pct",
    "rapm",
    "offensive_rapm",
    "defensive_rapm",
)

# Summed player statistics of the transfer summary.
TRANSFER_COUNTING_STATS = (
    "minutes",
    "possessions",
    "points",
    "field_goal_attempts",
    "free_throw_attempts",
    "assists",
    "offensive_rebounds",
    "defensive_rebounds",
    "rebounds",
    "steals",
    "blocks",
    "turnovers",
    "warp",
    "win_shares",
    "offensive_win_shares",
    "defensive_win_shares",
)

# Minutes-weighted player statistics of the transfer summary.
TRANSFER_RATE_STATS = (
    "usage_pct",
    "ortg_player",
    "drtg_player",
    "per",
    "warp_per_40",
    "win_shares_per_40",
    "effective_fg_pct",
    "true_shooting_pct",
    "assist_pct",
    "rebound_pct",
    "turnover_pct",
    "rapm",
    "offensive_rapm",
    "defensive_rapm",
)

# Transfer summary columns that get a season percentile.
TRANSFER_PERCENTILE_COLUMNS = (
    "cbb_transfer_players",
    "cbb_transfer_500_minute_players",
    "cbb_transfer_200_minute_players",
    "cbb_transfer_high_usage_players",
    "cbb_transfer_positive_warp_players",
    "cbb_transfer_plus_one_warp_players",
    "cbb_transfer_minutes",
    "cbb_transfer_warp",
    "cbb_transfer_win_shares",
    "cbb_transfer_source_adjusted_warp",
    "cbb_transfer_source_adjusted_win_shares",
    "cbb_transfer_minutes_weighted_per",
    "cbb_transfer_minutes_weighted_net_rating",
    "cbb_transfer_minutes_weighted_source_adj_em",
)

# Small word lists.
NAME_SUFFIXES = ("ii", "iii", "iv", "jr", "sr", "v")
COACH_TITLE_WORDS = ("acting", "coach", "head", "interim")
UNKNOWN_COACH_VALUES = ("", "open", "tbd", "vacant")
SENIOR_CLASS_LABELS = ("grad", "graduate", "gr", "senior")
TOP_CONFERENCES = ("ACC", "B10", "B12", "BE", "P12", "SEC")
ADJUSTED_STATS = ("points", "assists", "rebounds", "warp", "win_shares")

# Roster statuses, in the order of the output columns.
STATUS_LABELS = (
    "probable_returner",
    "confirmed_returning_same_team",
    "transferred_out_committed",
    "in_portal_uncommitted_or_pending",
    "draft_prospect_review",
    "senior_eligibility_review",
)
RETURNING_STATUSES = STATUS_LABELS[:2]
LOST_STATUSES = STATUS_LABELS[2:]

# Rank bands of the rolling evaluation and of the target table.
TARGET_BANDS = (25, 50, 75, 100, 135, 160, 200, 250, 300)
LABEL_BANDS = (50, 75, 100, 135)
BAND_LABELS = (
    "top_25",
    "26_50",
    "51_75",
    "76_100",
    "101_135",
    "136_160",
    "161_200",
    "201_250",
    "251_300",
    "301_plus",
)

# Numeric constants.
HOME_ADVANTAGE = 3.5
WIN_SCALE = 6.5
LOGISTIC_BASE = 2.718281828
FIELD_SIZE = 364.0
ROTATION_SIZE = 9.0
ROTATION_MINUTES_TARGET = 0.75
ROLE_REFERENCE_SHARE = 0.08
SPECIALIST_TARGET = 2.0
COURT_TARGET = 5.0
IMPACT_WEIGHTS = {"returner": 1.0, "hs": 0.65, "transfer": 1.15}
PROXY_WEIGHTS = {"coach": 0.6, "program": 0.4}
MIN_RECRUIT_SAMPLE = 12
MIN_TRANSFER_SAMPLE = 20
CLASS_WEIGHTS = (1.0, 0.8, 0.65, 0.5, 0.4, 0.3)
CLASS_TAIL_WEIGHT = 0.25

# Accepted header spellings of a transfer ledger, in order of preference.
LEDGER_HEADERS = {
    "player_id": ("playerid", "player id", "player_id"),
    "player": ("player", "name", "player name", "player_name", "full name", "full_name"),
    "source": (
        "source team", "source_team", "from", "from team", "from_team", "prior team",
        "prior_team", "previous team", "previous_team", "old team", "old_team",
    ),
    "destination": (
        "destination team", "destination_team", "to", "to team", "to_team", "new team",
        "new_team", "current team", "current_team", "committed team", "committed_team", "school",
    ),
    "status": ("portalstatus", "portal_status", "status", "rawstatus", "raw_status"),
    "source_division": ("divisionid", "division_id", "source_division", "division"),
    "destination_division": ("divisionidto", "division_id_to", "destination_division", "division_to"),
}

# Month names of ranking pages.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7,
    "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
}
