"""Ordered decision rules: each is one CASE expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tipoff import fixed_values as fixed
from tipoff.functions.casts import is_roster_flag
from tipoff.functions.scalar import bucketize


def is_senior(class_year: Column) -> Column:
    word = F.lower(F.trim(class_year))
    known = word.isin(*fixed.SENIOR_CLASS_LABELS) | word.contains("senior") | word.contains("grad")
    return F.coalesce(known, F.lit(False))


def roster_status(
    team_id: Column,
    next_team_id: Column,
    in_portal: Column,
    will_transfer: Column,
    draft_prospect: Column,
    class_year: Column,
) -> Column:
    """Where a player is headed; the first rule that holds wins."""
    has_next = next_team_id.isNotNull() & (next_team_id != "")
    same = F.coalesce(next_team_id == team_id, F.lit(False))
    return (
        F.when(has_next & same, "confirmed_returning_same_team")
        .when(has_next, "transferred_out_committed")
        .when(is_roster_flag(in_portal) | is_roster_flag(will_transfer), "in_portal_uncommitted_or_pending")
        .when(is_roster_flag(draft_prospect), "draft_prospect_review")
        .when(is_senior(class_year), "senior_eligibility_review")
        .otherwise("probable_returner")
    )


def position_class(position: Column) -> Column:
    token = F.trim(F.upper(F.coalesce(position, F.lit(""))))
    return (
        F.when(token == "PG", "pg")
        .when(token.isin("SG", "CG", "G"), "guard")
        .when(token == "C", "big")
        .when(token.isin("PF", "F"), "forward")
        .otherwise("wing")
    )


def recruit_bucket(rank: Column) -> Column:
    labels = ("top25", "26_50", "51_100", "101_150", "151_250", "251_plus")
    ranked = bucketize(rank, (25, 50, 100, 150, 250), labels)
    return F.when(rank.isNull() | (rank <= 0), "unranked").otherwise(ranked)


def transfer_bucket(source_share: Column) -> Column:
    labels = ("0_05", "05_10", "10_15", "15_20", "20_25", "25_plus")
    return bucketize(source_share, (0.05, 0.10, 0.15, 0.20, 0.25), labels, null_label="0_05")


def rank_band(rank: Column) -> Column:
    return bucketize(rank, fixed.TARGET_BANDS, fixed.BAND_LABELS, null_label="unknown")


def band_from_flags(flags: list[Column]) -> Column:
    """Band of the first true flag; `flags` follow the order of the bands."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for flag, label in zip(flags, fixed.BAND_LABELS):
        out = out.when(F.coalesce(flag, F.lit(False)), label)
    return out.otherwise(fixed.BAND_LABELS[-1])


def stronger_band(left: Column, right: Column) -> Column:
    order = F.array(*[F.lit(b) for b in fixed.BAND_LABELS])
    last = len(fixed.BAND_LABELS)

    def place(band: Column) -> Column:
        at = F.array_position(order, F.coalesce(band, F.lit(fixed.BAND_LABELS[-1])))
        return F.when(at > 0, at).otherwise(last)

    return F.element_at(order, F.least(place(left), place(right)).cast("int"))


def consistency_band(
    last_rank: Column,
    rates: dict[int, Column],
    last3_rating: Column,
) -> Column:
    """Band of a program from its last rank, its hit rates and its three-year rating."""
    rate = {n: F.coalesce(c, F.lit(0.0)) for n, c in rates.items()}
    recent = F.coalesce(last3_rating, F.lit(float("-inf")))
    return (
        F.when(last_rank.isNull(), "301_plus")
        .when((last_rank <= 25) & ((rate[25] >= 0.50) | (recent >= 25)), "top_25")
        .when((last_rank <= 50) & ((rate[50] >= 0.50) | (recent >= 18)), "26_50")
        .when((last_rank <= 75) & (rate[75] >= 0.40), "51_75")
        .when((last_rank <= 100) & (rate[100] >= 0.40), "76_100")
        .when((last_rank <= 135) & (rate[135] >= 0.40), "101_135")
        .otherwise(bucketize(last_rank, (160, 200, 250, 300), fixed.BAND_LABELS[5:]))
    )


def risk_bucket(probability: Column) -> Column:
    labels = ("very_high", "high", "medium", "low", "very_low")
    return bucketize(probability, (0.12, 0.08, 0.05, 0.03), labels, upper_inclusive=False)


def risk_bucket_pct(pct: Column) -> Column:
    labels = ("very_high", "high", "medium", "low", "very_low")
    return bucketize(pct, (12, 8, 5, 3), labels, upper_inclusive=False, null_label="unknown")


def risk_order(bucket: Column) -> Column:
    order = F.array(*[F.lit(b) for b in ("very_low", "low", "medium", "high", "very_high")])
    return F.coalesce(F.array_position(order, bucket), F.lit(0)).cast("int")


def coach_signal(lift_points: Column) -> Column:
    return (
        F.when(lift_points.isNull(), "unknown")
        .when(lift_points >= 8, "very_high")
        .when(lift_points >= 3, "high")
        .when(lift_points <= -2, "low")
        .otherwise("neutral")
    )


def schedule_value(rank: Column) -> Column:
    return bucketize(rank, fixed.TARGET_BANDS, (10, 9, 8, 7, 6, 5, 4, 3, 2, 1), null_label=0)


def recommendation(value: Column, probability: Column) -> Column:
    return (
        F.when((probability >= 0.10) & (value <= 6), "avoid_bad_risk_reward")
        .when(probability >= 0.08, "avoid_unless_needed")
        .when((value >= 5) & (probability < 0.05), "strong_target")
        .when((value >= 4) & (probability < 0.07), "good_target")
        .when(value <= 2, "low_value")
        .otherwise("monitor")
    )


def tier_label(band: Column) -> Column:
    return (
        F.when(band == "top_25", "Top 25")
        .when(band == "301_plus", "301+")
        .otherwise(F.replace(F.trim(F.coalesce(band, F.lit(""))), F.lit("_"), F.lit("-")))
    )


def signal_group(feature: Column) -> Column:
    return (
        F.when(feature.contains("_roster_talent_") | feature.startswith("roster_talent_"), "roster_talent")
        .when(feature.contains("_coach_") | feature.startswith("coach_"), "coach_history_style")
        .when(feature.isin("days_from_nov_1", "venue_capacity_log"), "game_context")
        .otherwise("program_history")
    )


def slice_flags() -> dict[str, Column]:
    """Named booleans over a modeling row; a missing input makes a test false."""

    def at_least(name: str, edge: float) -> Column:
        return F.coalesce(F.col(name) >= edge, F.lit(False))

    def at_most(name: str, edge: float) -> Column:
        return F.coalesce(F.col(name) <= edge, F.lit(False))

    lost = "prior_roster_lost_or_uncertain_minutes_pct"
    gone = "prior_roster_confirmed_unavailable_minutes_pct"
    back = "prior_roster_expected_returning_minutes_pct"
    high_churn = at_least(lost, 0.35) | at_least(gone, 0.30)
    recruits = at_least("incoming_on3_hs_rank_percentile", 0.80)
    transfers = (
        at_least("incoming_on3_transfer_rank_percentile", 0.80)
        | at_least("incoming_cbb_transfer_players", 3)
        | at_least("incoming_cbb_transfer_source_adjusted_warp", 1.5)
    )
    return {
        "roster_data_available": F.col("prior_roster_source_season").isNotNull(),
        "high_churn": high_churn,
        "extreme_churn": at_least(lost, 0.50) | at_least(gone, 0.45),
        "very_high_churn": at_least(lost, 0.75),
        "low_returning_production": at_most(back, 0.35),
        "very_low_returning_core": at_most("prior_roster_expected_returning_top_7_minutes_roster_share", 0.25),
        "stable_roster": at_least(back, 0.65),
        "major_hs_class": recruits,
        "major_transfer_class": transfers,
        "major_incoming_class": recruits | transfers,
        "high_churn_or_major_incoming": high_churn | recruits | transfers,
    }
