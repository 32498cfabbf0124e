"""Hand-computed cases of the column functions."""

from pyspark.sql import functions as F

from tipoff.functions import casts as C
from tipoff.functions import labels as L
from tipoff.functions import scalar as S
from tipoff.functions import text as T


def one(spark, column, **values):
    fields = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items())
    frame = spark.createDataFrame([tuple(values.values())], fields)
    return frame.select(column.alias("x")).first()["x"]


def test_casts(spark):
    rows = ["7", "7.0", "", "bad", "7d", " 2 ", "true", "NaN", "-", "1e3"]
    got = spark.createDataFrame([(r,) for r in rows], "a string").select(
        "a", C.to_double("a").alias("d"), C.to_finite_double("a").alias("f"), C.to_int("a").alias("i"),
        C.to_int_via_double("a").alias("v"), C.double_or_zero("a").alias("z"), C.dash_int("a").alias("m"),
    )
    by = {r["a"]: r for r in got.collect()}
    assert by["7.0"]["d"] == 7.0 and by["7.0"]["i"] is None and by["7.0"]["v"] == 7
    assert by[""]["d"] is None and by["bad"]["d"] is None and by["7d"]["d"] is None
    assert by[" 2 "]["d"] == 2.0 and by["1e3"]["d"] == 1000.0
    assert by["true"]["f"] == 1.0 and by["NaN"]["f"] is None and by["NaN"]["d"] != by["NaN"]["d"]
    assert by["bad"]["z"] == 0.0 and by["-"]["m"] is None


def test_names(spark):
    assert one(spark, T.normalize_text(F.col("a")), a="  José & O'Neil–St. ") == "jose and oneil st"
    assert one(spark, T.normalize_text(F.col("a"), full_unicode=True), a="ﬁrst") == "first"
    assert one(spark, T.normalize_text(F.col("a")), a=None) == ""
    keys = {
        "St. John's (NY)": "saint johns", "Ohio St.": "ohio state", "UConn AQ": "connecticut",
        "Cal St. Bakersfield": "cal state bakersfield", "Texas A&M": "texas a and m",
    }
    for name, key in keys.items():
        assert one(spark, T.team_key(F.col("a")), a=name) == key
    assert one(spark, T.schedule_key(F.col("a")), a="Long Island University") == "liu"
    assert one(spark, T.coach_name(F.col("a")), a="Interim Coach Bill Self (acting)") == "bill self"
    assert set(one(spark, T.name_keys(F.col("a")), a="Bill J Self")) == {"bill j self", "bill self", "billy self", "william self"}
    assert one(spark, T.name_keys(F.col("a")), a="") == []
    assert one(spark, T.player_key(F.col("a")), a="Tim Smith Jr.") == "tim smith"
    assert one(spark, T.clean_cell(F.col("a")), a=" <b>A&amp;M</b>  x ") == "A&M x"


def test_name_match(spark):
    pairs = [
        ("Bill Self", "Coach Bill Self", "exact_normalized"), ("Bill Self", "Billy Self", "first_last"),
        ("Jonathan Smith", "Jonathon Smith", "fuzzy"), ("Ann Lee", "Bob Ray", "no_match"), ("", "Bob Ray", "missing"),
    ]
    frame = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string")
    got = {(r["a"], r["b"]): r["m"] for r in T.with_name_match(frame, "a", "b", "m").collect()}
    assert all(got[(a, b)] == m for a, b, m in pairs)


def test_bands_and_rules(spark):
    assert one(spark, L.rank_band(F.col("r")), r=25.0) == "top_25"
    assert one(spark, L.rank_band(F.col("r")), r=25.5) == "26_50"
    assert one(spark, L.rank_band(F.lit(None).cast("double")), r=1.0) == "unknown"
    assert one(spark, L.risk_bucket(F.col("p")), p=0.12) == "very_high"
    assert one(spark, L.stronger_band(F.lit("76_100"), F.lit("26_50")), p=1.0) == "26_50"
    assert one(spark, L.stronger_band(F.lit(None).cast("string"), F.lit("odd")), p=1.0) == "301_plus"
    assert one(spark, L.recommendation(F.lit(6), F.col("p")), p=0.10) == "avoid_bad_risk_reward"
    assert one(spark, L.recommendation(F.lit(5), F.col("p")), p=0.04) == "strong_target"
    assert one(spark, L.coach_signal(F.col("p")), p=-2.0) == "low"
    assert one(spark, L.recruit_bucket(F.col("p")), p=0.0) == "unranked"
    assert one(spark, L.band_from_flags([F.lit(False), F.lit(True)]), p=1.0) == "26_50"


def test_null_rules(spark):
    none = F.lit(None).cast("double")
    assert one(spark, S.mean_existing(F.col("a"), none), a=4.0) == 4.0
    assert one(spark, S.mean_existing(none, none), a=4.0) is None
    assert one(spark, S.clip(none, 0.0, 1.0), a=4.0) is None
    assert one(spark, S.weighted_mean_existing((F.col("a"), 0.5), (none, 0.5)), a=4.0) == 4.0
    assert one(spark, S.field_percentile(F.col("a")), a=400.0) == 1 / 364
    assert one(spark, S.field_percentile(F.col("a")), a=0.0) is None
    assert one(spark, S.rank_percentile(F.col("a"), F.lit(1)), a=1.0) is None
    assert one(spark, C.first_non_zero(F.col("a"), F.lit(3.0)), a=0.0) == 3.0
    assert one(spark, S.quadrant(F.col("a"), F.lit("Neutral")), a=100.0) == "Q2"
    assert one(spark, S.strength_multiplier(none, none, F.lit("ACC")), a=1.0) == 1.0
    assert abs(one(spark, S.strength_multiplier(F.col("a"), F.lit(20.0), F.lit("ACC")), a=12.0) - 1.35) < 1e-12


def test_dates_and_records(spark):
    assert str(one(spark, T.game_date(F.col("a")), a="2024-11-05T00:30Z")) == "2024-11-05"
    assert one(spark, T.game_date(F.col("a")), a="soon") is None
    assert one(spark, T.days_from_november(F.to_date(F.col("a"))), a="2024-12-01") == 30
    assert one(spark, T.record_part(F.col("a"), 1), a=" 12-3 ") == 12
    assert one(spark, T.record_part(F.col("a"), 2), a="12-3-1") is None
    assert str(one(spark, T.through_date(F.col("a")), a="Through Games Mar. 15 2026")) == "2026-03-15"
    assert str(one(spark, T.us_date(F.col("a")), a="x 03/15/2026 y")) == "2026-03-15"
    assert T.header_name("Non-Div I") == "non_division_i" and T.header_name("Quad 1") == "q1"
    assert one(spark, S.season_label(F.col("a").cast("int")), a=2026.0) == "2025-26"


def test_folding_equals_full_decomposition(spark):
    from pyspark.sql import functions as F

    from tipoff.functions import text as T

    words = ["Ĳssel", "𝐀bc", "½ cup", "ﬁne", "Café", "Étude", "Straße", "™", "plain", None]
    rows = spark.createDataFrame([(w,) for w in words], "t string").select(
        T.normalize_text(F.col("t")).alias("a"), T.normalize_text(F.col("t"), True).alias("b")
    ).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows] and rows[0]["a"] == "ijssel" and rows[1]["a"] == "abc"


def test_both_foldings_agree_on_marks(spark):
    """Marks with a combining class go, those without one part words; plain and other letters in between."""
    import random
    import unicodedata

    rng = random.Random(6)
    marks = [chr(c) for c in range(0x250, 0x11FFF) if unicodedata.category(chr(c)).startswith("M")]
    texts = ["a\u0941b", "a\u034fb", "e\u0301", "ﬁ½"] + ["a" + m + "b" for m in marks]
    texts += ["".join(rng.choices([*marks[:200], *"abcé ßŁ漢ﬁ"], k=8)) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "a string")
    bad = df.where(~T.normalize_text(F.col("a")).eqNullSafe(T.normalize_text(F.col("a"), full_unicode=True))).collect()
    assert not bad
    assert df.limit(1).select(T.normalize_text(F.col("a"))).first()[0] == "a b"


def test_accents_of_a_long_text_with_ligatures(spark):
    """Only the characters that fold to several are looked up; the runs between them stay."""
    text = "ﬁne ½ œuvre é ﬀ" + " plain words żółć" * 200 + "ﬃ"
    assert one(spark, T.strip_accents(F.col("a")), a=text) == one(spark, T.strip_accents_full(F.col("a")), a=text)
    assert T._MARKS.startswith(T._BEYOND_ASCII) and T._MANY_CLASS.startswith(T._BEYOND_ASCII)
