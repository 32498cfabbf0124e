"""Casts, names, bands and row-wise formulas over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tipoff.functions import casts as C
from tipoff.functions import labels as L
from tipoff.functions import scalar as S
from tipoff.functions import text as T
from tipoff.operators.joins import prefixed
from tipoff.plans.registry import CUSTOMER_YEARS, customer_years, query, r6, table


@query(
    "safe_casts",
    """
WITH e AS (
  SELECT event_id, json_extract_string(props, '$.k') AS k,
    CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS kind,
    CASE event_id % 6 WHEN 0 THEN json_extract_string(props, '$.k') WHEN 1 THEN '' WHEN 2 THEN 'n/a'
      WHEN 3 THEN 'true' WHEN 4 THEN json_extract_string(props, '$.k') || '.5' ELSE '-' END AS raw
  FROM events),
n AS (SELECT *, CASE WHEN regexp_full_match(raw, '[0-9]+(\\.[0-9]+)?') THEN CAST(raw AS DOUBLE) END AS d FROM e)
SELECT event_id, d AS as_double, CASE WHEN raw = 'true' THEN 1.0 ELSE d END AS as_finite,
  CASE WHEN regexp_full_match(raw, '[0-9]+') THEN CAST(raw AS INTEGER) END AS as_int,
  CAST(TRUNC(d) AS INTEGER) AS as_int_via_double, COALESCE(d, 0) AS or_zero,
  raw IN ('true', '1') AS flag, COALESCE(NULLIF(kind, ''), NULLIF(raw, ''), k) AS first_text,
  CASE WHEN d IS NOT NULL AND d <> 0 THEN d ELSE CAST(k AS DOUBLE) END AS or_other
FROM n
""",
)
def safe_casts(spark, folder):
    k = F.get_json_object("props", "$.k")
    kind = F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))
    which = F.col("event_id") % 6
    raw = (
        F.when(which == 0, k).when(which == 1, "").when(which == 2, "n/a").when(which == 3, "true")
        .when(which == 4, F.concat(k, F.lit(".5"))).otherwise("-")
    )
    e = table(spark, folder, "events").select("event_id", k.alias("k"), kind.alias("kind"), raw.alias("raw"))
    return e.select(
        "event_id",
        C.to_double("raw").alias("as_double"),
        C.to_finite_double("raw").alias("as_finite"),
        C.to_int("raw").alias("as_int"),
        C.to_int_via_double("raw").alias("as_int_via_double"),
        C.double_or_zero("raw").alias("or_zero"),
        C.is_true("raw").alias("flag"),
        C.first_non_empty("kind", "raw", "k").alias("first_text"),
        C.first_non_zero(C.to_double("raw"), C.to_double("k")).alias("or_other"),
    )


@query(
    "canonical_names",
    r"""
WITH n AS (
  SELECT doc_id, trim(regexp_replace(replace(lower(strip_accents(text)), '&', ' and '), '[''`]', '', 'g')) AS t
  FROM documents),
w AS (SELECT doc_id, trim(regexp_replace(t, '[^a-z0-9]+', ' ', 'g')) AS words FROM n)
SELECT doc_id, md5(words) AS words_md5, length(words) AS size FROM w
""",
)
def canonical_names(spark, folder):
    docs = table(spark, folder, "documents")
    words = T.normalize_text(F.col("text"))
    return docs.select("doc_id", F.md5(words).alias("words_md5"), F.length(words).alias("size"))


@query(
    "entity_keys",
    """
WITH n AS (
  SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'St ' || p_name WHEN p_partkey % 3 = 1 THEN p_name || ' St.'
    ELSE upper(p_name) || ' AQ' END AS name FROM part),
w AS (SELECT *, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS t FROM n),
a AS (SELECT *, trim(regexp_replace(t, '\\baq$', '')) AS t1 FROM w),
b AS (SELECT *, regexp_replace(regexp_replace(t1, '^st\\s+', 'saint '), '\\bst$', 'state') AS key FROM a)
SELECT p_partkey, key, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS compact,
  replace(lower(trim(name)), '.', '') AS light
FROM b
""",
)
def entity_keys(spark, folder):
    third = F.col("p_partkey") % 3
    name = (
        F.when(third == 0, F.concat(F.lit("St "), "p_name"))
        .when(third == 1, F.concat("p_name", F.lit(" St.")))
        .otherwise(F.concat(F.upper("p_name"), F.lit(" AQ")))
    )
    parts = table(spark, folder, "part").select("p_partkey", name.alias("name"))
    return parts.select(
        "p_partkey",
        T.team_key(F.col("name")).alias("key"),
        T.compact_name(F.col("name")).alias("compact"),
        T.light_name(F.col("name")).alias("light"),
    )


@query(
    "person_names",
    """
WITH n AS (
  SELECT s_suppkey, 'Coach Bill ' || s_name || ' Jr. (interim)' AS a, 'Billy ' || s_name AS b,
    CASE WHEN s_suppkey % 4 = 0 THEN 'TBD' ELSE s_name END AS c FROM supplier)
SELECT s_suppkey, 'bill supplier ' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || ' jr' AS coach,
  'coach bill supplier ' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || ' interim' AS player,
  CASE WHEN s_suppkey % 4 = 0 THEN TRUE ELSE FALSE END AS unknown,
  'fuzzy' AS ab_match, TRUE AS ab_same, 'exact_normalized' AS aa_match,
  ['bill supplier ' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || ' jr', 'bill jr', 'billy jr', 'william jr'] AS keys
FROM n
""",
)
def person_names(spark, folder):
    rows = table(spark, folder, "supplier").select(
        "s_suppkey",
        F.concat(F.lit("Coach Bill "), "s_name", F.lit(" Jr. (interim)")).alias("a"),
        F.concat(F.lit("Billy "), "s_name").alias("b"),
        F.when(F.col("s_suppkey") % 4 == 0, "TBD").otherwise(F.col("s_name")).alias("c"),
    )
    rows = T.with_name_match(rows, "a", "b", "ab_match")
    rows = T.with_name_match(rows, "a", "a", "aa_match")
    return rows.select(
        "s_suppkey",
        T.coach_name(F.col("a")).alias("coach"),
        T.player_key(F.col("a")).alias("player"),
        T.is_unknown_coach(F.col("c")).alias("unknown"),
        "ab_match",
        T.is_name_match(F.col("ab_match")).alias("ab_same"),
        "aa_match",
        T.name_keys(F.col("a")).alias("keys"),
    )


@query(
    "rank_bands",
    f"""
WITH {CUSTOMER_YEARS},
r AS (SELECT season, entity, ROW_NUMBER() OVER (PARTITION BY season ORDER BY spend DESC, entity) AS rank FROM cy),
p AS (SELECT *, rank % 97 / 600.0 AS risk,
  CASE WHEN rank <= 25 THEN 10 WHEN rank <= 50 THEN 9 WHEN rank <= 75 THEN 8 WHEN rank <= 100 THEN 7
       WHEN rank <= 135 THEN 6 WHEN rank <= 160 THEN 5 WHEN rank <= 200 THEN 4 WHEN rank <= 250 THEN 3
       WHEN rank <= 300 THEN 2 ELSE 1 END AS value FROM r)
SELECT season, entity, rank, value,
  CASE WHEN rank <= 25 THEN 'top_25' WHEN rank <= 50 THEN '26_50' WHEN rank <= 75 THEN '51_75'
       WHEN rank <= 100 THEN '76_100' WHEN rank <= 135 THEN '101_135' WHEN rank <= 160 THEN '136_160'
       WHEN rank <= 200 THEN '161_200' WHEN rank <= 250 THEN '201_250' WHEN rank <= 300 THEN '251_300'
       ELSE '301_plus' END AS band,
  CASE WHEN rank <= 25 THEN 'top25' WHEN rank <= 50 THEN '26_50' WHEN rank <= 100 THEN '51_100'
       WHEN rank <= 150 THEN '101_150' WHEN rank <= 250 THEN '151_250' ELSE '251_plus' END AS recruit_bucket,
  CASE WHEN risk <= 0.05 THEN '0_05' WHEN risk <= 0.10 THEN '05_10' WHEN risk <= 0.15 THEN '10_15'
       WHEN risk <= 0.20 THEN '15_20' WHEN risk <= 0.25 THEN '20_25' ELSE '25_plus' END AS share_bucket,
  CASE WHEN risk >= 0.12 THEN 'very_high' WHEN risk >= 0.08 THEN 'high' WHEN risk >= 0.05 THEN 'medium'
       WHEN risk >= 0.03 THEN 'low' ELSE 'very_low' END AS risk_bucket,
  CASE WHEN risk >= 0.12 THEN 5 WHEN risk >= 0.08 THEN 4 WHEN risk >= 0.05 THEN 3
       WHEN risk >= 0.03 THEN 2 ELSE 1 END AS risk_order,
  CASE WHEN risk >= 0.10 AND value <= 6 THEN 'avoid_bad_risk_reward' WHEN risk >= 0.08 THEN 'avoid_unless_needed'
       WHEN value >= 5 AND risk < 0.05 THEN 'strong_target' WHEN value >= 4 AND risk < 0.07 THEN 'good_target'
       WHEN value <= 2 THEN 'low_value' ELSE 'monitor' END AS recommendation,
  CASE WHEN rank <= 30 THEN 'Q1' WHEN rank <= 75 THEN 'Q2' WHEN rank <= 160 THEN 'Q3' ELSE 'Q4' END AS home_quad,
  CASE WHEN rank <= 75 THEN 'Q1' WHEN rank <= 135 THEN 'Q2' WHEN rank <= 240 THEN 'Q3' ELSE 'Q4' END AS away_quad,
  ROUND((365 - LEAST(rank, 364)) / 364.0, 6) AS field_percentile
FROM p
""",
)
def rank_bands(spark, folder):
    from tipoff.operators.ranking import ordinal_rank

    ranked = ordinal_rank(customer_years(spark, folder), ["season"], [F.col("spend").desc(), F.col("entity")])
    rank, risk = F.col("rank"), F.col("rank") % 97 / 600.0
    value = L.schedule_value(rank)
    bucket = L.risk_bucket(risk)
    return ranked.select(
        "season",
        "entity",
        "rank",
        value.alias("value"),
        L.rank_band(rank).alias("band"),
        L.recruit_bucket(rank).alias("recruit_bucket"),
        L.transfer_bucket(risk).alias("share_bucket"),
        bucket.alias("risk_bucket"),
        L.risk_order(bucket).alias("risk_order"),
        L.recommendation(value, risk).alias("recommendation"),
        S.quadrant(rank, F.lit("Home")).alias("home_quad"),
        S.quadrant(rank, F.lit("Away")).alias("away_quad"),
        r6(S.field_percentile(rank)).alias("field_percentile"),
    )


@query(
    "program_bands",
    f"""
WITH {CUSTOMER_YEARS},
r AS (SELECT season, entity, ROW_NUMBER() OVER (PARTITION BY season ORDER BY spend DESC, entity) AS rank FROM cy),
h AS (
  SELECT season, entity, MAX_BY(rank, season) OVER w AS last_rank,
    AVG(CASE WHEN rank <= 25 THEN 1.0 ELSE 0 END) OVER w AS t25, AVG(CASE WHEN rank <= 50 THEN 1.0 ELSE 0 END) OVER w AS t50,
    AVG(CASE WHEN rank <= 75 THEN 1.0 ELSE 0 END) OVER w AS t75, AVG(CASE WHEN rank <= 100 THEN 1.0 ELSE 0 END) OVER w AS t100,
    AVG(CASE WHEN rank <= 135 THEN 1.0 ELSE 0 END) OVER w AS t135
  FROM r WINDOW w AS (PARTITION BY entity ORDER BY season RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT season, entity, CASE WHEN last_rank IS NULL THEN '301_plus'
  WHEN last_rank <= 25 AND t25 >= 0.5 THEN 'top_25' WHEN last_rank <= 50 AND t50 >= 0.5 THEN '26_50'
  WHEN last_rank <= 75 AND t75 >= 0.4 THEN '51_75' WHEN last_rank <= 100 AND t100 >= 0.4 THEN '76_100'
  WHEN last_rank <= 135 AND t135 >= 0.4 THEN '101_135' WHEN last_rank <= 160 THEN '136_160'
  WHEN last_rank <= 200 THEN '161_200' WHEN last_rank <= 250 THEN '201_250' WHEN last_rank <= 300 THEN '251_300'
  ELSE '301_plus' END AS consistency_band
FROM h
""",
)
def program_bands(spark, folder):
    from tipoff.operators.history import Stat, from_end, prior_last_rows, prior_stats
    from tipoff.operators.ranking import ordinal_rank

    ranked = ordinal_rank(customer_years(spark, folder), ["season"], [F.col("spend").desc(), F.col("entity")])
    rates = [Stat(f"t{n}", "rate", F.col("rank") <= n) for n in (25, 50, 75, 100, 135)]
    prior = prior_stats(ranked, ["entity"], "season", rates)
    last = prior_last_rows(ranked, ["entity"], "season", ["season"], ["rank"], 1)
    joined = prior.join(last, ["entity", "season"])
    band = L.consistency_band(
        from_end("last_rows")["rank"], {n: F.col(f"t{n}") for n in (25, 50, 75, 100, 135)}, F.lit(None).cast("double")
    )
    return joined.select("season", "entity", band.alias("consistency_band"))


@query(
    "null_skipping",
    """
WITH x AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_shipdate,
    CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_discount END AS a,
    CASE WHEN l_linestatus = 'F' THEN NULL ELSE l_tax END AS b, l_quantity / 50.0 AS c FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_shipdate AS DATE) AS l_shipdate, l_quantity,
  ROUND((COALESCE(a, 0) + COALESCE(b, 0) + c) / ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + 1), 6) AS mean_existing,
  ROUND(CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE COALESCE(a, 0) + COALESCE(b, 0) END, 6) AS sum_existing,
  ROUND(CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE (COALESCE(a, 0) * 0.67 + COALESCE(b, 0) * 0.33)
    / (CASE WHEN a IS NULL THEN 0 ELSE 0.67 END + CASE WHEN b IS NULL THEN 0 ELSE 0.33 END) END, 6) AS weighted,
  ROUND(a * b, 6) AS product, ROUND(a - b, 6) AS difference, CASE WHEN a IS NOT NULL THEN GREATEST(LEAST(a, 0.05), 0.02) END AS clipped,
  ROUND(GREATEST(LEAST(c * SQRT(CASE WHEN b IS NULL THEN 1.0 ELSE GREATEST(LEAST(b * 20, 1.35), 0.65) END), 0.35), 0.0), 6)
    AS adjusted_share,
  ROUND(GREATEST(LEAST(c / 0.08, 1.5), 0.0), 6) AS role_fill
FROM x
""",
)
def null_skipping(spark, folder):
    x = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.to_date("l_shipdate").alias("l_shipdate"), "l_quantity",
        F.when(F.col("l_returnflag") != "R", F.col("l_discount")).alias("a"),
        F.when(F.col("l_linestatus") != "F", F.col("l_tax")).alias("b"),
        (F.col("l_quantity") / 50.0).alias("c"),
    )
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return x.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_quantity",
        r6(S.mean_existing(a, b, c)).alias("mean_existing"),
        r6(S.sum_existing(a, b)).alias("sum_existing"),
        r6(S.weighted_mean_existing((a, 0.67), (b, 0.33))).alias("weighted"),
        r6(a * b).alias("product"),
        r6(a - b).alias("difference"),
        S.clip(a, 0.02, 0.05).alias("clipped"),
        r6(S.adjusted_source_share(c, b * 20)).alias("adjusted_share"),
        r6(S.role_fill(c)).alias("role_fill"),
    )


@query(
    "win_probability",
    """
WITH g AS (
  SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, c.c_acctbal / 400.0 AS own, s.s_acctbal / 400.0 AS other,
    CASE l.l_linenumber % 3 WHEN 0 THEN 'Home' WHEN 1 THEN 'Neutral' ELSE 'Away' END AS site, l.l_quantity, l.l_shipdate
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
    JOIN supplier s ON s.s_suppkey = l.l_suppkey),
p AS (SELECT *, CASE site WHEN 'Home' THEN 3.5 WHEN 'Away' THEN -3.5 ELSE 0 END AS adj FROM g)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, CAST(l_shipdate AS DATE) AS l_shipdate, site,
  ROUND(1 / (1 + POW(2.718281828, -((own + adj - other) / 6.5))), 6) AS p_win,
  ROUND(1 - 1 / (1 + POW(2.718281828, -((16.0 + adj - other) / 6.5))), 6) AS win_value
FROM p
""",
)
def win_probability(spark, folder):
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, folder, "customer").select("c_custkey", (F.col("c_acctbal") / 400.0).alias("own"))
    suppliers = table(spark, folder, "supplier").select("s_suppkey", (F.col("s_acctbal") / 400.0).alias("other"))
    third = F.col("l_linenumber") % 3
    site = F.when(third == 0, "Home").when(third == 1, "Neutral").otherwise("Away")
    games = (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .withColumn("site", site)
    )
    return games.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        F.to_date("l_shipdate").alias("l_shipdate"), "site",
        r6(S.win_probability(F.col("own"), F.col("other"), F.col("site"))).alias("p_win"),
        r6(1 - S.win_probability(F.lit(16.0), F.col("other"), F.col("site"))).alias("win_value"),
    )


@query(
    "strength_multiplier",
    """
WITH s AS (
  SELECT s.s_suppkey, s.s_acctbal / 300.0 - 5 AS em, ROW_NUMBER() OVER (ORDER BY s_acctbal DESC, s_suppkey) * 4 AS rank,
    CASE WHEN n_regionkey = 1 THEN 'ACC' ELSE 'OTHER' END AS conf
  FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey)
SELECT s_suppkey, rank, ROUND(GREATEST(LEAST(1 + em / 60 + CASE WHEN conf = 'ACC' THEN 0.05 ELSE 0 END
  + CASE WHEN rank <= 25 THEN 0.10 WHEN rank <= 50 THEN 0.06 WHEN rank <= 100 THEN 0.03 WHEN rank >= 300 THEN -0.12
      WHEN rank >= 250 THEN -0.08 WHEN rank >= 200 THEN -0.04 ELSE 0 END, 1.45), 0.55), 6) AS multiplier,
  ROUND(GREATEST(LEAST((401 - rank) / 400.0, 1), 0), 6) AS recruit_percentile
FROM s
""",
)
def strength_multiplier(spark, folder):
    from tipoff.operators.ranking import ordinal_rank

    suppliers = table(spark, folder, "supplier")
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    ranked = ordinal_rank(suppliers.join(nations, "s_nationkey"), [], [F.col("s_acctbal").desc(), F.col("s_suppkey")], "place")
    conf = F.when(F.col("n_regionkey") == 1, "ACC").otherwise("OTHER")
    rank = F.col("place") * 4
    none = F.lit(None).cast("double")
    return ranked.select(
        "s_suppkey",
        rank.alias("rank"),
        r6(S.strength_multiplier(F.col("s_acctbal") / 300.0 - 5, rank, conf)).alias("multiplier"),
        r6(S.recruit_percentile(rank.cast("double"), none, none)).alias("recruit_percentile"),
    )


@query(
    "roster_status",
    """
WITH l AS (
  SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS team_id,
    CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey AS VARCHAR) WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0
      THEN CAST(o_custkey + 1 AS VARCHAR) ELSE '' END AS next_id,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'Yes' ELSE 'no' END AS portal,
    CASE WHEN o_orderpriority = '2-HIGH' THEN '1' ELSE '' END AS draft,
    CASE WHEN o_orderpriority = '5-LOW' THEN 'Grad Transfer' ELSE 'Freshman' END AS cls,
    ['PG', 'sg', 'C', 'F', 'SF'][1 + o_orderkey % 5] AS pos
  FROM orders)
SELECT o_orderkey, CASE WHEN next_id <> '' AND next_id = team_id THEN 'confirmed_returning_same_team'
  WHEN next_id <> '' THEN 'transferred_out_committed' WHEN portal = 'Yes' THEN 'in_portal_uncommitted_or_pending'
  WHEN draft = '1' THEN 'draft_prospect_review' WHEN cls = 'Grad Transfer' THEN 'senior_eligibility_review'
  ELSE 'probable_returner' END AS status,
  CASE pos WHEN 'PG' THEN 'pg' WHEN 'sg' THEN 'guard' WHEN 'C' THEN 'big' WHEN 'F' THEN 'forward' ELSE 'wing' END AS position
FROM l
""",
)
def roster_status(spark, folder):
    o = table(spark, folder, "orders")
    team = F.col("o_custkey").cast("string")
    following = (
        F.when(F.col("o_orderstatus") == "F", team)
        .when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 2 == 0), (F.col("o_custkey") + 1).cast("string"))
        .otherwise("")
    )
    priority = F.col("o_orderpriority")
    position = F.element_at(F.array(*[F.lit(p) for p in ("PG", "sg", "C", "F", "SF")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return o.select(
        "o_orderkey",
        L.roster_status(
            team, following, F.when(priority == "1-URGENT", "Yes").otherwise("no"), F.lit(None).cast("string"),
            F.when(priority == "2-HIGH", "1").otherwise(""),
            F.when(priority == "5-LOW", "Grad Transfer").otherwise("Freshman"),
        ).alias("status"),
        L.position_class(position).alias("position"),
    )


@query(
    "game_days",
    """
WITH d AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT19:30:00Z') AS raw FROM orders),
p AS (SELECT *, CAST(raw[1:10] AS DATE) AS day FROM d)
SELECT o_orderkey, day, date_diff('day', make_date(year(day), 11, 1), day) AS days_from_november,
  month(day) IN (11, 12) AS early, CAST(year(day) - 1 AS VARCHAR) || '-' || right(CAST(year(day) AS VARCHAR), 2) AS season_label
FROM p
""",
)
def game_days(spark, folder):
    raw = F.date_format("o_orderdate", "yyyy-MM-dd'T19:30:00Z'")
    day = T.game_date(raw)
    return table(spark, folder, "orders").select(
        "o_orderkey",
        day.alias("day"),
        T.days_from_november(day).cast("long").alias("days_from_november"),
        F.month(day).isin(11, 12).alias("early"),
        S.season_label(F.year(day)).alias("season_label"),
    )


@query(
    "record_parts",
    """
WITH c AS (SELECT o_custkey AS entity, COUNT(*) FILTER (o_orderstatus = 'F') AS w, COUNT(*) FILTER (o_orderstatus <> 'F') AS l
  FROM orders GROUP BY 1)
SELECT entity, CASE WHEN w > 0 THEN CAST(w AS INTEGER) END AS record_wins, CASE WHEN w > 0 THEN CAST(l AS INTEGER) END AS record_losses,
  CASE WHEN w > 0 THEN CAST(w AS INTEGER) END AS dash_int
FROM c
""",
)
def record_parts(spark, folder):
    c = (
        table(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("entity"))
        .agg(F.count_if(F.col("o_orderstatus") == "F").alias("w"), F.count_if(F.col("o_orderstatus") != "F").alias("l"))
        .select(
            "entity",
            F.when(F.col("w") > 0, F.concat_ws("-", "w", "l")).otherwise("none").alias("record"),
            F.when(F.col("w") > 0, F.col("w").cast("string")).otherwise("--").alias("cell"),
        )
    )
    return T.with_record_parts(c, ["record"]).select(
        "entity", "record_wins", "record_losses", C.dash_int("cell").alias("dash_int")
    )


@query(
    "board_search",
    """
SELECT s_suppkey, s_name, n_name, ROUND(s_acctbal, 1) AS balance,
  'Tier ' || replace(CASE WHEN s_acctbal > 5000 THEN 'top_half' ELSE 'low_half' END, '_', '-') AS tier
FROM supplier JOIN nation ON n_nationkey = s_nationkey
WHERE contains(lower(s_name || ' ' || n_name), 'nation_1') AND n_name IN ('NATION_1', 'NATION_10', 'NATION_11', 'NATION_12')
""",
)
def board_search(spark, folder):
    from tipoff.plans.planner import search_board

    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    board = table(spark, folder, "supplier").join(nations, "s_nationkey")
    found = search_board(
        board, "NATION_1", ["s_name", "n_name"],
        {"n_name": ["NATION_1", "NATION_10", "NATION_11", "NATION_12"]}, "s_acctbal", "s_suppkey", descending=True,
    )
    tier = L.tier_label(F.when(F.col("s_acctbal") > 5000, "top_half").otherwise("low_half"))
    return found.select(
        "s_suppkey", "s_name", "n_name", S.compact(F.col("s_acctbal"), 1).alias("balance"),
        F.concat(F.lit("Tier "), tier).alias("tier"),
    )


@query(
    "prefixed_columns",
    "SELECT s_suppkey AS key, s_name AS src_s_name, s_acctbal AS src_s_acctbal FROM supplier",
)
def prefixed_columns(spark, folder):
    rows = table(spark, folder, "supplier").withColumnRenamed("s_suppkey", "key")
    return prefixed(rows, "src_", keep=["key"], drop=["s_nationkey"])


@query(
    "display_labels",
    """
SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'Top 25' WHEN 1 THEN '301+' ELSE '26-50' END AS tier,
  CASE WHEN n_nationkey % 2 = 0 THEN 'WVU' ELSE n_name || ' HS' END AS source
FROM nation
""",
)
def display_labels(spark, folder):
    third = F.col("n_nationkey") % 3
    band = F.when(third == 0, "top_25").when(third == 1, "301_plus").otherwise("26_50")
    source = F.when(F.col("n_nationkey") % 2 == 0, "West Virginia").otherwise(F.concat("n_name", F.lit(" High  School")))
    source = F.regexp_replace(source, "  ", " ")
    return table(spark, folder, "nation").select(
        "n_nationkey", L.tier_label(band).alias("tier"), T.short_source_label(source).alias("source")
    )
