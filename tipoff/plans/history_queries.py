"""Histories, ranks and peer statistics over customers and suppliers by year."""

from __future__ import annotations

from pyspark.sql import functions as F

from tipoff.operators import history as H
from tipoff.operators import ranking as R
from tipoff.operators.peers import schedule_environment
from tipoff.plans.registry import (
    CUSTOMER_YEAR_ROWS,
    CUSTOMER_YEARS,
    SUPPLIER_YEARS,
    customer_year_rows,
    customer_years,
    query,
    r6,
    supplier_years,
    table,
)


@query(
    "prior_history",
    f"""
WITH {CUSTOMER_YEAR_ROWS},
first_seen AS (SELECT entity, program, MIN(season) AS season FROM cyp GROUP BY 1, 2),
programs AS (
  SELECT c.entity, c.season, COUNT(f.program) AS prior_programs
  FROM (SELECT DISTINCT entity, season FROM cyp) c
  LEFT JOIN first_seen f ON f.entity = c.entity AND f.season < c.season GROUP BY 1, 2),
h AS (
  SELECT entity, season, program, spend,
    COUNT(*) OVER w AS prior_rows,
    AVG(spend) OVER w AS prior_avg, MAX(spend) OVER w AS prior_best, MIN(spend) OVER w AS prior_worst,
    AVG(CASE WHEN spend >= 200000 THEN 1.0 ELSE 0.0 END) OVER w AS prior_big_rate,
    CAST(SUM(n_orders) OVER w AS BIGINT) AS prior_orders,
    COUNT(*) OVER s AS same_rows, AVG(spend) OVER s AS same_avg, MAX(season) OVER w AS prior_last_season
  FROM cyp
  WINDOW w AS (PARTITION BY entity ORDER BY season RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         s AS (PARTITION BY entity, program ORDER BY season RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT h.entity, h.season, h.program, h.prior_rows, ROUND(h.prior_avg, 6) AS prior_avg, h.prior_best, h.prior_worst,
  ROUND(h.prior_big_rate, 6) AS prior_big_rate, COALESCE(h.prior_orders, 0) AS prior_orders,
  h.same_rows, ROUND(h.same_avg, 6) AS same_avg, h.same_rows = 0 AS first_year_here,
  h.season - h.prior_last_season AS prior_gap, p.prior_programs
FROM h JOIN programs p USING (entity, season)
""",
)
def prior_history(spark, folder):
    rows = customer_year_rows(spark, folder)
    spend = F.col("spend")
    stats = [
        H.Stat("prior_rows", "rows"),
        H.Stat("prior_avg", "mean", spend),
        H.Stat("prior_best", "max", spend),
        H.Stat("prior_worst", "min", spend),
        H.Stat("prior_big_rate", "rate", spend >= 200000),
        H.Stat("prior_orders", "sum", F.col("n_orders")),
        H.Stat("prior_last_season", "max", F.col("season")),
    ]
    prior = H.prior_stats(rows, ["entity"], "season", stats)
    same = H.prior_stats(
        rows, ["entity", "program"], "season", [H.Stat("same_rows", "rows"), H.Stat("same_avg", "mean", spend)]
    )
    programs = H.prior_distinct(rows, ["entity"], "season", "program", "prior_programs")
    by_season = prior.join(programs, ["entity", "season"])
    out = same.join(by_season, ["entity", "season"])
    return out.select(
        "entity",
        "season",
        "program",
        "prior_rows",
        F.round("prior_avg", 6).alias("prior_avg"),
        "prior_best",
        "prior_worst",
        r6("prior_big_rate").alias("prior_big_rate"),
        "prior_orders",
        "same_rows",
        F.round("same_avg", 6).alias("same_avg"),
        (F.col("same_rows") == 0).alias("first_year_here"),
        (F.col("season") - F.col("prior_last_season")).alias("prior_gap"),
        "prior_programs",
    )


@query(
    "prior_last_rows",
    f"""
WITH {CUSTOMER_YEAR_ROWS},
h AS (
  SELECT entity, season, program,
    LIST({{'s': season, 'p': program, 'v': spend}}) OVER w AS hist
  FROM cyp
  WINDOW w AS (PARTITION BY entity ORDER BY season RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sorted AS (SELECT DISTINCT entity, season, LIST_SORT(hist) AS hist FROM h)
SELECT entity, season,
  ROUND(LIST_AVG(LIST_TRANSFORM(LIST_SLICE(hist, -3, -1), lambda x: x.v)), 6) AS last3_avg,
  ROUND(LIST_AVG(LIST_TRANSFORM(LIST_SLICE(hist, -5, -1), lambda x: x.v)), 6) AS last5_avg,
  hist[-1].v AS last_spend, hist[-1].p AS last_program,
  ROUND(hist[-1].v - hist[-2].v, 2) AS one_row_change
FROM sorted
""",
)
def prior_last_rows(spark, folder):
    rows = customer_year_rows(spark, folder)
    last = H.prior_last_rows(rows, ["entity"], "season", ["program"], ["spend"], 5)
    end = H.from_end("last_rows")
    return last.select(
        "entity",
        "season",
        F.round(H.tail_mean("last_rows", "spend", 3), 6).alias("last3_avg"),
        F.round(H.tail_mean("last_rows", "spend", 5), 6).alias("last5_avg"),
        end["spend"].alias("last_spend"),
        end["program"].alias("last_program"),
        F.round(end["spend"] - H.from_end("last_rows", 2)["spend"], 2).alias("one_row_change"),
    )


@query(
    "latest_summary",
    f"""
WITH {CUSTOMER_YEAR_ROWS},
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY season DESC, program DESC) AS rn FROM cyp)
SELECT entity, COUNT(*) AS seasons, COUNT(DISTINCT program) AS programs, ROUND(AVG(spend), 6) AS avg_spend,
  MAX(spend) AS best_spend, MAX(CASE WHEN rn = 1 THEN season END) AS last_season,
  MAX(CASE WHEN rn = 1 THEN program END) AS last_program,
  ROUND(AVG(CASE WHEN rn <= 3 THEN spend END), 6) AS last3_avg
FROM ranked GROUP BY entity
""",
)
def latest_summary(spark, folder):
    rows = customer_year_rows(spark, folder)
    stats = [
        H.Stat("seasons", "rows"),
        H.Stat("avg_spend", "mean", F.col("spend")),
        H.Stat("best_spend", "max", F.col("spend")),
    ]
    totals = H.total_stats(rows, ["entity"], stats)
    programs = rows.groupBy("entity").agg(F.countDistinct("program").alias("programs"))
    last = H.last_rows(rows, ["entity"], ["season", "program"], ["spend"], 3)
    end = H.from_end("last_rows")
    return (
        totals.join(programs, "entity")
        .join(last, "entity")
        .select(
            "entity",
            "seasons",
            "programs",
            F.round("avg_spend", 6).alias("avg_spend"),
            "best_spend",
            end["season"].alias("last_season"),
            end["program"].alias("last_program"),
            F.round(H.tail_mean("last_rows", "spend", 3), 6).alias("last3_avg"),
        )
    )


@query(
    "season_grid",
    f"""
WITH {SUPPLIER_YEARS},
firsts AS (SELECT entity, MIN(season) AS f FROM sy GROUP BY 1),
grid AS (
  SELECT entity, CAST(UNNEST(GENERATE_SERIES(f + 1, (SELECT MAX(season) + 1 FROM sy))) AS INTEGER) AS season
  FROM firsts)
SELECT g.entity, g.season, COUNT(*) AS prior_seasons, ROUND(AVG(s.revenue), 6) AS prior_avg,
  MAX(s.revenue) AS prior_best, ARG_MAX(s.revenue, s.season) AS prior_last,
  ROUND(ARG_MAX(s.revenue, s.season)
    - LIST_SORT(LIST({{'a': s.season, 'b': s.revenue}}))[-2].b, 2) AS one_year_change
FROM grid g JOIN sy s ON s.entity = g.entity AND s.season < g.season
GROUP BY 1, 2
""",
)
def season_grid(spark, folder):
    rows = supplier_years(spark, folder)
    grid = H.season_grid(rows, ["entity"], "season")
    stats = [
        H.Stat("prior_seasons", "rows"),
        H.Stat("prior_avg", "mean", F.col("revenue")),
        H.Stat("prior_best", "max", F.col("revenue")),
    ]
    prior = H.prior_stats(rows, ["entity"], "season", stats, grid)
    last = H.prior_last_rows(rows, ["entity"], "season", ["season"], ["revenue"], 2, grid=grid)
    end, before = H.from_end("last_rows"), H.from_end("last_rows", 2)
    return prior.join(last, ["entity", "season"]).select(
        "entity",
        "season",
        "prior_seasons",
        F.round("prior_avg", 6).alias("prior_avg"),
        "prior_best",
        end["revenue"].alias("prior_last"),
        F.round(end["revenue"] - before["revenue"], 2).alias("one_year_change"),
    )


@query(
    "tenure",
    """
WITH yearly AS (
  SELECT o_custkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS season, MAX(o_orderstatus) AS person
  FROM orders GROUP BY 1, 2),
runs AS (
  SELECT *, season - ROW_NUMBER() OVER (PARTITION BY entity, person ORDER BY season) AS run FROM yearly),
islands AS (SELECT entity, person, run, COUNT(*) AS tenure, MAX(season) AS season FROM runs GROUP BY 1, 2, 3)
SELECT entity, person, season, tenure FROM islands i
WHERE season = (SELECT MAX(season) FROM yearly y WHERE y.entity = i.entity)
""",
)
def tenure(spark, folder):
    rows = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("season"), F.col("o_orderstatus").alias("person")
    )
    return H.current_tenure(rows, "entity", "season", "person").select("entity", "person", "season", "tenure")


@query(
    "season_lag_record",
    """
WITH games AS (
  SELECT l_suppkey AS entity, CAST(year(l_shipdate) AS INTEGER) AS season,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS upset, l_quantity - 25 AS margin
  FROM lineitem),
h AS (
  SELECT DISTINCT entity, season, COUNT(*) OVER w AS games, AVG(upset) OVER w AS upset_rate,
    AVG(CASE WHEN margin >= -10 THEN 1.0 ELSE 0.0 END) OVER w AS close_rate,
    AVG(margin) OVER w AS avg_margin
  FROM games
  WINDOW w AS (PARTITION BY entity ORDER BY season RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT entity, season, games, ROUND(LN(1 + games), 6) AS games_log, ROUND(upset_rate, 6) AS upset_rate,
  ROUND(close_rate, 6) AS close_rate, ROUND(avg_margin, 6) AS avg_margin FROM h
""",
)
def season_lag_record(spark, folder):
    games = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("entity"),
        F.year("l_shipdate").alias("season"),
        (F.col("l_returnflag") == "R").alias("upset"),
        (F.col("l_quantity") - 25).alias("margin"),
    )
    stats = [
        H.Stat("games", "rows"),
        H.Stat("upset_rate", "rate", F.col("upset")),
        H.Stat("close_rate", "rate", F.col("margin") >= -10),
        H.Stat("avg_margin", "mean", F.col("margin")),
    ]
    out = H.prior_stats(games, ["entity"], "season", stats)
    return out.select(
        "entity", "season", "games", r6(F.log1p("games")).alias("games_log"), r6("upset_rate").alias("upset_rate"),
        r6("close_rate").alias("close_rate"), r6("avg_margin").alias("avg_margin"),
    )


@query(
    "leave_one_out",
    f"""
WITH {CUSTOMER_YEARS},
x AS (SELECT cy.season, c.c_nationkey AS grp, cy.entity, FLOOR(cy.spend) AS spend FROM cy JOIN customer c ON c.c_custkey = cy.entity),
national AS (SELECT season, AVG(spend) AS m FROM x GROUP BY 1),
p AS (
  SELECT a.season, a.grp, a.entity, COUNT(b.spend) AS n, AVG(b.spend) AS peer_mean, MEDIAN(b.spend) AS peer_median,
    MAX(b.spend) AS peer_best, LIST_REVERSE_SORT(LIST(b.spend) FILTER (b.spend IS NOT NULL)) AS tops,
    AVG(CASE WHEN b.spend IS NULL THEN NULL WHEN b.spend >= 500000 THEN 1.0 ELSE 0.0 END) AS peer_big_share
  FROM x a LEFT JOIN x b ON a.season = b.season AND a.grp = b.grp AND a.entity <> b.entity
  GROUP BY 1, 2, 3)
SELECT p.season, p.grp, p.entity, CAST(n + 1 AS DOUBLE) AS league_size, ROUND(peer_mean, 6) AS peer_mean,
  peer_median, peer_best, ROUND(LIST_AVG(tops[1:3]), 6) AS peer_top3_mean, ROUND(LIST_AVG(tops[1:5]), 6) AS peer_top5_mean,
  ROUND(peer_big_share, 6) AS peer_big_share, ROUND(peer_mean - m, 6) AS minus_national,
  ROUND(CASE WHEN peer_mean IS NULL THEN m ELSE (0.67 * peer_mean + 0.33 * m) / (0.67 + 0.33) END, 6) AS two_thirds
FROM p JOIN national USING (season)
""",
)
def leave_one_out(spark, folder):
    cy = customer_years(spark, folder)
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("entity"), F.col("c_nationkey").cast("string").alias("grp")
    )
    whole = F.floor("spend").cast("double").alias("spend")
    rows = cy.join(customers, "entity").select("season", "grp", "entity", whole)
    out = schedule_environment(rows, "season", "grp", "spend", "entity", {"big": 500000.0}, prefix="env_")
    return out.select(
        "season",
        F.col("grp").cast("int").alias("grp"),
        "entity",
        F.col("env_league_size").alias("league_size"),
        F.round("env_peer_mean", 6).alias("peer_mean"),
        F.col("env_peer_median").alias("peer_median"),
        F.col("env_peer_best").alias("peer_best"),
        F.round("env_peer_top3_mean", 6).alias("peer_top3_mean"),
        F.round("env_peer_top5_mean", 6).alias("peer_top5_mean"),
        r6("env_peer_big_share").alias("peer_big_share"),
        F.round("env_peer_mean_minus_national", 6).alias("minus_national"),
        F.round("env_two_thirds_schedule_proxy", 6).alias("two_thirds"),
    )


@query(
    "season_percentiles",
    f"""
WITH {SUPPLIER_YEARS}
SELECT season, entity, revenue, n_lines,
  ROUND(PERCENT_RANK() OVER (PARTITION BY season ORDER BY revenue, entity), 6) AS revenue_percentile,
  ROUND(PERCENT_RANK() OVER (PARTITION BY season ORDER BY n_lines, entity), 6) AS n_lines_percentile,
  ROUND((PERCENT_RANK() OVER (PARTITION BY season ORDER BY revenue, entity)
    + PERCENT_RANK() OVER (PARTITION BY season ORDER BY n_lines, entity)) / 2, 6) AS production_percentile
FROM sy
""",
)
def season_percentiles(spark, folder):
    from tipoff.functions.scalar import mean_existing

    rows = supplier_years(spark, folder).drop("n_returned")
    out = R.ordinal_percentiles(rows, ["season"], ["entity"], ["revenue", "n_lines"])
    return out.select(
        "season",
        "entity",
        "revenue",
        "n_lines",
        r6("revenue_percentile").alias("revenue_percentile"),
        r6("n_lines_percentile").alias("n_lines_percentile"),
        r6(mean_existing("revenue_percentile", "n_lines_percentile")).alias("production_percentile"),
    )


@query(
    "ordinal_ranks",
    f"""
WITH {CUSTOMER_YEARS},
t AS (SELECT entity, CAST(SUM(CAST(spend AS DECIMAL(18,2))) AS DOUBLE) AS spend FROM cy GROUP BY 1)
SELECT entity, spend, ROW_NUMBER() OVER (ORDER BY spend DESC, entity) AS rank,
  ROUND(1 - (ROW_NUMBER() OVER (ORDER BY spend DESC, entity) - 1) / GREATEST(COUNT(*) OVER () - 1, 1), 6) AS percentile
FROM t
""",
)
def ordinal_ranks(spark, folder):
    from tipoff.functions.scalar import percentile_from_rank
    from tipoff.plans.registry import money

    rows = customer_years(spark, folder).groupBy("entity").agg(money("spend").alias("spend"))
    ranked = R.ordinal_rank(rows, [], [F.col("spend").desc(), F.col("entity")], "rank", "n")
    return ranked.select(
        "entity", "spend", "rank", r6(percentile_from_rank(F.col("rank"), F.col("n"))).alias("percentile")
    )


@query(
    "rating_curve",
    """
WITH s AS (SELECT s_suppkey, s_acctbal, ROW_NUMBER() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier),
n AS (SELECT MAX(place) AS n FROM s),
c AS (SELECT place, s_acctbal AS rating, COALESCE(LEAD(s_acctbal) OVER (ORDER BY place), s_acctbal) AS nxt FROM s),
q AS (SELECT c_custkey, c_acctbal,
        CASE WHEN c_acctbal IS NULL THEN NULL ELSE GREATEST(LEAST(c_acctbal / 97.0, n), 1.0) END AS at FROM customer, n)
SELECT c_custkey, ROUND(c.rating + (c.nxt - c.rating) * (q.at - FLOOR(q.at)), 2) AS rating_at_rank
FROM q LEFT JOIN c ON c.place = FLOOR(q.at)
""",
)
def rating_curve(spark, folder):
    curve = R.rating_curve(table(spark, folder, "supplier"), "s_acctbal", ["s_suppkey"])
    last = curve.count()
    asked = table(spark, folder, "customer").select("c_custkey", (F.col("c_acctbal") / 97.0).alias("rank"))
    return R.rating_at_rank(asked, "rank", curve, "rating_at_rank", last).select("c_custkey", "rating_at_rank")


@query(
    "medians",
    """
SELECT l_returnflag, l_linestatus, MEDIAN(l_quantity) AS l_quantity, MEDIAN(l_extendedprice) AS l_extendedprice,
  MEDIAN(l_discount) AS l_discount
FROM lineitem GROUP BY 1, 2
""",
)
def medians(spark, folder):
    return R.medians(
        table(spark, folder, "lineitem"),
        ["l_returnflag", "l_linestatus"],
        ["l_quantity", "l_extendedprice", "l_discount"],
    )


@query(
    "latest_per_key",
    """
SELECT user_id, CAST(ts AS DATE) AS day, event_id, event_type, value FROM events
QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1
""",
)
def latest_per_key(spark, folder):
    events = table(spark, folder, "events").withColumn("day", F.to_date("ts"))
    latest = R.latest_per_key(events, ["user_id", "day"], ["ts", "event_id"])
    return latest.select("user_id", "day", "event_id", "event_type", "value")
