"""Summaries, calibration tables and evaluation metrics over lines, orders and labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tipoff.functions import labels as L
from tipoff.operators import aggregates as A
from tipoff.operators import metrics as M
from tipoff.operators import ranking as R
from tipoff.operators.linear import fit_least_squares
from tipoff.plans.registry import CUSTOMER_YEARS, SUPPLIER_YEARS, customer_years, query, r6, supplier_years, table



def _lines(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("team"),
        F.col("l_returnflag").alias("status"),
        F.col("l_quantity").alias("minutes"),
        F.floor("l_extendedprice").cast("double").alias("points"),
        F.when(F.col("l_linestatus") == "O", F.round(F.col("l_discount") * 100)).alias("usage"),
        F.round(F.col("l_tax") * 100).alias("per"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("player"),
    )


_LINES = """
lines AS (
  SELECT l_suppkey AS team, l_returnflag AS status, l_quantity AS minutes, FLOOR(l_extendedprice) AS points,
    CASE WHEN l_linestatus = 'O' THEN ROUND(l_discount * 100) END AS usage, ROUND(l_tax * 100) AS per,
    l_orderkey || '-' || l_linenumber || '-' || l_partkey AS player
  FROM lineitem)"""

_STATUS_COLUMNS = ", ".join(
    f"""COUNT(*) FILTER (status = '{s}') AS {s.lower()}_players, COALESCE(SUM(minutes) FILTER (status = '{s}'), 0) AS {s.lower()}_minutes,
  ROUND(COALESCE(SUM(minutes) FILTER (status = '{s}'), 0) / NULLIF(SUM(minutes), 0), 6) AS {s.lower()}_minutes_pct"""
    for s in ("A", "N", "R")
)


@query(
    "status_summary",
    f"""
WITH {_LINES}
SELECT team, COUNT(*) AS players, SUM(minutes) AS total_minutes, SUM(points) AS total_points, {_STATUS_COLUMNS},
  COUNT(*) FILTER (status <> 'R') AS kept_players, SUM(points) FILTER (status <> 'R') AS kept_points,
  ROUND(SUM(points) FILTER (status <> 'R') / SUM(points), 6) AS kept_points_pct,
  ROUND(SUM(COALESCE(usage, 0) * minutes) FILTER (status <> 'R') / SUM(minutes) FILTER (status <> 'R'), 6)
    AS kept_minutes_weighted_usage,
  ROUND(SUM(per * minutes) FILTER (status <> 'R') / SUM(minutes) FILTER (status <> 'R'), 6) AS kept_minutes_weighted_per,
  COUNT(*) FILTER (status <> 'R' AND minutes >= 40 AND per >= 5) AS kept_strong_players,
  ROUND(SUM(COALESCE(usage, 0) * minutes) FILTER (status <> 'R') / SUM(minutes) FILTER (status <> 'R')
   - SUM(per * minutes) FILTER (status <> 'R') / SUM(minutes) FILTER (status <> 'R'), 6) AS kept_minutes_weighted_net
FROM lines GROUP BY team
""",
)
def status_summary(spark, folder):
    out = A.status_summary(
        _lines(spark, folder),
        ["team"],
        statuses=("A", "N", "R"),
        groups={"kept": ("A", "N")},
        counting=("points",),
        rates=("usage", "per"),
        status_stats=("minutes",),
        totals=("minutes", "points"),
        flags={"strong_players": (F.col("minutes") >= 40) & (F.col("per") >= 5)},
        net=("net", "usage", "per"),
    )
    lower = {c: c.lower() for c in out.columns if c[:2] in ("A_", "N_", "R_")}
    rounded = [
        (r6(c) if c.endswith("_pct") or "weighted" in c else F.col(c)).alias(lower.get(c, c)) for c in out.columns
    ]
    return out.select(*rounded)


@query(
    "weighted_means",
    f"""
WITH {_LINES}
SELECT team, status, ROUND(SUM(usage * minutes) / SUM(minutes) FILTER (usage IS NOT NULL), 6) AS skip_null,
  ROUND(SUM(COALESCE(usage, 0) * minutes) / SUM(minutes), 6) AS null_as_zero
FROM lines GROUP BY 1, 2
""",
)
def weighted_means(spark, folder):
    usage, minutes = F.col("usage"), F.col("minutes")
    return (
        _lines(spark, folder)
        .groupBy("team", "status")
        .agg(
            r6(A.weighted_mean(usage, minutes)).alias("skip_null"),
            r6(A.weighted_mean(usage, minutes, null_as_zero=True)).alias("null_as_zero"),
        )
    )


def _core_sql() -> str:
    parts = []
    for m in ("minutes", "points"):
        for k in (3, 7):
            mine = f"measure = '{m}' AND rn <= {k}"
            parts.append(f"COUNT(*) FILTER ({mine} AND back) AS returning_top_{k}_{m}_players")
            parts.append(
                f"ROUND(COALESCE(SUM(v) FILTER ({mine} AND back), 0) / SUM(v) FILTER ({mine}), 6) AS returning_top_{k}_{m}_share"
            )
    return ", ".join(parts)


@query(
    "core_shares",
    f"""
WITH {_LINES},
long AS (SELECT team, player, status <> 'R' AS back, 'minutes' AS measure, minutes AS v FROM lines
  UNION ALL SELECT team, player, status <> 'R', 'points', points FROM lines),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY team, measure ORDER BY v DESC, player) AS rn FROM long),
tot AS (SELECT team, SUM(minutes) AS total FROM lines GROUP BY 1)
SELECT team, {_core_sql()},
  ROUND(COALESCE(SUM(v) FILTER (measure = 'minutes' AND rn <= 7 AND back), 0) / MAX(total), 6)
    AS expected_returning_top_7_minutes_roster_share
FROM r JOIN tot USING (team) GROUP BY team
""",
)
def core_shares(spark, folder):
    out = A.core_shares(
        _lines(spark, folder), ["team"], "player", F.col("status") != "R", measures=("minutes", "points"), cutoffs=(3, 7)
    )
    return out.select(*[(r6(c) if c.endswith("share") else F.col(c)).alias(c) for c in out.columns])


@query(
    "floor_totals",
    """
SELECT c_nationkey, SUM(GREATEST(FLOOR(c_acctbal), 0)) AS total, ARG_MAX(c_custkey, FLOOR(c_acctbal) * 1000000 - c_custkey) AS best_custkey
FROM customer GROUP BY 1
""",
)
def floor_totals(spark, folder):
    rows = table(spark, folder, "customer").withColumn("balance", F.floor("c_acctbal").cast("double"))
    totals = A.floor_total(rows, ["c_nationkey"], "balance", "total")
    best = A.greatest_row(rows, ["c_nationkey"], "balance", [-F.col("c_custkey")])
    return totals.join(best.select("c_nationkey", F.col("c_custkey").alias("best_custkey")), "c_nationkey")


@query(
    "class_summary",
    """
WITH p AS (
  SELECT s.s_nationkey AS team, p.p_partkey, p.p_name AS name, CAST(p.p_partkey % 450 AS DOUBLE) AS rank, CAST(p.p_size AS DOUBLE) AS rating,
    ['pg', 'guard', 'wing', 'forward', 'big'][1 + p.p_size % 5] AS position
  FROM part p JOIN supplier s ON s.s_suppkey = p.p_partkey % (SELECT COUNT(*) FROM supplier)),
q AS (SELECT *, CASE WHEN rank > 0 THEN GREATEST(LEAST((401 - rank) / 400.0, 1), 0) ELSE rating / 100.0 END AS pct FROM p),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY team ORDER BY pct DESC, CASE WHEN rank = 0 THEN 9999 ELSE rank END, name) AS rn FROM q),
w AS (SELECT *, CASE rn WHEN 1 THEN 1.0 WHEN 2 THEN 0.8 WHEN 3 THEN 0.65 WHEN 4 THEN 0.5 WHEN 5 THEN 0.4 WHEN 6 THEN 0.3 ELSE 0.25 END AS w FROM r)
SELECT team, COUNT(*) AS class_count, COUNT(*) FILTER (rank > 0 AND rank <= 25) AS class_top_25_count,
  COUNT(*) FILTER (rank > 0 AND rank <= 50) AS class_top_50_count, COUNT(*) FILTER (rank > 0 AND rank <= 100) AS class_top_100_count,
  ROUND(AVG(rating), 9) AS class_avg_rating, COUNT(*) FILTER (position = 'pg') AS class_pg_count,
  COUNT(*) FILTER (position IN ('pg', 'guard')) AS class_guard_count, COUNT(*) FILTER (position IN ('forward', 'wing')) AS class_forward_count,
  COUNT(*) FILTER (position = 'big') AS class_big_count, MAX(rank) FILTER (rn = 1) AS class_best_rank,
  ROUND(MAX(pct) FILTER (rn = 1), 9) AS class_top_percentile, ROUND(AVG(pct), 9) AS class_avg_percentile,
  ROUND(SUM(pct * w) / SUM(w), 9) AS class_weighted_percentile
FROM w GROUP BY team
""",
)
def class_summary(spark, folder):
    from tipoff.functions.scalar import recruit_percentile

    suppliers = table(spark, folder, "supplier")
    n = suppliers.count()
    parts = table(spark, folder, "part").select(
        "p_partkey",
        F.col("p_name").alias("name"),
        (F.col("p_partkey") % 450).cast("double").alias("rank"),
        F.col("p_size").cast("double").alias("rating"),
        F.element_at(F.array(*[F.lit(p) for p in ("pg", "guard", "wing", "forward", "big")]), F.col("p_size") % 5 + 1).alias("position"),
        (F.col("p_partkey") % n).alias("s_suppkey"),
    )
    rows = parts.join(suppliers.select("s_suppkey", F.col("s_nationkey").alias("team")), "s_suppkey").withColumn(
        "pct", recruit_percentile(F.col("rank"), F.col("rating"), F.lit(None).cast("double"))
    )
    out = A.class_summary(rows, ["team"], "pct", "rank", "name", "rating", "position", prefix="class_")
    return out.select(*[(F.round(c, 9) if "percentile" in c or c.endswith("rating") else F.col(c)).alias(c) for c in out.columns])


@query(
    "incoming_summary",
    """
WITH t AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS season, l_suppkey AS team, l_partkey % 50 AS source, l_quantity AS minutes,
    ROUND(l_tax * 100) AS warp, CASE WHEN l_linestatus = 'O' THEN ROUND(l_discount * 100) END AS per
  FROM lineitem)
SELECT season, team, COUNT(*) AS in_players, COUNT(DISTINCT source) AS in_source_teams, COUNT(*) FILTER (minutes >= 40) AS in_heavy,
  COUNT(*) FILTER (warp > 0) AS in_positive, SUM(minutes) AS in_minutes, SUM(warp) AS in_warp, SUM(warp) * 2 AS in_adjusted,
  ROUND(SUM(per * minutes) / SUM(minutes) FILTER (per IS NOT NULL), 6) AS in_minutes_weighted_per
FROM t GROUP BY 1, 2
""",
)
def incoming_summary(spark, folder):
    t = table(spark, folder, "lineitem").select(
        F.year("l_shipdate").alias("season"),
        F.col("l_suppkey").alias("team"),
        (F.col("l_partkey") % 50).alias("source"),
        F.col("l_quantity").alias("minutes"),
        F.round(F.col("l_tax") * 100).alias("warp"),
        F.when(F.col("l_linestatus") == "O", F.round(F.col("l_discount") * 100)).alias("per"),
    )
    out = A.incoming_summary(
        t,
        ["season", "team"],
        "source",
        counts={"heavy": F.col("minutes") >= 40, "positive": F.col("warp") > 0},
        sums={"minutes": F.col("minutes"), "warp": F.col("warp"), "adjusted": F.col("warp") * 2},
        means={"per": F.col("per")},
        weight="minutes",
        prefix="in_",
    )
    return out.withColumn("in_minutes_weighted_per", r6("in_minutes_weighted_per"))


@query(
    "backoff_calibration",
    """
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, p_brand AS bucket, p_type AS position,
    CAST(ROUND(l_discount * 100) AS INTEGER) AS v FROM lineitem JOIN part ON p_partkey = l_partkey),
b AS (SELECT bucket, position, COUNT(*) AS n, AVG(v) AS m FROM x GROUP BY 1, 2),
c AS (SELECT bucket, COUNT(*) AS n, AVG(v) AS m FROM x GROUP BY 1),
d AS (SELECT position, COUNT(*) AS n, AVG(v) AS m FROM x GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CAST(l_shipdate AS DATE) AS l_shipdate,
  ROUND(CASE WHEN b.n >= 45 THEN b.m WHEN c.n >= 45 THEN c.m WHEN d.n >= 45 THEN d.m ELSE (SELECT AVG(v) FROM x) END, 6) AS expected
FROM x JOIN b USING (bucket, position) JOIN c USING (bucket) JOIN d USING (position)
""",
)
def backoff_calibration(spark, folder):
    parts = table(spark, folder, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("bucket"), F.col("p_type").alias("position")
    )
    x = table(spark, folder, "lineitem").join(parts, "l_partkey").withColumn("v", F.round(F.col("l_discount") * 100))
    levels = A.backoff_table(x, "bucket", "position", "v")
    out = A.backoff_lookup(x, levels, "bucket", "position", 45, "expected")
    return out.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        F.to_date("l_shipdate").alias("l_shipdate"), r6("expected").alias("expected"),
    )


@query(
    "rank_targets",
    f"""
WITH {SUPPLIER_YEARS},
r AS (SELECT season, entity, ROW_NUMBER() OVER (PARTITION BY season ORDER BY revenue DESC, entity) AS net_rank FROM sy),
n AS (SELECT season, COUNT(*) AS teams_ranked FROM r GROUP BY 1)
SELECT season, entity, net_rank, teams_ranked, ROUND(1 - (net_rank - 1) / (teams_ranked - 1), 6) AS net_percentile,
  net_rank <= 50 AS top_50, net_rank <= 75 AS top_75, net_rank <= 100 AS top_100, net_rank <= 135 AS top_135, net_rank > 200 AS below_200
FROM r JOIN n USING (season)
""",
)
def rank_targets(spark, folder):
    ranked = R.ordinal_rank(
        supplier_years(spark, folder).select("season", "entity", "revenue"),
        ["season"], [F.col("revenue").desc(), F.col("entity")], "net_rank",
    ).drop("revenue")
    return A.rank_targets(ranked, ["season"], "net_rank").withColumn("net_percentile", r6("net_percentile"))


# Supplier seasons with the rank of the season before as the prediction, and a second, blunter model.
_PREDICTIONS = f"""
{SUPPLIER_YEARS},
rk AS (SELECT season, entity, ROW_NUMBER() OVER (PARTITION BY season ORDER BY revenue DESC, entity) AS rank FROM sy),
pred AS (
  SELECT 'last' AS model, a.season, a.entity, CAST(a.rank AS DOUBLE) AS actual_net_rank, CAST(b.rank AS DOUBLE) AS predicted_net_rank,
    COUNT(*) OVER (PARTITION BY a.season) AS teams_ranked
  FROM rk a JOIN rk b ON b.entity = a.entity AND b.season = a.season - 1
  UNION ALL
  SELECT 'shifted', a.season, a.entity, CAST(a.rank AS DOUBLE), b.rank * 0.75 + 3, COUNT(*) OVER (PARTITION BY a.season)
  FROM rk a JOIN rk b ON b.entity = a.entity AND b.season = a.season - 1)"""
_BANDS = (25, 50)


def _predictions(spark, folder):
    ranked = R.ordinal_rank(
        supplier_years(spark, folder).select("season", "entity", "revenue"),
        ["season"], [F.col("revenue").desc(), F.col("entity")],
    ).select("season", "entity", "rank")
    before = ranked.select((F.col("season") + 1).alias("season"), "entity", F.col("rank").alias("prior"))
    both = ranked.join(before, ["season", "entity"])
    sizes = both.groupBy("season").agg(F.count("*").alias("teams_ranked"))
    models = F.inline(
        F.array(
            F.struct(F.lit("last").alias("model"), F.col("prior").cast("double").alias("predicted_net_rank")),
            F.struct(F.lit("shifted").alias("model"), (F.col("prior") * 0.75 + 3).alias("predicted_net_rank")),
        )
    )
    p = both.join(sizes, "season").select(
        "season", "entity", F.col("rank").cast("double").alias("actual_net_rank"), "teams_ranked", models
    )
    return p.withColumns(
        {
            "absolute_rank_error": F.abs(F.col("predicted_net_rank") - F.col("actual_net_rank")),
            **{f"actual_top_{b}": F.col("actual_net_rank") <= b for b in _BANDS},
            **{f"predicted_top_{b}": F.col("predicted_net_rank") <= b for b in _BANDS},
        }
    )


def _confusion_sql(prefix: str = "p") -> str:
    parts = []
    for b in _BANDS:
        a, p = f"actual_net_rank <= {b}", f"{prefix}_{b}"
        parts.append(
            f"""COUNT(*) FILTER ({a} AND {p}) AS top_{b}_true_positive, COUNT(*) FILTER (NOT ({a}) AND {p}) AS top_{b}_false_positive,
  COUNT(*) FILTER (NOT ({a}) AND NOT {p}) AS top_{b}_true_negative, COUNT(*) FILTER ({a} AND NOT {p}) AS top_{b}_false_negative"""
        )
    return ", ".join(parts)


def _score_sql() -> str:
    parts = []
    for b in _BANDS:
        tp, fp, fn, tn = (f"top_{b}_{n}" for n in ("true_positive", "false_positive", "false_negative", "true_negative"))
        parts.append(
            f"""ROUND(({tp} + {tn}) / NULLIF({tp} + {fp} + {tn} + {fn}, 0), 6) AS top_{b}_accuracy,
  ROUND({tp} / NULLIF({tp} + {fp}, 0), 6) AS top_{b}_precision, ROUND({tp} / NULLIF({tp} + {fn}, 0), 6) AS top_{b}_recall,
  CASE WHEN {tp} > 0 THEN ROUND(2 * {tp} / (2 * {tp} + {fp} + {fn}), 6) END AS top_{b}_f1"""
        )
    return ", ".join(parts)


_METRIC_COLUMNS = "rows, ROUND(rank_mae, 6) AS rank_mae, ROUND(rank_rmse, 6) AS rank_rmse"
_METRIC_AGG = (
    "COUNT(*) AS rows, AVG(ABS(predicted_net_rank - actual_net_rank)) AS rank_mae, "
    "SQRT(AVG(POW(predicted_net_rank - actual_net_rank, 2))) AS rank_rmse"
)
_FLAGS = ", ".join(f"predicted_net_rank <= {b} AS p_{b}" for b in _BANDS)
_COUNTS = ", ".join(
    f"top_{b}_{n}" for b in _BANDS for n in ("true_positive", "false_positive", "true_negative", "false_negative")
)


def _rounded(df):
    return df.select(
        *[
            (r6(c) if c.endswith(("mae", "rmse", "accuracy", "precision", "recall", "f1")) else F.col(c)).alias(c)
            for c in df.columns
        ]
    )


@query(
    "band_metrics",
    f"""
WITH {_PREDICTIONS}, f AS (SELECT *, {_FLAGS} FROM pred),
m AS (SELECT model, season, {_METRIC_AGG}, {_confusion_sql()} FROM f GROUP BY GROUPING SETS ((model, season), (model)))
SELECT model, season, {_METRIC_COLUMNS}, {_COUNTS}, {_score_sql()} FROM m
""",
)
def band_metrics(spark, folder):
    return _rounded(M.band_metrics(_predictions(spark, folder), [["model", "season"], ["model"]], bands=_BANDS))


@query(
    "slice_metrics",
    f"""
WITH {_PREDICTIONS}, f AS (SELECT *, {_FLAGS} FROM pred),
s AS (
  SELECT *, CASE WHEN season >= 1999 THEN 'late' ELSE 'not_late' END AS slice FROM f
  UNION ALL SELECT *, CASE WHEN entity % 3 = 0 THEN 'third' ELSE 'not_third' END FROM f),
m AS (SELECT model, slice, {_METRIC_AGG}, {_confusion_sql()} FROM s GROUP BY 1, 2)
SELECT model, slice, {_METRIC_COLUMNS}, {_COUNTS}, {_score_sql()} FROM m
""",
)
def slice_metrics(spark, folder):
    rows = _predictions(spark, folder).withColumns(
        {"late": F.col("season") >= 1999, "third": F.col("entity") % 3 == 0, "never": F.lit(False)}
    )
    return _rounded(M.slice_metrics(rows, "model", ["late", "third", "never"], bands=_BANDS))


def _sweep_sql(source: str, keys: str) -> str:
    """Brute force over every threshold."""
    return f"""
grid AS (SELECT DISTINCT {keys}, band, CAST(MAX(teams_ranked) OVER (PARTITION BY {keys}) AS INTEGER) AS mx
  FROM {source} CROSS JOIN (VALUES (25), (50)) v(band)),
sweep AS (SELECT {keys}, band, CAST(UNNEST(GENERATE_SERIES(1, mx)) AS INTEGER) AS t FROM grid),
tried AS (
  SELECT {", ".join("s." + k.strip() for k in keys.split(","))}, s.band, s.t,
    COUNT(*) FILTER (p.actual_net_rank <= s.band AND p.predicted_net_rank <= s.t) AS tp,
    COUNT(*) FILTER (p.actual_net_rank > s.band AND p.predicted_net_rank <= s.t) AS fp,
    COUNT(*) FILTER (p.actual_net_rank <= s.band AND p.predicted_net_rank > s.t) AS fn
  FROM sweep s JOIN {source} p USING ({keys}) GROUP BY {", ".join("s." + k.strip() for k in keys.split(","))}, s.band, s.t),
pr AS (SELECT *, COALESCE(tp / NULLIF(tp + fp, 0), 0) AS prec, COALESCE(tp / NULLIF(tp + fn, 0), 0) AS rec FROM tried),
scored AS (SELECT *, COALESCE(2 * prec * rec / NULLIF(prec + rec, 0), 0) AS f1 FROM pr),
best AS (SELECT * FROM scored
  QUALIFY ROW_NUMBER() OVER (PARTITION BY {keys}, band ORDER BY f1 DESC, prec DESC, ABS(t - band), t) = 1)"""


@query(
    "threshold_sweep",
    f"""
WITH {_PREDICTIONS}, {_sweep_sql("pred", "model")}
SELECT model, band, CAST(t AS DOUBLE) AS threshold, ROUND(f1, 6) AS f1, ROUND(prec, 6) AS precision FROM best
""",
)
def threshold_sweep(spark, folder):
    out = M.sweep_thresholds(_predictions(spark, folder), ["model"], _BANDS)
    return out.select("model", "band", "threshold", r6("f1").alias("f1"), r6("precision").alias("precision"))


_OOF = f"""
{_PREDICTIONS},
seasons AS (SELECT DISTINCT season AS test FROM pred),
earlier AS (SELECT p.model, s.test, p.actual_net_rank, p.predicted_net_rank, p.teams_ranked
  FROM pred p JOIN seasons s ON p.season < s.test), {_sweep_sql("earlier", "model, test")},
wanted AS (SELECT DISTINCT model, season, band FROM pred CROSS JOIN (VALUES (25), (50)) v(band)),
thr AS (SELECT w.model, w.season, w.band, COALESCE(CAST(b.t AS DOUBLE), w.band) AS threshold
  FROM wanted w LEFT JOIN best b ON b.model = w.model AND b.test = w.season AND b.band = w.band)"""


@query("out_of_fold_thresholds", f"WITH {_OOF} SELECT model, season, band, threshold FROM thr")
def out_of_fold_thresholds(spark, folder):
    out = M.out_of_fold_thresholds(_predictions(spark, folder), ["model"], "season", _BANDS)
    return out.select("model", "season", "band", "threshold")


@query(
    "calibrated_decisions",
    f"""
WITH {_OOF},
wide AS (SELECT model, season, MAX(threshold) FILTER (band = 25) AS t25, MAX(threshold) FILTER (band = 50) AS t50 FROM thr GROUP BY 1, 2),
f AS (SELECT p.*, predicted_net_rank <= t25 AS c_25, predicted_net_rank <= t50 AS c_50, {_FLAGS} FROM pred p JOIN wide USING (model, season)),
m AS (
  SELECT 'rank_threshold' AS decision_type, model, {_METRIC_AGG}, {_confusion_sql("p")} FROM f GROUP BY 2
  UNION ALL SELECT 'calibrated_threshold', model, {_METRIC_AGG}, {_confusion_sql("c")} FROM f GROUP BY 2)
SELECT decision_type, model, {_METRIC_COLUMNS}, {_COUNTS}, {_score_sql()} FROM m
""",
)
def calibrated_decisions(spark, folder):
    rows = _predictions(spark, folder)
    thresholds = M.out_of_fold_thresholds(rows, ["model"], "season", _BANDS)
    decided = M.apply_thresholds(rows, thresholds, ["model", "season"], "predicted_net_rank", _BANDS)
    kinds = {"rank_threshold": "predicted", "calibrated_threshold": "calibrated"}
    return _rounded(M.decision_metrics(decided, [["model"]], kinds, bands=_BANDS))


@query(
    "probability_scores",
    """
WITH d AS (
  SELECT d.source, l.quality AS y, ROUND(1 / (1 + EXP(-(d.n_chars - 700) / 900.0)), 4) AS p
  FROM documents d JOIN labels l USING (doc_id)),
base AS (
  SELECT source, COUNT(*) AS rows, SUM(y) AS positives,
    AVG(-(y * LN(LEAST(GREATEST(p, 1e-6), 1 - 1e-6)) + (1 - y) * LN(1 - LEAST(GREATEST(p, 1e-6), 1 - 1e-6)))) AS log_loss,
    AVG((p - y) * (p - y)) AS brier
  FROM d GROUP BY 1),
auc AS (
  SELECT a.source, AVG(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) AS auc
  FROM d a JOIN d b ON a.source = b.source AND a.y = 1 AND b.y = 0 GROUP BY 1),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source ORDER BY p DESC, y DESC) AS rn FROM d),
top AS (
  SELECT r.source, AVG(y) AS hit10 FROM ranked r JOIN base USING (source)
  WHERE rn <= GREATEST(1, ROUND_EVEN(rows * 0.1, 0)) GROUP BY 1)
SELECT b.source, b.rows, CAST(b.positives AS BIGINT) AS positives, ROUND(auc, 6) AS auc, ROUND(log_loss, 6) AS log_loss,
  ROUND(brier, 6) AS brier, ROUND(hit10, 6) AS hit10
FROM base b LEFT JOIN auc USING (source) LEFT JOIN top USING (source)
""",
)
def probability_scores(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    score = F.round(1 / (1 + F.exp(-(F.col("n_chars") - 700) / 900.0)), 4)
    d = docs.join(table(spark, folder, "labels"), "doc_id").select("source", F.col("quality").alias("y"), score.alias("p"))
    out = M.probability_scores(d, ["source"], "y", "p", {"hit10": 0.10})
    return out.select(
        "source", "rows", "positives", r6("auc").alias("auc"), r6("log_loss").alias("log_loss"),
        r6("brier").alias("brier"), r6("hit10").alias("hit10"),
    )


_GAMES = """
games AS (
  SELECT CAST(year(l.l_shipdate) AS INTEGER) AS season, 'c' || o.o_custkey AS home, 's' || l.l_suppkey AS away,
    ROUND(c.c_acctbal) / 512.0 AS home_rating, ROUND(s.s_acctbal) / 512.0 AS away_rating, l.l_linenumber % 4 = 0 AS neutral
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
    JOIN supplier s ON s.s_suppkey = l.l_suppkey)"""


def _games(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("home"))
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("home"), (F.round("c_acctbal") / 512.0).alias("home_rating")
    )
    suppliers = table(spark, folder, "supplier").select("s_suppkey", (F.round("s_acctbal") / 512.0).alias("away_rating"))
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", F.col("l_suppkey").alias("s_suppkey"), F.year("l_shipdate").alias("season")
    )
    return (
        lines.join(orders, "l_orderkey").join(customers, "home").join(suppliers, "s_suppkey")
        .withColumns({"home": F.concat(F.lit("c"), "home"), "away": F.concat(F.lit("s"), "s_suppkey")})
        .withColumn("neutral", F.col("l_linenumber") % 4 == 0)
    )


@query(
    "both_sides_strength",
    f"""
WITH {_GAMES},
sides AS (
  SELECT season, home AS team, CASE WHEN neutral THEN away_rating ELSE away_rating - 3.5 END AS opp,
    CASE WHEN neutral THEN 0 ELSE 1 END AS at_home, neutral::INT AS n FROM games
  UNION ALL
  SELECT season, away, CASE WHEN neutral THEN home_rating ELSE home_rating + 3.5 END, 0, neutral::INT FROM games)
SELECT season, team, ROUND(AVG(opp), 11) AS avg_adj_em, ROUND(AVG(at_home), 6) AS home_share, ROUND(AVG(n), 6) AS neutral_share,
  COUNT(*) AS games FROM sides GROUP BY 1, 2
""",
)
def both_sides_strength(spark, folder):
    out = A.both_sides(_games(spark, folder), "season", "home", "away", "home_rating", "away_rating", F.col("neutral"))
    return out.select(
        "season", "team", F.round("avg_adj_em", 11).alias("avg_adj_em"), r6("home_share").alias("home_share"),
        r6("neutral_share").alias("neutral_share"), "games",
    )


@query(
    "least_squares",
    """
SELECT 1 AS term, ROUND(REGR_INTERCEPT(l_extendedprice, l_quantity), 3) AS coefficient FROM lineitem
UNION ALL SELECT 2, ROUND(REGR_SLOPE(l_extendedprice, l_quantity), 3) FROM lineitem
""",
)
def least_squares(spark, folder):
    b = fit_least_squares(table(spark, folder, "lineitem"), [F.col("l_quantity")], F.col("l_extendedprice"))
    return spark.createDataFrame([(i, round(v, 3)) for i, v in enumerate(b, 1)], "term int, coefficient double")


@query(
    "label_counts",
    """
SELECT 'lang' AS "column", lang AS label, COUNT(*) AS rows FROM documents GROUP BY 2
UNION ALL SELECT 'source', source, COUNT(*) FROM documents GROUP BY 2
""",
)
def label_counts(spark, folder):
    return A.label_counts(table(spark, folder, "documents"), ["lang", "source"])


@query(
    "tier_benchmarks",
    """
WITH s AS (SELECT c_acctbal, ROW_NUMBER() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer),
t AS (SELECT * FROM (VALUES ('top_25', 1, 25), ('26_50', 26, 50), ('51_75', 51, 75), ('301_plus', 301, 100000000), ('bubble', 40, 60)) v(tier, lo, hi))
SELECT tier, ROUND(AVG(FLOOR(c_acctbal)), 2) AS mean_rating FROM t JOIN s ON place BETWEEN lo AND hi GROUP BY 1
""",
)
def tier_benchmarks(spark, folder):
    curve = R.rating_curve(table(spark, folder, "customer"), "c_acctbal", ["c_custkey"])
    curve = curve.withColumn("rating", F.floor("rating").cast("double"))
    ranges = {"top_25": (1, 25), "26_50": (26, 50), "51_75": (51, 75), "301_plus": (301, None), "bubble": (40, 60)}
    return A.range_means(curve, ranges)


@query(
    "tier_placeholders",
    f"""
WITH {CUSTOMER_YEARS},
t AS (SELECT entity, SUM(n_orders) AS n FROM cy GROUP BY 1),
r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY n DESC, entity) AS rank FROM t),
b AS (SELECT *, CASE WHEN rank <= 25 THEN 'top_25' WHEN rank <= 50 THEN '26_50' WHEN rank <= 75 THEN '51_75'
  WHEN rank <= 100 THEN '76_100' WHEN rank <= 135 THEN '101_135' WHEN rank <= 160 THEN '136_160' WHEN rank <= 200 THEN '161_200'
  WHEN rank <= 250 THEN '201_250' WHEN rank <= 300 THEN '251_300' ELSE '301_plus' END AS tier FROM r)
SELECT tier, ROUND_EVEN(AVG(rank), 1) AS schedule_score, ROUND_EVEN(AVG(n), 2) AS projected_adj_em FROM b GROUP BY 1
""",
)
def tier_placeholders(spark, folder):
    totals = customer_years(spark, folder).groupBy("entity").agg(F.sum("n_orders").alias("n"))
    ranked = R.ordinal_rank(totals, [], [F.col("n").desc(), F.col("entity")])
    return A.placeholders(ranked.withColumn("tier", L.rank_band(F.col("rank"))), "tier", "rank", "n")


@query(
    "schedule_rollup",
    f"""
WITH g AS (
  SELECT l.l_orderkey AS schedule, ROUND(c.c_acctbal) / 512.0 AS host, ROUND(s.s_acctbal) / 512.0 AS opp, CAST(l.l_partkey % 350 + 1 AS DOUBLE) AS rank,
    CASE l.l_linenumber % 3 WHEN 0 THEN 'Home' WHEN 1 THEN 'Neutral' ELSE 'Away' END AS site
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
    JOIN supplier s ON s.s_suppkey = l.l_suppkey),
p AS (SELECT *, CASE site WHEN 'Home' THEN 3.5 WHEN 'Away' THEN -3.5 ELSE 0 END AS adj FROM g),
w AS (SELECT *, 1 / (1 + POW(2.718281828, -((host + adj - opp) / 6.5))) AS pw, opp - adj AS oa,
  CASE site WHEN 'Home' THEN CASE WHEN rank <= 30 THEN 1 WHEN rank <= 75 THEN 2 WHEN rank <= 160 THEN 3 ELSE 4 END
    WHEN 'Neutral' THEN CASE WHEN rank <= 50 THEN 1 WHEN rank <= 100 THEN 2 WHEN rank <= 200 THEN 3 ELSE 4 END
    ELSE CASE WHEN rank <= 75 THEN 1 WHEN rank <= 135 THEN 2 WHEN rank <= 240 THEN 3 ELSE 4 END END AS q FROM p)
SELECT schedule, COUNT(*) AS games, ROUND(SUM(pw), 6) AS expected_wins, ROUND(COUNT(*) - SUM(pw), 6) AS expected_losses,
  ROUND(AVG(pw), 6) AS win_pct, ROUND(AVG(oa), 9) AS avg_opponent, COUNT(*) FILTER (site = 'Home') AS home,
  COUNT(*) FILTER (site = 'Neutral') AS neutral, COUNT(*) FILTER (site = 'Away') AS away, COUNT(*) FILTER (q = 1) AS q1,
  COUNT(*) FILTER (q = 2) AS q2, COUNT(*) FILTER (q = 3) AS q3, COUNT(*) FILTER (q = 4) AS q4,
  COUNT(*) FILTER (rank <= 100) AS top100, COUNT(*) FILTER (rank <= 200) AS top200, COUNT(*) FILTER (rank > 250) AS buy251,
  COUNT(*) FILTER (rank > 300) AS buy301,
  CAST(GREATEST(1, LEAST(365, FLOOR(180.0 - 2.5 * AVG(oa) + 20.0 * COUNT(*) FILTER (site = 'Home') / COUNT(*)
    - 5.0 * COUNT(*) FILTER (site = 'Neutral') / COUNT(*) + 0.5))) AS INTEGER) AS difficulty
FROM w GROUP BY 1
""",
)
def schedule_rollup(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("schedule"), F.col("o_custkey").alias("c_custkey"))
    customers = table(spark, folder, "customer").select("c_custkey", (F.round("c_acctbal") / 512.0).alias("host"))
    suppliers = table(spark, folder, "supplier").select("s_suppkey", (F.round("s_acctbal") / 512.0).alias("opp"))
    third = F.col("l_linenumber") % 3
    games = (
        table(spark, folder, "lineitem")
        .select(
            F.col("l_orderkey").alias("schedule"),
            F.col("l_suppkey").alias("s_suppkey"),
            (F.col("l_partkey") % 350 + 1).cast("double").alias("rank"),
            F.when(third == 0, "Home").when(third == 1, "Neutral").otherwise("Away").alias("site"),
        )
        .join(orders, "schedule").join(customers, "c_custkey").join(suppliers, "s_suppkey")
    )
    out = A.schedule_rollup(games, ["schedule"], "rank", "opp", F.col("host"))
    difficulty = A.difficulty_rank(
        F.col("avg_opponent"), F.col("home"), F.col("neutral"), F.col("games"), (180.0, -2.5, 20.0, -5.0)
    )
    out = out.withColumns({"difficulty": difficulty, "avg_opponent": F.round("avg_opponent", 9)})
    return out.select(
        *[
            (r6(c) if c in ("expected_wins", "expected_losses", "win_pct") else F.col(c)).alias(c)
            for c in out.columns
        ]
    )
