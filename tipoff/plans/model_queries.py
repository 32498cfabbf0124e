"""Models and ordered assignments over lines, suppliers, parts and labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tipoff.operators import ranking as R
from tipoff.operators import rolling as RO
from tipoff.operators.boosting import fit_boosted_trees
from tipoff.operators.linear import correlation_scores, fit_ridge, fit_ridge_by_label, profile
from tipoff.operators.logistic import fit_logistic
from tipoff.operators.slots import bench, slot_filling, starters
from tipoff.plans.registry import SUPPLIER_YEARS, query, r6, supplier_years, table


@query(
    "ridge_fit",
    """
WITH x AS (SELECT l_quantity AS q, FLOOR(l_extendedprice) / 1024.0 AS y FROM lineitem),
s AS (SELECT COUNT(*) AS n, AVG(q) AS m, STDDEV_POP(q) AS sd, AVG(y) AS yb FROM x),
w AS (SELECT SUM((q - m) / sd * y) AS zy FROM x, s)
SELECT DISTINCT q AS l_quantity, ROUND(yb + (q - m) / sd * zy / (n + 5000), 4) AS predicted FROM x, s, w
""",
)
def ridge_fit(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_quantity", (F.floor("l_extendedprice") / 1024.0).alias("y"))
    model = fit_ridge(lines, ["l_quantity"], F.col("y"), 5000.0)
    return lines.select("l_quantity").distinct().select("l_quantity", F.round(model.predict(), 4).alias("predicted"))


@query("ridge_many_features")
def ridge_many_features(spark, folder):
    lines = table(spark, folder, "lineitem").withColumn(
        "l_tax", F.when(F.col("l_linestatus") == "O", F.col("l_tax"))
    )
    model = fit_ridge(
        lines, ["l_quantity", "l_discount", "l_tax", "l_linenumber"], F.col("l_extendedprice") / 1024.0, 100.0, "l_returnflag"
    )
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(model.predict(), 4).alias("predicted"))


@query(
    "ridge_many_labels",
    """
WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, CASE WHEN l_returnflag <> 'N' THEN l_partkey END AS g,
  FLOOR(l_extendedprice) / 1024.0 AS y FROM lineitem),
m AS (SELECT AVG(q) AS mean, STDDEV_POP(q) AS sd FROM x),
z AS (SELECT l_orderkey, l_linenumber, g, (q - mean) / sd AS z, y FROM x, m),
g AS (SELECT g, COUNT(*) AS n, SUM(z) AS sz, SUM(y) AS sy, COUNT(*) + 25.0 AS d FROM z WHERE g IS NOT NULL GROUP BY 1),
t AS (SELECT COUNT(*) AS n, SUM(z) AS sz, SUM(z * z) + 25.0 AS zz, SUM(y) AS sy, SUM(z * y) AS zy FROM z),
u AS (SELECT SUM(n * n / d) AS n, SUM(n * sz / d) AS sz, SUM(sz * sz / d) AS zz, SUM(n * sy / d) AS sy, SUM(sz * sy / d) AS zy FROM g),
s AS (SELECT t.n - u.n AS a, t.sz - u.sz AS b, t.zz - u.zz AS c, t.sy - u.sy AS e, t.zy - u.zy AS f FROM t, u),
w AS (SELECT (e * c - b * f) / (a * c - b * b) AS w0, (a * f - b * e) / (a * c - b * b) AS w1 FROM s)
SELECT l_orderkey, l_linenumber, ROUND(w0 + w1 * z + COALESCE((sy - n * w0 - sz * w1) / d, 0), 4) AS predicted
FROM z LEFT JOIN g USING (g), w
""",
)
def ridge_many_labels(spark, folder):
    """A term for each part; half of the rows have no label."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", (F.floor("l_extendedprice") / 1024.0).alias("y"),
        F.when(F.col("l_returnflag") != "N", F.col("l_partkey")).alias("part"),
    )
    model = fit_ridge_by_label(lines, ["l_quantity"], F.col("y"), 25.0, "part")
    return model.score(lines, "p").select("l_orderkey", "l_linenumber", F.round("p", 4).alias("predicted"))


@query(
    "feature_correlations",
    """
SELECT 'l_quantity' AS feature, ROUND(ABS(CORR(l_quantity, l_extendedprice)), 6) AS score FROM lineitem
UNION ALL SELECT 'l_discount', ROUND(ABS(CORR(l_discount, l_extendedprice)), 6) FROM lineitem
UNION ALL SELECT 'l_tax', ROUND(ABS(CORR(COALESCE(CASE WHEN l_linestatus = 'O' THEN l_tax END,
    (SELECT MEDIAN(l_tax) FROM lineitem WHERE l_linestatus = 'O')), l_extendedprice)), 6) FROM lineitem
UNION ALL SELECT 'l_linenumber', ROUND(ABS(CORR(l_linenumber, l_extendedprice)), 6) FROM lineitem
""",
)
def feature_correlations(spark, folder):
    lines = table(spark, folder, "lineitem").withColumn("l_tax", F.when(F.col("l_linestatus") == "O", F.col("l_tax")))
    columns = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    scores = correlation_scores(profile(lines, columns, F.col("l_extendedprice")), columns)
    frame = spark.createDataFrame([(c, s) for s, c in scores], "feature string, score double")
    return frame.select("feature", r6("score").alias("score")).orderBy(F.col("score").desc(), F.col("feature").desc())


def season_table(spark, folder):
    """Supplier seasons as modeling rows: last season's rank and this season's line count as features."""
    sy = supplier_years(spark, folder)
    ranked = R.ordinal_rank(sy, ["season"], [F.col("revenue").desc(), F.col("entity")], "rank", "n")
    before = ranked.select((F.col("season") + 1).alias("season"), "entity", F.col("rank").alias("last_rank"))
    rows = ranked.join(before, ["season", "entity"], "left")
    return rows.select(
        "season",
        F.col("entity").cast("string").alias("team"),
        F.col("entity").cast("string").alias("team_key"),
        F.lit(None).cast("string").alias("conference"),
        F.col("last_rank").cast("double").alias("kenpom_preseason_rank_adj_em"),
        F.col("n_lines").cast("double").alias("prior_roster_lines"),
        F.col("rank").cast("double").alias("target_net_rank"),
        (1 - (F.col("rank") - 1) / (F.col("n") - 1)).alias("target_net_percentile"),
        F.col("n").cast("double").alias("target_teams_ranked"),
    )


_SEASONS = f"""
{SUPPLIER_YEARS},
rk AS (SELECT season, entity, n_lines, ROW_NUMBER() OVER (PARTITION BY season ORDER BY revenue DESC, entity) AS rank,
    COUNT(*) OVER (PARTITION BY season) AS n FROM sy),
tab AS (SELECT a.season, a.entity, CAST(a.n_lines AS DOUBLE) AS x, a.rank, a.n, 1 - (a.rank - 1) / (a.n - 1) AS y, b.rank AS last_rank
  FROM rk a LEFT JOIN rk b ON b.entity = a.entity AND b.season = a.season - 1),
tests AS (SELECT DISTINCT season AS test FROM tab WHERE season > (SELECT MIN(season) FROM tab)),
fit AS (SELECT test, COUNT(*) AS k, AVG(x) AS m, STDDEV_POP(x) AS sd, AVG(y) AS yb FROM tests JOIN tab ON season < test GROUP BY 1),
slope AS (SELECT f.test, SUM((x - m) / sd * y) / (MAX(k) + 100) AS w FROM fit f JOIN tab ON season < test GROUP BY 1),
base AS (SELECT season, entity, n, k, LEAST(GREATEST(COALESCE(last_rank, n / 2.0), 1.0), n) AS prank, rank FROM tab JOIN fit ON test = season),
pred AS (
  SELECT 'kenpom_preseason_baseline' AS model, season, entity, 1 AS feature_count, k, n, rank, 1 - (prank - 1) / GREATEST(n - 1, 1) AS p FROM base
  UNION ALL
  SELECT 'lines_ridge', season, entity, 1, k, n, rank, LEAST(GREATEST(yb + (x - m) / sd * w, 0), 1)
  FROM tab JOIN fit f ON f.test = season JOIN slope s ON s.test = season)"""


@query(
    "rolling_predictions",
    f"""
WITH {_SEASONS}
SELECT model, season, CAST(entity AS VARCHAR) AS team_key, feature_count, k AS train_rows, ROUND(p, 6) AS predicted_net_percentile,
  ROUND(1 + (1 - p) * GREATEST(n - 1, 1), 4) AS predicted_net_rank FROM pred
""",
)
def rolling_predictions(spark, folder):
    config = RO.ModelConfig("lines_ridge", ("prior_roster_",), "direct", alpha=100.0)
    out = RO.rolling_predictions(season_table(spark, folder), [config])
    return out.select(
        "model", "season", "team_key", "feature_count", "train_rows", r6("predicted_net_percentile").alias("predicted_net_percentile"),
        F.round("predicted_net_rank", 4).alias("predicted_net_rank"),
    )


@query(
    "blended_predictions",
    f"""
WITH {_SEASONS}
SELECT 'mix' AS model, season, CAST(entity AS VARCHAR) AS team_key, CAST(SUM(feature_count) AS INTEGER) AS feature_count,
  MIN(k) AS train_rows, ROUND(AVG(p), 6) AS predicted_net_percentile
FROM pred GROUP BY season, entity
""",
)
def blended_predictions(spark, folder):
    config = RO.ModelConfig("lines_ridge", ("prior_roster_",), "direct", alpha=100.0)
    base = RO.rolling_predictions(season_table(spark, folder), [config])
    out = RO.blend(base, {"mix": ["kenpom_preseason_baseline", "lines_ridge"]})
    return out.select(
        "model", "season", "team_key", "feature_count", "train_rows", r6("predicted_net_percentile").alias("predicted_net_percentile")
    )


@query("feature_selections")
def feature_selections(spark, folder):
    config = RO.ModelConfig("both", ("prior_roster_", "kenpom_preseason_"), "residual")
    return RO.feature_report(season_table(spark, folder), [config], max_features=1)


_STUMP = """
x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, FLOOR(l_extendedprice) AS y, ROUND(l_discount * 100) AS f0, l_quantity AS f1 FROM lineitem),
base AS (SELECT AVG(y) AS b, COUNT(*) AS n, SUM(y) AS t FROM x),
vals AS (SELECT 0 AS f, f0 AS v, COUNT(*) AS n, SUM(y) AS s FROM x GROUP BY 2 UNION ALL SELECT 1, f1, COUNT(*), SUM(y) FROM x GROUP BY 2),
pos AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY f ORDER BY v) - 1 AS p, COUNT(*) OVER (PARTITION BY f) AS u,
  SUM(n) OVER (PARTITION BY f ORDER BY v) AS ln, SUM(s) OVER (PARTITION BY f ORDER BY v) AS ls FROM vals),
cand AS (SELECT pos.*, base.t, base.n AS tn FROM pos, base
  WHERE p IN (SELECT CAST(FLOOR(i * (u - 1) / 7) AS BIGINT) FROM range(1, 7) r(i)) AND ln >= 35 AND base.n - ln >= 35),
gain AS (SELECT *, ls * ls / ln + (t - ls) * (t - ls) / (tn - ln) - t * t / tn AS g FROM cand),
best AS (SELECT * FROM gain ORDER BY g DESC, f, v LIMIT 1)"""


@query(
    "boosted_stump",
    f"""
WITH {_STUMP}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
  ROUND(base.b + 0.5 * (CASE WHEN (CASE WHEN f = 0 THEN f0 ELSE f1 END) <= v THEN ls / ln ELSE (best.t - ls) / (tn - ln) END - base.b), 4) AS predicted
FROM x, base, best
""",
)
def boosted_stump(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        F.floor("l_extendedprice").cast("double").alias("y"), F.round(F.col("l_discount") * 100).alias("f0"), F.col("l_quantity").alias("f1"),
    )
    model = fit_boosted_trees(lines, ["f0", "f1"], F.col("y"), estimators=1, rate=0.5, max_depth=1)
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.round(model.predict(), 4).alias("predicted")
    )


def _trees_sql(estimators: int = 28) -> str:
    """Boosting written out tree by tree: best cut of the root, best cut of each child, leaf means."""

    def cuts(source: str, node: str) -> str:
        return f"""
  SELECT * FROM (
    SELECT *, CASE WHEN u <= 7 THEN (v + following) / 2 ELSE v END AS thr,
      round(ls * ls / ln + (ts - ls) * (ts - ls) / nullif(tn - ln, 0) - ts * ts / tn, 12) AS g FROM (
      SELECT *, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY {node}, f) AS u, lead(v) OVER w AS following,
        sum(n) OVER w AS ln, sum(s) OVER w AS ls, sum(n) OVER (PARTITION BY {node}, f) AS tn, sum(s) OVER (PARTITION BY {node}, f) AS ts
      FROM (SELECT {node}, f, v, count(*) AS n, sum(res) AS s FROM (
          SELECT {node}, res, unnest([0, 1, 2, 3, 4]) AS f, unnest([f0, f1, f2, f3, f4]) AS v FROM {source}) GROUP BY ALL)
      WINDOW w AS (PARTITION BY {node}, f ORDER BY v))
    WHERE ln >= 35 AND tn - ln >= 35 AND CASE WHEN u <= 7 THEN p < u - 1 ELSE p IN (
      (u - 1) // 7, 2 * (u - 1) // 7, 3 * (u - 1) // 7, 4 * (u - 1) // 7, 5 * (u - 1) // 7, 6 * (u - 1) // 7) END)
  WHERE g > 0 QUALIFY row_number() OVER (PARTITION BY {node} ORDER BY g DESC, f, thr) = 1"""

    parts = []
    for t in range(estimators):
        parts.append(f"""
r{t} AS MATERIALIZED (SELECT * EXCLUDE (pred), pred, y - pred AS res, 0 AS k FROM p{t}),
a{t} AS MATERIALIZED ({cuts(f"r{t}", "k")}),
c{t} AS MATERIALIZED (SELECT r.* EXCLUDE (k), CASE WHEN [f0, f1, f2, f3, f4][f + 1] <= thr THEN 0 ELSE 1 END AS k FROM r{t} r, a{t}),
b{t} AS MATERIALIZED ({cuts(f"c{t}", "k")}),
p{t + 1} AS MATERIALIZED (
  SELECT key, f0, f1, f2, f3, f4, y, pred + 0.05 * CASE WHEN f IS NULL THEN own
    WHEN [f0, f1, f2, f3, f4][f + 1] <= thr THEN ls / ln ELSE (ts - ls) / (tn - ln) END AS pred
  FROM (SELECT *, avg(res) OVER (PARTITION BY k) AS own FROM c{t}) c LEFT JOIN b{t} b USING (k))""")
    return f"""
WITH p0 AS MATERIALIZED (
  SELECT {{'o': l_orderkey, 'l': l_linenumber, 'p': l_partkey, 's': l_suppkey}} AS key, l_quantity AS f0, l_discount AS f1, l_tax AS f2,
    CAST(l_linenumber AS DOUBLE) AS f3, CAST(l_partkey AS DOUBLE) AS f4, l_extendedprice AS y, avg(l_extendedprice) OVER () AS pred FROM lineitem),
{",".join(parts)}
SELECT key.o AS l_orderkey, key.l AS l_linenumber, key.p AS l_partkey, key.s AS l_suppkey, round(pred, 2) AS predicted FROM p{estimators}"""


@query("boosted_trees", _trees_sql())
def boosted_trees(spark, folder):
    lines = table(spark, folder, "lineitem")
    columns = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_partkey"]
    model = fit_boosted_trees(lines, columns, F.col("l_extendedprice"))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(model.predict(), 2).alias("predicted"))


def _documents(spark, folder):
    docs = table(spark, folder, "documents").select(
        "doc_id",
        F.col("n_chars").cast("double").alias("program_chars"),
        F.log1p("n_chars").alias("coach_chars_log"),
        F.size(F.split("text", "\n")).cast("double").alias("roster_talent_lines"),
        (F.length(F.regexp_replace("text", r"[^0-9]", "")) / F.greatest(F.length("text"), F.lit(1))).alias("roster_talent_digits"),
    )
    return docs.join(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id")


_DOC_FEATURES = ["program_chars", "coach_chars_log", "roster_talent_lines", "roster_talent_digits"]


@query("logistic_risk")
def logistic_risk(spark, folder):
    docs = _documents(spark, folder)
    model = fit_logistic(docs, _DOC_FEATURES, "quality")
    return docs.select("doc_id", "quality", F.round(model.probability(), 4).alias("probability"))


@query("logistic_coefficients")
def logistic_coefficients(spark, folder):
    model = fit_logistic(_documents(spark, folder), _DOC_FEATURES, "quality")
    out = model.coefficients(spark)
    return out.select("feature", "signal_group", F.round("coefficient", 4).alias("coefficient"), F.round("abs_coefficient", 4).alias("abs_coefficient"))


@query("rolling_risk")
def rolling_risk(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        F.year("l_shipdate").alias("season"), (F.col("l_returnflag") == "R").cast("int").alias("upset"),
        "l_quantity", "l_discount", (F.col("l_extendedprice") / 1000).alias("price"),
    )
    _, metrics = RO.rolling_risk(lines, ["l_quantity", "l_discount", "price"])
    return metrics.select(
        "season", "train_rows", "test_rows", "test_upsets",
        *[F.round(c, 3).alias(c) for c in ("test_upset_rate", "auc", "log_loss", "brier", "upset_rate_top_10_pct_risk", "upset_rate_top_20_pct_risk")],
    )


@query("counterfactual_lift")
def counterfactual_lift(spark, folder):
    docs = _documents(spark, folder)
    model = fit_logistic(docs, _DOC_FEATURES, "quality")
    middle = R.medians(docs, [], ["roster_talent_lines", "roster_talent_digits"]).first()
    neutral = docs.withColumns({c: F.lit(middle[c]) for c in ("roster_talent_lines", "roster_talent_digits")})
    scored = docs.select("doc_id", model.probability().alias("p"))
    return scored.join(neutral.select("doc_id", model.probability().alias("q")), "doc_id").select(
        "doc_id", F.round("p", 4).alias("probability"), F.round(F.col("p") - F.col("q"), 4).alias("lift")
    )


_SLOT = """
n AS (SELECT COUNT(*) AS k FROM supplier),
rec AS (SELECT p_partkey % k AS team, p_partkey AS id, p_name AS name, (p_size % 37 + 1) / 64.0 AS base, (p_partkey % 7 + 2) / 128.0 AS hist,
  ['pg', 'guard', 'wing', 'forward', 'big'][1 + p_size % 5] AS pos
  FROM (SELECT * FROM part UNION ALL SELECT * FROM part WHERE p_size > 25), n),
o AS (SELECT *, CASE WHEN pos IN ('pg', 'guard') THEN 'back' ELSE 'front' END AS court, pos IN ('pg', 'big') AS special FROM rec),
seq AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY team, court ORDER BY base DESC, name, id) AS i FROM o),
known AS (SELECT s_suppkey AS team, s_suppkey % 3 / 4.0 AS ks, s_suppkey % 5 / 2.0 AS kc FROM supplier),
courts AS (SELECT team, UNNEST(['back', 'front']) AS court, ks AS s, kc AS c FROM known WHERE team IN (SELECT team FROM rec)),"""


@query(
    "slot_filling",
    f"""
WITH RECURSIVE {_SLOT}
fold AS (
  SELECT team, court, 0 AS i, CAST(s AS DOUBLE) AS s, CAST(c AS DOUBLE) AS c, CAST(0 AS DOUBLE) AS share, CAST(0 AS DOUBLE) AS tot,
    CAST(0 AS DOUBLE) AS wt FROM courts
  UNION ALL
  SELECT team, court, i, s + CASE WHEN special THEN LEAST(sh / 0.08, 1) ELSE 0 END, c + LEAST(sh / 0.08, 1), sh, tot + sh, wt + base * sh
  FROM (
    SELECT f.team, f.court, q.i, f.s, f.c, f.tot, f.wt, q.base, q.special,
      LEAST(q.hist * (0.65 + 0.85 * CASE WHEN q.special
        THEN (GREATEST(LEAST((2 - f.s) / 2, 1), 0) + GREATEST(LEAST((5 - f.c) / 5, 1), 0)) / 2
        ELSE GREATEST(LEAST((5 - f.c) / 5, 1), 0) END), 0.22) AS sh
    FROM fold f JOIN seq q ON q.team = f.team AND q.court = f.court AND q.i = f.i + 1)),
fin AS (SELECT * FROM fold QUALIFY ROW_NUMBER() OVER (PARTITION BY team, court ORDER BY i DESC) = 1),
top AS (SELECT team, MAX(share) AS top FROM fold GROUP BY 1),
need AS (SELECT team, SUM(tot) AS total, SUM(wt) AS wt,
  MAX(CASE WHEN court = 'back' THEN GREATEST(LEAST((2 - s) / 2, 1), 0) END) AS pg_need,
  MAX(CASE WHEN court = 'front' THEN GREATEST(LEAST((2 - s) / 2, 1), 0) END) AS big_need,
  MAX(CASE WHEN court = 'back' THEN GREATEST(LEAST((5 - c) / 5, 1), 0) END) AS backcourt_need,
  MAX(CASE WHEN court = 'front' THEN GREATEST(LEAST((5 - c) / 5, 1), 0) END) AS frontcourt_need FROM fin GROUP BY 1),
tal AS (SELECT team, SUM(base * hist) / SUM(hist) AS talent FROM rec GROUP BY 1)
SELECT team, ROUND(total, 6) AS total, ROUND(wt / total, 6) AS impact, ROUND(top, 6) AS top, ROUND(talent, 6) AS talent,
  ROUND(pg_need, 6) AS pg_need, ROUND(big_need, 6) AS big_need, ROUND(backcourt_need, 6) AS backcourt_need,
  ROUND(frontcourt_need, 6) AS frontcourt_need, ROUND(LEAST(total / 0.08, 9), 6) AS hs_role_units
FROM need JOIN top USING (team) JOIN tal USING (team)
""",
)
def slot_filling_query(spark, folder):
    suppliers = table(spark, folder, "supplier")
    k = suppliers.count()
    positions = F.array(*[F.lit(p) for p in ("pg", "guard", "wing", "forward", "big")])
    parts = table(spark, folder, "part")
    recruits = parts.union(parts.where("p_size > 25")).select(  # some recruits come twice
        (F.col("p_partkey") % k).alias("team"),
        F.col("p_partkey").alias("player_id"),
        F.col("p_name").alias("player_name"),
        ((F.col("p_size") % 37 + 1) / 64.0).alias("base"),
        ((F.col("p_partkey") % 7 + 2) / 128.0).alias("history_share"),
        F.element_at(positions, F.col("p_size") % 5 + 1).alias("position"),
    )
    s, c = F.col("s_suppkey") % 3 / 4.0, F.col("s_suppkey") % 5 / 2.0
    known = suppliers.select(
        F.col("s_suppkey").alias("team"), s.alias("known_pg"), s.alias("known_big"), c.alias("known_backcourt"),
        c.alias("known_frontcourt"), F.lit(0.1).alias("returner_share"), F.lit(0.0).alias("transfer_share"),
    )
    out = slot_filling(recruits, known, ["team"])
    return out.select(
        "team",
        r6("projected_minutes_share_total").alias("total"),
        r6("need_adjusted_impact_percentile").alias("impact"),
        r6("top_projected_minutes_share").alias("top"),
        r6("player_talent_percentile").alias("talent"),
        *[r6(f"{c}_need").alias(f"{c}_need") for c in ("pg", "big", "backcourt", "frontcourt")],
        r6("hs_role_units").alias("hs_role_units"),
    )


def _pick_sql() -> str:
    slots = (
        ("PG", "('pg','guard')", "('pg')", 0.035), ("SG", "('guard','pg','wing')", "('guard','pg')", 0.02),
        ("Wing", "('wing','forward','guard')", "('wing','forward')", 0.02), ("PF", "('forward','big','wing')", "('forward','big')", 0.02),
        ("C", "('big','forward')", "('big')", 0.002),
    )
    parts = []
    for i, (slot, allowed, natural, bonus) in enumerate(slots):
        taken = " AND ".join([f"NOT EXISTS (SELECT 1 FROM s{j} t WHERE t.team = p.team AND t.name = p.name)" for j in range(i)]) or "TRUE"
        parts.append(
            f"""s{i} AS (SELECT team, '{slot}' AS starter_slot, {i + 1} AS slot_order, name, position, score FROM pl p WHERE {taken}
  QUALIFY ROW_NUMBER() OVER (PARTITION BY team ORDER BY position IN {allowed} DESC,
    score + CASE WHEN position IN {natural} THEN {bonus} ELSE 0 END DESC, COALESCE(NULLIF(rank, 0), 9999), name DESC) = 1)"""
        )
    return ",\n".join(parts)


_PLAYERS = """
pl AS (SELECT c_nationkey AS team, c_name AS name, ['pg', 'guard', 'wing', 'forward', 'big'][1 + c_custkey % 5] AS position,
  FLOOR(c_acctbal) / 16384.0 AS score, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 50 AS DOUBLE) END AS rank, c_custkey AS id FROM customer)"""


def _players(spark, folder):
    positions = F.array(*[F.lit(p) for p in ("pg", "guard", "wing", "forward", "big")])
    return table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("team"),
        F.col("c_name").alias("name"),
        F.element_at(positions, (F.col("c_custkey") % 5 + 1).cast("int")).alias("position"),
        (F.floor("c_acctbal") / 16384.0).alias("score"),
        F.when(F.col("c_custkey") % 3 == 0, (F.col("c_custkey") % 50).cast("double")).alias("rank"),
        F.col("c_custkey").alias("id"),
    )


@query(
    "lineup_starters",
    f"""
WITH {_PLAYERS}, {_pick_sql()}
SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4
""",
)
def lineup_starters(spark, folder):
    return starters(_players(spark, folder), ["team"])


@query(
    "lineup_bench",
    f"""
WITH {_PLAYERS}, {_pick_sql()},
st AS (SELECT team, name FROM s0 UNION ALL SELECT team, name FROM s1 UNION ALL SELECT team, name FROM s2 UNION ALL SELECT team, name FROM s3
  UNION ALL SELECT team, name FROM s4)
SELECT p.team, p.name, p.position, p.score, p.rank, p.id,
  ROW_NUMBER() OVER (PARTITION BY p.team ORDER BY score DESC, COALESCE(NULLIF(rank, 0), 9999), p.name, id) AS bench_order
FROM pl p WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.team = p.team AND st.name = p.name)
""",
)
def lineup_bench(spark, folder):
    players = _players(spark, folder)
    return bench(players, starters(players, ["team"]), ["team"], "id")
