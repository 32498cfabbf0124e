"""Keyed assembly and entity matching over customers, suppliers, parts and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tipoff.functions.text import normalize_text, team_key
from tipoff.operators import joins as J
from tipoff.operators import matching as X
from tipoff.operators.ranking import latest_per_key
from tipoff.plans import features as PF
from tipoff.plans.registry import (
    CUSTOMER_YEARS,
    SUPPLIER_YEARS,
    customer_years,
    query,
    r6,
    supplier_years,
    table,
)
from tipoff.session import pinned


@query(
    "lagged_lookup",
    f"""
WITH {CUSTOMER_YEARS}
SELECT a.entity, a.season, a.spend, c.c_mktsegment AS info_c_mktsegment, b.spend AS prior_spend, b.n_orders AS prior_n_orders,
  ROUND(a.spend - b.spend, 2) AS change
FROM cy a LEFT JOIN customer c ON c.c_custkey = a.entity LEFT JOIN cy b ON b.entity = a.entity AND b.season = a.season - 1
""",
)
def lagged_lookup(spark, folder):
    cy = customer_years(spark, folder)
    info = table(spark, folder, "customer").select(F.col("c_custkey").alias("entity"), "c_mktsegment")
    out = J.lookup(cy.drop("n_orders"), info, ["entity"], prefix="info_")
    out = J.lookup(out, cy, ["entity", "season"], prefix="prior_", lag={"season": 1})
    return out.withColumn("change", F.round(F.col("spend") - F.col("prior_spend"), 2))


@query(
    "last_duplicate_lookup",
    """
SELECT c_custkey, c_name, o.o_orderkey AS last_o_orderkey, o.o_totalprice AS last_o_totalprice FROM customer
LEFT JOIN (SELECT * FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) o
  ON o.o_custkey = c_custkey
""",
)
def last_duplicate_lookup(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice", "o_orderdate"
    )
    customers = table(spark, folder, "customer").select("c_custkey", "c_name")
    return J.lookup(customers, orders, ["c_custkey"], order=["o_orderdate", "o_orderkey"], prefix="last_", drop=["o_orderdate"])


@query(
    "attach_children",
    "SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON o_custkey = c_custkey",
)
def attach_children(spark, folder):
    orders = table(spark, folder, "orders").withColumnRenamed("o_custkey", "c_custkey")
    customers = table(spark, folder, "customer").select("c_custkey", "c_name")
    out = J.attach_children(customers, orders, ["c_custkey"], ["o_orderkey", "o_totalprice"], "order")
    return out.select("c_custkey", "c_name", "order.o_orderkey", "order.o_totalprice")


@query(
    "game_four_lookups",
    f"""
WITH {CUSTOMER_YEARS}, {SUPPLIER_YEARS},
f AS (SELECT season, 'c' || entity AS entity, spend AS strength FROM cy UNION ALL SELECT season, 's' || entity, revenue FROM sy),
g AS (SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_quantity, CAST(year(l.l_shipdate) AS INTEGER) AS season,
    'c' || o.o_custkey AS home, 's' || l.l_suppkey AS away FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey)
SELECT g.*, hn.strength AS home_now, hp.strength AS home_prior, an.strength AS away_now, ap.strength AS away_prior,
  ROUND(ap.strength - hp.strength - 3.5, 2) AS expected_margin
FROM g JOIN f hn ON hn.season = g.season AND hn.entity = g.home JOIN f an ON an.season = g.season AND an.entity = g.away
LEFT JOIN f hp ON hp.season = g.season - 1 AND hp.entity = g.home LEFT JOIN f ap ON ap.season = g.season - 1 AND ap.entity = g.away
""",
)
def game_four_lookups(spark, folder):
    features = customer_years(spark, folder).select("season", F.concat(F.lit("c"), "entity").alias("entity"), F.col("spend").alias("strength")).unionByName(
        supplier_years(spark, folder).select(
            "season", F.concat(F.lit("s"), "entity").alias("entity"), F.col("revenue").alias("strength")
        )
    )
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("c"), "o_custkey").alias("home"))
    games = (
        table(spark, folder, "lineitem")
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.year("l_shipdate").alias("season"),
                F.concat(F.lit("s"), "l_suppkey").alias("away"))
        .join(orders, "l_orderkey")
    )
    out = J.both_seasons(games, features, ["strength"], home="home", away="away", team="entity")
    return out.select(
        *games.columns,
        F.col("home_now_strength").alias("home_now"),
        F.col("home_prior_strength").alias("home_prior"),
        F.col("away_now_strength").alias("away_now"),
        F.col("away_prior_strength").alias("away_prior"),
        F.round(F.col("away_prior_strength") - F.col("home_prior_strength") - 3.5, 2).alias("expected_margin"),
    )


@query(
    "merged_sources",
    """
WITH o AS (SELECT o_custkey AS key, COUNT(*) AS n_orders, MAX(o_orderpriority) AS label FROM orders GROUP BY 1),
e AS (SELECT user_id AS key, COUNT(*) AS n_events, MAX(event_type) AS label FROM events GROUP BY 1),
s AS (SELECT s_suppkey AS key, s_acctbal FROM supplier)
SELECT COALESCE(o.key, e.key, s.key) AS key, COALESCE(o.label, e.label) AS label, n_orders, n_events, s_acctbal
FROM o FULL JOIN e ON o.key = e.key FULL JOIN s ON s.key = COALESCE(o.key, e.key)
""",
)
def merged_sources(spark, folder):
    o = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("key")).agg(
        F.count("*").alias("n_orders"), F.max("o_orderpriority").alias("label")
    )
    e = table(spark, folder, "events").groupBy(F.col("user_id").alias("key")).agg(
        F.count("*").alias("n_events"), F.max("event_type").alias("label")
    )
    s = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("key"), "s_acctbal")
    return J.merge_sources([o, e, s], ["key"], shared=["label"])


@query(
    "override_join",
    """
SELECT c_custkey, c_name, CASE WHEN s_suppkey IS NOT NULL AND s_acctbal > 3000 THEN s_name ELSE c_name END AS projected
FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey
""",
)
def override_join(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", F.col("c_name").alias("projected"))
    changes = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_name", "s_acctbal")
    out = J.override(customers, changes, ["c_custkey"], "projected", "s_name", F.col("s_acctbal") > 3000)
    return out.select("c_custkey", "c_name", "projected")


@query(
    "supplemented_players",
    """
WITH base AS (SELECT o_custkey AS id, CAST(COUNT(*) AS DOUBLE) AS minutes, FALSE AS added FROM orders GROUP BY 1)
SELECT id, minutes, added FROM base
UNION ALL SELECT c_custkey, 0.0, TRUE FROM customer WHERE c_custkey NOT IN (SELECT id FROM base)
""",
)
def supplemented_players(spark, folder):
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    base = (
        table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").cast("double").alias("minutes"))
        .join(customers, "id").withColumn("added", F.lit(False))
    )
    out = J.supplement(
        base, customers, [["id"], ["name"]], "id", {"minutes": F.lit(0.0), "added": F.lit(True)}
    )
    return out.select("id", "minutes", "added")


_LETTERS = "translate(lpad(CAST({} AS VARCHAR), 9, '0'), '0123456789', 'abcdefghij')"


@query(
    "supplement_players",
    f"""
WITH seen AS (SELECT o_custkey AS j, MAX(o_orderpriority = '1-URGENT') AS by_id, MAX(o_orderpriority = '2-HIGH') AS by_name
  FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1),
entries AS (SELECT c_custkey AS i, c_custkey // 2 AS id, (c_custkey + 1) // 2 AS person FROM customer),
fresh AS (SELECT * FROM entries WHERE id NOT IN (SELECT j FROM seen WHERE by_id) AND person NOT IN (SELECT j FROM seen WHERE by_name)),
chains AS (SELECT *, i - ROW_NUMBER() OVER (ORDER BY i) AS chain FROM fresh),
kept AS (SELECT * FROM chains QUALIFY ROW_NUMBER() OVER (PARTITION BY chain ORDER BY i) % 2 = 1)
SELECT CASE WHEN by_id THEN lpad(CAST(j AS VARCHAR), 9, '0') END AS player_id,
  CASE WHEN by_name THEN 'Person ' || {_LETTERS.format("j")} ELSE 'Nobody ' || {_LETTERS.format("j")} END AS player_name,
  'Market ' || chr(CAST(97 + j % 25 AS INTEGER)) AS team_market, 12.5 AS minutes, NULL AS source_row_type, NULL AS season FROM seen
UNION ALL SELECT lpad(CAST(id AS VARCHAR), 9, '0'), 'Person ' || {_LETTERS.format("person")},
  'Market ' || chr(CAST(97 + person % 25 AS INTEGER)), 0.0, 'competition_team_players_placeholder', 2024 FROM kept
""",
)
def supplement_players(spark, folder):
    """Entries 2m and 2m + 1 share an id, 2m + 1 and 2m + 2 a name: long chains, cut where the statistics know one."""

    def code(c):
        return F.lpad(c.cast("string"), 9, "0")

    def label(word, c):
        return F.concat(F.lit(word + " "), F.translate(code(c), "0123456789", "abcdefghij"))

    def market(c):
        return F.concat(F.lit("Market "), F.expr("char(97 + {} % 25)".format(c)))

    priority = F.col("o_orderpriority")
    seen = table(spark, folder, "orders").where((F.col("o_orderstatus") == "P") & priority.isin("1-URGENT", "2-HIGH"))
    seen = seen.groupBy(F.col("o_custkey").alias("j")).agg(
        F.max(priority == "1-URGENT").alias("by_id"), F.max(priority == "2-HIGH").alias("by_name")
    )
    players = seen.select(
        F.when(F.col("by_id"), code(F.col("j"))).alias("player_id"),
        F.when(F.col("by_name"), label("Person", F.col("j"))).otherwise(label("Nobody", F.col("j"))).alias("player_name"),
        market("j").alias("team_market"),
        F.lit(None).cast("string").alias("team_name"),
        F.lit(12.5).alias("minutes"),
        F.lit(None).cast("int").alias("season"),
    )
    entries = table(spark, folder, "customer").selectExpr("c_custkey div 2 as id", "(c_custkey + 1) div 2 as person", "c_mktsegment")
    none = F.lit(None).cast("string")
    roster = entries.select(
        F.lit("1").alias("competitionId"), F.lit("1").alias("teamId"), market("person").alias("teamMarket"), none.alias("teamName"),
        none.alias("conferenceId"), code(F.col("id")).alias("playerId"), label("Person", F.col("person")).alias("fullName"),
        none.alias("classYr"), F.col("c_mktsegment").alias("position"), none.alias("height"),
    )
    out = PF.supplement_players(players, roster, 2024)
    return out.select("player_id", "player_name", "team_market", "minutes", "source_row_type", "season")


@query(
    "player_moves",
    f"""
WITH m AS (
  SELECT CAST(year(o.o_orderdate) AS INTEGER) AS season, o.o_custkey AS player, l.l_suppkey AS team, COUNT(*) AS n
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY 1, 2, 3),
top AS (SELECT * FROM m QUALIFY ROW_NUMBER() OVER (PARTITION BY season, player ORDER BY n DESC, team DESC) = 1),
{SUPPLIER_YEARS},
t AS (SELECT a.*, b.team AS nxt, c.team AS prv, COALESCE(b.team <> a.team, FALSE) AS leaves FROM top a
  LEFT JOIN top b ON b.player = a.player AND b.season = a.season + 1 LEFT JOIN top c ON c.player = a.player AND c.season = a.season - 1),
v AS (SELECT season AS source_season, player, n, CASE WHEN leaves THEN nxt ELSE team END AS team, CASE WHEN leaves THEN team ELSE prv END AS source
  FROM t WHERE leaves OR COALESCE(prv <> team, FALSE)),
r AS (SELECT sy.season, s_suppkey, s_acctbal / 512 AS em, s_suppkey % 350 AS rnk FROM sy JOIN supplier ON s_suppkey = sy.entity),
x AS (SELECT v.*, COALESCE(GREATEST(LEAST(1 + em / 60.0 + CASE WHEN rnk <= 25 THEN 0.10 WHEN rnk <= 50 THEN 0.06 WHEN rnk <= 100 THEN 0.03
    WHEN rnk >= 300 THEN -0.12 WHEN rnk >= 250 THEN -0.08 WHEN rnk >= 200 THEN -0.04 ELSE 0 END, 1.45), 0.55), 1.0) AS f
  FROM v LEFT JOIN r ON r.season = v.source_season AND r.s_suppkey = v.source)
SELECT CAST(player AS VARCHAR) AS player_id, source_season, source_season + 1 AS season, a.s_name AS team, b.s_name AS source_team,
  ROUND(f, 6) AS multiplier, ROUND(n * f, 6) AS points FROM x JOIN supplier a ON a.s_suppkey = x.team JOIN supplier b ON b.s_suppkey = x.source
""",
)
def player_moves(spark, folder):
    """The most frequent supplier of a customer's year is its team; who has another one next year or had one before has moved."""
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("player"), F.year("o_orderdate").alias("season")
    )
    lines = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("team"))
    played = lines.join(orders, "l_orderkey").groupBy("season", "player", "team").agg(F.count("*").alias("n"))
    names = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("team"), F.col("s_name").alias("name"))
    top = latest_per_key(played, ["season", "player"], ["n", "team"]).join(names, "team")
    after = top.select((F.col("season") - 1).alias("season"), "player", F.col("team").alias("next_team_id"), F.col("name").alias("next_team_market"))
    before = top.select((F.col("season") + 1).alias("season"), "player", F.col("name").alias("prior_team_market"))
    rows = top.join(after, ["season", "player"], "left").join(before, ["season", "player"], "left")
    blank = [c for c in (*PF._TRANSFER_PERSON, *PF._TRANSFER_STATS) if c not in ("player_id", "points")]
    players = rows.select(
        "season", F.col("player").cast("string").alias("player_id"), F.col("team").alias("team_id"), F.col("name").alias("team_market"),
        "next_team_id", "next_team_market", "prior_team_market", F.lit("true").alias("is_transfer"), F.lit("").alias("team_key"),
        F.col("n").alias("points"), *[F.lit(None).cast("string").alias(c) for c in blank],
    )
    none = F.lit(None).cast("string")
    strength = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("entity"), team_key(F.col("s_name")).alias("source_team_key"), (F.col("s_acctbal") / 512).alias("source_kenpom_adj_em"),
        (F.col("s_suppkey") % 350).alias("source_kenpom_rank_adj_em"), none.alias("source_kenpom_conference"),
    )
    context = supplier_years(spark, folder).select("entity", F.col("season").alias("source_season")).join(strength, "entity").drop("entity")
    return PF.transfer_moves(players, context, current_roster=True).select(
        "player_id", "source_season", "season", "team", "source_team",
        r6("source_context_multiplier").alias("multiplier"), r6("context_adjusted_points").alias("points"),
    )


@query(
    "complete_components",
    """
WITH p AS (SELECT o_custkey AS entity, CAST(year(o_orderdate) AS INTEGER) AS season, o_orderstatus AS model,
    MAX(o_totalprice) AS v FROM orders GROUP BY 1, 2, 3)
SELECT entity, season, MAX(v) FILTER (model = 'F') AS "F", MAX(v) FILTER (model = 'O') AS "O" FROM p
GROUP BY 1, 2 HAVING COUNT(*) FILTER (model IN ('F', 'O')) = 2
""",
)
def complete_components(spark, folder):
    p = table(spark, folder, "orders").groupBy(
        F.col("o_custkey").alias("entity"), F.year("o_orderdate").alias("season"), F.col("o_orderstatus").alias("model")
    ).agg(F.max("o_totalprice").alias("v"))
    return J.keep_complete(p, ["entity", "season"], "model", ["F", "O"], "v")


@query(
    "stacked_feeds",
    """
SELECT source, id, name, MIN(extra) AS extra FROM (
  SELECT 'customer' AS source, c_custkey AS id, lower(c_mktsegment) AS name, c_mktsegment AS extra FROM customer
  UNION ALL SELECT 'supplier', s_suppkey, lower(s_name), NULL FROM supplier
  UNION ALL SELECT 'part', p_partkey % 100, lower(p_name), p_type FROM part) GROUP BY 1, 2, 3
""",
)
def stacked_feeds(spark, folder):
    def feed(name, source, key, label, extra=None):
        columns = [F.lit(source).alias("source"), F.expr(key).alias("id"), normalize_text(F.col(label)).alias("key"), F.lower(label).alias("name")]
        if extra:
            columns.append(F.col(extra).alias("extra"))
        return table(spark, folder, name).select(*columns)

    stacked = J.union_all(
        [
            feed("customer", "customer", "c_custkey", "c_mktsegment", "c_mktsegment"),
            feed("supplier", "supplier", "s_suppkey", "s_name"),
            feed("part", "part", "p_partkey % 100", "p_name", "p_type"),
        ]
    )
    return J.distinct_first(stacked, ["source", "key", "id"], ["extra", "name"]).select("source", "id", "name", "extra")


def _ledger(spark, folder):
    """Customers listed with partly wrong ids and sources."""
    c = table(spark, folder, "customer")
    third = F.col("c_custkey") % 4
    return c.select(
        F.col("c_custkey").alias("ledger_id"),
        F.when(third == 0, F.col("c_custkey").cast("string")).otherwise("").alias("player_id"),
        F.when(third == 3, F.concat(F.lit("nobody "), F.col("c_name"))).otherwise(F.concat(F.lit("p"), F.col("c_custkey") % 40)).alias("player_key"),
        F.when(third == 1, F.col("c_nationkey")).otherwise(-1).cast("string").alias("source_team_key"),
    )


@query(
    "cascade_match",
    """
WITH people AS (SELECT CAST(c_custkey AS VARCHAR) AS id, 'p' || (c_custkey % 40) AS name, CAST(c_nationkey AS VARCHAR) AS src, c_custkey AS pick FROM customer),
ledger AS (
  SELECT c_custkey AS ledger_id, CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE '' END AS id,
    CASE WHEN c_custkey % 4 = 3 THEN 'nobody ' || c_name ELSE 'p' || (c_custkey % 40) END AS name,
    CASE WHEN c_custkey % 4 = 1 THEN CAST(c_nationkey AS VARCHAR) ELSE '-1' END AS src FROM customer),
ns AS (SELECT name, src, MAX(pick) AS pick FROM people GROUP BY 1, 2 HAVING COUNT(*) = 1),
nn AS (SELECT name, MAX(pick) AS pick FROM people GROUP BY 1 HAVING COUNT(*) = 1)
SELECT l.ledger_id, CASE WHEN p.pick IS NOT NULL THEN 'player_id' WHEN ns.pick IS NOT NULL THEN 'player_name_source_team'
  WHEN nn.pick IS NOT NULL THEN 'player_name_only' ELSE 'no_match' END AS match_method, COALESCE(p.pick, ns.pick, nn.pick) AS pick
FROM ledger l LEFT JOIN people p ON p.id = l.id LEFT JOIN ns ON ns.name = l.name AND ns.src = l.src LEFT JOIN nn ON nn.name = l.name
""",
)
def cascade_match(spark, folder):
    people = table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("player_id"),
        F.concat(F.lit("p"), F.col("c_custkey") % 40).alias("player_key"),
        F.col("c_nationkey").cast("string").alias("source_team_key"),
        F.col("c_custkey").alias("pick"),
    )
    out = X.cascade_match(_ledger(spark, folder), people, payload=["pick"])
    return out.select("ledger_id", F.coalesce("match_method", F.lit("no_match")).alias("match_method"), "person.pick")


@query(
    "alias_overlap_latest",
    """
WITH jobs AS (
  SELECT CAST(year(l_shipdate) AS INTEGER) AS season, l_suppkey AS team, string_split(p_name, ' ') AS keys
  FROM lineitem JOIN part ON p_partkey = l_partkey),
j AS (SELECT DISTINCT season, team, UNNEST(keys) AS key FROM jobs),
asked AS (SELECT p_partkey AS ask, p_partkey % (SELECT COUNT(*) FROM supplier) AS own, UNNEST(string_split(p_name, ' ')) AS key FROM part),
best AS (SELECT key, team, MAX(season) AS season FROM j GROUP BY 1, 2),
hits AS (SELECT a.ask, b.season, b.team FROM asked a JOIN best b ON b.key = a.key AND b.team <> a.own)
SELECT ask, MAX(season) AS last_seen_season FROM hits GROUP BY 1
""",
)
def alias_overlap_latest(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", F.split("p_name", " ").alias("keys"))
    jobs = (
        table(spark, folder, "lineitem")
        .select(F.year("l_shipdate").alias("season"), F.col("l_suppkey").alias("team"), F.col("l_partkey").alias("p_partkey"))
        .join(parts, "p_partkey")
    )
    n = table(spark, folder, "supplier").count()
    asked = parts.select(F.col("p_partkey").alias("ask"), (F.col("p_partkey") % n).alias("team"), "keys")
    return X.latest_by_any_key(asked, jobs, "ask", "keys", "team", "season", []).select("ask", "last_seen_season")


def _misspelled(spark, folder):
    """Part names with one letter dropped, doubled or kept, and some that are far off."""
    name = F.col("p_name")
    at = (F.col("p_partkey") % F.length("p_name") + 1).cast("int")
    cut = F.concat(F.substring("p_name", F.lit(1), at - 1), F.substring("p_name", at + 1, F.lit(100)))
    doubled = F.concat(F.substring("p_name", F.lit(1), at), F.substring("p_name", at, F.lit(100)))
    which = F.col("p_partkey") % 4
    key = F.when(which == 0, name).when(which == 1, cut).when(which == 2, doubled).otherwise(F.reverse("p_name"))
    return table(spark, folder, "part").select("p_partkey", normalize_text(key).alias("key"))


# Matching blocks of pairs of names in SQL: the longest common block of a pair (first in a, then first in b) leaves the
# parts before and after it, which are pairs of their own.
_RATIOS = """
asked AS (SELECT p_partkey, lower(CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN left(p_name, pos - 1) || substr(p_name, pos + 1)
    WHEN 2 THEN left(p_name, pos) || substr(p_name, pos) ELSE reverse(p_name) END) AS raw
  FROM (SELECT *, CAST(p_partkey % length(p_name) + 1 AS INTEGER) AS pos FROM part)),
keyed AS (SELECT p_partkey, trim(regexp_replace(raw, '[^a-z0-9]+', ' ', 'g')) AS key FROM asked),
names AS (SELECT DISTINCT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS other, p_name FROM part),
pairs AS (SELECT k.key, n.other FROM (SELECT DISTINCT key FROM keyed) k, names n),
boxes AS (
  SELECT key, other, key AS a, other AS b, 0 AS matched FROM pairs
  UNION ALL
  SELECT key, other, side.a, side.b, side.matched FROM (
    SELECT key, other, unnest([
      {'a': substr(a, 1, hit.i), 'b': substr(b, 1, instr(b, substr(a, hit.i + 1, hit.n)) - 1), 'matched': hit.n},
      {'a': substr(a, hit.i + hit.n + 1), 'b': substr(b, instr(b, substr(a, hit.i + 1, hit.n)) + hit.n), 'matched': 0}]) AS side
    FROM (SELECT *, list_filter(flatten(list_transform(range(length(a), 0, -1), lambda n:
        list_transform(range(0, length(a) - n + 1), lambda i: {'n': n, 'i': i}))),
        lambda x: instr(b, substr(a, x.i + 1, x.n)) > 0)[1] AS hit FROM boxes WHERE a <> '' AND b <> '')
    WHERE hit IS NOT NULL)),
scored AS (SELECT key, other, 2.0 * SUM(matched) / (length(key) + length(other)) AS score FROM boxes GROUP BY 1, 2),
best AS (SELECT * FROM scored WHERE score > 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY key ORDER BY score DESC, other) = 1)"""


@query(
    "fuzzy_crosswalk",
    f"""
WITH RECURSIVE {_RATIOS},
m AS (SELECT k.*, k.key = 'gnir llams' AS skip, b.other, b.score, n.p_name FROM keyed k LEFT JOIN best b USING (key) LEFT JOIN names n USING (other)),
t AS (SELECT *, CASE WHEN skip THEN 'known_unmatched' WHEN score IS NULL THEN 'no_match' WHEN score = 1 THEN 'canonical_exact'
  WHEN score >= 0.94 THEN 'fuzzy_high' WHEN score >= 0.86 THEN 'fuzzy_review' ELSE 'low_confidence' END AS match_type,
  CASE WHEN skip THEN 0.0 ELSE coalesce(score, 0.0) END AS match_score FROM m)
SELECT p_partkey, key, CASE WHEN NOT skip THEN other END AS known_key, CASE WHEN NOT skip THEN p_name END AS known_p_name, match_type,
  ROUND(match_score, 6) AS match_score,
  match_type <> 'known_unmatched' AND (match_score < 0.94 OR match_type IN ('fuzzy_review', 'low_confidence', 'no_match')) AS needs_review
FROM t
""",
)
def fuzzy_crosswalk(spark, folder):
    universe = table(spark, folder, "part").select(normalize_text(F.col("p_name")).alias("key"), "p_name").distinct()
    sources = _misspelled(spark, folder)
    out = X.crosswalk(sources, universe, "key", ["p_name"], "known", known_unmatched=["gnir llams"])
    return out.withColumn("match_score", r6("match_score"))


@query(
    "fuzzy_lookup",
    f"""
WITH RECURSIVE {_RATIOS}
SELECT p_partkey, key, other AS match, ROUND(score, 6) AS score FROM keyed LEFT JOIN (SELECT * FROM best WHERE score >= 0.94) USING (key)
""",
)
def fuzzy_lookup(spark, folder):
    universe = table(spark, folder, "part").select(normalize_text(F.col("p_name")).alias("key")).distinct()
    asked = _misspelled(spark, folder)
    found = X.best_matches(asked, universe, "key", floor=0.94, below=False)
    return asked.join(found, "key", "left").select("p_partkey", "key", F.col("other").alias("match"), r6("score").alias("score"))


def _sentence_names(spark, folder):
    """The first two words of every sentence, as names."""
    said = table(spark, folder, "documents").select(F.explode(F.split("text", "[.\\n]+")).alias("s"))
    # a third word must follow
    first = F.regexp_extract(F.lower("s"), "^[^a-z]*+([a-z]++[^a-z]++[a-z]++)[^a-z]++[a-z]", 1)
    return said.select(first.alias("w")).where("w != ''").select(F.regexp_replace("w", "[^a-z]+", " ").alias("key")).distinct()


@query("fuzzy_names")
def fuzzy_names(spark, folder):
    """Names with one letter missing, looked up among all names of the documents (160,000 at the largest scale)."""
    universe = pinned(_sentence_names(spark, folder))  # the documents are read once
    at = (F.pmod(F.crc32("key"), F.length("key")) + 1).cast("int")
    cut = F.concat(F.substring("key", F.lit(1), at - 1), F.substring("key", at + 1, F.length("key")))
    asked = universe.select(F.col("key").alias("name"), cut.alias("key"))
    found = X.best_matches(asked, universe, "key")
    return asked.join(found, "key", "left").select("name", "key", F.col("other").alias("match"), r6("score").alias("score"))


@query(
    "unmatched_report",
    """
SELECT c_custkey, c_name, 'no_order' AS reason FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
""",
)
def unmatched_report(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"))
    rows = table(spark, folder, "customer").select("c_custkey", "c_name", F.lit("no_order").alias("reason"))
    return J.missing_rows(orders, rows, [["c_custkey"]])


@query(
    "season_facts",
    f"""
WITH {SUPPLIER_YEARS},
pre AS (SELECT entity, season + 1 AS season, revenue AS pre FROM sy),
style AS (SELECT l_suppkey AS entity, CAST(year(l_shipdate) AS INTEGER) AS season, AVG(ROUND(l_discount * 100)) AS tempo FROM lineitem GROUP BY 1, 2)
SELECT sy.season, sy.entity, s.s_name AS team_name, n_lines - n_returned AS wins, n_returned AS losses,
  ROUND((n_lines - n_returned) / NULLIF(n_lines, 0), 6) AS win_pct, pre AS preseason, revenue AS final,
  ROUND(revenue - pre, 2) AS over_expected, ROUND(tempo, 6) AS tempo
FROM sy LEFT JOIN supplier s ON s.s_suppkey = sy.entity LEFT JOIN pre USING (entity, season) LEFT JOIN style USING (entity, season)
""",
)
def season_facts(spark, folder):
    sy = supplier_years(spark, folder)
    names = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_name").alias("team_name"))
    pre = sy.select("entity", (F.col("season") + 1).alias("season"), F.col("revenue").alias("preseason"))
    style = table(spark, folder, "lineitem").groupBy(
        F.col("l_suppkey").alias("entity"), F.year("l_shipdate").alias("season")
    ).agg(F.avg(F.round(F.col("l_discount") * 100)).alias("tempo"))
    keys = ["entity", "season"]
    out = J.lookup(J.lookup(J.lookup(sy, names, ["entity"]), pre, keys), style, keys)
    wins = F.col("n_lines") - F.col("n_returned")
    return out.select(
        "season", "entity", "team_name", wins.alias("wins"), F.col("n_returned").alias("losses"),
        r6(wins / F.nullif(F.col("n_lines"), F.lit(0))).alias("win_pct"), "preseason", F.col("revenue").alias("final"),
        F.round(F.col("revenue") - F.col("preseason"), 2).alias("over_expected"), r6("tempo").alias("tempo"),
    )


@query(
    "transfer_moves",
    f"""
WITH m AS (
  SELECT CAST(year(o.o_orderdate) AS INTEGER) AS season, o.o_custkey AS player, l.l_suppkey AS team, COUNT(*) AS n
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY 1, 2, 3),
top AS (SELECT season, player, team FROM m QUALIFY ROW_NUMBER() OVER (PARTITION BY season, player ORDER BY n DESC, team DESC) = 1),
{SUPPLIER_YEARS}
SELECT a.season AS source_season, b.season, a.player, a.team AS source_team, b.team, sy.revenue AS source_strength
FROM top a JOIN top b ON b.player = a.player AND b.season = a.season + 1 AND b.team <> a.team
LEFT JOIN sy ON sy.entity = a.team AND sy.season = a.season
""",
)
def transfer_moves(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("player"), F.year("o_orderdate").alias("season")
    )
    m = (
        table(spark, folder, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("team"))
        .join(orders, "l_orderkey").groupBy("season", "player", "team").agg(F.count("*").alias("n"))
    )
    top = latest_per_key(m, ["season", "player"], ["n", "team"]).drop("n")
    before = top.select(
        F.col("season").alias("source_season"), (F.col("season") + 1).alias("season"), "player", F.col("team").alias("source_team")
    )
    moves = top.join(before, ["season", "player"]).where(F.col("team") != F.col("source_team"))
    strength = supplier_years(spark, folder).select(
        F.col("season").alias("source_season"), F.col("entity").alias("source_team"), F.col("revenue").alias("source_strength")
    )
    return J.lookup(moves, strength, ["source_season", "source_team"])


