"""Pages, embedded JSON and event payloads."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tipoff.functions.text import page_text as visible_text
from tipoff.sources import files, nested, pages
from tipoff.plans.registry import query, table
from tipoff.session import shared_folder, shuffle_width


@query(
    "page_text",
    r"""
WITH t AS (SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS t FROM pages),
e AS (SELECT page_id, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM t),
s AS (SELECT page_id, trim(regexp_replace(t, '[ \t\n\r\f]+', ' ', 'g')) AS t FROM e)
SELECT page_id, md5(t) AS text_md5, length(t) AS size FROM s
""",
)
def page_text(spark, folder):
    text = visible_text(F.col("html"))
    return table(spark, folder, "pages").select("page_id", F.md5(text).alias("text_md5"), F.length(text).alias("size"))


@query(
    "page_links",
    r"""
WITH l AS (
  SELECT page_id, UNNEST(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref="([^"]*)"[^>]*>(.*?)</a>', 1)) AS url,
    UNNEST(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref="([^"]*)"[^>]*>(.*?)</a>', 2)) AS raw FROM pages),
t AS (SELECT page_id, url, regexp_replace(raw, '<[^>]+>', ' ', 'g') AS t FROM l),
e AS (SELECT page_id, url, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM t)
SELECT page_id, url, trim(regexp_replace(t, '[ \t\n\r\f]+', ' ', 'g')) AS label, COUNT(*) AS n FROM e GROUP BY 1, 2, 3
""",
)
def page_links(spark, folder):
    found = pages.links(table(spark, folder, "pages"), ["page_id"])
    return found.groupBy("page_id", "url", "label").agg(F.count("*").alias("n"))


@query(
    "page_checks",
    r"""
SELECT page_id, contains(lower(html), 'attention required! | cloudflare') OR contains(lower(html), 'sorry, you have been blocked') AS blocked,
  (contains(html, 'D-I Men&#39;s Basketball') OR contains(html, 'D-I Men''s Basketball')) AND contains(html, 'NET Ranking') AS ranking,
  NULLIF(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '') AS title
FROM pages
""",
)
def page_checks(spark, folder):
    html = F.col("html")
    title = F.nullif(F.regexp_extract(html, "(?s)<title>(.*?)</title>", 1), F.lit(""))
    return table(spark, folder, "pages").select(
        "page_id", pages.is_blocked(html).alias("blocked"), pages.is_net_ranking_page(html).alias("ranking"), title.alias("title")
    )


def _order_pages(spark, folder):
    """One selection sheet per order, written out as a page."""
    line = F.struct(
        "l_linenumber", F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_quantity").cast("int").alias("qty")
    )
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("rows"))
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    filler = "".join("<td>7</td><td>3-4</td>" for _ in range(8))

    def row(r):
        return F.concat(
            F.lit("<tr><td> Part &amp; "), r["part"].cast("string"), F.lit("</td><td>S"), r["supplier"].cast("string"),
            F.lit("</td><td>"), r["qty"].cast("string"), F.lit("</td><td>--</td><td>5</td><td>6</td>" + filler + "<td>1</td><td>2</td></tr>"),
        )

    body = F.array_join(F.transform("rows", row), "")
    html = F.concat(
        F.lit("<html><body><h1>D-I Men&#39;s Basketball NET Ranking thru games "), F.date_format("o_orderdate", "MM/dd/yyyy"),
        F.lit("</h1><table><tr><th>Team</th></tr>"), body, F.lit("</table></body></html>"),
    )
    # landed pages come in many files; the small derived table is spread the same way, before its rows are written out
    rows = lines.join(orders, "l_orderkey")
    return rows.repartition(shuffle_width(rows), "l_orderkey").select("l_orderkey", html.alias("html"))


@query(
    "selection_sheets",
    """
SELECT l_orderkey, CAST(year(o_orderdate) AS INTEGER) AS season,
  CAST(year(o_orderdate) - 1 AS VARCHAR) || '-' || right(CAST(year(o_orderdate) AS VARCHAR), 2) AS season_label,
  CAST(o_orderdate AS DATE) AS selection_thru_games, 'Part & ' || l_partkey AS team, 'S' || l_suppkey AS conference,
  CAST(l_quantity AS INTEGER) AS net_rank, CAST(NULL AS INTEGER) AS previous_net_rank, 3 AS overall_record_wins,
  COUNT(*) AS n
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL
""",
)
def selection_sheets(spark, folder):
    rows = pages.selection_rows(_order_pages(spark, folder), ["l_orderkey"])
    keep = [
        "l_orderkey", "season", "season_label", "selection_thru_games", "team", "conference", "net_rank", "previous_net_rank",
        "overall_record_wins",
    ]
    return rows.groupBy(*keep).agg(F.count("*").alias("n"))


@query(
    "embedded_rankings",
    """
SELECT page_id, page_id % 9 + 2015 AS ranking_year, 'team ' || (page_id % 7) AS team, CAST(page_id % 300 + 1 AS DOUBLE) AS rank,
  CAST(length(url) AS DOUBLE) AS commits
FROM pages
""",
)
def embedded_rankings(spark, folder):
    item = F.struct(
        F.struct(F.concat(F.lit("team "), F.col("page_id") % 7).alias("name")).alias("organization"),
        F.lit(0).alias("overallConsensusRank"),
        (F.col("page_id") % 300 + 1).alias("overallRank"),
        F.length("url").alias("commits"),
    )
    model = F.struct((F.col("page_id") % 9 + 2015).alias("year"))
    body = F.to_json(
        F.struct(F.struct(F.struct(F.struct(model.alias("relatedModel"), F.array(item).alias("list")).alias("teamData")).alias("pageProps")).alias("props"))
    )
    script = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), body, F.lit("</script></body>"))
    html = F.concat(F.regexp_replace("html", "</body>.*$", ""), script)
    landed = table(spark, folder, "pages").select("page_id", pages.embedded_json(html).alias("json"))
    rows = nested.recruiting_rankings(landed)
    return rows.select("page_id", F.col("ranking_year").cast("long").alias("ranking_year"), "team", "rank", "commits")


@query(
    "event_envelopes",
    """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type AS kind FROM events
""",
)
def event_envelopes(spark, folder):
    row = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "kind": "'), F.col("event_type"), F.lit('"}'))
    which = F.col("event_id") % 4
    body = (
        F.when(which == 0, F.concat(F.lit("["), row, F.lit("]")))
        .when(which == 1, F.concat(F.lit('{"data": ['), row, F.lit("]}")))
        .when(which == 2, F.concat(F.lit('{"rows": ['), row, F.lit("]}")))
        .otherwise(row)
    )
    landed = table(spark, folder, "events").select("event_id", body.alias("json"))
    return nested.unwrap_envelope(landed, "json", "k: int, kind: string")


@query(
    "latest_snapshots",
    """
WITH s AS (SELECT event_type, CAST(ts AS DATE) AS snapshot_date, event_id, value FROM events)
SELECT event_type, snapshot_date, event_id, value FROM s
WHERE snapshot_date = (SELECT MAX(snapshot_date) FROM s t WHERE t.event_type = s.event_type)
""",
)
def latest_snapshots(spark, folder):
    s = table(spark, folder, "events").select("event_type", F.to_date("ts").alias("snapshot_date"), "event_id", "value")
    return files.keep_latest(s, ["event_type"], "snapshot_date")


@query(
    "input_freshness",
    """
SELECT 'events' AS source, CAST(MAX(ts) AS DATE) AS newest, COUNT(*) AS rows FROM events
UNION ALL SELECT 'orders', CAST(MAX(o_orderdate) AS DATE), COUNT(*) FROM orders
UNION ALL SELECT 'lineitem', CAST(MAX(l_shipdate) AS DATE), COUNT(*) FROM lineitem
""",
)
def input_freshness(spark, folder):
    stamps = {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate"}
    return files.table_freshness({name: (table(spark, folder, name), stamp) for name, stamp in stamps.items()})


@query(
    "file_status",
    """
SELECT 'events' AS source, 1 AS files, COUNT(*) AS rows FROM events
UNION ALL SELECT 'orders', 1, COUNT(*) FROM orders UNION ALL SELECT 'lineitem', 1, COUNT(*) FROM lineitem
""",
)
def file_status(spark, folder):
    names = ("events", "orders", "lineitem")
    return files.input_status(spark, {n: f"{folder}/{n}.parquet" for n in names}).select("source", "files", "rows")


@query(
    "json_list_scan",
    """
SELECT o_orderkey AS id, o_custkey AS buyer, ROUND(o_totalprice, 2) AS total, o_orderpriority || ' }{"[\\' || o_orderstatus AS note,
  CAST(o_orderkey % 3 AS INTEGER) AS parts FROM orders
""",
)
def json_list_scan(spark, folder):
    """Orders land as one JSON list a year, with scalars between the entries, and are read back."""
    orders = table(spark, folder, "orders").withColumn("season", F.year("o_orderdate"))
    note = F.concat("o_orderpriority", F.lit(' }{"[\\'), "o_orderstatus")
    part = F.struct(F.col("o_orderkey").alias("of"), note.alias("note"))
    parts = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.when(i < F.col("o_orderkey") % 3, part))
    entry = F.struct(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("buyer"), F.col("o_totalprice").alias("total"), note.alias("note"),
        F.array_compact(parts).alias("parts"),
    )
    lines = orders.select("season", F.lit(1).alias("kind"), "o_orderkey", F.concat(F.to_json(entry), F.lit(", 1,")).alias("value"))
    ends = orders.select("season").distinct().select(
        "season", F.inline(F.array(F.struct(F.lit(0), F.lit(0).cast("long"), F.lit("[")), F.struct(F.lit(2), F.lit(0).cast("long"), F.lit('"end}"]'))))
    )
    ordered = lines.union(ends.toDF(*lines.columns)).repartition("season").sortWithinPartitions("season", "kind", "o_orderkey")
    root = f"{shared_folder(spark)}/json_lists-{uuid.uuid4().hex}"
    ordered.select("season", "value").write.partitionBy("season").text(root)
    rows = files.read_json_list(
        spark, f"{root}/season=*", "id long, buyer long, total double, note string, parts array<struct<of: long, note: string>>"
    )
    return rows.select("id", "buyer", F.round("total", 2).alias("total"), "note", F.size("parts").alias("parts"))


@query(
    "portal_ledger",
    """
SELECT CAST(c_custkey AS VARCHAR) AS "playerId", trim(c_mktsegment || ' ' || c_name) AS player_name,
  CASE WHEN c_custkey % 2 = 0 THEN '1' ELSE '2' END AS "divisionId", 'N' || c_nationkey AS source_team
FROM customer WHERE c_custkey % 3 <> 0
""",
)
def portal_ledger(spark, folder):
    feed = table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("playerId"),
        F.col("c_mktsegment").alias("firstName"),
        F.concat(F.lit(" "), "c_name", F.lit(" ")).alias("lastName"),
        F.when(F.col("c_custkey") % 2 == 0, "1").otherwise("").alias("divisionIdFrom"),
        F.lit("2").alias("divisionId"),
        F.concat(F.lit("N"), F.col("c_nationkey")).alias("teamMarketFrom"),
        F.when(F.col("c_custkey") % 3 == 0, "Withdrawn").when(F.col("c_custkey") % 3 == 1, "Transferred").otherwise("").alias("status"),
    )
    rows = nested.portal_ledger(feed)
    return rows.where(nested.ledger_status_ok(F.col("portalStatus"))).select("playerId", "player_name", "divisionId", "source_team")
