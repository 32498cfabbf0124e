"""Files, payloads and pages."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tipoff.sources import files, nested, pages
from tipoff.streaming.snapshots import current_snapshot, ingest_snapshots


def test_season_folders_and_lists(spark, tmp_path):
    for name, rows in (("2019", [{"a": 1}]), ("2020", [{"a": 2}, 5, {"a": 3}]), ("notes", [{"a": 9}])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "ratings.json").write_text(json.dumps(rows))
    got = files.season_scan(spark, str(tmp_path), "ratings.json", "a int", 2020, 2021).dropna(subset=["a"])
    assert sorted((r["folder_season"], r["a"]) for r in got.collect()) == [(2020, 2), (2020, 3)]
    everything = files.season_scan(spark, str(tmp_path), "ratings.json", "a int").dropna(subset=["a"])
    assert sorted(r["a"] for r in everything.collect()) == [1, 2, 3]
    assert files.read_json_list(spark, str(tmp_path / "2020" / "ratings.json"), "a int").count() == 2
    (tmp_path / "bad.json").write_text('{"a": 1}')
    with pytest.raises(ValueError):
        files.read_json_list(spark, str(tmp_path / "bad.json"), "a int")


def test_lists_are_cut_at_any_place(spark, tmp_path):
    """Splits of a few bytes: braces, quotes and escapes in strings, nested lists, scalars and entries over many splits."""
    rng = random.Random(5)
    bits = ["{", "}", '"', "\\", "[", "]", ",", "é漢", "a b", "\n", "\\}", '\\"', ""]

    def text():
        return "".join(rng.choices(bits, k=rng.randint(0, 9)))

    def entry(i):
        return {"id": i, "s": text(), "deep": [{"t": text(), "u": {}}, [text()]] * rng.randint(0, 3)}

    want = {}
    for name in ("a", "b", "c"):
        rows = [rng.choice([entry(i), entry(i), text(), i, None, [entry(-1), [text()]], [[]], {}]) for i in range(60)]
        body = json.dumps(rows, ensure_ascii=False, indent=rng.choice([None, 1]))
        (tmp_path / f"{name}.json").write_text(" \n" + body)
        want[name] = [(r.get("id"), r.get("s")) for r in rows if isinstance(r, dict)]
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "none.json").write_text("[]")
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    try:
        for size in ("37b", "128m"):
            spark.conf.set(keys[0], size)
            spark.conf.set(keys[1], "1b")
            got = files.read_json_list(spark, str(tmp_path / "*.json"), "id int, s string").collect()
            assert sorted(map(str, map(tuple, got))) == sorted(str(x) for rows in want.values() for x in rows)
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)


def test_newest_snapshot_and_refresh(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "changes_2026-01-02.csv").write_text("school,coach\nA,new\n")
    (landing / "changes_2026-01-01.csv").write_text("school,coach\nA,old\nB,old\n")
    newest = files.read_latest_csv(spark, str(landing / "*.csv"))
    assert [(r["school"], r["coach"]) for r in newest.collect()] == [("A", "new")]
    status = files.input_status(spark, {"changes": str(landing / "*.csv")}).first()
    assert str(status["snapshot_date"]) == "2026-01-02" and status["files"] == 2 and status["rows"] == 1
    (tmp_path / "x_2026-02-01.csv").write_text('a,b\n1,"two\nlines"\n2,c\n')
    (tmp_path / "y.json").write_text('[{"a": 1}, 4, {"a": 2}, {"a": 3}]')
    (tmp_path / "z.csv").write_text("a,b\n")
    spark.range(7).coalesce(1).write.parquet(str(tmp_path / "p"))
    asked = {"x": "x_*.csv", "y": "y.json", "z": "z.csv", "p": "p/*.parquet"}
    got = files.input_status(spark, {k: str(tmp_path / v) for k, v in asked.items()}).collect()
    assert {r["source"]: r["rows"] for r in got} == {"x": 2, "y": 3, "z": 0, "p": 7}
    table, progress = str(tmp_path / "table"), str(tmp_path / "progress")
    for _ in range(2):
        ingest_snapshots(spark, str(landing), "school string, coach string", table, progress)
    rows = current_snapshot(spark, table, ["school"])
    assert sorted((r["school"], r["coach"]) for r in rows.collect()) == [("A", "new"), ("B", "old")]


def test_paths(spark):
    df = spark.createDataFrame(
        [("/d/hs/2026/on3_hs_2026_x.json",), ("/d/hs/on3_hs_2025_y.json",), ("/d/a_competition_41_v.json",)], "p string"
    )
    got = [tuple(r) for r in df.select(files.year_from_path(F.col("p")), files.competition_from_path(F.col("p"))).collect()]
    assert got == [(2026, None), (2025, None), (None, "41")]


def test_payloads(spark):
    item = {"player": {"key": "1", "fullName": "Al B", "classYear": "2026"}, "status": {"type": "Signed", "committedAsset": {"slug": "x"}}, "rating": {"consensusNationalRank": 7}}
    moved = {**item, "status": {"type": "Signed", "transfer": True}}
    other = {**item, "status": {"type": "Signed", "committedAsset": {"slug": "y"}}}
    body = json.dumps({"props": {"pageProps": {"playerList": {"list": [item, moved, other]}}}})
    page = spark.createDataFrame([(body, "x", "St. X", 2026)], "json string, team_slug string, team_name string, ranking_year int")
    got = nested.commit_rows(page).collect()
    assert [(r["player_name"], r["team_key"], r["season"], r["industry_rank"]) for r in got] == [("Al B", "saint x", 2027, 7.0)]
    changes = json.dumps([{"value": {"school": "<b>A&amp;M</b>", "new_coach": "TBD", "___id___": "r1"}}, {"value": {"school": " "}}])
    frame = spark.createDataFrame([(changes, "u", "t", 2026)], "json string, source_url string, captured_at string, season int")
    assert [(r["school"], r["hoopdirt_row_id"]) for r in nested.coaching_changes(frame).collect()] == [("A&M", "r1")]
    columns = nested.ledger_columns(["Player Name", "Old Team", "School", "To", "Status"])
    assert columns["player"] == "Player Name" and columns["destination"] == "To" and columns["player_id"] is None


def test_ranking_page(spark):
    html = (
        '<figure class="x rankings-last-updated">Through Games Mar. 15 2026</figure><table class="sticky"><tr><th>Rank</th><th>Prev</th>'
        "<th>School</th><th>Record</th><th>Quad 1</th></tr><tr><td>1</td><td>-</td><td>A&amp;M</td><td>20-3</td><td>4-1</td></tr>"
        "<tr><td>2</td><td>9</td></tr></table><table><tr><td>no</td></tr></table>"
    )
    df = spark.createDataFrame([(1, html), (2, "<p>none</p>")], "page_id int, html string")
    got = pages.ranking_rows(df, ["page_id"], ["Rank", "Prev", "School", "Record", "Quad 1"]).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["rank"], r["previous_rank"], r["school"], r["record_wins"], r["q1_losses"]) == (1, None, "A&M", 20, 1)
    assert str(r["through_games"]) == "2026-03-15"


def test_options_and_links(spark):
    html = (
        '<select><option value="9">2025-26</option><option value="9">2025-26</option><option value="8">All</option>'
        '<option value="77">Selection 03/15/2026</option></select><a href="/s/1">Selection Sunday 03/17/2024</a>'
    )
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    found = pages.options(df, ["page_id"])
    assert [(r["value"], r["label"]) for r in pages.academic_years(found, ["page_id"]).collect()] == [("9", "2025-26")]
    every = pages.links(df, ["page_id"]).select("url", "label").unionByName(pages.option_links(found))
    got = pages.selection_links(every, "https://x.org/")
    assert [(r["season"], r["season_label"], r["url"]) for r in got.collect()] == [
        (2024, "2023-24", "https://x.org/s/1"), (2026, "2025-26", "https://x.org/selection_rankings/nitty_gritties/77"),
    ]


def test_plain_pages_leave_the_parser(monkeypatch):
    """Pages of plain tags are cut without the parser and yield its rows; pages with anything else go through it."""
    import random

    from tipoff.sources import pages as P

    draw, calls = random.Random(4), []
    plain = ["<table>", '<table class="x sticky">', '<TABLE class="a">', "</table>", "<tr>", "</tr>", "<td>", "</TD>", "<th>", "</th>", "</td>",
             "a  b", "&amp;", "&lt", "x & y", "\n", "<b>", "</b>", '<td class="c" id="d">', "> 5", "&nbsp;", "é"]
    odd = ["<!-- <td> -->", "<td colspan=2>", "<br/>", "<title>", "<script>", "</td >", '<p title="q>', "<", "<3", '<a href="u?x&y">']
    made = ["".join(draw.choice(plain) for _ in range(draw.randint(1, 30))) for _ in range(400)]
    made += ["<table><tr><td>1</td>" + draw.choice(odd) + "</tr>" + draw.choice(plain) for _ in range(100)]
    want = []
    for html in made:
        for wanted in (None, "sticky"):
            parser = P._Tables(wanted)
            parser.feed(html)
            want.append(parser.rows)
    feed = P._Tables.feed
    monkeypatch.setattr(P._Tables, "feed", lambda self, html: (calls.append(html), feed(self, html)))
    assert [P._rows_of(html, wanted) for html in made for wanted in (None, "sticky")] == want
    assert sum(map(len, want)) > 50 and set(calls) == set(made[400:])


def test_sums_of_splits_need_no_text(spark, tmp_path):
    """Whether a file opens a list is told chunk by chunk; blanks and a byte order mark before it do not count."""
    (tmp_path / "a.json").write_bytes('﻿ \n[1, {"a": 1}, {"a": 2}]'.encode())
    (tmp_path / "b.json").write_text('{"a": [1]}, [{"a": 3}]')
    chunks = files._chunks(spark, str(tmp_path / "*.json"))
    first = chunks.groupBy("_path").agg(F.min_by("_listed", "_at").alias("listed")).collect()
    assert {r["_path"][-6:]: r["listed"] for r in first} == {"a.json": True, "b.json": False}
    assert files.read_json_list(spark, str(tmp_path / "a.json"), "a int").count() == 2
    with pytest.raises(ValueError, match="b.json"):
        files.read_json_list(spark, str(tmp_path / "b.json"), "a int")
