"""Landed web pages as a table: embedded JSON, tables, links, options and dates."""

from __future__ import annotations

import re
from collections.abc import Sequence
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipoff.functions.casts import dash_int
from tipoff.functions.scalar import season_label
from tipoff.functions.text import header_name, page_text, through_date, us_date, with_record_parts


def embedded_json(html: Column) -> Column:
    """Body of the page's data script, or null."""
    body = F.regexp_extract(html, r'(?s)<script id="__NEXT_DATA__" type="application/json">(.*?)</script>', 1)
    return F.nullif(body, F.lit(""))


def is_blocked(html: Column) -> Column:
    text = F.lower(html)
    return text.contains("attention required! | cloudflare") | text.contains("sorry, you have been blocked")


def is_net_ranking_page(html: Column) -> Column:
    sport = html.contains("D-I Men&#39;s Basketball") | html.contains("D-I Men's Basketball")
    return sport & html.contains("NET Ranking")


class _Tables(HTMLParser):
    """Cell texts of every row inside the wanted tables."""

    def __init__(self, wanted: str | None):
        super().__init__(convert_charrefs=True)
        self.wanted, self.depth, self.rows, self.row, self.cell = wanted, 0, [], None, None

    def handle_starttag(self, tag, attrs):
        classes = (dict(attrs).get("class") or "").split()
        if tag == "table" and (self.depth or self.wanted is None or self.wanted in classes):
            self.depth += 1
        elif self.depth and tag == "tr":
            self.row = []
        elif self.depth and tag in ("td", "th"):
            self.cell = []

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            if self.row is not None:
                self.row.append(" ".join(" ".join(self.cell).split()))
            self.cell = None
        elif tag == "tr" and self.row:
            self.rows.append(self.row)
            self.row = None
        elif tag == "table" and self.depth:
            self.depth -= 1


# What stands between the brackets of a plain tag: a name, then quoted attributes without entities.
_TAG = re.compile(r'(/[a-zA-Z][a-zA-Z0-9]*|[a-zA-Z][a-zA-Z0-9]*(?: [a-zA-Z][a-zA-Z0-9-]*="[^"<>&]*")*)')
_CLASS = re.compile(r' class="([^"]*)"', re.IGNORECASE)
_CELLS = {"td": 1, "th": 1, "/td": 2, "/th": 2, "tr": 3, "/tr": 4, "table": 5, "/table": 6}
# Elements whose content is not read as markup.
_RAW = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "plaintext", "noscript", "svg", "math"))


def _plain_rows(html: str, wanted: str | None) -> list[list[str]] | None:
    """The rows that `_Tables` finds in a page of plain tags, cut at the brackets; None if the page holds anything else."""
    depth, rows, row, cell = 0, [], None, None
    for piece in html.split("<")[1:]:
        tag, closed, text = piece.partition(">")
        kind = _CELLS.get(tag)
        if kind is None or not closed:
            name = tag.partition(" ")[0].lower()
            if not closed or not _TAG.fullmatch(tag) or name.removeprefix("/") in _RAW:
                return None
            kind = _CELLS.get(name, 0)
        if kind == 1:
            if depth:
                cell = []
        elif kind == 2:
            if cell is not None:
                if row is not None:
                    row.append(" ".join(" ".join(cell).split()))
                cell = None
        elif kind == 3:
            if depth:
                row = []
        elif kind == 4:
            if row:
                rows.append(row)
                row = None
        elif kind == 5:
            if depth or wanted is None:
                depth += 1
            else:
                found = _CLASS.findall(tag)
                depth += bool(found) and wanted in found[-1].split()
        elif kind == 6 and depth:
            depth -= 1
        if text and cell is not None:
            cell.append(unescape(text) if "&" in text else text)
    return rows


def _rows_of(html: str, wanted: str | None) -> list[list[str]]:
    rows = _plain_rows(html, wanted)
    if rows is None:
        parser = _Tables(wanted)
        parser.feed(html)
        rows = parser.rows
    return rows


def table_rows(pages: DataFrame, ids: Sequence[str], html: str = "html", table_class: str | None = None) -> DataFrame:
    """(ids, row, cells) of the table rows of every page; only pages with a table reach Python.

    Pages of plain tags are cut at the brackets; the parser goes through all others.
    """
    ids = list(ids)
    kept = pages.where(F.lower(F.col(html)).contains("<table")).select(*ids, html)

    def parse(batches):
        for pdf in batches:
            out = {c: [] for c in [*ids, "row", "cells"]}
            for record in pdf.itertuples(index=False):
                for i, cells in enumerate(_rows_of(record[-1], table_class)):
                    for c, v in zip(ids, record):
                        out[c].append(v)
                    out["row"].append(i)
                    out["cells"].append(cells)
            yield pd.DataFrame(out)

    fields = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in ids)
    return kept.mapInPandas(parse, f"{fields}, row int, cells array<string>")


# Columns of a ranking page that hold `W-L` texts.
RECORD_COLUMNS = ("record", "road", "neutral", "home", "non_division_i", "q1", "q2", "q3", "q4")


def ranking_rows(pages: DataFrame, ids: Sequence[str], headers: Sequence[str], html: str = "html") -> DataFrame:
    """Rows of the page's sticky ranking table under the given headings.

    The first row of a page names its columns; pages with other headings and rows of another width
    are left out.
    """
    ids, names = list(ids), [header_name(h) for h in headers]
    label = F.regexp_extract(html, r'(?s)<figure[^>]*rankings-last-updated[^>]*>(.*?)</figure>', 1)
    pages = pages.withColumn("through_games_label", F.nullif(page_text(label), F.lit("")))
    rows = table_rows(pages, [*ids, "through_games_label"], html, "sticky")
    titles = F.transform(
        "cells", lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_|_$", "")
    )
    plain = ["_".join("".join(ch if ch.isalnum() else " " for ch in h.lower()).split()) for h in headers]
    right = rows.where((F.col("row") == 0) & (titles == F.array(*[F.lit(p) for p in plain]))).select(*ids).distinct()
    body = rows.where((F.col("row") > 0) & (F.size("cells") == len(names))).join(right, ids, "left_semi")
    out = body.select(
        *ids,
        "through_games_label",
        through_date(F.col("through_games_label")).alias("through_games"),
        *[F.col("cells")[i].alias(n) for i, n in enumerate(names)],
    )
    if "rank" in names:
        out = out.withColumn("rank", dash_int("rank"))
    if "prev" in names:
        out = out.withColumn("previous_rank", dash_int("prev")).drop("prev")
    return with_record_parts(out, [c for c in RECORD_COLUMNS if c in names])


# Cells after the rank of a selection sheet, in order; `_record` cells stay text.
SELECTION_CELLS = (
    "net_rank", "previous_net_rank", "net_avg_opponent_rank", "avg_opponent_net_rank", "wins", "overall_record",
    "conference_wins", "conference_record", "nonconference_wins", "nonconference_record", "road_wins", "road_record",
    "net_sos", "net_nonconference_sos", "q1_wins", "q1_record", "q2_wins", "q2_record", "q3_wins", "q3_record",
    "q4_wins", "q4_record",
)


def page_season(text: Column) -> tuple[Column, Column, Column]:
    """(season, season label, through date) from the visible text of a page."""
    pattern = r"(\d{4}-\d{2})\s+D-I Men's Basketball NET Ranking thru games\s+(\d{2}/\d{2}/\d{4})"
    label = F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    day = F.coalesce(us_date(F.regexp_extract(text, pattern, 2)), us_date(text))
    season = F.year(day)
    return season, F.coalesce(label, season_label(season)), day


def selection_rows(pages: DataFrame, ids: Sequence[str], html: str = "html") -> DataFrame:
    """Team rows of selection sheets: at least 24 cells, the rank in the third or, failing that, fourth."""
    season, label, day = page_season(F.col("_text"))
    pages = pages.withColumn("_text", page_text(F.col(html))).withColumns(
        {"season": season, "season_label": label, "selection_thru_games": day}
    )
    carried = [*ids, "season", "season_label", "selection_thru_games"]
    rows = table_rows(pages, carried, html).where(F.size("cells") >= 24)
    third = dash_int(F.get("cells", F.lit(2)))
    at = F.when(third.isNotNull(), 2).when(F.size("cells") > 24, 3)
    out = rows.withColumn("_at", at).where(F.col("_at").isNotNull())

    def cell(i: int, name: str) -> Column:
        text = F.get("cells", F.col("_at") + i)
        return (text if name.endswith("_record") else dash_int(text)).alias(name)

    out = out.select(
        *carried,
        F.col("cells")[0].alias("team"),
        F.col("cells")[1].alias("conference"),
        *[cell(i, n) for i, n in enumerate(SELECTION_CELLS)],
    ).where(F.col("net_rank").isNotNull())
    return with_record_parts(out, [n for n in SELECTION_CELLS if n.endswith("_record")])


def links(pages: DataFrame, ids: Sequence[str], html: str = "html") -> DataFrame:
    """(ids, url, label) of the links of every page, in page order."""
    pattern = r'(?is)<a\b[^>]*\bhref="([^"]*)"[^>]*>(.*?)</a>'
    pair = F.arrays_zip(
        F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("url"),
        F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("label"),
    )
    rows = pages.select(*ids, F.posexplode(pair).alias("position", "_l"))
    return rows.select(*ids, "position", F.col("_l.url").alias("url"), page_text(F.col("_l.label")).alias("label"))


def options(pages: DataFrame, ids: Sequence[str], html: str = "html") -> DataFrame:
    """(ids, value, label) of the select options of every page."""
    pattern = r'(?is)<option[^>]*\bvalue="([^"]+)"[^>]*>(.*?)</option>'
    pair = F.arrays_zip(
        F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("value"),
        F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("label"),
    )
    rows = pages.select(*ids, F.posexplode(pair).alias("position", "_o"))
    return rows.select(*ids, "position", F.col("_o.value").alias("value"), page_text(F.col("_o.label")).alias("label"))


def selection_links(found: DataFrame, base_url: str) -> DataFrame:
    """Links and options that name a dated selection, one per address, by season."""
    day = us_date(F.col("label"))
    url = F.when(F.col("url").rlike("^[a-z]+://"), F.col("url")).otherwise(F.concat(F.lit(base_url.rstrip("/")), F.col("url")))
    kept = found.where(F.lower("label").contains("selection") & day.isNotNull()).select(
        F.year(day).alias("season"), season_label(F.year(day)).alias("season_label"), day.alias("thru_games"), "label", url.alias("url")
    )
    return kept.groupBy("url").agg(F.max(F.struct("thru_games", "label", "season", "season_label")).alias("_l")).select(
        "_l.season", "_l.season_label", "_l.thru_games", "_l.label", "url"
    ).orderBy("season", "url")


def option_links(found: DataFrame) -> DataFrame:
    """Options as addresses of their selection page."""
    return found.select(F.concat(F.lit("/selection_rankings/nitty_gritties/"), "value").alias("url"), "label")


def academic_years(found: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Options that name an academic year, one per page and value."""
    years = found.where(F.trim("label").rlike(r"^\d{4}-\d{2}$"))
    return years.groupBy(*ids, "value").agg(F.min_by("label", "position").alias("label"))
