"""Name and text normalisation as column expressions."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tipoff import fixed_values as fixed
from tipoff.functions.casts import to_int
from tipoff.functions.similarity import similarity


# Plain characters fail here at once, before the long lists of ranges that follow.
_BEYOND_ASCII = r"(?=[^\x00-\x7F])"


def _folds() -> dict[str, str]:
    """Every character whose compatibility decomposition holds a plain character, and that decomposition without marks."""
    found = {}
    for code in (*range(0x00A0, 0xD800), *range(0xE000, 0x110000)):
        char = chr(code)
        parts = unicodedata.normalize("NFKD", char)
        if parts != char:
            base = "".join(c for c in parts if not unicodedata.combining(c))
            if base != char and any(c < "\x80" for c in base):
                found[char] = base
    return found


def _marks() -> str:
    """Pattern of the marks that decompose into marks with a combining class. Marks without one stay."""
    codes = [c for c in range(0x110000) if all(map(unicodedata.combining, unicodedata.normalize("NFKD", chr(c))))]
    starts = [c for i, c in enumerate(codes) if not i or codes[i - 1] != c - 1]
    ends = [c for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != c + 1]
    return _BEYOND_ASCII + "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends)) + "]+"


_FOLDS = _folds()
_MARKS = _marks()
_ONE = {k: v for k, v in _FOLDS.items() if len(v) == 1}
_MANY = {k: v for k, v in _FOLDS.items() if len(v) > 1}
_FOLD_FROM, _FOLD_TO = "".join(_ONE), "".join(_ONE.values())
_MANY_CLASS = _BEYOND_ASCII + "[" + "".join(f"\\x{{{ord(c):x}}}" for c in _MANY) + "]"


def strip_accents(c: Column) -> Column:
    """Accents off by compatibility decomposition, in the JVM.

    Characters that fold to several (ligatures, fractions) are looked up one by one, in the rows that have any.
    """
    one = F.translate(F.regexp_replace(c, _MARKS, ""), _FOLD_FROM, _FOLD_TO)
    many = F.map_from_arrays(F.split(F.lit("\n".join(_MANY)), "\n"), F.split(F.lit("\n".join(_MANY.values())), "\n"))
    # the runs between such characters stay whole; only the characters are looked up
    runs, found = F.split(one, _MANY_CLASS, -1), F.regexp_extract_all(one, F.lit(_MANY_CLASS), F.lit(0))
    spelled = F.array_join(
        F.zip_with(runs, found, lambda run, x: F.concat(run, F.coalesce(F.try_element_at(many, x), F.lit("")))), ""
    )
    folded = F.when(one.rlike(_MANY_CLASS), spelled).otherwise(one)
    return F.when(c.rlike(r"[^\x00-\x7F]"), folded).otherwise(c)


@F.pandas_udf(StringType())
def strip_accents_full(values: pd.Series) -> pd.Series:
    """Accents off by full compatibility decomposition, for text with ligatures and the like."""

    def fold(text):
        if text is None or text.isascii():
            return text
        return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))

    return values.map(fold, na_action="ignore")


def normalize_text(c: Column, full_unicode: bool = False) -> Column:
    """Plain lower-case words separated by single blanks; null becomes the empty text."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    text = F.lower(strip_accents_full(text) if full_unicode else strip_accents(text))
    text = F.replace(text, F.lit("&"), F.lit(" and "))
    text = F.regexp_replace(text, "['`]", "")
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), key)


def team_key(c: Column, aliases: dict[str, str] = fixed.TEAM_ALIASES) -> Column:
    """Canonical key of a school name."""
    text = F.trim(F.regexp_replace(normalize_text(c), r"\baq$", ""))
    text = F.regexp_replace(text, r"^st\s+", "saint ")
    text = F.regexp_replace(text, r"\bcal st\b", "cal state")
    text = F.regexp_replace(text, r"\bst$", "state")
    return _lookup(aliases, F.trim(F.regexp_replace(text, r"\s+", " ")))


def schedule_key(c: Column) -> Column:
    return _lookup(fixed.SCHEDULE_ALIASES, team_key(c))


def _drop_words(text: Column, words: tuple[str, ...]) -> Column:
    return F.array_join(F.filter(F.split(text, " "), lambda w: ~w.isin(*words) & (w != "")), " ")


def coach_name(c: Column) -> Column:
    """Person name without remarks in brackets and titles."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"\([^)]*\)", "")
    return _drop_words(normalize_text(bare), fixed.COACH_TITLE_WORDS)


def name_keys(c: Column) -> Column:
    """All keys a person may be listed under: full name, first + last, nickname + last."""
    full = coach_name(c)
    words = F.split(full, " ")
    first, last = F.element_at(words, 1), F.element_at(words, -1)
    table = F.create_map(
        *[x for k, v in fixed.FIRST_NAME_ALIASES.items() for x in (F.lit(k), F.array(*[F.lit(a) for a in v]))]
    )
    nicknames = F.coalesce(F.try_element_at(table, first), F.array().cast("array<string>"))
    short = F.concat(F.array(F.concat_ws(" ", first, last)), F.transform(nicknames, lambda a: F.concat_ws(" ", a, last)))
    keys = F.when(F.size(words) >= 2, F.array_union(F.array(full), short)).otherwise(F.array(full))
    return F.when(full == "", F.array().cast("array<string>")).otherwise(keys)


def is_unknown_coach(c: Column) -> Column:
    return coach_name(c).isin(*fixed.UNKNOWN_COACH_VALUES)


def player_key(c: Column) -> Column:
    return _drop_words(normalize_text(c), fixed.NAME_SUFFIXES)


def compact_name(c: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")


def light_name(c: Column) -> Column:
    return F.replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit("."), F.lit(""))


def with_name_match(df: DataFrame, left: str, right: str, out: str, threshold: float = 0.9) -> DataFrame:
    """How two person names agree: exact, shared key, similar, none or missing.

    Only rows the cheap tests leave open carry text into the similarity function.
    """
    a, b = coach_name(F.col(left)), coach_name(F.col(right))
    cheap = (
        F.when((a == "") | (b == ""), "missing")
        .when(a == b, "exact_normalized")
        .when(F.arrays_overlap(name_keys(F.col(left)), name_keys(F.col(right))), "first_last")
    )
    open_left = F.when(F.col("_cheap").isNull(), a)
    fuzzy = F.when(similarity(open_left, b) >= threshold, "fuzzy").otherwise("no_match")
    return df.withColumn("_cheap", cheap).withColumn(out, F.coalesce("_cheap", fuzzy)).drop("_cheap")


def is_name_match(match_class: Column) -> Column:
    return F.coalesce(match_class.isin("exact_normalized", "first_last", "fuzzy"), F.lit(False))


@F.pandas_udf(StringType())
def unescape_entities(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


def clean_cell(c: Column) -> Column:
    """Entities resolved, tags removed, blanks squeezed; nothing left is null."""
    text = F.regexp_replace(unescape_entities(c.cast("string")), "<[^>]+>", "")
    return F.nullif(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(""))


def page_text(c: Column) -> Column:
    """Visible words of a page: tags to blanks, the five basic entities resolved, blanks squeezed."""
    text = F.regexp_replace(c, "<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))


def record_part(c: Column, which: int) -> Column:
    """Wins (1) or losses (2) of a `W-L` text; null for any other text."""
    return to_int(F.nullif(F.regexp_extract(c, r"^\s*(\d+)-(\d+)\s*$", which), F.lit("")))


def with_record_parts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns(
        {f"{c}_{name}": record_part(F.col(c), i) for c in columns for i, name in ((1, "wins"), (2, "losses"))}
    )


def header_name(text: str) -> str:
    """Column name for a table heading."""
    words = "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in text.lower()).split()
    name = "_".join(words)
    if name == "non_div_i":
        return "non_division_i"
    return f"q{name[-1]}" if name in ("quad_1", "quad_2", "quad_3", "quad_4") else name


def us_date(c: Column) -> Column:
    """First `MM/DD/YYYY` in the text."""
    return F.try_to_date(F.nullif(F.regexp_extract(c, r"(\d{2}/\d{2}/\d{4})", 1), F.lit("")), "MM/dd/yyyy")


def through_date(c: Column) -> Column:
    """Date of a label such as `Through games Mar. 15 2026`."""
    pattern = r"([A-Za-z]+)\.?\s+(\d{1,2})\s+(\d{4})"
    pairs = [F.lit(x) for item in fixed.MONTHS.items() for x in item]
    month = F.try_element_at(F.create_map(*pairs), F.lower(F.regexp_extract(c, pattern, 1)))
    day, year = to_int(F.regexp_extract(c, pattern, 2)), to_int(F.regexp_extract(c, pattern, 3))
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def epoch_to_iso(c: Column) -> Column:
    return F.date_format(F.timestamp_seconds(F.floor(c)), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def game_date(c: Column) -> Column:
    """Date part of an ISO date or timestamp text (`Z` and offsets keep the local date)."""
    return F.try_to_date(F.left(c, F.lit(10)), "yyyy-MM-dd")


def days_from_november(day: Column) -> Column:
    return F.datediff(day, F.make_date(F.year(day), F.lit(11), F.lit(1)))


def short_source_label(c: Column) -> Column:
    """Shortened school label for display."""
    # Display abbreviations, applied in this order.
    table = {
        "West Virginia": "WVU",
        "iSchool of Lewisville": "iSchool Lewisville",
        "College Preparatory School": "Prep",
        "Preparatory School": "Prep",
        "High School": "HS",
        "School of Lewisville": "Lewisville",
        "St. John's (NY)": "St. John's",
        "Florida St.": "Florida St",
        "Boise St.": "Boise St",
    }
    label = F.trim(F.coalesce(c, F.lit("")))
    short = label
    for source, target in table.items():
        short = F.replace(short, F.lit(source), F.lit(target))
    pairs = [F.lit(x) for item in table.items() for x in item]
    squeezed = F.trim(F.regexp_replace(short, r"\s+", " "))
    return F.coalesce(F.try_element_at(F.create_map(*pairs), label), squeezed)
