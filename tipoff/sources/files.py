"""Landed files: season folders, dated snapshots, JSON lists, CSV text, sinks and freshness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tipoff.functions.casts import first_non_empty, to_int
from tipoff.session import pinned


_PIECE = ["_path", "_start"]


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _chunks(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The text between closing braces, in order (`_start` of the split, `_at`), with what it does to the nesting.

    A brace is never escaped, so no escape is cut. `_odd` tells whether a chunk starts inside a string if its
    split starts outside; `_a` is the change of depth then, `_b` the change if the split starts inside a string.
    `_listed` tells whether the chunk opens a list, so that the sums of the splits need no text.
    """
    rows = spark.read.option("lineSep", "}").text(path).select(
        file_path().alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"), "value"
    )
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    quotes = _count(bare, '"')

    def change(inside: int) -> Column:
        marks = F.regexp_replace(F.concat(F.lit('"' * inside), bare), r'"[^"]*("|$)', "")
        closes = F.when((quotes + inside) % 2 == 0, 1).otherwise(0)
        return _count(marks, "{") + _count(marks, "[") - _count(marks, "]") - closes

    before = Window.partitionBy(*_PIECE).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    listed = F.ltrim(F.regexp_replace("value", r"^[\ufeff\s]+", "")).startswith("[")
    rows = rows.withColumns({"_quotes": quotes, "_out": change(0), "_in": change(1), "_listed": listed})
    rows = rows.withColumn("_odd", F.coalesce(F.sum("_quotes").over(before), F.lit(0)) % 2)
    even = F.col("_odd") == 0
    return rows.withColumns({"_a": F.when(even, F.col("_out")).otherwise(F.col("_in")), "_b": F.when(even, F.col("_in")).otherwise(F.col("_out"))})


def _list_entries(
    spark: SparkSession, path: str | Sequence[str], schema: StructType | str, strict: bool = False
) -> DataFrame:
    """Object entries of one-list files as (path, entry).

    Spark cuts each file into splits at closing braces, so a file of any size is read by many tasks. A split does not
    know whether it starts inside a string or how deep; one row a split sums up what it does in either case,
    and running totals over the splits of a file tell each its start. Entries are put together inside their
    splits; only the ones that run over a border meet in a further shuffle.
    """
    chunks = _chunks(spark, path)
    sums = chunks.groupBy(*_PIECE).agg(
        (F.sum("_quotes") % 2).alias("_quotes"), F.sum("_a").alias("_a"), F.sum("_b").alias("_b"), F.min_by("_listed", "_at").alias("_listed")
    )
    earlier = Window.partitionBy("_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_inside", F.coalesce(F.sum("_quotes").over(earlier), F.lit(0)) % 2)
    sums = sums.withColumn("_change", F.when(F.col("_inside") == 0, F.col("_a")).otherwise(F.col("_b")))
    sums = sums.withColumn("_depth", F.coalesce(F.sum("_change").over(earlier), F.lit(0)))
    sums = pinned(sums.select(*_PIECE, "_inside", "_depth", "_listed"))
    if strict:
        wrong = sums.where((F.col("_start") == 0) & ~F.col("_listed")).first()
        if wrong is not None:
            raise ValueError(f"expected a JSON list in {wrong['_path']}")
    before = Window.partitionBy(*_PIECE).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*_PIECE).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    outside = F.col("_inside") == 0
    known = chunks.drop("_listed").join(sums.drop("_listed"), _PIECE).withColumn("_change", F.when(outside, F.col("_a")).otherwise(F.col("_b")))
    known = known.withColumn("_deep", F.col("_depth") + F.coalesce(F.sum("_change").over(before), F.lit(0)))
    # Outside entries: scalars, strings and lists up to the first brace that is not in a string.
    whole = F.concat(F.when((F.col("_inside") + F.col("_odd")) % 2 == 1, '"').otherwise(""), "value")
    lead = F.regexp_extract(whole, r'(?s)^((?:[^"{]|"(?:[^"\\]|\\.)*+")*+)\{', 1)
    marks = F.regexp_replace(F.regexp_replace(lead, r"(?s)\\.", ""), r'"[^"]*"', "")
    opens = whole.rlike(r'(?s)^(?:[^"{]|"(?:[^"\\]|\\.)*+")*+\{')
    starts = opens & (F.col("_deep") + _count(marks, "[") - _count(marks, "]") == 1)
    known = known.withColumns({"_starts": starts, "_text": F.when(starts, F.substr(whole, F.length(lead) + 1)).otherwise(F.col("value"))})
    # Number of the entry a chunk belongs to: -1 outside, null as long as the split before it decides.
    mark = F.when(F.col("_starts"), F.col("_at")).when(F.col("_deep") <= 1, F.lit(-1).cast("long"))
    known = known.withColumn("_entry", F.last(mark, ignorenulls=True).over(upto))
    text = F.when(F.coalesce("_entry", F.lit(0)) >= 0, F.struct("_at", "_text"))
    parts = known.groupBy(*_PIECE, "_entry").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(text)), lambda c: F.concat(c["_text"], F.lit("}"))), "").alias("_text"),
        (F.max_by(F.col("_deep") + F.col("_change"), "_at") <= 1).alias("_closed"),
        F.max("_at").alias("_to"),
    )
    parts = pinned(parts)
    done = parts.where("_entry >= 0 and _closed").select("_path", "_text")
    last = parts.groupBy(*_PIECE).agg(F.max_by("_entry", "_to").alias("_last"))
    last = last.withColumn("_owner", F.last(F.when(F.col("_last").isNotNull(), F.struct("_start", F.col("_last").alias("_entry"))), ignorenulls=True).over(earlier))
    cut = parts.where("_entry is null or _entry >= 0 and not _closed").join(last.select(*_PIECE, "_owner"), _PIECE)
    cut = cut.withColumn("_owner", F.when(F.col("_entry").isNull(), F.col("_owner")).otherwise(F.struct("_start", "_entry")))
    cut = cut.where("_owner._entry >= 0").groupBy("_path", "_owner").agg(F.array_sort(F.collect_list(F.struct("_start", "_text"))).alias("_parts"))
    entries = done.union(cut.select("_path", F.array_join("_parts._text", "")))
    return entries.select("_path", F.from_json("_text", schema).alias("_row"))


def read_json_list(spark: SparkSession, path: str | Sequence[str], schema: StructType | str) -> DataFrame:
    """Rows of files that each hold one JSON list. Entries that are not objects are dropped; an empty file has none."""
    return _list_entries(spark, path, schema, strict=True).select("_row.*")


def read_text_csv(spark: SparkSession, path: str | Sequence[str], multi_line: bool = True) -> DataFrame:
    """CSV with header; every column is text. Without `multi_line`, for fields that hold no line ends, files are split."""
    return spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)


def file_path() -> Column:
    return F.col("_metadata.file_path")


def season_from_folder(path: Column) -> Column:
    """Number of the folder a file lies in; null for other folders."""
    return to_int(F.nullif(F.regexp_extract(path, r"/(\d+)/[^/]+$", 1), F.lit("")))


def year_from_path(path: Column) -> Column:
    """Year of the innermost four-digit folder, else from a dated ranking file name."""
    folder = F.regexp_extract(path, r"^.*/(\d{4})/", 1)
    name = F.regexp_extract(path, r"on3_(?:hs|transfer)_(\d{4})_[^/]*$", 1)
    return to_int(first_non_empty(folder, name))


def competition_from_path(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"_competition_(\d+)_[^/]*$", 1), F.lit(""))


def season_scan(
    spark: SparkSession,
    root: str,
    file_name: str,
    schema: StructType | str,
    first: int | None = None,
    last: int | None = None,
) -> DataFrame:
    """One JSON list per season folder, between two seasons; other folders and missing files are skipped.

    With both bounds only the named folders are listed, so nothing outside them is opened.
    """
    folder = "[0-9]*" if first is None or last is None else "{" + ",".join(map(str, range(first, last + 1))) + "}"
    rows = _list_entries(spark, f"{root}/{folder}/{file_name}", schema)
    rows = rows.select("_row.*", season_from_folder(F.col("_path")).alias("folder_season"))
    keep = F.col("folder_season").isNotNull()
    if first is not None:
        keep &= F.col("folder_season") >= first
    if last is not None:
        keep &= F.col("folder_season") <= last
    return rows.where(keep)


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Paths, dates in the names, and modification times; contents are not read."""
    found = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    date = F.regexp_extract(F.regexp_extract("path", r"[^/]*$", 0), r"(\d{4}-\d{2}-\d{2})", 1)
    return found.withColumn("snapshot_date", F.try_to_date(F.nullif(date, F.lit(""))))


def latest_files(spark: SparkSession, pattern: str, key: Column | None = None) -> DataFrame:
    """Newest file by name, of all or per key (`key` is computed from `path`). No key, no row."""
    files = list_files(spark, pattern).withColumn("key", F.lit("all") if key is None else key.cast("string"))
    return files.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.max("path").alias("path"), F.max_by("snapshot_date", "path").alias("snapshot_date")
    )


def read_latest_csv(spark: SparkSession, pattern: str, key: Column | None = None) -> DataFrame:
    """Rows of the newest file (per key) only; older copies are never opened."""
    paths = [r["path"] for r in latest_files(spark, pattern, key).collect()]
    if not paths:
        raise FileNotFoundError(pattern)
    return read_text_csv(spark, paths).withColumn("source_file", file_path())


def keep_latest(df: DataFrame, keys: Sequence[str], stamp: str) -> DataFrame:
    """Rows of the newest stamp of each key, for snapshots that are already in one table."""
    newest = df.groupBy(*keys).agg(F.max(stamp).alias(stamp))
    return df.join(newest, [*keys, stamp], "left_semi")


def competition_seasons(rows: DataFrame, gender: str | None = None) -> DataFrame:
    """(competition_id, season); rows without either are dropped, `gender` keeps one kind."""
    season = first_non_empty(F.col("season").cast("string"), F.col("endYear").cast("string"))
    kept = rows if gender is None else rows.where(F.lower("gender") == gender.lower())
    return (
        kept.select(F.col("competitionId").cast("string").alias("competition_id"), to_int(season).alias("season"))
        .where(F.col("competition_id").isNotNull() & F.col("season").isNotNull())
        .groupBy("competition_id")
        .agg(F.max("season").alias("season"))
    )


def write_table(df: DataFrame, path: str, order: Sequence[str | Column] = (), formats: Sequence[str] = ("parquet",)) -> None:
    """Write under `<path>.<format>`, sorted if asked."""
    rows = df.orderBy(*order) if order else df
    for kind in formats:
        writer = rows.write.mode("overwrite")
        if kind == "csv":
            writer = writer.option("header", True)
        writer.format(kind).save(f"{path}.{kind}")


def row_counts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(`path`, `rows`) of files: CSV rows, JSON list entries that are objects, or Parquet rows.

    No column of a Parquet file is read, only what its footers count. Files without rows, and other kinds of files, have 0.
    """
    kinds: dict[str, list[str]] = {}
    for path in paths:
        kinds.setdefault(path.rsplit(".", 1)[-1].lower(), []).append(path)
    parts = [spark.createDataFrame([(p,) for p in paths], "path string").withColumn("rows", F.lit(0).cast("long"))]
    for kind, some in kinds.items():
        if kind == "csv":
            held = read_text_csv(spark, some).select(file_path().alias("path"))
        elif kind == "parquet":
            held = spark.read.parquet(*some).select(file_path().alias("path"))
        elif kind == "json":
            held = _list_entries(spark, some, "_ string").select(F.col("_path").alias("path"))
        else:
            continue
        parts.append(held.groupBy("path").agg(F.count("*").alias("rows")))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    # Both ways of listing name a local file differently (file:/ and file:///).
    bare = F.regexp_replace("path", "^([a-z0-9]+):/+", "$1:/")
    return union.groupBy(bare.alias("path")).agg(F.sum("rows").alias("rows"))


def input_status(spark: SparkSession, patterns: Mapping[str, str]) -> DataFrame:
    """Newest snapshot, newest change, number of files, and rows of the newest file by name, per named source."""
    parts = [list_files(spark, p).withColumn("source", F.lit(name)) for name, p in patterns.items()]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    found = pinned(
        union.groupBy("source").agg(
            F.max("snapshot_date").alias("snapshot_date"),
            F.to_date(F.max("modificationTime")).alias("built_at"),
            F.count("*").alias("files"),
            F.regexp_replace(F.max("path"), "^([a-z0-9]+):/+", "$1:/").alias("path"),
        )
    )
    newest = [r["path"] for r in found.select("path").collect()]  # one path a source
    if not newest:
        return found.drop("path").withColumn("rows", F.lit(0).cast("long"))
    return found.join(row_counts(spark, newest), "path", "left").select(
        "source", "snapshot_date", "built_at", "files", F.coalesce("rows", F.lit(0)).alias("rows")
    )


def table_freshness(frames: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Newest stamp and row count per named table."""
    parts = [
        df.agg(F.to_date(F.max(stamp)).alias("newest"), F.count("*").alias("rows")).withColumn("source", F.lit(name))
        for name, (df, stamp) in frames.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("source", "newest", "rows")
