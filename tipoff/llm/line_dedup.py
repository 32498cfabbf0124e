"""Line deduplication by MinHash over character shingles, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipoff.llm.common import named
from tipoff.llm.graph import components
from tipoff.session import pinned

ToSet = Callable[[Column], Column]
# Lines of a bucket that are held against each other one by one, at most.
_FEW = 32


def _places(line: str | Column, size: int) -> Column:
    """Hashes of the `size` characters at every place of the line, repeats included; a shorter line is one shingle.

    Four bytes stand for each character, so that a place is found without a walk over those before it.
    """
    wide = F.encode(line, "UTF-32")
    last = F.greatest(F.octet_length(wide) - 4 * size, F.lit(0)) + 1
    starts = F.sequence(F.lit(1), last, F.lit(4))
    cut = F.transform(F.array(wide), lambda w: F.transform(starts, lambda i: F.xxhash64(F.substring(w, i, F.lit(4 * size)))))
    return F.flatten(cut)


def shingles(line: str | Column, size: int) -> Column:
    """Distinct hashes of the `size` characters at every place of the line; a shorter line is one shingle."""
    return F.array_distinct(_places(line, size))


def bands(hashes: str | Column, count: int, rows: int) -> Column:
    """`count` band values: the hash of the `rows` least distinct shingle hashes from each of `count` points of the hash circle.

    Two lines of similarity s agree on the `rows` next hashes after a point with probability s ** rows. `hashes` may
    repeat: a few after a point are looked at first, all of them where these hold too few distinct ones.
    """
    points = [j * (1 << 64) // count - (1 << 63) for j in range(count)]
    hashes = F.sort_array(hashes)
    merged = F.sort_array(F.concat(hashes, F.array([F.lit(p).cast("long") for p in points])))
    circle = F.concat(hashes, hashes)

    def band(j: int) -> Column:
        start = F.array_position(merged, F.lit(points[j]).cast("long")).cast("int") - j
        few, every = (F.slice(F.array_distinct(F.slice(circle, start, n)), 1, rows) for n in (F.lit(3 * rows), F.size(hashes)))
        return F.xxhash64(F.lit(j), F.when(F.size(few) == rows, few).otherwise(every))

    return F.array([band(j) for j in range(count)])


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each line that is not blank: id, hash of the text, line number, line and its key."""
    text = named(text_col).cast("string")
    cut = docs.select(
        named(id_col).alias("doc_id"), F.xxhash64(text).alias("version"), F.posexplode(F.split(text, "\n")).alias("line_no", "line")
    )
    return cut.where(F.col("line").rlike(r"\S")).withColumn("key", F.xxhash64("line"))


def _alike(pairs: DataFrame, items: DataFrame, to_set: ToSet, percent: int) -> DataFrame:
    """The rows of `pairs` (`a`, `b`) whose items (`key`, `item`) have a Jaccard index of `percent` or more.

    Items are made sets after the joins. No lambda holds the sets, so generated code makes each once and compares them.
    """
    left = items.select(F.col("key").alias("a"), F.col("item").alias("left"))
    right = items.select(F.col("key").alias("b"), F.col("item").alias("right"))
    x, y = to_set(F.col("left")), to_set(F.col("right"))
    wanted = (100 + percent) * F.size(F.array_intersect(x, y)) >= percent * (F.size(x) + F.size(y))
    return pairs.join(left, "a").join(right, "b").where(wanted).select(pairs.columns)


def _mixed(rooted: DataFrame) -> DataFrame:
    """The rows (`band`, `key`, `root`) of buckets with several roots, the most frequent root `main` and the lines `n` of the bucket."""
    parts = rooted.groupBy("band", "root").agg(F.count("*").alias("n"))
    mains = parts.groupBy("band").agg(
        F.max(F.struct("n", "root"))["root"].alias("main"), F.sum("n").alias("n"), F.count("*").alias("parts")
    )
    return rooted.join(mains.where("parts > 1").drop("parts"), "band")


def _moved(rooted: DataFrame, edges: DataFrame) -> DataFrame:
    """`rooted` with the roots that `edges` between its roots leave."""
    to = components(edges).select(F.col("node").alias("root"), F.col("root").alias("new"))
    return rooted.join(to, "root", "left").withColumn("root", F.coalesce("new", "root")).drop("new")


def _parities(items: DataFrame, to_set: ToSet) -> DataFrame:
    """`key`, the size `m` of its set and 256 parity bits `p0`, `p1`, ... of it.

    A bit in which two sets differ stands for at least one element that only one of them has.
    """
    bits = [F.expr(f"bit_xor(if((h >> 6 & 3) = {j}, 1L << cast(h & 63 as int), 0L))").alias(f"p{j}") for j in range(4)]
    cut = items.select("key", F.explode(to_set(F.col("item"))).alias("h"))
    return cut.groupBy("key").agg(F.count("*").cast("int").alias("m"), *bits)


def _ranked(items: DataFrame, to_set: ToSet, percent: int) -> DataFrame:
    """`key`, how `common` the elements of its set are on the mean, and its `prefix`: its rarest elements, rarest first.

    Two sets with a Jaccard index of `percent` or more share an element of their prefixes.
    """
    cut = items.select("key", F.explode(to_set(F.col("item"))).alias("h"))
    counts = cut.groupBy("h").agg(F.count("*").alias("n"))
    sets = cut.join(counts, "h").groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("n", "h"))).alias("s"), F.count("*").alias("m"), F.sum("n").alias("common")
    )
    prefix = F.slice("s", 1, F.floor((100 - percent) * F.col("m") / 100).cast("int") + 1)
    return sets.select("key", (F.col("common") / F.col("m")).alias("common"), prefix.alias("prefix"))


def _may_be_like(percent: int) -> str:
    """Whether two lines `x` and `y` of different roots, at least one a stray, may be similar by their sizes and parities."""
    odd = " + ".join(f"bit_count(x.p{j} ^ y.p{j})" for j in range(4))
    return f"""x.root <> y.root and (not y.stray or x.key < y.key) and 100 * least(x.m, y.m) >= {percent} * greatest(x.m, y.m)
        and {100 + percent} * ({odd}) <= {100 - percent} * (x.m + y.m)"""


def _met(lines: DataFrame, wanted: str) -> DataFrame:
    """Pairs (`a`, `b`, their roots `ra` and `rb`) of a stray and another of `lines`."""
    met = lines.where("stray").alias("x").join(lines.alias("y"), F.expr(wanted))
    return met.selectExpr("x.key as a", "y.key as b", "least(x.root, y.root) as ra", "greatest(x.root, y.root) as rb").distinct()


def _apart(mixed: DataFrame, ranked: DataFrame, prints: DataFrame, percent: int) -> DataFrame:
    """Pairs (`a`, `b`, roots `ra` and `rb`) of a stray and a line of one of its buckets that may be similar."""
    lines = mixed.groupBy("key").agg(
        F.first("root").alias("root"), F.max(F.col("root") != F.col("main")).alias("stray"), F.collect_list("band").alias("bands")
    )
    held = lines.join(ranked.drop("common"), "key").join(prints, "key").select("*", F.posexplode("prefix").alias("place", "e"))
    held = held.where("e.n > 1").withColumn("h", F.col("e.h")).drop("e", "prefix")
    wanted = f"""x.h = y.h and {_may_be_like(percent)}
        and {100 + percent} * least(x.m - x.place, y.m - y.place) >= {percent} * (x.m + y.m)
        and arrays_overlap(x.bands, y.bands)"""
    return _met(held, wanted)


def _stray_links(members: DataFrame, roots: DataFrame, items: DataFrame, to_set: ToSet, percent: int) -> DataFrame:
    """Edges (`a`, `b`) that connect the roots of all similar lines that share a bucket (`band`, `key`) of `members`.

    A stray has another root than the most frequent one of its bucket. In a bucket of up to `_FEW` lines the strays are
    held against all lines. The lines of a larger one are held against its most central line, whose shingles are the
    most common ones, then against the most central stray: near copies of a line are like that line, if not like each
    other. That is linear in the lines. What is still apart meets in an exact join by prefix, length and positional
    filters, the rarest shingles first, of strays with lines of their buckets.
    """
    rooted = members.join(roots.withColumnRenamed("node", "key"), "key", "left")
    first = pinned(_mixed(rooted.select("band", "key", F.coalesce("root", "key").alias("root"))))
    items = pinned(items.join(first.select("key").distinct(), "key", "left_semi"))
    prints = pinned(_parities(items, to_set))
    few = first.where(F.col("n") <= _FEW).join(prints, "key").withColumn("stray", F.col("root") != F.col("main"))
    found = [_alike(pinned(_met(few, f"x.band = y.band and {_may_be_like(percent)}")), items, to_set, percent).select("ra", "rb")]
    now = first.where(F.col("n") > _FEW)
    ranked = pinned(_ranked(items.join(now.select("key").distinct(), "key", "left_semi"), to_set, percent))
    for strays in (False, True):
        ours = now.where("root <> main") if strays else now
        place = F.struct("common", "key", "root")
        center = ours.join(ranked.select("key", "common"), "key").groupBy("band").agg(F.max(place).alias("center"))
        met = now.join(center, "band").where(F.col("root") != F.col("center.root"))
        low, high = F.least("root", "center.root"), F.greatest("root", "center.root")
        pairs = met.select(F.col("key").alias("a"), F.col("center.key").alias("b"), low.alias("ra"), high.alias("rb")).distinct()
        found.append(pinned(_alike(pairs, items, to_set, percent).select("ra", "rb").distinct()))
        now = pinned(_mixed(_moved(now.select("band", "key", "root"), found[-1].toDF("a", "b"))))
    found.append(_alike(pinned(_apart(now, ranked, prints, percent)), items, to_set, percent).select("ra", "rb"))
    return reduce(DataFrame.union, found).distinct().toDF("a", "b")


def similar_lines(
    lines: DataFrame, *, size: int = 12, count: int = 6, rows: int = 3, percent: int = 80
) -> DataFrame:
    """(`node`, `root`) for the keys of lines linked with a smaller key, which is the root of their component.

    Links join different lines that share a bucket of a band and whose shingle sets have a Jaccard index of
    `percent` or more; the index is exact, from the whole sets. Equal lines are one key from the first step on.
    First every line is held against the least and the greatest key of its buckets, which is linear in the lines
    however large a bucket is, and all there is to see in buckets of three. Then the lines of larger buckets that
    these links left in different components are searched for the rest. Buckets are summed up before the
    shuffle and joined back; only bounded tiles of them are gathered.
    """
    signed = lines.select("key", bands(_places("line", size), count, rows).alias("bands"))
    signed = signed.select("key", *[F.col("bands")[j].alias(f"b{j}") for j in range(count)])

    def items(keys: DataFrame) -> DataFrame:
        chosen = lines.select("key", "line").dropDuplicates(["key"]).join(keys, "key", "left_semi")
        return chosen.select("key", F.col("line").alias("item"))

    return linked_keys(signed, count, items, percent, lambda line: shingles(line, size))


def linked_keys(
    signed: DataFrame, count: int, items_of: Callable[[DataFrame], DataFrame], percent: int, to_set: ToSet = lambda item: item
) -> DataFrame:
    """(`node`, `root`) as `similar_lines` has it, from the bands `b0`, `b1`, ... of each `key`.

    `items_of` gives the items (`key`, `item`) of a table of distinct keys, one row for each key; `to_set` makes
    an item a set.
    """
    distinct = signed.groupBy("key").agg(*[F.first(f"b{j}").alias(f"b{j}") for j in range(count)])
    held = distinct.select("key", F.explode(F.array(*[f"b{j}" for j in range(count)])).alias("band"))
    ends = held.groupBy("band").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n"))
    met = held.join(ends.where("low < high"), "band")
    met = pinned(met.select(F.when(F.col("n") > 3, F.col("band")).alias("crowd"), "key", "low", "high"))
    members = met.where("crowd is not null").select(F.col("crowd").alias("band"), "key")
    pairs = met.select("key", F.explode(F.array("low", "high")).alias("end")).where("key <> end")
    pairs = pairs.select(F.least("key", "end").alias("a"), F.greatest("key", "end").alias("b")).distinct()
    items = items_of(met.select("key").distinct())
    # One shuffle of the lines by key serves both sides of the pairs and the items kept for the crowded buckets.
    crowded = items.join(members.select("key").distinct(), "key", "left_semi")
    nothing = F.lit(None).cast(items.schema["item"].dataType).alias("item")
    first = _alike(pairs, items, to_set, percent).select("a", "b", nothing)
    seen = pinned(first.union(crowded.select("key", F.lit(None).cast("long"), "item")))
    roots = components(seen.where("b is not null").select("a", "b"))
    kept = seen.where("b is null").select(F.col("a").alias("key"), "item")
    more = components(_stray_links(members, roots, kept, to_set, percent))
    moved = more.select(F.col("node").alias("root"), F.col("root").alias("new"))
    return roots.join(moved, "root", "left").select("node", F.coalesce("new", "root").alias("root")).union(more)


def line_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each line that is not blank: `doc_id`, `version`, `line_no`, `keeper_doc_id`, `keeper_line_no`, `kept`.

    The keeper of a class of lines that are equal, or linked by similar lines, is its first line by id, text hash
    and line number; only that line is kept. `version` is the hash of the text.

    Null, empty and blank texts have no rows. Null ids come first. Rows with the same id and the same text are
    one document, so a line kept in one is kept in each. Very long texts are taken whole.
    """
    lines = _lines(docs, id_col, text_col)
    places = lines.select("key", F.struct("doc_id", "version", "line_no").alias("place"))
    roots = similar_lines(lines, **options).select(F.col("node").alias("key"), "root")
    roots = roots.union(roots.select("root", "root").distinct())
    # Only lines that repeat or are linked need a keeper; their table meets the lines in a join that can be split.
    first = places.groupBy("key").agg(F.min("place").alias("keeper"), F.count("*").alias("n")).join(roots, "key", "left")
    first = pinned(first.where("n > 1 or root is not null").select("key", "root", "keeper"))
    linked = first.where("root is not null")
    heads = linked.groupBy("root").agg(F.min("keeper").alias("keeper"))
    keepers = linked.select("key", "root").join(heads, "root").select("key", "keeper")
    keepers = keepers.union(first.where("root is null").select("key", "keeper"))
    keeper = F.coalesce("keeper", "place")
    return places.join(keepers, "key", "left").select(
        "place.*",
        keeper["doc_id"].alias("keeper_doc_id"),
        keeper["line_no"].alias("keeper_line_no"),
        (F.col("place") == keeper).alias("kept"),
    )


def without_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs`, its columns as they were, with each text cut down to its kept and its blank lines.

    Null texts stay null; a text whose lines all go is empty. A column named like a result of `line_classes`
    is not touched.
    """
    own = docs.columns
    inner = docs.select([named(c).alias(f"c{i}") for i, c in enumerate(own)])
    key, text = f"c{own.index(id_col)}", f"c{own.index(text_col)}"
    gone = (
        line_classes(inner, id_col=key, text_col=text, **options)
        .where(~F.col("kept"))
        .groupBy("doc_id", "version")
        .agg(F.collect_set("line_no").alias("gone"))
    )
    cut = F.split(text, "\n")
    numbers = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), "gone")
    left = F.array_join(F.transform(numbers, lambda i: F.get(cut, i)), "\n")
    mine = inner.withColumn("own_version", F.xxhash64(F.col(text).cast("string")))
    joined = mine.join(gone, F.col(key).eqNullSafe(F.col("doc_id")) & (F.col("own_version") == F.col("version")), "left")
    new = F.when(F.col("gone").isNull(), F.col(text)).otherwise(left)
    return joined.select([(new if f"c{i}" == text else F.col(f"c{i}")).alias(c) for i, c in enumerate(own)])
