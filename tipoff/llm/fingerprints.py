"""Document fingerprints by SimHash with block tables, with DataFrame functions only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tipoff.llm.common import named
from tipoff.session import pinned

# Terms counted together: at weight 4, a lane of 15 bits holds them all.
_PART = 8191
_LANES = 0x0001000100010001


def simhash(rows: DataFrame, keys: list[str], text: str, *, shingle: int = 3) -> DataFrame:
    """`keys` and `fingerprint` (long): the signed votes of the weighted term hashes of each text.

    A term is `shingle` words in a row (all words of a shorter text), repeats included; it weighs 1 and 1 more
    for each of its words over three characters, up to 4. A bit is set where the terms that have it weigh more
    than those that don't. Votes are summed four bits to a long before any shuffle, a long text in parts, so a
    row per text and part is all that moves. Keys must name the text; rows of equal keys are one text.
    """
    words = rows.select(*keys, F.split(text, r"\s+").alias("words"))
    each = words.select(*keys, "words", F.posexplode("words").alias("at", "word"))
    near = [F.get(F.col("words"), F.col("at") + k) for k in range(shingle)]
    weight = F.lit(1).cast("long")
    for w in near[:3]:
        weight = weight + F.coalesce((F.length(w) > 3).cast("long"), F.lit(0).cast("long"))
    terms = each.where((F.col("at") == 0) | near[-1].isNotNull()).select(
        *keys, F.floor(F.col("at") / _PART).cast("int").alias("part"), F.xxhash64(*near).alias("h"), F.least(weight, F.lit(4).cast("long")).alias("w")
    )
    lanes = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(_LANES).cast("long")) * F.col("w")).alias(f"v{j}") for j in range(16)]
    parts = terms.groupBy(*keys, "part").agg(F.sum("w").alias("w"), *lanes)
    bit = lambda b: F.shiftrightunsigned(f"v{b % 16}", b // 16 * 16).bitwiseAND(F.lit(0xFFFF).cast("long"))
    sums = parts.groupBy(*keys).agg(F.sum("w").alias("w"), *[F.sum(bit(b)).alias(f"s{b}") for b in range(64)])
    value = F.lit(0).cast("long")
    for b in range(64):
        mask = (1 << b) - (1 << 64 if b == 63 else 0)
        value = value.bitwiseOR(F.when(2 * F.col(f"s{b}") > F.col("w"), F.lit(mask).cast("long")).otherwise(F.lit(0).cast("long")))
    return sums.select(*keys, value.alias("fingerprint"))


def likeness(a: str | Column, b: str | Column) -> Column:
    """Share of equal bits."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


def within_radius(queries: DataFrame, prints: DataFrame, *, radius: int = 3, name: str = "fingerprint") -> DataFrame:
    """(`query`, `found`) for all distinct fingerprints of `prints` at most `radius` bits from one of `queries`.

    The bits fall into radius + 3 blocks. Two fingerprints within the radius agree on three of them at least,
    so a table for each choice of three blocks has both under one key. A pair is returned by the first of its
    tables only. Copies are one fingerprint on either side; no bucket is gathered or cut.
    """
    n_blocks = radius + 3
    cuts = [64 * i // n_blocks for i in range(n_blocks + 1)]
    block = [((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in range(n_blocks)]
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m).cast("long")
    tables = list(combinations(range(n_blocks), 3))

    def keyed(df: DataFrame, alias: str) -> DataFrame:
        keys = F.array([F.col(alias).bitwiseAND(signed(sum(block[i] for i in t))) for t in tables])
        return df.select(F.col(name).alias(alias)).distinct().select(alias, F.posexplode(keys).alias("t", "key"))

    differ = F.col("query").bitwiseXOR(F.col("found"))
    agreed = [differ.bitwiseAND(signed(b)) == 0 for b in block]
    first = F.lit(None).cast("int")
    for t, chosen in reversed(list(enumerate(tables))):
        here = agreed[chosen[0]] & agreed[chosen[1]] & agreed[chosen[2]]
        first = F.when(here, F.lit(t)).otherwise(first)
    q, p = keyed(queries, "query").alias("q"), keyed(prints, "found").alias("p")
    near = (F.col("q.t") == F.col("p.t")) & (F.col("q.key") == F.col("p.key")) & (F.bit_count(differ) <= radius) & (first == F.col("q.t"))
    # by sort and merge: sizes after an explode are guessed too low for a broadcast
    return q.join(p.hint("merge"), near).select("query", "found")


def successors(keys: DataFrame) -> DataFrame:
    """`keys` (`doc_id`, `version`, `key`, others) with `next_key`: what follows in ascending order; the first follows the last.

    The distinct keys are sorted by range and numbered piece by piece; only the least key of each piece looks
    across its border.
    """
    ranged = pinned(keys.distinct().repartitionByRange("doc_id", "version").withColumn("piece", F.spark_partition_id()))
    place = F.struct("doc_id", "version", "key")
    least = ranged.groupBy("piece").agg(F.min(place).alias("least"))
    row = Window.orderBy("piece")  # one row for each piece
    start = F.min("least").over(row.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    borders = least.select("piece", F.coalesce(F.lead("least").over(row), start)["key"].alias("ahead"))
    inside = F.lead("key").over(Window.partitionBy("piece").orderBy("doc_id", "version"))
    joined = ranged.withColumn("inside", inside).join(borders, "piece")
    return joined.select(*keys.columns, F.coalesce("inside", "ahead").alias("next_key"))


def edited_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each distinct id and text: `doc_id`, `key` (two hashes that name them), `text`, `edited`, `next_key`.

    The last quarter of the code points (rounded down) gives way to as many of the next document's first ones.
    Only those first ones travel to their neighbour; both joins share one shuffle of the texts.
    """
    text, own = F.coalesce(named(text_col).cast("string"), F.lit("")), named(id_col)
    # a name of its own keeps both reads of the texts alike, so that their shuffle is used twice
    base = docs.select(own.alias("own_id"), F.xxhash64(text).alias("version"), text.alias("own_text"))
    base = base.withColumn("key", F.struct("version", F.xxhash64("own_id", "version").alias("both")))
    cut = pinned(successors(base.select(F.col("own_id").alias("doc_id"), "version", "key", F.floor(F.char_length("own_text") / 4).cast("int").alias("cut"))))
    texts = base.select("key", F.col("own_text").alias("text")).dropDuplicates(["key"])
    ahead = cut.select("doc_id", F.col("key").alias("before"), "next_key", "cut")
    heads = texts.join(ahead, F.col("key") == F.col("next_key")).select(
        "doc_id", F.col("before").alias("key"), "next_key", "cut", F.left("text", F.col("cut")).alias("head")
    )
    edited = F.concat(F.left("text", F.char_length("text") - F.col("cut")), F.col("head"))
    return texts.join(heads, "key").select("doc_id", "key", "text", edited.alias("edited"), "next_key")


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """`doc_id`, `n_chars`, `edited_sha256`, `fingerprint`, `edited_fingerprint`, `near_edited`, `near_next` for each distinct id and text.

    Null texts are empty; an empty text has the fingerprint of one empty term. Rows with the same id and the same
    text are one document with one result row; null ids come first in the order, and texts of one id are ordered
    by their hash. A single document follows itself. An empty table gives no rows. Other columns are not returned.
    """
    rows = edited_texts(docs, id_col=id_col, text_col=text_col)
    keys = ["doc_id", "key", "kind", "next_key", "n_chars", "sha"]
    two = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("x")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("x")))
    apart = rows.select(
        "doc_id", "key", "next_key", F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("sha"), F.explode(two).alias("one"),
    ).select("*", "one.kind", "one.x")
    votes = pinned(simhash(apart, keys, "x", shingle=shingle))
    own = votes.where("kind = 0").drop("kind")
    edited = votes.where("kind = 1").select("key", F.col("fingerprint").alias("edited_fingerprint"))
    after = own.select(F.col("key").alias("next_key"), F.col("fingerprint").alias("next_fingerprint"))
    return own.join(edited, "key").join(after, "next_key").select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
