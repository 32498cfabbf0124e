"""The registered queries of the subpackage: one for each operator."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipoff.llm.alignment import align_documents
from tipoff.llm.common import held_out, table
from tipoff.llm.decontamination import find_benchmark, is_contaminated, n_hit
from tipoff.llm.fingerprints import fingerprint_documents, within_radius
from tipoff.llm.language_id import fit_languages, predict_languages
from tipoff.llm.licenses import PHRASES, TEMPLATES, scan_licenses
from tipoff.llm.line_dedup import line_classes
from tipoff.llm.packing import pack
from tipoff.llm.quality import fit_quality, quality_scores
from tipoff.llm.ranking import rank_documents
from tipoff.llm.sharding import uniform_shards
from tipoff.llm.simhash_dedup import as_hex, near_duplicates
from tipoff.llm.suffixes import distinct_without_repeats, without_repeats
from tipoff.llm.warc import archive
from tipoff.plans.registry import Query
from tipoff.session import pinned

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


_OP1 = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
v AS (SELECT item, w, unnest(range(1, greatest(2, len(w) - 11))) AS a FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[a : a + least(len(w), 13) - 1], ' ') AS s FROM v),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
ax AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS a FROM d),
sized AS (SELECT doc_id, a, n, array_to_string(w[a : a + n - 1], ' ') AS s FROM ax, (SELECT DISTINCT n FROM win) WHERE a + n - 1 <= len(w)),
occ AS (SELECT doc_id, a, sized.n, item FROM sized JOIN win ON win.n = sized.n AND win.s = sized.s),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(a, a + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM occ GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)"""


@query("op1_decontamination", _OP1)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside benchmark windows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_benchmark(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


@query("op2_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality_scores(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query("op3_simhash_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", as_hex("fingerprint"))


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of 1024 tokens."""
    files = [public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")]
    packed = pack(table(spark, sf_dir, "documents"), str(files[0]), ranks_path=str(files[1]))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op9_line_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every line that is not blank, named by the line that is kept."""
    classes = line_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", F.col("line_no").cast("long"), "keeper_doc_id", F.col("keeper_line_no").cast("long"), "kept")


@query("op4_sharding")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of equal row counts; equal texts are spread like any other rows."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return uniform_shards(rows, 8, seed=20).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _op6() -> str:
    def place(phrase: str) -> str:
        same = " AND ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(phrase.split(" ")))
        return f"list_filter(range(1, len(w) + 1), lambda i: coalesce({same}, false))"

    rows = []
    for label, text in TEMPLATES:
        held = sorted(set(re.findall("[a-z0-9]+", text.lower())))
        rows.append(f"('{label}', [{', '.join(repr(x) for x in held)}])")
    found = ", ".join(f"{place(p)} AS p{k}" for k, p in enumerate(PHRASES))
    labels = " || ".join(f"CASE WHEN len(p{k}) > 0 THEN ['{x}'] ELSE [] END" for k, x in enumerate(PHRASES.values()))
    every = " || ".join(f"p{k}" for k in range(len(PHRASES)))
    return f"""
WITH t(label, words) AS (VALUES {", ".join(rows)}),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
l AS (SELECT doc_id, {_WORDS} AS lw FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents)),
m AS (SELECT doc_id, label, len(list_intersect(words, lw)) / len(words) AS share FROM l, t
      WHERE 100 * len(list_intersect(words, lw)) >= 80 * len(words)),
g AS (SELECT doc_id, list(DISTINCT label) AS met, max(share) AS share FROM m GROUP BY doc_id),
b AS (SELECT doc_id, w, {found} FROM d),
c AS (SELECT doc_id, len(w) AS n, {every} AS starts, {labels} AS base FROM b)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(starts) AS BIGINT) AS n_base, list_min(starts) - 1 AS first_word, list_max(starts) - 1 AS last_word,
       array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(base || coalesce(met, []))), ',') AS labels,
       CASE WHEN len(starts) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM c LEFT JOIN g USING (doc_id)"""


@query("op6_license_scan", _op6())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document."""
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.transform("places", lambda p: p["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


@query("op7_fingerprints")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how many fingerprints lie within 3 bits of every 20th id's."""
    prints = pinned(fingerprint_documents(table(spark, sf_dir, "documents")))
    asked = F.col("doc_id") % 20 == 0
    near = within_radius(prints.where(asked), prints).groupBy("query").agg(F.count("*").alias("n"))
    return (
        prints.join(near, prints["fingerprint"] == near["query"], "left")
        .withColumn("n_within", F.when(asked, F.col("n")))
        .select(
            "doc_id", "n_chars", "edited_sha256", as_hex("fingerprint").alias("fingerprint"),
            as_hex("edited_fingerprint").alias("edited_fingerprint"), "near_edited", "near_next", "n_within",
        )
    )


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.select("doc_id", "text", "lang"))
    found = predict_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


_DIGITS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(hexed, {5 * i + 1}, 5) AS INTEGER) >> {k}) & 31) + 1, 1)"
    for i in range(8)
    for k in (15, 10, 5, 0)
)
_OP8 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hexed FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, {_DIGITS} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f"""


@query("op8_warc", _OP8)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of every page, as read back from the archives."""
    index = archive(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_OP11 = f"""
WITH t AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents),
l AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
s AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM l),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM f, s GROUP BY term, nn),
q AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark) GROUP BY item_id, term),
r AS (SELECT item_id, doc_id, CAST(sum(c * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll)))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN f USING (term) JOIN l USING (doc_id), s GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= 10"""


@query("op11_lexical_search", _OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return rank_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


@query("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of a byte-level and a piece tokenizer line up in every document."""
    files = [str(public_tokenizers.path(f)) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")]
    return align_documents(table(spark, sf_dir, "documents"), files[0], files[1], a_ranks=files[2])


@query("op13_suffix_dedup")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the strings of 400 bytes that also start elsewhere."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lengths = F.transform("spans", lambda s: (s["end"] - s["start"]).cast("long"))
    found = distinct_without_repeats(docs).select(
        "text_1", "text_2", "n_bytes", F.aggregate(lengths, F.lit(0).cast("long"), lambda n, x: n + x).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
    return without_repeats(docs, results=found).drop("text")
