"""WARC archives with revisit records, and the global index that a loser tree merges from their sorted runs."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tipoff.llm.common import named, shared_folder, texts
from tipoff.session import pinned

# Fixed values of the format.
_VERSION = b"WARC/1.1\r\n"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

ENTRY = (
    T.StructType()
    .add("page_id", T.LongType())
    .add("payload_bytes", T.LongType())
    .add("payload_digest", T.StringType())
    .add("record_type", T.StringType())
    .add("refers_to", T.LongType())
    .add("url_key", T.StringType())
    .add("captured", T.StringType())
    .add("file", T.StringType())
    .add("offset", T.LongType())
    .add("length", T.LongType())
)
# Index rows that a merging task holds, on average.
_MERGE = 50_000


def url_key(url: str | Column) -> Column:
    """Sort key of a URL: host names from the right, then the rest; lower case."""
    url = F.lower(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")))
    host = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://([^/:?#]*)", 1)
    rest = F.regexp_replace(url, r"^[a-z][a-z0-9+.-]*://[^/:?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def base32_sha1(text: Column) -> Column:
    """SHA-1 of the UTF-8 bytes in base32."""
    hexed, digits = F.sha1(text.cast("binary")), []
    for i in range(8):
        value = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
        digits += [F.substring(F.lit(_BASE32), (F.shiftright(value, s).bitwiseAND(31) + 1), F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*digits)


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record(page_id: int | None, url: str | None, captured: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has the HTTP head of the full payload and no body."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    name = lambda p: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{p}')}>"
    lines = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", captured)]
    if page_id is not None:
        lines.append(("X-Page-ID", str(page_id)))
    if url is not None:
        lines.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    lines.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if revisit:
        lines += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", name(refers_to)), ("X-Refers-To-Page", str(refers_to))]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _VERSION + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member of a stream."""
    offset, inflate, held, size, rest = 0, zlib.decompressobj(31), [], 0, b""
    while True:
        data = rest or stream.read(1 << 16)
        if not data:
            if size:
                raise EOFError("the archive ends inside a record")
            return
        held.append(inflate.decompress(data))
        rest = inflate.unused_data
        size += len(data) - len(rest)
        if inflate.eof:
            yield offset, size, b"".join(held)
            offset, inflate, held, size = offset + size, zlib.decompressobj(31), [], 0


def entry(content: bytes) -> dict:
    """What the index holds of one record; the payload of a response is checked against its digest."""
    head, _, block = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not match its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("X-Page-ID"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"],
        "refers_to": number("X-Refers-To-Page"), "captured": fields["WARC-Date"],
    }


def write_archives(pages: DataFrame, folder: str, *, least_bytes: int = 0) -> DataFrame:
    """Write `pages` (`page_id`, `url`, `html`) as archives in `folder`, one file per task; (`file`, `n`) for each.

    Of equal payloads of `least_bytes` or more the least page id is a response, the others revisit it. The least
    id is found by a grouped minimum and joined back, so that no group of equal payloads is gathered. Each file
    is a run sorted by URL key, time and id. A file has a random name and only the names that a finished task
    returns are used, so repeated attempts leave files that nobody reads.
    """
    html = F.coalesce(named("html").cast("string"), F.lit(""))
    ident = named("page_id").cast("long")
    seconds = F.lit(1577836800) + F.pmod(F.coalesce(ident, F.lit(0)), F.lit(1_000_000_000))
    rows = pages.select(
        ident.alias("page_id"), named("url").cast("string").alias("url"), html.alias("html"), base32_sha1(html).alias("digest"),
        F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"),
    )
    least = rows.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("least"))
    placed = rows.join(least, "digest", "left").withColumn("url_key", url_key("url"))
    placed = placed.select("page_id", "url", "html", "digest", "captured", "least", "url_key")
    runs = placed.sortWithinPartitions("url_key", "captured", "page_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/run-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, n = None, 0
        for batch in batches:
            if out is None:
                files, path = _file_system(name)
                files.create_dir(path.rpartition("/")[0], recursive=True)
                out = files.open_output_stream(path, compression=None)
            columns = [batch.column(i).to_pylist() for i in range(6)]
            columns[2] = texts(batch, "html")
            for page, url, payload, digest, captured, first in zip(*columns):
                revisit = first is not None and page != first
                pack = zlib.compressobj(4, zlib.DEFLATED, 31)
                out.write(pack.compress(record(page, url, captured, payload, digest, first, revisit)) + pack.flush())
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "n"])

    return pinned(runs.mapInArrow(write, "file string, n long"))


def read_archives(files: DataFrame) -> DataFrame:
    """The index entries of all records, each archive streamed by one task in the order of its records."""
    schema = T.StructType([f for f in ENTRY if f.name != "url_key"]).add("url", T.StringType())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        kinds = pa.schema([(f.name, pa.int64() if isinstance(f.dataType, T.LongType) else pa.string()) for f in schema])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, path = _file_system(name)
                with system.open_input_stream(path, compression=None) as stream:
                    for offset, length, content in members(stream):
                        url = re.search(rb"\r\nWARC-Target-URI: ([^\r]*)", content[: content.find(b"\r\n\r\n")])
                        place = {"file": name, "offset": offset, "length": length, "url": url and url[1].decode()}
                        held.append(entry(content) | place)
                        if len(held) == 5000:
                            yield pa.RecordBatch.from_pylist(held, schema=kinds)
                            held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=kinds)

    return files.select("file").mapInArrow(read, schema).withColumn("url_key", url_key("url")).select(*ENTRY.names)


def loser_tree(runs: list[list]) -> Iterator[int]:
    """The number of the run that holds the next least key, until all sorted runs are used up.

    Each inner node keeps the loser of its match, so one key after another only replays its own path.
    """
    k, done = len(runs), (1,)
    walks = [iter(r) for r in runs]
    heads = [(0, key) if (key := next(w, None)) is not None else done for w in walks]
    tree = [-1] * max(k, 1)

    def play(i: int) -> None:
        node = (i + k) // 2
        while node:
            if tree[node] == -1:
                tree[node] = i
                return
            if heads[tree[node]] < heads[i]:
                tree[node], i = i, tree[node]
            node //= 2
        tree[0] = i

    for i in reversed(range(k)):
        play(i)
    while k and heads[tree[0]] != done:
        i = tree[0]
        yield i
        key = next(walks[i], None)
        heads[i] = (0, key) if key is not None else done
        play(i)


def merged_index(entries: DataFrame) -> DataFrame:
    """`entries` with `part` and `position`: by these two, all captures stand in order of URL key, time and page id.

    The key range is cut into parts of some 50,000 entries; a hot URL is cut by time and id. Each part gets its
    stretch of every run and merges the runs with a loser tree.
    """
    parts = -(-entries.count() // _MERGE) or 1
    order = ["url_key", "captured", "page_id"]
    dealt = entries.repartitionByRange(parts, *order, "file", "offset").sortWithinPartitions("file", "offset")
    schema = T.StructType(entries.schema.fields).add("part", T.LongType()).add("position", T.LongType())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        rows = pa.Table.from_batches(held).combine_chunks() if held else None
        if rows is None or not rows.num_rows:
            return
        files = rows["file"].to_pylist()
        keys = list(zip(rows["url_key"].to_pylist(), rows["captured"].to_pylist(), [(p is not None, p or 0) for p in rows["page_id"].to_pylist()]))
        starts = [i for i in range(len(files)) if not i or files[i] != files[i - 1]]
        ends = [*starts[1:], len(files)]
        at, order = list(starts), []
        for run in loser_tree([keys[a:b] for a, b in zip(starts, ends)]):
            order.append(at[run])
            at[run] += 1
        out = rows.take(pa.array(order, pa.int64()))
        part = TaskContext.get().partitionId()
        out = out.append_column("part", pa.array([part] * len(order), pa.int64())).append_column("position", pa.array(range(len(order)), pa.int64()))
        yield from out.to_batches()

    return dealt.mapInArrow(merge, schema)


def archive(pages: DataFrame, folder: str | None = None, *, least_bytes: int = 0) -> DataFrame:
    """Write `pages` as WARC archives, read them back, and return the merged global index of their records.

    Null html is an empty payload; a null url has an empty key and no target header. Rows with the least id of
    their payload are responses, also where that id repeats; payloads that come with null ids only are responses
    each; other null ids revisit the least id. Empty tables give no rows. Other columns are not returned.
    The archives stay in `folder`, by default a new one in the shared folder.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    entries = pinned(read_archives(write_archives(pages, folder, least_bytes=least_bytes)))
    return merged_index(entries)
