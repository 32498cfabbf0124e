"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bytes of text that an Arrow step works on at a time.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """Column `name`, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """`df` without the columns `names`, in any case."""
    gone = {n.lower() for n in names}
    return df.select([named(c) for c in df.columns if c.lower() not in gone])


def held_out(doc_id: Column) -> Column:
    """True for the ids kept for tests; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learnable(doc_id: Column) -> Column:
    """True for the ids that models may learn from; a null id is neither learned from nor held out."""
    return doc_id.isNotNull() & ~held_out(doc_id)


def with_arrow(
    df: DataFrame, fields: T.StructType, fn: Callable[[pa.RecordBatch], list[pa.Array]], weigh: str = "text",
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """`df` with the columns `fields`, which `fn` makes for each slice of a batch.

    Slices hold about `slice_bytes` of the text column `weigh`, or a single longer text. A column of `df`
    that is called like one of `fields` is replaced.
    """
    kept = without(df, fields.names)
    schema = T.StructType(kept.schema.fields + fields.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, weigh, slice_bytes):
                yield pa.RecordBatch.from_arrays(part.columns + fn(part), schema.names)

    return kept.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, weigh: str, slice_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `slice_bytes` in the column `weigh`."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(weigh))), 0)
    ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype("i8"))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + slice_bytes, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column; null is empty."""
    values = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()
    return [v or b"" for v in values.cast(kind).to_pylist()]


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in `spark.checkpoint.dir`; a folder of its own for a local session without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tipoff-shared-")
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder: later reads see the same rows and do not repeat the work."""
    path = f"{shared_folder(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
