"""Sharding by a hypergeometric communication matrix, with DataFrame functions only."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tipoff.llm.common import named
from tipoff.session import pinned

# Rows that a task ranks at a time within a shard, on average.
_CELL = 100_000


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """Number of good ones among `draws` taken without return; inversion from the mode outwards."""
    low, high = max(0, draws - bad), min(draws, good)
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)
    log = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    at_mode = math.exp(log(good, mode) + log(bad, draws - mode) - log(good + bad, draws))
    left = rng.random() - at_mode
    up, p_up, down, p_down = mode, at_mode, mode, at_mode
    while left > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
        if p_up == p_down == 0:  # the rest of the mass is below the smallest float
            break
    return mode


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """How many rows of each partition go to each shard, as if all rows were shuffled; rows add up to `counts`, columns to `sizes`."""
    rng, room, matrix = random.Random(seed), list(sizes), []
    for count in counts:
        row, rest, others = [], count, sum(room)
        for s, size in enumerate(room):
            others -= size
            taken = hypergeometric(rng, size, others, rest) if others else rest
            row.append(taken)
            rest -= taken
        room = [size - taken for size, taken in zip(room, row)]
        matrix.append(row)
    return matrix


def uniform_shards(rows: DataFrame, shards: int, *, seed: int = 0) -> DataFrame:
    """`rows` with `shard` (int) and `slot` (long, gapless from 0 in each shard): a uniform shuffle into shards of exact size.

    Shard sizes differ by one at most. The rows are pinned as they lie, with two random numbers each. Only the
    number of rows of each partition reaches the driver, which draws the matrix: exact counts for every pair of
    partition and shard. Each partition orders its rows by the first number and deals them out by its line of
    the matrix; in the shard they are ordered by the second number, in cells of about 100,000 rows that are
    ranked apart and stand one after the other. So no key of the data decides where a row goes, and no hot key,
    source or group of copies can crowd a shard or a task. All columns move along; to move ids only, select them.

    Nulls and repeated rows are rows like any other. An empty table gives no rows. Input columns called `shard`
    or `slot` are replaced.
    """
    spark, own = rows.sparkSession, [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    inner = rows.select([named(c).alias(f"c{i}") for i, c in enumerate(own)])
    fixed = pinned(
        inner.withColumns({"part": F.spark_partition_id(), "first": F.rand(seed), "second": F.rand(seed + 1)})
    )
    counted = sorted(map(tuple, fixed.groupBy("part").count().collect()))
    total = sum(n for _, n in counted)
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    ends, lines = communication_matrix([n for _, n in counted], sizes, seed), []
    for (part, _), line in zip(counted, ends):
        sums = [sum(line[: s + 1]) for s in range(shards)]
        lines.append((part, sums))
    matrix = spark.createDataFrame(lines, "part int, ends array<long>")
    cells = -(-total // (shards * _CELL)) or 1
    order = Window.partitionBy("part").orderBy("first", "second")
    dealt = pinned(
        fixed.withColumn("place", F.row_number().over(order) - 1)
        .join(matrix, "part")
        .withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("place"))))
        .withColumn("cell", F.floor(F.col("second") * cells).cast("int"))
        .drop("part", "first", "place", "ends")
    )
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "cell").count().withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0)))
    within = Window.partitionBy("shard", "cell").orderBy("second")
    placed = dealt.withColumn("rank", F.row_number().over(within) - 1).join(offsets, ["shard", "cell"])
    return placed.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(own)], "shard", (F.col("offset") + F.col("rank")).alias("slot")
    )
