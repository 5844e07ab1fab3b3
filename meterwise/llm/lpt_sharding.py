"""Longest-processing-time sharding of groups of equal texts.

Groups, largest first, each go to the least-loaded shard. Groups of the same
size are interchangeable, so the heap needs only the table of group sizes and
how many groups have each: different sizes s1 < s2 < ... add up to at least
D(D+1)/2 bytes, hence at most sqrt(2 x corpus bytes) rows reach the driver,
however many groups there are, and they arrive as a stream. The schedule it
makes (at most ``shards`` ranges of ranks for each size) leaves the driver as a
stream as well: it is written in parts of SCHEDULE_ROWS rows and joined back.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterwise.llm.common import cut, split_rank
from meterwise.session import fresh_path

SCHEDULE_ROWS = 200_000  # rows of the schedule that the driver holds at once
SCHEDULE = "group_bytes long, low long, high long, shard int"


def lpt_schedule(sizes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, int, int, int]]:
    """(size, low, high, shard): of the groups of a size, ranks low <= r < high go to shard.

    ``sizes`` holds (size, number of groups), sizes descending. Ties between
    loads go to the lower shard. A long run of equal sizes first skips, by
    bisection on the load, what the heap would certainly deal out, then the
    heap deals the rest one group at a time.
    """
    loads = [0] * shards
    for size, count in sizes:
        given = [0] * shards
        if count > 4 * shards:
            low, high = min(loads), max(loads) + size * count
            while low < high:  # the highest level that needs at most count groups
                level = (low + high + 1) // 2
                if sum(max(0, -(-(level - x) // size)) for x in loads) <= count:
                    low = level
                else:
                    high = level - 1
            given = [max(0, -(-(low - x) // size)) for x in loads]
        heap = [(x + size * n, i) for i, (x, n) in enumerate(zip(loads, given))]
        heapq.heapify(heap)
        for _ in range(count - sum(given)):
            load, i = heap[0]
            heapq.heapreplace(heap, (load + size, i))
            given[i] += 1
        at = 0
        for i, n in enumerate(given):
            if n:
                yield size, at, at + n, i
                at += n
            loads[i] += size * n


def written(spark: SparkSession, schedule: Iterator[tuple[int, int, int, int]]) -> DataFrame:
    """The schedule as a table; at most SCHEDULE_ROWS of its rows are in the driver at any time."""
    path = fresh_path(spark, "llm")
    part = None
    while part is None or len(part) == SCHEDULE_ROWS:
        part = list(islice(schedule, SCHEDULE_ROWS))
        spark.createDataFrame(part, SCHEDULE).write.mode("append").parquet(path)
    return spark.read.schema(SCHEDULE).parquet(path)


def lpt_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot for every row; rows of equal text share a shard.

    Returns id_col, size (UTF-8 bytes plus 1; null text: 1), text_crc32
    (unsigned; null: that of no bytes), law ("bytes"), shard, slot (gapless from
    0 within the shard) and grown_shard (null: the law is not ``key``).
    Null texts form a group of their own beside empty ones. Repeated rows are
    rows. An empty table gives an empty result. A very long text is a row like any
    other: only its size and hashes are kept. A group is known by size, crc32 and
    xxhash64 together.
    """
    spark = docs.sparkSession
    rows = cut(docs.select(
        F.col(id_col), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit(""))).alias("text_crc32"),
        F.xxhash64(text_col, F.col(text_col).isNull()).alias("_h")))
    key = ["size", "text_crc32", "_h"]
    groups = cut(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
                 .withColumn("group_bytes", F.col("size") * F.col("_n")))
    sizes = groups.groupBy("group_bytes").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("group_bytes"))
    plan = written(spark, lpt_schedule(sizes.toLocalIterator(), shards))
    ranked = split_rank(groups, ["group_bytes"], key, "_rank", groups.count())
    placed = ranked.join(plan, "group_bytes").where("low <= _rank and _rank < high").select(*key, "shard")
    sharded = cut(rows.join(placed, key).select(F.col(id_col).alias("_id"), "size", "text_crc32", "shard"))
    return split_rank(sharded, ["shard"], ["_id", "text_crc32"], "slot", rows.count()).select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
