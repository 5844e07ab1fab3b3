"""Helpers shared by the operators: lineage cuts, hold-out rule, split ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from meterwise.session import fresh_path

RANK_ROWS = 65_536  # rows that one rank window sorts, on average
ARROW_ROWS = 2_000  # whole texts in an Arrow batch, which stands several times in a task's JVM and Python memory


def small_batches(spark) -> None:
    """Python workers get at most ARROW_ROWS rows at once; a session's own smaller limit stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table outlives lost executors, and what follows is planned on
    its real size.
    """
    path = fresh_path(df.sparkSession, "llm")
    small_batches(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_fields(schema: StructType, ddl: str) -> StructType:
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text modulo ``n`` (null id: null)."""
    return F.crc32(doc_id.cast("string")) % n


def split_rank(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str, rows: int) -> DataFrame:
    """Add ``name``: a gapless rank from 0 within ``group``, no group in one task.

    Rows are dealt into chunks by a hash of ``order``; a row's rank is its place
    in its (group, chunk) plus the sizes of the group's chunks before it. The
    only window over a whole group has one row per chunk. ``df`` is read twice,
    so it should be a written table. Null group or order values are values
    like any other; rows equal in ``order`` take their ranks in any order.
    """
    chunks = max(1, -(-rows // RANK_ROWS))
    keyed = df.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int"))
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (keyed.groupBy(*group, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
              .select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_chunk").alias("_c"), "_start"))
    own = Window.partitionBy(*group, "_chunk").orderBy(*order)
    placed = keyed.withColumn("_place", F.row_number().over(own) - 1)
    same = placed["_chunk"] == starts["_c"]
    for i, g in enumerate(group):
        same = same & placed[g].eqNullSafe(starts[f"_g{i}"])
    return (placed.join(starts, same).withColumn(name, (F.col("_start") + F.col("_place")).cast("long"))
            .drop("_chunk", "_c", "_n", "_start", "_place", *[f"_g{i}" for i in range(len(group))]))
