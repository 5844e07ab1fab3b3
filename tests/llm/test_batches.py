"""Whole texts reach Python workers in small Arrow batches."""

from meterwise.llm.common import ARROW_ROWS, cut, small_batches

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_texts_reach_workers_in_small_batches(spark):
    before = spark.conf.get(ROWS)

    def sizes(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    try:
        spark.conf.set(ROWS, "10000")
        found = [r.n for r in cut(spark.range(0, 9_000, 1, 1).mapInArrow(sizes, "n bigint")).collect()]
        assert sum(found) == 9_000 and max(found) <= ARROW_ROWS
        spark.conf.set(ROWS, "7")
        small_batches(spark)
        assert spark.conf.get(ROWS) == "7"
    finally:
        spark.conf.set(ROWS, before)
