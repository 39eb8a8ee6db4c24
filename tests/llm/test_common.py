import pyarrow as pa
from pyspark.sql import functions as F

from gridlake.llm.common import BATCH_BYTES, written


def test_batches_to_python_are_bounded_while_a_table_is_written(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    rows = spark.range(0, 1000, 1, 1).select(F.repeat(F.lit("x"), 20_000).alias("text"))
    found = written(rows.mapInArrow(sizes, "n long, size long"), "sizes").collect()
    assert sum(r.n for r in found) == 1000
    assert len(found) > 1 and all(r.size <= BATCH_BYTES + 50_000 for r in found)
    assert spark.conf.get(key) == before
