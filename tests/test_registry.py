from pyspark.sql import functions as F

from corpuslode.plans.registry import BATCH_BYTES, table


def test_long_texts_come_to_python_in_bounded_batches(spark, tmp_path):
    spark.range(3000).select("id", F.repeat(F.lit("word "), 2000).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")

    def sizes(it):
        import pyarrow as pa

        for b in it:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    got = [r.n for r in table(spark, str(tmp_path), "documents").mapInArrow(sizes, "n long").collect()]
    assert sum(got) > 3000 * 10_000 and max(got) < 2 * BATCH_BYTES
