import pytest
from pyspark.sql import functions as F

from spanwarden.operators import reports


@pytest.mark.parametrize("aqe", ["true", "false"])
def test_places_of_two_million_rows(spark, aqe):
    had = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
        n = 2_000_000
        rows = spark.range(n).select(F.format_string("%09d", F.pmod(F.col("id") * 7919, F.lit(n))).alias("file_path"), F.lit(1).alias("line_start"), F.lit("r").alias("rule_id"))
        got = reports.with_place(rows, "place")
        right, low, high, different = got.agg(F.count_if(F.col("file_path").cast("long") == F.col("place")), F.min("place"), F.max("place"), F.count_distinct("place")).first()
        assert (right, low, high, different) == (n, 0, n - 1, n)
    finally:
        for k, v in had.items():
            spark.conf.set(k, v)
