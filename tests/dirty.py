"""Folders of tables that are empty, or of which many values are null."""

from pyspark.sql import functions as F

SOURCE = "/root/testdata/sf0.001"


def write_tables(spark, folder, names, empty):
    for name in names:
        df = spark.read.parquet(f"{SOURCE}/{name}.parquet")
        if empty:
            df = df.limit(0)
        else:  # each column is null in other rows, some rows in most; some rows come twice
            h = lambda c: F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(c)), F.lit(5)) == 0
            df = df.select(*[F.when(~h(c), F.col(c)).alias(c) for c in df.columns])
            df = df.unionByName(df.limit(20))
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
