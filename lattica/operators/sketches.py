"""Profiles of columns from sketches that are kept for each file and merged, so that a file is read once, all columns at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import scalar as S

#: Registers of a distinct count (2 to this power: 1.6 % standard error) and size of a quantile sketch (about 0.4 % of rank).
REGISTERS, RANKS = 12, 800


def _path(file: Column) -> Column:
    """A file's path with one slash after the scheme, since scans and listings differ there."""
    return F.regexp_replace(file, "^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")


def sketched(df: DataFrame, columns: list[str]) -> DataFrame:
    """(file, col, total, nulls, numbers, sum, low, high, first, last, values, ranks) of each column in each file of a table scan.

    numbers counts what is a number, with sum, low, high and ranks of those; first and last are the least and greatest
    text, values sketches the distinct texts. One aggregation makes all; a column without values has empty sketches.
    """

    def one(name: str) -> list:
        c = F.col(f"`{name}`")
        x, t = S.as_double(c), c.cast("string")
        x = F.when(~F.isnan(x), x)
        return [
            F.count("*").alias("total"), F.count_if(c.isNull()).alias("nulls"), F.count(x).alias("numbers"), F.sum(x).alias("sum"), F.min(x).alias("low"), F.max(x).alias("high"),
            F.min(t).alias("first"), F.max(t).alias("last"), F.hll_sketch_agg(t, REGISTERS).alias("values"), F.kll_sketch_agg_double(x, RANKS).alias("ranks"),
        ]

    # struct fields of aggregates: one row a file, then a row a column
    wide = df.groupBy(_path(F.col("_metadata.file_path")).alias("file")).agg(*(F.struct(F.lit(c).alias("col"), *one(c)).alias(f"c{i}") for i, c in enumerate(columns)))
    return wide.select("file", F.inline(F.array(*(f"c{i}" for i in range(len(columns))))))


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """As sketched(), of several files together: for each column (and what else is named), whatever the order they are merged in."""
    total = lambda c: F.sum(c).alias(c)
    return sketches.groupBy(*by, "col").agg(
        total("total"), total("nulls"), total("numbers"), total("sum"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.min("first").alias("first"), F.max("last").alias("last"), F.hll_union_agg("values").alias("values"), F.kll_merge_agg_double("ranks").alias("ranks"),
    )


def profiles(sketches: DataFrame) -> DataFrame:
    """sketches with mean and median of the numbers (null without any) and the number of distinct values in place of sketches."""
    some = F.col("numbers") > 0
    return sketches.select(
        *(c for c in sketches.columns if c not in ("values", "ranks")), F.hll_sketch_estimate("values").alias("distinct"),
        F.when(some, F.col("sum") / F.col("numbers")).alias("mean"), F.when(some, F.kll_sketch_get_quantile_double("ranks", F.lit(0.5))).alias("median"),
    )


def refreshed(spark: SparkSession, table: str, store: str, columns: list[str]) -> DataFrame:
    """The sketches kept in a folder of a Parquet table's files, after reading those that are not among them yet.

    Files are told apart by their paths: one rewritten under its old name is not noticed, one deleted is left out. What
    is added comes in one write, so that a run that fails adds nothing.
    """
    files = spark.createDataFrame([(f,) for f in spark.read.parquet(table).inputFiles()], "path string").withColumn("file", _path(F.col("path")))
    at = spark._jvm.org.apache.hadoop.fs.Path(store)
    kept = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    fresh = files.join(spark.read.parquet(store).select("file"), "file", "left_anti") if kept else files
    fresh = [r.path for r in fresh.collect()]
    if fresh:
        sketched(spark.read.parquet(*fresh), columns).write.mode("append").parquet(store)
    return spark.read.parquet(store).join(files.select("file"), "file", "left_semi")
