"""Raw tables: Parquet files with global row numbers, their catalog, and what an annotator asks about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.sources.annotation import Annotation

MOST_SAMPLED, MOST_QUERIED = 50, 10
#: A physical row's number in its table: files in name order, rows in file order.
LOCAL = "_local_row"


def listed(spark: SparkSession, data_dir: str) -> list[str]:
    """Names of the data sets under data_dir, sorted; any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(data_dir)
    names = [s.getPath().getName() for s in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)]
    return sorted(n.removesuffix(".parquet") for n in names if n.endswith(".parquet"))


def read(spark: SparkSession, data_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{data_dir}/{table}.parquet")


def with_local_rows(df: DataFrame) -> DataFrame:
    """df, straight from a Parquet scan, with each row's number in its table from 0.

    Several files are numbered in the order of their names; only their row counts go to the driver.
    """
    named = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias(LOCAL))
    if len(df.inputFiles()) < 2:
        return named.drop("_file")
    counts = named.groupBy("_file").agg(F.count("*").alias("n")).collect()
    before, starts = 0, []
    for r in sorted(counts):
        starts.append((r._file, before))
        before += r.n
    starts = df.sparkSession.createDataFrame(starts, "_file string, _before long")
    return named.join(F.broadcast(starts), "_file").withColumn(LOCAL, F.col(LOCAL) + F.col("_before")).drop("_file", "_before")


class RawDatabase:
    """Tables of one annotation and the offsets that make their row numbers global."""

    def __init__(self, spark: SparkSession, data_dir: str, annotation: Annotation):
        self.spark, self.data_dir, self.annotation = spark, data_dir, annotation
        self._counts: dict[str, int] | None = None

    def scan(self, table: str) -> DataFrame:
        return read(self.spark, self.data_dir, table)

    @property
    def counts(self) -> dict[str, int]:
        """Rows of each table, from Parquet footers."""
        if self._counts is None:
            self._counts = {t: self.scan(t).count() for t in self.annotation.tables}
        return self._counts

    @property
    def offsets(self) -> dict[str, int]:
        out, at = {}, 0
        for t, n in self.counts.items():
            out[t] = at
            at += n
        return out

    def rows(self, table: str) -> DataFrame:
        """The columns that the annotation names and the data have, with the global number row_id and the local one.

        What the annotation lacks is dropped; what the data lack comes as null.
        """
        df = self.scan(table)
        have = set(df.columns)
        columns = [F.col(f"`{c}`") if c in have else F.lit(None).cast("string").alias(c) for c in self.annotation.tables[table].columns]
        numbered = with_local_rows(df)
        return numbered.select(*columns, F.col(LOCAL), (F.col(LOCAL) + F.lit(self.offsets[table])).alias("row_id"))

    def register(self) -> None:
        """Every table as a temporary view under its own name."""
        for t in self.annotation.tables:
            self.scan(t).createOrReplaceTempView(f"`{t}`")

    def table_of(self, rows: DataFrame, column: str = "row_id") -> DataFrame:
        """rows with table_idx and local_row of a global row number; the ranges are one row a table."""
        offsets = [(self.annotation.tables[t].index, o, o + self.counts[t]) for t, o in self.offsets.items()]
        ranges = self.spark.createDataFrame(offsets, "table_idx int, _start long, _end long")
        out = rows.join(F.broadcast(ranges), (F.col(column) >= F.col("_start")) & (F.col(column) < F.col("_end")), "left")
        return out.withColumn("local_row", F.col(column) - F.col("_start")).drop("_start", "_end")


def schema_rows(df: DataFrame) -> list[dict]:
    """Name, type and nullability of each column."""
    return [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable} for f in df.schema]


def sample(df: DataFrame, n: int) -> DataFrame:
    """The first n rows of a scan (at most MOST_SAMPLED) as strings, in the order of the file."""
    return with_local_rows(df).orderBy(LOCAL).limit(min(n, MOST_SAMPLED)).select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def query(spark: SparkSession, sql: str) -> list[dict]:
    """Up to MOST_QUERIED rows of a query, as strings; an error is a row of its own."""
    try:
        rows = spark.sql(sql).limit(MOST_QUERIED).collect()
    except Exception as e:  # noqa: BLE001  whatever is wrong with the text is the answer to it
        return [{"error": str(e).splitlines()[0]}]
    return [{k: None if v is None else str(v) for k, v in r.asDict().items()} for r in rows]
