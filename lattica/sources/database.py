"""The encoded database on disk: tables, edges, tasks, embeddings and metadata, and its loader."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.sources.annotation import Annotation, SType


def folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where it is unset and all runs on one machine, the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (at or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def written(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df as a Parquet table in the shared folder: what follows reads the same rows however often it is computed.

    by names columns whose values get a folder each, so that a filter on them leaves the other folders unread.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/lattica/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lattica_path = path
    return out


def forget(tables: list[DataFrame]) -> None:
    """Deletes tables made by written() that nothing is going to read again."""
    for t in tables:
        at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._lattica_path)
        at.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


@dataclass
class Database:
    """An encoded database; tables are read when they are asked for."""

    spark: SparkSession
    path: str
    annotation: Annotation
    metadata: dict

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Database:
        meta = json.loads(read_text(spark, f"{path}/metadata.json"))
        return cls(spark, path, Annotation.parse(json.dumps(meta["annotation"])), meta)

    def table(self, name: str) -> DataFrame:
        """row_id, _us (the row's time, where the table has one) and the encoded columns."""
        return self.spark.read.parquet(f"{self.path}/tables/{name}")

    @property
    def edges(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/edges")

    @property
    def seeds(self) -> DataFrame:
        """task, task_idx, seed_idx, row_id, obs, bucket, split and a value of the task's type, of all tasks."""
        return self.spark.read.parquet(f"{self.path}/tasks")

    def embeddings(self, kind: str) -> DataFrame:
        """(idx, text, emb) of column, categorical or text."""
        return self.spark.read.parquet(f"{self.path}/embeddings").filter(F.col("kind") == kind).drop("kind")

    @property
    def offsets(self) -> dict[str, int]:
        out, at = {}, 0
        for t, n in self.metadata["rows"].items():
            out[t] = at
            at += n
        return out

    @property
    def times(self) -> DataFrame:
        """(row_id, us) of every row with a time."""
        out = self.spark.createDataFrame([], "row_id long, us long")
        for t in self.annotation.tables.values():
            if t.temporal_column:
                out = out.unionAll(self.table(t.name).select("row_id", F.col("_us").alias("us")).filter("us is not null"))
        return out

    @property
    def row_cells(self) -> DataFrame:
        """(row_id, cells) of all rows of all tables."""
        from lattica.operators.encode import row_cells

        out = None
        for t in self.annotation.tables.values():
            part = row_cells(self.table(t.name), t)
            out = part if out is None else out.unionByName(part)
        return out

    @property
    def cells(self) -> DataFrame:
        """All rows of all tables in long form."""
        return self.row_cells.select("row_id", F.inline("cells"))

    def value(self, row_id: int, column: str):
        """One encoded value of a row."""
        for t, first in reversed(self.offsets.items()):
            if row_id >= first:
                r = self.table(t).filter(F.col("row_id") == row_id).select(column).first()
                return None if r is None else r[0]
        return None

    def values(self, rows: DataFrame, table: str, column: str) -> DataFrame:
        """rows (row_id) of a table with the cell of one column: present (it is not null), value as encoded, and _us, the row's time or null.

        An identifier's value is its presence. Rows that are not the table's own are left out; all cells come from one join.
        """
        own = self.table(table)
        time = F.col("_us") if "_us" in own.columns else F.lit(None).cast("bigint")
        cell = F.col(f"`{column}`")
        present = cell if self.annotation.tables[table].columns[column].stype == SType.IDENTIFIER else cell.isNotNull()
        return rows.select("row_id").join(own.select("row_id", present.alias("present"), cell.alias("value"), time.alias("_us")), "row_id")

    def embedded(self, rows: DataFrame, kind: str, idx: str = "idx") -> DataFrame:
        """rows with text and emb of the vocabulary's entry that the column idx names; null for those without one."""
        entries = self.embeddings(kind).withColumnRenamed("idx", "_entry")
        return rows.join(entries, F.col(f"`{idx}`") == F.col("_entry"), "left").drop("_entry")

    def widths(self) -> list[tuple[int, int]]:
        """(first row, cells a row) of each table that has rows."""
        return [(self.offsets[t.name], sum(c.stype != SType.IGNORED for c in t.columns.values())) for t in self.annotation.tables.values() if self.metadata["rows"][t.name]]
