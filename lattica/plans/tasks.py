"""Prediction tasks: SQL over the tables, resolved to anchor rows with observation times and encoded targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import scalar as S
from lattica.operators import stats as A
from lattica.operators.encode import scalar_encoding
from lattica.operators.graph import key_rows
from lattica.sources.annotation import TARGETS, SType, Task
from lattica.sources.tables import RawDatabase


def rewritten(query: str, tables: list[str]) -> str:
    """The query with each literal 'table.parquet' as the quoted name of its view."""
    for t in tables:
        query = query.replace(f"'{t}.parquet'", f"`{t}`")
    return query


def result(db: RawDatabase, task: Task) -> DataFrame:
    """What the task's query gives. Views of the tables must have been registered."""
    return db.spark.sql(rewritten(task.query, list(db.annotation.tables)))


def resolved(db: RawDatabase, task: Task) -> DataFrame:
    """(row_id, obs, target) of the task's seeds: rows whose anchor key is a key of the anchor table.

    obs is in microseconds, null without a limit: the task's own observation time, else the anchor's time, else none.
    target is as the query gives it. Unknown anchor tables, tables without a key and missing columns are errors.
    """
    table = db.annotation.tables.get(task.anchor_table)
    if table is None or not table.primary_key:
        raise ValueError(f"{task.name}: {task.anchor_table} is no table with a primary key")
    if task.target_stype not in TARGETS:
        raise ValueError(f"{task.name}: a target cannot be {task.target_stype.name.lower()}")
    df = result(db, task)
    for c in (task.anchor_key, task.target_column, task.observation_time_column):
        if c and c not in df.columns:
            raise ValueError(f"{task.name}: the query has no column {c}")
    rows = db.rows(task.anchor_table)
    own = df.select(
        S.as_long(F.col(f"`{task.anchor_key}`")).alias("key"), F.col(f"`{task.target_column}`").alias("target"),
        *([S.micros(S.as_time(F.col(f"`{task.observation_time_column}`"))).alias("obs")] if task.observation_time_column else []),
    ).filter("key is not null")
    found = own.join(key_rows(rows, table.primary_key), "key").drop("key")
    if task.observation_time_column:
        return found.select("row_id", "obs", "target")
    if table.temporal_column:
        times = rows.select("row_id", S.micros(S.as_time(F.col(f"`{table.temporal_column}`"))).alias("obs"))
        return found.join(times, "row_id").select("row_id", "obs", "target")
    return found.select("row_id", F.lit(None).cast("bigint").alias("obs"), "target")


def ordered(seeds: DataFrame) -> DataFrame:
    """seeds with seed_idx from 0 in the order of row, time and target: a query's own order is not defined."""
    from lattica.operators.vocabulary import numbered

    return numbered(seeds, ["row_id", "obs", "target"], "seed_idx")


def target_stats(seeds: DataFrame, task: Task) -> A.Stats:
    """Statistics of a task's targets over its seeds."""
    return A.Stats(task.target_stype, **seeds.agg(A.aggregates(task.target_stype, F.col("target")).alias("s")).first()["s"].asDict())


def encoded(seeds: DataFrame, task: Task, stats: A.Stats, scale: tuple[float, float], categories: DataFrame) -> DataFrame:
    """seeds with value in place of target: z-scored by the task's own mean, times by the scale of all times.

    A category's number is that of "<target column> is <value>"; a target named otherwise than its source is not found and is 0.
    """
    if task.target_stype == SType.CATEGORICAL:
        vocabulary = categories.select(F.col("text").alias("_text"), F.col("idx").alias("_idx")).distinct()
        out = seeds.join(vocabulary, S.category_text(task.target_column, S.as_text(F.col("target"))) == F.col("_text"), "left")
        return out.withColumn("value", F.when(F.col("target").isNotNull(), F.coalesce("_idx", F.lit(0)))).drop("_text", "_idx", "target")
    return seeds.withColumn("value", scalar_encoding(task.target_stype, F.col("target"), stats, scale)).drop("target")
