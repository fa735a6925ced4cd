"""From Parquet tables and an annotation to an encoded database."""

from __future__ import annotations

import json

from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.embedders import Embedder, Zero, embedded
from lattica.operators import encode, graph, split, stats, vocabulary
from lattica.plans import tasks
from lattica.sources.annotation import Annotation, SType
from lattica.sources.database import Database, write_text
from lattica.sources.tables import RawDatabase

#: Columns for a task's value by its type.
VALUES = {SType.NUMERICAL: ("numeric", "float"), SType.TIMESTAMP: ("timestamp", "array<float>"), SType.BOOLEAN: ("boolean", "boolean"), SType.CATEGORICAL: ("categorical", "bigint")}


def preprocess(spark: SparkSession, data_dir: str, annotation: Annotation, out: str, embedder: Embedder | None = None, totals: Accumulator | None = None) -> Database:
    """Write the database to out and load it. Tasks without seeds are left out and leave no gap in the numbers.

    totals, from request_totals, adds up the embedder's requests.
    """
    db = RawDatabase(spark, data_dir, annotation)
    known = {t: stats.table_stats(db.scan(t), annotation.tables[t]) for t in annotation.tables}
    times = [(db.scan(t.name), c.name) for t, c in annotation.column_list() if c.stype == SType.TIMESTAMP and c.name in db.scan(t.name).columns]
    scale = tuple(stats.time_scale(stats.all_times(times)).first()) if times else (0.0, 1.0)

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        return spark.read.parquet(f"{out}/{name}")

    categories = kept(vocabulary.categorical(db), "vocabulary/categorical")
    texts = kept(vocabulary.texts(db), "vocabulary/text")
    for row in categories.groupBy("column_idx").agg(F.min_by("idx", "category").alias("start"), F.sort_array(F.collect_list("category")).alias("values")).collect():
        table, column = annotation.column_list()[row.column_idx]
        known[table.name][column.name].categories = row["values"]
        known[table.name][column.name].min = row.start
    strings = vocabulary.all_strings(spark, annotation, categories, texts)
    kept(embedded(strings.withColumn("string", F.col("text")), embedder or Zero(), "string", totals=totals), "embeddings")
    for t in annotation.tables.values():
        kept(encode.encode_table(db.rows(t.name), t, known[t.name], scale, categories, texts), f"tables/{t.name}")
    edges = kept(graph.edges(db), "edges")
    db.register()
    listed, parts = [], None
    for task in annotation.tasks.values():
        seeds = tasks.ordered(tasks.resolved(db, task))
        seeds.write.mode("overwrite").parquet(f"{out}/seeds/{task.name}")
        seeds = spark.read.parquet(f"{out}/seeds/{task.name}")
        n = seeds.count()
        if not n:
            continue
        own = tasks.target_stats(seeds, task)
        name, _ = VALUES[task.target_stype]
        coded = tasks.encoded(seeds, task, own, scale, categories)
        slots = [(F.col("value") if k == name else F.lit(None)).cast(kind).alias(k) for k, kind in VALUES.values()]
        part = coded.select(F.lit(task.name).alias("task"), F.lit(len(listed)).alias("task_idx"), "seed_idx", "row_id", "obs", *slots)
        parts = part if parts is None else parts.unionAll(part)
        listed.append({"name": task.name, "anchor_table": task.anchor_table, "target_column": task.target_column, "target_stype": task.target_stype.name.lower(), "seeds": n, "stats": own.dump()})
    if parts is None:
        parts = spark.createDataFrame([], "task string, task_idx int, seed_idx long, row_id long, obs long, " + ", ".join(" ".join(x) for x in VALUES.values()))
    split_ = split.assigned(parts.withColumn("row", F.col("row_id"))).drop("row")
    split_.write.mode("overwrite").partitionBy("task").parquet(f"{out}/tasks")
    meta = {
        "annotation": json.loads(annotation.dump()),
        "rows": db.counts,
        "edges": edges.count(),
        "time_scale": scale,
        "columns": {t: {c: s.dump() for c, s in x.items()} for t, x in known.items()},
        "foreign_keys": {f"{t.name}.{c.name}": annotation.resolve(c.foreign_key) for t, c in annotation.column_list() if c.foreign_key},
        "vocabulary": {"column": len(annotation.column_list()), "categorical": categories.select("idx").distinct().count(), "text": texts.count()},
        "tasks": listed,
    }
    write_text(spark, f"{out}/metadata.json", json.dumps(meta, indent=2))
    return Database.load(spark, out)
