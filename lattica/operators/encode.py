"""Typed encodings of table columns and task targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import scalar as S
from lattica.operators.stats import Stats
from lattica.sources.annotation import SType, Table

#: Spark types of encoded columns by semantic type.
STORED = {SType.IDENTIFIER: "boolean", SType.NUMERICAL: "float", SType.TIMESTAMP: "array<float>", SType.BOOLEAN: "boolean", SType.CATEGORICAL: "bigint", SType.TEXT: "bigint"}


def scalar_encoding(stype: SType, c: Column, stats: Stats | None, scale: tuple[float, float]) -> Column | None:
    """The encoding that needs no vocabulary, or None: presence, z-score, time vector, truth."""
    if stype == SType.IDENTIFIER:
        return c.isNotNull()
    if stype == SType.NUMERICAL:
        return S.zscore(S.as_double(c), stats.mean or 0.0, stats.std if stats.std is not None else 1.0).cast("float")
    if stype == SType.TIMESTAMP:
        return S.time_vector(S.as_time(c), *scale)
    if stype == SType.BOOLEAN:
        return S.as_boolean(c)
    return None


def encode_table(rows: DataFrame, table: Table, stats: dict[str, Stats], scale: tuple[float, float], categories: DataFrame, texts: DataFrame) -> DataFrame:
    """row_id and, under their names, the encoded columns of a table, but for ignored ones; values that do not fit are null.

    Categories and texts become numbers of their vocabulary, those not in it 0. Categories of one column are few and
    joined as a broadcast if they are small; texts are joined by shuffle.
    """
    out = rows
    chosen = ["row_id"]
    if table.temporal_column:
        us = S.micros(S.as_time(F.col(f"`{table.temporal_column}`")))
        out = out.withColumn("_us", us)
        chosen.append("_us")
    for c in table.columns.values():
        source = F.col(f"`{c.name}`")
        if c.stype == SType.IGNORED:
            continue
        if c.stype == SType.CATEGORICAL:
            own = categories.filter(F.col("column_idx") == c.index).select(F.col("category").alias("_value"), F.col("idx").alias("_idx"))
            out = out.join(own, S.as_text(source) == F.col("_value"), "left")
            value = F.when(source.isNotNull(), F.coalesce("_idx", F.lit(0)))
        elif c.stype == SType.TEXT:
            own = texts.select(F.col("text").alias("_value"), F.col("idx").alias("_idx"))
            out = out.withColumn("_key", S.truncated(S.as_text(source))).join(own, F.col("_key") == F.col("_value"), "left").drop("_key")
            value = F.when(source.isNotNull(), F.coalesce("_idx", F.lit(0)))
        else:
            value = scalar_encoding(c.stype, source, stats[c.name], scale)
        out = out.withColumn(f"_e{c.index}", value).drop("_value", "_idx")
        chosen.append(F.col(f"_e{c.index}").alias(c.name))
    return out.select(*chosen)


def row_cells(encoded: DataFrame, table: Table) -> DataFrame:
    """(row_id, cells) of encoded rows: an array of pos (place among the row's cells), column_idx, stype, is_null and one value of each type.

    An identifier's cell is never null, whether or not it is present.
    """
    cols = [c for c in table.columns.values() if c.stype != SType.IGNORED]
    none = {"numeric": "float", "timestamp": "array<float>", "boolean": "boolean", "categorical": "bigint", "text": "bigint"}
    slot = {SType.NUMERICAL: "numeric", SType.TIMESTAMP: "timestamp", SType.BOOLEAN: "boolean", SType.CATEGORICAL: "categorical", SType.TEXT: "text"}
    made = []
    for pos, c in enumerate(cols):
        own = F.col(f"`{c.name}`")
        values = [(own if slot.get(c.stype) == n else F.lit(None)).cast(k).alias(n) for n, k in none.items()]
        null = F.lit(False) if c.stype == SType.IDENTIFIER else own.isNull()
        made.append(F.struct(F.lit(pos).alias("pos"), F.lit(c.index).alias("column_idx"), F.lit(int(c.stype)).alias("stype"), null.alias("is_null"), *values))
    return encoded.select("row_id", F.array(*made).alias("cells"))


def cells(encoded: DataFrame, table: Table) -> DataFrame:
    """The cells of encoded rows, one a row of the table: row_id and the fields of row_cells()."""
    return row_cells(encoded, table).select("row_id", F.inline("cells"))
