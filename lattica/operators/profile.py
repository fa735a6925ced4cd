"""What an annotator wants to know about columns, and a draft of an annotation by rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions import scalar as S
from lattica.sources.annotation import Annotation, Column, SType, Table
from lattica.sources.database import written
from lattica.sources.tables import listed, read

MOST_VALUES = 50


def distinct(df: DataFrame, column: str) -> DataFrame:
    """total, distinct (of values that are not null) and nulls."""
    c = F.col(f"`{column}`")
    return df.agg(F.count("*").alias("total"), F.count_distinct(c).alias("distinct"), F.count_if(c.isNull()).alias("nulls"))


def value_counts(df: DataFrame, column: str, k: int = MOST_VALUES) -> DataFrame:
    """(value, n) of the k most frequent values as text, null among them; of equal counts the smaller text first."""
    counts = df.groupBy(F.col(f"`{column}`").cast("string").alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(min(k, MOST_VALUES))


def column_profile(df: DataFrame, column: str, exact_median: bool = True) -> DataFrame:
    """total, nulls, non_null, min, max, mean, std (sample), median and dominant: the share of the most frequent value among those not null."""
    c = F.col(f"`{column}`")
    x = S.as_double(c)
    r = lambda v: F.round(v, 6)
    median = F.percentile(x, F.lit(0.5)) if exact_median else F.percentile_approx(x, 0.5)
    base = df.agg(
        F.count("*").alias("total"), F.count_if(c.isNull()).alias("nulls"), F.count(c).alias("non_null"), r(F.min(x)).alias("min"), r(F.max(x)).alias("max"),
        r(F.avg(x)).alias("mean"), r(F.stddev_samp(x)).alias("std"), r(median).alias("median"),
    )
    top = df.filter(c.isNotNull()).groupBy(c).count().agg(F.max("count").alias("most"))
    return base.crossJoin(F.broadcast(top)).select("*", F.round(F.when(F.col("non_null") > 0, F.col("most") / F.col("non_null")).otherwise(0.0), 4).alias("dominant")).drop("most")


def contained(df: DataFrame, column: str, other: DataFrame, key: str) -> DataFrame:
    """total (values not null, repeated ones counted), matched and rate (4 places, 0 without values) of a foreign key's values among a key's."""
    v = df.select(F.col(f"`{column}`").alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    k = other.select(F.col(f"`{key}`").alias("v"), F.lit(1).alias("hit")).filter("v is not null").distinct()
    out = v.join(k, "v", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n"))), F.lit(0)).alias("matched"))
    return out.withColumn("rate", F.round(F.when(F.col("total") > 0, F.col("matched") / F.col("total")).otherwise(0.0), 4))


def inclusions(parts: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """(col, holder, total, matched, rate) of every two of the columns (name, table, column): as contained() has it for each pair.

    All columns' values are grouped once, each to the set of columns that hold it; how often a column's values have which
    set is all that pairs need, and sets are few, however many values there are. Values are compared as 64-bit integers,
    others are left out. A column without values is held by none.
    """
    values = None
    for name, df, column in parts:
        own = df.select(F.lit(name).alias("col"), S.as_long(F.col(f"`{column}`")).alias("v")).filter("v is not null").groupBy("col", "v").agg(F.count("*").alias("n"))
        values = own if values is None else values.unionAll(own)
    sets = values.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("col", "n"))).alias("held"))
    sets = sets.select(F.col("held.col").alias("holders"), F.inline("held")).groupBy("holders", "col").agg(F.sum("n").alias("n"))
    pairs = sets.select("col", "n", F.explode("holders").alias("holder")).groupBy("col", "holder").agg(F.sum("n").alias("matched"))
    pairs = written(pairs, "pairs")  # at most a row for each two columns
    total = F.broadcast(pairs.filter("col = holder").select("col", F.col("matched").alias("total")))
    return pairs.filter("col <> holder").join(total, "col").withColumn("rate", F.round(F.col("matched") / F.col("total"), 4)).select("col", "holder", "total", "matched", "rate")


def draft(spark: SparkSession, data_dir: str, name: str) -> Annotation:
    """An annotation by rules: types from physical types, names and distinct counts; keys from uniqueness; references from names and containment."""
    frames = {t: read(spark, data_dir, t) for t in listed(spark, data_dir)}
    tables, unique = {}, {}
    for t, df in frames.items():
        row = df.agg(
            F.count("*").alias("n"), *[F.approx_count_distinct(f"`{f.name}`").alias(f"d{i}") for i, f in enumerate(df.schema) if isinstance(f.dataType, T.AtomicType)],
            *[F.avg(F.length(f"`{f.name}`")).alias(f"l{i}") for i, f in enumerate(df.schema) if isinstance(f.dataType, T.StringType)],
            *[F.avg(F.size(F.split(f"`{f.name}`", " "))).alias(f"w{i}") for i, f in enumerate(df.schema) if isinstance(f.dataType, T.StringType)],
        ).first().asDict()
        n = max(1, row["n"])
        columns, key = {}, None
        for i, f in enumerate(df.schema):
            d, low = row.get(f"d{i}"), f.name.lower()
            named = low.endswith(("id", "key"))
            if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
                kind = SType.TIMESTAMP
            elif isinstance(f.dataType, T.BooleanType):
                kind = SType.BOOLEAN
            elif isinstance(f.dataType, T.IntegralType) and named:
                kind = SType.IDENTIFIER
            elif d is None:
                kind = SType.IGNORED
            elif isinstance(f.dataType, T.NumericType):
                kind = SType.CATEGORICAL if isinstance(f.dataType, T.IntegralType) and d < 20 and d / n < 0.01 else SType.NUMERICAL
            elif d < 100 and d / n < 0.5:
                kind = SType.CATEGORICAL
            elif (row[f"w{i}"] or 0) >= 3 and (row[f"l{i}"] or 0) >= 20:
                kind = SType.TEXT
            else:
                kind = SType.IDENTIFIER
            columns[f.name] = Column(f.name, kind)
            if key is None and kind == SType.IDENTIFIER and isinstance(f.dataType, T.IntegralType) and named and d >= 0.9 * n and df.agg(F.count_distinct(f"`{f.name}`")).first()[0] == row["n"]:
                key = f.name
        times = [c.name for c in columns.values() if c.stype == SType.TIMESTAMP]
        tables[t] = Table(t, columns, key, times[0] if len(times) == 1 else None)
        if key:
            unique[t] = key
    stem = lambda c: c.lower().rpartition("_")[2]
    whole = [(t, c) for t, table in tables.items() for c in table.columns.values() if c.stype == SType.IDENTIFIER and isinstance(frames[t].schema[c.name].dataType, T.IntegralType)]
    rates = {(r.col, r.holder): r.rate for r in inclusions([(f"{t}.{c.name}", frames[t], c.name) for t, c in whole]).collect()} if whole else {}
    for t, c in whole:
        for other, key in unique.items():
            if c.name != tables[t].primary_key and other != t and stem(c.name) == stem(key) and rates.get((f"{t}.{c.name}", f"{other}.{key}"), 0) >= 0.99:
                c.foreign_key = f"{other}.{key}"
                break
    return Annotation(name, tables)
