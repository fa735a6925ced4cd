"""Column statistics, in one aggregation a table."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import scalar as S
from lattica.operators.vocabulary import numbered
from lattica.sources.annotation import SType, Table


@dataclass
class Stats:
    """num_nulls counts values that are null or do not fit the type; mean and std are of the sample, std 1 for one value or none."""

    stype: SType
    num_nulls: int = 0
    min: float | int | None = None
    max: float | int | None = None
    mean: float | None = None
    std: float | None = None
    num_true: int | None = None
    num_false: int | None = None
    categories: list[str] = field(default_factory=list)

    def dump(self) -> dict:
        return asdict(self) | {"stype": self.stype.name.lower()}


def exact_mean(us: Column) -> Column:
    """Mean of 64-bit integers from an exact sum."""
    return (F.sum(us.cast("decimal(38,0)")).cast("double") / F.count(us)).cast("double")


def _sample_std(x: Column) -> Column:
    return F.when(F.count(x) <= 1, 1.0).otherwise(F.stddev_samp(x))


def aggregates(stype: SType, c: Column) -> Column:
    """A struct of what is known of one column of this type; c as it stands in the data."""
    if stype == SType.NUMERICAL:
        x = S.as_double(c)
        zero = lambda f: F.coalesce(f, F.lit(0.0))
        return F.struct(F.count_if(x.isNull()).alias("num_nulls"), zero(F.min(x)).alias("min"), zero(F.max(F.when(~F.isnan(x), x))).alias("max"), zero(F.avg(x)).alias("mean"), _sample_std(x).alias("std"))
    if stype == SType.TIMESTAMP:
        us = S.micros(S.as_time(c))
        return F.struct(
            F.count_if(us.isNull()).alias("num_nulls"), F.coalesce(F.min(us), F.lit(0)).alias("min"), F.coalesce(F.max(us), F.lit(0)).alias("max"),
            F.when(F.count(us) > 0, exact_mean(us)).otherwise(0.0).alias("mean"), _sample_std(us.cast("double")).alias("std"),
        )
    if stype == SType.BOOLEAN:
        b = S.as_boolean(c)
        return F.struct(F.count_if(b.isNull()).alias("num_nulls"), F.count_if(b).alias("num_true"), F.count_if(~b).alias("num_false"))
    return F.struct(F.count_if(c.isNull()).alias("num_nulls"))


def table_stats(df: DataFrame, table: Table) -> dict[str, Stats]:
    """Statistics of every column of table but its ignored ones; categories are not among them."""
    have = set(df.columns)
    used = [c for c in table.columns.values() if c.stype != SType.IGNORED and c.name in have]
    out = {c.name: Stats(c.stype) for c in table.columns.values()}
    if used:
        row = df.agg(*[aggregates(c.stype, F.col(f"`{c.name}`")).alias(f"c{c.index}") for c in used]).first()
        for c in used:
            out[c.name] = Stats(c.stype, **row[f"c{c.index}"].asDict())
    for c in table.columns.values():
        if c.name not in have:
            out[c.name] = Stats(c.stype, **{SType.NUMERICAL: dict(min=0.0, max=0.0, mean=0.0, std=1.0), SType.TIMESTAMP: dict(min=0, max=0, mean=0.0, std=1.0), SType.BOOLEAN: dict(num_true=0, num_false=0)}.get(c.stype, {}))
    return out


def categories(df: DataFrame, column: str) -> DataFrame:
    """(category, place): distinct values as text in the order of their bytes, numbered from 0. One row a category."""
    values = df.select(S.as_text(F.col(f"`{column}`")).alias("category")).filter("category is not null").distinct()
    return numbered(values, ["category"], "place").select("category", F.col("place").cast("int").alias("place"))


def all_times(parts: list[tuple[DataFrame, str]]) -> DataFrame:
    """(us) of every time of the columns named."""
    out = None
    for df, column in parts:
        us = df.select(S.micros(S.as_time(F.col(f"`{column}`"))).alias("us")).filter("us is not null")
        out = us if out is None else out.unionAll(us)
    return out


def time_scale(times: DataFrame) -> DataFrame:
    """One row (mean, std) over all times: exact sum, sample deviation; 0 and 1 without times, 1 with one."""
    return times.agg(F.when(F.count("us") > 0, exact_mean(F.col("us"))).otherwise(0.0).alias("mean"), _sample_std(F.col("us").cast("double")).alias("std"))
