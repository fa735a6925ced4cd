"""The first k rows of every group by radix selection: histograms over a value's bits, ties over the bytes of a text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.shared import sized, written

#: Bits of a value and bytes of a text that one histogram looks at.
BITS, BYTES = 12, 2
#: A group is refined no further when so many times k rows are left of it.
ENOUGH = 4


def first_ranked(rows: DataFrame, groups: list[str], k: int, value: str = "value", item: str = "item") -> DataFrame:
    """rows (groups, value, item) with rank: of each group the first k by value descending, then item ascending by UTF-8 bytes.

    rows is a written table; values are longs of 0 or more, items differ within a group, groups are not null. Each round
    counts, for all groups at once, the rows of the bucket with the k-th row by the next bits of their value, and keeps
    one bucket: so the k-th value is found without sorting or gathering a group. Where more rows share it than are
    wanted, the next bytes of their items go on in the same way. What is left of a group, ENOUGH * k rows at most, is ranked.
    """
    # lo: the least value of the bucket; need: how many rows are wanted of its n; prefix: what its items begin with
    state = rows.groupBy(*groups).agg(F.count("*").alias("n"), F.max(value).alias("_most"))
    state = written(state.withColumns({"lo": F.lit(0).cast("long"), "need": F.lit(k).cast("long"), "prefix": F.lit(None).cast("binary")}), "state")
    most = state.agg(F.max("_most")).first()[0] or 0
    state = state.drop("_most")
    closed, refine = [], F.col("need") < F.col("n") - (ENOUGH - 1) * k
    text = F.col(item).cast("binary")
    shifts = [s for s in range(0, 63, BITS) if most >> s][::-1]
    step = 0
    while True:
        closed.append(state.filter(~refine))
        open_ = written(state.filter(refine), "state")
        if open_.isEmpty():
            break
        found = rows.join(sized(open_), groups)
        if step < len(shifts):
            shift = shifts[step]
            found = found.filter(F.shiftright(value, shift + BITS) == F.shiftright("lo", shift + BITS)) if step else found
            digit, order = F.shiftright(value, shift), F.col("digit").desc()
        else:
            known = F.coalesce("prefix", F.lit(b""))
            head = F.substring(text, F.lit(1), F.length(known))
            found = found.filter((F.col(value) == F.col("lo")) & (head == known))
            digit, order = F.substring(text, F.length(known) + 1, F.lit(BYTES)), F.col("digit").asc()
        bins = found.groupBy(*groups, digit.alias("digit")).agg(F.count("*").alias("c"), F.first("need").alias("need"), F.first("lo").alias("lo"), F.first("prefix").alias("prefix"))
        upto = bins.withColumn("upto", F.sum("c").over(Window.partitionBy(*groups).orderBy(order)))
        bucket = upto.filter("upto >= need and upto - c < need").withColumns({"n": F.col("c"), "need": F.col("need") - F.col("upto") + F.col("c")})
        if step < len(shifts):
            bucket = bucket.withColumn("lo", F.shiftleft("digit", shift))
        else:
            bucket = bucket.withColumn("prefix", F.concat(F.coalesce("prefix", F.lit(b"")), "digit"))
        state = written(bucket.select(*groups, "n", "lo", "need", "prefix"), "state")
        step += 1
    bounds = closed[0]
    for c in closed[1:]:
        bounds = bounds.unionByName(c)
    bounds = written(bounds.select(*groups, "lo", "prefix"), "bounds")
    within = (F.col(value) > F.col("lo")) | ((F.col(value) == F.col("lo")) & (F.col("prefix").isNull() | (F.substring(text, F.lit(1), F.length("prefix")) <= F.col("prefix"))))
    within = F.when(F.col("prefix").isNull(), F.col(value) >= F.col("lo")).otherwise(within)
    left = rows.join(sized(bounds), groups).filter(within).drop("lo", "prefix")
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(F.col(value).desc(), F.col(item).asc()))
    return left.withColumn("rank", rank).filter(F.col("rank") <= k)
