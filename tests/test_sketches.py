"""Sketches of files against exact values."""

import statistics

from lattica.operators import sketches as K

COLUMNS = ["a", "b c", "t", "none"]


def test_merged_sketches_against_exact_values(spark, tmp_path):
    table, store = str(tmp_path / "table"), str(tmp_path / "store")
    rows = [(i * 7919 % 30_011, None if i % 3 else i / 4, f"v{i % 40}", None) for i in range(40_000)]
    make = lambda part: spark.createDataFrame(part, "a long, `b c` double, t string, none int").repartition(3)
    make(rows[:25_000]).write.parquet(table)
    first = K.refreshed(spark, table, store, COLUMNS)
    assert first.select("file").distinct().count() == 3
    before = {r.file for r in first.collect()}
    make(rows[25_000:]).write.mode("append").parquet(table)
    both = K.refreshed(spark, table, store, COLUMNS)
    assert both.count() == 6 * len(COLUMNS) and before < {r.file for r in both.collect()}
    # nothing new: nothing is added
    assert K.refreshed(spark, table, store, COLUMNS).count() == 6 * len(COLUMNS)
    got = {r.col: r for r in K.profiles(K.merged(both)).collect()}
    for k, name in enumerate(COLUMNS):
        own = [r[k] for r in rows if r[k] is not None]
        x, numbers = got[name], [v for v in own if not isinstance(v, str)]
        assert (x.total, x.nulls, x.numbers) == (len(rows), len(rows) - len(own), len(numbers))
        assert abs(x.distinct - len(set(own))) <= 0.05 * len(set(own))
        assert (x.first, x.last) == ((min(map(str, own)), max(map(str, own))) if own else (None, None))
        if numbers:
            assert (x.low, x.high) == (min(numbers), max(numbers)) and abs(x["mean"] - statistics.fmean(numbers)) < 1e-6 * x["mean"]
            rank = sum(v <= x.median for v in numbers) / len(numbers)
            assert abs(rank - 0.5) < 0.01
        else:
            assert x.low is x["mean"] is x.median is None
    assert got["t"].distinct == 40
    empty = str(tmp_path / "empty")
    make([]).write.parquet(empty)
    assert K.merged(K.sketched(spark.read.parquet(empty), COLUMNS)).count() == 0
