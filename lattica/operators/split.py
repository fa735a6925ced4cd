"""Train, validation and test by a hash of task and row; shards of a split for ranks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.siphash import bucket
from lattica.operators.vocabulary import numbered

RATIOS, SPLIT_SEED = (0.8, 0.1, 0.1), 123


def bounds(ratios: tuple[float, float, float] = RATIOS) -> tuple[float, float]:
    """Buckets below the first are train, below the second validation; in 32-bit arithmetic, so 0.8 + 0.1 is a little over 0.9."""
    train, val = np.float32(ratios[0]), np.float32(ratios[1])
    return float(train * np.float32(1000)), float((train + val) * np.float32(1000))


def split_of(b: Column, ratios: tuple[float, float, float] = RATIOS) -> Column:
    train, val = bounds(ratios)
    return F.when(b < train, "train").when(b < val, "val").otherwise("test")


def assigned(seeds: DataFrame, seed: int = SPLIT_SEED, ratios: tuple[float, float, float] = RATIOS) -> DataFrame:
    """seeds (task_idx, row, ...) with bucket and split; row is the anchor's number, as an unsigned 32-bit one."""
    out = seeds.withColumn("bucket", bucket(F.col("task_idx"), F.col("row"), seed))
    return out.withColumn("split", split_of(F.col("bucket"), ratios))


def positioned(seeds: DataFrame, order: tuple[str, ...] = ("seed_idx",)) -> DataFrame:
    """seeds with position, from 0 within each task and split, numbered in ranges and not in one task a split."""
    all_ = numbered(seeds, ["task_idx", "split", *order], "_idx")
    first = all_.groupBy("task_idx", "split").agg(F.min("_idx").alias("_first"))
    return all_.join(F.broadcast(first), ["task_idx", "split"]).withColumn("position", F.col("_idx") - F.col("_first")).drop("_idx", "_first")


def sharded(seeds: DataFrame, rank: int, world: int, order: tuple[str, ...] = ("seed_idx",)) -> DataFrame:
    """Every world-th seed of each task and split, from the rank-th."""
    return positioned(seeds, order).filter(F.col("position") % world == rank).drop("position")


def sizes(seeds: DataFrame) -> DataFrame:
    return seeds.groupBy("task_idx", "split").agg(F.count("*").alias("n"))
