"""Batches as a stream: a source of their numbers, whose offset in a checkpoint is what makes production restartable."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType


class BatchNumbers(DataSource):
    """Rows (number) from 0 on, `each` a micro-batch, up to but without `until` if that is given."""

    @classmethod
    def name(cls) -> str:
        return "batch_numbers"

    def schema(self) -> str:
        return "number long"

    def simpleStreamReader(self, schema: StructType) -> _Numbers:
        until = self.options.get("until")
        return _Numbers(max(1, int(self.options.get("each", "1"))), None if until is None else int(until))

    @classmethod
    def register(cls, spark: SparkSession) -> None:
        spark.dataSource.register(cls)


class _Numbers(SimpleDataSourceStreamReader):
    """An offset is the number that comes next."""

    def __init__(self, each: int, until: int | None):
        self.each, self.until = each, until

    def initialOffset(self) -> dict:
        return {"next": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        first = start["next"]
        end = first + self.each if self.until is None else max(first, min(first + self.each, self.until))
        return self.readBetweenOffsets(start, {"next": end}), {"next": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([(n,) for n in range(start["next"], end["next"])])
