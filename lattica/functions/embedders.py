"""Embedders of strings, and their use on a column.

An embedder is anything with a dimension and embed(list of str) -> array of float; those here need no network but one,
which posts to a service that is named by its caller.
"""

from __future__ import annotations

import json
import random
import time
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import astuple, dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator, AccumulatorParam
from pyspark.sql import DataFrame, SparkSession

DIMENSION, SERVED = 256, 1024
#: Strings of one request, and requests that a task has under way at once.
BATCH, AT_ONCE = 128, 64


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


@dataclass
class Zero:
    dimension: int = DIMENSION

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.zeros((len(texts), self.dimension), np.float32)


@dataclass
class Hashing:
    """Signed hashes of character trigrams, scaled to length 1: like texts have like vectors, everywhere the same."""

    dimension: int = DIMENSION

    def embed(self, texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), self.dimension), np.float32)
        for i, t in enumerate(texts):
            raw = f"\x02{t}\x03".encode()
            for k in range(max(1, len(raw) - 2)):
                h = xxhash.xxh64_intdigest(raw[k : k + 3])
                out[i, h % self.dimension] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=np.zeros_like(out), where=n > 0)


@dataclass
class Timings:
    """Microseconds of one request's phases."""

    serialize: int = 0
    http: int = 0
    deserialize: int = 0
    convert: int = 0


@dataclass
class Http:
    """Posts {"input": [...]}, wants as many vectors of `served` components, shortens and scales them.

    Fails after `attempts`; waits 0.2 s, doubled each time up to 10 s, times 0.5 to 1.5. On a column each task has at most
    `at_once` requests of `batch` strings under way, and the cluster that many times its cores.
    """

    url: str
    headers: dict[str, str] = field(default_factory=dict)
    dimension: int = DIMENSION
    served: int = SERVED
    attempts: int = 5
    batch: int = BATCH
    at_once: int = AT_ONCE
    timings: list[Timings] = field(default_factory=list)

    def _once(self, texts: list[str]) -> np.ndarray:
        t = [time.perf_counter()]
        body = json.dumps({"input": texts}).encode()
        t.append(time.perf_counter())
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json", **self.headers})
        with urllib.request.urlopen(request, timeout=60) as response:
            raw = response.read()
        t.append(time.perf_counter())
        data = json.loads(raw)["data"]
        t.append(time.perf_counter())
        x = np.array([d["embedding"] for d in sorted(data, key=lambda d: d.get("index", 0))], np.float32)
        if x.shape != (len(texts), self.served):
            raise ValueError(f"{x.shape} came for {len(texts)} texts of {self.served}")
        out = shortened(x, self.dimension)
        t.append(time.perf_counter())
        self.timings.append(Timings(*(int((b - a) * 1e6) for a, b in zip(t, t[1:], strict=False))))
        return out

    def embed(self, texts: list[str]) -> np.ndarray:
        wait = 0.2
        for k in range(self.attempts):
            try:
                return self._once(texts)
            except (OSError, ValueError):
                if k + 1 == self.attempts:
                    raise
                time.sleep(min(wait, 10) * random.uniform(0.5, 1.5))
                wait *= 2
        raise AssertionError


def shortened(x: np.ndarray, size: int) -> np.ndarray:
    """The first components of each row, scaled to length 1; zeros stay zeros."""
    x = x[:, :size]
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


class _Sums(AccumulatorParam):
    def zero(self, value: list[int]) -> list[int]:
        return [0] * len(value)

    def addInPlace(self, value1: list[int], value2: list[int]) -> list[int]:
        return [a + b for a, b in zip(value1, value2, strict=True)]


def request_totals(spark: SparkSession) -> Accumulator:
    """Requests and the sums of their Timings, brought to the driver by embedded(); repeated tasks count each time."""
    return spark.sparkContext.accumulator([0] * 5, _Sums())


def embedded(df: DataFrame, embedder: Embedder, text: str = "text", batch: int | None = None, totals: Accumulator | None = None) -> DataFrame:
    """df with emb in place of text; partitions work at once, order within them is kept.

    batch strings a call, else as many as the embedder says, else BATCH. An embedder with at_once over 1 is called in so
    many threads a task. Null texts are embedded as empty ones. totals, from request_totals, adds up an embedder's timings.
    """
    kept = [f for f in df.schema if f.name != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", emb array<float>"
    names = [f.name for f in kept]
    batch, threads = batch or getattr(embedder, "batch", BATCH), getattr(embedder, "at_once", 1)

    def count() -> None:
        timings = getattr(embedder, "timings", None)
        if timings:
            own = [(1, *astuple(t)) for t in timings]
            timings.clear()
            if totals is not None:
                totals.add([sum(c) for c in zip(*own, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(threads) as pool:
            for b in batches:
                parts = [b.slice(at, batch) for at in range(0, len(b), batch)]
                inputs = ([t or "" for t in part.column(text).to_pylist()] for part in parts)
                for part, x in zip(parts, (pool.map if threads > 1 else map)(embedder.embed, inputs), strict=True):
                    # vectors are kept as 16-bit floats would keep them
                    x = np.asarray(x, np.float32).astype(np.float16).astype(np.float32)
                    emb = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), emb], [*names, "emb"])
                count()

    return df.mapInArrow(run, schema)
