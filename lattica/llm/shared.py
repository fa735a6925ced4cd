"""What the operators share: intermediate tables in shared storage, vectorised word hashing, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a task takes; its arrays are many times as large, and a worker keeps much of that memory.
CHUNK = 500_000
#: Bytes of a batch for Python where several operators follow each other in one session.
SMALL_BATCH = 4_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset and all runs on one machine, the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (at or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 16_000_000) -> None:
    """Batches for Python no larger than this in the session, so that a task's memory is bounded also for long rows."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(name, None)
        if not (now and now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to shared storage and read again: lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lattica/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lattica_path = path
    return out


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session for as long as the block runs."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As written(), in buckets of a key: such tables are joined and grouped by it without a shuffle, if they have as many.

    What is written may itself come from such tables: Spark is told to read them by bucket also where rows are exploded
    and broadcasts joined before they are grouped by the key.
    """
    spark = df.sparkSession
    table = f"lattica_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/lattica/{table}"
    with setting(spark, "spark.sql.sources.bucketing.autoBucketedScan.enabled", "false"):
        df.write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").saveAsTable(table)
    out = spark.table(table)
    out._lattica_path, out._lattica_table = path, table
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by written() or bucketed() that nothing is going to read again."""
    for t in tables:
        spark = t.sparkSession
        if hasattr(t, "_lattica_table"):
            spark.sql(f"DROP TABLE IF EXISTS {t._lattica_table}")
        at = spark._jvm.org.apache.hadoop.fs.Path(t._lattica_path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd multiplier modulo 2**64 and of its inverse, grown on demand."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            m = max(n, 1 << 18)
            for name, base in (("up", MULTIPLIER), ("down", INVERSE)):
                a = np.full(m, base, np.uint64)
                a[0] = 1
                setattr(cls, name, np.multiply.accumulate(a))
        return cls.up, cls.down


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[s:e] for each run: a polynomial by prefix sums, then mixed with the run's length."""
    n = len(values)
    up, down = _Powers.get(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


#: Bytes that part words: space and \t \n \v \f \r.
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MARKS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_chunks(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, row offsets in them), each of about `most` bytes or of one row; null reads as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words_of(data: np.ndarray, offsets: np.ndarray, marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a chunk (A-Z lower-cased) and, for each row, where its words begin (n+1 entries).

    Words are parted by ASCII white space or, with marks, by every ASCII character but letters and digits.
    """
    space = (_MARKS if marks else _SPACE)[data]
    # a row's end parts words too: an inserted separator keeps rows apart
    n_rows = len(offsets) - 1
    flags = np.ones(len(data) + n_rows, bool)
    row = np.repeat(np.arange(n_rows), np.diff(offsets))
    moved = np.arange(len(data)) + row
    flags[moved] = space
    values = np.zeros(len(flags), np.uint8)
    values[moved] = _LOWER[data]
    edge = np.diff(np.concatenate(([True], flags, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    first = offsets[:-1] + np.arange(n_rows)
    return run_hashes(values, starts, ends), np.append(np.searchsorted(starts, first), len(starts))


#: What a byte does in tokens(): it belongs to a token, or parts tokens, or parts pieces and so tokens too.
INSIDE, BLANK, END = 0, 1, 2


def tokens(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(code, dictionary, row, piece) of a chunk's tokens (A-Z lower-cased): code and row of each, its piece's number in the chunk.

    kinds tells for each byte what it does; those that part must be ASCII. A row's end parts pieces.
    """
    n_rows = len(offsets) - 1
    place = np.int32 if len(data) + n_rows < 1 << 31 else np.int64  # half the memory
    values = np.full(len(data) + n_rows, 10, np.uint8)
    kind = np.full(len(values), END, np.uint8)
    moved = np.arange(len(data), dtype=place) + np.repeat(np.arange(n_rows, dtype=place), np.diff(offsets))
    values[moved], kind[moved] = _LOWER[data], kinds[data]
    inside = kind == INSIDE
    edge = np.diff(np.concatenate(([False], inside, [False])).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(values[inside])).dictionary_encode()
    row = np.searchsorted(offsets[1:] + np.arange(n_rows), starts, "right")
    return words.indices.to_numpy(), words.dictionary, row, np.cumsum(kind == END, dtype=place)[starts]


def shingles_of(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct k-word shingles' hashes, sorted; of fewer words the whole sequence as one; of none, none."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    m = min(k, n)
    h = words[: n - m + 1].copy()
    for i in range(1, m):
        h = mixed(h * MULTIPLIER + words[i : n - m + 1 + i])
    return np.unique(h)


def sized(df: DataFrame, most: int = 500_000) -> DataFrame:
    """df, a written table of short rows, marked for broadcast if it has at most so many; larger ones are shuffled."""
    return F.broadcast(df) if df.count() <= most else df


#: Rounds in which nodes choose the least neighbour; from then on the order is another one each round.
PLAIN_ROUNDS = 2


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over edges (a, b) of any integer type; nodes without edges are absent.

    Each round every node joins the first of its neighbours and itself in some order, and edges go on between what they
    have joined, until none is left; then the rounds' choices are followed one after another. Stars with a small centre
    end in one round; later rounds change the order by a bijective hash, so that a path too halves again and again. Only
    minima and edges are shuffled, and no node's neighbours are gathered in one place. Null ends and loops are ignored.
    """
    kind = edges.schema["a"].dataType.simpleString()
    a, b = (F.col(c).cast("long") for c in "ab")
    e = written(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a > b").distinct(), "edges")
    rounds = []
    while not e.isEmpty():
        k = len(rounds)
        place = (lambda c, k=k: F.xxhash64(F.lit(k), F.col(c))) if k >= PLAIN_ROUNDS else F.col  # a bijection of 64 bits
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        joined = both.groupBy("a").agg(F.min(place("b")).alias("m")).select(F.col("a").alias("node"), F.least(place("a"), "m").alias("to"))
        joined = written(joined, "joined")
        end = lambda c, t=joined: t.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}"))
        new = e.join(end("a"), "a").join(end("b"), "b").select(F.greatest("to_a", "to_b").alias("a"), F.least("to_a", "to_b").alias("b"))
        new = written(new.filter("a > b").distinct(), "edges")
        forget(e)
        e = new
        rounds.append((joined, place))
    forget(e)
    if not rounds:
        return edges.sparkSession.createDataFrame([], f"node {kind}, root {kind}")
    out = rounds[0][0]
    for joined, place in rounds[1:]:
        step = joined.select(F.col("node").alias("to"), F.col("to").alias("next"))
        out = out.join(step, "to", "left").select("node", F.coalesce("next", place("to")).alias("to"))
    if len(rounds) > PLAIN_ROUNDS:
        out = written(out, "ends")
        out = out.join(out.groupBy("to").agg(F.min("node").alias("root")), "to")
    else:
        out = out.withColumnRenamed("to", "root")
    return out.select(F.col("node").cast(kind).alias("node"), F.col("root").cast(kind).alias("root"))
