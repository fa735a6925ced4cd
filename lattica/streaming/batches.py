"""Batches of sequences without end: a producer that stays a few ahead of its consumer, and fixed arrays for training.

One Spark job makes several batches, each assembled by one task: a batch is bounded by its size, its sequences' length and
their rows. What goes to the driver is its arrays, one row a batch.
"""

from __future__ import annotations

import json
import queue
import threading
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lattica.operators import sampling as M
from lattica.operators.graph import parts_for, pruned
from lattica.operators.split import assigned, positioned, sharded
from lattica.operators.store import RowStore
from lattica.sources.annotation import SType, stype_of
from lattica.sources.database import Database, forget, written
from lattica.streaming.source import BatchNumbers

SPLITS = ("train", "val", "test")
#: The seeds' column with a target's value and the batch's array for it, by its type.
_SLOT = {SType.NUMERICAL: ("numeric", "numeric_values"), SType.TIMESTAMP: ("timestamp", "timestamp_values"), SType.BOOLEAN: ("boolean", "bool_values"), SType.CATEGORICAL: ("categorical", "categorical_embed_ids")}
_SEED = "struct<i:int,at:int,slot:string,value:array<double>>"


def permuted(cells: DataFrame, adjacency: DataFrame, config: M.SamplerConfig) -> DataFrame:
    """(seq, place, col_perm, out_perm, in_perm): the three orders of each sequence's cells, padding last."""
    n, r = config.sequence_length, config.max_rows_per_seq
    both = cells.select("seq", "pos", "seq_row_id", "column_idx", F.lit(None).cast("int").alias("i"), F.lit(None).cast("int").alias("j"))
    both = both.unionByName(adjacency.select("seq", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("int").alias("seq_row_id"), F.lit(None).cast("int").alias("column_idx"), "i", "j"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = M.permutations(*_rows_and_columns(group[group.pos.notna()], n), _matrix(group[group.i.notna()], r))
        return pd.DataFrame({"seq": group.seq.iloc[0], "place": np.arange(n), **{k: v.astype(np.int32) for k, v in out.items()}})

    return both.groupBy("seq").applyInPandas(run, "seq long, place int, col_perm int, out_perm int, in_perm int")


def _rows_and_columns(cells: pd.DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, columns, padding = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    at = cells.pos.to_numpy(np.int64)
    rows[at], columns[at], padding[at] = cells.seq_row_id, cells.column_idx, False
    return rows, columns, padding


def _matrix(adjacency: pd.DataFrame, r: int) -> np.ndarray:
    out = np.zeros((r, r), bool)
    out[adjacency.i.to_numpy(np.int64), adjacency.j.to_numpy(np.int64)] = True
    return out


def fields(config: M.SamplerConfig) -> dict[str, tuple[type, tuple[int, ...]]]:
    """Type and shape of the arrays that a batch has for its sequences."""
    b, n, r = config.batch_size, config.sequence_length, config.max_rows_per_seq
    kinds = {"semantic_types": np.int8, "column_ids": np.int32, "seq_row_ids": np.uint16, "numeric_values": np.float32, "timestamp_values": np.float32, "bool_values": np.uint8, "categorical_embed_ids": np.uint32, "text_embed_ids": np.uint32}
    kinds |= {"is_null": np.uint8, "is_target": np.uint8, "is_padding": np.uint8, "fk_adj": np.uint8, "col_perm": np.uint16, "out_perm": np.uint16, "in_perm": np.uint16}
    return {k: (t, (b, r, r) if k == "fk_adj" else (b, n, 15) if k == "timestamp_values" else (b, n)) for k, t in kinds.items()}


def _column(values: pa.ChunkedArray | pa.Array) -> pa.Array:
    return values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Which list each value is of, and the values."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    return np.repeat(np.arange(len(lists)), lengths), pc.list_flatten(lists)


def assembled(rows: pa.Table, seeds: pa.Table, config: M.SamplerConfig) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """A batch's arrays and its texts' numbers, in the order of their first appearance.

    rows has a row for each visited row: i (the sequence's place in the batch), seq_row_id, row_id, first_pos, parents
    and cells; seeds for each sequence: i, at (the target's place), slot (the array it goes to) and value (null if unknown).
    """
    n, r = config.sequence_length, config.max_rows_per_seq
    out = {k: np.zeros(shape, kind) for k, (kind, shape) in fields(config).items()}
    rows = rows.sort_by([("i", "ascending"), ("seq_row_id", "ascending")])
    seq, own, row_id = (_column(rows[c]).to_numpy() for c in ("i", "seq_row_id", "row_id"))
    at, cells = _flat(_column(rows["cells"]))
    value = lambda c, null: pc.fill_null(cells.field(c), null).to_numpy(zero_copy_only=False)
    pos = _column(rows["first_pos"]).to_numpy()[at] + value("pos", 0)
    kept = pos < n
    i, p = seq[at[kept]], pos[kept]
    out["is_padding"][:] = 1
    out["is_padding"][i, p] = 0
    out["seq_row_ids"][i, p] = own[at[kept]]
    for name, field, null in (("semantic_types", "stype", 0), ("column_ids", "column_idx", 0), ("is_null", "is_null", True), ("numeric_values", "numeric", 0.0), ("bool_values", "boolean", False), ("categorical_embed_ids", "categorical", 0)):
        out[name][i, p] = value(field, null)[kept]
    times = cells.field("timestamp")
    timed = pc.is_valid(times).to_numpy(zero_copy_only=False) & kept
    out["timestamp_values"][seq[at[timed]], pos[timed]] = pc.list_flatten(times.filter(pa.array(timed))).to_numpy().reshape(-1, 15)
    worded = pc.is_valid(cells.field("text")).to_numpy(zero_copy_only=False) & kept
    texts, first, which = np.unique(value("text", 0)[worded], return_index=True, return_inverse=True)
    order = np.argsort(first)
    local = np.empty(len(texts), np.int64)
    local[order] = np.arange(len(texts))
    out["text_embed_ids"][seq[at[worded]], pos[worded]] = local[which]
    # a row's references to rows of its own sequence
    place = {(a, b): k for a, b, k in zip(seq.tolist(), row_id.tolist(), own.tolist(), strict=True)}
    of, parents = _flat(_column(rows["parents"]))
    for x, parent in zip(of.tolist(), parents.to_pylist(), strict=True):
        j = place.get((seq[x], parent))
        if j is not None:
            out["fk_adj"][seq[x], own[x], j] = 1
    for k in range(config.batch_size):
        # cells of a target's type are ordered as they stand, before the target is put in
        for name, perm in M.permutations(out["seq_row_ids"][k].astype(np.int64), out["column_ids"][k].astype(np.int64), out["is_padding"][k] == 1, out["fk_adj"][k].astype(bool)).items():
            out[name][k] = perm
    for x in seeds.to_pylist():
        k, at_ = x["i"], x["at"]
        known = x["value"] is not None
        out["is_target"][k, at_], out["is_null"][k, at_] = 1, not known
        out[x["slot"]][k, at_] = (x["value"] if x["slot"] == "timestamp_values" else x["value"][0]) if known else 0
    return out, texts[order]


class Shutdown(Exception):
    """The sampler has been shut down."""


class Sampler:
    """Training and validation batches of an encoded database.

    A batch has one task, chosen evenly among those with seeds in the split, and seeds chosen with replacement from
    this rank's shard; choices follow from the configured seed, the rank, the split and the batch's number.
    """

    def __init__(self, db: Database, config: M.SamplerConfig | None = None):
        self.db, self.config = db, config or M.SamplerConfig()
        c = self.config
        seeds = db.seeds.drop("bucket", "split").withColumn("row", F.col("row_id"))
        seeds = sharded(assigned(seeds, c.split_seed, c.split_ratios).drop("row"), c.rank, c.world_size)
        self._seeds = self._written(seeds)
        sizes = self._seeds.groupBy("split", "task_idx").agg(F.count("*").alias("n")).collect()
        self._sizes = {s: {r.task_idx: r.n for r in sizes if r.split == s} for s in SPLITS}
        self._numbered = self._written(positioned(self._seeds).withColumnRenamed("position", "k"))
        self._edges, self._times = db.edges, self._written(db.times)
        self._store = RowStore.build(self._edges, self._times)
        self._rows = self._in_parts(db.row_cells.join(self._store.rows.select("row_id", "parents"), "row_id", "left"), "row_id", self._store.width)
        n = max(1, db.metadata["vocabulary"]["text"])
        self._text_width = -(-n // parts_for(n))
        self._texts = self._in_parts(db.embeddings("text").select("idx", "emb"), "idx", self._text_width)
        one = db.embeddings("column").select(F.size("emb").alias("n")).first()
        self._dimension = one.n if one else 0
        self._stop = threading.Event()
        self._queues: dict[str, queue.Queue] = {}
        self._threads: list[threading.Thread] = []

    @staticmethod
    def _written(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        return written(df, "batches", by)

    def _in_parts(self, df: DataFrame, key: str, width: int) -> DataFrame:
        """df in ranges of a number, a folder each, so that a job reads only those it needs."""
        return self._written(df.withColumn("part", F.floor(F.col(key) / width).cast("int")).repartitionByRange(key).sortWithinPartitions(key), ("part",))

    @staticmethod
    def _found(store: DataFrame, asked: DataFrame, key: str, width: int) -> DataFrame | None:
        return pruned(store, asked.withColumn("part", F.floor(F.col(key) / width).cast("int")), [key])

    def _choices(self, split: str, number: int) -> tuple[int, np.ndarray] | None:
        tasks = sorted(k for k, n in self._sizes[split].items() if n)
        if not tasks:
            return None
        rng = np.random.default_rng([self.config.seed, self.config.rank, SPLITS.index(split), number])
        task = tasks[int(rng.integers(len(tasks)))]
        return task, rng.integers(self._sizes[split][task], size=self.config.batch_size)

    def batches(self, split: str, first: int, count: int) -> list[dict[str, np.ndarray]]:
        """Batches number first to first + count - 1 of a split, the same however many are asked for at once; none if it has no seeds.

        Executors walk, look up cells and assemble: what comes to the driver is a row a batch with its arrays as bytes.
        """
        tables: list[DataFrame] = []
        done = self._job(split, first, count, tables)
        out = [] if done is None else [self._shaped(x) for x in sorted(done.collect(), key=lambda x: x.batch)]
        forget(tables)  # all is here; an endless stream must not fill the shared folder
        return out

    def written_stream(self, split: str, path: str, checkpoint: str, each: int | None = None, until: int | None = None) -> StreamingQuery:
        """Batches of a split as rows of Parquet, written by executors until the query is stopped, or up to number `until`.

        A micro-batch makes `each` of them (batches_per_job by default), in a folder that its first number names. A query
        started again on the checkpoint goes on where it stopped: what it had not finished is made anew, bit for bit, in
        the place of what is there. A split without seeds gives none. Rows are read back by read_stream().
        """
        spark = self.db.spark
        BatchNumbers.register(spark)
        numbers = spark.readStream.format("batch_numbers").option("each", each or self.config.batches_per_job)
        numbers = (numbers if until is None else numbers.option("until", until)).load()

        def write(df: DataFrame, _: int) -> None:
            low, n = df.agg(F.min("number"), F.count("*")).first()
            tables: list[DataFrame] = []
            done = self._job(split, low, n, tables) if n else None
            if done is not None:
                done.write.mode("overwrite").parquet(f"{path}/first={low}")
            forget(tables)

        return numbers.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()

    def read_stream(self, path: str, first: int, count: int) -> list[dict[str, np.ndarray]]:
        """Batches number first to first + count - 1 of those that written_stream() has written so far."""
        rows = self.db.spark.read.parquet(path).filter(F.col("batch").between(first, first + count - 1))
        return [self._shaped(x) for x in sorted(rows.collect(), key=lambda x: x.batch)]

    def _job(self, split: str, first: int, count: int, tables: list[DataFrame]) -> DataFrame | None:
        """A row for each batch, of its number, its task, its arrays as bytes and its texts' vectors; tables gets what is to be forgotten."""
        b, config = self.config.batch_size, self.config
        chosen, rows = [], []
        for m in range(count):
            pick = self._choices(split, first + m)
            if pick is None:
                return None
            chosen.append((first + m, pick[0]))
            rows += [((first + m) * b + i, pick[0], int(k)) for i, k in enumerate(pick[1])]
        picks = self.db.spark.createDataFrame(rows, "seq long, task_idx int, k long")
        seeds = self._written(self._numbered.filter(F.col("split") == split).join(F.broadcast(picks), ["task_idx", "k"]))
        tables.append(seeds)

        def made(df: DataFrame) -> DataFrame:
            tables.append(self._written(df))
            return tables[-1]

        walked = made(M.sampled(self.db.spark, seeds, self._edges, self._times, self.db.widths(), config, made, self._store))
        visited = self._found(self._rows, walked, "row_id", self._store.width)
        batch, i = F.floor(F.col("seq") / b).alias("batch"), (F.col("seq") % b).cast("int").alias("i")
        visited = visited.select(batch, F.struct(i, "seq_row_id", "row_id", "first_pos", "parents", "cells").alias("row"), F.lit(None).cast(_SEED).alias("seed"))
        targets = seeds.select(batch, F.lit(None).cast(visited.schema["row"].dataType).alias("row"), self._target(i).alias("seed"))
        names = list(fields(config))

        def assemble(group: pa.Table) -> pa.Table:
            own = {c: pa.Table.from_batches([pa.RecordBatch.from_struct_array(_column(group[c]).filter(pc.is_valid(_column(group[c]))))]) for c in ("row", "seed")}
            arrays, texts = assembled(own["row"], own["seed"], config)
            columns = [pa.array([group["batch"][0].as_py()], pa.int64()), *(pa.array([arrays[k].tobytes()], pa.binary()) for k in names), pa.array([texts.tolist()], pa.list_(pa.int64()))]
            return pa.Table.from_arrays(columns, names=["batch", *names, "texts"])

        done = visited.unionAll(targets).groupBy("batch").applyInArrow(assemble, "batch long, " + ", ".join(f"{k} binary" for k in names) + ", texts array<long>")
        done = made(done)
        texts = done.select("batch", F.posexplode("texts").alias("local", "idx"))
        vectors = self._found(self._texts, texts, "idx", self._text_width)
        if vectors is not None:
            done = done.join(vectors.groupBy("batch").agg(F.collect_list(F.struct("local", "emb")).alias("vectors")), "batch", "left")
        else:
            done = done.withColumn("vectors", F.lit(None).cast(f"array<struct<local:int,emb:{self._texts.schema['emb'].dataType.simpleString()}>>"))
        tasks = self.db.spark.createDataFrame(chosen, "batch long, task_idx int")
        return done.join(F.broadcast(tasks), "batch")

    def _target(self, i: Column) -> Column:
        """Of each seed: where its target stands, in which array, and its value as an array of numbers, null if it is unknown."""
        places, slots, values = [], [], []
        for k, task in enumerate(self.db.metadata["tasks"]):
            kind = stype_of(task["target_stype"])
            own = F.col("task_idx") == k
            columns = self.db.annotation.tables[task["anchor_table"]].columns.values()
            places.append(F.when(own, M.target_position([x.stype for x in columns], kind)))
            slots.append(F.when(own, _SLOT[kind][1]))
            cell = F.col(_SLOT[kind][0])
            number = cell if kind == SType.TIMESTAMP else F.when(cell.isNotNull() & ~F.isnan(cell.cast("double")), F.array(cell.cast("double")))
            values.append(F.when(own, number.cast("array<double>")))
        return F.struct(i, F.coalesce(*places).alias("at"), F.coalesce(*slots).alias("slot"), F.coalesce(*values).alias("value"))

    def _shaped(self, row: Row) -> dict[str, np.ndarray]:
        out = {k: np.frombuffer(row[k], kind).reshape(shape).copy() for k, (kind, shape) in fields(self.config).items()}
        task_idx = row.task_idx
        task = self.db.metadata["tasks"][task_idx]
        out["text_batch_embeddings"] = np.zeros((len(row.texts), self._dimension), np.float32)
        for x in row.vectors or ():
            out["text_batch_embeddings"][x.local] = x.emb
        own = self.db.metadata["columns"][task["anchor_table"]].get(task["target_column"], {})
        categories = own.get("categories") or []
        out["target_stype"], out["task_idx"] = np.array([int(stype_of(task["target_stype"]))], np.uint8), np.array([task_idx], np.uint32)
        out["cat_emb_start"] = np.array([own.get("min") if categories else 0], np.uint32)
        out["cat_emb_count"] = np.array([len(categories)], np.uint32)
        return out

    def stream(self, split: str, first: int = 0) -> Iterator[dict[str, np.ndarray]]:
        """Batches without end; ends at once where the split has no seeds."""
        while True:
            got = self.batches(split, first, self.config.batches_per_job)
            if not got:
                return
            yield from got
            first += len(got)

    def _produce(self, split: str) -> None:
        out = self._queues[split]
        try:
            for x in self.stream(split):
                while not self._stop.is_set():
                    try:
                        out.put(x, timeout=0.1)
                        break
                    except queue.Full:
                        continue
                if self._stop.is_set():
                    return
            out.put(None)
        except Exception as e:  # noqa: BLE001  handed to the consumer
            out.put(e)

    def _next(self, split: str) -> dict[str, np.ndarray] | None:
        if self._stop.is_set():
            raise Shutdown
        if split not in self._queues:
            self._queues[split] = queue.Queue(self.config.num_prefetch)
            self._threads.append(threading.Thread(target=self._produce, args=(split,), daemon=True))
            self._threads[-1].start()
        got = self._queues[split].get()
        if isinstance(got, Exception):
            raise got
        return got

    def next_train_batch(self) -> dict[str, np.ndarray] | None:
        return self._next("train")

    def next_val_batch(self) -> dict[str, np.ndarray] | None:
        return self._next("val")

    def column_embeddings(self) -> np.ndarray:
        return self._matrix_of("column")

    def categorical_embeddings(self) -> np.ndarray:
        return self._matrix_of("categorical")

    def _matrix_of(self, kind: str) -> np.ndarray:
        rows = self.db.embeddings(kind).orderBy("idx").select("emb").collect()
        return np.array([r.emb for r in rows], np.float32)

    def database_metadata(self) -> str:
        return json.dumps(self.db.metadata)

    def shutdown(self) -> None:
        """Stop producing; waiting batches are dropped, later calls raise Shutdown."""
        self._stop.set()
        for t in self._threads:
            t.join(timeout=60)
        for q in self._queues.values():
            while not q.empty():
                q.get_nowait()


