"""Packing of token pieces into fixed windows by non-negative least squares over shallow length combinations.

The histogram of piece lengths has at most `window` bins, whatever the corpus. Combinations of up to three lengths that
fill the window exactly are enumerated, repeat counts are solved against the histogram by non-negative least squares
and rounded down, and what remains is packed greedily, still on the histogram. The resulting plan is a bounded list of
(lengths, repeats); pieces are matched to it by their rank among pieces of equal length.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.shared import SMALL_BATCH, small_batches, written

WINDOW, END = 2048, 1
#: Pieces of one length are ranked in SALTS groups, in more where those would exceed RANKED rows.
SALTS, RANKED = 16, 200_000
#: Text the two tokenizer libraries may read differently: their special token, and letters newer than one of their tables.
_UNLIKE = re.compile("<\\|endoftext\\|>|[⿠-\U0010ffff]")
_ENCODERS: dict[tuple[str, str], tuple] = {}


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoder(paths: tuple[str, str]):
    """text -> uint32 ids of the JSON tokenizer; the same vocabulary as ranks gives the same ids faster on ordinary text."""
    if paths not in _ENCODERS:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(paths[1], "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        slow = Tokenizer.from_file(paths[0])
        _ENCODERS[paths] = fast, slow
    fast, slow = _ENCODERS[paths]

    def encode(text: str) -> np.ndarray:
        if not _UNLIKE.search(text):
            try:
                return fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # its pattern gives up on very long runs of white space; the tokenizer itself does not
                pass
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def token_pieces(docs: DataFrame, window: int = WINDOW, end: int = END, paths: tuple[str, str] | None = None, keep_ids: bool = False) -> DataFrame:
    """Each text's ids with `end` after them, cut at every multiple of `window`.

    Columns doc_id, start, length, ids_crc32 (of the ids as little-endian unsigned 32-bit words), doc_tokens and, with
    keep_ids, ids. A null text reads as empty and gives the one id `end`. Every row of docs (doc_id, text) gives its
    own pieces, those that repeat or lack a doc_id included; other columns are ignored.
    """
    small_batches(docs.sparkSession, size=SMALL_BATCH)
    paths = paths or tokenizer_paths()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(paths)
        tail = np.array([end], np.uint32)
        for batch in batches:
            for at in range(0, len(batch), 512):
                rows, cols = [], ([], [], [], [], [])
                for i, text in enumerate(batch.column("text").slice(at, 512).to_pylist(), at):
                    ids = np.concatenate((encode(text or ""), tail)).astype("<u4")
                    for start in range(0, len(ids), window):
                        piece = ids[start : start + window]
                        rows.append(i)
                        for c, v in zip(cols, (start, len(piece), zlib.crc32(piece.tobytes()), len(ids), piece), strict=True):
                            c.append(v)
                arrays = [batch.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in cols[:4])]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if keep_ids:
                    arrays, names = [*arrays, pa.array([x.astype(np.int32) for x in cols[4]], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def combinations(lengths: np.ndarray, window: int, grid: int = 64) -> np.ndarray:
    """Triples of present lengths (0: none) that add up to window: all pairs, and all triples with one length on a grid."""
    present = np.zeros(window + 1, bool)
    present[lengths] = True
    present[window] = False
    x = np.flatnonzero(present)
    found = {(0, int(a), int(window - a)) for a in x if a <= window - a and present[window - a]}
    for g in {int(x[np.abs(x - at).argmin()]) for at in range(grid // 2, window, grid)} if len(x) else ():
        b = x[x <= window - g - 1]
        c = window - g - b
        for y, z in zip(b[present[c]].tolist(), c[present[c]].tolist(), strict=True):
            if y <= z:
                found.add(tuple(sorted((g, y, z))))
    return np.array(sorted(found), np.int64).reshape(-1, 3)


def least_squares(combos: np.ndarray, have: np.ndarray, steps: int = 400) -> np.ndarray:
    """x >= 0 that minimises |Ax - have|^2, A counting lengths in combos; projected gradients with momentum."""
    n, bins = len(combos), len(have)
    flat = combos.ravel()
    used = flat > 0
    apply = lambda x: np.bincount(flat[used], np.repeat(x, 3)[used], bins)
    back = lambda r: np.where(used, r[flat], 0).reshape(n, 3).sum(1)
    v = np.ones(n)
    for _ in range(20):  # the largest eigenvalue, for the step
        v = back(apply(v))
        size = np.linalg.norm(v)
        v /= size
    step = 1 / (1.05 * size)
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * back(apply(y) - have))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """(lengths with their multiplicity, repeats) that together use every piece of the histogram exactly once."""
    left = np.zeros(window + 1, np.int64)
    for k, v in histogram.items():
        left[k] += v
    out: list[tuple[dict[int, int], int]] = []

    def take(pattern: dict[int, int], most: int) -> None:
        n = min([most, *(int(left[k]) // m for k, m in pattern.items())])
        if n > 0:
            for k, m in pattern.items():
                left[k] -= n * m
            out.append((pattern, n))

    take({window: 1}, int(left[window]))
    combos = combinations(np.flatnonzero(left), window)
    if len(combos):
        x = np.floor(least_squares(combos, left.astype(float)) + 1e-9).astype(np.int64)
        for j in np.argsort(-x, kind="stable")[: int((x > 0).sum())]:
            take(dict(Counter(int(k) for k in combos[j] if k)), int(x[j]))
    lengths = np.flatnonzero(left).tolist()
    while lengths:
        pattern, room, upto = {}, window, len(lengths)
        while room and upto:
            upto = bisect_right(lengths, room, 0, upto)
            if upto:
                k = lengths[upto - 1]
                m = min(room // k, int(left[k]))
                pattern[k] = m
                room -= m * k
                upto -= 1
        take(pattern, 1 << 62)
        lengths = [k for k in lengths if left[k]]
    return out


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """pieces with sequence_id and offset: each sequence's pieces lie without gaps from 0 and are at most window long.

    pieces needs doc_id, start and length (1 to window; other lengths are an error); other columns are kept, but for
    columns of these two names. It is read more than once and so should be a written table. Equal lengths are ranked
    in salted groups of about RANKED rows at most, so one length may hold any share of the rows. An empty table stays empty.
    """
    spark = pieces.sparkSession
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = pieces.select("doc_id", "start", F.col("length").cast("long").alias("length"), F.struct(*[f"`{c}`" for c in kept]).alias("row"))
    groups = [(r.length, max(SALTS, -(-r.n // RANKED))) for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()]  # at most window rows
    sizes = spark.createDataFrame(groups, "length long, groups long")
    salted = rows.join(F.broadcast(sizes), "length", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), "groups"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).collect()  # one row a group
    if any(not r.length or not 0 < r.length <= window for r in counts):
        raise ValueError(f"lengths must be between 1 and {window}")
    bases, sums = [], Counter()
    for r in sorted(counts):
        bases.append((r.length, r.salt, sums[r.length]))
        sums[r.length] += r.n
    slots, used, first = [], Counter(), 0
    for pattern, repeats in plan(dict(sums), window):
        at = 0
        for k, m in sorted(pattern.items(), reverse=True):
            slots.append((k, used[k], used[k] + m * repeats, first, m, at))
            used[k] += m * repeats
            at += k * m
        first += repeats
    slots.sort()
    low = np.array([(s[0] << 48) + s[1] for s in slots], np.int64)
    base, mult, at = (np.array([s[i] for s in slots], np.int64) for i in (3, 4, 5))
    start_of = np.array([s[1] for s in slots], np.int64)
    tables = spark.sparkContext.broadcast((low, start_of, base, mult, at))  # bounded by the plan, not by the corpus

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, start_of, base, mult, at = tables.value
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            i = np.searchsorted(low, (length << 48) + rank, "right") - 1
            q = rank - start_of[i]
            cols = b.column("row").flatten()
            yield pa.RecordBatch.from_arrays([*cols, pa.array(base[i] + q // mult[i]), pa.array(at[i] + q % mult[i] * length)], [*kept, "sequence_id", "offset"])

    order = Window.partitionBy("length", "salt").orderBy("doc_id", "start")
    bases_df = spark.createDataFrame(bases, "length long, salt long, base long")
    ranked = salted.withColumn("n", F.row_number().over(order)).join(F.broadcast(bases_df), ["length", "salt"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name in kept) + ", sequence_id long, offset long"
    return ranked.select("row", "length", (F.col("n") - 1 + F.col("base")).alias("rank")).mapInArrow(place, schema)


def pack_documents(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The pieces of docs (doc_id, text) with sequence_id and offset.

    A null or empty text gives the end mark alone; a text of any length, of whatever characters, is read whole. Rows that
    repeat or lack a doc_id give pieces of their own. Other columns are ignored; an empty table stays empty.
    """
    return pack(written(token_pieces(docs, window), "pieces"), window)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
