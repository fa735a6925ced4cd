"""Near duplicates by MinHash bands with sequential Bayesian verification.

Texts become sets of k-word shingles. Rows of equal sets form one class, which goes on alone under a number of its own.
Signatures are cut into bands; classes that share a band are candidates. A pair's signatures are compared batch by
batch, and the pair is dropped as soon as the posterior probability that its similarity reaches the threshold is below
`miss`; the survivors are verified on their full sets. No list of all pairs of a bucket is made: its first member is
compared with the others, and of those what is not connected after that is compared in blocks that emit links between
components only, each pair in the first bucket that it shares.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.shared import SMALL_BATCH, MULTIPLIER, connected_components, forget, mixed, shingles_of, sized, small_batches, text_chunks, words_of, written

ROWS, BANDS, STEP = 6, 42, 42
HASHES = ROWS * BANDS
#: Signatures compared with one another in one task: at most about BLOCK by BLOCK.
BLOCK = 1024


def _factors() -> tuple[np.ndarray, np.ndarray]:
    x = mixed(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * MULTIPLIER)
    return x[:HASHES] | np.uint64(1), x[HASHES:]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash signatures (uint32) of sets that are not empty."""
    lengths = np.array([len(s) for s in sets])
    flat, starts = np.concatenate(sets), np.concatenate(([0], np.cumsum(lengths)[:-1]))
    out = np.empty((HASHES, len(sets)), np.uint32)
    for j, (a, b) in enumerate(zip(*_factors(), strict=True)):
        out[j] = np.minimum.reduceat(((flat * a + b) >> np.uint64(32)).astype(np.uint32), starts)
    return np.ascontiguousarray(out.T)


def band_keys(sig: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(sig), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    for i in range(ROWS):
        keys = mixed(keys * MULTIPLIER + parts[:, :, i])
    return keys.view(np.int64)


@lru_cache
def least_matches(percent: int, miss: float) -> tuple[tuple[int, int], ...]:
    """(n, m): after n hashes a pair goes on only with m matches or more.

    With a uniform prior the similarity's posterior is Beta(m + 1, n - m + 1), whose mass above t is P(Bin(n + 1, t) <= m).
    """
    t, out = percent / 100, []
    for n in range(STEP, HASHES + 1, STEP):
        mass, m = 0.0, -1
        while mass < miss and m < n:
            m += 1
            mass += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return tuple(out)


def plausible(a: np.ndarray, b: np.ndarray, percent: int, miss: float) -> np.ndarray:
    """Which pairs of signatures are not ruled out; later batches are looked at only for pairs that are still open."""
    alive, matches, before = np.arange(len(a)), np.zeros(len(a), int), 0
    for n, m in least_matches(percent, miss):
        matches[alive] += (a[alive, before:n] == b[alive, before:n]).sum(1)
        alive, before = alive[matches[alive] >= m], n
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether percent * union <= 100 * intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for at, to, data, offsets in text_chunks(batch.column("text")):
        words, first = words_of(data, offsets)
        yield at, [shingles_of(words[first[i] : first[i + 1]], k) for i in range(to - at)]


def _print(shingles: np.ndarray) -> str:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).hexdigest()


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in _sets(batch, k):
                full = [s for s in sets if len(s)]
                sig = signatures(full) if full else np.zeros((0, HASHES), np.uint32)
                pos = iter(range(len(full)))
                rows = [next(pos) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(sets)),
                        batch.column("th").slice(at, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([None if r is None else _print(full[r]) for r in rows], pa.string()),
                        pa.array([None if r is None else sig[r].tobytes() for r in rows], pa.binary()),
                    ],
                    ["doc_id", "th", "n_shingles", "fp", "sig"],
                )

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    """Signatures stored as binary, one row each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            keys = band_keys(_matrix(batch.column("sig")))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column("node").to_numpy(), BANDS))], ["key", "node"])


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in _sets(batch, k):
                # a doc_id may stand for several texts; the class's own is told by its fingerprint
                own = [fp == _print(s) for fp, s in zip(batch.column("fp").slice(at, len(sets)).to_pylist(), sets, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(at, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"]
                ).filter(pa.array(own, pa.bool_()))

    return run


def _still_plausible(percent: int, miss: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                a, b = _matrix(batch.column("sig_a")), _matrix(batch.column("sig_b"))
                yield batch.select(["a", "b"]).filter(pa.array(plausible(a, b, percent, miss)))

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("set_a"), batch.column("set_b"), strict=True)
            keep = [similar(*(np.frombuffer(x.as_buffer(), np.uint64) for x in pair), percent) for pair in pairs]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _first_shared(sig: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The first band in which a signature equals each of the others, or 0 if there is none."""
    return (others == sig).reshape(len(others), BANDS, ROWS).all(2).argmax(1)


def _links_in_blocks(members: DataFrame, roots: DataFrame, candidates: DataFrame, sets: DataFrame, percent: int, miss: float) -> DataFrame | None:
    """Links (a, b) between components, from members (key, node, a) of buckets, roots (node, root), candidates (node, sig) and sets (node, shingles).

    A bucket's first member has been compared with all others. Where the others are of several components, at least
    one of a pair is outside of the bucket's largest one: blocks of such members meet blocks of all. A member is verified
    against plausible others of another component, the likeliest first, until one is linked; with that component it is
    then done. So a block gives a few links for each member however many pairs are plausible. None if no bucket has any.
    """
    rest = members.filter("node <> a").select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    sizes = rest.groupBy("key", "root").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.max_by("root", F.struct("n", "root")).alias("largest"), F.max("n").alias("most"), F.count("*").alias("roots"))
    open_ = written(sizes.filter("roots > 1").select("key", "n", "largest", "most"), "open")
    if open_.isEmpty():
        return None
    parts = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    rows = rest.join(sized(open_), "key").withColumns({"na": parts(F.col("n")), "nq": parts(F.col("n") - F.col("most"))})
    rows = rows.join(candidates.select("node", "sig").join(sets, "node"), "node")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    cols = ("key", "node", "root", "sig", "shingles")
    every = rows.select(*cols, F.lit(False).alias("query"), own("na").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("j"))
    queries = rows.filter("root <> largest").select(*cols, F.lit(True), F.explode(F.sequence(F.lit(0), F.col("na") - 1)), own("nq"))

    def compare(table: pa.Table) -> pa.Table:
        query = table.column("query").to_numpy()
        node, root = (table.column(c).to_numpy() for c in ("node", "root"))
        sig = _matrix(table.column("sig"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        band = int(np.flatnonzero(band_keys(sig[:1])[0] == table.column("key")[0].as_py())[0])
        them, out = np.flatnonzero(~query), []
        parent = {x: x for x in root.tolist()}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for q in np.flatnonzero(query):
            other = them[root[them] != root[q]]
            other = other[_first_shared(sig[q], sig[other]) == band]
            other = other[plausible(sig[other], sig[np.full(len(other), q)], percent, miss)]
            for o in other[np.argsort(-(sig[other] == sig[q]).sum(1), kind="stable")]:
                x, y = find(root[q].item()), find(root[o].item())
                if x != y and similar(sets[q], sets[o], percent):
                    parent[max(x, y)] = min(x, y)
                    out.append((root[q], root[o]))
        return pa.table({n: pa.array([x[k].item() for x in out], pa.int64()) for k, n in enumerate("ab")})

    return written(every.unionAll(queries).groupBy("key", "i", "j").applyInArrow(compare, "a long, b long"), "more")


def _linked(docs: DataFrame, reps: DataFrame, k: int, percent: int, miss: float) -> DataFrame | None:
    """(node, root) of classes (node, rep, fp, sig) that are linked with another, root being a class's number; None if none are candidates."""
    entries = reps.select("node", "sig").mapInArrow(_bands, "key long, node long")
    heads = entries.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n"))
    heads = written(heads.filter("n > 1").select("key", "a"), "heads")
    if heads.isEmpty():
        return None
    members = written(entries.join(sized(heads), "key"), "members")
    candidates = written(reps.join(members.select("node").distinct(), "node", "left_semi"), "candidates")
    own = docs.select("doc_id", "text").join(candidates.select(F.col("rep").alias("doc_id"), "node", "fp"), "doc_id")
    own = own.groupBy("node", "fp", F.xxhash64("text")).agg(F.first("text").alias("text"))
    sets = written(own.select("node", "fp", "text").mapInArrow(_full_sets(k), "node long, shingles binary"), "sets")
    # Every bucket's first member against its others: groups of near copies mostly have the same first in all buckets.
    pairs = members.filter("node <> a").select("a", F.col("node").alias("b")).distinct()
    side = lambda t, c, x: t.select(F.col("node").alias(x), F.col(c).alias(f"{'sig' if c == 'sig' else 'set'}_{x}"))
    likely = pairs.join(side(candidates, "sig", "a"), "a").join(side(candidates, "sig", "b"), "b").select("a", "b", "sig_a", "sig_b")
    likely = likely.mapInArrow(_still_plausible(percent, miss), "a long, b long")
    full = likely.join(side(sets, "shingles", "a"), "a").join(side(sets, "shingles", "b"), "b").select("a", "b", "set_a", "set_b")
    links = written(full.mapInArrow(_verified(percent), "a long, b long"), "links")
    roots = written(connected_components(links), "roots")
    more = _links_in_blocks(members, roots, candidates, sets, percent, miss)
    if more is not None and not more.isEmpty():
        # components that are joined further; a class that had no link until now is a component of its own
        tops = written(connected_components(more), "tops")
        ends = tops.select(F.col("node").alias("root"), F.col("root").alias("top"))
        known = roots.join(ends, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        roots = written(known.unionAll(tops.join(roots, "node", "left_anti").select("node", "root")), "roots")
    forget(members, sets, candidates)
    return roots


def components(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """near_duplicates with th, the xxhash64 of the row's text."""
    small_batches(docs.sparkSession, size=SMALL_BATCH)
    docs = docs.select("doc_id", "text")
    sketches = docs.withColumn("th", F.xxhash64("text")).mapInArrow(_sketch(k), f"{_kind(docs)}, th long, n_shingles long, fp string, sig binary")
    sketches = written(sketches, "sketches")
    # equal sets have equal signatures, so it does not matter whose is taken
    classes = sketches.filter("fp is not null and doc_id is not null").groupBy("fp")
    classes = classes.agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    reps = written(classes.withColumn("node", F.monotonically_increasing_id()), "reps")
    roots = _linked(docs, reps, k, percent, miss)
    named = reps.filter("copies > 1").select("fp", F.col("rep").alias("component_id"))
    if roots is not None:
        linked = written(roots.join(reps.select("node", "fp", "rep"), "node").select("root", "fp", "rep"), "linked")
        least = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
        named = named.join(linked, "fp", "left_anti").unionAll(linked.join(least, "root").select("fp", "component_id"))
    named = written(named, "named")
    known = F.col("fp").isNotNull() & F.col("doc_id").isNotNull()
    out = sketches.select("doc_id", "th", "n_shingles", F.when(known, F.col("fp")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("fp"))
    out = out.join(sized(named), "fp", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "th", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Texts with percent * union <= 100 * intersection of their shingle sets are linked; component_id is the smallest
    doc_id that links reach, kept tells whether it is the row's own. Texts without words (null, empty, white space
    only) have an empty set and are linked with nothing. Rows that repeat a doc_id each give a row and are linked by
    their own texts; one without a doc_id takes part in nothing, its component_id is null and kept is false. An empty
    table stays empty. Other columns of docs are ignored. Pairs are missed with a probability of about
    (1 - s**6)**42 for similarity s: 3 in a million at 0.8.
    """
    return components(docs, k, percent, miss).drop("th")


def without_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """The rows of docs (doc_id, text and any other columns) that near_duplicates keeps, and those without a doc_id.

    Rows of one doc_id stay or go by their own texts; of a group one doc_id stays, with as many rows as it has equal ones.
    """
    gone = components(docs, k, percent, miss).filter("not kept and doc_id is not null")
    gone = written(gone.select(F.col("doc_id").alias("_gone_id"), F.col("th").alias("_gone_th")).distinct(), "gone")
    # a row travels as one structure, so that its columns may have any name
    rows = docs.select("doc_id", "text", F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"))
    return rows.join(sized(gone), (F.col("doc_id") == F.col("_gone_id")) & (F.xxhash64("text") == F.col("_gone_th")), "left_anti").select("row.*")


def _kind(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2)


#: Shingles as strings, links by their intersections, components by recursion over links.
OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END AS s FROM words
), classes AS (
  SELECT list_sort(s) AS s, min(doc_id) AS rep, len(any_value(s)) AS n FROM sets WHERE len(s) > 0 GROUP BY 1
), grams AS (
  SELECT rep, n, unnest(s) AS g FROM classes
), links AS (
  SELECT a.rep AS a, b.rep AS b FROM grams a JOIN grams b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), sides AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(a, root) AS (
  SELECT a, a FROM sides UNION SELECT b.b, r.root FROM reach r JOIN sides b ON b.a = r.a AND r.root < b.b
), roots AS (
  SELECT a, min(root) AS root FROM reach GROUP BY a
)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(r.root, c.rep, s.doc_id) AS component_id, s.doc_id = coalesce(r.root, c.rep, s.doc_id) AS kept
FROM sets s LEFT JOIN classes c ON c.s = list_sort(s.s) LEFT JOIN roots r ON r.a = c.rep
"""
