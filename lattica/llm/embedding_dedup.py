"""Near-duplicate embeddings by a forest of random-projection trees.

Every tree splits the vectors of a label again and again at the median of their projections on a random direction; a
vector close to a split goes to both sides. How close follows from the node's measured spread, so that the chances of
parting a linked pair stay under a bound down every tree; a node too dense for that stays whole. Directions follow from
a node's number, so a tree is only its thresholds and margins, fitted on bounded samples of the nodes. Vectors are
compared within leaves, in blocks where those are large. A linked pair is counted in the least leaf
that both share and nowhere else; leaves give sums and spanning edges, never lists of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.shared import connected_components, forget, sized, small_batches, written

TREES = 16
#: Leaves are split further while they have more vectors than this.
LEAF = 128
#: Leaves of more vectors, which could not be split, are compared in blocks of about so many; small ones are compared
#: together in tasks of about GROUP rows.
BLOCK, GROUP = 1024, 4000
#: About so many vectors of a node serve to fit its thresholds, and levels fitted at a time.
SAMPLE, LEVELS = 2000, 8
#: Vectors go down the trees so many bytes at a time.
CHUNK = 48_000_000
#: A just linked pair shares no leaf of any tree with at most this chance, by the model of _loss.
MISS = 1e-6
#: A node is split if no side gets more than this share of it; the levels still to come are counted with sides of USUAL.
WIDEST, USUAL = 0.85, 0.62
#: Rows of a node around which its spread is measured, over so large shares of at most so many rows of its sample.
PROBES, SHARES, SPREAD_ROWS = 16, (0.1, 0.25, 0.5, 1.0), 500
ROUNDS = 12
#: Thresholds of up to so many nodes' subtrees are broadcast (6 kB each); more are joined by leaf.
MOST_CUTS = 5000
#: Stands for the threshold of a node that is not split.
WHOLE = 1e300


def _directions(leaf: int, dim: int) -> np.ndarray:
    x = np.random.default_rng(leaf & 0xFFFFFFFFFFFFFFFF).standard_normal((2**LEVELS - 1, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _rows_of(column: pa.Array, rows: np.ndarray) -> np.ndarray:
    """Some rows, all of one length, of a column of lists as a matrix of unit vectors."""
    offsets = column.offsets.to_numpy()
    size = offsets[rows[0] + 1] - offsets[rows[0]]
    values = column.values.to_numpy(zero_copy_only=False)
    return _normed(values[offsets[rows][:, None] + np.arange(size)].astype(float))


def _normed(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # else squares of very small or large components leave the range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_Z = np.linspace(0, 5, 101)
_WEIGHT = np.exp(-(_Z**2) / 2) / np.exp(-(_Z**2) / 2).sum()
_GRID = np.linspace(0, 28, 28_001)
_ERFC = np.array([math.erfc(x) for x in _GRID])


def _erfc(x: np.ndarray) -> np.ndarray:
    return np.interp(x, _GRID, _ERFC)


def _radii(x: np.ndarray, apart: float) -> np.ndarray:
    """Distance of the middle of a linked pair from the centre of the nearest rows, of each of SHARES, by probe."""
    x = x[:: -(-len(x) // SPREAD_ROWS)]
    probes = x[:: max(1, len(x) // PROBES)]
    order = np.argsort(-(x @ probes.T), axis=0)
    out = []
    for i, p in enumerate(probes):
        centres = [x[order[: max(2, round(s * len(x))), i]].mean(0) for s in SHARES]
        out.append([max(((p - c) ** 2).sum() - apart**2 / 4, 0) ** 0.5 for c in centres])
    return np.array(out)


def _loss(margin: float, radii: np.ndarray, apart: float) -> float:
    """Chance that a node parts a pair at the distance apart; margin counts in deviations of the pair's difference.

    A pair is parted where its difference on the direction exceeds twice the margin and twice its middle's distance
    from the cut, both normal. The cut lies where most rows are: within a group of half of them always, within a
    smaller one as often as its share. The worst of all probes and shares counts.
    """
    most = 0.0
    for k, share in enumerate(SHARES):
        width = 2 * radii[:, k].min() / apart
        most = max(most, min(1.0, 2 * share) * float(_WEIGHT @ _erfc((2 * margin + width * _Z) / 2**0.5)))
    return most


def _thresholds(unit: np.ndarray, leaf: int, total: int, least: float, spent: float = 0.0) -> np.ndarray:
    """(cut, margin, chance of having parted a pair so far) of each node of LEVELS levels.

    WHOLE where a node stays whole: small enough, or not to be parted within what is left of the chances.
    """
    out = np.full((2**LEVELS - 1, 3), WHOLE)
    share = total / len(unit)
    apart = (2 - 2 * least) ** 0.5
    way, rows = _directions(leaf, unit.shape[1]), {0: (np.arange(len(unit)), spent)}
    for node in range(len(out)):
        r, used = rows.pop(node, (None, 0.0))
        if r is None or len(r) * share <= LEAF or len(r) < 16:
            continue
        p = unit[r] @ way[node]
        cut = float(np.median(p))
        # what is left is dealt evenly over the levels to come; directions are drawn anew, so chances to stay together multiply
        may = 1 - (max(1 - MISS ** (1 / TREES), 0) / (1 - used)) ** (1 / (1 + math.log(len(r) * share / LEAF) / -math.log(USUAL)))
        radii = _radii(unit[r], apart)
        small, large = 0.0, 4.0
        for _ in range(12):
            half = (small + large) / 2
            small, large = (small, half) if _loss(half, radii, apart) <= may else (half, large)
        margin = large * apart / unit.shape[1] ** 0.5
        low, high = r[p < cut + margin], r[p >= cut - margin]
        lost = _loss(large, radii, apart)
        if max(len(low), len(high)) > WIDEST * len(r) or lost > may:
            continue
        out[node] = cut, margin, 1 - (1 - used) * (1 - lost)
        rows[2 * node + 1], rows[2 * node + 2] = (low, out[node, 2]), (high, out[node, 2])
    return out


def _descend(unit: np.ndarray, leaf: int, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, node it ends in), some rows several times."""
    way, at = _directions(leaf, unit.shape[1]), {0: np.arange(len(unit))}
    rows, ends = [], []
    while at:
        node, r = at.popitem()
        if node >= len(cuts) or cuts[node, 0] == WHOLE:
            rows.append(r)
            ends.append(np.full(len(r), node))
            continue
        p = unit[r] @ way[node]
        cut, margin, _ = cuts[node]
        for child, go in ((2 * node + 1, p < cut + margin), (2 * node + 2, p >= cut - margin)):
            if go.any():
                at[child] = r[go]
    return np.concatenate(rows), np.concatenate(ends)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to CHUNK bytes, so that a leaf's rows are handled together."""
    held, size = [], 0
    for batch in batches:
        if len(batch):
            held.append(batch)
            size += batch.nbytes
        if size > CHUNK:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _moved(least_cuts: dict[int, bytes] | None):
    """Rows (node, embedding, leaf, spent) down the subtrees of their leaves, given by a dictionary or else by the column cuts.

    Rows of leaves without a subtree, and those that end above its last level, are done: their embedding is null.
    """

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = least_cuts.value if least_cuts is not None else None
        for batch in _chunked(batches):
            leaves, vectors = batch.column("leaf").to_numpy(), batch.column("embedding")
            order = np.argsort(leaves, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(leaves[order])) + 1):
                leaf = int(leaves[own[0]])
                cuts = known.get(leaf) if known is not None else batch.column("cuts")[int(own[0])].as_py()
                if cuts is None:
                    rows, new, spent, done = own, leaves[own], np.zeros(len(own)), np.ones(len(own), bool)
                else:
                    cuts = np.frombuffer(cuts).reshape(-1, 3)
                    r, end = _descend(_rows_of(vectors, own), leaf, cuts)
                    new = (pd.util.hash_array(np.full(len(end), leaf, np.int64), categorize=False) ^ pd.util.hash_array(end + 1, categorize=False)).view(np.int64)
                    rows, spent, done = own[r], cuts[(end - 1) // 2, 2], end < len(cuts)
                at = pa.array(rows)
                kept = vectors.take(pa.array(np.where(done, -1, rows), mask=done))
                yield pa.RecordBatch.from_arrays([batch.column("node").take(at), kept, pa.array(new), pa.array(spent)], ["node", "embedding", "leaf", "spent"])

    return move


def forest(classes: DataFrame, least: float) -> DataFrame:
    """(node, leaf) of classes (node, label, embedding): every leaf that a class is in."""
    spark = classes.sparkSession
    trees = F.explode(F.transform(F.sequence(F.lit(1), F.lit(TREES)), lambda t: F.xxhash64(t, F.col("label"), F.size("embedding")))).alias("leaf")
    rows = classes.select("node", "embedding", trees, F.lit(0.0).alias("spent"))
    schema, done = rows.schema, rows.filter("false").select("node", "leaf")

    def fit(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        rows = np.argsort(group.column("node").to_numpy())
        leaf, total, spent = (group.column(c)[0].as_py() for c in ("leaf", "total", "spent"))
        cuts = _thresholds(_rows_of(group.column("embedding").chunk(0), rows), leaf, total, least, spent)
        return pa.table({"leaf": [leaf], "cuts": pa.array([cuts.tobytes() if (cuts[:, 0] < WHOLE).any() else None], pa.binary())})

    for _ in range(ROUNDS):
        large = written(rows.groupBy("leaf").agg(F.count("*").alias("total")).filter(F.col("total") > LEAF), "large")
        # a share of each node by hash, not a ranking: no node is sorted however large it is
        place = F.pmod(F.xxhash64("node", "leaf"), F.lit(1 << 40)) / F.lit(float(1 << 40))
        sample = rows.join(sized(large), "leaf").filter(place * F.col("total") < SAMPLE)
        fitted = written(sample.groupBy("leaf").applyInArrow(fit, "leaf long, cuts binary").filter("cuts is not null"), "cuts")
        n = fitted.count()
        if not n:
            break
        if n <= MOST_CUTS:
            down = _moved(spark.sparkContext.broadcast({r.leaf: bytes(r.cuts) for r in fitted.collect()}))
            moved = written(rows.mapInArrow(down, schema), "leaves")
        else:
            moved = written(rows.join(fitted, "leaf", "left").select("node", "embedding", "leaf", "cuts").mapInArrow(_moved(None), schema), "leaves")
        done = done.unionAll(moved.filter("embedding is null").select("node", "leaf"))
        # leaves are many by now: rows of one come together, and large ones are split again
        rows = moved.filter("embedding is not null").hint("rebalance", "leaf").sortWithinPartitions("leaf")
    return done.unionAll(rows.select("node", "leaf"))


def _shared_before(i: np.ndarray, j: np.ndarray, leaf: int, leaves: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which of the pairs of rows (i, j) share a leaf less than this one."""
    rows, at = np.unique(np.concatenate((i, j)), return_inverse=True)
    n = offsets[rows + 1] - offsets[rows]
    own = leaves[np.repeat(offsets[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())]
    row = np.repeat(np.arange(len(rows)), n)[own < leaf]
    _, column, count = np.unique(own[own < leaf], return_inverse=True, return_counts=True)
    often = np.flatnonzero(count > 1)  # those of one row alone are shared by no pair
    if not len(often):
        return np.zeros(len(i), bool)
    place = np.full(len(count), -1)
    place[often] = np.arange(len(often))
    inside = place[column] >= 0
    has = np.zeros((len(rows), len(often)), np.float32)
    has[row[inside], place[column][inside]] = 1
    a, b = at[: len(i)], at[len(i) :]
    if len(i) > len(rows):
        return (has @ has.T)[a, b] > 0
    return (has[a] * has[b]).any(1)


def _compare(least: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, copies, side, leaf = (table.column(c).to_numpy() for c in ("node", "copies", "side", "leaf"))
        vectors, own = (table.column(c).chunk(0) for c in ("embedding", "leaves"))
        leaves, offsets = own.values.to_numpy(), own.offsets.to_numpy()
        alone = table.column("bi")[0].as_py() == table.column("bj")[0].as_py()
        links, root = np.zeros(len(node), np.int64), np.arange(len(node))
        out: list[tuple[np.ndarray, np.ndarray]] = []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        order = np.argsort(leaf, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
            unit = _rows_of(vectors, rows)
            a, b = (np.arange(len(rows)),) * 2 if alone else (np.flatnonzero(side[rows] == 0), np.flatnonzero(side[rows] == 1))
            root[rows] = rows
            for at in range(0, len(a), 512):
                x = a[at : at + 512]
                near = unit[x] @ unit[b].T >= least
                if alone:
                    near &= x[:, None] < b[None, :]
                i, j = np.nonzero(near)
                if not len(i):
                    continue
                i, j = rows[x[i]], rows[b[j]]
                new = ~_shared_before(i, j, int(leaf[rows[0]]), leaves, offsets)
                i, j = i[new], j[new]
                if not len(i):
                    continue
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                # pairs that a lesser leaf has are joined there
                for r, hit in zip(*_by_row(i, j), strict=True):
                    p = find(r)
                    for q in hit[root[hit] != p]:
                        q = find(q)
                        if q != p:
                            root[max(q, p)] = min(q, p)
                            p = min(q, p)
            top = np.array([find(r) for r in rows], np.int64)
            moved = top != rows
            out.append((rows[moved], top[moved]))
        linked = np.flatnonzero(links)
        ends = [np.concatenate(x) if out else linked[:0] for x in zip(*out, strict=True)]
        kinds = np.concatenate((links[linked], np.zeros(len(ends[0]), np.int64)))
        return pa.table({"node": np.concatenate((node[linked], node[ends[0]])), "other": np.concatenate((node[linked], node[ends[1]])), "links": kinds})

    return run


def _by_row(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    order = np.argsort(i, kind="stable")
    rows, first = np.unique(i[order], return_index=True)
    return rows, np.split(j[order], first[1:])


def near_vectors(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """One row per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors of one label with a cosine of at least `least` are linked; n_links counts the others linked directly,
    equal vectors included, component_id is the smallest vec_id that links reach. Vectors that are null, empty or zero,
    hold a null or non-finite component, have no label or no vec_id are linked with nothing. Vectors of different
    lengths are never linked. Rows that repeat a vec_id are vectors of their own. Other columns are ignored. Links below
    it are never made; the forest is built to miss a pair just at the threshold with a chance of at most MISS, by a model of
    normal projections on samples of the nodes; groups too dense for it are compared as wholes.
    """
    small_batches(vectors.sparkSession)
    table = vectors.select("vec_id", "embedding", "label")
    fine = "size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.expr(fine), F.lit(False))
    keyed = table.withColumn("ok", usable)
    keyed = keyed.withColumns({"h1": F.when(F.col("ok"), F.xxhash64("label", "embedding")), "h2": F.when(F.col("ok"), F.xxhash64("embedding", "label"))})
    # equal vectors of a label are one class, whichever ids they have
    classes = keyed.filter("ok").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    leaves = written(forest(classes, least), "forest")
    sizes = written(leaves.groupBy("leaf").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    # a vector travels once with its leaves, as many as its trees' spill makes, and is then dealt out to them
    own = leaves.join(sized(sizes), "leaf").groupBy("node").agg(F.collect_set("leaf").alias("leaves"))
    rows = classes.select("node", "copies", "embedding").join(own, "node").select("*", F.explode("leaves").alias("leaf")).join(sized(sizes), "leaf")
    groups = 1 + leaves.count() // GROUP
    rows = rows.withColumn("nb", F.when(F.col("n") <= 2 * BLOCK, 1).otherwise(F.ceil(F.col("n") / F.lit(BLOCK))).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.withColumn("g", F.when(F.col("nb") == 1, F.pmod(F.xxhash64("leaf"), F.lit(groups))).otherwise(F.col("leaf")))
    parts = rows.select("node", "copies", "embedding", "leaf", "leaves", "g", (F.col("nb") == 1).alias("whole"), F.least("own", "to").alias("bi"), F.greatest("own", "to").alias("bj"), (F.col("own") > F.col("to")).cast("int").alias("side"))
    found = written(parts.groupBy("whole", "g", "bi", "bj").applyInArrow(_compare(least), "node long, other long, links long"), "found")
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    names = classes.select("node", "rep", "h1", "h2", "copies")
    linked = written(names.join(roots, "node").select("root", "node", "rep"), "linked")
    least_of = linked.groupBy("root").agg(F.min("rep").alias("first"))
    known = names.join(links, "node", "left").join(linked.join(least_of, "root").select("node", "first"), "node", "left")
    known = written(known.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("first", "rep").alias("component_id")), "known")
    forget(leaves)
    out = keyed.join(known, ["h1", "h2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").cast("long").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs of a label, components by recursion over links.
OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), usable AS (
  SELECT vec_id, label, e, sqrt(list_sum([x * x FOR x IN e])) AS n FROM v
  WHERE label IS NOT NULL AND len(e) > 0 AND len([x FOR x IN e IF x IS NOT NULL AND isfinite(x)]) = len(e) AND list_sum([x * x FOR x IN e]) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93
), reach(a, root) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.a AND r.root < l.b
), roots AS (
  SELECT a, min(root) AS root FROM reach GROUP BY a
)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, r.root AS component_id, e.vec_id = r.root AS kept FROM embeddings e JOIN roots r ON r.a = e.vec_id
"""
