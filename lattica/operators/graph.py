"""The graph of rows: edges from foreign keys to primary keys, adjacency, degrees and neighbourhoods."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import scalar as S
from lattica.operators.vocabulary import numbered, ranged
from lattica.sources.database import written
from lattica.sources.tables import RawDatabase


def key_rows(rows: DataFrame, key: str) -> DataFrame:
    """(key, row_id) of a primary key as a 64-bit integer; null and unfitting keys are left out, of equal keys the last row holds."""
    return rows.select(S.as_long(F.col(f"`{key}`")).alias("key"), "row_id").filter("key is not null").groupBy("key").agg(F.max("row_id").alias("row_id"))


def edges_of(rows: DataFrame, foreign_key: str, keys: DataFrame, column_idx: int) -> DataFrame:
    """(src, dst, column_idx): an edge for each row whose foreign key is a known key. Null and dangling keys make none."""
    fk = rows.select(S.as_long(F.col(f"`{foreign_key}`")).alias("key"), F.col("row_id").alias("src")).filter("key is not null")
    return fk.join(keys, "key").select("src", F.col("row_id").alias("dst"), F.lit(column_idx).alias("column_idx"))


def edges(db: RawDatabase, into: set[str] | None = None) -> DataFrame:
    """All edges of a database, or those to rows of some tables; two foreign keys to one row make two."""
    out, keys = None, {}
    for t, c, to in db.annotation.foreign_keys():
        if (into is not None and to.name not in into) or not to.primary_key or c.name not in db.scan(t.name).columns:
            continue
        if to.name not in keys:
            keys[to.name] = key_rows(db.rows(to.name), to.primary_key)
        part = edges_of(db.rows(t.name), c.name, keys[to.name], c.index)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else db.spark.createDataFrame([], "src long, dst long, column_idx int")


def nodes(db: RawDatabase) -> DataFrame:
    """(row_id) of every row of every table."""
    return db.spark.range(sum(db.counts.values())).withColumnRenamed("id", "row_id")


def transposed(e: DataFrame) -> DataFrame:
    return e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in e.columns if c not in ("src", "dst")])


def flat_adjacency(e: DataFrame) -> DataFrame:
    """(row_id, place, neighbor): each edge at its place among its source's, in ascending order, duplicates included.

    Edges are numbered in ranges of (src, dst), so a hub's neighbours are never in one place. Only a range's first source
    may have edges in earlier ranges: what those hold of it is added, a row a range.
    """
    parts = ranged(e.select("src", "dst"), ["src", "dst"])
    firsts = parts.groupBy("_part").agg(F.min("src").alias("src"))
    held = parts.join(F.broadcast(firsts.select("src").distinct()), "src").groupBy("src", "_part").agg(F.count("*").alias("_c"))
    before = held.select("src", "_part", (F.sum("_c").over(Window.partitionBy("src").orderBy("_part")) - F.col("_c")).alias("_before"))
    within = parts.withColumn("_n", F.row_number().over(Window.partitionBy("_part", "src").orderBy("dst")) - 1)
    place = (F.col("_n") + F.coalesce("_before", F.lit(0))).cast("long")
    return within.join(F.broadcast(before), ["src", "_part"], "left").select(F.col("src").alias("row_id"), place.alias("place"), F.col("dst").alias("neighbor"))


def adjacency(e: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """(row_id, neighbors): ascending, with duplicates; an empty array for nodes without edges.

    A node's array is as long as its degree: for graphs whose degrees are bounded; flat_adjacency serves all others.
    """
    lists = e.groupBy(F.col("src").alias("row_id")).agg(F.sort_array(F.collect_list("dst")).alias("neighbors"))
    return all_nodes.join(lists, "row_id", "left").select("row_id", F.coalesce("neighbors", F.expr("cast(array() as array<bigint>)")).alias("neighbors"))


def degrees(e: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """(row_id, out_degree, in_degree) of every node."""
    out = e.groupBy(F.col("src").alias("row_id")).agg(F.count("*").alias("out_degree"))
    into = e.groupBy(F.col("dst").alias("row_id")).agg(F.count("*").alias("in_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return all_nodes.join(out, "row_id", "left").join(into, "row_id", "left").select("row_id", zero("out_degree"), zero("in_degree"))


def row_pointers(degree: DataFrame, column: str = "out_degree") -> DataFrame:
    """(row_id, row_ptr): where each node's neighbours begin in the flat list; sums of ranges first, then within them."""
    parts = ranged(degree.select("row_id", column), ["row_id"])
    sums = parts.groupBy("_part").agg(F.sum(column).alias("_s"))
    before = sums.select("_part", (F.sum("_s").over(Window.orderBy("_part")) - F.col("_s")).alias("_before"))
    within = F.sum(column).over(Window.partitionBy("_part").orderBy("row_id")) - F.col(column)
    return parts.withColumn("_w", within).join(F.broadcast(before), "_part").select("row_id", (F.col("_w") + F.col("_before")).alias("row_ptr"))


def degree_stats(degree: DataFrame, column: str) -> DataFrame:
    """mean, max, and the exact elements n // 2 and int(n * 0.99) of the sorted degrees.

    Degrees are counted by value first, so that the elements are found among as many rows as there are different degrees.
    """
    by = degree.groupBy(F.col(column).alias("d")).agg(F.count("*").alias("n"))
    upto = by.withColumn("upto", F.sum("n").over(Window.orderBy("d"))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    at = lambda k: F.min(F.when(F.col("upto") > F.floor(k), F.col("d")))
    return upto.agg(
        (F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("mean"), F.max("d").alias("max"), at(F.col("total") / 2).alias("median"), at(F.col("total") * 0.99).alias("p99")
    )


def sampled_nodes(all_nodes: DataFrame, total: int, k: int) -> DataFrame:
    """Every (total // k)-th node from 0, k at most."""
    step = max(1, total // max(1, k))
    return all_nodes.filter(F.col("row_id") % step == 0).orderBy("row_id").limit(k)


def expanded(frontier: DataFrame, e: DataFrame, times: DataFrame) -> DataFrame:
    """One hop from (seq, row_id, obs): (seq, parent, row_id, obs, relation).

    Parents (what a row refers to) come without a look at time. A child comes if the observation has no limit, the
    child has no time, or its time is not later. times is (row_id, us), rows without a time absent or null.
    """
    parents = frontier.join(e, frontier.row_id == e.src).select("seq", F.col("src").alias("parent"), F.col("dst").alias("row_id"), "obs", F.lit("parent").alias("relation"))
    children = frontier.join(e, frontier.row_id == e.dst).select("seq", F.col("dst").alias("parent"), F.col("src").alias("row_id"), "obs")
    children = children.join(times, "row_id", "left").filter("obs is null or us is null or us <= obs")
    return parents.unionByName(children.select("seq", "parent", "row_id", "obs", F.lit("child").alias("relation")))


def reached(frontier: DataFrame, e: DataFrame, times: DataFrame) -> DataFrame:
    """(relation, row_id, n, sequences): one hop from a frontier (seq, row_id, obs), as expanded() has it, counted by where it leads.

    n is how many links lead to a row, sequences how many sequences do. A row of the frontier counts for all its sequences
    of one observation time at once, so every edge is followed once a row and time, not once a sequence. Where a row is
    reached from one row alone, its sequences are that row's. Where paths meet, sequences are listed, once for all rows
    that are reached from the same rows. Repeated frontier rows count once.
    """
    front = written(frontier.select("seq", "row_id", "obs").distinct(), "front")
    weights = written(front.groupBy("row_id", "obs").agg(F.count("*").alias("w")), "weights")
    hops = expanded(weights.select(F.col("w").alias("seq"), "row_id", "obs"), e, times).withColumnRenamed("seq", "w")
    # references of one row to another may repeat: links counts them, the rest does not
    hops = hops.groupBy("relation", "row_id", "parent", "obs").agg(F.first("w").alias("w"), F.count("*").alias("links"))
    source = F.xxhash64(F.lit(1), "parent", "obs"), F.xxhash64(F.lit(2), "parent", "obs")
    hops = written(hops.withColumns({"h1": source[0], "h2": source[1]}), "hops")
    met = hops.groupBy("relation", "row_id").agg(
        F.sum(F.col("w") * F.col("links")).alias("n"), F.sum("w").alias("w"), (F.min("parent") != F.max("parent")).alias("meet"), F.count("*").alias("size"),
        F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"),
    )
    met = written(met, "met")
    # a set of sources is told by its size and the hashes of its members, in whatever order they come
    key = ["size", "x1", "x2"]
    sets = met.filter("meet").groupBy(*key).agg(F.min(F.struct("relation", "row_id")).alias("one"))
    members = hops.join(sets.select(*key, "one.*"), ["relation", "row_id"]).select(*key, F.col("parent"), F.col("obs").alias("at"))
    listed = members.join(front, (F.col("parent") == F.col("row_id")) & F.col("at").eqNullSafe(F.col("obs")))
    listed = written(listed.groupBy(*key).agg(F.count_distinct("seq").alias("together")), "listed")
    return met.join(listed, key, "left").select("relation", "row_id", "n", F.when(F.col("meet"), F.col("together")).otherwise(F.col("w")).alias("sequences"))


#: Children of one parent whose times are summed up in one row of the index.
BLOCK = 4096
#: Rows that a part of a store is to hold, and parts at least and at most.
PART_ROWS, LEAST_PARTS, MOST_PARTS = 1_000_000, 16, 4096
#: Rows asked for that are sent to all executors; more are shuffled.
SENT_ROWS = 500_000
#: Steps through a parent's children; primes above any number of children, so that a step visits each once.
STEPS = (2147483647, 2246822519, 2654435761, 3266489917, 4294967291)


def parts_for(rows: int) -> int:
    return min(MOST_PARTS, max(LEAST_PARTS, rows // PART_ROWS))


def pruned(store: DataFrame, asked: DataFrame, on: list[str]) -> DataFrame | None:
    """store joined with asked, both with a column part: only the parts that are asked for are read. None if none are.

    asked comes from a written table. Parts are few (MOST_PARTS), so which ones they are is known before the plan is made.
    """
    parts = {r.part: r["count"] for r in asked.groupBy("part").count().collect()}
    if not parts:
        return None
    asked = F.broadcast(asked) if sum(parts.values()) <= SENT_ROWS else asked
    return store.filter(F.col("part").isin(sorted(parts))).join(asked, [*on, "part"])


@dataclass
class ChildIndex:
    """Every parent's children by place, in the order of time: children (parent, pos, child, us), blocks (parent, block, us).

    us of a block is its first child's time. Children without a time come first; two references of one row to another count
    once. Blocks of children are dealt to so many parts, each in a folder of its own.
    """

    children: DataFrame
    blocks: DataFrame
    parts: int

    def part(self, parent: Column, pos: Column) -> Column:
        return F.pmod(F.xxhash64(parent, F.floor(pos / BLOCK)), F.lit(self.parts)).cast("int")


def child_index(e: DataFrame, times: DataFrame) -> ChildIndex:
    """The index of edges (src, dst) and times (row_id, us), numbered in ranges, so that no hub's children are in one task."""
    kids = e.select(F.col("dst").alias("parent"), F.col("src").alias("child")).distinct()
    kids = kids.join(times.withColumnRenamed("row_id", "child"), "child", "left").select("parent", "child", "us")
    placed = written(numbered(kids, ["parent", "us", "child"], "_at"), "placed")
    first = placed.groupBy("parent").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    out = ChildIndex(None, None, parts_for(first.agg(F.sum("_n")).first()[0] or 0))
    children = placed.join(first, "parent").select("parent", (F.col("_at") - F.col("_first")).alias("pos"), "child", "us")
    out.children = written(children.withColumn("part", out.part(F.col("parent"), F.col("pos"))), "children", ("part",))
    blocks = out.children.groupBy("parent", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.when(F.count("us") == F.count("*"), F.min("us")).alias("us"))
    out.blocks = written(blocks, "blocks")
    return out


def eligible(asked: DataFrame, index: ChildIndex) -> DataFrame:
    """asked (row_id, obs and others) with total: how many of a row's children are not later than obs (null: no limit).

    In the order of time they are the first ones, so the last block that begins in time tells all but its own part.
    """
    limit = F.coalesce("obs", F.lit(S.NO_LIMIT)).alias("limit")
    keys = asked.select(F.col("row_id").alias("parent"), limit).distinct()
    in_time = F.col("us").isNull() | (F.col("us") <= F.col("limit"))
    last = keys.join(index.blocks, "parent").filter(in_time).groupBy("parent", "limit").agg(F.max("block").alias("block"))
    last = written(last.withColumn("part", index.part(F.col("parent"), F.col("block") * BLOCK)), "last")
    own = index.children.withColumn("block", F.floor(F.col("pos") / BLOCK)).select("parent", "block", "us", "part")
    found = pruned(own, last, ["parent", "block"])
    if found is None:
        return asked.withColumn("total", F.lit(0).cast("long"))
    total = found.filter(in_time).groupBy("parent", "limit", "block").agg(F.count("*").alias("n"))
    total = total.select(F.col("parent").alias("row_id"), "limit", (F.col("block") * BLOCK + F.col("n")).alias("total"))
    return asked.withColumn("limit", limit).join(total, ["row_id", "limit"], "left").withColumn("total", F.coalesce("total", F.lit(0))).drop("limit")


def draw(seed: int, seq: Column, row_id: Column, rank: Column, total: Column) -> Column:
    """Which of total children, in the order of time, is the rank-th drawn: steps from a start, both by a hash of (seed, seq, row)."""
    h = F.xxhash64(F.lit(seed), seq, row_id)
    step = F.element_at(F.array(*map(F.lit, STEPS)), (F.pmod(h, F.lit(len(STEPS))) + 1).cast("int"))
    return F.pmod(F.pmod(F.shiftright(h, 8), total) + rank * step, total)


def drawn_children(asked: DataFrame, index: ChildIndex, seed: int = 0) -> DataFrame:
    """(seq, parent, row_id, rank) of asked (seq, row_id, total, since, upto): the children drawn at the ranks since to upto - 1.

    As many are looked up as are asked for, however many there are.
    """
    ranks = asked.filter(F.col("since") < F.least("upto", "total")).select(
        "seq", F.col("row_id").alias("parent"), "total", F.explode(F.sequence(F.col("since").cast("long"), F.least("upto", "total").cast("long") - 1)).alias("rank")
    )
    ranks = ranks.withColumn("pos", draw(seed, F.col("seq"), F.col("parent"), F.col("rank"), F.col("total")))
    ranks = written(ranks.withColumn("part", index.part(F.col("parent"), F.col("pos"))), "ranks")
    found = pruned(index.children, ranks, ["parent", "pos"])
    if found is None:
        found = ranks.withColumn("child", F.col("parent"))  # nothing is drawn
    return found.select("seq", "parent", F.col("child").alias("row_id"), "rank")


def top_children(asked: DataFrame, index: ChildIndex, width: int, seed: int = 0) -> DataFrame:
    """(seq, parent, row_id, rank): at most width children in time of each of asked (seq, row_id, obs): all where there are no more, else a draw."""
    rows = eligible(asked.select("seq", "row_id", "obs"), index).withColumns({"since": F.lit(0), "upto": F.lit(width)})
    return drawn_children(rows, index, seed)
