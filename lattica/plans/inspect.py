"""A report of an encoded database as text: tables, statistics, graph, tasks, embeddings, and single sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import scalar as S
from lattica.operators import graph as G
from lattica.sources.annotation import SType
from lattica.sources.database import Database

#: Neighbours, categories and characters that are shown.
NEIGHBORS, CATEGORIES, CHARACTERS = 8, 10, 18


def cut(x: object, n: int = CHARACTERS) -> str:
    s = "" if x is None else str(x)
    return s if len(s) <= n else s[: n - 1] + "…"


def grid(head: list[str], rows: list[list]) -> str:
    """A table drawn with lines."""
    cells = [[str(x) for x in r] for r in [head, *rows]]
    width = [max(len(r[i]) for r in cells) for i in range(len(head))]
    line = lambda a, b, c: a + b.join("─" * (w + 2) for w in width) + c
    text = ["│" + "│".join(f" {x:<{w}} " for x, w in zip(r, width, strict=True)) + "│" for r in cells]
    return "\n".join([line("┌", "┬", "┐"), text[0], line("├", "┼", "┤"), *text[1:], line("└", "┴", "┘")])


def overview(db: Database) -> str:
    m = db.metadata
    n = sum(m["rows"].values())
    return grid(["what", "n"], [["tables", len(m["rows"])], ["columns", m["vocabulary"]["column"]], ["rows", n], ["tasks", len(m["tasks"])], ["nodes", n], ["edges", m["edges"]], *[[f"{k} strings", v] for k, v in m["vocabulary"].items()]])


def table_report(db: Database, name: str, sample_rows: int = 5) -> str:
    t = db.annotation.tables[name]
    stats = []
    for c in t.columns.values():
        s = db.metadata["columns"][name][c.name]
        more = {SType.CATEGORICAL: ", ".join(cut(x) for x in s["categories"][:CATEGORIES]), SType.BOOLEAN: f"{s['num_true']} true, {s['num_false']} false"}.get(c.stype)
        if c.stype in (SType.NUMERICAL, SType.TIMESTAMP):
            more = f"{s['min']} to {s['max']}, mean {s['mean']:.6g}, std {s['std']:.6g}"
        stats.append([c.index, c.name, c.stype.name.lower(), s["num_nulls"], c.foreign_key or "", more or ""])
    rows = [[cut(x) for x in r] for r in db.table(name).orderBy("row_id").limit(sample_rows).collect()]
    out = [f"{name}: {db.metadata['rows'][name]} rows", grid(["#", "column", "type", "nulls", "refers to", "values"], stats)]
    return "\n".join([*out, grid(db.table(name).columns, rows)] if rows else out)


def graph_report(db: Database, sample_nodes: int = 5) -> str:
    nodes = db.spark.range(sum(db.metadata["rows"].values())).withColumnRenamed("id", "row_id")
    degree = G.degrees(db.edges, nodes)
    lines = []
    for side in ("out_degree", "in_degree"):
        r = G.degree_stats(degree, side).first()
        lines.append([side, f"{r.mean or 0:.3f}", r.max, r.median, r.p99])
    shown = []
    for node in G.sampled_nodes(nodes, sum(db.metadata["rows"].values()), sample_nodes).collect():
        near = lambda a, b, x=node.row_id: [r[0] for r in db.edges.filter(F.col(a) == x).orderBy(b).limit(NEIGHBORS + 1).select(b).collect()]
        show = lambda x: ", ".join(map(str, x[:NEIGHBORS])) + " …" * (len(x) > NEIGHBORS)
        shown.append([node.row_id, show(near("src", "dst")), show(near("dst", "src"))])
    return grid(["degree", "mean", "max", "median", "p99"], lines) + "\n" + grid(["node", "refers to", "referred to by"], shown)


def task_report(db: Database, sample_seeds: int = 5) -> str:
    out = []
    for k, t in enumerate(db.metadata["tasks"]):
        seeds = db.seeds.filter(F.col("task_idx") == k)
        parts = {r.split: r["count"] for r in seeds.groupBy("split").count().collect()}
        first = seeds.orderBy("seed_idx").limit(sample_seeds).select("row_id", S.shown_time(F.coalesce("obs", F.lit(S.NO_LIMIT)), True), F.coalesce(*[F.col(c).cast("string") for c in ("numeric", "boolean", "categorical", "timestamp")])).collect()
        head = f"{t['name']}: {t['target_stype']} on {t['anchor_table']}, {t['seeds']} seeds, {parts}, {t['stats']['num_nulls']} null"
        out.append(head + "\n" + grid(["row", "observed", "target"], [[cut(x, 24) for x in r] for r in first]))
    return "\n".join(out)


def norm_report(db: Database) -> str:
    rows = []
    for kind in ("column", "categorical", "text"):
        r = db.embeddings(kind).select(S.norm(F.col("emb")).alias("n")).agg(F.count("*"), F.min("n"), F.avg("n"), F.max("n")).first()
        rows.append([kind, r[0], *(f"{x or 0:.4f}" for x in r[1:])])
    return grid(["embeddings", "n", "least norm", "mean", "greatest"], rows)


def report(db: Database, sample_rows: int = 5, sample_nodes: int = 5, sample_seeds: int = 5) -> str:
    tables = [table_report(db, t, sample_rows) for t in db.annotation.tables]
    return "\n\n".join([overview(db), *tables, graph_report(db, sample_nodes), task_report(db, sample_seeds), norm_report(db)])


def batch_report(batch: dict) -> str:
    """Cells, rows, references, targets and nulls of each sequence of a batch."""
    rows = []
    for i in range(len(batch["is_padding"])):
        used = batch["is_padding"][i] == 0
        rows.append([i, int(used.sum()), len(set(batch["seq_row_ids"][i][used].tolist())), int(batch["fk_adj"][i].sum()), int(batch["is_target"][i].sum()), int(batch["is_null"][i][used].sum())])
    return grid(["sequence", "cells", "rows", "references", "targets", "nulls"], rows)


