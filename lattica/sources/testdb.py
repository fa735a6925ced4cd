"""Annotation of the test tables, with tasks of every shape."""

from __future__ import annotations

from lattica.sources.annotation import Annotation, Column, SType, Table, Task

I, N, T, B, C, X, G = SType.IDENTIFIER, SType.NUMERICAL, SType.TIMESTAMP, SType.BOOLEAN, SType.CATEGORICAL, SType.TEXT, SType.IGNORED

#: name: (primary key, temporal column, {column: type or (type, foreign key)})
TABLES = {
    "region": ("r_regionkey", None, {"r_regionkey": I, "r_name": C}),
    "nation": ("n_nationkey", None, {"n_nationkey": I, "n_name": C, "n_regionkey": (I, "region.r_regionkey")}),
    "customer": ("c_custkey", None, {"c_custkey": I, "c_name": I, "c_nationkey": (I, "nation.n_nationkey"), "c_acctbal": N, "c_mktsegment": C}),
    "supplier": ("s_suppkey", None, {"s_suppkey": I, "s_name": I, "s_nationkey": (I, "nation.n_nationkey"), "s_acctbal": N}),
    "part": ("p_partkey", None, {"p_partkey": I, "p_name": X, "p_brand": C, "p_type": C, "p_size": N, "p_retailprice": N}),
    "orders": ("o_orderkey", "o_orderdate", {"o_orderkey": I, "o_custkey": (I, "customer.c_custkey"), "o_orderstatus": C, "o_totalprice": N, "o_orderdate": T, "o_orderpriority": C}),
    "lineitem": (
        None,
        "l_shipdate",
        {
            "l_orderkey": (I, "orders.o_orderkey"), "l_partkey": (I, "part.p_partkey"), "l_suppkey": (I, "supplier.s_suppkey"), "l_linenumber": G, "l_quantity": N,
            "l_extendedprice": N, "l_discount": N, "l_tax": N, "l_returnflag": C, "l_linestatus": C, "l_shipdate": T,
        },
    ),
    "events": ("event_id", "ts", {"event_id": I, "ts": T, "user_id": (I, "customer.c_custkey"), "event_type": C, "value": N, "props": G}),
    "documents": ("doc_id", None, {"doc_id": I, "text": X, "lang": C, "source": C, "n_chars": N}),
    "labels": ("doc_id", None, {"doc_id": (I, "documents.doc_id"), "quality": B, "toxic": B}),
}


def _window(select: str, days: int, more: str = "") -> str:
    return (
        f"SELECT o.o_orderkey, o.o_orderdate + INTERVAL '{days} days' AS obs_time, {select} FROM 'orders.parquet' o "
        f"LEFT JOIN 'lineitem.parquet' l ON l.l_orderkey = o.o_orderkey AND l.l_shipdate <= o.o_orderdate + INTERVAL '{days} days'{more} "
        "GROUP BY o.o_orderkey, o.o_orderdate"
    )


#: name: (query, anchor table, anchor key, target, type, observation time)
TASKS = {
    "task_cell_mask": ("SELECT c_custkey, c_mktsegment FROM 'customer.parquet'", "customer", "c_custkey", "c_mktsegment", C, None),
    "task_cell_mask_temporal": ("SELECT o_orderkey, o_orderstatus FROM 'orders.parquet'", "orders", "o_orderkey", "o_orderstatus", C, None),
    "task_filtered_cell": ("SELECT o_orderkey, (o_totalprice > 250000) AS has_big_total FROM 'orders.parquet' WHERE o_orderstatus = 'F'", "orders", "o_orderkey", "has_big_total", B, None),
    "task_isnotnull": ("SELECT c_custkey, (nullif(c_mktsegment, 'BUILDING') IS NOT NULL) AS other_segment FROM 'customer.parquet' WHERE c_acctbal IS NOT NULL", "customer", "c_custkey", "other_segment", B, None),
    "task_num_lineitems_7d": (_window("COUNT(l.l_orderkey) AS num_lineitems", 7), "orders", "o_orderkey", "num_lineitems", N, "obs_time"),
    "task_num_lineitems_30d": (_window("COUNT(l.l_orderkey) AS num_lineitems", 30), "orders", "o_orderkey", "num_lineitems", N, "obs_time"),
    "task_num_orders_30d": (
        "SELECT q.o_orderkey, q.o_orderdate + INTERVAL '30 days' AS obs_time, COUNT(a.o_orderkey) AS num_orders FROM 'orders.parquet' q LEFT JOIN 'orders.parquet' a "
        "ON a.o_custkey = q.o_custkey AND a.o_orderdate <= q.o_orderdate + INTERVAL '30 days' WHERE q.o_orderstatus = 'O' GROUP BY q.o_orderkey, q.o_orderdate",
        "orders", "o_orderkey", "num_orders", N, "obs_time",
    ),
    "task_score_30d": (
        _window("SUM(CASE WHEN l.l_returnflag = 'A' THEN 1 ELSE 0 END) - SUM(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) AS score", 30),
        "orders", "o_orderkey", "score", N, "obs_time",
    ),
    "task_count_case": (_window("COUNT(CASE WHEN l.l_linestatus = 'F' THEN 1 END) AS num_final", 30), "orders", "o_orderkey", "num_final", N, "obs_time"),
    "task_count_distinct": (_window("COUNT(DISTINCT l.l_partkey) AS num_parts", 30, " AND l.l_linenumber IN (1, 2, 3)"), "orders", "o_orderkey", "num_parts", N, "obs_time"),
    "task_exists_30d": (_window("(COUNT(l.l_orderkey) > 0) AS has_returned", 30, " AND l.l_returnflag = 'R'"), "orders", "o_orderkey", "has_returned", B, "obs_time"),
    "task_lookup_30d": (
        "SELECT o.o_orderkey, o.o_orderdate + INTERVAL '30 days' AS obs_time, (c.c_custkey IS NOT NULL AND c.c_acctbal > 0) AS in_credit FROM 'orders.parquet' o "
        "LEFT JOIN 'customer.parquet' c ON c.c_custkey = o.o_custkey AND c.c_mktsegment = 'MACHINERY'",
        "orders", "o_orderkey", "in_credit", B, "obs_time",
    ),
    "task_self_inner": (
        "SELECT b.c_custkey, (a.c_mktsegment IS NOT NULL AND a.c_mktsegment = b.c_mktsegment) AS same_segment FROM 'customer.parquet' a INNER JOIN 'customer.parquet' b ON a.c_custkey = b.c_nationkey",
        "customer", "c_custkey", "same_segment", B, None,
    ),
    "task_first_shipdate": (
        "SELECT o.o_orderkey, o.o_orderdate AS obs_time, MIN(l.l_shipdate) AS first_ship FROM 'orders.parquet' o LEFT JOIN 'lineitem.parquet' l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey, o.o_orderdate",
        "orders", "o_orderkey", "first_ship", T, "obs_time",
    ),
}


def annotation() -> Annotation:
    tables = {}
    for name, (pk, temporal, columns) in TABLES.items():
        made = {c: Column(c, *(x if isinstance(x, tuple) else (x,))) for c, x in columns.items()}
        tables[name] = Table(name, made, pk, temporal)
    return Annotation("testdb", tables, {n: Task(n, *t) for n, t in TASKS.items()})
