"""Every operator over the test tables as a named query, each beside SQL of its own that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import losses as L
from lattica.functions import scalar as S
from lattica.operators import encode as E
from lattica.operators import graph as G
from lattica.operators import lineage as H
from lattica.operators import profile as P
from lattica.operators import sampling as M
from lattica.operators import sketches as Q
from lattica.operators import split as B
from lattica.operators import stats as A
from lattica.operators import vocabulary as V
from lattica.plans import tasks as K
from lattica.sources import tables as R
from lattica.sources.annotation import SType
from lattica.sources.database import written as keep
from lattica.sources.testdb import TASKS, annotation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Keyed tables: their keys are their row numbers in the test data.
KEYED = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id"}
ANNOTATION = annotation()
ORDER = list(ANNOTATION.tables)
#: SQL for each table's first row number.
OFFSET = {t: "(0" + "".join(f" + (SELECT count(*) FROM {x})" for x in ORDER[:i]) + ")" for i, t in enumerate(ORDER)}
#: Where each row stands in its table: its key, or its place in the file where it has none.
ROWS = {t: f"(SELECT *, {KEYED[t]} AS _row FROM {t})" if t in KEYED else f"(SELECT *, row_number() OVER () - 1 AS _row FROM {t})" for t in ORDER}
US = "epoch_us({})"


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def db(spark: SparkSession, sf_dir: str) -> R.RawDatabase:
    return R.RawDatabase(spark, sf_dir, annotation())


def union(parts) -> DataFrame:
    out = None
    for p in parts:
        out = p if out is None else out.unionAll(p)
    return out


def columns(*kinds: SType) -> list[tuple[str, str, int]]:
    return [(t.name, c.name, c.index) for t, c in ANNOTATION.column_list() if c.stype in kinds]


def union_sql(template: str, *kinds: SType) -> str:
    return " UNION ALL ".join(template.format(t=t, c=c, i=i, o=OFFSET[t]) for t, c, i in columns(*kinds))


# Scans and projections


@query(" UNION ALL ".join(f"SELECT '{t}' AS tbl, CAST({k} AS BIGINT) AS key, CAST({k} AS BIGINT) + {OFFSET[t]} AS row_id FROM {t}" for t, k in KEYED.items()))
def scan_global_rowid(spark, sf_dir):
    d = db(spark, sf_dir)
    return union(d.rows(t).select(F.lit(t).alias("tbl"), F.col(k).cast("long").alias("key"), "row_id") for t, k in KEYED.items())


@query("SELECT event_id, epoch_us(ts) AS us, user_id, event_type, value FROM events")
def project_annotated(spark, sf_dir):
    d = db(spark, sf_dir)
    kept = [c.name for c in d.annotation.tables["events"].columns.values() if c.stype != SType.IGNORED]
    return d.rows("events").select(*kept).withColumn("us", S.micros(F.col("ts"))).drop("ts")


@query("SELECT o_orderkey, nullif(o_orderstatus, 'F') IS NOT NULL AS status_present, o_custkey IS NOT NULL AS customer_present, nullif(o_orderpriority, '5-LOW') IS NULL AS priority_null FROM orders")
def presence_bits(spark, sf_dir):
    o = db(spark, sf_dir).rows("orders")
    present = lambda c: E.scalar_encoding(SType.IDENTIFIER, c, None, (0.0, 1.0))
    return o.select("o_orderkey", present(F.nullif("o_orderstatus", F.lit("F"))).alias("status_present"), present(F.col("o_custkey")).alias("customer_present"), F.nullif("o_orderpriority", F.lit("5-LOW")).isNull().alias("priority_null"))


@query("""SELECT o_orderkey, TRY_CAST(left(o_orderpriority, 1) AS BIGINT) AS as_long, TRY_CAST(o_orderpriority AS DOUBLE) AS not_a_number, TRY_CAST(left(o_orderpriority, 1) || '.5' AS DOUBLE) AS as_double,
  CAST(o_orderkey AS VARCHAR) AS as_text, epoch_us(TRY_CAST(CAST(o_orderdate AS VARCHAR) AS TIMESTAMP)) AS as_time,
  TRY_CAST(CASE o_orderstatus WHEN 'F' THEN 'true' WHEN 'O' THEN 'false' ELSE 'maybe' END AS BOOLEAN) AS as_boolean FROM orders""")
def cast_profile(spark, sf_dir):
    o = db(spark, sf_dir).scan("orders")
    digit = F.left("o_orderpriority", F.lit(1))
    word = F.when(F.col("o_orderstatus") == "F", "true").when(F.col("o_orderstatus") == "O", "false").otherwise("maybe")
    return o.select(
        "o_orderkey", S.as_long(digit).alias("as_long"), S.as_double(F.col("o_orderpriority")).alias("not_a_number"), S.as_double(F.concat(digit, F.lit(".5"))).alias("as_double"),
        S.as_text(F.col("o_orderkey")).alias("as_text"), S.micros(S.as_time(F.col("o_orderdate").cast("string"))).alias("as_time"), S.as_boolean(word).alias("as_boolean"),
    )


@query(f"SELECT row_id, CASE {' '.join(f'WHEN row_id < {OFFSET[t]} THEN {i - 1}' for i, t in enumerate(ORDER) if i)} ELSE {len(ORDER) - 1} END AS table_idx FROM (SELECT unnest(range({OFFSET['labels']} + (SELECT count(*) FROM labels))) AS row_id)")
def row_table_lookup(spark, sf_dir):
    d = db(spark, sf_dir)
    return d.table_of(G.nodes(d)).select("row_id", "table_idx")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey < 7")
def sample_rows(spark, sf_dir):
    return R.sample(db(spark, sf_dir).scan("orders"), 7).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


# Statistics


@query(union_sql("SELECT '{t}' AS tbl, '{c}' AS col, count(*) FILTER (WHERE {c} IS NULL) AS num_nulls FROM {t}", SType.IDENTIFIER))
def stats_identifier(spark, sf_dir):
    return _stats(spark, sf_dir, SType.IDENTIFIER).select("tbl", "col", "num_nulls")


@query(union_sql("SELECT '{t}' AS tbl, '{c}' AS col, count(*) FILTER (WHERE {c} IS NULL) AS num_nulls FROM {t}", SType.TEXT))
def stats_text(spark, sf_dir):
    return _stats(spark, sf_dir, SType.TEXT).select("tbl", "col", "num_nulls")


def _stats(spark, sf_dir, kind: SType) -> DataFrame:
    """One aggregation a table, whatever the number of its columns."""
    d, of = db(spark, sf_dir), {}
    for t, c, _ in columns(kind):
        of.setdefault(t, []).append(c)
    one = lambda t, cs: d.scan(t).agg(*[A.aggregates(kind, F.col(c)).alias(c) for c in cs]).select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).alias("s")) for c in cs])).alias("x"))
    return union(one(t, cs).select(F.lit(t).alias("tbl"), "x.col", "x.s.*") for t, cs in of.items())


@query(union_sql("""SELECT '{t}' AS tbl, '{c}' AS col, count(*) FILTER (WHERE {c} IS NULL) AS num_nulls, CAST(coalesce(min({c}), 0) AS DOUBLE) AS min, CAST(coalesce(max({c}), 0) AS DOUBLE) AS max,
  round(coalesce(avg(CAST({c} AS DOUBLE)), 0), 4) AS mean, round(CASE WHEN count({c}) <= 1 THEN 1 ELSE stddev_samp(CAST({c} AS DOUBLE)) END, 4) AS std FROM {t}""", SType.NUMERICAL))
def stats_numerical(spark, sf_dir):
    return _stats(spark, sf_dir, SType.NUMERICAL).withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


_TIMES = "SELECT epoch_us(o_orderdate) AS us FROM orders UNION ALL SELECT epoch_us(l_shipdate) FROM lineitem UNION ALL SELECT epoch_us(ts) FROM events"
_SCALE = "CAST(sum(us) AS DOUBLE) / count(us) AS mean, stddev_samp(CAST(us - 800000000000000 AS DOUBLE)) AS std"


@query(union_sql("""SELECT '{t}' AS tbl, '{c}' AS col, count(*) FILTER (WHERE {c} IS NULL) AS num_nulls, min(epoch_us({c})) AS min, max(epoch_us({c})) AS max,
  round(CAST(sum(epoch_us({c})) AS DOUBLE) / count({c}) / 1e6, 3) AS mean_s, round(stddev_samp(CAST(epoch_us({c}) - 800000000000000 AS DOUBLE)) / 1e6, 2) AS std_s FROM {t}""", SType.TIMESTAMP))
def stats_timestamp(spark, sf_dir):
    return _stats(spark, sf_dir, SType.TIMESTAMP).withColumns({"mean_s": F.round(F.col("mean") / 1e6, 3), "std_s": F.round(F.col("std") / 1e6, 2)}).drop("mean", "std")


@query(f"SELECT round(mean / 1e6, 3) AS mean_s, round(std / 1e6, 2) AS std_s FROM (SELECT {_SCALE} FROM ({_TIMES}))")
def stats_ts_global(spark, sf_dir):
    return _scale(db(spark, sf_dir)).select(F.round(F.col("mean") / 1e6, 3).alias("mean_s"), F.round(F.col("std") / 1e6, 2).alias("std_s"))


def _scale(d: R.RawDatabase) -> DataFrame:
    return A.time_scale(A.all_times([(d.scan(t), c) for t, c, _ in columns(SType.TIMESTAMP)]))


@query(union_sql("SELECT '{t}' AS tbl, '{c}' AS col, count(*) FILTER (WHERE {c} IS NULL) AS num_nulls, count(*) FILTER (WHERE {c} = 1) AS num_true, count(*) FILTER (WHERE {c} = 0) AS num_false FROM {t}", SType.BOOLEAN))
def stats_boolean(spark, sf_dir):
    return _stats(spark, sf_dir, SType.BOOLEAN)


@query(union_sql("SELECT '{t}' AS tbl, '{c}' AS col, category, row_number() OVER (ORDER BY category) - 1 AS place FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS category FROM {t} WHERE {c} IS NOT NULL)", SType.CATEGORICAL))
def stats_categorical(spark, sf_dir):
    d = db(spark, sf_dir)
    return union(A.categories(d.scan(t), c).select(F.lit(t).alias("tbl"), F.lit(c).alias("col"), "category", F.col("place").cast("long").alias("place")) for t, c, _ in columns(SType.CATEGORICAL))


# Vocabularies


@query(" UNION ALL ".join(f"SELECT CAST({c.index} AS BIGINT) AS idx, '{c.name} of {t.name}' AS text" for t, c in ANNOTATION.column_list()))
def vocab_columns(spark, sf_dir):
    return V.column_texts(spark, annotation())


_CATEGORIES = union_sql("SELECT DISTINCT {i} AS column_idx, CAST({c} AS VARCHAR) AS category, '{c} is ' || CAST({c} AS VARCHAR) AS text FROM {t} WHERE {c} IS NOT NULL", SType.CATEGORICAL)
_VOCABULARY = f"""cats AS ({_CATEGORIES}), firsts AS (SELECT text, min({{'c': column_idx, 'v': category}}) AS f FROM cats GROUP BY text),
  numbers AS (SELECT text, row_number() OVER (ORDER BY f) - 1 AS idx FROM firsts), vocabulary AS (SELECT column_idx, category, text, idx FROM cats JOIN numbers USING (text))"""
_TEXTS = f"""alltexts AS (SELECT {dict((c, i) for _, c, i in columns(SType.TEXT))['p_name']} AS c, p_partkey AS r, p_name AS text FROM part
  UNION ALL SELECT {dict((c, i) for _, c, i in columns(SType.TEXT))['text']}, doc_id, {{cut}} FROM documents),
  textnumbers AS (SELECT text, row_number() OVER (ORDER BY f) - 1 AS idx FROM (SELECT text, min({{{{'c': c, 'r': r}}}}) AS f FROM alltexts GROUP BY text))"""
_CUT = """(CASE WHEN strlen(text) <= 2048 THEN text ELSE substr(text, 1, (SELECT max(k) FROM (SELECT unnest(range(512, 2049)) AS k) WHERE strlen(substr(text, 1, k)) <= 2048)) END)"""


@query(f"WITH {_VOCABULARY} SELECT column_idx, category, text, idx FROM vocabulary")
def vocab_categorical(spark, sf_dir):
    return V.categorical(db(spark, sf_dir))


@query(f"WITH {_TEXTS.format(cut=_CUT)} SELECT idx, md5(text) AS digest FROM textnumbers")
def vocab_text(spark, sf_dir):
    return V.texts(db(spark, sf_dir)).select("idx", F.md5("text").alias("digest"))


# Encodings


@query(" UNION ALL ".join(f"SELECT '{c}' AS col, _row AS key, round(({c} - m) / s, 4) AS z FROM {ROWS[t]}, (SELECT avg(CAST({c} AS DOUBLE)) AS m, stddev_samp(CAST({c} AS DOUBLE)) AS s FROM {t})" for t, c, _ in columns(SType.NUMERICAL)))
def encode_numerical_z(spark, sf_dir):
    d = db(spark, sf_dir)
    out = []
    for t in ORDER:
        own = [c for u, c, _ in columns(SType.NUMERICAL) if u == t]
        if own:
            s = A.table_stats(d.scan(t), d.annotation.tables[t])
            z = [F.struct(F.lit(c).alias("col"), F.round(S.zscore(S.as_double(F.col(c)), s[c].mean, s[c].std), 4).alias("z")) for c in own]
            out.append(d.rows(t).select(F.col(R.LOCAL).alias("key"), F.explode(F.array(*z)).alias("x")).select("x.col", "key", "x.z"))
    return union(out)


_SLOTS = ", ".join(f"{f}(2 * pi() * {x} / {p}.0)" for x, p in (("second(t)", 60), ("minute(t)", 60), ("hour(t)", 24), ("(isodow(t) - 1)", 7), ("(day(t) - 1)", 31), ("(month(t) - 1)", 12), ("(dayofyear(t) - 1)", 366)) for f in ("sin", "cos"))


@query(f"""WITH scale AS (SELECT {_SCALE} FROM ({_TIMES})), rows AS ({" UNION ALL ".join(f"SELECT '{t}' AS tbl, _row AS key, {c} AS t FROM {ROWS[t]}" for t, c, _ in columns(SType.TIMESTAMP))}),
  slots AS (SELECT tbl, key, [{_SLOTS}, (epoch_us(t) - mean) / std] AS v FROM rows, scale)
  SELECT tbl, key, unnest(range(15)) AS slot, round(CAST(CAST(unnest(v) AS FLOAT) AS DOUBLE), 4) + 0.0 AS value FROM slots""")
def encode_timestamp15(spark, sf_dir):
    d = db(spark, sf_dir)
    scale = _scale(d).first()
    vector = lambda t, c: d.rows(t).select(F.lit(t).alias("tbl"), F.col(R.LOCAL).alias("key"), F.posexplode(S.time_vector(F.col(c), scale.mean, scale.std)).alias("slot", "v"))
    both = union(vector(t, c) for t, c, _ in columns(SType.TIMESTAMP))
    return both.select("tbl", "key", F.col("slot").cast("long").alias("slot"), (F.round(F.col("v").cast("double"), 4) + 0.0).alias("value"))


@query("SELECT doc_id, quality = 1 AS quality, CASE WHEN quality = 1 THEN toxic = 1 END AS toxic FROM labels")
def encode_boolean(spark, sf_dir):
    return db(spark, sf_dir).scan("labels").select("doc_id", S.as_boolean(F.col("quality")).alias("quality"), S.as_boolean(F.when(F.col("quality") == 1, F.col("toxic"))).alias("toxic"))


_SEGMENT = next(i for _, c, i in columns(SType.CATEGORICAL) if c == "c_mktsegment")


@query(f"""WITH {_VOCABULARY} SELECT c_custkey, CASE WHEN nullif(c_mktsegment, 'BUILDING') IS NOT NULL THEN idx ELSE -1 END AS idx FROM customer
  LEFT JOIN vocabulary ON column_idx = {_SEGMENT} AND category = nullif(c_mktsegment, 'BUILDING')""")
def encode_categorical_idx(spark, sf_dir):
    d = db(spark, sf_dir)
    t = d.annotation.tables["customer"]
    rows = d.rows("customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    out = E.encode_table(rows, t, A.table_stats(d.scan("customer"), t), (0.0, 1.0), V.categorical(d), V.texts(d))
    return out.select((F.col("row_id") - d.offsets["customer"]).alias("c_custkey"), F.coalesce("c_mktsegment", F.lit(-1)).alias("idx"))


@query(f"WITH {_TEXTS.format(cut=_CUT)} SELECT doc_id, idx FROM documents JOIN textnumbers ON textnumbers.text = {_CUT.replace('text', 'documents.text')}")
def encode_text_idx(spark, sf_dir):
    d = db(spark, sf_dir)
    t = d.annotation.tables["documents"]
    out = E.encode_table(d.rows("documents"), t, A.table_stats(d.scan("documents"), t), (0.0, 1.0), V.categorical(d), V.texts(d))
    return out.select((F.col("row_id") - d.offsets["documents"]).alias("doc_id"), F.col("text").alias("idx"))


@query(f"SELECT doc_id, strlen(cut) AS bytes, md5(cut) AS digest FROM (SELECT doc_id, {_CUT} AS cut FROM documents)")
def truncate_utf8(spark, sf_dir):
    cut = db(spark, sf_dir).scan("documents").select("doc_id", S.truncated(F.col("text")).alias("cut"))
    return cut.select("doc_id", F.octet_length("cut").cast("long").alias("bytes"), F.md5("cut").alias("digest"))


# The graph

_FKS = [(t.name, c.name, c.index, to.name, to.primary_key) for t, c, to in ANNOTATION.foreign_keys()]
_EDGES = " UNION ALL ".join(f"SELECT CAST(_row AS BIGINT) + {OFFSET[t]} AS src, CAST({c} AS BIGINT) + {OFFSET[to]} AS dst, {i} AS column_idx FROM {ROWS[t]}" for t, c, i, to, _ in _FKS)


@query("SELECT column_idx, dst, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT {i} AS column_idx, CAST(x.{c} AS BIGINT) + {OFFSET[to]} AS dst FROM {t} x JOIN {to} y ON x.{c} = y.{k}" for t, c, i, to, k in _FKS) + ") GROUP BY column_idx, dst")
def fk_edges(spark, sf_dir):
    return G.edges(db(spark, sf_dir)).groupBy("column_idx", "dst").agg(F.count("*").alias("n"))


@query(_EDGES)
def fk_edges_keyed(spark, sf_dir):
    return G.edges(db(spark, sf_dir)).select("src", "dst", "column_idx")


@query(f"SELECT o_orderkey + {OFFSET['orders']} AS src, CASE WHEN o_custkey % 3 = 1 THEN o_custkey END + {OFFSET['customer']} AS dst FROM orders WHERE o_custkey % 3 = 1")
def fk_edges_dangling(spark, sf_dir):
    d = db(spark, sf_dir)
    fk = F.when(F.col("o_custkey") % 3 == 0, None).when(F.col("o_custkey") % 3 == 1, F.col("o_custkey")).otherwise(-F.col("o_custkey"))
    return G.edges_of(d.rows("orders").withColumn("o_custkey", fk), "o_custkey", G.key_rows(d.rows("customer"), "c_custkey"), 0).select("src", "dst")


@query(f"SELECT CAST(c_nationkey AS BIGINT) AS key, max(c_custkey) + {OFFSET['customer']} AS row_id FROM customer WHERE c_nationkey <> 3 GROUP BY c_nationkey")
def pk_duplicate_last(spark, sf_dir):
    rows = db(spark, sf_dir).rows("customer").withColumn("c_nationkey", F.nullif("c_nationkey", F.lit(3)))
    return G.key_rows(rows, "c_nationkey")


_NODES = f"nodes AS (SELECT unnest(range({OFFSET['labels']} + (SELECT count(*) FROM labels))) AS row_id)"
_DEGREES = f"""edges AS ({_EDGES}), {_NODES}, degrees AS (SELECT row_id, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM nodes
  LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY src) o ON o.src = row_id LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY dst) i ON i.dst = row_id)"""


@query(f"WITH {_DEGREES} SELECT row_id, out_degree, in_degree FROM degrees")
def degrees(spark, sf_dir):
    d = db(spark, sf_dir)
    return G.degrees(G.edges(d), G.nodes(d))


@query(f"WITH {_DEGREES} SELECT row_id, CAST(sum(out_degree) OVER (ORDER BY row_id) - out_degree AS BIGINT) AS row_ptr FROM degrees")
def csr_row_ptr(spark, sf_dir):
    d = db(spark, sf_dir)
    return G.row_pointers(G.degrees(G.edges(d), G.nodes(d)))


@query(f"WITH edges AS ({_EDGES}) SELECT src AS row_id, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS place, dst AS neighbor FROM edges")
def csr_adjacency(spark, sf_dir):
    d = db(spark, sf_dir)
    return G.flat_adjacency(G.edges(d))


@query(f"WITH edges AS ({_EDGES}) SELECT dst AS row_id, row_number() OVER (PARTITION BY dst ORDER BY src) - 1 AS place, src AS neighbor FROM edges")
def csr_transpose(spark, sf_dir):
    d = db(spark, sf_dir)
    return G.flat_adjacency(G.transposed(G.edges(d)))


_STATS = "SELECT '{c}' AS side, round(avg({c}), 6) AS mean, max({c}) AS max, list_sort(list({c}))[count(*) // 2 + 1] AS median, list_sort(list({c}))[CAST(floor(count(*) * 0.99) AS BIGINT) + 1] AS p99 FROM degrees"


@query(f"WITH {_DEGREES} {_STATS.format(c='out_degree')} UNION ALL {_STATS.format(c='in_degree')}")
def degree_stats(spark, sf_dir):
    d = db(spark, sf_dir)
    g = G.degrees(G.edges(d), G.nodes(d))
    return union(G.degree_stats(g, c).select(F.lit(c).alias("side"), F.round("mean", 6).alias("mean"), "max", "median", "p99") for c in ("out_degree", "in_degree"))


@query(f"WITH {_NODES} SELECT row_id FROM nodes, (SELECT greatest(1, count(*) // 5) AS step FROM nodes) WHERE row_id % step = 0 ORDER BY row_id LIMIT 5")
def node_sample(spark, sf_dir):
    d = db(spark, sf_dir)
    return G.sampled_nodes(G.nodes(d), sum(d.counts.values()), 5)


_ALLTIMES = " UNION ALL ".join(f"SELECT _row + {OFFSET[t]} AS row_id, epoch_us({c}) AS us FROM {ROWS[t]}" for t, c, _ in columns(SType.TIMESTAMP))


def _frontier(d: R.RawDatabase) -> DataFrame:
    """Every customer, seen at the middle of 1998."""
    return d.rows("customer").select(F.col("c_custkey").alias("seq"), "row_id", F.lit(899251200000000).alias("obs"))


def _times(d: R.RawDatabase, parents: str | None = None) -> DataFrame:
    """Times of rows, or of those of the tables that refer to one."""
    own = {t.name for t, _, to in d.annotation.foreign_keys() if parents in (None, to.name)}
    return union(d.rows(t).select("row_id", S.micros(F.col(c)).alias("us")) for t, c, _ in columns(SType.TIMESTAMP) if parents is None or t in own)


_HOP = f"""edges AS ({_EDGES}), times AS ({_ALLTIMES}),
  start AS (SELECT c_custkey AS seq, c_custkey + {OFFSET['customer']} AS row_id FROM customer),
  hop1 AS (SELECT seq, row_id AS parent, dst AS row_id, 'parent' AS relation FROM start JOIN edges ON src = row_id
    UNION ALL SELECT seq, start.row_id, src, 'child' FROM start JOIN edges ON dst = start.row_id LEFT JOIN times ON times.row_id = src WHERE us IS NULL OR us <= 899251200000000)"""


@query(f"WITH {_HOP} SELECT seq, parent, row_id, relation FROM hop1")
def neighbors_1hop_temporal(spark, sf_dir):
    d = db(spark, sf_dir)
    return G.expanded(_frontier(d), G.edges(d), _times(d)).drop("obs")


@query(f"""WITH {_HOP}, front AS (SELECT DISTINCT seq, row_id FROM hop1), hop2 AS (SELECT seq, row_id AS parent, dst AS row_id, 'parent' AS relation FROM front JOIN edges ON src = row_id
  UNION ALL SELECT seq, front.row_id, src, 'child' FROM front JOIN edges ON dst = front.row_id LEFT JOIN times ON times.row_id = src WHERE us IS NULL OR us <= 899251200000000)
  SELECT relation, row_id, count(*) AS n, count(DISTINCT seq) AS sequences FROM hop2 GROUP BY relation, row_id""")
def neighbors_2hop_temporal(spark, sf_dir):
    d = db(spark, sf_dir)
    e, t = G.edges(d), _times(d)
    return G.reached(G.expanded(_frontier(d), e, t), e, t)


@query(f"""WITH {_HOP}, kids AS (SELECT DISTINCT seq, parent, row_id FROM hop1 WHERE relation = 'child')
  SELECT seq, least(count(*), 8) AS kept, 0 AS late FROM kids GROUP BY seq""")
def child_topw(spark, sf_dir):
    d = db(spark, sf_dir)
    # customers are asked for, so only their children are indexed
    index = G.child_index(G.edges(d, {"customer"}), _times(d, "customer"))
    kept = G.top_children(_frontier(d), index, 8).join(index.children.withColumnRenamed("child", "row_id"), ["parent", "row_id"])
    return kept.groupBy("seq").agg(F.count_distinct("row_id").alias("kept"), F.count_if(F.col("us") > 899251200000000).alias("late"))


# Tasks


def _task_query(name: str) -> None:
    sql, _, key, target, kind, obs = TASKS[name]
    value = {SType.TIMESTAMP: "epoch_us({0})", SType.NUMERICAL: "CAST({0} AS BIGINT)"}.get(kind, "{0}").format(target)
    more = f", epoch_us({obs}) AS obs_us" if obs else ""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = db(spark, sf_dir)
        d.register()
        out = K.result(d, d.annotation.tasks[name])
        c = F.col(target)
        c = S.micros(c) if kind == SType.TIMESTAMP else c.cast("long") if kind == SType.NUMERICAL else c
        return out.select(F.col(key).alias("key"), c.alias("target"), *([S.micros(F.col(obs)).alias("obs_us")] if obs else []))

    QUERIES[name] = run
    SQL[name] = f"SELECT {key} AS key, {value} AS target{more} FROM ({K.rewritten(sql, ORDER).replace('`', '')})"


for _name in TASKS:
    _task_query(_name)


@query(f"""SELECT c_custkey + {OFFSET['customer']} AS row_id, CAST(NULL AS BIGINT) AS obs, CAST(count(o_orderkey) AS BIGINT) AS target FROM orders JOIN customer ON o_custkey * 2 = c_custkey WHERE o_custkey % 7 <> 0 GROUP BY c_custkey""")
def task_resolved_seeds(spark, sf_dir):
    d = db(spark, sf_dir)
    d.register()
    task = d.annotation.tasks["task_cell_mask"]
    task.query = "SELECT nullif(o_custkey * 2, CASE WHEN o_custkey % 7 = 0 THEN o_custkey * 2 ELSE -1 END) AS k, count(o_orderkey) AS n FROM 'orders.parquet' GROUP BY 1"
    task.anchor_key, task.target_column, task.target_stype = "k", "n", SType.NUMERICAL
    return K.resolved(d, task).select("row_id", "obs", F.col("target").cast("long").alias("target"))


@query(f"""SELECT 'own' AS kind, o_orderkey + {OFFSET['orders']} AS row_id, epoch_us(o_orderdate + INTERVAL '30 days') AS obs FROM orders
  UNION ALL SELECT 'anchor', o_orderkey + {OFFSET['orders']}, epoch_us(o_orderdate) FROM orders UNION ALL SELECT 'none', c_custkey + {OFFSET['customer']}, 9223372036854775807 FROM customer""")
def task_obs_cascade(spark, sf_dir):
    d = db(spark, sf_dir)
    d.register()
    of = {"own": "task_num_lineitems_30d", "anchor": "task_cell_mask_temporal", "none": "task_cell_mask"}
    return union(K.resolved(d, d.annotation.tasks[t]).select(F.lit(k).alias("kind"), "row_id", F.coalesce("obs", F.lit(S.NO_LIMIT)).alias("obs")) for k, t in of.items())


_COUNTS = K.rewritten(TASKS["task_num_lineitems_30d"][0], ORDER).replace("`", "")


@query(f"SELECT count(*) FILTER (WHERE num_lineitems IS NULL) AS num_nulls, CAST(min(num_lineitems) AS DOUBLE) AS min, CAST(max(num_lineitems) AS DOUBLE) AS max, round(avg(num_lineitems), 6) AS mean, round(stddev_samp(num_lineitems), 6) AS std FROM ({_COUNTS})")
def task_target_stats(spark, sf_dir):
    d = db(spark, sf_dir)
    d.register()
    task = d.annotation.tasks["task_num_lineitems_30d"]
    s = K.resolved(d, task).agg(A.aggregates(task.target_stype, F.col("target")).alias("s")).select("s.*")
    return s.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(f"""WITH {_VOCABULARY}, counts AS ({_COUNTS}), s AS (SELECT avg(num_lineitems) AS m, stddev_samp(num_lineitems) AS d FROM counts)
  SELECT 'count' AS task, o_orderkey + {OFFSET['orders']} AS row_id, round((num_lineitems - m) / d, 4) AS value FROM counts, s
  UNION ALL SELECT 'segment', c_custkey + {OFFSET['customer']}, CAST(idx AS DOUBLE) FROM customer JOIN vocabulary ON text = 'c_mktsegment is ' || c_mktsegment""")
def task_target_encoded(spark, sf_dir):
    d = db(spark, sf_dir)
    d.register()
    out = []
    for label, name in (("count", "task_num_lineitems_30d"), ("segment", "task_cell_mask")):
        task = d.annotation.tasks[name]
        seeds = K.resolved(d, task)
        e = K.encoded(seeds, task, K.target_stats(seeds, task), (0.0, 1.0), V.categorical(d))
        out.append(e.select(F.lit(label).alias("task"), "row_id", F.round(F.col("value").cast("double"), 4).alias("value")))
    return union(out)


# Splits

_M = "18446744073709551615"


def _siphash_sql(source: str) -> str:
    """SipHash-1-3 of (task, row, seed) over `source`, in 128-bit arithmetic cut to 64 bits, one step a subquery."""
    cut = lambda x: f"(({x}) & {_M}::UHUGEINT)"
    turn = lambda x, n: cut(f"(({x}) << {n}) | (({x}) >> {64 - n})")
    step, steps = "start", [f"start AS (SELECT *, 8317987319222330741::UHUGEINT AS a, 7237128888997146477::UHUGEINT AS b, 7816392313619706465::UHUGEINT AS c, 8387220255154660723::UHUGEINT AS d FROM ({source}))"]

    def next_(**change: str) -> None:
        nonlocal step
        new = f"s{len(steps)}"
        steps.append(f"{new} AS (SELECT * REPLACE ({', '.join(f'{v} AS {k}' for k, v in change.items())}) FROM {step})")
        step = new

    def round_() -> None:
        next_(a=cut("a + b"), c=cut("c + d"))
        next_(b=f"xor({turn('b', 13)}, a)", d=f"xor({turn('d', 16)}, c)")
        next_(a=turn("a", 32))
        next_(a=cut("a + d"), c=cut("c + b"))
        next_(d=f"xor({turn('d', 21)}, a)", b=f"xor({turn('b', 17)}, c)")
        next_(c=turn("c", 32))

    for word in ("(task_idx::UHUGEINT | (row::UHUGEINT << 32))", "123::UHUGEINT", f"({16 << 56})::UHUGEINT"):
        next_(d=f"xor(d, {word})")
        round_()
        next_(a=f"xor(a, {word})")
    next_(c="xor(c, 255::UHUGEINT)")
    for _ in range(3):
        round_()
    return f"{', '.join(steps)}, hashed AS (SELECT * EXCLUDE (a, b, c, d), CAST(xor(xor(a, b), xor(c, d)) % 1000 AS INTEGER) AS bucket FROM {step})"


_SPLIT = f"WITH {_siphash_sql('SELECT 0 AS task_idx, o_orderkey AS row FROM orders UNION ALL SELECT 3, c_custkey FROM customer')}, splits AS (SELECT *, CASE WHEN bucket < 800 THEN 'train' WHEN bucket <= 900 THEN 'val' ELSE 'test' END AS split FROM hashed)"


def _seeds(d: R.RawDatabase) -> DataFrame:
    o = d.scan("orders").select(F.lit(0).alias("task_idx"), F.col("o_orderkey").alias("row"))
    return o.unionAll(d.scan("customer").select(F.lit(3), "c_custkey"))


@query(f"{_SPLIT} SELECT task_idx, row, bucket, split FROM splits")
def split_assign(spark, sf_dir):
    return B.assigned(_seeds(db(spark, sf_dir)))


@query(f"{_SPLIT} SELECT task_idx, split, count(*) AS n FROM splits GROUP BY task_idx, split")
def split_sizes(spark, sf_dir):
    return B.sizes(B.assigned(_seeds(db(spark, sf_dir))))


@query(f"{_SPLIT} SELECT task_idx, split, row FROM (SELECT *, row_number() OVER (PARTITION BY task_idx, split ORDER BY row) - 1 AS k FROM splits) WHERE k % 4 = 1")
def rank_shard(spark, sf_dir):
    return B.sharded(B.assigned(_seeds(db(spark, sf_dir))), 1, 4, ("row",)).select("task_idx", "split", "row")


# Sequences. With children, what is drawn follows from hashes, and tests hold the walk against a plain model. Without
# them (a width of 0) it is what rows refer to, first come first served, which SQL can say.


def _walks(d: R.RawDatabase, seeds: DataFrame, config: M.SamplerConfig, links: bool = False) -> DataFrame:
    """Walks from seeds (seq, row_id, obs)."""
    widths = [(d.offsets[t.name], len(H.cells_of(t))) for t in d.annotation.tables.values()]
    return M.walks(d.spark, seeds, G.edges(d), _times(d), widths, config, lambda df: keep(df, "walk"), links=links)


def _suppliers(d: R.RawDatabase) -> DataFrame:
    """Every supplier, seen at the middle of 1998."""
    return d.rows("supplier").select(F.col("row_id").alias("seq"), "row_id", F.lit(899251200000000).alias("obs"))


def _low(d: R.RawDatabase) -> Callable[[str], DataFrame]:
    """Rows of a table, orders without the lowest priority."""
    return lambda t: d.rows(t).withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("5-LOW"))) if t == "orders" else d.rows(t)


def _targets(d: R.RawDatabase) -> DataFrame:
    """(seq, value): line items shipped up to 30 days after an order, null unless more than one."""
    d.register()
    return K.resolved(d, d.annotation.tasks["task_num_lineitems_30d"]).select(F.col("row_id").alias("seq"), F.when(F.col("target") > 1, F.col("target").cast("double")).alias("value"))


@query()
def sequence_cells(spark, sf_dir):
    d, config = db(spark, sf_dir), M.SamplerConfig()
    return H.laid_out(d, M.rows_of(_walks(d, _suppliers(d), config)), config).select("seq", "pos", "seq_row_id", "row_id", "column_idx", "stype")


@query()
def sequence_edges(spark, sf_dir):
    """References within the sequences of sequence_cells, as the walks have looked them up."""
    d = db(spark, sf_dir)
    return _walks(d, _suppliers(d), M.SamplerConfig(), links=True).select("seq", F.inline(F.arrays_zip("i", "j")))


_WIDTH = {t.name: sum(c.stype != SType.IGNORED for c in t.columns.values()) for t in ANNOTATION.tables.values()}
_SIZE = "CASE " + " ".join(f"WHEN row_id >= {OFFSET[t]} THEN {_WIDTH[t]}" for t in reversed(ORDER)) + " END"
#: What a line item refers to, in the order of the walk: supplier, part, order, the supplier's nation, the customer, the
#: nation's region, and the customer's nation and its region where they are others.
_ANCESTORS = f"""parts AS (SELECT l._row + {OFFSET['lineitem']} AS seq, l_suppkey + {OFFSET['supplier']} AS r1, l_partkey + {OFFSET['part']} AS r2, l_orderkey + {OFFSET['orders']} AS r3, s_nationkey + {OFFSET['nation']} AS r4,
    o_custkey + {OFFSET['customer']} AS r5, a.n_regionkey AS r6, c_nationkey + {OFFSET['nation']} AS r7, b.n_regionkey AS r8, o_orderpriority = '5-LOW' AS low
    FROM {ROWS['lineitem']} l JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN nation a ON a.n_nationkey = s_nationkey JOIN customer ON c_custkey = o_custkey JOIN nation b ON b.n_nationkey = c_nationkey),
  lists AS (SELECT seq, low, [seq, r1, r2, r3, r4, r5, r6] || (CASE WHEN r7 <> r4 THEN [r7] ELSE [] END) || (CASE WHEN r8 <> r6 THEN [r8] ELSE [] END) AS l FROM parts),
  walked AS (SELECT seq, low, unnest(range(len(l))) AS seq_row_id, unnest(l) AS row_id FROM lists)"""


@query(f"""WITH {_ANCESTORS} SELECT seq, seq_row_id, row_id, CAST(sum({_SIZE}) OVER (PARTITION BY seq ORDER BY seq_row_id) - {_SIZE} AS BIGINT) AS first_pos FROM walked""")
def sequence_ancestors(spark, sf_dir):
    return H.walked(H.lineage(db(spark, sf_dir), "lineitem", M.SamplerConfig(bfs_child_width=0)))


#: Budgets of which some sequences use up the one and some the other, and a width above every number of children.
_ALL = M.SamplerConfig(sequence_length=80, bfs_child_width=1_000_000_000, max_rows_per_seq=17)
#: The walk as a recursion: a row of it pops the first waiting row that is new, parents before children, and lets what
#: that row refers to and what refers to it in time wait. Where no row has more children than the width none are drawn.
_WALK = f"""RECURSIVE {_NODES}, edges AS ({_EDGES}), times AS ({_ALLTIMES}),
  up AS (SELECT src, list(DISTINCT dst ORDER BY dst) AS l FROM edges GROUP BY src),
  down AS (SELECT dst, list({{'r': src, 'us': us}} ORDER BY src) AS l FROM (SELECT DISTINCT dst, src FROM edges) LEFT JOIN times ON row_id = src GROUP BY dst),
  links AS (SELECT row_id, {_SIZE} AS size, coalesce(up.l, []) AS parents, coalesce(down.l, []) AS children FROM nodes LEFT JOIN up ON src = row_id LEFT JOIN down ON dst = row_id),
  walk AS (
    SELECT seq, obs, [seq] AS first, CAST([] AS BIGINT[]) AS later, CAST([] AS BIGINT[]) AS seen, CAST([] AS BIGINT[]) AS places, CAST(0 AS BIGINT) AS cells
    FROM (SELECT o_orderkey + {OFFSET['orders']} AS seq, epoch_us(o_orderdate + INTERVAL 60 DAY) AS obs FROM orders)
    UNION ALL
    SELECT seq, obs, CASE WHEN f = [] THEN f ELSE f[2:] END || parents, (CASE WHEN f = [] THEN l[2:] ELSE l END) || list_transform(list_filter(children, lambda k: k.us IS NULL OR k.us <= obs), lambda k: k.r),
      seen || [row_id], places || [cells], least({_ALL.sequence_length}, cells + size)
    FROM (SELECT *, list_filter(first, lambda x: NOT list_contains(seen, x)) AS f, list_filter(later, lambda x: NOT list_contains(seen, x)) AS l FROM walk
      WHERE cells < {_ALL.sequence_length} AND len(seen) < {_ALL.max_rows_per_seq}) JOIN links ON row_id = coalesce(f[1], l[1])),
  ended AS (SELECT seq, arg_max(seen, len(seen)) AS seen, arg_max(places, len(places)) AS places FROM walk GROUP BY seq)"""


@query(f"WITH {_WALK} SELECT seq, CAST(unnest(range(len(seen))) AS INTEGER) AS seq_row_id, unnest(seen) AS row_id, CAST(unnest(places) AS INTEGER) AS first_pos FROM ended")
def sequence_rows(spark, sf_dir):
    """Walks from every order, seen two months after its day, over what it refers to and what refers to that."""
    d = db(spark, sf_dir)
    seeds = d.rows("orders").select(F.col("row_id").alias("seq"), "row_id", (S.micros(F.col("o_orderdate")) + 60 * 86400 * 1_000_000).alias("obs"))
    return M.rows_of(_walks(d, seeds, _ALL))


@query(f"""WITH {_ANCESTORS}, edges AS ({_EDGES}), e AS (SELECT a.seq, count(DISTINCT (a.row_id, b.row_id)) AS edges FROM walked a JOIN edges x ON x.src = a.row_id JOIN walked b ON b.seq = a.seq AND b.row_id = x.dst GROUP BY a.seq)
  SELECT seq, CAST(sum({_SIZE}) AS BIGINT) AS cells, count(*) AS rows, CASE WHEN bool_or(low) THEN 1 ELSE 0 END AS nulls, any_value(edges) AS edges FROM walked JOIN e USING (seq) GROUP BY seq""")
def sequence_summary(spark, sf_dir):
    d, config = db(spark, sf_dir), M.SamplerConfig(bfs_child_width=0)
    return H.summary(d, H.lineage(d, "lineitem", config, links=True, nulls=True, rows=_low(d)), config)


@query(f"""WITH {_ANCESTORS}, edges AS ({_EDGES}) SELECT DISTINCT a.seq, a.seq_row_id AS i, b.seq_row_id AS j FROM walked a JOIN edges x ON x.src = a.row_id JOIN walked b ON b.seq = a.seq AND b.row_id = x.dst""")
def fk_adj(spark, sf_dir):
    return H.adjacency(H.lineage(db(spark, sf_dir), "lineitem", M.SamplerConfig(bfs_child_width=0), links=True))


_LAYOUT = " UNION ALL ".join(f"SELECT '{t.name}' AS tbl, {k} AS cell, {c.index} AS column_idx" for t in ANNOTATION.tables.values() if t.name in ("orders", "customer") for k, c in enumerate(x for x in t.columns.values() if x.stype != SType.IGNORED))


@query(f"""WITH layout AS ({_LAYOUT}), w AS (SELECT o_orderkey + {OFFSET['orders']} AS seq, o_orderkey + {OFFSET['orders']} AS o, o_custkey + {OFFSET['customer']} AS c FROM orders)
  SELECT seq, CAST(cell AS BIGINT) AS pos, 0 AS seq_row_id, o AS row_id, column_idx FROM w, layout WHERE tbl = 'orders'
  UNION ALL SELECT seq, cell + {_WIDTH['orders']}, 1, c, column_idx FROM w, layout WHERE tbl = 'customer' AND cell + {_WIDTH['orders']} < 9""")
def sequence_cut(spark, sf_dir):
    """A length that ends within the second row."""
    d, config = db(spark, sf_dir), M.SamplerConfig(sequence_length=9, bfs_child_width=0)
    return H.laid_out(d, H.walked(H.lineage(d, "orders", config)), config).select("seq", "pos", "seq_row_id", "row_id", "column_idx")


_AT = M.target_position([c.stype for c in ANNOTATION.tables["orders"].columns.values()], SType.NUMERICAL)


@query(f"""WITH layout AS ({_LAYOUT}), counts AS (SELECT o_orderkey AS k, CASE WHEN num_lineitems > 1 THEN num_lineitems END AS v FROM ({K.rewritten(TASKS['task_num_lineitems_30d'][0], ORDER).replace('`', '')}))
  SELECT o_orderkey + {OFFSET['orders']} AS seq, cell AS pos, cell = {_AT} AS is_target, CASE WHEN cell = {_AT} THEN v IS NULL ELSE column_idx = {next(c.index for c in ANNOTATION.tables['orders'].columns.values() if c.name == 'o_orderpriority')} AND o_orderpriority = '5-LOW' END AS is_null,
    CASE WHEN cell = {_AT} THEN CAST(v AS DOUBLE) END AS numeric FROM orders JOIN counts ON k = o_orderkey, layout WHERE tbl = 'orders'""")
def target_mark(spark, sf_dir):
    d, config = db(spark, sf_dir), M.SamplerConfig(sequence_length=_WIDTH["orders"], bfs_child_width=0)
    walks = H.lineage(d, "orders", config).join(_targets(d), "seq", "left")
    cells = H.valued(d, H.walked(walks), H.reached(d, "orders", config.sequence_length), config, _low(d))
    return M.marked(cells, _AT, "numeric").select("seq", F.col("pos").cast("int").alias("pos"), "is_target", "is_null", "numeric")


@query(f"""WITH counts AS (SELECT o_orderkey AS k, CASE WHEN num_lineitems > 1 THEN num_lineitems END AS v FROM ({K.rewritten(TASKS['task_num_lineitems_30d'][0], ORDER).replace('`', '')}))
  SELECT o_orderkey + {OFFSET['orders']} AS seq, CAST({sum(_WIDTH[t] for t in ('orders', 'customer', 'nation', 'region'))} AS BIGINT) AS cells, CAST(4 AS BIGINT) AS rows,
    CAST(CASE WHEN v IS NULL THEN 1 ELSE 0 END + CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS BIGINT) AS nulls, CAST(1 AS BIGINT) AS targets, CAST(3 AS BIGINT) AS edges FROM orders JOIN counts ON k = o_orderkey""")
def sequence_targets(spark, sf_dir):
    """Summaries of the sequences of a task's seeds: an order, its customer, nation and region, with the target put in."""
    d, config = db(spark, sf_dir), M.SamplerConfig(bfs_child_width=0)
    walks = H.lineage(d, "orders", config, links=True, nulls=True, rows=_low(d)).join(_targets(d), "seq", "left")
    return H.summary(d, walks, config, _AT).select("seq", "cells", "rows", "nulls", "targets", "edges")


@query(f"""SELECT s_suppkey + {OFFSET['supplier']} AS seq, unnest(range(12)) AS place, unnest([7, 8, 4, 5, 6, 0, 1, 2, 3, 9, 10, 11]) AS col_perm,
  unnest([4, 5, 6, 0, 1, 2, 3, 7, 8, 9, 10, 11]) AS out_perm, unnest([7, 8, 4, 5, 6, 0, 1, 2, 3, 9, 10, 11]) AS in_perm FROM supplier""")
def perm_rcm(spark, sf_dir):
    """Chains of a supplier, its nation and its region: nine cells and three places of padding."""
    d, config = db(spark, sf_dir), M.SamplerConfig(sequence_length=12, bfs_child_width=0, max_rows_per_seq=3)
    from lattica.streaming.batches import permuted

    walks = H.lineage(d, "supplier", config, links=True)
    return permuted(H.laid_out(d, H.walked(walks.drop("links")), config), H.adjacency(walks), config)


_CELLS = "cells AS (SELECT s_nationkey AS seq, r, r * 4 + c AS pos, c FROM (SELECT s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS r FROM supplier), (SELECT unnest(range(4)) AS c))"


@query(f"""WITH {_CELLS} SELECT * FROM (SELECT a.seq, a.pos AS i, b.pos AS j, a.r = b.r OR b.r = a.r + 1 AS outbound, a.r = b.r + 1 OR a.pos = b.pos AS inbound, a.c = b.c AS same_column
  FROM cells a JOIN cells b ON a.seq = b.seq) WHERE outbound OR inbound OR same_column""")
def attention_masks(spark, sf_dir):
    from pyspark.sql import Window

    s = db(spark, sf_dir).scan("supplier").select(F.col("s_nationkey").alias("seq"), (F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1).alias("seq_row_id"))
    cells = s.withColumn("column_idx", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("pos", (F.col("seq_row_id") * 4 + F.col("column_idx")).cast("long"))
    adjacency = s.select("seq", F.col("seq_row_id").alias("i"), (F.col("seq_row_id") + 1).alias("j"))
    return M.masks(cells, adjacency)


@query("""WITH x AS (SELECT doc_id % 16 AS batch, doc_id // 16 AS seq, text FROM documents WHERE text IS NOT NULL)
  SELECT batch, md5(text) AS digest, row_number() OVER (PARTITION BY batch ORDER BY f) - 1 AS local FROM (SELECT batch, text, min(seq) AS f FROM x GROUP BY batch, text)""")
def batch_text_dedup(spark, sf_dir):
    x = db(spark, sf_dir).scan("documents").select((F.col("doc_id") % 16).alias("batch"), F.floor(F.col("doc_id") / 16).alias("seq"), F.lit(0).alias("pos"), "text")
    return M.local_texts(x).select("batch", F.md5("text").alias("digest"), F.col("local").cast("long").alias("local"))


# Vectors


@query("SELECT vec_id, round(sqrt(list_sum([CAST(x AS DOUBLE) * x FOR x IN embedding])), 5) AS norm FROM embeddings")
def l2_norm(spark, sf_dir):
    return R.read(spark, sf_dir, "embeddings").select("vec_id", F.round(S.norm(F.col("embedding")), 5).alias("norm"))


@query("""SELECT vec_id, unnest(range(16)) AS place, round(unnest([CAST(x AS DOUBLE) / n FOR x IN v]), 4) + 0.0 AS x FROM
  (SELECT vec_id, embedding[1:16] AS v, sqrt(list_sum([CAST(x AS DOUBLE) * x FOR x IN embedding[1:16]])) AS n FROM embeddings)""")
def mrl_normalize(spark, sf_dir):
    e = R.read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(S.shortened(F.col("embedding"), 16)).alias("place", "x"))
    return e.select("vec_id", F.col("place").cast("long").alias("place"), (F.round(F.col("x").cast("double"), 4) + 0.0).alias("x"))


@query("""SELECT a.vec_id, round(list_sum([CAST(x AS DOUBLE) * b.embedding[i] FOR x, i IN a.embedding]) / sqrt(list_sum([CAST(x AS DOUBLE) * x FOR x IN a.embedding])) / sqrt(list_sum([CAST(x AS DOUBLE) * x FOR x IN b.embedding])), 4) + 0.0 AS cosine
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine(spark, sf_dir):
    e = R.read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    near = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(near, "vec_id").select("vec_id", (F.round(S.cosine(F.col("embedding"), F.col("other")), 4) + 0.0).alias("cosine"))


@query("SELECT event_id, vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM events JOIN embeddings ON vec_id = event_id % (SELECT count(*) FROM embeddings)")
def embed_gather(spark, sf_dir):
    e = R.read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"))
    keys = R.read(spark, sf_dir, "events").select("event_id", (F.col("event_id") % e.count()).alias("vec_id"))
    return keys.join(e, "vec_id").select("event_id", "vec_id", F.round("x", 6).alias("first"))


# Profiles


@query("SELECT count(*) AS total, count(DISTINCT nullif(o_orderpriority, '5-LOW')) AS distinct, count(*) FILTER (WHERE nullif(o_orderpriority, '5-LOW') IS NULL) AS nulls FROM orders".replace("AS distinct", 'AS "distinct"'))
def profile_distinct(spark, sf_dir):
    return P.distinct(db(spark, sf_dir).scan("orders").withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("5-LOW"))), "o_orderpriority")


@query("SELECT CAST(p_size AS VARCHAR) AS value, count(*) AS n FROM part GROUP BY p_size ORDER BY n DESC, value LIMIT 20")
def profile_value_counts(spark, sf_dir):
    return P.value_counts(db(spark, sf_dir).scan("part"), "p_size", 20)


_PROFILE = """SELECT '{c}' AS col, count(*) AS total, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count({c}) AS non_null, round(CAST(min({c}) AS DOUBLE), 4) AS min, round(CAST(max({c}) AS DOUBLE), 4) AS max,
  round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(CAST(median({c}) AS DOUBLE), 4) AS median, round((SELECT max(n) FROM (SELECT count(*) AS n FROM {t} GROUP BY {c})) / count({c}), 4) AS dominant FROM {t}"""


@query(" UNION ALL ".join(_PROFILE.format(t=t, c=c) for t, c in (("orders", "o_totalprice"), ("part", "p_size"), ("lineitem", "l_quantity"), ("events", "value"))))
def profile_column_stats(spark, sf_dir):
    d = db(spark, sf_dir)
    r = {c: F.round(c, 4) for c in ("min", "max", "mean", "std", "median")}
    return union(P.column_profile(d.scan(t), c).withColumns(r).select(F.lit(c).alias("col"), "*") for t, c in (("orders", "o_totalprice"), ("part", "p_size"), ("lineitem", "l_quantity"), ("events", "value")))


#: Categories: so few that their count in a sketch is exact.
_FEW = {t: [c.name for c in ANNOTATION.tables[t].columns.values() if c.stype == SType.CATEGORICAL] for t in ORDER}


@query(" UNION ALL ".join(f"SELECT '{t}' AS tbl, '{c}' AS col, count(*) AS total, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS n_distinct, min(CAST({c} AS VARCHAR)) AS first, max(CAST({c} AS VARCHAR)) AS last FROM {t}" for t in ORDER for c in _FEW[t]))
def profile_sketched(spark, sf_dir):
    """Profiles of all columns of categories from sketches of files, merged over each table's files."""
    parts = union(Q.sketched(R.read(spark, sf_dir, t), _FEW[t]).withColumn("tbl", F.lit(t)) for t in ORDER if _FEW[t])
    return Q.profiles(Q.merged(parts, "tbl")).select("tbl", "col", "total", "nulls", F.col("distinct").alias("n_distinct"), "first", "last")


#: Identifiers that are whole numbers.
_KEYS = [(t.name, c.name) for t, c in ANNOTATION.column_list() if c.stype == SType.IDENTIFIER and not c.name.endswith("name")]


@query(" UNION ALL ".join(f"SELECT '{t}.{c}' AS col, '{u}.{k}' AS holder, count(*) AS total FROM (SELECT {c} AS v FROM {t} WHERE {c} IS NOT NULL) HAVING count(*) > 0 AND count(*) = count(*) FILTER (WHERE v IN (SELECT {k} FROM {u}))"
  for t, c in _KEYS for u, k in _KEYS if (t, c) != (u, k)))
def key_inclusions(spark, sf_dir):
    """Every key column all of whose values another one holds."""
    found = P.inclusions([(f"{t}.{c}", R.read(spark, sf_dir, t), c) for t, c in _KEYS])
    return found.filter("matched = total").select("col", "holder", "total")


@query("""SELECT 'lineitem.l_orderkey' AS fk, count(l_orderkey) AS total, count(o_orderkey) AS matched, round(count(o_orderkey) / count(l_orderkey), 4) AS rate FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT 'events.user_id', count(user_id), count(s_suppkey), round(count(s_suppkey) / count(user_id), 4) FROM events LEFT JOIN supplier ON user_id = s_suppkey""")
def fk_check(spark, sf_dir):
    d = db(spark, sf_dir)
    one = lambda t, c, o, k: P.contained(d.scan(t), c, d.scan(o), k).select(F.lit(f"{t}.{c}").alias("fk"), "*")
    return one("lineitem", "l_orderkey", "orders", "o_orderkey").unionAll(one("events", "user_id", "supplier", "s_suppkey"))


_DISTINCT = lambda t, k: " + ".join(["0", *(f"(SELECT count(DISTINCT {c}) FROM {t})" for u, c, _ in columns(k) if u == t)])


@query(" UNION ALL ".join(f"SELECT '{t}' AS tbl, {len(ANNOTATION.tables[t].columns)} AS n_columns, (SELECT count(*) FROM {t}) AS n_rows, {' + '.join(['0', *(f'(SELECT count({c}) FROM {u})' for u, c, *_ in _FKS if u == t)])} AS n_edges, {_DISTINCT(t, SType.CATEGORICAL)} AS n_categories, {sum(x[1] == t for x in TASKS.values())} AS n_tasks" for t in ORDER))
def db_overview(spark, sf_dir):
    d = db(spark, sf_dir)
    tables = spark.createDataFrame([(t, len(d.annotation.tables[t].columns), n, sum(x.anchor_table == t for x in d.annotation.tasks.values())) for t, n in d.counts.items()], "tbl string, n_columns int, n_rows long, n_tasks int")
    of = spark.createDataFrame([(c.index, t.name) for t, c in d.annotation.column_list()], "column_idx int, tbl string")
    count = lambda df, name: df.groupBy("column_idx").agg(F.count("*").alias("n")).join(F.broadcast(of), "column_idx").groupBy("tbl").agg(F.sum("n").alias(name))
    out = tables.join(count(G.edges(d), "n_edges"), "tbl", "left").join(count(V.categorical(d), "n_categories"), "tbl", "left")
    return out.fillna(0)


# Losses


@query("SELECT event_id, round(greatest(x, 0) - x * y + ln(1 + exp(-abs(x))), 6) AS loss FROM (SELECT event_id, value / 10 - 5 AS x, CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.0 END AS y FROM events)")
def loss_bce(spark, sf_dir):
    e = R.read(spark, sf_dir, "events")
    return e.select("event_id", F.round(L.bce(F.col("value") / 10 - 5, F.when(F.col("event_id") % 3 == 0, 1.0).otherwise(0.0)), 6).alias("loss"))


@query("SELECT event_id, 0.5::DOUBLE * q * q + 1.0::DOUBLE * (abs(x) - q) AS loss FROM (SELECT event_id, x, least(abs(x), 1.0::DOUBLE) AS q FROM (SELECT event_id, CAST(value AS DOUBLE) / 20 - 1 AS x FROM events))")
def loss_huber(spark, sf_dir):
    return R.read(spark, sf_dir, "events").select("event_id", L.huber(F.col("value").cast("double") / 20 - 1).alias("loss"))


@query("""WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) * 8 FOR x IN embedding[1:15]] AS p, [CAST(x AS DOUBLE) * 8 FOR x IN embedding[16:30]] AS t FROM embeddings),
  e AS (SELECT vec_id, [CASE WHEN abs(x - t[i]) <= 1 THEN (x - t[i]) * (x - t[i]) / 2 ELSE abs(x - t[i]) - 0.5 END FOR x, i IN p] AS h FROM v)
  SELECT vec_id, round(list_sum(h[1:14]) / 14 + 2 * h[15], 5) AS loss FROM e""")
def loss_timestamp(spark, sf_dir):
    e = R.read(spark, sf_dir, "embeddings")
    part = lambda at: F.transform(F.slice("embedding", at, 15), lambda x: x.cast("double") * 8)
    return e.select("vec_id", F.round(L.time_loss(part(1), part(16)), 5).alias("loss"))


@query("""WITH v AS (SELECT vec_id, label, [CAST(x AS DOUBLE) * 4 FOR x IN embedding[1:10]] AS l FROM embeddings), z AS (SELECT *, ln(list_sum([exp(x) FOR x IN l])) AS lz FROM v)
  SELECT vec_id, round(lz - l[label + 1] + 1e-4 * lz * lz, 6) AS loss FROM z""")
def loss_categorical(spark, sf_dir):
    logits = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") * 4)
    return R.read(spark, sf_dir, "embeddings").select("vec_id", F.round(L.category_loss(logits, F.col("label")), 6).alias("loss"))


@query("SELECT event_type, round(coalesce(sum(value) FILTER (WHERE event_id % 5 = 0), 0) / greatest(count(*) FILTER (WHERE event_id % 5 = 0), 1), 5) AS loss FROM events GROUP BY event_type")
def loss_masked_mean(spark, sf_dir):
    return R.read(spark, sf_dir, "events").groupBy("event_type").agg(F.round(L.masked_mean(F.col("value"), F.col("event_id") % 5 == 0), 5).alias("loss"))
