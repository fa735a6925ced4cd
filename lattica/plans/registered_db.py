"""Queries over the encoded database, written from the test tables and read back, and over what surrounds it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import losses as L
from lattica.functions import scalar as S
from lattica.plans import registered as Q
from lattica.plans import tasks as K
from lattica.plans.preprocess import preprocess
from lattica.plans.registered import ANNOTATION, OFFSET, ORDER, ROWS, columns, query, union
from lattica.sources import tables as R
from lattica.sources.annotation import Annotation, SType
from lattica.sources.database import Database, folder
from lattica.sources.testdb import TABLES, TASKS, annotation

_MADE: dict[tuple[str, str], Database] = {}


def encoded(spark: SparkSession, sf_dir: str) -> Database:
    """The encoded database of the test tables in the shared folder, written once a session."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _MADE:
        _MADE[key] = preprocess(spark, sf_dir, annotation(), f"{folder(spark)}/lattica/database-{uuid.uuid4().hex}")
    return _MADE[key]


def _long(d: Database, kind: SType, value: str) -> DataFrame:
    """(column_idx, row_id, value) of every encoded column of a type."""
    parts = []
    for t in ORDER:
        own = [F.struct(F.lit(i).alias("column_idx"), F.col(f"`{c}`").alias(value)) for u, c, i in columns(kind) if u == t]
        if own:
            parts.append(d.table(t).select("row_id", F.explode(F.array(*own)).alias("x")).select("x.column_idx", "row_id", f"x.{value}"))
    return union(parts)


def _rows_sql(select: str, kind: SType, more: str = "") -> str:
    """A select over the rows of every column of a type; {c}, {t}, {i} are its name, its table and its number."""
    one = "SELECT {i} AS column_idx, CAST(_row AS BIGINT) + {o} AS row_id, " + select + " FROM {r}" + more
    return " UNION ALL ".join(one.format(t=t, c=c, i=i, o=OFFSET[t], r=ROWS[t]) for t, c, i in columns(kind))


@query(_rows_sql("round(CAST(CAST(({c} - m) / s AS FLOAT) AS DOUBLE), 4) + 0.0 AS z", SType.NUMERICAL, ", (SELECT avg(CAST({c} AS DOUBLE)) AS m, stddev_samp(CAST({c} AS DOUBLE)) AS s FROM {t})"))
def db_numerical(spark, sf_dir):
    return _long(encoded(spark, sf_dir), SType.NUMERICAL, "z").withColumn("z", F.round(F.col("z").cast("double"), 4) + 0.0)


@query(_rows_sql("epoch_us({c}) AS us, CASE WHEN {c} IS NOT NULL THEN 15 END AS slots", SType.TIMESTAMP))
def db_timestamp(spark, sf_dir):
    d = encoded(spark, sf_dir)
    one = lambda t, c, i: d.table(t).select(F.lit(i).alias("column_idx"), "row_id", F.col("_us").alias("us"), F.when(F.col(c).isNotNull(), F.size(c)).alias("slots"))
    return union(one(*x) for x in columns(SType.TIMESTAMP))


@query(_rows_sql("{c} <> 0 AS truth", SType.BOOLEAN))
def db_boolean(spark, sf_dir):
    return _long(encoded(spark, sf_dir), SType.BOOLEAN, "truth")


@query(f"WITH {Q._VOCABULARY} " + _rows_sql("v.idx AS idx", SType.CATEGORICAL, " LEFT JOIN vocabulary v ON v.column_idx = {i} AND v.category = CAST({c} AS VARCHAR)"))
def db_categorical(spark, sf_dir):
    return _long(encoded(spark, sf_dir), SType.CATEGORICAL, "idx")


_BOTH = dict((c, i) for _, c, i in columns(SType.TEXT))


@query(f"""WITH {Q._TEXTS.format(cut=Q._CUT)} SELECT {_BOTH['p_name']} AS column_idx, p_partkey + {OFFSET['part']} AS row_id, idx FROM part JOIN textnumbers ON text = p_name
  UNION ALL SELECT {_BOTH['text']}, doc_id + {OFFSET['documents']}, idx FROM documents JOIN textnumbers ON textnumbers.text = {Q._CUT.replace('text', 'documents.text')}""")
def db_text(spark, sf_dir):
    return _long(encoded(spark, sf_dir), SType.TEXT, "idx")


_CELLS = [(t.name, c.name, c.index, int(c.stype)) for t, c in ANNOTATION.column_list() if c.stype != SType.IGNORED]


@query(" UNION ALL ".join(f"SELECT {i} AS column_idx, {k} AS stype, count(*) AS cells, {0 if k == SType.IDENTIFIER else f'count(*) FILTER (WHERE {c} IS NULL)'}::BIGINT AS nulls FROM {t}" for t, c, i, k in _CELLS))
def db_cells(spark, sf_dir):
    return encoded(spark, sf_dir).cells.groupBy("column_idx", "stype").agg(F.count("*").alias("cells"), F.count_if("is_null").alias("nulls"))


@query(Q._EDGES)
def db_edges(spark, sf_dir):
    return encoded(spark, sf_dir).edges.select("src", "dst", "column_idx")


def _seeds_sql(k: int, name: str) -> str:
    sql, table, key, target, _, obs = TASKS[name]
    time = ANNOTATION.tables[table].temporal_column
    us = f"epoch_us(q.{obs})" if obs else f"epoch_us(a.{time})" if time else "CAST(NULL AS BIGINT)"
    pk = ANNOTATION.tables[table].primary_key
    return f"""SELECT '{name}' AS task, {k} AS task_idx, row_number() OVER (ORDER BY q.{key}, {us} NULLS FIRST, q.{target} NULLS FIRST) - 1 AS seed_idx,
      a.{pk} + {OFFSET[table]} AS row, {us} AS obs, q.{target} IS NULL AS is_null FROM ({K.rewritten(sql, ORDER).replace('`', '')}) q JOIN {table} a ON a.{pk} = q.{key}"""


@query(f"""WITH {Q._siphash_sql(' UNION ALL '.join(_seeds_sql(k, n) for k, n in enumerate(TASKS)))}
  SELECT task, task_idx, seed_idx, row AS row_id, obs, is_null, bucket, CASE WHEN bucket < 800 THEN 'train' WHEN bucket <= 900 THEN 'val' ELSE 'test' END AS split FROM hashed""")
def db_seeds(spark, sf_dir):
    values = [F.col(c).isNull() for c in ("numeric", "timestamp", "boolean", "categorical")]
    return encoded(spark, sf_dir).seeds.select("task", "task_idx", "seed_idx", "row_id", "obs", (values[0] & values[1] & values[2] & values[3]).alias("is_null"), "bucket", "split")


@query(f"""WITH {Q._VOCABULARY}, {Q._TEXTS.format(cut=Q._CUT)}, strings AS (SELECT 'column' AS kind, idx, text FROM ({Q.SQL['vocab_columns']})
  UNION ALL SELECT DISTINCT 'categorical', idx, text FROM vocabulary UNION ALL SELECT 'text', idx, text FROM textnumbers)
  SELECT kind, idx, md5(text) AS digest, 256 AS dimension, 0.0::DOUBLE AS norm FROM strings""")
def db_embeddings(spark, sf_dir):
    d = encoded(spark, sf_dir)
    one = lambda k: d.embeddings(k).select(F.lit(k).alias("kind"), "idx", F.md5("text").alias("digest"), F.size("emb").alias("dimension"), S.norm(F.col("emb")).alias("norm"))
    return union(map(one, ("column", "categorical", "text")))


_NUMBER = {(t.name, c.name): c.index for t, c in ANNOTATION.column_list()}


@query(f"""WITH {Q._VOCABULARY}, {Q._TEXTS.format(cut=Q._CUT)}, edges AS ({Q._EDGES}) SELECT 'rows' AS what, tbl AS name, n FROM ({" UNION ALL ".join(f"SELECT '{t}' AS tbl, count(*) AS n FROM {t}" for t in ORDER)})
  UNION ALL SELECT 'edges', '', count(*) FROM edges
  UNION ALL SELECT 'vocabulary', 'column', {len(_NUMBER)} UNION ALL SELECT 'vocabulary', 'categorical', count(DISTINCT idx) FROM vocabulary UNION ALL SELECT 'vocabulary', 'text', count(*) FROM textnumbers
  UNION ALL {" UNION ALL ".join(f"SELECT 'refers to', '{t}.{c}', {_NUMBER[to, k]}" for t, c, _, to, k in Q._FKS)}
  UNION ALL {" UNION ALL ".join(f"SELECT 'seeds', '{n}', count(*) FROM ({_seeds_sql(k, n)})" for k, n in enumerate(TASKS))}""")
def db_metadata(spark, sf_dir):
    m = encoded(spark, sf_dir).metadata
    out = [("edges", "", m["edges"]), *(("seeds", t["name"], t["seeds"]) for t in m["tasks"])]
    out += [(what, name, n) for what, key in (("rows", "rows"), ("vocabulary", "vocabulary"), ("refers to", "foreign_keys")) for name, n in m[key].items()]
    return spark.createDataFrame(out, "what string, name string, n long")


_HALF = f"(SELECT *, CAST(o_orderkey AS BIGINT) + {OFFSET['orders']} AS row_id FROM orders WHERE o_orderkey % 2 = 0)"


@query(f"""WITH {Q._VOCABULARY} SELECT 'time' AS cell, row_id, o_orderdate IS NOT NULL AS present, epoch_us(o_orderdate) AS us, CAST(NULL AS BIGINT) AS idx FROM {_HALF}
  UNION ALL SELECT 'key', row_id, o_custkey IS NOT NULL, epoch_us(o_orderdate), NULL FROM {_HALF}
  UNION ALL SELECT 'category', row_id, o_orderstatus IS NOT NULL, epoch_us(o_orderdate), v.idx FROM {_HALF} LEFT JOIN vocabulary v ON v.text = 'o_orderstatus is ' || o_orderstatus""")
def db_values(spark, sf_dir):
    """Cells of the orders with even keys: the rows are the request."""
    d = encoded(spark, sf_dir)
    asked = d.table("orders").select("row_id").filter((F.col("row_id") - d.offsets["orders"]) % 2 == 0)
    out = []
    for cell, column in (("time", "o_orderdate"), ("key", "o_custkey"), ("category", "o_orderstatus")):
        idx = F.col("value") if cell == "category" else F.lit(None).cast("bigint")
        out.append(d.values(asked, "orders", column).select(F.lit(cell).alias("cell"), "row_id", "present", F.col("_us").alias("us"), idx.alias("idx")))
    return union(out)


@query(f"SELECT event_id + {OFFSET['events']} AS row_id, 'event_type is ' || event_type AS text, CASE WHEN event_type IS NOT NULL THEN 256 ELSE -1 END AS dimension FROM events")
def db_embedding_of(spark, sf_dir):
    d = encoded(spark, sf_dir)
    rows = d.table("events").select("row_id", F.col("event_type").alias("idx"))
    return d.embedded(rows, "categorical").select("row_id", "text", F.coalesce(F.size("emb"), F.lit(-1)).alias("dimension"))


_BIG = "CASE WHEN event_type <> 'click' THEN value > 50 END"


@query(f"SELECT event_id // 8 AS byte, CAST(sum(CASE WHEN {_BIG} THEN 1 << CAST(event_id % 8 AS INTEGER) ELSE 0 END) AS INTEGER) AS bits FROM events GROUP BY event_id // 8")
def bitmap(spark, sf_dir):
    return S.packed_rows(R.read(spark, sf_dir, "events"), "event_id", F.expr(_BIG))


@query(f"SELECT event_id, coalesce({_BIG}, false) AS is_set FROM events")
def bitmap_bits(spark, sf_dir):
    events = R.read(spark, sf_dir, "events")
    packed = S.packed_rows(events, "event_id", F.expr(_BIG))
    return events.select("event_id", F.floor(F.col("event_id") / 8).alias("byte")).join(packed, "byte").select("event_id", S.bit_of(F.col("bits"), F.col("event_id")).alias("is_set"))


# What an annotator asks


def _annotated_sql() -> str:
    out, kinds = [], {}
    for i, (t, (pk, time, own)) in enumerate(TABLES.items()):
        for c, x in own.items():
            kind, to = x if isinstance(x, tuple) else (x, None)
            kinds[f"{t}.{c}"] = len(kinds)
            role = "key" if c == pk else "time" if c == time else ""
            out.append((t, i, c, kinds[f"{t}.{c}"], kind.name.lower(), role, to))
    value = lambda to: f"CAST({kinds[to] if to else 'NULL'} AS INTEGER)"
    return " UNION ALL ".join(f"SELECT '{t}' AS tbl, {i} AS tbl_idx, '{c}' AS col, {n} AS idx, '{k}' AS stype, '{r}' AS role, {value(to)} AS refers_to" for t, i, c, n, k, r, to in out)


@query(_annotated_sql())
def annotation_columns(spark, sf_dir):
    """The annotation written as JSON and read again."""
    a = Annotation.parse(annotation().dump())
    role = lambda t, c: "key" if c == t.primary_key else "time" if c == t.temporal_column else ""
    rows = [(t.name, t.index, c.name, c.index, c.stype.name.lower(), role(t, c.name), a.resolve(c.foreign_key)) for t, c in a.column_list()]
    return spark.createDataFrame(rows, "tbl string, tbl_idx int, col string, idx int, stype string, role string, refers_to int")


@query(" UNION ALL ".join(f"SELECT '{t}' AS name" for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()))
def dataset_listing(spark, sf_dir):
    return spark.createDataFrame([(t,) for t in R.listed(spark, sf_dir)], "name string")


@query(" UNION ALL ".join(f"SELECT '{t}' AS tbl, column_name AS name, CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END AS type FROM (DESCRIBE {t})" for t in ORDER))
def schema_columns(spark, sf_dir):
    return spark.createDataFrame([(t, x["name"], x["type"]) for t in ORDER for x in R.schema_rows(R.read(spark, sf_dir, t))], "tbl string, name string, type string")


@query("SELECT o_orderstatus AS status, CAST(count(*) AS VARCHAR) AS n FROM orders GROUP BY o_orderstatus")
def adhoc_sql(spark, sf_dir):
    Q.db(spark, sf_dir).register()
    rows = R.query(spark, "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus")
    return spark.createDataFrame(rows, "status string, n string")


# From predictions back to values


@query("SELECT event_id, strftime(ts + INTERVAL 500 MICROSECOND, '%Y-%m-%d %H:%M') AS shown FROM events")
def time_inverse(spark, sf_dir):
    """A z-score holds a time to about a microsecond; half a millisecond more keeps whole minutes on their side."""
    d = Q.db(spark, sf_dir)
    scale = Q._scale(d).first()
    us = S.micros(S.as_time(F.col("ts"))).cast("double")
    back = F.round(S.time_from_z(S.zscore(us, scale.mean, scale.std), scale.mean, scale.std)).cast("long")
    return d.scan("events").select("event_id", S.shown_time(back + 500).alias("shown"))


@query("SELECT event_id, round(value * 2.5 + 1.25, 4) AS number, value / 10 - 5 > 0 AS truth FROM events")
def decode_scalars(spark, sf_dir):
    v = F.col("value")
    return R.read(spark, sf_dir, "events").select("event_id", F.round(L.decoded_number(v, 1.25, 2.5), 4).alias("number"), L.decoded_boolean(v / 10 - 5).alias("truth"))


@query("SELECT vec_id, CAST(list_position(l, list_max(l)) - 1 AS BIGINT) AS choice FROM (SELECT vec_id, embedding[1:10] AS l FROM embeddings)")
def decode_category(spark, sf_dir):
    return R.read(spark, sf_dir, "embeddings").select("vec_id", L.decoded_category(F.slice("embedding", 1, 10)).alias("choice"))


@query("""WITH x AS (SELECT event_id, event_id % 7 = 0 AS gone, value / 50 - 1 AS a, value / 20 - 1 AS e, value / 10 - 5 AS b, CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.0 END AS y FROM events)
  SELECT event_id, round(greatest(a, 0) - CASE WHEN gone THEN a ELSE 0 END + ln(1 + exp(-abs(a))) + CASE WHEN gone THEN 0
    WHEN event_id % 2 = 0 THEN CASE WHEN abs(e) <= 1 THEN e * e / 2 ELSE abs(e) - 0.5 END ELSE greatest(b, 0) - b * y + ln(1 + exp(-abs(b))) END, 6) AS loss FROM x""")
def loss_cell(spark, sf_dir):
    v, n = F.col("value"), F.col("event_id")
    cells = R.read(spark, sf_dir, "events").select(
        n, F.when(n % 2 == 0, int(SType.NUMERICAL)).otherwise(int(SType.BOOLEAN)).alias("target_stype"), (n % 7 == 0).cast("int").alias("is_null"), (v / 50 - 1).alias("null_logit"),
        (v / 20).alias("num_pred"), F.lit(1.0).alias("num_true"), (v / 10 - 5).alias("bool_logit"), F.when(n % 3 == 0, 1.0).otherwise(0.0).alias("bool_true"),
    )
    return cells.select("event_id", F.round(L.cell_loss(cells), 6).alias("loss"))


@query("""SELECT p_partkey AS step, round(0.001::DOUBLE * CASE WHEN p_partkey < 50 THEN p_partkey / 50.0::DOUBLE
  ELSE 0.1::DOUBLE + 0.9::DOUBLE * 0.5::DOUBLE * (1 + cos(pi() * least((p_partkey - 50) / 100.0::DOUBLE, 1))) END, 10) AS rate FROM part""")
def learning_rate(spark, sf_dir):
    return R.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("step"), F.round(L.schedule(F.col("p_partkey"), 50, 150, 0.001), 10).alias("rate"))
