"""Weighted rendezvous hashing of record keys to shards, and gapless places within them, with DataFrame functions only.

Every shard draws a number for every key, from the key and the shard's number alone; the best draw has the key. A shard
that is added takes the keys for which it draws better than all others and moves no other key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.shared import sized, written

#: Hexadecimal digits of a draw: 52 bits, so that a draw and its half-step are exact as double.
DIGITS = 13


def _draws(key: Column, shards: Column) -> Column:
    """An array with every shard's draw for a key, in the open interval 0 to 1. One MD5 serves two shards."""
    half = lambda h, at: (F.conv(F.substring(h, at, DIGITS), 16, 10).cast("long") + 0.5) / float(16**DIGITS)
    both = lambda i: F.transform(F.array(F.md5(F.concat_ws("/", i.cast("string"), key))), lambda h: F.array(half(h, 1), half(h, 17)))
    pairs = F.sequence(F.lit(0), F.ceil(shards / 2).cast("int") - 1)
    return F.flatten(F.flatten(F.transform(pairs, both)))


def assigned(docs: DataFrame, key: Column, weights: Sequence[float], grown: float | None = None) -> DataFrame:
    """docs with shard, a place in weights, and grown_shard, the one when a shard of weight `grown` comes last (null without).

    A shard's share of the keys is that of its weight; weight 0 takes none. Keys count by their text, null as ''. Rows of
    one key are in one shard. Columns called shard or grown_shard are replaced.
    """
    if not any(weights) or min(weights) < 0 or (grown is not None and grown < 0):
        raise ValueError("weights are not negative and at least one is above 0")
    all_ = [float(w) for w in [*weights, *([] if grown is None else [grown])]]
    scores = lambda draws: F.transform(draws, lambda u, i: F.struct(F.try_divide(-F.ln(u), F.get(F.array(*map(F.lit, all_)), i)).alias("score"), i.alias("shard")))
    # a weight of 0 gives null: such a shard is left out
    ranked = F.filter(scores(F.slice(_draws(F.coalesce(key.cast("string"), F.lit("")), F.lit(len(all_))), 1, len(all_))), lambda s: s["score"].isNotNull())
    best = F.transform(F.array(ranked), lambda r: F.struct(F.array_min(F.filter(r, lambda s: s["shard"] < len(weights)))["shard"].alias("now"), F.array_min(r)["shard"].alias("then")))[0]
    free = next(f"_{i}" for i in range(len(docs.columns) + 1) if f"_{i}" not in docs.columns)
    out = docs.withColumn(free, best)
    then = F.col(f"{free}.then") if grown is not None else F.lit(None)
    return out.withColumns({"shard": F.col(f"{free}.now").cast("int"), "grown_shard": then.cast("int")}).drop(free)


def placed(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows, a written table, with `name`: each row's place from 0 in its group, in the given order.

    Rows are sorted in ranges of (group, order), numbered within them, and moved on by what earlier ranges hold of their
    group, so that neither a group nor rows with equal values have to fit one task. Rows equal in all of order have any order.
    """
    row, at = (next(f"_{x}{i}" for i in range(len(rows.columns) + 1) if f"_{x}{i}" not in rows.columns) for x in ("row", "at"))
    keys = [group, *order, row]
    ranges = rows.withColumn(row, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranges = written(ranges.drop(row).withColumn(at, F.monotonically_increasing_id()), "ranges")
    part = F.shiftright(at, 33)
    parts = ranges.groupBy(F.col(group).alias("_group"), part.alias("_part")).agg(F.min(at).alias("_first"), F.count("*").alias("_c"))
    # one row a range, and one more a group that spans ranges
    starts = written(parts.select("_group", "_part", (F.sum("_c").over(Window.partitionBy("_group").orderBy("_part")) - F.col("_c") - F.col("_first")).alias("_move")), "starts")
    own = ranges.select(F.struct(*[f"`{c}`" for c in rows.columns]).alias("_row"), F.col(f"`{group}`").alias("_group"), part.alias("_part"), F.col(at).alias("_at"))
    return own.join(sized(starts), ["_group", "_part"]).select("_row.*", (F.col("_at") + F.col("_move")).alias(name))


def sharded(docs: DataFrame, weights: Sequence[float], grown: float | None = None, key: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """(key, keep, size, text_crc32, law, shard, slot, grown_shard) of docs (key, text).

    size is the UTF-8 bytes of the text and 8 more, text_crc32 their CRC-32, unsigned; a null text has no bytes. law is
    'key': nothing but a row's key and the shards decide, so rows of one key stay together and equal texts of different
    keys need not. A null key counts as one key. Slots go by (key, size, CRC-32) in a shard from 0 without gaps; equal
    rows have slots of their own. Columns kept are not looked at; of those called as a result the result stays. Empty in, empty out.
    """
    text = F.coalesce("text", F.lit(""))
    kept = [c for c in keep if c not in (key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")]
    rows = docs.select(F.col(f"`{key}`"), *[f"`{c}`" for c in kept], (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    rows = written(assigned(rows, F.col(f"`{key}`"), weights, grown), "shards")
    return placed(rows, "shard", [key, "size", "text_crc32"], "slot")


def write_shards(rows: DataFrame, path: str) -> None:
    """Rows of sharded() as Parquet, a folder a shard (shard=0 and so on), each file a range of slots in their order."""
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


#: Shards of the query, of equal weight; one more of the same weight for grown_shard.
SHARDS = 24


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return sharded(docs, [1.0] * SHARDS, 1.0)


#: The CRC-32 goes through a text's bytes with the table of the polynomial EDB88320, made by eight steps a byte.
OP11_SQL = f"""
WITH RECURSIVE steps AS (
  SELECT i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), lookup AS (
  SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8
), texts AS (
  SELECT DISTINCT coalesce(text, '') AS text FROM documents
), crcs AS (
  SELECT text, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: CAST('0x' || b AS BIGINT))),
    lambda c, b: xor(t[CAST(xor(c, b) & 255 AS INTEGER) + 1], c >> 8))) AS crc FROM texts, lookup
), draws AS (
  SELECT doc_id, shard, -ln((CAST('0x' || substr(md5(CAST(shard // 2 AS VARCHAR) || '/' || coalesce(CAST(doc_id AS VARCHAR), '')), 1 + 16 * CAST(shard % 2 AS INTEGER), {DIGITS}) AS BIGINT) + 0.5::DOUBLE) / {16**DIGITS}::DOUBLE) AS score
  FROM (SELECT DISTINCT doc_id FROM documents), range({SHARDS + 1}) s(shard)
), chosen AS (
  SELECT doc_id, arg_min(shard, score) FILTER (WHERE shard < {SHARDS}) AS shard, arg_min(shard, score) AS grown FROM draws GROUP BY doc_id
)
SELECT d.doc_id, strlen(coalesce(d.text, '')) + 8 AS size, c.crc AS text_crc32, 'key' AS law, CAST(h.shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY h.shard ORDER BY d.doc_id NULLS FIRST, strlen(coalesce(d.text, '')), c.crc) - 1 AS slot, CAST(h.grown AS INTEGER) AS grown_shard
FROM documents d JOIN crcs c ON c.text = coalesce(d.text, '') JOIN chosen h ON h.doc_id IS NOT DISTINCT FROM d.doc_id
"""
