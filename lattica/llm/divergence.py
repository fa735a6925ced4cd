"""How the sources of a language differ: smoothed shares of its terms, pair by pair of sources and term by term.

Shares are whole numbers of billionths, so every sum is exact. A pair's sum over all terms starts from what it would be
if neither source had a term, adds what either source's own terms change, which depends on their counts alone, and mends
what both have: only common terms are joined, and no source's terms are gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.ranking import first_ranked
from lattica.llm.shared import BLANK, INSIDE, small_batches, sized, text_chunks, tokens, written

#: Documents of a language that a term must be in, ranks of terms reported, shares in units of 1 / UNIT.
LEAST_DOCS, TERMS, UNIT = 3, 200, 1_000_000_000
#: Bytes of text whose terms are counted together before anything is shuffled.
CHUNK = 6_000_000
#: Letters A-Z, a-z and all that is not ASCII make terms.
_KINDS = np.array([INSIDE if i >= 128 or chr(i).isalpha() else BLANK for i in range(256)], np.uint8)
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk of (lang, source, text): a term's occurrences and documents by (lang, source), and a row without a term for each such group."""
    for b in batches:
        lang, source = (b.column(c).dictionary_encode() for c in ("lang", "source"))
        n_sources = max(1, len(source.dictionary))
        groups, group = np.unique(lang.indices.to_numpy().astype(np.int64) * n_sources + source.indices.to_numpy(), return_inverse=True)

        def named(at: np.ndarray, term: pa.Array, n: np.ndarray, docs: np.ndarray, groups=groups, lang=lang, source=source, n_sources=n_sources) -> pa.RecordBatch:
            names = [lang.dictionary.take(pa.array(groups[at] // n_sources)), source.dictionary.take(pa.array(groups[at] % n_sources))]
            return pa.RecordBatch.from_arrays([*names, term.cast(pa.string()), pa.array(n.astype(np.int64)), pa.array(docs.astype(np.int64))], schema=_COUNTS)

        rows = np.bincount(group, minlength=len(groups))
        yield named(np.arange(len(groups)), pa.nulls(len(groups), pa.string()), np.zeros(len(groups)), rows)
        for first, _, data, offsets in text_chunks(b.column("text"), CHUNK):
            code, terms, row, _ = tokens(data, offsets, _KINDS)
            if not len(code):
                continue
            # a document's terms first, then those of its group: counts are added, documents counted
            own, n = np.unique(row.astype(np.int64) * len(terms) + code, return_counts=True)
            key, at = np.unique(group[first + own // len(terms)] * len(terms) + own % len(terms), return_inverse=True)
            yield named(key // len(terms), terms.take(pa.array(key % len(terms))), np.bincount(at, weights=n), np.bincount(at))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term, with term null and all rows for every group."""
    small_batches(docs.sparkSession)
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return read.mapInArrow(_counted, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + terms)), exact beyond 64 bits on the way."""
    wide = lambda c, d=20: c.cast(f"decimal({d},0)")
    return 1 + F.call_function("div", wide(n + 1) * wide(F.lit(UNIT), 10), wide(total + terms))


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, terms: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (text, lang, source).

    Null text, lang or source reads as ''; every row is a document, also one that repeats another. A language keeps the
    terms in at least least_docs of its documents. A share p is 1 + floor(10^9 (n + 1) / (N + V)): n of the N occurrences
    of V kept terms. Part 'pair': item is each other source of the language, value the sum over all kept terms of
    floor((p - q)^2 / q), q the item's shares; 0 without kept terms. Part 'term': item is each kept term that the source
    has with p above q, the language's share, its first `terms` ones. Ranks go by value, then by the item's bytes. A source
    without terms has pairs, a language of one source has none. Other columns are not looked at. No rows in, no rows out.
    """
    counts = written(term_counts(docs), "counts")
    known = counts.filter("term is not null")
    kept = written(known.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).select("lang", "term", "all"), "kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("n_lang"))
    own = written(known.select("lang", "source", "term", "n").join(sized(kept), ["lang", "term"]), "own")
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = counts.filter("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", zero("total"), zero("v"), zero("n_lang"))
    groups = written(groups.withColumn("none", F.when(F.col("v") > 0, _share(F.lit(0), F.col("total"), F.col("v"))).otherwise(1)), "groups")
    shares = own.join(sized(groups), ["lang", "source"]).withColumns({"p": _share(F.col("n"), F.col("total"), F.col("v")), "q": _share(F.col("all"), F.col("n_lang"), F.col("v"))})
    shares = written(shares.select("lang", "source", "term", "p", "q", "none"), "shares")

    above = written(shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value")), "above")
    top = first_ranked(above, ["lang", "source"], terms)

    c, wide = F.col, lambda x: x.cast("decimal(38,0)")
    other = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("other"))
    base = _apart(c("none"), c("other"))
    part = lambda df, value: df.select("lang", "source", "item", wide(value).alias("value"))
    # where neither has a term, for all terms; then what either's counts change, by how many terms have them
    pairs = groups.join(sized(other), "lang").filter("source <> item")
    bins = written(shares.groupBy("lang", "source", "p", "none").agg(F.count("*").alias("m")), "bins")
    times = lambda m, x: m.cast("decimal(19,0)") * x.cast("decimal(19,0)")
    mine = bins.join(sized(other), "lang").filter("source <> item")
    theirs = bins.select("lang", F.col("source").alias("item"), F.col("p").alias("q"), "m", F.col("none").alias("other")).join(sized(groups.select("lang", "source", "none")), "lang").filter("source <> item")
    both = shares.select("lang", "term", "source", "p", "none").join(shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("none").alias("other")), ["lang", "term"]).filter("source <> item")
    value = part(pairs, times(c("v"), base)).unionAll(part(mine, times(c("m"), _apart(c("p"), c("other")) - base)))
    value = value.unionAll(part(theirs, times(c("m"), _apart(c("none"), c("q")) - base)))
    value = value.unionAll(part(both, _apart(c("p"), c("q")) - _apart(c("p"), c("other")) - _apart(c("none"), c("q")) + base))
    pair = value.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    # as many rows a group as the language has other sources, all of which are asked for
    pair = pair.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())))
    out = lambda name, df: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return out("pair", pair).unionAll(out("term", top))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


#: Every share of every group and kept term is written out, and every pair of groups compared on all of them.
OP13_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), occurrences AS (
  SELECT d, lang, source, unnest(terms) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS c FROM occurrences GROUP BY lang, term HAVING count(DISTINCT d) >= {LEAST_DOCS}
), sources AS (
  SELECT DISTINCT lang, source FROM docs
), grid AS (
  SELECT s.lang, s.source, k.term, k.c, coalesce(o.c, 0) AS n FROM sources s JOIN kept k ON k.lang = s.lang
  LEFT JOIN (SELECT lang, source, term, count(*) AS c FROM occurrences GROUP BY ALL) o ON o.lang = s.lang AND o.source = s.source AND o.term = k.term
), shares AS (
  SELECT lang, source, term, n, 1 + ({UNIT}::HUGEINT * (n + 1)) // (sum(n) OVER own + count(*) OVER own) AS p, 1 + ({UNIT}::HUGEINT * (c + 1)) // (sum(c) OVER own + count(*) OVER own) AS q
  FROM grid WINDOW own AS (PARTITION BY lang, source)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows) WHERE part = 'pair' OR rank <= {TERMS}
"""
