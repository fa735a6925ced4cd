"""Phrases of words that occur together more often than their parts let expect, from vertical lists of positions.

Texts are cut into blocks. In a block every phrase has the ascending list of the positions where it begins; a list's
length is how often the phrase occurs there, and the lengths' sum over all blocks is its exact frequency. Phrases that
are frequent everywhere are extended by a word: positions moved on by the phrase's length meet the postings of the
words that stand there. Between steps only lengths and numbers are shuffled: lists stay in their block's bucket.

A phrase's number is that of its beginning and that of its last word, spread by a bijection; ranges of these codes are
groups of even size, counted each by itself. A block sends a group the gaps between its codes, which take about two
bytes each, and gets back a bit for each and the places of those that are frequent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.shared import BLANK, END, INSIDE, INVERSE, MULTIPLIER, bucketed, forget, setting, small_batches, sized, text_chunks, tokens, written

#: Least frequency of a phrase, most words in it, ranks reported for a language; bytes of text in a block.
LEAST, LONGEST, RANKS, BLOCK = 100, 5, 2000, 2_000_000
#: Codes that are counted in one group at most.
GROUP = 4_000_000
#: A block's row has a megabyte or more: a task reads few of them at once, however many a bucket has.
_FEW_ROWS = ("spark.sql.parquet.columnarReaderBatchSize", "16")
_LISTS = "blk long, g array<int>, k array<int>, data array<binary>, at binary"
_COUNTED = "g int, blk long, few int, left binary, ranks binary, prefix array<long>, word array<long>, a array<long>"
#: Bytes of a space and tab part words; those of .,;:!? and of line ends part pieces.
_KINDS = np.full(256, INSIDE, np.uint8)
_KINDS[[32, 9]] = BLANK
_KINDS[[*b".,;:!?\n\x0b\x0c\r"]] = END


def _gaps(at: np.ndarray) -> bytes:
    """Positions, list after list, as 32-bit differences."""
    return np.diff(at, prepend=0).astype(np.int32).tobytes()


def _positions(gaps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(gaps, np.int32), dtype=np.int32)


def _cell(values: np.ndarray | pa.Array) -> pa.ListArray:
    """One row that holds all the values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values) if isinstance(values, np.ndarray) else values)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts (lang, text): (blk, lang, words, word, n, at) of each block, one of a language each; words is how many it has.

    Between two pieces a position is left out, so that what follows directly stands in the same piece.
    """
    names = ["blk", "lang", "words", "word", "n", "at"]
    blk = TaskContext.get().partitionId() << 32
    for b in batches:
        for lang in pc.unique(b.column("lang")):
            texts = b.filter(pc.equal(b.column("lang"), lang)).column("text")
            for _, _, data, offsets in text_chunks(texts, BLOCK):
                code, words, _, piece = tokens(data, offsets, _KINDS)
                if not len(code):
                    continue
                place = np.arange(len(code)) + np.cumsum(np.diff(piece, prepend=piece[0]) > 0)
                order = np.argsort(code, kind="stable")
                n = np.bincount(code, minlength=len(words)).astype(np.int32)
                known = [pa.array([blk], pa.int64()), pa.array([lang.as_py()], pa.string()), pa.array([len(code)], pa.int64())]
                yield pa.RecordBatch.from_arrays([*known, _cell(words.cast(pa.string())), _cell(n), pa.array([_gaps(place[order])], pa.binary())], names=names)
                blk += 1


def _ints(batch: pa.RecordBatch, column: str, i: int) -> np.ndarray:
    return batch.column(column)[i].values.to_numpy()


def _kept(n: np.ndarray, at: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and positions of the lists at the places given in ascending order."""
    left = np.zeros(len(n), bool)
    left[places] = True
    return n[places], at[np.repeat(left, n)]


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(blk, id, n, at): a block's postings of frequent words."""
    for b in batches:
        for i in range(b.num_rows):
            n, at = _kept(_ints(b, "n", i), _positions(b.column("at")[i].as_py()), _ints(b, "places", i))
            yield pa.RecordBatch.from_arrays([b.column("blk").slice(i, 1), b.column("ids").slice(i, 1), _cell(n), pa.array([_gaps(at)], pa.binary())], names=["blk", "id", "n", "at"])


def longer(n: np.ndarray, at: np.ndarray, wn: np.ndarray, wat: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, word, n, at) of every phrase of so many words extended by the word that follows, from the lists of both.

    Positions are dense, so the lists meet by looking up which word stands at a position: a merge join of all lists at once.
    What stands one position on must begin a phrase of the list too, since a phrase is no more frequent than its last words.
    """
    stands = np.full(max(at.max(initial=0), wat.max(initial=0)) + length + 1, -1, np.int32)
    stands[wat] = np.repeat(np.arange(len(wn), dtype=np.int32), wn)
    begins = np.zeros(len(stands) + 1, bool)
    begins[at] = True
    word = stands[at + length]
    found = (word >= 0) & begins[at + 1]
    code = np.repeat(np.arange(len(n)), n)[found] * max(1, len(wn)) + word[found]
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    return code[first] // max(1, len(wn)), code[first] % max(1, len(wn)), np.diff(np.append(first, len(code))).astype(np.int32), at[found][order]


def _spread(code: np.ndarray, bits: int, back: bool = False) -> np.ndarray:
    """A bijection of numbers of so many bits that deals them out evenly; with back, the other way."""
    by, mask = INVERSE if back else MULTIPLIER, np.uint64((1 << bits) - 1)
    code = code.astype(np.uint64) * by & mask
    return (code ^ code >> np.uint64((bits + 1) // 2)) * by & mask


def _packed(*columns: np.ndarray) -> bytes:
    """Integers of one length, bytes of one place side by side, compressed."""
    return pa.compress(pa.py_buffer(b"".join(c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)), codec="zstd", asbytes=True)


def _unpacked(data: bytes, k: int, *types: type) -> list[np.ndarray]:
    wide = [np.dtype(t).itemsize for t in types]
    planes = np.frombuffer(pa.decompress(data, decompressed_size=k * sum(wide), codec="zstd"), np.uint8)
    parts = np.split(planes, k * np.cumsum(wide)[:-1])
    return [np.ascontiguousarray(x.reshape(w, k).T).view(t).ravel() for x, w, t in zip(parts, wide, types, strict=True)]


class Codes(NamedTuple):
    """How phrases of one length are numbered: (number of the phrase without its last word) * words + number of that word,
    spread over so many bits; groups of them are ranges of what comes out."""

    words: int
    bits: int
    groups: int

    def of(self, prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
        return _spread(prefix * self.words + word, self.bits)

    def parts(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        plain = _spread(code, self.bits, back=True).astype(np.int64)
        return plain // self.words, plain % self.words

    def group(self, code: np.ndarray) -> np.ndarray:
        kept = min(self.bits, 32)
        return ((code >> np.uint64(self.bits - kept)) * np.uint64(self.groups) >> np.uint64(kept)).astype(np.int32)


def _lists(blk: pa.Array, ids: np.ndarray, n: np.ndarray, at: np.ndarray, wids: np.ndarray, wn: np.ndarray, wat: np.ndarray, length: int, codes: Codes) -> Iterator[pa.RecordBatch]:
    """(blk, g, k, data, at): a block's lists of phrases one word longer than length, by code: of each group how many, and codes and lengths packed."""
    p, w, n, at = longer(n, at, wn, wat, length)
    if not len(n):
        return
    code = codes.of(ids[p], wids[w])
    order = np.argsort(code)
    starts = (np.cumsum(n) - n)[order]
    code, n = code[order], n[order]
    at = at[np.arange(len(at)) + np.repeat(starts - (np.cumsum(n) - n), n)]
    group = codes.group(code)
    first = np.flatnonzero(np.diff(group, prepend=-1))
    k = np.diff(np.append(first, len(code))).astype(np.int32)
    data = [_packed(np.diff(code[i : i + c], prepend=np.uint64(0)), n[i : i + c]) for i, c in zip(first, k, strict=True)]
    yield pa.RecordBatch.from_arrays([blk, _cell(group[first]), _cell(k), _cell(pa.array(data, pa.binary())), pa.array([_gaps(at)], pa.binary())], names=["blk", "g", "k", "data", "at"])


def _pairs(batches: Iterator[pa.RecordBatch], codes: Codes) -> Iterator[pa.RecordBatch]:
    """As _lists(): a block's pairs of frequent words."""
    for b in batches:
        for i in range(b.num_rows):
            ids, n, at = _ints(b, "wids", i), _ints(b, "wn", i), _positions(b.column("wat")[i].as_py())
            yield from _lists(b.column("blk").slice(i, 1), ids, n, at, ids, n, at, 1, codes)


def _extended(batches: Iterator[pa.RecordBatch], length: int, most: int, codes: Codes) -> Iterator[pa.RecordBatch]:
    """As _lists(): a block's phrases of length words that are frequent in all blocks, extended by a word."""
    for b in batches:
        for i in range(b.num_rows):
            known = {x["g"]: x for x in b.column("known")[i].as_py()}
            ids, n, left = [], [], []
            for g, k, data in zip(*(b.column(c)[i].as_py() for c in ("g", "k", "data")), strict=True):
                n.append(_unpacked(data, k, np.uint64, np.int32)[1])
                if x := known.get(g):
                    left.append(np.unpackbits(np.frombuffer(x["left"], np.uint8), count=k).astype(bool))
                    ids.append(g * most + np.cumsum(_unpacked(x["ranks"], x["few"], np.int32)[0], dtype=np.int64))
                else:
                    left.append(np.zeros(k, bool))
            n, at = _kept(np.concatenate(n), _positions(b.column("at")[i].as_py()), np.flatnonzero(np.concatenate(left)))
            yield from _lists(b.column("blk").slice(i, 1), np.concatenate(ids), n, at, _ints(b, "wids", i), _ints(b, "wn", i), _positions(b.column("wat")[i].as_py()), length, codes)


def _counted(codes: Codes, least: int) -> Callable[[tuple[pa.Scalar, ...], pa.Table], pa.Table]:
    def counted(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        """Of a group's codes and lengths in all blocks: one row (g, prefix, word, a) of the frequent phrases, numbered by place, and
        (g, blk, few, left, ranks) of each block that has any: a bit for each of its codes, set if it is frequent, and their places."""
        k = rows.column("k").to_numpy()
        both = [_unpacked(data.as_py(), c, np.uint64, np.int32) for data, c in zip(rows.column("data"), k, strict=True)]
        code, own = np.unique(np.concatenate([np.cumsum(gaps, dtype=np.uint64) for gaps, _ in both]), return_inverse=True)
        # a sum of lengths is no more than all words, far from where doubles are no longer exact
        a = np.bincount(own, np.concatenate([n for _, n in both])).astype(np.int64)
        frequent = a >= least
        rank = np.cumsum(frequent, dtype=np.int32) - np.int32(1)
        back = [(None, None, None, None)]
        for blk, mine in zip(rows.column("blk").to_pylist(), np.split(own, np.cumsum(k)[:-1]), strict=True):
            left = frequent[mine]
            if left.any():
                ranks = np.diff(rank[mine[left]], prepend=np.int32(0))
                back.append((blk, len(ranks), np.packbits(left).tobytes(), _packed(ranks)))
        columns = [pa.array(c, t) for c, t in zip(zip(*back, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)]
        lists = [pa.array([c.tolist()] + [None] * (len(back) - 1), pa.list_(pa.int64())) for c in (*codes.parts(code[frequent]), a[frequent])]
        group = pa.array([key[0].as_py()] * len(back), pa.int32())
        return pa.Table.from_arrays([group, *columns, *lists], names=["g", "blk", "few", "left", "ranks", "prefix", "word", "a"])

    return counted


def _frequent(lists: DataFrame, least: int) -> DataFrame:
    """(lang, word, a, id): words whose lists have at least so many positions in all blocks, numbered almost without gaps."""
    found = lists.select("lang", F.explode(F.arrays_zip("word", "n")).alias("x")).groupBy("lang", "x.word").agg(F.sum("x.n").alias("a")).filter(F.col("a") >= least)
    found = written(found.withColumn("id", F.monotonically_increasing_id()), "frequent")
    # of each partition as many numbers as the largest takes
    place = F.col("id").bitwiseAND((1 << 33) - 1)
    most = found.agg(F.max(place)).first()[0]
    return found.withColumn("id", F.shiftright("id", 33) * ((most or 0) + 1) + place)


def _places(lists: DataFrame, frequent: DataFrame) -> DataFrame:
    """(blk, places, ids): which of a block's lists are of frequent words, and their numbers. One row of a word a block is looked up."""
    own = lists.select("blk", "lang", F.posexplode("word").alias("place", "word"))
    found = own.join(sized(frequent.select("lang", "word", "id")), ["lang", "word"]).groupBy("blk").agg(F.sort_array(F.collect_list(F.struct("place", "id"))).alias("m"))
    return found.select("blk", F.col("m.place").alias("places"), F.col("m.id").alias("ids"))


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, a) of every phrase of 1 to longest words that occurs at least so often, and (lang, n) of all words."""
    spark = docs.sparkSession
    small_batches(spark, size=8_000_000)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    # as many buckets as partitions of a shuffle, so that no side of a join is dealt out anew, or as the input is read in
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), texts.rdd.getNumPartitions())
    lists = bucketed(texts.mapInArrow(_postings, "blk long, lang string, words long, word array<string>, n array<int>, at binary"), "postings", "blk", buckets)
    totals = written(lists.groupBy("lang").agg(F.sum("words").alias("n")), "totals")
    found = _frequent(lists, least)
    words = found.select("id", "lang", F.col("word").alias("phrase"), "a")
    out, named = [words.withColumn("size", F.lit(1))], words
    own = lists.select("blk", "n", "at").join(_places(lists, found).hint("shuffle_hash"), "blk").mapInArrow(_words, "blk long, id array<long>, n array<int>, at binary")
    with setting(spark, *_FEW_ROWS):
        postings = bucketed(own, "words", "blk", buckets)
    forget(lists)
    lists = None
    others = postings.select("blk", F.col("id").alias("wids"), F.col("n").alias("wn"), F.col("at").alias("wat"))
    last, occurring = words.agg(F.max("id"), F.sum("a")).first()
    n_words = n_prefixes = (last or 0) + 1
    for size in range(2, longest + 1):
        # no more codes come to a group than what is extended occurs
        codes = Codes(n_words, max(1, (n_prefixes * n_words - 1).bit_length()), max(buckets, (occurring or 0) // GROUP + 1))
        if lists is None:
            longer_ = others.mapInArrow(partial(_pairs, codes=codes), _LISTS)
        else:
            known = counted.filter("blk is not null").select("blk", F.struct("g", "few", "left", "ranks").alias("x")).repartition(buckets, "blk").groupBy("blk").agg(F.collect_list("x").alias("known"))
            both = lists.join(known.hint("shuffle_hash"), "blk").join(others.hint("shuffle_hash"), "blk")
            longer_ = both.mapInArrow(partial(_extended, length=size - 1, most=most, codes=codes), _LISTS)
        with setting(spark, *_FEW_ROWS):
            longer_ = bucketed(longer_, "lists", "blk", buckets)
        if lists is not None:
            forget(lists, counted)
        lists = longer_
        packed = lists.select("blk", F.explode(F.arrays_zip("g", "k", "data")).alias("x")).select("blk", "x.*")
        counted = written(packed.groupBy("g").applyInArrow(_counted(codes, least), _COUNTED), "counted")
        found = counted.filter("blk is null").select("g", F.posexplode(F.arrays_zip("prefix", "word", "a")).alias("rank", "x")).select("g", "rank", "x.*")
        last, occurring = found.agg(F.max("rank"), F.sum("a")).first()
        most = (last or 0) + 1
        n_prefixes = codes.groups * most
        found = found.withColumn("id", F.col("g").cast("long") * most + F.col("rank"))
        text = found.join(sized(named.select(F.col("id").alias("prefix"), "lang", "phrase")), "prefix").join(sized(words.select(F.col("id").alias("word"), F.col("phrase").alias("last"))), "word")
        named = written(text.select("id", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "a"), "named")
        out.append(named.withColumn("size", F.lit(size)))
        if named.isEmpty():
            break
    forget(postings, lists, counted)
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return written(every.select("lang", "phrase", "size", "a"), "phrases"), totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, ranks: int = RANKS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of docs (text, lang): each language's first phrases by score, frequency and bytes.

    A-Z are lower-cased, other letters are not. A null text has no words, a null lang is 'und', repeated rows count each.
    Phrases do not go over .,;:!? and line ends. a is how often a phrase of 2 to longest words occurs, at least `least`
    times; l and r that of its parts at the cut that gives the lowest score floor(1000 a n / (l r)), of equal ones the
    first; n is all words of the language. Left out is what a longer candidate holds that occurs as often. Other columns
    are not looked at; a table without words gives no rows.
    """
    every, totals = frequent_phrases(docs, least, longest)
    cuts = every.filter("size > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    first = F.call_function("substring_index", F.col("phrase"), F.lit(" "), F.col("k"))
    cuts = cuts.withColumn("first", first).withColumn("rest", F.substring(F.col("phrase"), F.length("first") + 2, F.length("phrase")))
    part = lambda c, f: sized(every).select("lang", F.col("phrase").alias(c), F.col("a").alias(f))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(sized(totals), "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n"), wide("l") * wide("r"))
    cuts = written(cuts.withColumn("score", score), "cuts")
    # what is in a longer phrase as often is in one that is a word longer as often: at its first or its last cut
    held = cuts.filter("size > 2 and k = size - 1 and a >= l").select("lang", F.col("first").alias("phrase"))
    held = written(held.unionAll(cuts.filter("size > 2 and k = 1 and a >= r").select("lang", F.col("rest").alias("phrase"))).distinct(), "held")
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    left = written(best.join(sized(held), ["lang", "phrase"], "left_anti"), "left")
    # first within parts of a language, then among those: neither has all of its phrases
    parts = 1 + int((left.count() / ranks) ** 0.5)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    ranked = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= ranks)
    some = ranked(left.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts))), "lang", "_part")
    return ranked(some.drop("rank", "_part"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang")).withColumn("rank", F.col("rank").cast("long"))


OP12_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, range(1, {LONGEST + 1}) t(k))
), counts AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}
), cuts AS (
  SELECT lang, k, phrase, f, array_to_string(w[1:c], ' ') AS first, array_to_string(w[c + 1:k], ' ') AS rest, c
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS c FROM counts WHERE k > 1)
), scored AS (
  SELECT c.lang, c.phrase, c.f AS a, l.f AS l, r.f AS r, n, 1000::HUGEINT * c.f * n // (l.f::HUGEINT * r.f) AS score, c.c
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = c.first JOIN counts r ON r.lang = c.lang AND r.phrase = c.rest JOIN totals t ON t.lang = c.lang
), least AS (
  SELECT lang, phrase, a, n, min({{'score': score, 'c': c, 'l': l, 'r': r}}) AS cut FROM scored GROUP BY ALL
), held AS (
  SELECT DISTINCT x.lang, x.phrase, x.f FROM (
    SELECT lang, f, array_to_string(w[i:j], ' ') AS phrase FROM (SELECT *, unnest(range(i + 1, k + 1)) AS j FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS i FROM counts WHERE k > 2)) WHERE j - i + 1 < k) x
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY cut.score DESC, a DESC, phrase) AS rank, phrase, a, cut.l AS l, cut.r AS r, n, CAST(cut.score AS BIGINT) AS score
FROM least e WHERE NOT EXISTS (FROM held h WHERE h.lang = e.lang AND h.phrase = e.phrase AND 100 * h.f >= 100 * e.a)
QUALIFY rank <= {RANKS}
"""
