"""Near-duplicate lines by a deletion-neighbourhood join, with DataFrame functions only.

A line is a list of words; two are near when one word's insertion, deletion or replacement makes them equal. Each line
emits, hashed, what remains when one word is deleted, with the place of the gap, and itself with a gap at each place.
All lines that share a key are within the bound of each other, so the earliest of a key removes the rest and no pairs
are listed. Only lines that share one half with another emit keys: without that no other line can be near.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.shared import sized, written

#: Lines with fewer words and fewer characters are left alone: equal ones occur by chance. Lines of NEAR_WORDS or more are
#: matched with one word edited.
LEAST_WORDS, LEAST_CHARS, NEAR_WORDS = 4, 40, 10
#: Elements whose hashes are chained in one array.
BLOCK = 32


def normal(text: Column) -> Column:
    """A text in lower case, its words parted by one space or a line's end; tabs, returns, form feeds and vertical tabs are spaces."""
    return F.regexp_replace(F.lower(text), r"[ \t\r\f\x0B]{2,}|[\t\r\f\x0B]", " ")


def _lines(docs: DataFrame, words: int, chars: int) -> DataFrame:
    """(doc_id, th, pos, line, n): every line of so many words or characters, normalised; th tells rows of one doc_id apart."""
    # the text is normalised before it is parted, where it is read once: a filter would repeat what it looks at
    rows = docs.filter("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split(normal(F.col("text")), "\n")).alias("pos", "line"))
    rows = rows.filter(F.octet_length("line") >= min(2 * words - 1, chars)).withColumn("line", F.trim("line"))
    spaces = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit("")))
    return rows.withColumn("n", spaces + 1).filter((F.col("n") >= words) | (F.length("line") >= chars))


def _hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2")]


def _halves(line: Column, n: Column, near_words: int) -> Column:
    """Hashes of the first and the second half of a line as one of n words and as one that has a word more than n - 1.

    Of two lines of c and c or c + 1 words that are near, the first c // 2 words are equal or the last c - c // 2 are.
    """
    out = []
    part = lambda k: F.call_function("substring_index", line, F.lit(" "), k)
    for c in (n, n - 1):
        k = F.floor(c / 2).cast("int")
        out += [F.xxhash64(F.lit("first"), c, part(k)), F.xxhash64(F.lit("last"), c, part(k - c))]
    return F.when(n >= near_words, F.array(*out))


def _prefixes(x: Column, levels: int = 2) -> Column:
    """Hashes of the first 0, 1, ... and of all elements of an array.

    A chain that appends to an array copies it each time. Here only BLOCK elements at a time are chained like that; the
    hashes of whole blocks are prefixes in the same way, two levels up in one chain, and go before those inside a block.
    """
    chain = lambda y: F.aggregate(y, F.array(F.lit(42).cast("long")), lambda acc, z: F.concat(acc, F.array(F.xxhash64(F.element_at(acc, -1), z))))
    if not levels:
        return chain(x)
    once = lambda y, f: F.flatten(F.transform(F.array(y), f))  # noqa: E731  what a lambda names is computed anew for each element
    parted = lambda y: F.transform(F.sequence(F.lit(0), F.floor(F.size(y) / BLOCK).cast("int")), lambda b: chain(F.slice(y, b * BLOCK + 1, F.lit(BLOCK))))

    def joined(b: Column) -> Column:
        # a whole block's own hash is where the next one begins
        before = _prefixes(F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda y: F.element_at(y, -1)), levels - 1)
        return F.flatten(F.zip_with(b, before, lambda y, h: F.transform(F.slice(y, 1, BLOCK), lambda z: F.xxhash64(h, z))))

    return once(once(x, parted), joined)


def _neighbourhood(w: Column) -> Column:
    """Hashes of every variant, of its length, its place and both sides: first without word 1 to n, then with a gap before word 1 to n + 1."""
    n = F.size(w)
    both = F.struct(_prefixes(w).alias("p"), _prefixes(F.reverse(w)).alias("s"))

    def keys(b: Column) -> Column:
        key = lambda size, i, left: F.xxhash64(size, i, F.element_at(b["p"], i), F.element_at(b["s"], left + 1))
        cut = F.transform(F.sequence(F.lit(1), n), lambda i: key(n - 1, i, n - i))
        gap = F.transform(F.sequence(F.lit(1), n + 1), lambda i: key(n, i, n - i + 1))
        return F.concat(cut, gap)

    return F.flatten(F.transform(F.array(both), keys))  # the chains are computed once


def near_classes(docs: DataFrame, classes: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """(h1, h2) of the classes of equal lines to which an earlier line is near but not equal."""
    halves = classes.filter(F.col("halves").isNotNull()).select("h1", "h2", "first", F.explode("halves").alias("g"))
    paired = halves.groupBy("g").agg(F.count("*").alias("c")).filter("c > 1").select("g")
    found = written(halves.join(paired, "g").select("h1", "h2", "first").distinct(), "paired")
    within = written(found.select(F.col("first.doc_id").alias("doc_id")).distinct(), "within")
    own = _lines(docs.select("doc_id", "text").join(sized(within), "doc_id", "left_semi"), near_words, 2 * near_words - 1)
    own = own.filter(F.col("n") >= near_words).select(*_hashes(F.col("line")), F.struct("doc_id", "pos", "th").alias("first"), F.split("line", " ").alias("w"))
    texts = own.join(sized(found), ["h1", "h2", "first"], "left_semi").dropDuplicates(["h1", "h2"])
    texts = written(texts.withColumn("keys", _neighbourhood(F.col("w"))), "texts")
    # most keys stand alone; only those that do not go on with what they belong to
    shared = texts.select(F.explode("keys").alias("k")).groupBy("k").agg(F.count("*").alias("c"))
    shared = written(shared.filter("c > 1").select("k"), "shared")
    keys = texts.select("h1", "h2", "first", F.size("w").alias("n"), F.posexplode("keys").alias("at", "k")).join(sized(shared), "k", "left_semi")
    keys = keys.withColumn("cut", F.col("at") < F.col("n")).withColumn("i", F.when(F.col("cut"), F.col("at") + 1).otherwise(F.col("at") - F.col("n") + 1))
    keys = written(keys.select("k", "h1", "h2", "first", "i", "cut"), "keys")
    lead = keys.groupBy("k").agg(F.min(F.struct("first", "h1", "h2", "cut")).alias("lead"))
    hits = keys.join(lead, "k").filter("first > lead.first")
    hits = hits.select("h1", "h2", "i", "cut", F.col("lead.h1").alias("e1"), F.col("lead.h2").alias("e2"), F.col("lead.cut").alias("ecut")).dropDuplicates(["h1", "h2", "e1", "e2"])
    # the hashes agree; what counts is whether the words do
    left = lambda w, i, cut: F.when(F.col(cut), F.concat(F.slice(w, F.lit(1), F.col(i) - 1), F.slice(w, F.col(i) + 1, F.size(w)))).otherwise(F.col(w))
    sure = hits.join(texts.select("h1", "h2", "w"), ["h1", "h2"]).join(texts.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("w").alias("e")), ["e1", "e2"])
    return sure.filter(left("w", "i", "cut") == left("e", "i", "ecut")).select("h1", "h2").distinct()


def without_repeated_lines(docs: DataFrame, least_words: int = LEAST_WORDS, least_chars: int = LEAST_CHARS, near_words: int = NEAR_WORDS) -> DataFrame:
    """docs (doc_id, text, other columns kept) with lines removed that an earlier line equals or is near to, and n_lines, n_removed.

    Lines are what \\n parts; earlier is the smaller (doc_id, place). A line of fewer than least_words words and fewer
    than least_chars characters is never removed nor removes others, so that lines without spaces count by their length;
    near matches need near_words words (2 or more) on both sides. Lower case and the blanks between words do not matter.
    An earlier line removes later ones also if it is itself removed. Null and empty texts stay as they are (n_lines 0 and
    1); rows without a doc_id keep their text. Equal rows of one doc_id have equal results: their lines are not later
    than each other's.
    """
    for name in ("n_lines", "n_removed"):
        if name in docs.columns:
            docs = docs.drop(name)
    # Lines are read once; from here on they are a place and hashes.
    lines = _lines(docs, least_words, least_chars).select("doc_id", "th", "pos", *_hashes(F.col("line")), _halves(F.col("line"), F.col("n"), near_words).alias("halves"))
    lines = written(lines, "lines")
    grouped = lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "pos", "th")).alias("first"), F.count("*").alias("c"), F.first("halves").alias("halves"))
    classes = written(grouped, "classes")
    near = near_classes(docs, classes, near_words).withColumn("near", F.lit(True))
    repeated = classes.select("h1", "h2", "first", "c").join(near, ["h1", "h2"], "left").filter("c > 1 or near").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    repeated = written(repeated, "repeated")
    gone = lines.select("doc_id", "th", "pos", "h1", "h2").join(sized(repeated), ["h1", "h2"])
    gone = gone.filter("near or doc_id > first.doc_id or (doc_id = first.doc_id and pos > first.pos)")
    gone = written(gone.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("_gone")).withColumnsRenamed({"doc_id": "_doc_id", "th": "_th"}), "gone")
    # a row travels as one structure, so that its columns may have any name
    rows = docs.select("doc_id", "text", F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"))
    texts = rows.join(sized(gone), (F.col("doc_id") == F.col("_doc_id")) & (F.xxhash64("text") == F.col("_th")), "left")
    parts = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_gone"))
    joined = F.transform(F.array(parts), lambda p: F.array_join(F.transform(kept, lambda i: F.get(p, i)), "\n"))[0]  # parted once
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(joined)
    ends = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(ends + 1)
    own = [text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    return texts.select(*own, n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeated_lines(docs).select("doc_id", "text", "n_lines", "n_removed")


#: Variants as strings: what remains of a line without word i, and the line itself with a gap before word i.
OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents
), worded AS (
  SELECT doc_id, pos, string_split_regex(regexp_replace(lower(line), '^[ \t\r\f\x0B]+|[ \t\r\f\x0B]+$', '', 'g'), '[ \t\r\f\x0B]+') AS w FROM lines
), long AS (
  SELECT doc_id, pos, w, len(w) AS n FROM worded WHERE len(w) >= 4 OR length(array_to_string(w, ' ')) >= 40
), classes AS (
  SELECT w, n, min({'d': doc_id, 'p': pos}) AS first FROM long GROUP BY w, n
), keys AS (
  SELECT w, first, n - 1 AS m, i, array_to_string(w[1:i-1], ' ') || '|' || array_to_string(w[i+1:n], ' ') AS k
  FROM (SELECT w, first, n, unnest(range(1, n + 1)) AS i FROM classes WHERE n >= 10)
  UNION ALL
  SELECT w, first, n AS m, i, array_to_string(w[1:i-1], ' ') || '|' || array_to_string(w[i:n], ' ') AS k
  FROM (SELECT w, first, n, unnest(range(1, n + 2)) AS i FROM classes WHERE n >= 10)
), led AS (
  SELECT w, first, min(first) OVER (PARTITION BY m, i, k) AS lead FROM keys
), near AS (
  SELECT DISTINCT w FROM led WHERE lead < first
), gone AS (
  SELECT l.doc_id, l.pos FROM long l JOIN classes c ON l.w = c.w LEFT JOIN near e ON l.w = e.w
  WHERE e.w IS NOT NULL OR {'d': l.doc_id, 'p': l.pos} > c.first
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT removed), '') AS text,
       count(*) AS n_lines, count(*) FILTER (WHERE removed) AS n_removed
FROM (SELECT l.doc_id, l.pos, l.line, g.doc_id IS NOT NULL AS removed FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos)
GROUP BY doc_id
"""
