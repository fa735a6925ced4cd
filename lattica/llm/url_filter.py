"""URL verdicts from rules and, where none fits, from trust and distrust propagated over the host graph.

Trusted mass flows along links between hosts, distrusted mass against them (who links to blocked hosts is suspect):
personalised PageRank in both directions, started from the hosts whose pages rules allow or block. A host's own start
mass is left out of its score, so that a rule for part of a site does not spread to the rest of it by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
DAMPING = 0.85
#: Propagation ends when what can still arrive anywhere is at most this share of the mass it started from (54 steps at most).
SETTLED = 1e-3
#: A host without a rule is blocked where distrust makes up more than this share of what reached it.
SHARE = 0.5
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def host_and_path(pages: DataFrame) -> DataFrame:
    """pages with host and path of url: empty for a null url or one without ://; A-Z of the host are lower-cased."""
    rest = F.coalesce(F.expr("CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) END"), F.lit(""))
    return pages.withColumn("host", F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)).withColumn(
        "path", F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    )


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """hosts (host) with rules: an array of (size, rule, path, verdict) of the rules (host, path, verdict) for it or a domain above it."""
    labels = hosts.select("host", F.split("host", r"\.").alias("l"))
    above = labels.select("host", F.explode(F.expr("transform(sequence(1, size(l)), i -> array_join(slice(l, i, size(l)), '.'))")).alias("domain"))
    known = rules.select(F.col("host").alias("domain"), F.struct((F.length("host") + F.length("path")).alias("size"), F.concat("host", "path").alias("rule"), "path", "verdict").alias("r"))
    fit = above.join(known, "domain").groupBy("host").agg(F.sort_array(F.collect_list("r"), asc=False).alias("rules"))
    return hosts.join(fit, "host", "left")


def propagated(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(host, trust, distrust) that reaches hosts over distinct edges (src, dst) from seeds (host, trust, distrust), without a host's own start."""
    out = edges.groupBy("src").agg(F.count("*").alias("n"))
    into = edges.groupBy("dst").agg(F.count("*").alias("n"))
    steps = written(
        edges.join(out, "src")
        .select(F.lit("trust").alias("kind"), "src", "dst", (1 / F.col("n")).alias("w"))
        .unionAll(edges.join(into, "dst").select(F.lit("distrust"), F.col("dst"), F.col("src"), 1 / F.col("n"))),
        "steps",
    )
    start = seeds.select("host", F.expr("stack(2, 'trust', trust, 'distrust', distrust) AS (kind, mass)")).filter("mass > 0").select("kind", "host", "mass")
    start = written(start, "start")
    total = start.agg(F.sum("mass")).first()[0] or 0.0
    reached, new, left = start.filter("false"), start, 0.0 if steps.isEmpty() else total
    while left > SETTLED * total:
        # mass is linear in its start, so only what has just arrived moves on; each step keeps DAMPING of it at most
        moved = steps.join(new.withColumnRenamed("host", "src"), ["kind", "src"])
        new = written(moved.groupBy("kind", F.col("dst").alias("host")).agg((DAMPING * F.sum(F.col("w") * F.col("mass"))).alias("mass")), "arrived")
        reached = reached.unionAll(new)
        left = (new.agg(F.sum("mass")).first()[0] or 0.0) * DAMPING / (1 - DAMPING)
    side = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass"))), F.lit(0.0)).alias(k)
    return reached.groupBy("host").agg(side("trust"), side("distrust"))


def judged(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url, html) by rules (host, path, verdict).

    Of the rules that fit, that with the longest host and path wins (of equal ones the greater); rule is its text.
    Where none fits, rule is null and verdict is the method's: block if more than half of what links brought to the
    host is distrust, else allow, also for hosts that nothing reached and for urls without a host. Null html has no
    links. Rows that repeat or lack a page_id each give a row; other columns are ignored.
    """
    table = host_and_path(pages.select("page_id", "url", "html"))
    hosts = table.select("host").distinct()
    fitting = written(rules_by_host(hosts, rules), "hosts")
    ruled = table.select("page_id", "host", "path").join(fitting, "host", "left")
    ruled = ruled.withColumn("r", F.expr("get(filter(rules, r -> startswith(path, r.path)), 0)"))
    # shares of each host's pages that rules judge are what its propagation starts from
    seeds = ruled.groupBy("host").agg(
        F.avg(F.when(F.col("r.verdict") == "allow", 1.0).otherwise(0.0)).alias("trust"), F.avg(F.when(F.col("r.verdict") == "block", 1.0).otherwise(0.0)).alias("distrust")
    )
    links = table.filter("html is not null and host <> ''").select("host", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("to"))
    far = F.translate(F.regexp_replace("to", r"^[^@]*@|:\d*$", ""), UPPER, LOWER)
    edges = written(links.select(F.col("host").alias("src"), far.alias("dst")).filter("src <> dst and dst <> ''").distinct(), "edges")
    scores = propagated(edges, seeds).select("host", (F.col("distrust") > SHARE * (F.col("trust") + F.col("distrust"))).alias("bad"))
    own = F.when(F.coalesce("bad", F.lit(False)), "block").otherwise("allow")
    out = ruled.join(scores, "host", "left")
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), own).alias("verdict"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


#: The rules alone: what links decide is tested against a plain computation; the given pages link to no other host.
OP2_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(rhost, rpath, rverdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m AS (
  SELECT p.page_id, r.*, row_number() OVER (PARTITION BY p.page_id ORDER BY length(rhost) + length(rpath) DESC) AS k
  FROM p JOIN r ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)
)
SELECT p.page_id, p.host, p.path, m.rhost || m.rpath AS rule, coalesce(m.rverdict, 'allow') AS verdict
FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.k = 1
"""
