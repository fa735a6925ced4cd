"""Main text of web pages by templates deduced from all pages of one layout.

Pages with the same set of paths of sections (body, div, main, ...) have one layout. Those of one layout on one host share
a template; where they are too few, those of that layout on all hosts do, and where these are too few too, all of the host.
Tokens are tags and runs of text, told apart by the path of containers they stand in. Those with equal occurrence
vectors over those pages form an equivalence class; vectors are compared by a hash that is gathered in Spark, so
every page counts and none is brought together with others. Classes that are large and frequent are valid, and their
elements nest by their paths into the template. The slots between them hold what varies: the template is followed
from its root into the element that holds most of the varying text, as long as no varying heading is left outside. What
stands in that element's slots is the article; runs of text that belong to the template are dropped. Names of elements
and classes (navigation, comments) tell what to leave out inside the slots, and serve alone where there is no template.
"""

from __future__ import annotations

import html as entities
import json
import re
import struct
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.shared import sized, small_batches, written
from lattica.llm.url_filter import host_and_path

#: A valid class has so many tokens, on so many different pages, which are so large a share of those that are to share a
#: template; a run of text must be on a larger share of them.
LEAST_TOKENS, LEAST_PAGES, SHARE, TEXT_SHARE = 3, 5, 0.5, 0.8
#: The template is followed into an element that holds more than this share of the varying text.
MOST = 0.5
HEADINGS = frozenset(("h1", "h2"))
#: Containers that a path names, from the outermost; what stands deeper belongs to the last of them.
DEPTH = 24
#: Templates up to so many bytes in all are broadcast; beyond that they are joined by host.
BROADCAST_BYTES = 32_000_000
#: Parts of a group's pages that meet its template apart where templates are more than that.
SALTS = 64

#: Possessive, so that broken markup takes no more time than sound one; a tag has no < outside of quotes.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+>?|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>]*+)(?P<attrs>(?>[^<>"']+|"[^"]*"|'[^']*'|["'])*+)>""", re.S)
#: Sections, whose paths are a page's layout, and what may hold text that looks like one.
_SECTION = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|template|noscript|svg)\b.*?(?:</\1\s*>|\Z)|<(?P<end>/?)(?P<tag>body|div|section|main|article|nav|header|footer|aside|form)\b(?P<attrs>[^<>]*+)>", re.S | re.I)
_HINT = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
#: Elements whose content is no text.
RAW = frozenset(("script", "style", "noscript", "template", "iframe", "object", "svg", "math", "textarea", "title", "head", "canvas", "xmp", "noframes", "noembed"))
#: Of these, those in which a tag is no tag.
OPAQUE = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noframes", "noembed"))
#: Elements that are not part of an article.
BESIDE = frozenset(("nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "fieldset"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
#: Elements inside a block; all others part blocks.
INLINE = frozenset(("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"))
#: Words of class, id or role that mark what is not part of an article, and words that may stand beside one in a compound.
BESIDE_WORDS = frozenset(("ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "promotion", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"))
PLAIN_WORDS = frozenset(("area", "articles", "bar", "block", "body", "bottom", "box", "button", "buttons", "container", "content", "field", "form", "global", "group", "header", "icons", "inner", "item", "items", "left", "links", "list", "main", "media", "message", "page", "panel", "post", "posts", "primary", "right", "section", "secondary", "site", "slot", "text", "thread", "title", "top", "wrap", "wrapper"))
_WORDS = re.compile(r"[a-z]+")
MAIN = ("article", "main")


def _says_beside(names: str) -> bool:
    """Whether one of some names (of class, id or role) says that an element is not part of an article.

    A compound does only if all its other words are plain: related-posts, but not related-work.
    """
    for name in names.lower().split():
        words = _WORDS.findall(name)
        if any(w in BESIDE_WORDS for w in words) and all(w in BESIDE_WORDS or w in PLAIN_WORDS for w in words):
            return True
    return False


class _Block:
    __slots__ = ("beside", "main", "path", "text")

    def __init__(self, path: str, main: bool, beside: bool, text: str):
        self.path, self.main, self.beside, self.text = path, main, beside, text


def parsed(page: str, tags: list[tuple[str, str]] | None = None, names: bool = True) -> list[_Block]:
    """Blocks of text in page order, but for what is never text; tags gets (path, tag) of every tag.

    A path names the containers that are open, with the first word of their class. beside tells whether names of
    elements or classes say that a block is not part of an article; without names they are not asked.
    """
    stack: list[tuple[str, int, bool, str]] = []  # element, whether it is beside (1) or no text (2), whether it is a container, path
    blocks: list[_Block] = []
    parts: tuple[list[str], list[str]] = ([], [])
    open_: Counter[str] = Counter()
    away = [0, 0, 0]
    main = depth = at = 0

    def put(text: str) -> None:
        if not away[2]:
            parts[away[1] > 0].append(text)

    def close() -> None:
        for beside in (False, True):
            if parts[beside]:
                text = _SPACE.sub(" ", entities.unescape("".join(parts[beside]))).strip()
                if text:
                    blocks.append(_Block(stack[-1][3] if stack else "", main > 0, beside, text))
                parts[beside].clear()

    def remove(k: int) -> None:
        nonlocal main, depth
        tag, kind, container, _ = stack.pop(k)
        open_[tag] -= 1
        away[kind] -= 1
        depth -= container
        main -= tag in MAIN

    def end_inline(tag: str) -> None:
        """Ends the innermost such element unless a container stands in it."""
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == tag:
                remove(k)
                break
            if stack[k][0] not in INLINE:
                break

    raw = None
    for m in _TOKEN.finditer(page):
        if raw is not None:
            if not (m["end"] and m["tag"].lower() == raw):
                continue
            raw, at = None, m.start()
        if at < m.start():
            put(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            put(m["cdata"])
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if tag == "br":
            put("\n")
        elif tag not in INLINE:
            close()
        path = stack[-1][3] if stack else ""
        if m["end"]:
            if tags is not None:
                tags.append((path, "</" + tag))
            if open_[tag]:
                # what stands open inside ends too; an inline element's end ends only what is inline inside it
                if tag in INLINE:
                    end_inline(tag)
                else:
                    while stack[-1][0] != tag:
                        remove(len(stack) - 1)
                    remove(len(stack) - 1)
            continue
        hints = [a[1] or a[2] or a[3] or "" for a in _HINT.finditer(m["attrs"])] if m["attrs"] else []
        label = tag
        if hints and (first := _WORDS.search(hints[0].lower())):
            label = f"{tag}.{first[0]}"
        if tags is not None:
            tags.append((path, "<" + label))
        if tag in VOID or m["attrs"].endswith("/"):
            continue
        if tag in MAIN and away[1]:
            # an article begins: what stands open and beside, by its class only, was never closed
            for k, (x, kind, c, own) in enumerate(stack):
                if kind == 1 and x not in BESIDE:
                    stack[k] = (x, 0, c, own)
                    away[0], away[1] = away[0] + 1, away[1] - 1
        if tag == "body":
            while stack and open_["head"]:
                remove(len(stack) - 1)
        kind = 2 if tag in RAW else int(names and (tag in BESIDE or (tag not in ("html", "body") and tag not in MAIN and any(map(_says_beside, hints)))))
        if tag == "p" and open_["p"]:  # a paragraph cannot stand in another
            end_inline("p")
        container = tag not in INLINE and tag != "p" and depth < DEPTH
        path = stack[-1][3] if stack else ""
        stack.append((tag, kind, container, f"{path}/{label}" if container else path))
        open_[tag] += 1
        away[kind] += 1
        depth += container
        main += tag in MAIN
        if tag in OPAQUE:
            raw = tag
    if raw is None and at < len(page):
        put(page[at:])
    close()
    return blocks


def _hash(*parts: bytes) -> int:
    """A signed 64-bit hash."""
    return struct.unpack("<q", xxhash.xxh64_digest(b"\0".join(parts)))[0]


def _run_hash(b: _Block) -> int:
    return _hash(b.path.encode(), b.text.encode())


def layout_of(page: str) -> str:
    """A hash of the set of paths that a page's sections have, each named as in parsed(), to any depth."""
    stack: list[tuple[str, int]] = []
    open_: Counter[str] = Counter()
    seen: set[int] = set()
    for m in _SECTION.finditer(page):
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            while open_[tag]:
                last = stack.pop()[0]
                open_[last] -= 1
                if last == tag:
                    break
            continue
        label = tag
        if (hint := _HINT.search(m["attrs"])) and (first := _WORDS.search((hint[1] or hint[2] or hint[3] or "").lower())):
            label = f"{tag}.{first[0]}"
        path = _hash(struct.pack("<q", stack[-1][1] if stack else 0), label.encode())
        seen.add(path)
        if not m["attrs"].endswith("/"):
            stack.append((tag, path))
            open_[tag] += 1
    return f"{_hash(struct.pack(f'<{len(seen)}q', *sorted(seen))) & (1 << 64) - 1:016x}"


@F.pandas_udf(T.StringType())
def _layouts(pages: pd.Series) -> pd.Series:
    return pages.map(lambda x: layout_of(x or ""))


def tokens(pages: DataFrame, by: tuple[str, ...] = ("host",)) -> DataFrame:
    """(*by, path, tag, run, n, vector, times, chars) of each token of pages (*by, key, html) with equal texts in the columns `by`.

    tag is null for a run of text, which its hash tells. n pages have the token, times times in all; vector is equal for
    tokens that occur equally often on the same pages. chars is a run's length on all pages.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, list] = {}
            for *own, key, page in zip(*(batch.column(c).to_pylist() for c in (*by, "key", "html")), strict=True):
                tags: list[tuple[str, str]] = []
                runs = Counter()
                chars = {}
                for b in parsed(page or "", tags, names=False):
                    k = (*own, b.path, None, _run_hash(b))
                    runs[k] += 1
                    chars[k] = len(b.text)
                runs.update((*own, path, tag, 0) for path, tag in tags)
                marks = {t: _hash(struct.pack("<qq", key, t)) for t in set(runs.values())}
                for k, t in runs.items():
                    row = found.setdefault(k, [0, 0, 0, 0])
                    row[0] += 1
                    row[1] ^= marks[t]
                    row[2] += t
                    row[3] += t * chars.get(k, 0)
            if found:
                kinds = [pa.string()] * (len(by) + 2) + [pa.int64()] * 5
                columns = [*zip(*found, strict=True), *zip(*found.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*by, "path", "tag", "run", "n", "vector", "times", "chars"])

    names = "".join(f"`{c}` string, " for c in by)
    rows = pages.select(*by, "key", "html").mapInArrow(count, names + "path string, tag string, run long, n long, vector long, times long, chars long")
    return _summed(rows, *by)


def _summed(rows: DataFrame, *by: str) -> DataFrame:
    """Tokens of several sets of pages taken together: a vector over all of them is the sum of theirs."""
    return rows.groupBy(*by, "path", "tag", "run").agg(F.sum("n").alias("n"), F.bit_xor("vector").alias("vector"), F.sum("times").alias("times"), F.sum("chars").alias("chars"))


def valid_classes(rows: pd.DataFrame) -> list[pd.DataFrame]:
    """Tokens of one group of pages in classes of equal occurrence vectors, those with LEAST_TOKENS tokens."""
    return [c for _, c in rows.groupby(["n", "vector"]) if len(c) >= LEAST_TOKENS]


def nested(elements: list[str]) -> dict[str, list[str]]:
    """The children of each of some elements, given by their paths, and of the root (empty)."""
    known, out = set(elements), {x: [] for x in ("", *elements)}
    for x in sorted(known):
        up = x.rpartition("/")[0]
        while up and up not in known:
            up = up.rpartition("/")[0]
        out[up].append(x)
    return out


def article_of(elements: dict[str, int], total: int) -> str:
    """The element that holds the article, from the varying text in each element of the template and in all; empty for the root."""
    below, at, mass = nested(list(elements)), "", total
    while below[at]:
        child = max(below[at], key=lambda x: elements[x])
        inside = lambda x, of: x == of or x.startswith(of + "/")
        titled = any(m and inside(x, at) and not inside(x, child) and x.rpartition("/")[2].partition(".")[0] in HEADINGS for x, m in elements.items())
        if titled or elements[child] <= MOST * mass:
            break
        at, mass = child, elements[child]
    return at


def groups(counts: DataFrame) -> DataFrame:
    """(host, layout, choice, group, total, mirrors) of the groups of pages whose tokens a host's pages of one layout add to.

    counts has (host, layout, pages, own): how many different pages, and how many of them that no earlier host has too. A
    group of choice 1 is the host's pages of the layout, 2 all hosts' pages of it (mirrors is false: a page of several
    hosts counts once), 3 all of the host's. total is a group's number of pages; 2 and 3 are made only where too few pages
    make 1, and 3 only where too few make 2.
    """
    pools = counts.groupBy("layout").agg(F.sum("own").alias("pool"), F.min("pages").alias("least"))
    base = written(counts.join(sized(written(pools, "pools")), "layout").withColumn("lone", (F.col("pages") < LEAST_PAGES) & (F.col("pool") < LEAST_PAGES)), "layouts")
    hosts = base.groupBy("host").agg(F.sum("pages").alias("all"), F.bool_or("lone").alias("any_lone")).filter(F.col("any_lone") & (F.col("all") >= LEAST_PAGES))
    base = base.join(sized(written(hosts, "hosts")), "host", "left")
    group = lambda when, choice, name, total, mirrors: F.when(when, F.struct(F.lit(choice).alias("choice"), name.alias("group"), F.col(total).alias("total"), F.lit(mirrors).alias("mirrors")))
    key = lambda *parts: F.to_json(F.array(*parts))
    made = F.array_compact(
        F.array(
            group(F.col("pages") >= LEAST_PAGES, 1, key("host", "layout"), "pages", True),
            group((F.col("least") < LEAST_PAGES) & (F.col("pool") >= LEAST_PAGES), 2, key(F.lit(""), "layout", F.lit("")), "pool", False),
            group(F.col("all").isNotNull(), 3, key("host"), "all", True),
        )
    )
    return written(base.select("host", "layout", F.inline(made)), "groups")


def templates(pages: DataFrame) -> DataFrame:
    """(group, template as JSON) of pages (host, page_id, html)."""
    return templates_of_layouts(pages.withColumn("layout", _layouts("html")))[1]


def templates_of_layouts(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, layout, group) and (group, template as JSON) from pages (host, layout, page_id, html).

    Equal pages of a host count once. Each host's pages of a layout get the first of their groups that has a template, if any.
    """
    keyed = pages.select("host", "layout", "page_id", "html", F.xxhash64("html").alias("key"))
    firsts = keyed.groupBy("host", "layout", "key").agg(F.min("page_id").alias("first"), F.count("*").alias("c"))
    firsts = written(firsts, "firsts")
    again = written(firsts.filter("c > 1").select("host", "key", "first"), "again")
    owners = firsts.groupBy("key").agg(F.min("host").alias("owner"), F.count("*").alias("hosts")).filter("hosts > 1").drop("hosts")
    owners = written(owners, "owners")
    mirror = F.coalesce(F.col("owner") != F.col("host"), F.lit(False))
    once = keyed.join(sized(again), ["host", "key"], "left").filter("first is null or page_id = first")
    once = once.join(sized(owners), "key", "left").withColumn("mirror", mirror.cast("string"))
    counts = firsts.join(sized(owners), "key", "left").groupBy("host", "layout").agg(F.count("*").alias("pages"), F.count_if(~mirror).alias("own"))
    of = groups(written(counts, "counts"))
    found = written(tokens(once, ("host", "layout", "mirror")), "tokens")
    found = found.join(sized(of), ["host", "layout"]).filter("mirrors or mirror = 'false'")
    found = written(_summed(found, "group", "total"), "summed")
    share = F.when(F.col("tag").isNull(), F.lit(TEXT_SHARE)).otherwise(F.lit(SHARE))
    common = (F.col("n") >= LEAST_PAGES) & (F.col("n") >= share * F.col("total"))
    found = found.withColumn("common", common)
    frequent = written(found.filter("common"), "frequent")
    # varying text by the frequent elements that it stands in; the root is the empty path
    opened = frequent.filter("tag like '<%' and tag not like '</%'").select("group", F.concat("path", F.lit("/"), F.expr("substring(tag, 2)")).alias("element"))
    opened = opened.unionAll(frequent.select("group", F.lit("").alias("element")).distinct())
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    varying = found.filter("tag is null and not common").groupBy("group", "path").agg(F.sum("chars").alias("chars"))
    varying = varying.select("group", F.explode(F.array_distinct(above)).alias("element"), "chars")
    mass = varying.join(opened, ["group", "element"]).groupBy("group", "element").agg(F.sum("chars").alias("chars"))
    rows = frequent.select("group", "path", "tag", "run", "n", "vector", "times", F.lit(0).cast("long").alias("mass"))
    rows = rows.unionAll(mass.select("group", "element", F.lit("mass"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), "chars"))

    def deduce(group: pd.DataFrame) -> pd.DataFrame:
        held = group[group.tag == "mass"].set_index("path").mass.to_dict()
        classes = valid_classes(group[group.tag != "mass"])
        elements, fixed = {}, []
        for c in classes:
            once = c[(c.times == c.n) & c.tag.notna()]
            opens = once[once.tag.str.startswith("<") & ~once.tag.str.startswith("</")]
            elements |= {x: held.get(x, 0) for x in opens.path + "/" + opens.tag.str[1:]}
            fixed += c[c.tag.isna()].run.tolist()
        out = json.dumps({"article": article_of(elements, held.get("", 0)), "fixed": sorted(fixed)}) if elements else None
        return pd.DataFrame({"group": [group.group.iloc[0]], "template": [out]})

    deduced = rows.groupBy("group").applyInPandas(deduce, "group string, template string").filter("template is not null")
    deduced = written(deduced, "templates")
    chosen = of.join(sized(written(deduced.select("group"), "deduced")), "group").groupBy("host", "layout").agg(F.min_by("group", "choice").alias("group"))
    return written(chosen, "chosen"), deduced


def main_text(page: str, template: dict | None, names: bool = True) -> str:
    """The blocks of the article joined by a space."""
    blocks = [b for b in parsed(page, names=names) if not b.beside]
    own = []
    if template:
        at = template["article"]
        own = [b for b in blocks if b.path == at or b.path.startswith(at + "/")]
        fixed = template["fixed"]
        own = [b for b in own if _run_hash(b) not in fixed] if fixed else own
    if not own:  # no template, or not its page: names alone
        own = [b for b in blocks if b.main] or blocks
    return " ".join(b.text for b in own)


def extracted(pages: DataFrame, names: bool = True) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html).

    A null or empty html has an empty text. Urls that are null or have no host count as one host. Rows that repeat or
    lack a page_id each give a row; rows without a page_id whose html repeats say nothing about the template; other
    columns are ignored. A page that has no LEAST_PAGES different ones of its layout anywhere, nor on its host, has no
    template: there, and on pages without the template's article, only elements and their names tell what is beside the
    article; without names everything stays.
    """
    small_batches(pages.sparkSession)
    table = host_and_path(pages.select("page_id", "url", "html")).drop("path").withColumn("layout", _layouts("html"))
    chosen, found = templates_of_layouts(table)
    table = table.join(sized(chosen), ["host", "layout"], "left")
    size = found.agg(F.sum(F.octet_length("template") + F.octet_length("group"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        table = table.join(F.broadcast(found), "group", "left")
    else:  # pages of one group are many: each of SALTS parts of them meets a copy of its template
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        table = table.withColumn("salt", F.pmod(F.xxhash64("url", "html"), F.lit(SALTS)).cast("int")).join(salted, ["group", "salt"], "left")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = []
                for page, template in zip(part.column("html").to_pylist(), part.column("template").to_pylist(), strict=True):
                    if template and template not in known:
                        if len(known) > 256:
                            known.clear()
                        known[template] = json.loads(template)
                        known[template]["fixed"] = frozenset(known[template]["fixed"])
                    texts.append(main_text(page or "", known.get(template), names))
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    return table.select("page_id", "url", "html", "template").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
