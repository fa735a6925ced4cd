"""HTML extraction, URL verdicts and WARC archives."""

import hashlib
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from lattica.llm import html_extract as H
from lattica.llm import url_filter as U
from lattica.llm import warc as W

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>if(a<b){"</p>"}</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/x">menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div><article><h1>A &amp; B</h1><p>One <b>bo</b>ld
  line<br>two</p><p>T&eacute;st &#39;q&#39;<form><input>search</form><ul><li>i</li><li>j</li></ul><div class="ad">buy</div><!-- <p>gone</p> --></article>
<section id="comments"><p>first!</p></section><aside>side</aside><footer>foot</footer></body></html>"""


def test_main_text():
    assert H.main_text(PAGE, None) == "A & B One bold line two Tést 'q' i j"
    assert H.main_text("", None) == "" and H.main_text("plain  text", None) == "plain text"
    assert H.main_text("<article><p>never closed <b>tags<p>next", None) == "never closed tags next"
    assert H.main_text("<div class=ad>open<article><p>in</p></article>", None) == "in"
    assert H.main_text("<script>x</script><p>a<p>b", None) == "a b"
    assert H.main_text("<p>" * 3000 + "deep", None) == "deep"
    assert H.main_text("<b class=ad>buy</b> now <img alt='<p>'/>a", None) == "now a"


@pytest.mark.parametrize("piece", ["<div>", "<a<", '<a "', "<b><p>", "</div>", "<![CDATA[", "<!--", "<b>", "&", "<a '>\"", "<script>"])
def test_broken_markup_takes_no_long_time(piece):
    began = time.process_time()
    H.parsed(piece * 30_000, [])
    assert time.process_time() - began < 5


def made_pages(rng, n):
    """Pages of one host in which neither elements nor names tell the article, and their articles."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    pages, texts = [], []
    for _ in range(n):
        title, body = " ".join(word() for _ in range(4)), [" ".join(word() for _ in range(30)) for _ in range(rng.randrange(2, 5))]
        texts.append(" ".join([title, *body]))
        links = "".join(f"<li><a>{word()}</a></li>" for _ in range(rng.randrange(3, 6)))
        pages.append(
            f"<html><body><div><p>Welcome to our fine site</p><ul>{links}</ul></div><div class='x'><div class='y'><h1>{title}</h1>" + "".join(f"<p>{b}</p>" for b in body)
            + f"<p>Read all of our terms</p></div><div class='z'><p>{word()} {word()}</p></div></div></body></html>"
        )
    return pages, texts


def test_templates_where_names_say_nothing(spark):
    pages, texts = made_pages(random.Random(0), 30)
    rows = [(i, "http://h.org/", p) for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for names in (True, False):
        assert [r.text for r in H.extracted(df, names).orderBy("page_id").collect()] == texts
    # without a template everything stays; equal pages count once and so make none
    assert all(H.main_text(p, None) != t for p, t in zip(pages, texts, strict=True))
    same = spark.createDataFrame([(i, "http://h.org/", pages[i % 4]) for i in range(30)], "page_id long, url string, html string")
    assert H.templates(U.host_and_path(same)).count() == 0


def test_classes_against_brute_force(spark):
    pages, _ = made_pages(random.Random(1), 12)
    pages[3] = pages[3].replace("</h1>", "")
    vectors = {}
    for i, p in enumerate(pages):
        tags = []
        blocks = H.parsed(p, tags, names=False)
        for k in [*((path, tag, 0) for path, tag in tags), *((b.path, None, H._run_hash(b)) for b in blocks)]:
            vectors.setdefault(k, [0] * len(pages))[i] += 1
    want = {}
    for k, v in vectors.items():
        want.setdefault(tuple(v), set()).add(k)
    rows = spark.createDataFrame([("h", i * 7, p) for i, p in enumerate(pages)], "host string, key long, html string").repartition(5)
    found = H.tokens(rows).toPandas()
    key = lambda c: {(r.path, r.tag if isinstance(r.tag, str) else None, r.run) for r in c.itertuples()}
    got = [key(c) for _, c in found.groupby(["n", "vector"])]
    assert sorted(map(len, got)) == sorted(map(len, want.values())) and all(g in want.values() for g in got)
    assert [key(c) for c in H.valid_classes(found)] and all(len(c) >= 3 for c in H.valid_classes(found))


def test_given_pages_without_their_article_elements(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    hosts = U.host_and_path(df).groupBy("host").count().filter("count >= 8").select("host")
    df = U.host_and_path(df).join(hosts, "host", "left_semi").select("page_id", "url", "html")
    want = {r.page_id: r.text for r in H.extracted(df).collect()}
    plain = df.withColumn("html", F.regexp_replace("html", "(</?)article", "$1div"))
    got = {r.page_id: r.text for r in H.extracted(plain, names=False).collect()}
    html = {r.page_id: r.html for r in plain.collect()}
    # all but broken pages; without the template nearly all pages differ
    assert len(got) > 2000 and sum(got[i] != want[i] for i in want) <= 0.01 * len(want)
    assert sum(H.main_text(html[i] or "", None, names=False) != want[i] for i in want) > 0.9 * len(want)


def test_names_in_compounds():
    assert all(map(H._says_beside, ("comments", "post ad-banner", "related-posts", "Cookie_Notice", "site-nav")))
    assert not any(map(H._says_beside, ("social-science", "search-algorithms", "related-work", "article", "", "adverb")))


def _laid_out(k: int, i: int) -> tuple[str, str]:
    """A page of the k-th layout, none of whose elements and classes say what they are, and its article."""
    rng = random.Random(i)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    title, body, side = text(2), [text(30) for _ in range(3)], text(5)
    article = f"<h1>{title}</h1>" + "".join(f"<p>{b}</p>" for b in body)
    html = (
        f"<div><p>Welcome all</p></div><div class='x'><div class='y'>{article}</div><div class='z'><p>{side}</p></div></div>",
        f"<section><section class='q'>{article}</section></section><section class='r'><p>{side}</p><p>Terms apply</p></section>",
        f"<div class='u'><div><p>Old and new</p></div><section class='v'>{article}</section><div class='w'><p>{side}</p></div></div>",
    )[k]
    return f"<html><body>{html}</body></html>", " ".join((title, *body))


@pytest.mark.parametrize("most", [H.BROADCAST_BYTES, 0])
def test_layouts_of_one_host_and_of_small_ones(spark, monkeypatch, most):
    """Three layouts of a host have a template each; hosts of 1 to 4 pages take that of their layout, wherever it is known."""
    monkeypatch.setattr(H, "BROADCAST_BYTES", most)
    rows, want = [], []
    for i in range(82):
        html, text = _laid_out(i % 3, i)
        rows.append((i, "http://large.org/a" if i < 60 else f"http://small{(i - 60) % 12}.org/a", html))
        want.append(text)
    # mirrors: the same page on forty hosts is one page of its layout, and none of its text becomes template
    rows += [(i, f"http://mirror{i}.org/", rows[0][2]) for i in range(82, 122)]
    want += [want[0]] * 40
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    for names in (True, False):
        assert [r.text for r in H.extracted(df, names).orderBy("page_id").collect()] == want


def test_layout_is_the_set_of_section_paths():
    a = "<body><div class='one 7'><p>x</p><!-- <div> --><script>'<main>'</script></div><div class=one><p>y</p></div></body>"
    assert H.layout_of(a) == H.layout_of(a.replace("<p>y</p>", "<ul><li>z</ul>")) == H.layout_of("<BODY><DIV CLASS=one></DIV>")
    assert len({H.layout_of(x) for x in ("", "<body>", a, "<body><div id=two>", "<div><body>", "<body><div class=one><div class=one>")}) == 6
    assert H.layout_of("</div>" * 9 + a) == H.layout_of(a) and H.layout_of("<div>" * 50_000) != H.layout_of("<div>" * 49_999)
    assert H.layout_of("<div " * 200_000) == H.layout_of("")


def test_groups(spark):
    """Groups by plain loops: of a host's pages of a layout, of all of a layout, of all of a host."""
    rng = random.Random(5)
    rows = [(h, y, n, rng.randint(0, n)) for h in "abcdef" for y in "uvwxyz" if (n := rng.choice([0, 1, 2, 4, 5, 9]))]
    got = {(r.host, r.layout, r.choice): (r.total, r.mirrors) for r in H.groups(spark.createDataFrame(rows, "host string, layout string, pages long, own long")).collect()}
    pool = {y: sum(o for _, x, _, o in rows if x == y) for y in "uvwxyz"}
    small = {y for _, y, n, _ in rows if n < 5}
    lone = {h for h, y, n, _ in rows if n < 5 and pool[y] < 5}
    want = {}
    for h, y, n, _ in rows:
        if n >= 5:
            want[h, y, 1] = (n, True)
        if y in small and pool[y] >= 5:
            want[h, y, 2] = (pool[y], False)
        if h in lone and (total := sum(m for g, _, m, _ in rows if g == h)) >= 5:
            want[h, y, 3] = (total, True)
    assert got == want


def test_extracted(spark):
    rows = [(i, f"http://h{i % 3}.org/{i}", PAGE) for i in range(30)] + [(100, None, PAGE), (101, "nothing", None), (102, "http://a.b/", ""), (None, "http://h1.org", PAGE), (3, "http://h0.org/3", PAGE)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, host int, template string")
    out = H.extracted(df).collect()
    assert len(out) == len(rows)
    assert all(r.text == ("" if r.page_id in (101, 102) else "A & B One bold line two Tést 'q' i j") and r.n_chars == len(r.text) for r in out)
    assert H.extracted(df.filter("false")).count() == 0


@pytest.fixture
def rules(spark):
    return spark.createDataFrame(list(U.RULES), "host string, path string, verdict string")


def test_rules(spark, rules):
    urls = {
        "http://a.example.com/en/1": ("a.example.com", "/en/1", "example.com/en/", "block"), "https://WWW.Example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://x.www.example.com/en/?q": ("x.www.example.com", "/en/", "www.example.com/en/", "allow"), "http://b.com/": ("b.com", "/", "com/", "allow"), "http://b.com": ("b.com", "", None, "allow"),
        "http://com/x": ("com", "/x", "com/", "allow"), "http://telecom/x": ("telecom", "/x", None, "allow"), "ftp://n.net/es/a#b": ("n.net", "/es/a", "net/es/", "block"), "http://n.net/es": ("n.net", "/es", None, "allow"),
        "http://n.net?x=/es/": ("n.net", "", None, "allow"), None: ("", "", None, "allow"), "no scheme/es/": ("", "", None, "allow"), "": ("", "", None, "allow"), "a://b://c/d": ("b:", "//c/d", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, None, "z") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in U.judged(df, rules).collect()}
    for i, want in enumerate(urls.values()):
        assert tuple(got[i])[1:] == want, i
    assert U.judged(df.filter("false"), rules).count() == 0


def test_propagation_against_plain_loops(spark):
    rng = random.Random(2)
    hosts = [f"h{i}" for i in range(30)]
    edges = sorted({(a, b) for a in hosts for b in rng.sample(hosts, 3) if a != b})
    seeds = [(h, rng.choice([0.0, 0.0, 1.0]), rng.choice([0.0, 0.0, 0.5])) for h in hosts]
    got = {r.host: (r.trust, r.distrust) for r in U.propagated(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(seeds, "host string, trust double, distrust double")).collect()}
    for k in (0, 1):
        e = edges if k == 0 else [(b, a) for a, b in edges]
        n = {a: sum(x == a for x, _ in e) for a, _ in e}
        reach = dict.fromkeys(hosts, 0.0)
        for _ in range(200):
            held = {h: reach[h] + next(s[1 + k] for s in seeds if s[0] == h) for h in hosts}
            reach = dict.fromkeys(hosts, 0.0)
            for a, b in e:
                reach[b] += U.DAMPING * held[a] / n[a]
        total = sum(s[1 + k] for s in seeds)
        assert 0 <= sum(reach.values()) - sum(got.get(h, (0, 0))[k] for h in hosts) <= 2 * U.SETTLED * total
        for h in hosts:
            assert got.get(h, (0, 0))[k] == pytest.approx(reach[h], abs=3e-3), h


def test_links_decide_where_no_rule_fits(spark, rules):
    link = lambda *x: "".join(f'<a HREF="https://{h}/p">x</a>' for h in x)
    rows = [(1, "http://farm.org/a", link("bad.net", "bad2.net")), (2, "http://bad.net/es/1", ""), (3, "http://bad2.net/fr/1", ""), (4, "http://good.com/1", link("friend.org")), (5, "http://friend.org/z", None), (6, "http://alone.org/", "")]
    got = {r.page_id: r.verdict for r in U.judged(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow"}


def test_archives(spark, tmp_path):
    big = "é" * 60 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"
    rows = [(5, "http://a/1\r\nX: y", big), (2, None, big), (9, "u", big), (3, "u", "short"), (4, "u", "short"), (7, "u", None), (8, "u", ""), (None, "u", big), (10, "u", "x" * 100), (11, "u", "x" * 99), (12, "u", "x" * 99), (13, "u", "x" * 300_000)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, refers_to string").repartition(3)
    W.write_archives(W.resolve_revisits(df), f"{tmp_path}/w")
    out = W.read_archives(spark, f"{tmp_path}/w", keep_block=True).collect()
    assert len(out) == len(rows)
    got = {r.page_id: r for r in out}
    for i, _, html in rows:
        raw = (html or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        want = ("revisit", 2) if i in (5, 9) else ("response", None)
        assert (r.record_type, r.refers_to) == want and bytes(r.block) == (raw if want[0] == "response" else b"")
    assert got[2].url is None and got[5].url == "http://a/1X: y"
    members = 0
    for f in (tmp_path / "w").glob("part-*"):
        rest = f.read_bytes()
        while rest:
            one = zlib.decompressobj(31)
            text = one.decompress(rest) + one.flush()
            assert one.eof and text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
            rest, members = one.unused_data, members + 1
    assert members == len(rows)
    with pytest.raises(Exception, match="record"):
        (tmp_path / "bad").mkdir()
        (tmp_path / "bad" / "f.txt").write_bytes(b"junk")
        W.read_archives(spark, f"{tmp_path}/bad").collect()
    large = spark.createDataFrame([(1, "u", "abc" * 6_000_000), (2, "u", "y" * 200)], "page_id long, url string, html string")
    W.write_archives(W.resolve_revisits(large).coalesce(1), f"{tmp_path}/large")
    assert {r.page_id: r.payload_bytes for r in W.read_archives(spark, f"{tmp_path}/large").collect()} == {1: 18_000_000, 2: 200}
    W.write_archives(W.resolve_revisits(df.filter("false")), f"{tmp_path}/none")
    assert W.read_archives(spark, f"{tmp_path}/none").count() == 0
