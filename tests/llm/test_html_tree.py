"""The style tree decides: sites of any number of pages, a brute-force tree, and text that must not be lost."""

import math
from collections import defaultdict

import pytest

from varloom.llm import html_extract
from varloom.llm.html_extract import Page

PAGES = "page_id long, url string, html string"


def texts(spark, rows, **kw):
    return {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, PAGES), **kw).collect()}


def site(n, host):
    """A site without names that help: one repeated strip, one unique part."""
    return [(i, f"http://{host}/x", f"<body><div class='t1'>Same boiler text here</div><div class='t2'><p>story {i * 31} of {host}</p><p>tail {i * 17}</p></div></body>") for i in range(n)]


@pytest.mark.parametrize("n", [2, 7, 8, 30])
def test_repeated_strips_go_on_sites_of_any_size(spark, n):
    rows = site(n, "s.example.org")
    on, off = texts(spark, rows), texts(spark, rows, weight=0.0)
    for i in range(n):
        assert on[i] == f"story {i * 31} of s.example.org\ntail {i * 17}"
        assert off[i] == "Same boiler text here\n" + on[i]


def test_one_page_and_copies_give_no_evidence(spark):
    one = site(1, "one.example.org") + [(100 + i, "http://copy.example.org/x", site(1, "copy.example.org")[0][2]) for i in range(9)]
    got = texts(spark, one)
    assert got[0].startswith("Same boiler") and all(got[100 + i].startswith("Same boiler") for i in range(9))


def brute(pages):
    """Texts of the pages of one host, from the definitions."""
    parsed = [Page(h) for h in pages]
    same = [pages.count(h) for h in pages]
    nodes = sorted({b[0] for p in parsed for b in p.blocks})
    own, m_of = {}, {}
    for node in nodes:
        have = [(p, 1 / c) for p, c in zip(parsed, same, strict=True) if any(b[0] == node for b in p.blocks)]
        m = sum(w for _, w in have)
        content, shape = defaultdict(float), defaultdict(float)
        for p, w in have:
            for t in {b[1] for b in p.blocks if b[0] == node}:
                content[t] += w
            shape["|".join(p.children.get(node, ()))] += w
        if m > 1.0001:
            total = sum(content.values())
            c = 1 - sum(v * math.log(max(v, 1)) for v in content.values()) / total / math.log(m)
            ps = sum(shape.values())
            e = -sum(v / ps * math.log(v / ps) for v in shape.values()) / math.log(m)
        else:
            c = e = 1.0
        g = html_extract.GAMMA ** len(shape)
        own[node], m_of[node] = min(max((1 - g) * e + g * c, 0), 1), m
    out = []
    for p in parsed:
        low = {}
        for node in {b[0] for b in p.blocks}:
            best = max(own[x] for x in nodes if x == node or (x.startswith(node + ">") and any({x, node} <= {b[0] for b in q.blocks} for q in parsed)))
            low[html_extract._h(node)] = html_extract.WEIGHT * (best - 0.5) * (1 - 1 / max(m_of[node], 1)) * 1.5
        out.append(p.text({k: v for k, v in low.items() if v < 0}))
    return out


@pytest.mark.parametrize("low_rows", [1000, 0])
def test_against_a_brute_force_tree(spark, low_rows):
    rows = []
    for i in range(14):
        menu = "<ul class=m>" + "".join(f"<li>link {j}</li>" for j in range(4)) + "</ul>"
        extra = f"<div class=x>seen {i % 3}</div>" if i % 2 else ""
        rows.append((i, "http://a.example.org/", f"{menu}{extra}<div class=b>By staff<p>words {i}</p><p>more {i // 2}</p></div><div class=f>Imprint<p>c</p></div>"))
    rows += [(20 + i, "http://a.example.org/", rows[0][2]) for i in range(3)]
    rows += [(40 + i, "http://b.example.org/", f"<table><tr><td>cell {i % 2}<td>same</table><p>text {i}") for i in range(5)]
    got = texts(spark, rows, low_rows=low_rows)
    for host in ("a", "b"):
        mine = [r for r in rows if f"//{host}." in r[1]]
        assert [got[r[0]] for r in mine] == brute([r[2] for r in mine])
    assert got[1] == "By staff\nwords 1\nmore 0" or "seen" in got[1]


def test_the_tree_decides_on_the_tables(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").limit(200).collect()
    for r in rows:
        p = Page(r.html)
        everything = [b[1] for b in p.blocks]
        kept = p.text().split("\n")
        assert len(kept) < len(everything) and set(kept) <= set(everything)


CASES = {
    "math": ("<article><p>Body <math><mi>x</mi>=1</math> of it</p></article>", "Body x=1 of it"),
    "weak names in an article": ('<article><p class="legal">Law</p><p class="popular">Pop</p></article>', "Law\nPop"),
    "names on headings and sections": ('<article><h1 id="search-engines">Search</h1><section id="related-work"><p>Rel</p></section></article>', "Search\nRel"),
    "unclosed options": ("<datalist><option value=a><option value=b></datalist><p>Hello world</p>", "Hello world"),
    "stray option": ("<p>a<option>b<p>c", "a\nc"),
    "title before the article": ("<body><h1>Title</h1><article><p>x</p></article></body>", "Title\nx"),
    "comments in an article": ('<article><p>x</p><div class="comments"><p>nice</p></div><section id="comments">c</section></article>', "x"),
    "teasers in an aside": ("<article><p>a</p><aside><article><p>teaser</p></article></aside></article>", "a"),
    "forms": ("<div><p>a</p><form><label>q</label><textarea>z</textarea></form><p>b <button>go</button> c</p></div>", "a\nb c"),
    "textarea and object": ("<article><p>a <textarea>code</textarea> <object>alt</object> b</p></article>", "a code alt b"),
    "unclosed head": ("<html><head><title>x</title><p>Hello", "Hello"),
    "unclosed script": ("<p>a</p><script>var x", "a"),
    "unclosed comment": ("<p>a</p><!-- x <p>b", "a"),
}


@pytest.mark.parametrize("name", CASES)
def test_text_that_stays(name):
    source, want = CASES[name]
    assert Page(source).text() == want


def test_very_long_page_and_clashing_names(spark):
    from pyspark.sql import functions as F

    n = 300_000
    rows = [(1, "http://a.org", "<article>" + "<p>w</p>" * n + "</article>"), (None, None, None), (2, "u", "")]
    df = spark.createDataFrame(rows, PAGES)
    for c in ("host", "copy", "copies", "weight", "low", "node", "n_chars", "text", "key"):
        df = df.withColumn(c, F.lit(3))
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    assert got[1].n_chars == 2 * n - 1 and got[None].text == "" and got[2].n_chars == 0
