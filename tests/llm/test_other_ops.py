"""HTML extraction, URL filter, WARC, mixing, nearest neighbours, and the pipeline."""

import gzip
import hashlib
import io
import os

import numpy as np
import pytest
from conftest import SF, duck, rows_of
from pyspark.sql import functions as F
from test_neardup import brute_kept

import corpus_pipeline
from varloom.llm import ann, common, decontam, html_extract, langid, mixing, queries, toxicity, url_filter, warc
from varloom.llm.html_extract import Page

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("name", ["op4_url_filter", "op7_warc", "op8_mixing"])
def test_sql(spark, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck(SF).execute(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


# HTML
@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<p>a<b>b<div class='ad'>x</div>c</p>tail", "ab\nc\ntail"),
        ("<body><header>H</header><div id=content><p>One &amp; two&nbsp;three<br>x</p><ul><li>a<li>b</ul></div><div class=comments>no</div></body>", "One & two three x\na\nb"),
        ("plain & text < 5 > 3", "plain & text < 5 > 3"),
        ("<article><h1>T</h1><p>x <span class=ad>bad</span> y<p>z<aside>q</aside></article><p>out", "T\nx y\nz"),
        ("<div>a<!-- c --><script>1<2</script> b</div>", "a b"),
        ("<p><b>x.<br><p>y</p>", "x.\ny"),
        ("<nav>n</nav><main><form>f</form><p>m</p><div role=navigation>r</div></main><footer>f</footer>", "m"),
        ("<div hidden>h</div><div style='display: none'>s</div><p>v&#233;&#x41;</p>", "véA"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
        ("<p>cut <a href='x", "cut"),
        ("", ""),
    ],
)
def test_page_text(source, want):
    assert Page(source).text() == want


def test_site_style_tree_removes_what_repeats(spark):
    rows = []
    for i in range(30):
        rows.append((i, "http://a.example.org/x", f"<body><div class='t1'><div>Site slogan</div><span>All rights</span></div><div class='t2'><p>unique story {i} number {i * 7}</p><p>and more {i}</p></div></body>"))
    for i in range(3):  # too few pages to judge
        rows.append((100 + i, "http://b.example.org/x", "<div class='t1'>same</div><div class='t2'>same too</div>"))
    for i in range(20):  # a site of copies keeps its text
        rows.append((200 + i, "http://c.example.org/x", "<div>copy of one text</div>"))
    rows += [(300, None, None), (301, "http://a.example.org", ""), (301, "http://a.example.org", "")]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, PAGES).withColumn("host", F.lit(1))).collect()}
    assert got[4].text == "unique story 4 number 28\nand more 4" and got[4].n_chars == len(got[4].text)
    assert got[100].text == "same\nsame too" and got[205].text == "copy of one text"
    assert got[300].text == "" and got[300].n_chars == 0 and got[301].text == ""
    assert html_extract.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_importance_by_hand(spark):
    u = html_extract._UNIT
    rows = [(1, 0, 0, 4), (1, 1, 11, 4), (1, 2, 5, 4), (2, 0, 0, 4), *[(2, 1, 20 + i, 1) for i in range(4)], (2, 2, 5, 4)]
    c = spark.createDataFrame([("h", node, kind, feature, n * u) for node, kind, feature, n in rows], "host string, node long, kind int, feature long, n long")
    got = {r.node: r.importance for r in html_extract.importance(c).collect()}
    assert got[1] == pytest.approx(0) and got[2] == pytest.approx(0.9)


def test_html_of_the_tables(spark):
    import html as h
    import re

    p = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract(p).collect()}
    for r in p.collect():
        art = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        want = [" ".join(h.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", art)]
        assert got[r.page_id] == "\n".join(x for x in want if x)


# URLs
def test_url_parts_and_rules(spark):
    urls = ["http://A.Example.COM/en/7?x=1", "https://net/de/x", "ftp://x.example.net/de/81#f", "nohost", None, "http://org", "http://b.org/es/?q", "x://H:80?p", "://"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: r for r in url_filter.judge(df, none, [url_filter.parse_rule(*r) for r in queries.RULES]).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[1].rule == "net/de/" and got[1].verdict == "allow"
    assert got[2].rule == "example.net/de/8" and got[2].verdict == "block"
    assert all(got[i].host == "" and got[i].path == "" and got[i].rule is None and got[i].verdict == "allow" for i in (3, 4, 8))
    assert got[5].host == "org" and got[5].path == "" and got[6].rule == "org/es/" and got[7].host == "h:80"


def test_reputation_blocks_only_the_sure(spark):
    rows = [(i, f"http://bad.example.org/{i}") for i in range(200)] + [(1000 + i, f"http://good.example.org/{i}") for i in range(200)] + [(2000, "http://new.example.org/")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    out = spark.createDataFrame([(i, int(i < 190)) for i in range(200)] + [(1000 + i, 0) for i in range(200)] + [(None, 1), (5, None), (1001, 0)], "page_id long, bad int")
    got = {r.page_id: r.verdict for r in url_filter.judge(df, out, []).collect()}
    assert got[3] == "block" and got[1003] == "allow" and got[2000] == "allow"
    host, _ = url_filter.host_path(F.col("url"))
    rep = {r.host: r for r in url_filter.host_reputation(df.withColumn("host", host), out).collect()}
    assert 0.9 < rep["bad.example.org"].a / (rep["bad.example.org"].a + rep["bad.example.org"].b) < 0.96
    assert url_filter.judge(df.where("false"), out, []).count() == 0


def test_an_outcome_counts_once(spark):
    """The prior of a lone host knows nothing of its own pages; one bad page blocks no host."""
    df = spark.createDataFrame([(1, "http://a.one.xyz/"), (2, "http://b.two.com/"), (3, "http://c.two.com/")], "page_id long, url string")
    host, _ = url_filter.host_path(F.col("url"))
    out = spark.createDataFrame([(1, 1)], "page_id long, bad int")
    rep = {r.host: r for r in url_filter.host_reputation(df.withColumn("host", host), out).collect()}
    a = rep["a.one.xyz"]
    k = a.a + a.b - 1
    assert a.a - 1 == pytest.approx(0.5 * k)  # the global rate without its page is 0.5 of one pseudo-page
    assert {r.verdict for r in url_filter.judge(df, out, []).collect()} == {"allow"}


def test_beta_quantile(spark):
    import math

    def cdf(a, b, x, n=200_000):  # direct integral of the density
        p = (np.arange(n) + 0.5) / n
        d = np.exp((a - 1) * np.log(p) + (b - 1) * np.log(1 - p) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
        return d[p < x].sum() / n

    rows = [(2.0, 5.0), (40.0, 60.0), (9.5, 3.25), (1.5, 1.5), (300.0, 200.0), (6.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    for r in df.withColumn("c", url_filter.beta_cdf(F.col("a"), F.col("b"), 0.5)).collect():
        assert r.c == pytest.approx(cdf(r.a, r.b, 0.5), abs=2e-4)


def test_any_number_of_rules(spark):
    hosts = ["a.x.org", "x.org", "y.a.x.org", "z.net", "", "ax.org"]
    df = spark.createDataFrame([(i, f"http://{hosts[i % 6]}/{'abc'[i % 3]}/{i % 4}") for i in range(48)] + [(99, None)], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad int")
    rules = [url_filter.parse_rule("block" if k % 2 else "allow", r) for k, r in enumerate(["x.org/", "a.x.org/a/", "a.x.org/a/1", "org/b", "net", "z.net/c/3", "x.org/c/"])]
    want = sorted(url_filter.judge(df, none, rules).collect(), key=repr)
    assert sorted(url_filter.judge(df, none, rules, inline=0).collect(), key=repr) == want and len({r.rule for r in want}) > 4


def test_suffixes(spark):
    s, d = url_filter.suffix_domain(F.col("h"))
    got = spark.createDataFrame([("a.b.co.uk",), ("x.org",), ("localhost",), ("",)], "h string").select(s, d).collect()
    assert [tuple(r) for r in got] == [("co.uk", "b.co.uk"), ("org", "x.org"), ("localhost", "localhost"), ("", "")]


# WARC
def test_round_trip(spark):
    big = "x" * 1500
    rows = [(1, "http://a/1", big), (5, "http://a/2", big), (3, "http://a/3", big), (4, "http://b/\n", "small"), (9, None, "small"), (6, "u", None), (None, "n", big), (7, "é", "é" * 999), (8, "z", "")]
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    got = warc.round_trip(df.withColumn("digest", F.lit(0)), spark, payload=True).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 9 and by[5].record_type == "response" and bytes(by[5].payload).decode() == big
    for i in (1, 3, None):
        assert (by[i].record_type, by[i].refers_to, by[i].payload) == ("revisit", 5, None)
        assert by[i].payload_bytes == 1500 and by[i].payload_digest == hashlib.sha1(big.encode()).hexdigest()
    assert by[4].record_type == by[9].record_type == "response" and by[7].payload_bytes == 1998 and by[6].payload_bytes == 0
    assert by[4].url == "http://b/%0A" and by[9].url is None and by[7].url == "é"
    assert warc.round_trip(df.where("false"), spark).count() == 0


def test_normaliser_makes_members(spark, tmp_path):
    recs = [warc.make_record(i, f"http://h/{i}", os.urandom(50) * (i % 7), None, "2024-01-01T00:00:00Z", False) for i in range(40)]
    src, dst = str(tmp_path / "m.warc.gz"), str(tmp_path / "n.warc.gz")
    with gzip.open(src, "wb") as f:
        f.write(b"".join(recs))
    fs, p = warc._fs(src)
    assert warc.normalise_file(fs, p, dst) == 40
    raw = open(dst, "rb").read()
    for rec, line in zip(recs, open(dst + ".idx"), strict=True):
        at, size, kind, rid = line.split()
        assert gzip.decompress(raw[int(at) : int(at) + int(size)]) == rec and kind == "response" and rid.startswith("<urn:")
    assert gzip.decompress(raw) == b"".join(recs)
    # normalising again changes nothing, and a cut archive is an error
    assert warc.normalise_file(fs, dst, str(tmp_path / "o.warc.gz")) == 40
    with pytest.raises(ValueError):
        list(warc.records(iter([b"".join(recs)[:-100]])))
    assert len(list(warc.records(warc.inflate(io.BytesIO(open(src, "rb").read()), piece=7)))) == 40
    broken = recs[3].replace(b"WARC-Payload-Digest: sha1:", b"WARC-Payload-Digest: sha1:A"[:-1] + b"AAAA", 1)[: len(recs[3])]
    with pytest.raises(Exception):  # noqa: B017
        warc.read_record(broken)


# mixing
def brute_targets(sizes, weights=(1, 2, 3)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, done = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in done]
        left = total - sum(done.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return done | share
        done |= {s: 3.0 * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 50, "c": 3, None: 1000}, {"a": 0, "b": 10}, {"x": 7}, {"a": 500, "b": 2, "c": 1, "d": 0, "e": 40, "f": 3}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = brute_targets(sizes)
    assert set(got) == set(want) and all(got[s] == pytest.approx(want[s]) for s in want)
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (i % 90)), f"s{i % 5}" if i % 7 else "s0", None, 0) for i in range(600)] + [(600, None, None, None, 0), (601, "x y", None, None, 0), (601, "x y", None, None, 0), (None, "q " * 40, "s1", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    got = mixing.mix(docs, block=16).toPandas()
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all() and (got.taken >= 0).all()
    per = got.groupby("source", dropna=False).agg(t=("taken", "sum"), target=("target", "first"))
    assert (per.t == np.floor(per.target + 1e-6)).all()
    again = mixing.mix(docs.repartition(9), block=16).toPandas()
    assert rows_of(got) == rows_of(again)
    assert mixing.mix(docs.where("false")).count() == 0
    assert mixing.mix(docs.where("text is null")).toPandas().taken.tolist() == [0]


def test_schedule_is_low_discrepancy(spark):
    t = spark.createDataFrame([(0, 6400.0), (1, 12800.0), (2, 44800.0)], "pos int, target double")
    s = mixing.schedule(t, 64).orderBy("slot").toPandas()
    assert s.slot.is_unique and len(s) == 1000
    for p, share in ((0, 0.1), (1, 0.2), (2, 0.7)):
        mine = (s.pos == p).cumsum().to_numpy()
        assert np.abs(mine - share * np.arange(1, len(s) + 1)).max() < 6  # every prefix of the mix is near its target
        assert s[s.pos == p]["rank"].tolist() == list(range(int((s.pos == p).sum())))


def test_taken_comes_from_the_slots(spark):
    """Words taken against the definition: a stream of repeated documents, cut at the target."""
    import hashlib

    rows = [(i, " ".join(["w"] * (i % 50)), "a" if i % 3 else "b") for i in range(200)] + [(7, "x y z", "a"), (None, "q " * 9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, block=16).toPandas()
    want = []
    for src in {r[2] for r in rows}:
        mine = sorted(((hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), -1 if i is None else i, len((t or "").split())) for i, t, x in rows if x == src))
        target = got[got.source == src if src is not None else got.source.isna()].target.iloc[0]
        left, total, taken = int(target + 1e-6), sum(n for *_, n in mine), [0] * len(mine)
        at = 0
        while left and total:
            k = min(mine[at % len(mine)][2], left)
            taken[at % len(mine)] += k
            left, at = left - k, at + 1
        want += [(str(src), i, n, k) for (_, i, n), k in zip(mine, taken, strict=True)]
    mine = [(str(None if r.source != r.source or r.source is None else r.source), -1 if r.doc_id != r.doc_id else int(r.doc_id), int(r.size), int(r.taken)) for r in got.rename(columns={"size": "size"}).itertuples()]
    assert sorted(mine) == sorted(want)
    assert got[got.taken > 0].first_slot.notna().all()


def test_mixed_text_is_the_mix(spark):
    texts = {i: f"  \u00fcber {i}\n" + " ".join(f"w{j}\t" for j in range(i % 37)) + " end " for i in range(150)}
    docs = spark.createDataFrame([(i, t, f"s{i % 4}" if i % 5 else "s0") for i, t in texts.items()] + [(900, None, "s1"), (901, " \n ", "s1")], "doc_id long, text string, source string")
    for c in ("pos", "block", "words", "slot", "a", "cum", "_s", "_key"):
        docs = docs.withColumn(c, F.lit(1))
    mix, counts = mixing.mixed_text(docs, block=16).toPandas(), mixing.mix(docs, block=16).toPandas()
    assert mix.groupby("doc_id").words.sum().to_dict() == counts[counts.taken > 0].set_index("doc_id").taken.to_dict()
    assert all(len(t.split()) == n for t, n in zip(mix.text, mix.words, strict=True))
    assert (mix.groupby("slot").words.sum().sort_index().iloc[:-1] <= 16).all() and mix.groupby("slot").source.nunique().max() == 1
    assert mix.groupby("doc_id").slot.min().to_dict() == counts[counts.taken > 0].set_index("doc_id").first_slot.astype(int).to_dict()
    for i, group in mix.groupby("doc_id"):  # the pieces of a whole copy add up to the text
        copy = group.sort_values("at").drop_duplicates("start")
        if copy.words.sum() == len(texts[i].split()):
            assert "".join(copy.text) == texts[i]



# nearest neighbours
def brute_nearest(vecs, queries_, k):
    out = {}
    for q in queries_:
        s = sorted(((-float(np.dot(vecs[q], v)), i) for i, v in vecs.items() if i != q))[:k]
        out[q] = [(i, -x) for x, i in s]
    return out


def test_small_and_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0]), (3, [-1.0, 2.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (9, [1.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df.withColumn("rank", F.lit(1)), df.where("vec_id % 20 = 0"), 20).collect()
    vecs = {0: [1, 0], 1: [0.5, 0.5], 2: [1, 0], 3: [-1, 2], 20: [1, 0]}
    want = brute_nearest({k: np.array(v, float) for k, v in vecs.items()}, [0, 20], 20)
    for q in (0, 20):
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want[q]
    assert ann.nearest(df.where("false"), df, 5).count() == 0 and ann.nearest(df, df.where("false"), 5).count() == 0


def test_recall_over_shards(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(3000, 24))
    x[1000:1400] = x[0] * 1.5 + r.normal(size=(400, 24)) * 0.01  # a dense group
    x[1400:1900] = x[7]  # many copies
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id % 50 = 0"), 20, shard_rows=700).toPandas()
    want = brute_nearest(dict(enumerate(x)), range(0, 3000, 50), 20)
    hits = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and q not in set(g.vec_id)
        assert (np.diff(g.score) <= 0).all() and np.allclose(g.score, x[g.vec_id] @ x[q])
        hits += len(set(g.vec_id) & {i for i, _ in want[q]})
    assert hits / (20 * len(want)) > 0.95


@pytest.mark.parametrize("scales", [(1e39,), (1e-39,), (1e39, 1.0, 1e-39), (1e120, 1e-120)])
def test_recall_at_any_magnitude(spark, scales):
    r = np.random.default_rng(10)
    x = r.normal(size=(900, 16)) * np.array(scales)[np.arange(900) % len(scales)][:, None]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), 20, shard_rows=400).toPandas()
    want = brute_nearest(dict(enumerate(x)), range(0, 900, 20), 20)
    hits = sum(len(set(g.vec_id) & {i for i, _ in want[q]}) for q, g in got.groupby("query_id"))
    assert hits / (20 * len(want)) > 0.95 and got.groupby("query_id").size().eq(20).all()


def test_vectors_of_two_lengths(spark):
    r = np.random.default_rng(11)
    rows = [(i, [float(v) for v in r.normal(size=4 if i % 2 else 6)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for c in ("d", "v", "band", "h", "shard", "block", "part", "graph", "hot"):
        df = df.withColumn(c, F.lit(0))
    got = ann.nearest(df, df.where("vec_id in (20, 41)"), 40).toPandas()
    assert {int(q): set(g.vec_id % 2) for q, g in got.groupby("query_id")} == {20: {0}, 41: {1}} and len(got) == 58


def test_insertion_builds_a_navigable_graph():
    x = np.random.default_rng(12).normal(size=(4000, 32))
    g = ann.Graph.build(x, [np.array([i]) for i in range(4000)])
    assert len(g.layers) > 2 and all((nb < 4000).all() and (nodes[:, None] != nb).all() for nodes, nb in g.layers)
    want = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    got, _ = g.search(x[:200], 10)
    assert np.mean([len(set(a) & set(b)) for a, b in zip(got.tolist(), want.tolist(), strict=True)]) > 9.5


def test_graph_is_connected_and_dumps():
    x = np.random.default_rng(9).normal(size=(300, 8))
    g = ann.Graph.build(x, [np.array([i]) for i in range(300)])
    h = ann.Graph.load(g.dump())
    assert all((a[1] == b[1]).all() for a, b in zip(g.layers, h.layers, strict=True))
    seen, todo = {0}, [0]
    while todo:
        for n in g.layers[0][1][todo.pop()].tolist():
            if n >= 0 and n not in seen:
                seen.add(n)
                todo.append(n)
    assert len(seen) == 300
    one = ann.Graph.build(x[:1], [np.array([5])])
    assert one.search(x[:2], 3)[0].tolist() == [[0, -1, -1], [0, -1, -1]]


# pipeline
def test_pipeline_against_its_parts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    out = docs
    steps = {}
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = common.materialize(f(spark, out, SF), name)
        assert out.columns == docs.columns
        steps[name] = out
    lang = {r.doc_id for r in langid.predict(docs, langid.fit(docs)).where("lang_pred <> 'und' and score >= 0.3").collect()}
    assert {r.doc_id for r in steps["language_id"].collect()} == lang
    a = steps["language_id"]
    clean = {r.doc_id for r in toxicity.score(a, toxicity.fit(a, labels)).where("score < 0.5").collect()}
    assert {r.doc_id for r in steps["toxicity"].collect()} == clean
    left = [(r.doc_id, r.text) for r in steps["toxicity"].collect()]
    assert sorted(r.doc_id for r in steps["simhash_dedup"].collect()) == brute_kept(left)
    assert decontam.scan(steps["decontamination"], bench).where("n_hit > 0").count() == 0
    last, want = corpus_pipeline.run(spark, SF).toPandas(), mixing.mixed_text(steps["decontamination"]).toPandas()
    assert rows_of(last) == rows_of(want) and set(last.doc_id) <= {r.doc_id for r in steps["decontamination"].collect()}
    counts = mixing.mix(steps["decontamination"]).toPandas()
    assert last.groupby("doc_id").words.sum().to_dict() == counts[counts.taken > 0].set_index("doc_id").taken.to_dict()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "simhash_dedup", "decontamination", "mixing"]


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    t = "the and of this that with from have been were " * 3
    rows = [(1, t, "en", "a", 5), (1, t, "en", "a", 5), (2, None, None, None, None), (None, t + "x", "en", "b", 1), (3, "", "de", "b", 0), (4, "123", "en", "a", 3)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for data in (rows, []):
        d = spark.createDataFrame(data, schema)
        for _, f in corpus_pipeline.STAGES:
            d = f(spark, d, str(tmp_path))
            d.collect()
        left = sorted((r.doc_id for r in d.collect()), key=repr)
        assert left in ([1], [1, None]) if data else left == []
