"""SimHash, decontamination, language ID, toxicity, quality: brute force, round trips, held-out accuracy, edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import SF, duck, rows_of
from pyspark.sql import functions as F

from varloom.llm import common, decontam, langid, neardup, quality, queries, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, ids=None, extra=""):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "en", f"s{n % 3}", len(t or "")) for n, (i, t) in enumerate(zip(ids, texts, strict=True))], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# SimHash
def brute_fp(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    c = np.zeros(64, int)
    for x in sh:
        h = xxhash.xxh64_intdigest(x, 42)
        c += [(h >> b) & 1 for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * c[b] > len(sh))


def brute_components(ids, fps, radius=4):
    par = list(range(len(ids)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    f = np.array(fps, np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= radius):
            par[find(i)] = find(int(j))
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(i)
    out = [None] * len(ids)
    for g in groups.values():
        known = [ids[i] for i in g if ids[i] is not None]
        for i in g:
            out[i] = min(known) if known else None
    return out


def test_simhash_against_brute_force(spark):
    r = random.Random(1)
    base = [" ".join(r.choice("abcdefghij") * r.randint(1, 4) for _ in range(r.choice([1, 3, 5, 60, 300]))) for _ in range(30)]
    texts = base + [b + " zz" for b in base] + base[:9] + [None, "", "  \t", "Ünï ÇOde\u00a0x", "A a A a A a"]
    ids = [*range(len(texts) - 1), None]
    got = simhash.near_duplicates(docs_of(spark, texts, ids)).collect()
    fps = [brute_fp(t) for t in texts]
    want = sorted(zip(ids, fps, brute_components(ids, fps), strict=True), key=repr)
    assert sorted([(x.doc_id, x.fp % (1 << 64), x.component_id) for x in got], key=repr) == want
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_majority_counts_long_groups():
    h = np.random.default_rng(0).integers(0, 1 << 64, 150_000, dtype=np.uint64)
    bits = ((h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(0)
    got = simhash._majority(h, np.array([0, 140_000, 140_000, 150_000]))
    bits0 = ((h[:140_000, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(0)
    assert got[0] == sum(1 << b for b in range(64) if 2 * bits0[b] > 140_000) and got[1] == 0 and bits.sum() > 0


def planted(r, n, groups):
    """n random fingerprints and chains of near ones, distinct."""
    base = r.integers(0, 1 << 64, groups, dtype=np.uint64)
    near = [base]
    for _ in range(6):
        x = near[-1].copy()
        for _ in range(3):
            x ^= np.uint64(1) << r.integers(0, 64, groups).astype(np.uint64)
        near.append(x)
    return np.unique(np.concatenate([r.integers(0, 1 << 64, n, dtype=np.uint64), *near]))


def brute_links(fp, radius=4):
    return {(i, int(j)) for i, f in enumerate(fp) for j in np.flatnonzero(np.bitwise_count(fp ^ f) <= radius)}


def test_bk_tree_finds_all_links():
    fp = planted(np.random.default_rng(2), 12_000, 400)
    tree = simhash.Tree.build(fp)
    got = [(q, n) for q, n in tree.search(fp, 4)]
    found = {*zip(np.concatenate([q for q, _ in got]).tolist(), np.concatenate([n for _, n in got]).tolist(), strict=True)}
    assert found == brute_links(fp)
    assert tree.visited < 0.25 * len(fp) ** 2  # edges outside the radius aren't followed
    # every edge's key is the distance of child and parent, and every node but the root hangs somewhere
    assert all(int(fp[k // 65] ^ fp[c]).bit_count() == k % 65 for k, c in zip(tree.key.tolist(), tree.kid.tolist(), strict=True))
    assert sorted(tree.kid.tolist()) == list(range(1, len(fp)))
    assert list(simhash.Tree.build(fp[:1]).search(fp[:1], 4))[0][0].tolist() == [0]


@pytest.mark.parametrize("n", [1, 5_000, 10**5, 10**8, 10**10, 10**13])
def test_routes_share_a_shard_within_the_radius(n):
    r = np.random.default_rng(4)
    tables = simhash.routes(n)
    fp = r.integers(0, 1 << 64, 300, dtype=np.uint64)
    near = fp.copy()
    for _ in range(4):
        near ^= np.uint64(1) << r.integers(0, 64, 300).astype(np.uint64)
    same = np.zeros(300, bool)
    for k, fields in enumerate(tables):
        assert all(0 <= at and at + w <= 64 for at, w in fields)
        same |= simhash._shards_of(fp, k, fields) == simhash._shards_of(near, k, fields)
    assert same.all()


def check_components(comp, fp):
    label = {x.node % (1 << 64): x.label for x in comp}
    want = list(range(len(fp)))
    for i, j in brute_links(fp):
        a, b = want[i], want[j]
        if a != b:
            want = [min(a, b) if x == max(a, b) else x for x in want] if len(fp) < 3000 else want
    if len(fp) >= 3000:  # union-find for the large case
        up = list(range(len(fp)))

        def top(i):
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for i, j in brute_links(fp):
            up[top(i)] = top(j)
        want = [top(i) for i in range(len(fp))]
    seen = {}
    for i, f in enumerate(fp.tolist()):
        seen.setdefault(want[i], set()).add(label.get(f, f))
    assert all(len(v) == 1 for v in seen.values()) and len({next(iter(v)) for v in seen.values()}) == len(seen)


@pytest.mark.parametrize("how", [{}, {"group_bytes": 30_000, "max_groups": 10**6}, {"max_groups": 0}])
def test_deep_trees_in_broadcasts_and_shuffles(spark, how):
    fp = planted(np.random.default_rng(6), 24_000, 900)
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    assert len(simhash.routes(len(fp))) > 1
    check_components(simhash.components(simhash.links(df, **how)).collect(), fp)


@pytest.mark.parametrize("max_groups", [16, 0])
def test_hot_shards_are_split_without_loss(spark, max_groups):
    r = np.random.default_rng(3)
    # all share their low blocks, so that one shard holds everything
    fp = (r.integers(0, 1 << 20, 400, dtype=np.uint64) << np.uint64(44)) | np.uint64(12345)
    fp = np.unique(np.concatenate([fp, fp ^ (np.uint64(3) << np.uint64(50))]))
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    check_components(simhash.components(simhash.links(df, tree=32, max_groups=max_groups)).collect(), fp)


def test_components_with_hubs(spark):
    edges = [(0, i) for i in range(1, 200)] + [(500, i) for i in range(501, 650)] + [(640, 199), (900, 901)]
    e = spark.createDataFrame(edges, "a long, b long")
    want = {**{i: 0 for i in range(200)}, **{i: 0 for i in range(500, 650)}, 900: 900, 901: 900}
    assert {r.node: r.label for r in simhash.components(e, hub=20).collect()} == want


def test_deduplicate_any_ids_and_clashing_names(spark):
    d = spark.createDataFrame([("b", "one two three four five six"), ("a", "one two three four five six"), (None, "else"), ("c", "else"), ("c", "else")], "doc_id string, text string")
    for c in ("row", "doc", "fp", "component", "winner", "_row", "_lost", "_twice", "node", "label"):
        d = d.withColumn(c, F.lit("x"))
    for f in (simhash.deduplicate, neardup.deduplicate):
        got = f(d)
        assert got.columns == d.columns and sorted(r.doc_id for r in got.collect()) == ["a", "c"]
    assert sorted(r.component_id for r in simhash.near_duplicates(d).collect()) == ["a", "a", "c", "c", "c"]


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in simhash.components(e).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def test_deduplicate_keeps_one_of_each(spark):
    t = "one two three four five six seven eight nine ten"
    d = docs_of(spark, [t, t, t + " x y", None, "", "other words in this text", "other words in this text"], [4, 2, 9, 7, 5, 1, 1])
    got = simhash.deduplicate(d.withColumn("label", F.lit(1)))
    want = {c for c in brute_components([4, 2, 9, 7, 5, 1, 1], [brute_fp(r.text) for r in d.collect()])}
    assert sorted(r.doc_id for r in got.collect()) == sorted(want) and got.columns == [*d.columns, "label"]
    n = docs_of(spark, [t, "solo text here now", "solo text here now", t], [None, None, None, 3])
    assert sorted([r.doc_id for r in simhash.deduplicate(n).collect()], key=repr) == [3, None]
    assert simhash.deduplicate(empty(spark)).count() == 0


# decontamination
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_scan(text, items, n=10):
    w = WORD.findall(low(text))
    hit, found = set(), set()
    for i, t in items:
        b = WORD.findall(low(t))
        for k in range(max(1, len(b) - n + 1) if b else 0):
            win = b[k : k + n]
            for a in range(len(w) - len(win) + 1):
                if w[a : a + len(win)] == win:
                    hit |= set(range(a, a + len(win)))
                    found.add("" if i is None else str(i))
    return len(w), len(hit), sorted(found)


def test_decontamination_against_brute_force(spark):
    r = random.Random(4)
    v = ["al", "be", "ce", "Dé", "e9", "fü"]
    items = [(i, " ".join(r.choice(v) for _ in range(r.choice([0, 1, 4, 9, 10, 11, 25])))) for i in range(12)] + [(None, "nul item text"), (3, "al al al al al al al al al al al"), (40, None)]
    texts = [" ".join(r.choice(v) for _ in range(r.randint(0, 60))) for _ in range(40)] + [None, "", "...", items[5][1] + "," + items[7][1].upper()]
    b = spark.createDataFrame(items, "item_id long, text string")
    for block in (32 << 20, 60):  # one broadcast, and many
        got = sorted(((x.doc_id, x.n_words, x.n_hit, x.n_items, x.item_ids) for x in decontam.scan(docs_of(spark, texts), b, block_bytes=block).collect()))
        for i, n, h, k, ids in got:
            wn, wh, wi = brute_scan(texts[i], items)
            assert (n, h, k, ids) == (wn, wh, len(wi), wi), (i, texts[i])
    assert decontam.scan(empty(spark), b).count() == 0
    assert decontam.scan(docs_of(spark, ["a b"]), b.where("false")).first().n_hit == 0


def test_decontaminate_cuts_spans(spark):
    item = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu."
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = "nothing of note in this text at all"
    long_ = " ".join(f"w{i}" for i in range(40))
    d = docs_of(spark, [clean, f"{long_} {item} {long_}", item, None])
    got = {r.doc_id: r for r in decontam.decontaminate(d, b).collect()}
    assert set(got) == {0, 1, 3} and got[0].text == clean and got[3].text is None
    assert brute_scan(got[1].text, [(1, item)])[1] == 0 and got[1].text.count("w39") == 2 and got[1].n_chars == len(got[1].text)


def test_decontamination_sql(spark):
    got, want = queries.QUERIES["op3_decontamination"](spark, SF).toPandas(), duck(SF).execute(queries.ORACLE["op3_decontamination"]).df()
    assert rows_of(got) == rows_of(want)
    assert hashlib.sha256(b"").hexdigest() in set(got.items_sha256) or got.n_items.min() > 0


# language ID
def test_language_id_held_out(spark):
    got = queries.op6_language_id(spark, SF.replace("0.001", "0.01")).toPandas()
    d = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    m = got[got.held_out].merge(d, on="doc_id")
    assert (m.lang_pred == m.lang).mean() > 0.95 and got.score.between(0, 1).all()


def test_language_id_edges(spark):
    texts = ["the and this with", "der und nicht ist", None, "", "12 34 !!", "é"]
    model = langid.fit_texts([b"the and of to in that is was " * 9, "der die und nicht ist für über ".encode() * 9] * 8, ["en", "de"] * 8)
    got = {r.doc_id: r for r in langid.predict(docs_of(spark, texts), model).collect()}
    assert (got[0].lang_pred, got[1].lang_pred) == ("en", "de")
    assert [got[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and got[2].score == 0 and got[5].lang_pred in ("en", "de")
    assert [r.lang_pred for r in langid.predict(docs_of(spark, ["abc"]), None).collect()] == ["und"]
    kept = langid.keep_languages(docs_of(spark, texts), model)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 5] and kept.columns == docs_of(spark, texts).columns
    assert langid.fit(empty(spark)) is None and langid.predict(empty(spark), model).count() == 0


def test_tabulated_convolution_is_exact():
    m = langid.fit_texts([b"abc def ghi " * 60, b"xyz uvw rst " * 60], ["a", "b"], epochs=2)
    win = np.random.default_rng(0).integers(0, 256, (5, langid.WINDOW + langid.SPAN - 1)).astype(np.uint8)
    e = m.emb[win]
    z = sum(e[:, j : j + langid.WINDOW] @ m.conv[j] for j in range(langid.SPAN)).max(1)
    want = np.maximum(z + m.bias, 0) @ m.out + m.out_bias
    assert np.allclose(m.window_logits(win), want, atol=1e-3)


def test_windows_cover_whole_texts():
    texts = [b"a" * 600, b"", b"b" * 256, b"c"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.cumsum([0, *map(len, texts)])
    win, row = langid.windows_of(data, offs)
    assert list(row) == [0, 0, 0, 2, 3]
    assert [int((win[row == i][:, : langid.WINDOW] != 0).sum()) for i in range(4)] == [600, 0, 256, 1]


# toxicity
def brute_segments(s):
    """All maximal segments by the recursive definition: the best segment, then both sides of it."""
    best, at = 0, None
    for i in range(len(s)):
        t = 0
        for j in range(i, len(s)):
            t += s[j]
            if t > best + 1e-12:
                best, at = t, (i, j + 1)
    if at is None:
        return []
    a, b = at
    return brute_segments(s[:a]) + [(a, b, best)] + [(x + b, y + b, z) for x, y, z in brute_segments(s[b:])]


def test_segments_against_recursion():
    r = random.Random(5)
    for _ in range(200):
        s = [r.choice([-3, -2, -1, 1, 2, 5]) + r.random() / 100 for _ in range(r.randint(0, 25))]
        got = toxicity.segments_of(np.array(s, float))
        want = brute_segments(s)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([x[2] for x in got], [x[2] for x in want])


def test_toxicity_held_out(spark):
    d = SF.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(docs, labels)
    held = docs.join(labels.where(common.crc_fold(F.col("doc_id"), 5) == 0), "doc_id")
    got = toxicity.score(held, model).toPandas().merge(labels.toPandas(), on="doc_id")
    pred = got.score >= 0.5
    assert (pred == (got.toxic == 1)).mean() > 0.97
    assert (pred & (got.toxic == 0)).mean() < 0.01


def test_toxicity_edges_and_passages(spark):
    r = random.Random(6)
    w = lambda n: " ".join(r.choice(["lorem", "ipsum", "dolor", "amet", "sit", "elit"]) + r.choice("abcdefgh") for _ in range(n))
    texts = [w(60) + ((" blarghy " if i % 8 else " blarghy blarghous ") + w(20) if i % 4 == 0 else "") for i in range(400)]
    y = np.array([i % 4 == 0 for i in range(400)], int)
    m = toxicity.fit_texts([t.encode() for t in texts], y)
    probe = [w(50), w(50) + " blarghish " + w(50), w(5000) + " blarghy blarghed " + w(10), None, "", "!!"]
    s = {x.doc_id: x.score for x in toxicity.score(docs_of(spark, probe), m).collect()}
    assert s[0] < 0.5 < s[1] and s[2] > 0.5 and s[3] == s[4] == s[5] < 0.5
    p = toxicity.passages(docs_of(spark, probe), m).collect()
    assert {x.doc_id for x in p} >= {2} and all("blargh" in x.passage for x in p)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)] + [(1, None), (None, 1), (2, 7)], "doc_id long, toxic int")
    left = toxicity.drop_toxic(docs_of(spark, texts), labels)
    assert {x.doc_id for x in left.collect()} == {i for i in range(400) if i % 4}
    none = toxicity.fit(docs_of(spark, texts), labels.where("false"))
    assert toxicity.score(docs_of(spark, ["x"]), none).first().score == pytest.approx(0.1)
    assert toxicity.score(empty(spark), m).count() == 0


def test_rows_of_one_class_only():
    m = toxicity.fit_texts([b"a b c", b"d e f"], np.array([0, 0]))
    assert 0 <= toxicity._score(m, pa.array(["a b", None]))[0] < 0.5


# quality
def test_ngrams_against_loop():
    texts = ["One, two  two!!", "", "a_b c|d", "é ö"]
    data, offs = common.text_rows(pa.array(texts))
    _, rows = quality.ngrams(data, offs)
    tokens = [re.findall(r"[^\W_]+|_|[^\w\s]+", t) for t in texts]
    words = [re.findall(r"[\w]+|[^\w\s]+", t) for t in texts]
    assert [int((rows == i).sum()) for i in range(4)] == [max(0, 2 * len(w) - 1) for w in words] and tokens
    same = quality.ngrams(*common.text_rows(pa.array(["x y", "x y"])))
    assert list(same[0][same[1] == 0]) == list(same[0][same[1] == 1])


@pytest.mark.parametrize("k", [0, 1, 5, 77, 180, 299, 300, 400])
def test_top_k_is_exact(spark, k):
    r = np.random.default_rng(7)
    keys = np.concatenate([r.normal(size=150), np.full(100, 0.25), r.normal(size=40) * 1e9, np.full(10, -5e-324)])
    df = spark.createDataFrame([(i, float(x), (i // 60 << 33) + i % 60) for i, x in enumerate(keys)], "doc_id long, key double, place long")
    got = {x.doc_id for x in quality.top_k(df, k).where("selected").collect()}
    assert got == {int(i) for i in np.lexsort((np.arange(300), -keys))[:k]}


@pytest.mark.parametrize("ids", ["long", "string"])
def test_top_k_of_repeated_and_blank_rows(spark, ids):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    same = spark.range(12_000).select(F.lit(7).cast(ids).alias("doc_id"), F.lit("a b c").alias("text"))
    blank = spark.range(14_000).select(F.lit(None).cast(ids).alias("doc_id"), F.lit(" ").alias("text"))
    for docs in (same, blank):
        got = quality.select(docs, labels, share=0.1)
        assert got.where("selected").count() == docs.count() // 10
    both = quality.select(same.unionByName(blank), labels, share=0.5).where("selected").groupBy("n_grams").count().collect()
    assert {r.n_grams: r["count"] for r in both} == {5: 12_000, 0: 1_000}


def test_quality_against_brute_force(spark):
    """The whole result: models, likelihood ratios, noise and the k largest keys."""
    import math

    rng = random.Random(8)
    texts = [" ".join(rng.choice(["the", "of", "a1", "x,", "$$", "buy!", "now"][: 4 if i % 3 else 7]) for _ in range(rng.randint(0, 30))) for i in range(120)] + [None, "", "the"]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 120, 2)] + [(None, 1), (4, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.select(docs, labels, temper=0.7).collect()}

    def grams(t):
        w = re.findall(r"[A-Za-z0-9_\x80-\U0010ffff]+|[^A-Za-z0-9_\x80-\U0010ffff \t\n\r\f\v]+", t or "")
        h = [int(common.run_hashes(np.frombuffer(x.encode(), np.uint8), np.array([0]), np.array([len(x.encode())]))[0][0]) for x in w]
        two = [(a * 0x9E3779B97F4A7C15 + b) % 2**64 for a, b in zip(h, h[1:])]
        return [x % quality.BUCKETS for x in h] + [(x ^ (x >> 29)) % quality.BUCKETS for x in two]

    of = [grams(t) for t in texts]
    raw, target = [1.0] * quality.BUCKETS, [1.0] * quality.BUCKETS
    for i, g in enumerate(of):
        for x in g:
            raw[x] += 1
            target[x] += i < 120 and i % 2 == 0 and i % 3 > 0
    want = {i: 0.7 * sum(math.log(target[x] / sum(target)) - math.log(raw[x] / sum(raw)) for x in g) if g else -math.inf for i, g in enumerate(of)}
    noise = {r.doc_id: r.g for r in docs.select("doc_id", quality.gumbel(17).alias("g")).collect()}
    for i, r in got.items():
        assert r.n_grams == len(of[i]) and r.importance == pytest.approx(want[i], abs=1e-9)
    order = sorted(got, key=lambda i: (not of[i], -(want[i] if of[i] else 0) - noise[i]))
    assert {i for i, r in got.items() if r.selected} == set(order[: int(len(texts) * (40 / 60 + 0.03) + 0.5)])


def test_quality_selects_the_good(spark):
    d = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.select(docs, labels).toPandas()
    m = got.merge(labels.toPandas(), on="doc_id")
    assert m[m.quality == 1].selected.mean() > 0.95 and m[m.quality == 0].selected.mean() < 0.5
    good = (labels.where("quality = 1").count()) / labels.count()
    assert got.selected.sum() == int(len(got) * (good + 0.03) + 0.5)
    again = quality.select(docs.repartition(7), labels).toPandas()
    assert set(again[again.selected].doc_id) == set(got[got.selected].doc_id)


def test_quality_edges(spark):
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    got = quality.select(docs_of(spark, ["a b c d", None, "", "a b c"]), labels, share=0.5).toPandas()
    assert set(got[got.selected].doc_id) == {0, 3} and np.isneginf(got[got.doc_id == 1].importance.iloc[0])
    assert quality.select(empty(spark), labels).count() == 0
    assert quality.select(docs_of(spark, ["a"]), labels.where("false")).first().selected


# long texts
def test_long_texts_in_parts_are_as_whole(monkeypatch):
    rng = random.Random(9)
    text = " ".join(rng.choice(["alpha", "beta", "gamma", "de", "x" * 150, "\u00fcber", "f!", "idiot"]) for _ in range(700)).encode()
    data = np.frombuffer(text, np.uint8)
    whole = np.array([0, len(data)])
    # SimHash
    flat = lambda size: [x for p in simhash._shingle_hashes(text, 4, size) for x in p]
    assert flat(100) == flat(1 << 20) and len(flat(64)) == 697
    # windows of a benchmark
    words = decontam.item_words(text.decode())
    win = decontam.Windows([("a", words[30:60]), ("b", words[200:212]), ("c", words[5:9]), ("d", words[-11:])], 10)
    starts, ends, _, hit, items = decontam._scan(data, whole, [win])
    for size in (64, 300, 5000):
        n, h, found, ranges = decontam.scan_text(data, [win], 10, size)
        assert (n, h, found) == (len(starts), int(hit.sum()), items[0]) and ranges == decontam._ranges(starts, ends, hit)
    # toxic segments
    texts = [b"you idiot fool", b"nice day today", b"idiot and fool you", b"good work friend"] * 30
    model = toxicity.fit_texts([t + b" %d" % i for i, t in enumerate(texts)], np.array([1, 0] * 60))
    n, found, at = toxicity.long_segments(model, data, 64)
    (m, same), *_ = list(toxicity.doc_segments(model, toxicity.Tokens.of(data, whole), 1))
    assert n == m and [x[:2] for x in found] == [x[:2] for x in same] and np.allclose([x[2] for x in found], [x[2] for x in same]) and found
    # n-grams and windows of bytes
    g0, _ = quality.ngrams(data, whole)
    lang = langid.fit_texts([b"the cat sat", b"der Hund lief"] * 20, ["en", "de"] * 20, epochs=2)
    p0 = langid.predict_rows(lang, pa.array([text.decode()]))
    monkeypatch.setattr(quality, "CHUNK", 200)
    monkeypatch.setattr(langid, "CHUNK", 512)
    parts = [g for *_, g, _ in quality._chunks(data, whole)]
    assert len(parts) > 5 and sorted(np.concatenate(parts).tolist()) == sorted(g0.tolist())
    p1 = langid.predict_rows(lang, pa.array([text.decode()]))
    assert p0[0] == p1[0] and np.allclose(p0[1], p1[1])


def test_run_hashes_of_any_length(monkeypatch):
    data = np.random.default_rng(1).integers(97, 123, 3000).astype(np.uint8)
    starts, ends = np.array([0, 10, 700, 2900]), np.array([5, 650, 2890, 3000])
    want = common.run_hashes(data, starts, ends, np.minimum(starts + 4, ends))
    monkeypatch.setattr(common, "_SPAN", 64)
    monkeypatch.setattr(common, "_POW", [])
    got = common.run_hashes(data, starts, ends, np.minimum(starts + 4, ends))
    assert all((a == b).all() for a, b in zip(got, want, strict=True))


def test_a_big_benchmark_and_a_long_text_in_bounded_memory():
    """In a process of its own: 32 MB of benchmark and a 100 MB text."""
    import subprocess
    import sys

    code = """
import resource, random
import numpy as np
from varloom.llm import decontam
r = random.Random(1)
words = ["w%d" % r.randrange(10**6) for _ in range(600_000)]
block = 0
text = b" ".join(w.encode() for w in words)
for items in decontam.blocks_of(((str(i), " ".join(words[i * 100 : i * 100 + 100])) for i in range(6000) for _ in range(8)), 10, decontam.BLOCK_BYTES):
    win = decontam.Windows(items, 10)
    block = max(block, win.nbytes)
big = np.frombuffer(text * (100_000_000 // len(text)), np.uint8)
n, h, found, ranges = decontam.scan_text(big, [win])
assert n > 10_000_000 and 0 < h <= n and found
print(block >> 20, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600, check=True)
    block, peak = map(int, out.stdout.split())
    assert block < 96 and peak < 900


@pytest.mark.parametrize("name", ["toxicity", "langid", "decontam", "quality", "simhash"])
def test_three_megabytes_through_spark(spark, name):
    text = ("the quick brown fox jumps over the lazy dog and runs far away " * 50_000)[:3_000_000]
    docs = docs_of(spark, [text, "short text", None])
    labels = spark.createDataFrame([(1, 0, 1)], "doc_id long, toxic int, quality int")
    if name == "toxicity":
        got = toxicity.score(docs, toxicity.fit(docs, labels))
    elif name == "langid":
        got = langid.predict(docs, langid.fit(docs))
    elif name == "decontam":
        b = spark.createDataFrame([("a", "fox jumps over the lazy dog and runs far away the quick")], "item_id string, text string")
        got = decontam.scan(docs, b)
        assert {r.doc_id: r.n_words for r in got.collect()} == {0: len(text.split()), 1: 2, 2: 0}
    elif name == "quality":
        got = quality.select(docs, labels, share=0.9)
    else:
        got = simhash.near_duplicates(docs)
        assert next(r.fp for r in got.collect() if r.doc_id == 0) % (1 << 64) == brute_fp(text)
    assert got.count() == 3


# whole results of the classifiers' queries
def test_toxicity_query_against_brute_force(spark):
    """Scores of all documents by single words, plain loops and the definition of maximal segments."""
    import math

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    m = toxicity.fit(docs, labels)
    tables = [dict(zip(k.tolist(), v.tolist(), strict=True)) for k, v in zip(m.keys, m.scores, strict=True)]
    seen: dict[bytes, float] = {}

    def word_score(w):
        if w not in seen:
            d, out = np.frombuffer(w, np.uint8), -m.drift
            for k, n in enumerate([4, 5, 6, len(w)]):
                if len(w) >= n:
                    h = int(common.run_hashes(d, np.array([0]), np.array([min(n, len(w))]))[0][0]) ^ (k + 1 if k < 3 else 0)
                    out = tables[k].get(h, out)
            seen[w] = out
        return seen[w]

    def maximal(x, lo, hi):
        """The best sum of a range (the shortest, then the first), then what is left and right of it."""
        best, at, total, start = 0.0, None, 0.0, lo
        for i in range(lo, hi):
            if total <= 0:
                total, start = 0.0, i
            total += x[i]
            if total > best + 1e-12:
                best, at = total, (start, i + 1)
        if at is None:
            return []
        return maximal(x, lo, at[0]) + [best] + maximal(x, at[1], hi)

    got = {r.doc_id: r for r in queries.QUERIES["op5_toxicity"](spark, SF).collect()}
    rows = docs.collect()
    for r in rows:
        words = [w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (r.text or "").encode())]
        x = [word_score(w) for w in words]
        sums = maximal(x, 0, len(x)) if any(v > 0 for v in x) else []
        z = [m.lam * s - m.log_k - math.log(len(x)) for s in sums]
        a = m.coef[0] + m.coef[1] * max([0.0, *z]) + m.coef[2] * math.log1p(sum(v for v in z if v > 0))
        assert got[r.doc_id].score == pytest.approx(1 / (1 + math.exp(-a)), abs=1e-9)
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.5) and got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert len(got) == len(rows)


def test_language_query_against_brute_force(spark):
    """Predictions of all documents by direct convolution of every window."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m = langid.fit(docs)
    got = {r.doc_id: r for r in queries.QUERIES["op6_language_id"](spark, SF).collect()}
    rows = docs.collect()
    for r in rows:
        d = (r.text or "").encode()
        if not any(c.isalpha() for c in r.text or ""):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        logs = []
        for a in range(0, len(d), langid.WINDOW):
            w = np.frombuffer(d[a : a + langid.WINDOW + langid.SPAN - 1].ljust(langid.WINDOW + langid.SPAN - 1, b"\0"), np.uint8)
            e = m.emb[w]
            z = sum(e[k : k + langid.WINDOW] @ m.conv[k] for k in range(langid.SPAN))
            logit = np.maximum(z.max(0) + m.bias, 0) @ m.out + m.out_bias
            logs.append(logit - logit.max() - np.log(np.exp(logit - logit.max()).sum()))
        p = np.exp(np.mean(logs, 0))
        p /= p.sum()
        assert got[r.doc_id].score == pytest.approx(p.max(), abs=1e-4)
        top = np.sort(p)[::-1]
        assert top[0] - top[1] < 1e-4 or got[r.doc_id].lang_pred == m.langs[int(p.argmax())]
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert len(got) == len(rows)


def test_numbers_that_are_no_letters():
    assert not langid.has_letter("\u00bd \u00b2 12 _ !") and langid.has_letter("\u00bd x") and langid.has_letter("\u4e2d")
    model = langid.fit_texts([b"the cat sat", b"der Hund lief"] * 20, ["en", "de"] * 20, epochs=1)
    assert langid.predict_rows(model, pa.array(["\u00bd\u00b2", None, "a"]))[0][:2] == ["und", "und"]
