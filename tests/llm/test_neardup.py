"""The pipeline's near-duplicate stage against brute force on five-word shingles."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from varloom.llm import neardup, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def shingle_set(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_kept(rows):
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            union = sets[i] | sets[j]
            if label[i] != label[j] and (not union or 10 * len(sets[i] & sets[j]) >= 8 * len(union)):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return sorted({min(r[0] for r, x in zip(rows, label, strict=True) if x == c) for c in set(label)})


def test_pipeline_drops_pairs_at_similarity_080(spark, tmp_path):
    r = random.Random(5)
    words = [f"w{i}" for i in range(2000)]
    rows = []
    for k in range(40):
        t = [r.choice(words) for _ in range(r.choice([12, 60, 200, 5000] if k < 8 else [60, 200]))]
        rows.append((10 * k, " ".join(t)))
        for m in range(1, 6):  # one word changed in twenty to two hundred, so similarities around 0.8
            u = list(t)
            for at in r.sample(range(len(u)), max(1, len(u) * m // 130)):
                u[at] = r.choice(words)
            rows.append((10 * k + m, " ".join(u)))
    rows += [(9000, None), (9001, ""), (9002, "one two"), (9003, "ONE  two")]
    d = docs_of(spark, rows)
    want = brute_kept(rows)
    assert sorted(x.doc_id for x in neardup.deduplicate(d).collect()) == want and 46 < len(want) < 200
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    first = corpus_pipeline.near_dedup(spark, d, str(tmp_path))
    left = corpus_pipeline.decontaminated(spark, first, str(tmp_path))
    ids = sorted(x.doc_id for x in left.collect())
    assert left.columns == d.columns and ids == brute_kept([(x.doc_id, x.text) for x in first.collect()])
    assert ids == brute_kept([r for r in rows if r[0] in ids])  # no pair at 0.8 is left


def test_rows_and_ids(spark):
    t, u = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    # id 7 names two texts: one a copy of 3's, the other unique
    got = neardup.deduplicate(docs_of(spark, [(3, t), (3, t), (7, t), (7, u), (None, t), (None, "solo text of no id"), (None, "solo text of no id")]).withColumn("x", F.lit(1)))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(3, t), (7, u), (None, "solo text of no id")], key=repr)
    assert neardup.deduplicate(docs_of(spark, [])).count() == 0


def test_simhash_keeps_the_other_texts_of_a_clashing_id(spark):
    t, u, v = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    got = simhash.deduplicate(docs_of(spark, [(3, t), (7, t), (7, u), (8, u), (9, v), (9, "another text of its own"), (9, v)]))
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted([(3, t), (7, u), (9, v), (9, "another text of its own")])
