"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm import ann, decontam, html_extract, langid, mixing, quality, simhash, toxicity, url_filter, warc
from varloom.llm.common import crc_fold
from varloom.session import read

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op1_simhash(spark: SparkSession, d: str) -> DataFrame:
    nd = simhash.near_duplicates(read(spark, d, "documents"))
    return nd.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_html_extraction(spark: SparkSession, d: str) -> DataFrame:
    return html_extract.extract(read(spark, d, "pages"))


def op3_decontamination(spark: SparkSession, d: str) -> DataFrame:
    s = decontam.scan(read(spark, d, "documents"), read(spark, d, "benchmark"))
    return s.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_url_filter(spark: SparkSession, d: str) -> DataFrame:
    labels = read(spark, d, "labels")
    bad = F.greatest((F.col("quality") == 0).cast("int"), (F.col("toxic") == 1).cast("int"))
    outcomes = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return url_filter.judge(read(spark, d, "pages"), outcomes, [url_filter.parse_rule(*r) for r in RULES])


def op5_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    got = toxicity.score(docs, toxicity.fit(docs, read(spark, d, "labels")))
    return got.select("doc_id", (crc_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    got = langid.predict(docs, langid.fit(docs))
    return got.select("doc_id", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op7_warc(spark: SparkSession, d: str) -> DataFrame:
    got = warc.round_trip(read(spark, d, "pages"), spark)
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_mixing(spark: SparkSession, d: str) -> DataFrame:
    m = mixing.mix(read(spark, d, "documents"))
    return m.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "first_slot")


def op9_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.select(read(spark, d, "documents"), read(spark, d, "labels"))


def op10_ann(spark: SparkSession, d: str) -> DataFrame:
    vectors = read(spark, d, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def _half(lo: str, hi: str) -> str:
    """Midpoint sum of a beta density over log-odds from lo to hi."""
    t = f"({lo} + (i + 0.5) * ({hi} - {lo}) / {url_filter.NODES})"
    tail = f"ln(1 + exp(-abs({t})))"
    return f"({hi} - {lo}) / {url_filter.NODES} * list_sum(list_transform(range(0, {url_filter.NODES}), lambda i: exp(-a * ({tail} + greatest(-{t}, 0)) - b * ({tail} + greatest({t}, 0)) - top)))"


def _url_sql() -> str:
    rules = sorted((url_filter.parse_rule(*r) for r in RULES), key=lambda r: (-len(r.text), r.text))
    fits = lambda r: f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"
    pick = lambda what: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{getattr(r, what)}'" for r in rules) + " END"
    long_ = ", ".join(f"'{s}'" for s in url_filter.LONG_SUFFIXES)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def strength(table: str) -> str:
        v = "m * (1 - m)"
        return f"(SELECT 1 / least(greatest(coalesce(sum((bad - n * m) * (bad - n * m) - n * {v}) / nullif(sum(n * (n - 1) * {v}), 0), 0.5), 0.001), 0.999) - 1 FROM {table})"

    return f"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
rows AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{lower}'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
out AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
seen AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM rows LEFT JOIN out USING (page_id) GROUP BY host),
parts AS (SELECT *, string_split(host, '.') AS l FROM seen),
two AS (SELECT *, array_to_string(l[greatest(len(l) - 1, 1):], '.') AS t2, array_to_string(l[greatest(len(l) - 2, 1):], '.') AS t3 FROM parts),
hosts AS (SELECT host, n, bad, CASE WHEN t2 IN ({long_}) THEN t2 ELSE l[len(l)] END AS suffix, CASE WHEN t2 IN ({long_}) THEN t3 ELSE t2 END AS domain FROM two),
g AS (SELECT coalesce(sum(bad), 0) AS gb, coalesce(sum(n), 0) AS gn FROM hosts),
s0 AS (SELECT suffix, n, bad, (gb - bad + 0.5) / (gn - n + 1.0) AS m FROM (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY suffix), g),
ks AS (SELECT {strength("s0")} AS k),
d0 AS (SELECT d.suffix, domain, d.n, d.bad, (s0.bad - d.bad + k * m) / (s0.n - d.n + k) AS m FROM (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY 1, 2) d JOIN s0 ON d.suffix = s0.suffix, ks),
kd AS (SELECT {strength("d0")} AS k),
h0 AS (SELECT host, h.n, h.bad, (d0.bad - h.bad + k * m) / (d0.n - h.n + k) AS m FROM hosts h JOIN d0 ON h.suffix = d0.suffix AND h.domain = d0.domain, kd),
kh AS (SELECT {strength("h0")} AS k),
post AS (SELECT host, bad + k * m AS a, n - bad + k * (1 - m) AS b FROM h0, kh),
ab AS (SELECT host, a, b, ln(a / b) AS mode, sqrt(1 / a + 1 / b) AS sd FROM post),
qd AS (SELECT *, -a * (ln(1 + exp(-abs(mode))) + greatest(-mode, 0)) - b * (ln(1 + exp(-abs(mode))) + greatest(mode, 0)) AS top, least(0, mode - 12 * sd) AS lo, greatest(0, mode + 12 * sd) AS hi FROM ab),
pt AS (SELECT host, {_half("lo", "0")} AS l, {_half("0", "hi")} AS r FROM qd),
rep AS (SELECT host, l / (l + r) AS below FROM pt)
SELECT page_id, host, path, {pick("text")} AS rule, coalesce({pick("verdict")}, CASE WHEN below < 0.05 THEN 'block' ELSE 'allow' END) AS verdict
FROM rows LEFT JOIN rep USING (host)
"""


DECONTAM_SQL = r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
bl AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark),
b AS (SELECT item_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM bl),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
g AS (SELECT row_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT row_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
m AS (SELECT row_id, i, n, item_id FROM g JOIN win USING (n, g)),
h AS (SELECT row_id, count(DISTINCT p) AS n_hit FROM (SELECT row_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY row_id),
it AS (SELECT row_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT row_id, item_id FROM m) GROUP BY row_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (row_id) LEFT JOIN it USING (row_id)
"""

WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
r AS (SELECT payload_digest, max(page_id) AS response FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN response IS NOT NULL AND page_id IS DISTINCT FROM response THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM response THEN response END AS refers_to
FROM d LEFT JOIN r USING (payload_digest)
"""

MIX_SQL = rf"""
WITH z AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM z GROUP BY source),
s1 AS (SELECT *, (pos % 3 + 1)::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM s0),
s2 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef, sum(w) OVER (ORDER BY cap / w, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lft, (sum(source_size) OVER ())::DOUBLE AS total FROM s1),
lam AS (SELECT (total - bef) / lft AS lam FROM s2 WHERE cap >= (total - bef) / lft * w ORDER BY cap / w, pos LIMIT 1),
t AS (SELECT source, pos, source_size, least(cap, (SELECT lam FROM lam) * w) AS target FROM s1),
tw AS (SELECT *, floor(target + 1e-6)::BIGINT AS want FROM t),
bd AS (SELECT pos, floor(sum(target) OVER (ORDER BY pos) / sum(target) OVER () * {mixing.RING} + 0.5)::BIGINT AS hi FROM tw WHERE target > 0),
bounds AS (SELECT pos, hi, coalesce(lag(hi) OVER (ORDER BY pos), 0) AS lo FROM bd),
n AS (SELECT ((sum(want) + {mixing.BLOCK - 1}) // {mixing.BLOCK})::BIGINT AS n FROM tw),
sl AS (SELECT t AS slot, ((((t + 1) % {mixing.RING}) * {mixing.GOLD}) % {mixing.RING}) AS u FROM (SELECT unnest(range(0, (SELECT n FROM n))) AS t)),
rk AS (SELECT slot, pos, row_number() OVER (PARTITION BY pos ORDER BY slot) - 1 AS rank FROM sl JOIN bounds ON u >= lo AND u < hi),
bk AS (SELECT pos, (want + {mixing.BLOCK - 1}) // {mixing.BLOCK} AS blocks FROM tw),
have AS (SELECT pos, blocks, coalesce(c, 0) AS have FROM bk LEFT JOIN (SELECT pos, count(*) AS c FROM rk GROUP BY pos) USING (pos)),
tail AS (SELECT pos, unnest(range(have, blocks)) AS rank FROM have WHERE blocks > have),
plan AS (SELECT slot, pos, rank FROM rk JOIN bk USING (pos) WHERE rank < blocks UNION ALL SELECT row_number() OVER (ORDER BY rank, pos) - 1 + (SELECT n FROM n), pos, rank FROM tail),
shuf AS (SELECT pos, block, row_number() OVER (PARTITION BY pos ORDER BY md5(pos::VARCHAR || ':' || block::VARCHAR), block) - 1 AS rank FROM (SELECT pos, unnest(range(0, blocks)) AS block FROM bk)),
placed AS (SELECT pos, block, slot FROM plan JOIN shuf USING (pos, rank)),
c AS (SELECT row_number() OVER () AS row_id, doc_id, size, source_size, target, want, pos, sum(size) OVER (PARTITION BY pos ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS cum FROM z JOIN tw ON z.source IS NOT DISTINCT FROM tw.source),
cp AS (SELECT *, cum + copy * source_size AS a, least(cum + copy * source_size + size, want) AS e FROM (SELECT *, unnest(range(0, (want - 1) // source_size + 1)) AS copy FROM c WHERE size > 0 AND want > 0)),
pc AS (SELECT row_id, pos, block, least(e, (block + 1) * {mixing.BLOCK}) - greatest(a, block * {mixing.BLOCK}) AS words FROM (SELECT *, unnest(range((a // {mixing.BLOCK})::BIGINT, ((e - 1) // {mixing.BLOCK})::BIGINT + 1)) AS block FROM cp WHERE a < e)),
k AS (SELECT row_id, sum(words) AS taken, min(slot) AS first_slot FROM pc JOIN placed USING (pos, block) GROUP BY row_id)
SELECT doc_id, size, source_size, round(target, 6) AS target, coalesce(taken, 0)::BIGINT AS taken, first_slot
FROM c LEFT JOIN k USING (row_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_html_extraction": op2_html_extraction,
    "op3_decontamination": op3_decontamination,
    "op4_url_filter": op4_url_filter,
    "op5_toxicity": op5_toxicity,
    "op6_language_id": op6_language_id,
    "op7_warc": op7_warc,
    "op8_mixing": op8_mixing,
    "op9_quality": op9_quality,
    "op10_ann": op10_ann,
}

ORACLE: dict[str, str] = {"op3_decontamination": DECONTAM_SQL, "op4_url_filter": _url_sql(), "op7_warc": WARC_SQL, "op8_mixing": MIX_SQL}
