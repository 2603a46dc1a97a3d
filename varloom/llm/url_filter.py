"""URL filter: host rules first, then empirical-Bayes host reputation. DataFrame functions only.

Labelled page outcomes (1 bad, 0 good) are counted per host and shrunk through beta-binomial priors:
global rate -> suffix (last label, or a listed longer suffix) -> registered domain (one label more) ->
host. Each prior leaves out what it is a prior for (a host's domain counts without the host), so no outcome counts
twice, and has as its strength the level's method-of-moments beta-binomial estimate. A host is blocked when the
lower posterior bound of its bad rate, the ``level`` quantile of its beta posterior, exceeds ``max_bad``: when the
posterior's probability up to ``max_bad`` (by quadrature in log-odds) is below ``level``. Outcomes are counted before
any shuffle of page rows; page rows meet only host rows, by a broadcast of counted size or by a salted shuffle. Up to
``INLINE_RULES`` rules are one expression; more are a table that is joined on the suffixes of hosts.

Edge cases: a null url or one without ``://`` has empty host and path, and is judged as the host "";
hosts without labels get their domain's, suffix's or the global prior; without any labels the global
rate is 0.5 of one pseudo-page and nothing is blocked; repeated labels of a page count once (bad wins);
null ids and labels are ignored as outcomes; repeated page rows give repeated result rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import ascii_lower, lookup_join, materialize

#: Suffixes of two labels that are registries themselves (a parameter, not a full list).
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")
INLINE_RULES = 200
NODES = 200


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(host.lower(), slash + path, verdict)


def host_path(url: Column) -> tuple[Column, Column]:
    has = F.instr(url, "://") > 0
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.when(has, ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)))
    path = F.when(has, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_columns(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def suffix_domain(host: Column) -> tuple[Column, Column]:
    parts = F.split(host, r"\.")
    two = F.concat_ws(".", F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2))
    long_ = two.isin(*LONG_SUFFIXES)
    three = F.concat_ws(".", F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), 3))
    return F.when(long_, two).otherwise(F.element_at(parts, -1)), F.when(long_, three).otherwise(two)


def _strength(level: DataFrame) -> float:
    """kappa of a beta-binomial around each row's parent mean m, by moments over (n, bad, m)."""
    v = F.col("m") * (1 - F.col("m"))
    d = F.col("bad") - F.col("n") * F.col("m")
    r = level.agg(F.sum(d * d - F.col("n") * v), F.sum(F.col("n") * (F.col("n") - 1) * v)).first()
    rho = r[0] / r[1] if r[1] else 0.5
    return 1 / min(max(rho, 0.001), 0.999) - 1


def beta_cdf(a: Column, b: Column, x: float, nodes: int = NODES) -> Column:
    """P(p <= x) of a beta(a, b) law: midpoint sums over log-odds on both sides of x, twelve deviations out."""
    t0 = F.lit(math.log(x / (1 - x)))
    mode, sd = F.log(a / b), F.sqrt(1 / a + 1 / b)
    plus = lambda t: F.log1p(F.exp(-F.abs(t))) + F.greatest(t, F.lit(0.0))
    log_g = lambda t: -a * plus(-t) - b * plus(t)
    top = log_g(mode)

    def part(lo: Column, hi: Column) -> Column:
        step = (hi - lo) / nodes
        return step * F.aggregate(F.sequence(F.lit(0), F.lit(nodes - 1)), F.lit(0.0), lambda acc, i: acc + F.exp(log_g(lo + (i + 0.5) * step) - top))

    left, right = part(F.least(t0, mode - 12 * sd), t0), part(t0, F.greatest(t0, mode + 12 * sd))
    return left / (left + right)


def host_reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """host, n, bad, a, b (its beta posterior) for every host of pages(page_id, host) given outcomes(page_id, bad)."""
    one = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").cast("double").alias("bad"))
    seen = pages.select("page_id", "host").join(one, "page_id", "left").groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad"))
    suffix, domain = suffix_domain(F.col("host"))
    hosts = materialize(seen.select("host", suffix.alias("suffix"), domain.alias("domain"), "n", "bad"), "url-hosts")
    n, bad = hosts.agg(F.sum("n"), F.sum("bad")).first()
    total = lambda *by: hosts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    # the rate of all other suffixes, then the shrunk rate of the suffix's other domains, and of the domain's other hosts
    sfx = materialize(total("suffix").withColumn("m", (F.lit(bad or 0.0) - F.col("bad") + 0.5) / (F.lit(n or 0.0) - F.col("n") + 1.0)), "url-suffix")

    def below(child: DataFrame, parent: DataFrame, on: list[str]) -> DataFrame:
        k = _strength(parent)
        up = materialize(parent.select(*on, F.col("n").alias("pn"), F.col("bad").alias("pb"), F.col("m").alias("pm")), "url-parent")
        rest = lookup_join(child, up, on, "inner", salt=F.col(child.columns[-3]))
        return rest.withColumn("m", (F.col("pb") - F.col("bad") + k * F.col("pm")) / (F.col("pn") - F.col("n") + k)).drop("pn", "pb", "pm")

    dom = materialize(below(total("suffix", "domain"), sfx, ["suffix"]), "url-domain")
    full = materialize(below(hosts.select("suffix", "domain", "host", "n", "bad"), dom, ["suffix", "domain"]), "url-host")
    k = _strength(full)
    return full.select("host", "n", "bad", (F.col("bad") + k * F.col("m")).alias("a"), (F.col("n") - F.col("bad") + k * (1 - F.col("m"))).alias("b"))


def rule_table(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """host, path, rule, verdict of the longest rule for each (host, path) that one fits, for any number of rules."""
    table = materialize(rows.sparkSession.createDataFrame([(r.host, r.path, r.text, r.verdict) for r in rules], "above string, start string, rule string, said string"), "url-rules")
    one = rows.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    fits = lookup_join(one.select("host", "path", F.explode(above).alias("above")), table, ["above"], "inner", salt=F.col("path")).where(F.startswith("path", F.col("start")))
    return fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule"), "rule", "said")).alias("best")).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.said").alias("said"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], max_bad: float = 0.5, level: float = 0.05, inline: int = INLINE_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages(page_id, url)."""
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rep = host_reputation(rows, outcomes)
    rep = materialize(rep.select("host", F.when(beta_cdf(F.col("a"), F.col("b"), max_bad) < level, "block").otherwise("allow").alias("own")), "url-rep")
    out = lookup_join(rows, rep, ["host"], salt=F.struct("page_id", "path"))
    if len(rules) <= inline:
        text, verdict = rule_columns(F.col("host"), F.col("path"), rules)
        return out.select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, "own").alias("verdict"))
    said = materialize(rule_table(rows, rules), "url-said")
    return lookup_join(out, said, ["host", "path"], salt=F.col("page_id")).select("page_id", "host", "path", "rule", F.coalesce("said", "own").alias("verdict"))
