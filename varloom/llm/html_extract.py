"""Main-text extraction with a site style tree.

Pages are parsed by a tolerant tokenizer into blocks of text, each under a style path (tags with their
class and id names from the root down). Per host, all pages are merged into one style tree: for each style
node the counts of its presentation styles (sequence of child styles) and of its content features (block
texts) over the m pages that have it; copies of a page share the weight of one. A node's importance is

* content: 1 - mean over feature occurrences of log_m(pages that have the feature), and
* presentation: the entropy -sum p log_m p of its presentation styles,

combined as (1 - g^l) * presentation + g^l * content for l presentation styles (g = 0.9), as in the site
style tree method. Whether a node's blocks stay is one sum of log-odds, for every page of every site alike:

    prior(path) + WEIGHT * (importance - 1/2) * (1 - 1/m) * 3/2, kept when at least 0

The prior comes from what the elements on the path are (article and main for, navigation, footers, asides, forms,
hidden parts and whole names of adverts, comments, menus against; names that only contain such a word count little
inside an article and not at all on headings); the second term is the tree's evidence, none for one page and growing
with m, so no number of pages switches it on. Its importance is that of the whole branch, the largest of the node's and
all nodes' below, so that nothing unique goes with a repeated container. A page whose every
block is low by evidence falls back to the priors.

Two passes over the html: one emits counts (pre-aggregated per batch), one applies the removals. Counts are
aggregated by (host, node, feature) before (host, node), so a host with a third of all pages is spread
over its features. The nodes with evidence against them leave as hashes with a number: up to ``LOW_ROWS`` of them
(12 bytes each) are broadcast; beyond, each page's nodes are joined with them and gathered by page.

Edge cases: null or empty html gives an empty text; a null url is the host ""; a page that isn't HTML is
one block of text; unclosed and misnested tags are closed as browsers do for blocks, lists, tables and options, an
unclosed comment, script, style, title, template or iframe takes the rest of the page; text of math, svg, object,
textarea, audio, video and canvas is text; repeated rows give repeated results; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import frugal, lookup_join, materialize
from varloom.llm.url_filter import host_path
from varloom.session import ship

GAMMA = 0.9
WEIGHT = 4.0
LOW_ROWS = 4_000_000
_UNIT = 1 << 20  # weight of a page; its copies share it

# log-odds of a block by what stands on its path
NEUTRAL, INSIDE, OUTSIDE, TITLE, HEADING, NEVER, NAMED, HINT = 0.8, 4.0, -4.5, 2.0, 1.8, -30.0, -9.0, -2.5

_RAW = "script|style|template|title|iframe"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({_RAW})\b[^>]*?(?:/>|>.*?(?:</\1\s*>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"'=]|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[=\"'])*)(?:>|\Z)", re.S | re.I)
_ATTR = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.S)
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center datalist dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup p pre section select summary table tbody td tfoot th thead tr ul".split())
_CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "tbody": "tr td th tbody thead tfoot", "thead": "tr td th tbody thead tfoot", "tfoot": "tr td th tbody thead tfoot"}
_CLOSES = {k: frozenset(v.split()) for k, v in _CLOSES.items()}
_SCOPE = {"li": frozenset(("ul", "ol", "menu", "dir")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), **{k: frozenset(("table",)) for k in ("tr", "td", "th", "tbody", "thead", "tfoot")}}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_AGAINST = frozenset("nav footer aside form button dialog menu label fieldset legend select option optgroup datalist noscript".split())
_IN_HEAD = frozenset("base basefont bgsound link meta noscript".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_NAMES = frozenset(
    "nav navbar navigation menu submenu header masthead topbar footer foot colophon sidebar aside rail ad ads adv advert adverts advertisement adsense adslot banner banners sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices alert popup modal overlay interstitial newsletter subscribe subscription signup signin login register search searchbox breadcrumb breadcrumbs crumbs share sharing "
    "social comment comments commentlist disqus reply replies respond discussion feedback related recommended recommendations trending popular widget widgets toolbar pagination pager copyright legal disclaimer "
    "skip hidden tags tagcloud outbrain taboola paywall form".split()
)
#: Words that decide inside an article too, alone or as the first of a class name.
_FIRST = frozenset("ad ads adv advert adverts advertisement adsense adslot sponsored comment comments commentlist disqus cookie cookies newsletter sidebar nav navbar navigation breadcrumb breadcrumbs menu footer".split())
#: Whole names that decide inside an article too.
_WHOLE = _FIRST | frozenset("related relatedposts relatedarticles relatedlinks relatedstories share sharing sharebuttons sharelinks social socialshare sociallinks replies respond discussion promo banner popup modal subscribe signup login notice alert widget toolbar pagination pager outbrain taboola hidden tags tagcloud".split())
_KEEP_NAMES = frozenset("article content main post entry body text story".split())


def _attrs(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)} if raw.strip(" /\n\t\r") else {}


def _prior(tag: str, a: dict[str, str], inside: bool) -> float:
    """What an element adds to the log-odds of all below it."""
    if tag in _AGAINST or (tag == "header" and not inside):
        return NAMED
    if tag == "head":
        return NEVER
    if not a:
        return 0.0
    if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return NEVER
    if a.get("role", "").lower() in _ROLES:
        return NAMED
    if tag in ("body", "html", "article", "main") or tag in _HEADINGS:
        return 0.0
    classes = [[w.lower() for w in _CAMEL.findall(c)] for c in a.get("class", "").split()]
    ident = [w.lower() for w in _CAMEL.findall(a.get("id", ""))]
    names = [*classes, ident] if ident else classes
    words = {w for n in names for w in n}
    if not words & _NAMES:
        return 0.0
    strong = any("".join(n) in _WHOLE for n in names) or any(n and n[0] in _FIRST for n in classes)
    if inside:
        if tag == "p" and not words & {"ad", "ads", "advert", "advertisement", "sponsored"}:
            strong = False
        return NAMED if strong else HINT
    return NAMED if strong or not words & _KEEP_NAMES else HINT


class Page:
    """The blocks of a page: (style path, text, inside the main element, prior, tag), and child styles of each path."""

    __slots__ = ("blocks", "children", "main")

    def __init__(self, source: str):
        self.blocks: list[tuple[str, str, bool, float, str]] = []
        self.children: dict[str, list[str]] = {}
        self.main = False
        stack: list[tuple[str, str, float, bool]] = [("", "", NEUTRAL, False)]  # tag, path, prior, inside
        text: list[str] = []
        cut = False  # inside an inline element that doesn't stay

        def flush() -> None:
            if text:
                t = " ".join(_html.unescape("".join(text)).split())
                text.clear()
                if t:
                    # inline elements belong to their block
                    tag, path, prior, inside = next(x for x in reversed(stack) if x[0] in _BLOCK or not x[0])
                    self.blocks.append((path, t, inside, prior, tag))

        def pop(i: int) -> None:
            nonlocal cut
            del stack[i:]
            cut = False
            for x in reversed(stack):
                if x[0] in _BLOCK or not x[0]:
                    break
                if x[2] <= NEVER / 2:
                    cut = True
                    break

        at = 0
        for m in _TOKEN.finditer(source):
            if m.start() > at and not cut:
                text.append(source[at : m.start()])
            at = m.end()
            tag = m[3]
            if tag is None:
                continue
            tag = tag.lower()
            if m[2]:  # an end tag closes the nearest open element of its name
                if tag in _BLOCK:
                    flush()
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        if tag not in _BLOCK and any(x[0] in _BLOCK for x in stack[i + 1 :]):
                            flush()
                        pop(i)
                        break
                    if stack[i][0] in ("article", "main", "body", "td", "th") and tag not in _BLOCK:
                        break
                continue
            if tag == "br":
                text.append(" ")
                continue
            if stack[-1][0] == "head" and tag not in _IN_HEAD:
                flush()
                pop(len(stack) - 1)
            if tag in _BLOCK or tag == "option":
                flush()
                for i in range(len(stack) - 1, 0, -1):  # a block closes an open paragraph or option and what is open in it
                    if stack[i][0] in ("p", "option"):
                        pop(i)
                        break
                    if stack[i][0] in _BLOCK:
                        break
                if tag in _CLOSES:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] in _CLOSES[tag]:
                            pop(i)
                        elif stack[i][0] in _SCOPE[tag]:
                            break
            if tag in _VOID:
                continue
            a = _attrs(m[4])
            _, path, prior, inside = stack[-1]
            mine = prior + _prior(tag, a, inside)
            was = cut
            if tag in _BLOCK:
                name = tag + "".join("." + c for c in sorted(a.get("class", "").split())) + ("#" + re.sub(r"\d+", "0", a["id"]) if a.get("id") else "")
                self.children.setdefault(path, []).append(name)
                path = f"{path}>{name}"
            elif mine - prior <= NAMED:  # an inline element is cut out of its block
                cut, mine = True, prior + NEVER
            if not inside and mine > 0 and (tag in ("article", "main") or a.get("role", "").lower() == "main"):
                self.main = inside = True
                mine += INSIDE
            if not (m[4] or "").rstrip().endswith("/") or tag in _BLOCK:
                stack.append((tag, path, mine, inside))
            else:
                cut = was
        if at < len(source) and not cut:
            text.append(source[at:])
        flush()

    def odds(self) -> list[float]:
        """Prior log-odds of each block."""
        out = []
        for _, _, inside, prior, tag in self.blocks:
            if tag == "h1":
                prior += TITLE
            elif tag in _HEADINGS:
                prior += HEADING
            if self.main and not inside and tag != "h1":
                prior += OUTSIDE
            out.append(prior)
        return out

    def text(self, low: dict[int, float] | None = None) -> str:
        """The blocks that stay; ``low`` is the evidence (below 0) against style nodes by hash."""
        prior = self.odds()
        kept = [b[1] for b, p in zip(self.blocks, prior, strict=True) if p >= 0 and (not low or p + low.get(_h(b[0]), 0.0) >= 0)]
        return "\n".join(kept or [b[1] for b, p in zip(self.blocks, prior, strict=True) if p >= 0])


def _h(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode()) - (1 << 63)


def _above(path: str) -> Iterator[str]:
    """The paths of the nodes above a path."""
    at = path.find(">", 1)
    while at != -1:
        yield path[:at]
        at = path.find(">", at + 1)


def _key(host: str, node: int) -> int:
    """One number of a host's style node."""
    return xxhash.xxh64_intdigest(f"{node} {host}".encode()) - (1 << 63)


def style_counts(pages: DataFrame) -> DataFrame:
    """host, node, kind (0 page, 1 content, 2 presentation, 3 a node below), feature, n of pages(host, html, weight): the weight of pages that have it."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got: Counter = Counter()
            for host, source, weight in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not source:
                    continue
                p = Page(source)
                one = set()
                mine = {path: _h(path) for path, *_ in p.blocks}
                for path, t, *_ in p.blocks:
                    h = mine[path]
                    one.add((host, h, 1, _h(t)))
                    one.add((host, h, 0, 0))
                    one.add((host, h, 2, _h("|".join(p.children.get(path, ())))))
                for path, h in mine.items():
                    one.update((host, mine[up], 3, h) for up in _above(path) if up in mine)
                for k in one:
                    got[k] += weight
            keys = list(got)
            cols = list(zip(*keys, strict=True)) if keys else [[]] * 4
            types = [pa.string(), pa.int64(), pa.int8(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(cols, types, strict=True)], pa.array([got[k] for k in keys], pa.int64())], ["host", "node", "kind", "feature", "n"])

    counts = pages.select("host", "html", "weight").mapInArrow(frugal(run), "host string, node long, kind tinyint, feature long, n long")
    return counts.groupBy("host", "node", "kind", "feature").agg(F.sum("n").alias("n"))


def importance(counts: DataFrame) -> DataFrame:
    """host, node, pages, importance of every style node."""
    k, n = F.col("kind"), F.col("n") / float(_UNIT)
    nlogn = n * F.log(F.greatest(n, F.lit(1.0)))
    a = counts.groupBy("host", "node").agg(
        F.sum(F.when(k == 0, n)).alias("m"),
        F.sum(F.when(k == 1, n)).alias("c"),
        F.sum(F.when(k == 1, nlogn)).alias("cl"),
        F.sum(F.when(k == 2, n)).alias("p"),
        F.sum(F.when(k == 2, n * F.log(n))).alias("pl"),
        F.count(F.when(k == 2, 1)).alias("l"),
    )
    lm = F.log(F.col("m"))
    many = F.col("m") > 1.0001
    content = F.when(many, 1 - F.col("cl") / F.col("c") / lm).otherwise(1.0)
    shape = F.when(many, (F.log("p") - F.col("pl") / F.col("p")) / lm).otherwise(1.0)
    g = F.pow(F.lit(GAMMA), F.col("l"))
    return a.select("host", "node", F.col("m").alias("pages"), F.least(F.greatest((1 - g) * shape + g * content, F.lit(0.0)), F.lit(1.0)).alias("importance"))


def composite(counts: DataFrame, imp: DataFrame) -> DataFrame:
    """The same with the importance of a node's whole branch: the largest of its own and those of all nodes below."""
    below = counts.where("kind = 3").select("host", "node", F.col("feature").alias("below"))
    branch = below.join(imp.select("host", F.col("node").alias("below"), F.col("importance").alias("i")), ["host", "below"]).groupBy("host", "node").agg(F.max("i").alias("branch"))
    return imp.join(branch, ["host", "node"], "left").select("host", "node", "pages", F.greatest("importance", "branch").alias("importance"))


def evidence(imp: DataFrame, weight: float = WEIGHT) -> DataFrame:
    """host, node, e: the log-odds that the tree adds, for nodes that it speaks against."""
    e = weight * (F.col("importance") - 0.5) * (1 - 1 / F.greatest("pages", F.lit(1.0))) * 1.5
    return imp.select("host", "node", e.cast("float").alias("e")).where("e < 0")


def _low_by_page(rows: DataFrame, low: DataFrame) -> DataFrame:
    """Adds ``low``, a page's nodes with evidence against them, by joins: for sites with more nodes than a broadcast holds."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sorted({_h(x[0]) for x in Page(s).blocks}) if s else [] for s in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.list_(pa.int64()))], ["key", "host", "nodes"])

    keyed = rows.withColumn("key", F.xxhash64("host", "html"))
    of = keyed.select("key", "host", "html").mapInArrow(frugal(nodes), "key long, host string, nodes array<long>").select("key", "host", F.explode("nodes").alias("node")).distinct()
    got = materialize(lookup_join(of, low, ["host", "node"], "inner", salt=F.col("key")).groupBy("key").agg(F.collect_list(F.struct("node", "e")).alias("low")), "html-pages")
    return lookup_join(keyed, got, ["key"], salt=F.struct("page_id", "url"), max_rows=100_000)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weight: float = WEIGHT, low_rows: int = LOW_ROWS) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    ship(pages.sparkSession)
    spark = pages.sparkSession
    host, _ = host_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))
    mark = rows.withColumn("copy", F.xxhash64("html"))
    copies = materialize(mark.groupBy("host", "copy").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "html-copies")
    weighed = lookup_join(mark, copies, ["host", "copy"], salt=F.struct("page_id", "url")).withColumn("weight", F.greatest(F.floor(_UNIT / F.coalesce("copies", F.lit(1))), F.lit(1)).cast("long"))
    counts = materialize(style_counts(weighed), "html-counts")
    imp = materialize(importance(counts), "html-importance")
    low = materialize(evidence(composite(counts, imp), weight), "html-low")
    few = low.count() <= low_rows
    held = spark.sparkContext.broadcast(_table(low) if few else None)
    if not few:
        rows = _low_by_page(rows, low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for s, x in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if not s:
                    texts.append("")
                    continue
                p = Page(s)
                texts.append(p.text(_of_page(p, x, *held.value) if held.value else {y["node"]: y["e"] for y in x or ()}))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "html", "host" if few else "low").mapInArrow(frugal(run), f"page_id {pages.schema[id_col].dataType.simpleString()}, url string, text string, n_chars long")


def _table(low: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of (host, node) and their evidence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = [_key(h, n) for h, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), b.column(2)], ["key", "e"])

    got = low.select("host", "node", "e").mapInArrow(frugal(run), "key long, e float").toArrow()
    key, e = got.column("key").to_numpy(), got.column("e").to_numpy()
    order = np.argsort(key)
    return key[order], e[order]


def _of_page(p: Page, host: str, keys: np.ndarray, e: np.ndarray) -> dict[int, float]:
    """The evidence against the nodes of one page."""
    nodes = list({_h(b[0]) for b in p.blocks})
    if not len(keys) or not nodes:
        return {}
    want = np.array([_key(host, n) for n in nodes], np.int64)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return {n: float(e[i]) for n, i, k in zip(nodes, at.tolist(), want.tolist(), strict=True) if keys[i] == k}
