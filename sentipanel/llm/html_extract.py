"""Main text of web pages by equivalence classes of template tokens.

A page is a sequence of tokens: opening tags and text runs, told apart by their path of tags and classes.  Over the
pages of a host, a token's occurrence vector says how often each page holds it.  Tokens with equal vectors form
a class.  A class that is large (two tokens or more), frequent (a share of the host's pages), ordered (its tokens
come in one order on every page) and nested (it lies in one gap of the host's root class on every page) belongs
to the template; what lies between its tokens are slots.  Vectors are compared by sums of per-page hashes, so a host
with a third of all pages is pre-aggregated like any other, and no task sees a whole host.

From a page's slots the main text is taken: template text goes, by the same share on every host and in every
element, and only what is left in slots is looked at further.  There, as a following check, go menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments by tag, role, class and id, and of what remains the article element, the
main element or else the container with most text outside links is taken.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut_lineage, drop_clashing, skew_join, text_of

RESULTS = ["text", "n_chars"]

# HTML elements by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span "
             "strike strong sub sup time tt u var wbr".split())
NEVER = set("script style noscript template head title svg canvas iframe object audio video map math".split())
BOILER = set("nav footer aside form button select option textarea input menu dialog fieldset datalist".split())
CLOSES_P = set("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main "
               "menu nav ol p pre section table ul li dt dd tr td th tbody thead".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar note".split())
# Words of class and id names that mark boilerplate, and those that mark the main text.
BAD = set("ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
          "notices notification popup modal overlay sidebar sidenav rail menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar "
          "footer comment comments commentlist reply replies respond disqus discussion share sharing social related recommended recommendations "
          "newsletter subscribe subscription signup signin login search pagination pager widget widgets toolbar skip legal copyright".split())
ALWAYS_BAD = BAD - {"header", "banner", "legal", "notice", "notices"}
GOOD = set("article post entry story content main body text".split())


def _pieces(attrs: dict) -> set[str]:
    return set(re.findall(r"[a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", f"{attrs.get('class') or ''} {attrs.get('id') or ''}").lower()))


class Page(HTMLParser):
    """Tokens and text runs of one page."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str, bool, int]] = []  # tag, path, boilerplate, node
        self.nodes: list[tuple[str, int, set[str], dict]] = []  # tag, parent, pieces, attrs
        self.tokens: list[tuple[str, bool]] = []           # token, is text
        self.runs: list[tuple[int, bool, str, int, bool]] = []  # node, boilerplate, text, token, in a link
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close_p()
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            self._close_same(tag)
        a = {k: v for k, v in attrs}
        pieces = _pieces(a)
        parent = self.stack[-1] if self.stack else ("", "", False, -1)
        path = f"{parent[1]}/{tag}" + ("." + "-".join(sorted(pieces)) if pieces else "")
        if tag not in INLINE:
            self.tokens.append((path, False))
        in_main = any(t in ("article", "main") for t, *_ in self.stack)
        bad = parent[2] or tag in NEVER or tag in BOILER or (tag == "header" and not in_main)
        if not bad and tag not in ("html", "body", "article", "main"):
            good = bool(pieces & GOOD)
            bad = bool(pieces & (ALWAYS_BAD if good else BAD))
        if not bad:
            style = (a.get("style") or "").replace(" ", "").lower()
            bad = (a.get("role") or "").lower() in ROLES or "hidden" in a or (a.get("aria-hidden") or "").lower() == "true" or "display:none" in style
        self.nodes.append((tag, parent[3], pieces, a))
        if tag not in INLINE:
            self.runs.append((parent[3], parent[2], " ", -1, False))  # a block's edge parts words
        if tag not in VOID:
            self.stack.append((tag, path if tag not in INLINE else parent[1], bad, len(self.nodes) - 1))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                if tag in INLINE and any(t not in INLINE for t, *_ in self.stack[i:]):
                    return  # an inline end tag closes no block
                del self.stack[i:]
                break
        if tag not in INLINE:
            top = self.stack[-1] if self.stack else ("", "", False, -1)
            self.runs.append((top[3], top[2], " ", -1, False))

    def handle_data(self, data):
        top = self.stack[-1] if self.stack else ("", "", False, -1)
        flat = " ".join(data.split())
        if not flat:
            self.runs.append((top[3], top[2], " ", -1, False))
            return
        if top[0] not in ("script", "style"):
            self.tokens.append((f"{top[1]}#{flat}", True))
            linked = any(t == "a" for t, *_ in self.stack)
            self.runs.append((top[3], top[2], data, len(self.tokens) - 1, linked))

    def _close_p(self):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == "p":
                del self.stack[i:]
                return
            if self.stack[i][0] not in INLINE:
                return

    def _close_same(self, tag):
        outer = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select", "datalist")}.get(tag, ("table",))
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in outer:
                return
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return


def token_hash(token: str) -> int:
    import xxhash
    return xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass")) - (1 << 63)


def main_text(page: Page, template: set[int]) -> str:
    """Joins the main runs in a page's slots; ``template`` holds the tokens of the host's template text."""
    parents = [n[1] for n in page.nodes]

    def inside(node: int, roots: set[int]) -> int:
        while node >= 0 and node not in roots:
            node = parents[node]
        return node
    # a template token parts the words of the slots on its sides
    slots = [(node, bad, " ", -1, False) if tok >= 0 and token_hash(page.tokens[tok][0]) in template else (node, bad, text, tok, linked)
             for node, bad, text, tok, linked in page.runs]
    texts = [(node, text, tok, linked) for node, bad, text, tok, linked in slots if not bad]
    bad_node = {len(page.nodes)}
    weight: dict[int, float] = {}

    def pick(roots: set[int]) -> set[int]:
        size = dict.fromkeys(roots, 0)
        for node, text, tok, linked in texts:
            r = inside(node, roots)
            if r >= 0 and tok >= 0 and not linked:
                size[r] += len(text)
        top = [r for r in roots if inside(parents[r], roots) < 0]
        best = max(top, key=lambda r: (size[r] + sum(size[c] for c in roots if c != r and inside(c, {r}) == r), -r), default=None)
        return {best} if best is not None and any(size.values()) else set()
    tags = lambda test: {i for i, n in enumerate(page.nodes) if test(n)}
    root = (pick(tags(lambda n: n[0] == "article")) or pick(tags(lambda n: n[0] == "main" or (n[3].get("role") or "") == "main")))
    if not root:
        for node, text, tok, linked in texts:  # most text outside links, counted for the parent and half for its parent
            if tok < 0 or linked:
                continue
            while node >= 0 and (page.nodes[node][0] in INLINE or page.nodes[node][0] == "p" or page.nodes[node][0][0] == "h" and page.nodes[node][0][1:].isdigit()):
                node = parents[node]
            if node >= 0:
                weight[node] = weight.get(node, 0) + len(text)
                if parents[node] >= 0:
                    weight[parents[node]] = weight.get(parents[node], 0) + len(text) / 2
        best = max(weight, key=lambda n: (weight[n] * (1.2 if page.nodes[n][2] & GOOD else 1), -n), default=None)
        root = {best} if best is not None else bad_node
    out = [text for node, text, _, _ in texts if root == bad_node or inside(node, root) >= 0]
    return " ".join("".join(out).split())


def _tokens(p: DataFrame) -> DataFrame:
    """(host, page, token, is_text, n, first) of every distinct token of every page."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 256):
                rows: list[list] = [[] for _ in range(6)]
                part = b.slice(at, 256)
                for host, key, html in zip(*(part.column(c).to_pylist() for c in ("host", "page", "__h"))):
                    seen: dict[int, list] = {}
                    for i, (token, is_text) in enumerate(Page(html).tokens):
                        t = token_hash(token)
                        if t in seen:
                            seen[t][1] += 1
                        else:
                            seen[t] = [is_text, 1, i]
                    for t, (is_text, n, first) in seen.items():
                        for col, v in zip(rows, (host, key, t, is_text, n, first)):
                            col.append(v)
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], ["host", "page", "token", "is_text", "n", "first"])
    return p.select("host", "page", "__h").mapInArrow(run, "host string, page long, token long, is_text boolean, n int, first int")


def host_templates(p: DataFrame, min_share: float = 0.5, min_pages: int = 3, broadcast_rows: int = 500_000) -> DataFrame:
    """host, template (array of tokens): the text tokens of valid classes, those on a share of ``min_share`` of the host's
    different pages and on ``min_pages`` of them at least.  Copies of a page count once, or its own text would be template."""
    met = cut_lineage(p.groupBy("host", "page").agg(F.count(F.lit(1)).alias("n")))
    twice, _ = broadcast_if_small(met.where("n > 1").select("host", "page"), broadcast_rows)
    on = ["host", "page"]
    different = p.join(twice, on, "left_anti").unionByName(p.join(twice, on, "left_semi").dropDuplicates(on))
    tokens = cut_lineage(_tokens(different))  # narrow rows, read twice
    part = lambda seed: F.sum(F.pmod(F.xxhash64(F.lit(seed), "page", "n"), F.lit(1 << 31)))
    vec = (tokens.groupBy("host", "token").agg(part(1).alias("f1"), part(2).alias("f2"), F.count(F.lit(1)).alias("pages"), F.max("is_text").alias("is_text"))
                 .where(F.col("pages") >= min_pages))
    hosts = met.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    vec = vec.join(hosts, "host").where(F.col("pages") >= min_share * F.col("host_pages"))
    vec = cut_lineage(vec.withColumn("class", F.xxhash64("f1", "f2", "pages")).drop("f1", "f2"))
    large = vec.groupBy("host", "class").agg(F.count(F.lit(1)).alias("size")).where("size >= 2")
    vec = cut_lineage(vec.join(large, ["host", "class"]))

    cand, small = broadcast_if_small(vec.select("host", "token", "class"), broadcast_rows)
    on = ["host", "token"]
    seen = tokens.join(cand, on) if small else skew_join(tokens, cand, on)
    per = (seen.groupBy("host", "class", "page").agg(F.array_sort(F.collect_list(F.struct("first", "token"))).alias("t"))
               .select("host", "class", "page", F.xxhash64("t.token").alias("order"), F.col("t.first").alias("at")))
    per = cut_lineage(per)
    ordered = per.groupBy("host", "class").agg(F.min("order").alias("lo"), F.max("order").alias("hi"), F.count(F.lit(1)).alias("pages")).where("lo = hi")
    ordered = ordered.join(large, ["host", "class"]).select("host", "class", "pages", "size")
    root = ordered.groupBy("host").agg(F.max(F.struct("pages", "size", "class")).alias("r")).select("host", F.col("r.class").alias("root"))
    classes = cut_lineage(ordered.select("host", "class").join(root, "host"))
    classes, small = broadcast_if_small(classes, broadcast_rows)
    own = per.join(classes, ["host", "class"]) if small else skew_join(per, classes, ["host", "class"])
    roots = own.where(F.col("class") == F.col("root")).select("host", "page", F.col("at").alias("marks"))
    gap = lambda pos: F.size(F.filter("marks", lambda m: m < pos))
    inner = (own.where(F.col("class") != F.col("root")).join(roots, ["host", "page"], "left")
                .select("host", "class", gap(F.array_min("at")).alias("lo"), gap(F.array_max("at")).alias("hi")))
    nested = inner.groupBy("host", "class").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo = hi").select("host", "class")
    valid = nested.union(root.select("host", F.col("root").alias("class")))
    text = vec.where("is_text").join(valid, ["host", "class"])
    return text.groupBy("host").agg(F.array_sort(F.collect_list("token")).alias("template"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_hosts: int = 20_000) -> DataFrame:
    """Main text of every page.

    Returns the input's columns without the html, plus ``text`` and ``n_chars`` (code points).  Null html counts as empty
    and has empty text; null or odd urls are one host; repeated rows have equal results; an empty table gives an
    empty result; input columns named like a result are replaced.
    """
    p = drop_clashing(pages, RESULTS)
    keep = [c for c in p.columns if c != html_col]
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    p = p.select(*keep, text_of(html_col).alias("__h"), host.alias("__host"))
    found = cut_lineage(host_templates(p.select(F.col("__host").alias("host"), F.xxhash64("__h").alias("page"), "__h")))
    found = found.withColumnsRenamed({"host": "__host", "template": "__template"})
    found, small = broadcast_if_small(found, broadcast_hosts)
    p = (p.join(found, "__host", "left") if small else skew_join(p, found, ["__host"], "left")).select(*keep, "__h", "__host", "__template")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in p.schema.fields if f.name in keep] + ["text string, n_chars long"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates: dict = {}
        for b in it:
            out = []
            for html, host, template in zip(b.column("__h"), b.column("__host").to_pylist(), b.column("__template")):
                if host not in templates:
                    if len(templates) >= 1000:
                        templates.clear()
                    templates[host] = set(template.as_py() or ())
                out.append(main_text(Page(html.as_py()), templates[host]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], [*keep, *RESULTS])
    return p.mapInArrow(run, schema)
