"""Main text of pages by a site style tree.

The pages of a host are merged into one tree. An element node is the path of labels (tag,
classes, id without digits) from the root; pages that have it add to it

* a style: the run of labels below it, repeats folded, and
* contents: the text it holds itself, block by block.

A node with styles has the entropy of their distribution, to the base of its number of
pages, as importance: what is laid out alike everywhere says little. A node with content
has one less the mean of ``log_m(pages with the same content)``: what stands on every page
says nothing, what stands on one page only says most. A node on one page has importance 1.
A branch in which no node reaches ``THRESHOLD`` is cut from every page of the host, inside
``article`` and ``main`` as well.

Pages of a host with the same content are one page of the tree, so copies do not erase each
other. The content is the text of the ``article`` or ``main`` elements, else all text
outside chrome.

What a page says of itself counts before the statistics: elements that are chrome by tag or
by a class or id word are cut, and a page with ``article`` or ``main`` gives its text only
from there.

Nodes meet by (host, path), counted map-side, never by host; no task holds a site.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import keep
from corvane.llm.url_filter import host_and_path

THRESHOLD = 0.3
BROADCAST_NODES = 500_000
FLUSH = 200_000
PAGE = 2  # kind of the rows that stand for a page's content

# Chrome by tag; words of a class or id that mark chrome; block elements.
CHROME_TAGS = {"nav", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "object", "svg", "button", "select", "textarea", "dialog", "head", "menu"}
CHROME_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "sidebar", "side", "menu", "nav", "navbar", "navigation", "breadcrumb",
    "breadcrumbs", "header", "masthead", "footer", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "share",
    "sharing", "social", "related", "recommended", "comment", "comments", "respond", "replies", "disqus", "widget", "toolbar", "pagination", "pager", "skip"}
CHROME_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
MAIN_TAGS = {"article", "main"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5",
    "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "caption", "ul"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp"}
# an open element of the value is closed by the key
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/><]*+)((?:[^>"'<]|"[^"<]*+"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][^\s/><]*+)([^>]*+)>|</?[a-zA-Z][^>]*+\Z""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")


class Page:
    """Elements of a page in order: parent, label, path, whether chrome or main; and its blocks."""

    def __init__(self, text: str, paths: dict) -> None:
        self.parent, self.label, self.path, self.chrome, self.main = [-1], ["#"], [0], [False], [False]
        self.own: list[tuple[int, str]] = []  # (element, text of one block)
        self._parse(text, paths)

    def _parse(self, text: str, paths: dict) -> None:
        stack, tags = [0], ["#"]
        open_tags: Counter = Counter()
        pending: list[tuple[int, str]] = []
        at, end = 0, len(text)

        def flush() -> None:
            if pending:
                whole = " ".join(entities.unescape("".join(t for _, t in pending)).split())
                if whole:
                    self.own.append((pending[0][0], whole))
                pending.clear()

        def close(count: int) -> None:
            for _ in range(count):
                stack.pop()
                open_tags[tags.pop()] -= 1

        while at < end:
            m = _TAG.search(text, at)
            if m is None:
                pending.append((stack[-1], text[at:]))
                break
            if m.start() > at:
                pending.append((stack[-1], text[at : m.start()]))
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                continue
            tag = name.lower()
            if m[1] or m[4]:
                if tag in BLOCKS:
                    flush()
                elif tag in ("td", "th"):
                    pending.append((stack[-1], " "))
                if open_tags[tag]:
                    down = len(tags) - 1 - next(i for i in range(len(tags) - 1, -1, -1) if tags[i] == tag)
                    close(down + 1)
                continue
            if tag in BLOCKS:
                flush()
                if open_tags["p"]:
                    close(len(tags) - next(i for i in range(len(tags) - 1, -1, -1) if tags[i] == "p"))
            elif tag in ("br", "td", "th"):
                pending.append((stack[-1], " "))
            if tag in CLOSES:
                while tags[-1] in CLOSES[tag]:
                    close(1)
            if tag in VOID:
                continue
            stack.append(self._element(stack[-1], tag, m[3] or m[6] or "", paths))
            tags.append(tag)
            open_tags[tag] += 1
            if tag in RAW:
                stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(text, at)
                at = stop.end() if stop else end
                close(1)
        flush()

    def _element(self, parent: int, tag: str, attributes: str, paths: dict) -> int:
        label, chrome, main = tag, tag in CHROME_TAGS, tag in MAIN_TAGS
        if attributes and not attributes.isspace():
            words: list[str] = []
            for m in _ATTRIBUTE.finditer(attributes):
                key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if key == "role":
                    main |= value == "main"
                    chrome |= value in CHROME_ROLES
                elif key == "hidden":
                    chrome |= not value or value == "hidden"
                else:
                    words += value.split()
            if words:
                label = ".".join([tag, *sorted(_DIGITS.sub("", w) for w in words)])
                if not main and tag not in ("html", "body"):
                    chrome |= any(not CHROME_WORDS.isdisjoint(_WORD.findall(w)) for w in words)
        inside = self.main[parent]
        if tag == "header" and not inside:
            chrome = True
        path = paths.get((self.path[parent], label))
        if path is None:
            path = paths[self.path[parent], label] = xxhash.xxh64_intdigest(label, self.path[parent]) >> 1
        self.parent.append(parent), self.label.append(label), self.path.append(path)
        self.chrome.append(chrome or self.chrome[parent]), self.main.append(main or inside)
        return len(self.parent) - 1

    def facts(self) -> set[tuple[int, int, int, int]]:
        """(path, parent's path, 0 style or 1 content, key) of this page, outside chrome."""
        below: dict[int, list[str]] = {}
        for i in range(1, len(self.parent)):
            if not self.chrome[i]:
                kin = below.setdefault(self.parent[i], [])
                if not kin or kin[-1] != self.label[i]:
                    kin.append(self.label[i])
        parent_path = lambda i: self.path[self.parent[i]] if i else -1
        digest = lambda s: xxhash.xxh64_intdigest(s) >> 1
        out = {(self.path[i], parent_path(i), 0, digest(" ".join(kin))) for i, kin in below.items() if not self.chrome[i]}
        return out | {(self.path[i], parent_path(i), 1, digest(t)) for i, t in self.own if not self.chrome[i]}

    def has_main(self) -> bool:
        return any(m and not c for m, c in zip(self.main, self.chrome))

    def content(self) -> int:
        """Digest of the text outside chrome, of the main elements if there are any."""
        has_main = self.has_main()
        return xxhash.xxh64_intdigest("\n".join(t for i, t in self.own if not self.chrome[i] and (self.main[i] or not has_main))) >> 1

    def main_text(self, noise: set[int]) -> str:
        """Blocks outside chrome and noise, from the main elements if there are any."""
        has_main = self.has_main()
        cut = [False] * len(self.parent)
        for i in range(1, len(self.parent)):
            cut[i] = self.chrome[i] or cut[self.parent[i]] or self.path[i] in noise
        kept = [t for i, t in self.own if not cut[i] and (self.main[i] or not has_main)]
        if not kept and noise:  # never leave a page with nothing for being like others
            kept = [t for i, t in self.own if not self.chrome[i] and (self.main[i] or not has_main)]
        return "\n".join(kept)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The (host, path, parent, kind, key, content) of a task's pages, and one of kind ``PAGE`` for each content."""
    found: set = set()
    paths: dict = {}

    def rows() -> pa.RecordBatch:
        keys = list(found)
        columns = [pa.array([k[i] for k in keys], pa.string() if i == 0 else pa.int64()) for i in range(6)]
        batch = pa.RecordBatch.from_arrays(columns, names=["host", "path", "parent", "kind", "key", "content"])
        found.clear()
        return batch

    for batch in batches:
        for host, text in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            if text:
                page = Page(text, paths)
                content = page.content()
                found.update((host, *fact, content) for fact in page.facts())
                found.add((host, 0, -1, PAGE, 0, content))
            if len(found) >= FLUSH:
                yield rows()
            if len(paths) >= FLUSH:
                paths.clear()
    if found:
        yield rows()


def node_importance(pages: DataFrame) -> DataFrame:
    """``(host, path, parent, pages, importance)`` of the nodes of every host's tree; ``pages (host, html)``.

    Pages of a host with the same content count once, in ``pages`` and everywhere.
    """
    facts = pages.mapInArrow(_facts, "host string, path bigint, parent bigint, kind bigint, key bigint, content bigint").distinct()
    counted = keep(facts.groupBy("host", "path", "parent", "kind", "key").agg(F.count(F.lit(1)).alias("n")), "style-facts")
    sizes = counted.filter(F.col("kind") == PAGE).select("host", F.col("n").alias("pages"))
    x = F.col("n")
    sums = counted.filter(F.col("kind") != PAGE).groupBy("host", "path", "parent").agg(
        F.sum(F.when(F.col("kind") == 0, x)).alias("styled"), F.sum(F.when(F.col("kind") == 0, x * F.log(x))).alias("style_logs"),
        F.sum(F.when(F.col("kind") == 1, x)).alias("held"), F.sum(F.when(F.col("kind") == 1, x * F.log(x))).alias("content_logs"))
    m = F.log(F.col("pages").cast("double"))
    # sum of -p log p over styles; mean of log c over contents; both to the base of the pages
    style = F.when(F.col("styled") > 0, (F.log("styled") - F.col("style_logs") / F.col("styled")) / m)
    content = F.when(F.col("held") > 0, 1 - F.col("content_logs") / F.col("held") / m)
    importance = F.when(F.col("pages") <= 1, 1.0).otherwise(F.greatest(F.coalesce(style, F.lit(0.0)), F.coalesce(content, F.lit(0.0))))
    return sums.join(sizes, "host").select("host", "path", "parent", "pages", importance.alias("importance"))


def noise_nodes(importance: DataFrame, threshold: float = THRESHOLD, rounds: int = 60) -> DataFrame:
    """``(host, noise)``: paths whose whole branch stays below ``threshold``.

    Important nodes mark what is above them by jumps that double each round, so a branch of
    any depth is marked in the logarithm of it; ``rounds`` only guards against a fault and raises.
    """
    nodes = keep(importance, "style-nodes")
    marked = nodes.filter(F.col("importance") >= threshold).select("host", "path")
    jumps = nodes.filter(F.col("parent") != -1).select("host", "path", F.col("parent").alias("up"))
    for _ in range(rounds):
        above = marked.join(jumps, ["host", "path"]).select("host", F.col("up").alias("path"))
        marked = keep(marked.unionByName(above).distinct(), "style-marked")
        jumps = keep(jumps.join(jumps.select("host", F.col("path").alias("up"), F.col("up").alias("next")), ["host", "up"]).select("host", "path", F.col("next").alias("up")), "style-jumps")
        if jumps.isEmpty():
            break
    else:
        raise RuntimeError("the marks of the style tree did not settle")
    noise = nodes.join(marked, ["host", "path"], "left_anti")
    return noise.groupBy("host").agg(F.collect_set("path").alias("noise"))


def _texts(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths: dict = {}
        for batch in batches:
            texts = [Page(t, paths).main_text(set(n or ())) if t else "" for t, n in zip(batch.column("html").to_pylist(), batch.column("noise").to_pylist())]
            if len(paths) >= FLUSH:
                paths.clear()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*names, "text", "n_chars"])

    return run


def main_texts(pages: DataFrame, carry: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """The columns ``carry`` of every row of ``pages (url, html)``, with ``text`` and ``n_chars``.

    A null or empty page has an empty text. Pages whose url has no host form one site.
    Character references are decoded once, white space of a block is folded, blocks are in page
    order. Pages with the same content count once in the tree and give one result each; columns with
    the names of the results are replaced; an empty table gives no rows.
    """
    names = [c for c in carry if c not in ("text", "n_chars")]
    host, _ = host_and_path(F.col("url"))
    noise = keep(noise_nodes(node_importance(pages.select(host.alias("host"), "html")), threshold), "style-noise")
    rows = pages.select(*[F.col(c).alias(f"_{c}") for c in names], host.alias("host"), "html")
    size = noise.agg(F.coalesce(F.sum(F.size("noise")), F.lit(0))).first()[0]
    met = rows.join(F.broadcast(noise) if size <= BROADCAST_NODES else noise, "host", "left")
    met = met.select(*[F.col(f"_{c}").alias(c) for c in names], *(["html"] if "html" not in names else []), "noise")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*names).schema.fields)
    return met.mapInArrow(_texts(names), f"{schema}, text string, n_chars bigint" if names else "text string, n_chars bigint")
