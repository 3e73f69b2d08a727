"""Readable text of HTML pages, as an Arrow UDF on the standard parser."""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTENT = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("markdown", T.StringType()),
    T.StructField("text_length", T.IntegerType()), T.StructField("link_density", T.DoubleType()),
])

# Elements whose content is not part of the page body.
SKIPPED = {"script", "style", "noscript", "iframe", "nav", "header", "footer", "aside", "form"}
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
}
BLOCKS = {"p", "div", "section", "article", "ul", "ol", "table", "tr", "blockquote", "pre"}


class BodyText(HTMLParser):
    """Collects text nodes, links and simple markdown of the body."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.open: Counter = Counter()  # open elements by tag
        self.skipping = 0  # open elements whose content is skipped
        self.nodes: list[tuple[bool, str]] = []
        self.marks: list[tuple[bool, str]] = []
        self.links = [0, 0]
        self.open_text: list[str] = []
        self.saw_body = False
        self.href: list[str] = []

    def _flush(self) -> None:
        text = "".join(self.open_text).strip()
        self.open_text = []
        if text and not self.skipping:
            inside = self.open["body"] > 0
            self.nodes.append((inside, text))
            self.marks.append((inside, " ".join(text.split())))

    def _mark(self, mark: str) -> None:
        if not self.skipping:
            self.marks.append((self.open["body"] > 0, mark))

    def handle_starttag(self, tag, attrs):
        self._flush()
        if tag == "body":
            self.saw_body = True
        if tag == "a" and not self.skipping:
            self.links[1 if self.open["body"] else 0] += 1
            self.href.append(dict(attrs).get("href") or "")
            self._mark("[")
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self._mark("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self._mark("\n* ")
        elif tag in BLOCKS:
            self._mark("\n\n")
        elif tag == "br":
            self._mark("\n")
        if tag not in VOID:
            self.stack.append(tag)
            self.open[tag] += 1
            self.skipping += tag in SKIPPED

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        if tag == "a" and self.href and not self.skipping:
            self._mark(f"]({self.href.pop()})")
        while self.open[tag]:
            closed = self.stack.pop()
            self.open[closed] -= 1
            self.skipping -= closed in SKIPPED
            if closed == tag:
                break
        if tag in BLOCKS or (len(tag) == 2 and tag[0] == "h" and tag[1] in "123456"):
            self._mark("\n\n")

    def handle_data(self, data):
        self.open_text.append(data)

    def handle_comment(self, data):
        self._flush()

    def result(self) -> tuple[str, str, int, float]:
        self._flush()
        keep = lambda pairs: [t for inside, t in pairs if inside or not self.saw_body]
        text = " ".join(keep(self.nodes))
        markdown = ""
        for mark in keep(self.marks):
            glue = "" if not markdown or markdown[-1] in "\n [" or mark[0] in "\n]" else " "
            markdown += glue + mark
        lines = [line.rstrip() for line in markdown.replace("[ ", "[").splitlines()]
        folded: list[str] = []
        for line in lines:
            if line or (folded and folded[-1]):
                folded.append(line)
        links = self.links[1] if self.saw_body else sum(self.links)
        return text, "\n".join(folded).strip(), len(text), links / max(len(text.split()), 1)


@F.pandas_udf(CONTENT)
def extract_content(html: pd.Series) -> pd.DataFrame:
    """``struct(text, markdown, text_length, link_density)`` of a page."""
    rows = []
    for page in html.fillna(""):
        parser = BodyText()
        parser.feed(page)
        parser.close()
        rows.append(parser.result())
    return pd.DataFrame(rows, columns=["text", "markdown", "text_length", "link_density"])
