"""HTML pages to titles and text."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is no text.
SKIPPED = set("script style head noscript nav footer aside form iframe svg canvas template".split())
BLOCKS = set("p div section article main header blockquote pre table tr ul ol dl figure figcaption body html br hr td th".split())
ITEMS = {"li", "dt", "dd"}


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip: list[str] = []
        self.lines, self.now, self.mark, self.title, self.in_title = [], [], "", "", False

    def end_line(self) -> None:
        line = " ".join("".join(self.now).split())
        if line:
            self.lines.append(self.mark + line)
        self.now, self.mark = [], ""

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self.in_title = True
        if tag in SKIPPED:
            self.skip.append(tag)
        elif tag[0] == "h" and tag[1:].isdigit() and len(tag) == 2:
            self.end_line()
            self.mark = "#" * min(int(tag[1]), 6) + " "
        elif tag in ITEMS:
            self.end_line()
            self.mark = "- "
        elif tag in BLOCKS:
            self.end_line()

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in SKIPPED:
            if tag in self.skip:
                del self.skip[self.skip.index(tag) :]
        elif tag in BLOCKS or tag in ITEMS or (tag[0] == "h" and tag[1:].isdigit()):
            self.end_line()

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip:
            self.now.append(data)


def to_text(html: str | None) -> tuple[str, str]:
    """(title, text): headings as #, items as -, one line per block, inline white space collapsed."""
    p = _Text()
    p.feed(html or "")
    p.close()
    p.end_line()
    return " ".join(p.title.split()), "\n".join(p.lines)


def pages_to_text(pages: DataFrame) -> DataFrame:
    @F.pandas_udf("title string, text string")
    def convert(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for html in parts:
            yield pd.DataFrame([to_text(x) for x in html], columns=["title", "text"])

    return pages.select("page_id", "url", convert("html").alias("t")).select("page_id", "url", "t.title", "t.text")


def strip_tags(html: str) -> str:
    """What stands outside all signs < and >, however they are nested; a > without a < is left out."""
    depth, out = 0, []
    for c in html:
        depth += c == "<"
        if not depth and c != ">":
            out.append(c)
        depth = max(0, depth - (c == ">"))
    return "".join(out)
