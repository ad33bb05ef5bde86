"""HTML -> plain Markdown-like text."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


class _Reader(HTMLParser):
    _HIDDEN, _BREAKS = {"script", "style", "title"}, {"p", "div", "br", "li", "tr", "table", "ul", "ol", "section", "article", "header", "footer"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.parts, self._in = "", [], []

    def handle_starttag(self, tag, attrs):
        if tag in self._HIDDEN:
            self._in.append(tag)
        elif re.fullmatch(r"h[1-6]", tag):
            self.parts.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in self._BREAKS:
            self.parts.append("\n" + ("* " if tag == "li" else ""))

    def handle_endtag(self, tag):
        if self._in and tag == self._in[-1]:
            self._in.pop()
        elif re.fullmatch(r"h[1-6]", tag) or tag in self._BREAKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self._in:
            self.parts.append(data)
        elif self._in[-1] == "title":
            self.title += data


def to_markdown(html: str) -> str:
    """Scripts and styles dropped, the title as a heading, runs of empty lines as one."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    body = "\n".join(line.strip() for line in "".join(reader.parts).splitlines())
    head = f"# {reader.title.strip()}\n\n" if reader.title.strip() else ""
    return re.sub(r"\n{2,}", "\n\n", head + body).strip()


@F.pandas_udf(StringType())
def markdown(html: pd.Series) -> pd.Series:
    return html.map(lambda h: None if h is None else to_markdown(h))
