"""Text and vector columns: trimming and tokens as the retrieval operators use them, similarity, HTML helpers."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\n\r\x0b\x0c"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def search_tokens(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+"), lambda t: t != "")


def joined_fields(keys: list[str]) -> Column:
    return F.concat_ws(" ", *[F.col(k).cast("string") for k in keys])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def literal_vector(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def approx_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def cut_middle(text: Column, limit: int, marker: str = " ... ") -> Column:
    """At most ``limit`` characters: the middle gives way to a marker."""
    half = (limit - len(marker)) // 2
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - len(marker) - half), F.lit(marker), F.right(text, F.lit(half))))


def html_body(html: Column) -> Column:
    """What the body element holds, or all of it without one."""
    body = F.regexp_extract(html, r"(?is)<body[^>]*>(.*?)</body>", 1)
    return F.when(body != "", body).otherwise(html)


_LINKS = {("a", "href"), ("img", "src"), ("link", "href"), ("script", "src"), ("iframe", "src"), ("source", "src"), ("video", "src"), ("audio", "src"), ("form", "action"), ("area", "href")}


class _Absolute(HTMLParser):
    def __init__(self, base: str):
        super().__init__(convert_charrefs=False)
        self.base, self.out = base, []

    def handle_starttag(self, tag, attrs):
        fixed = "".join(f' {k}="{urljoin(self.base, v) if (tag, k) in _LINKS else v}"' if v is not None else f" {k}" for k, v in attrs)
        self.out.append(f"<{tag}{fixed}>")

    def handle_endtag(self, tag):
        self.out.append(f"</{tag}>")

    def handle_data(self, data):
        self.out.append(data)

    def handle_entityref(self, name):
        self.out.append(f"&{name};")

    def handle_charref(self, name):
        self.out.append(f"&#{name};")


def absolute_links(html: str, base: str) -> str:
    p = _Absolute(base)
    p.feed(html)
    p.close()
    return "".join(p.out)


class _Plain(HTMLParser):
    """A small rendering to Markdown: headings, links, list items, paragraphs."""

    def __init__(self):
        super().__init__()
        self.out, self.href, self.skip = [], None, 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            self.out.append("\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag in ("p", "br", "div", "tr"):
            self.out.append("\n")
        elif tag == "a":
            self.href = dict(attrs).get("href")
            self.out.append("[")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip -= 1
        elif tag == "a":
            self.out.append(f"]({self.href or ''})")
        elif tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def to_markdown(html: str) -> str:
    p = _Plain()
    p.feed(html)
    p.close()
    return "".join(p.out).strip()
