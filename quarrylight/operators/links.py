"""Links to videos in pages: from tags, from addresses in the text, from data of social sites, from streaming manifests."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import strings as S
from quarrylight.functions.arrays import first_of_each
from quarrylight.shipping import ship

#: Endings of videos, names of sites and the fields in which they keep an address, what marks promotion, the
#: least length of a page, the most links of a list.
VIDEO = ("mp4", "avi", "mov", "wmv", "flv", "webm", "mkv", "m4v")
SITES = (("Facebook", "(?:hd_src|sd_src)"), ("Instagram", "video_url"), ("Tiktok", "playAddr"))
PROMOTION = "add_to_home"
LEAST_PAGE = 1000
MOST_LISTED = 10

HREF = r"""href="([^"]+)\""""
LINK = "array<struct<url:string,title:string,format:string,quality:string>>"
_END = r"""[^\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"'>]"""
_KINDS = "|".join(VIDEO)
EMBEDDED = ((rf"(?i)https?://{_END}+\.(?:{_KINDS})", 0), (rf'(?i)"(https?://[^"]+\.(?:{_KINDS}))"', 1), (rf"(?i)'(https?://[^']+\.(?:{_KINDS}))'", 1))
STREAMING = tuple((rf"(?i)https?://{_END}+\.{k}{_END}*", 0) for k in ("m3u8", "mpd")) + tuple((rf'(?i)"(https?://[^"]+\.{k}[^"]*)"', 1) for k in ("m3u8", "mpd"))


class _Element:
    def __init__(self, name: str, up: _Element | None):
        self.name, self.up, self.text = name, up, []


class _Videos(HTMLParser):
    """Collects the addresses in video tags and in source tags inside them. An open video reaches to its end tag, or to the
    end of what holds it; a title is the text around the video, if it is short."""

    VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
    SILENT = frozenset(("script", "style", "template"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = self.now = _Element("", None)
        self.open: dict[str, int] = {}
        self.found: list[tuple[_Element, str, str, str, bool]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own = dict(attrs)
        src = own.get("src") or ""
        element = _Element(tag, self.now)
        if tag == "video" and src:
            self.found.append((element, src, "mp4", "unknown", False))
        if tag == "source" and src:
            at = self.now
            while at is not None and at.name != "video":
                at = at.up
            if at is not None:
                quality = own.get("data-quality")
                self.found.append((at, src, (own.get("type") or "mp4").split("/")[-1], "unknown" if quality is None else quality, True))
        if tag not in self.VOID:
            self.now = element
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in self.VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        while self.open.get(tag):
            name, self.now = self.now.name, self.now.up
            self.open[name] -= 1
            if name == tag:
                break

    def handle_data(self, data: str) -> None:
        data = data.strip()
        if data and self.now.name not in self.SILENT:
            at = self.now
            while at is not None:  # every element holds all text inside it, up to what could still be a title
                if sum(map(len, at.text)) < 100:
                    at.text.append(data)
                at = at.up


def _title(element: _Element, otherwise: str) -> str:
    text = "".join(element.up.text)
    lines = [x.strip() for x in text.split("\n") if x.strip()] if len(text) < 100 else []
    return lines[0][:50] if lines else otherwise


def tagged_videos(html: str | None, base: str | None) -> list[tuple[str, str, str, str]]:
    """(url, title, format, quality) of the video and source tags of a page, in order. A source's own sources of a video in a
    video belong to the inner one. Promotion is left out."""
    parser = _Videos()
    parser.feed(html or "")
    parser.close()
    kept = [x for x in parser.found if PROMOTION not in x[1]]
    return [(urljoin(base or "", src), _title(at, f"Video {n}") if source else f"Video {n}", kind, quality) for n, (at, src, kind, quality, source) in enumerate(kept, 1)]


def _tagged(html: Column, base: Column) -> Column:
    """tagged_videos of the pages with a video tag; other pages are not sent to Python."""

    @F.pandas_udf(LINK)
    def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        names = ("url", "title", "format", "quality")
        for pages, bases in batches:
            yield pd.Series([[dict(zip(names, x)) for x in tagged_videos(h, b)] if h else [] for h, b in zip(pages, bases)], dtype=object)

    return found(F.when(html.rlike(r"(?i)<video\b"), html), base)


def _all(html: Column, patterns) -> Column:
    return F.concat(*(F.coalesce(F.regexp_extract_all(html, F.lit(p), F.lit(g)), F.array().cast("array<string>")) for p, g in patterns))


def _link(url: Column, title: Column, kind: Column, quality: str) -> Column:
    return F.struct(url.alias("url"), title.alias("title"), kind.alias("format"), F.lit(quality).alias("quality"))


def embedded_videos(html: Column) -> Column:
    urls = F.filter(_all(html, EMBEDDED), lambda u: ~u.contains(PROMOTION))
    kind = lambda u: F.lower(F.substring_index(F.substring_index(u, ".", -1), "?", 1))
    return F.transform(urls, lambda u, i: _link(u, F.concat(F.lit("Embedded Video "), (i + 1).cast("string")), kind(u), "unknown"))


def social_videos(html: Column) -> Column:
    of = lambda name, field: F.transform(_all(html, ((rf'"{field}":\s*"([^"]+)"', 1),)), lambda u: _link(S.plain_url(u), F.lit(f"{name} Video"), F.lit("mp4"), "unknown"))
    return F.concat(*(of(name, field) for name, field in SITES))


def streaming_videos(html: Column) -> Column:
    kind = lambda u: F.when(u.contains(".m3u8"), "hls").otherwise("dash")
    return F.transform(_all(html, STREAMING), lambda u: _link(u, F.concat(F.lit("Streaming Video ("), F.upper(kind(u)), F.lit(")")), kind(u), "adaptive"))


def listed(links: Column, most: int = MOST_LISTED) -> Column:
    """The first links of a list; the feature of a fallback that reads lists."""
    return F.slice(links, 1, most)


def anchors(html: Column) -> Column:
    """The targets of a page's links as a fallback's links."""
    return F.transform(_all(html, ((HREF, 1),)), lambda u: _link(u, F.lit("Link"), F.lit("unknown"), "unknown"))


def long_enough(pages: DataFrame, least: int = LEAST_PAGE) -> DataFrame:
    """Pages of more characters than that; shorter ones are refusals and errors."""
    return pages.filter(F.length("html") > least)


def video_links(pages: DataFrame, fallback=None) -> DataFrame:
    """(page_id, ord, url, title, format, quality) of pages (page_id, url, html): links of the four kinds in turn, only the first
    of each address on a page. fallback(html) gives the links of pages that have none otherwise.

    A page is one row, so its order and its distinct addresses are array work, without a shuffle. A null page has none.
    """
    ship(pages.sparkSession)
    html = F.col("html")
    tagged = pages.select("page_id", F.col("url").alias("base"), "html", _tagged(html, F.col("url")).alias("tagged"))
    found = tagged.select("page_id", "base", "html", F.concat("tagged", embedded_videos(html), social_videos(html), streaming_videos(html)).cast(LINK).alias("links"))
    if fallback is not None:
        found = found.withColumn("links", F.when(F.size("links") > 0, F.col("links")).otherwise(fallback(html).cast(LINK)))
    out = found.select("page_id", F.posexplode(first_of_each(F.col("links"), "url")).alias("pos", "x"))
    return out.select("page_id", (F.col("pos") + 1).alias("ord"), "x.*")
