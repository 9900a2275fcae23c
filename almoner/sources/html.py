"""Pages: links, tables, plain text, and walks over listings."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HREF = r"""(?i)href\s*=\s*["']([^"'#][^"']*)["']"""


def links(pages: DataFrame, suffixes: tuple[str, ...] = (), key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, link, place: each page's links, absolute, once, by first place; mail, script and telephone links go."""
    found = pages.select(key, url, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(HREF), F.lit(1))).alias("at", "href"))
    kept = found.where(~F.lower("href").rlike(r"^\s*(?:mailto|javascript|tel):"))
    root = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://.*/)", 1)
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    h = F.trim("href")
    whole = F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h).when(h.startswith("//"), F.concat(scheme, h)).when(h.startswith("/"), F.concat(root, h)).otherwise(F.concat(F.when(F.length(folder) > F.length(root), folder).otherwise(F.concat(root, F.lit("/"))), h))
    out = kept.select(key, whole.alias("link"), "at")
    if suffixes:
        out = out.where(F.lower(F.regexp_replace("link", r"[?#].*$", "")).rlike("(?:" + "|".join(x.replace(".", r"\.") for x in suffixes) + ")$"))
    return out.groupBy(key, "link").agg(F.min("at").cast("int").alias("place"))


def plain_text(html: Column | str) -> Column:
    c = F.col(html) if isinstance(html, str) else html
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]+>", " "), r"\s+", " "))


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.open: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append([])
        elif tag == "tr" and self.open:
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open:
            if not self.open[-1]:
                self.open[-1].append([])
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None and self.open:
            self.open[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "table" and self.open:
            self.tables.append(self.open.pop())

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def tables(pages: DataFrame, least: int = 3, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, table, line, cells: the rows of tables of at least so many rows below their header, which is line 0."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, h in zip(f["k"], f["h"], strict=True):
                p = _Tables()
                p.feed(h or "")
                kept = [t for t in p.tables if len([r for r in t if r]) > least]
                rows += [(k, i, j, cells) for i, t in enumerate(kept) for j, cells in enumerate(r for r in t if r)]
            yield pd.DataFrame(rows, columns=[key, "table", "line", "cells"])

    return pages.select(F.col(key).cast("long").alias("k"), F.col(html).cast("string").alias("h")).mapInPandas(run, f"{key} long, table int, line int, cells array<string>")


def pick_table(rows: DataFrame, tokens: list[str], key: str = "page_id") -> DataFrame:
    """key, table: of each page the first table whose header holds all tokens."""
    head = F.lower(F.concat_ws(" ", "cells"))
    hit = F.lit(True)
    for t in tokens:
        hit = hit & F.contains(head, F.lit(t.lower()))
    return rows.where((F.col("line") == 0) & hit).groupBy(key).agg(F.min("table").alias("table"))


def walk(edges: DataFrame, roots: DataFrame, depth: int, within: Column | None = None) -> DataFrame:
    """node, level: what can be reached over edges (node, target) in at most depth steps, at its least level."""
    seen = roots.select("node").distinct().withColumn("level", F.lit(0))
    front = seen
    usable = (edges.where(within) if within is not None else edges).select("node", "target").distinct()
    for level in range(1, depth + 1):
        new = front.join(usable, "node").select(F.col("target").alias("node")).distinct().join(seen, "node", "left_anti")
        front = new.withColumn("level", F.lit(level))
        seen = seen.unionByName(front)
    return seen


def expand_pattern(weeks: DataFrame, pattern: str, accented: str, since: int = 2025) -> DataFrame:
    """url and alternate for each week: the accented form comes first from a year on, the plain one before."""
    at = lambda p: F.format_string(p, F.col("iso_year"), F.col("iso_week"))
    new = F.col("iso_year") >= since
    return weeks.select("iso_year", "iso_week", F.when(new, at(accented)).otherwise(at(pattern)).alias("url"), F.when(new, at(pattern)).otherwise(at(accented)).alias("alternate"))
