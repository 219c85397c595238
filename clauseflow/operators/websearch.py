"""Search results: pages of two engines read into hits, hits resolved, cleaned and deduplicated, results as a block of text.

Parsing goes over the element tree that the main-text reader builds, so damaged markup is taken as it is there.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from urllib.parse import parse_qs, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseflow.functions.text import url_key
from clauseflow.session import share_package
from clauseflow.sources.html import Node, decode_entities, own_text, parse

# engines' addresses, class names of their pages, schemes that are no addresses, signs of a blocked request.
BASES = {"duckduckgo": "https://html.duckduckgo.com/html/", "bing": "https://www.bing.com/search"}
_RESULT, _TITLE, _SNIPPET = {"result", "web-result"}, {"result__a", "result-link"}, {"result__snippet", "result-snippet"}
_CAPTION = {"b_lineclamp", "b_snippet", "b_algoSlug", "b_paractl"}
_NO_ADDRESS = re.compile(r"(?:javascript|data|vbscript|file|blob|about|chrome|chrome-extension|mailto|tel|sms|ftp)\s*:", re.I)
BLOCKED = "(?i)anomaly-modal|unusual traffic|detected unusual|are you a robot|enable javascript and cookies|cf-browser-verification|captcha"
_INVISIBLE = re.compile("[​-‏﻿]")
_SILENT = {"script", "style", "noscript", "template", "svg"}
_APART = {"p", "div", "li", "ul", "ol", "tr", "td", "th", "table", "thead", "tbody", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "blockquote", "pre", "dd", "dt", "dl", "figcaption", "figure", "main", "aside", "nav", "form", "br"}
NO_TITLE, BLOCK_CHARS, MAX_RESULTS = "(无标题)", 4000, 8
HIT = "ord int, href string, title string, snippet string, base string"


def plain(node: Node | None) -> str:
    """An element's text on one line, blocks set apart."""
    parts: list[str] = []
    stack: list = [node] if node else []
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            parts.append(decode_entities(n))
        elif n.tag not in _SILENT:
            if n.tag in _APART:
                parts.append(" ")
                stack.append(" ")
            stack.extend(reversed(n.children))
    return " ".join("".join(parts).split())


def _all(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        n = stack.pop()
        yield n
        stack.extend(c for c in reversed(n.children) if isinstance(c, Node))


def _classes(n: Node) -> set[str]:
    return set(n.attrs.get("class", "").split())


def _first(root: Node, test) -> Node | None:
    return next((n for n in _all(root) if n is not root and test(n)), None)


def hits(html: str | None, engine: str) -> list[tuple[str, str, str]]:
    """(href, title, snippet) of a result page: by its result blocks, or by its title links where it has no such blocks."""
    root = parse(html or "")
    link = lambda n: n.tag == "a" and bool(n.attrs.get("href"))
    out = []
    if engine == "duckduckgo":
        titled = lambda n: link(n) and bool(_classes(n) & _TITLE)
        told = lambda n: bool(_classes(n) & _SNIPPET)
        blocks = [n for n in _all(root) if n.tag == "div" and _classes(n) & _RESULT and not any(c.startswith("result--ad") for c in _classes(n))]
        found = [(_first(b, titled), _first(b, told)) for b in blocks]
        found = [x for x in found if x[0]] or [(n, None) for n in _all(root) if titled(n)]
    else:
        blocks = [n for n in _all(root) if n.tag in ("li", "div") and "b_algo" in _classes(n)]
        found = []
        for b in blocks or [n for n in _all(root) if n.tag == "h2"]:
            head = _first(b, lambda n: n.tag == "h2")
            title = _first(head, link) if head else None
            told = _first(b, lambda n: n.tag == "p") or _first(b, lambda n: bool(_classes(n) & _CAPTION)) or _first(b, lambda n: "b_caption" in _classes(n))
            found.append((title or _first(b, link), told))
    seen = set()
    for title, snippet in found:
        if title is not None and id(title) not in seen:  # a block within a block has the same link
            seen.add(id(title))
            out.append((title.attrs["href"], plain(title), plain(snippet)))
    return out


def _http(url: str) -> str:
    p = urlsplit(url)
    return url if p.scheme.lower() in ("http", "https") and p.hostname else ""


def resolve(href: str | None, base: str) -> str:
    """The address a result leads to, behind the engines' redirects; '' for what leads to none, the engines' own pages included."""
    h = _INVISIBLE.sub("", decode_entities(href or "").strip()).strip("\"'<>")
    if not h or _NO_ADDRESS.match(h):
        return ""
    try:
        url = _http(urljoin(base, h))
        if not url:
            return ""
        p = urlsplit(url)
        host, query = p.hostname.lower(), parse_qs(p.query)
        if host == "duckduckgo.com" or host.endswith(".duckduckgo.com"):
            target = (query.get("uddg") or query.get("u") or [""])[0]
            return _http(target) if p.path.startswith("/l/") else ""
        if host == "bing.com" or host.endswith(".bing.com"):
            token = (query.get("u") or [""])[0].removeprefix("a1")
            return _http(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)).decode()) if p.path.startswith("/ck/a") else ""
        return url
    except ValueError:
        return ""


def read_results(pages: DataFrame) -> DataFrame:
    """pages (query_id, engine, html) as rows of HIT per query, blocked pages without any; null pages have none."""
    share_package(pages.sparkSession)

    @F.pandas_udf("array<struct<href:string,title:string,snippet:string>>")
    def read(html: pd.Series, engine: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("href", "title", "snippet"), x, strict=True)) for x in hits(h, e)] for h, e in zip(html, engine, strict=True)])

    base = F.element_at(F.create_map(*(F.lit(v) for kv in BASES.items() for v in kv)), F.col("engine"))
    open_ = pages.where(~F.coalesce(F.substring("html", 1, 20_000).rlike(BLOCKED), F.lit(False)))
    x = open_.select("query_id", base.alias("base"), F.posexplode(read("html", "engine")).alias("ord", "x"))
    return x.select("query_id", "ord", "x.href", "x.title", "x.snippet", "base")


def normalize_hits(found: DataFrame) -> DataFrame:
    """found (query_id and HIT) with url, key and status: kept, invalid, untitled or repeated, in this order of tests."""
    share_package(found.sparkSession)

    @F.pandas_udf("string")
    def resolved(href: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series([resolve(h, b) for h, b in zip(href, base, strict=True)])

    x = found.withColumn("url", resolved("href", "base")).withColumn("key", url_key(F.col("url")))
    status = F.when(F.col("url") == "", F.lit("invalid")).when(F.coalesce(F.trim("title"), F.lit("")) == "", F.lit("untitled"))
    x = x.withColumn("status", status)
    good = F.col("status").isNull()
    again = F.row_number().over(Window.partitionBy("query_id", good, "key").orderBy("ord")) > 1
    return x.withColumn("status", F.when(good & again, F.lit("repeated")).when(good, F.lit("kept")).otherwise(F.col("status")))


def results(normalized: DataFrame, most: int = MAX_RESULTS) -> DataFrame:
    """query_id, results (title, url, snippet; the first `most` kept) and how many were repeated, invalid and untitled."""
    kept = F.when(F.col("status") == "kept", F.struct("ord", "title", "url", "snippet"))
    per = normalized.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(kept)), 1, most).alias("x"), *(F.count_if(F.col("status") == s).alias(s) for s in ("repeated", "invalid", "untitled")))
    return per.select("query_id", F.transform("x", lambda r: F.struct(r["title"].alias("title"), r["url"].alias("url"), r["snippet"].alias("snippet"))).alias("results"), "repeated", "invalid", "untitled")


def block(found: Column, most: int = BLOCK_CHARS) -> Column:
    """Results as numbered text of at most so many characters, with a note where it is cut."""
    text = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    shown = F.filter(found, lambda r: (text(r["title"]) != "") | (text(r["url"]) != ""))
    line = lambda c: F.when(text(c) != "", F.concat(F.lit("\n    "), text(c))).otherwise(F.lit(""))
    one = lambda r, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(F.nullif(text(r["title"]), F.lit("")), F.lit(NO_TITLE)), line(r["url"]), line(r["snippet"]))
    full = F.array_join(F.transform(shown, one), "\n\n")
    note = F.concat(F.lit("\n\n…（内容已截断：共 "), F.size(shown).cast("string"), F.lit(f" 条结果，仅显示前 {most} 字符）"))
    cut = F.concat(F.regexp_replace(F.substring(full, F.lit(1), F.greatest(F.lit(most) - F.length(note), F.lit(0))), r"\s+$", ""), note)
    return F.when(F.length(full) <= most, full).when(F.length(note) >= most, F.substring(full, 1, most)).otherwise(cut)
