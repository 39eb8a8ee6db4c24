"""Main text of web pages by consensus paths of their hosts.

Every page scores its containers: the share of the page's good text that a
container holds, less the links and the boilerplate in it.  A container goes by
its generalised path, the tags and classes down to it with digits made alike and
ids left out.  The pages of a host vote with their scores; the path of most
votes (ties: the shorter one) is the host's, and every page is read again with
it.  A page without such a container uses its own best path.

Text of menus, headers, footers, sidebars, notices, adverts, forms, reader
comments, scripts and styles is left out wherever it stands; such elements are
known by tag, role, or a word of class or id, unless they hold an article.

Defined results for odd input: a null or empty page has empty text; a page
without a container keeps all of its good text; pages without a host take their
own best path; unclosed or cut-off tags end with the page; repeated rows are
read again; very long pages are read whole; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.llm.common import batched, rows_of, written

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|iframe|svg|select|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>"""
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)

# The elements of HTML by their part on a page.
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr img".split()
)
_CONTAINERS = set("body div section article main td center blockquote table tbody tr dl ul ol fieldset".split())
_DROPPED = set("nav header footer aside form button menu dialog head object canvas video audio label".split())
_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
}
_SCOPES = set("table ul ol dl select article section main div body td th".split())
# Words of class or id that mark boilerplate.
_MARKS = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar aside menu "
    "nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar comment comments commentlist disqus reply "
    "replies respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login form search share sharing social related recommended widget pagination pager toolbar".split()
)
_NEGATED = set("has no with without".split())


class Page:
    """Blocks of a page, in order, with the elements around each."""

    def __init__(self, html: str):
        self.parents = [-1]
        self.tags = [""]
        self.paths = [""]
        self.hard = [False]
        self.soft = [False]
        self.core = [False]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters of links
        self._read(html)
        dropped = [False]
        for k in range(1, len(self.tags)):
            dropped.append(dropped[self.parents[k]] or self.hard[k] or (self.soft[k] and not self.core[k]))
        self.dropped = dropped

    def _read(self, html: str) -> None:
        stack, held, linked, links, at = [0], [], 0, 0, 0

        def flush() -> None:
            nonlocal linked
            text = " ".join("".join(held).split())
            if text:
                self.blocks.append((stack[-1], text, min(linked, len(text))))
            held.clear()
            linked = 0

        def close_to(depth: int) -> None:
            nonlocal links
            while len(stack) > depth:
                links -= self.tags[stack.pop()] == "a"

        for token in _TOKEN.finditer(html):
            if token.start() > at:
                text = unescape(html[at : token.start()])
                held.append(text)
                linked += len(text) if links else 0
            at = token.end()
            tag = (token[3] or token[6] or "").lower()
            if not tag:
                continue
            if tag == "br":
                held.append(" ")
                continue
            ends, rest = bool(token[2] or token[5]), token[4] or token[7] or ""
            if ends:
                depth = next((d for d in range(len(stack) - 1, 0, -1) if self.tags[stack[d]] == tag), 0)
                if not depth or tag == "p" and any(self.tags[k] in _SCOPES for k in stack[depth + 1 :]):
                    continue
                if tag not in _INLINE:
                    flush()
                close_to(depth)
                continue
            if tag in _INLINE:
                if tag not in _VOID:
                    self._open(stack, tag, rest)
                    links += tag == "a"
                continue
            flush()
            p = next((d for d in range(len(stack) - 1, 0, -1) if self.tags[stack[d]] in _SCOPES or self.tags[stack[d]] == "p"), 0)
            if p and self.tags[stack[p]] == "p":
                close_to(p)
            if tag in _CLOSED_BY:
                for depth in range(len(stack) - 1, 0, -1):
                    if self.tags[stack[depth]] in _CLOSED_BY[tag]:
                        close_to(depth)
                        break
                    if self.tags[stack[depth]] in _SCOPES:
                        break
            if tag == "body":  # a head that was never closed ends here
                close_to(next((d for d in range(1, len(stack)) if self.tags[stack[d]] == "head"), len(stack)))
            if tag not in _VOID:
                self._open(stack, tag, rest)
        if at < len(html):
            text = unescape(html[at:])
            held.append(text)
            linked += len(text) if links else 0
        flush()

    def _open(self, stack: list[int], tag: str, rest: str) -> None:
        parent, classes, hard, soft = stack[-1], "", tag in _DROPPED, False
        if rest:
            for name, value in _ATTRIBUTE.findall(rest):
                name, value = name.lower(), value.strip("\"'")
                if name == "hidden":
                    hard = hard or not value or value.lower() == "hidden"
                elif name == "role":
                    soft = soft or value.lower() in _ROLES
                else:
                    if name == "class":
                        classes = ".".join(sorted(set(re.sub(r"\d+", "#", value).split())))
                    for label in value.split():
                        words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", label).lower())
                        soft = soft or (not _MARKS.isdisjoint(words) and _NEGATED.isdisjoint(words))
        number = len(self.tags)
        self.parents.append(parent)
        self.tags.append(tag)
        path = self.paths[parent]
        self.paths.append(path if tag in _INLINE else f"{path}/{tag}.{classes}" if classes else f"{path}/{tag}")
        core = tag in ("html", "body", "main", "article")
        self.hard.append(hard)
        self.soft.append(soft and not core)
        self.core.append(core)
        if core and not hard:
            while parent and not self.core[parent]:
                self.core[parent] = True
                parent = self.parents[parent]
        stack.append(number)

    def votes(self) -> dict[str, float]:
        """Score of each container path of the page: at most 1, and only if above 0."""
        scores: dict[str, float] = defaultdict(float)
        whole = 0.0
        for element, text, links in self.blocks:
            bad = self.dropped[element]
            worth = -float(len(text)) if bad else (len(text) - links) * (1 - links / len(text)) - links
            whole += max(0.0, worth)
            seen = set()
            while element > 0:
                path = self.paths[element]
                if self.tags[element] in _CONTAINERS and not self.dropped[element] and path not in seen:
                    seen.add(path)
                    scores[path] += worth
                element = self.parents[element]
        return {path: score / whole for path, score in scores.items() if score > 0 and whole > 0}

    def best(self) -> str | None:
        votes = self.votes()
        return min(votes, key=lambda p: (-round(votes[p], 9), p.count("/"), p)) if votes else None

    def text(self, path: str | None) -> tuple[str, str | None]:
        """The page's text inside the path, and the path that was used."""
        if path is None or path not in self.paths:
            path = self.best()
        kept = []
        for element, text, _ in self.blocks:
            if self.dropped[element]:
                continue
            while path is not None and element > 0 and self.paths[element] != path:
                element = self.parents[element]
            if path is None or element > 0:
                kept.append(text)
        return "\n".join(kept), path


def _with_host(pages: DataFrame) -> DataFrame:
    host = F.regexp_extract(F.lower(F.col("url").cast("string")), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    return pages.select("page_id", "url", F.when(host != "", host).alias("host"), html)


def host_paths(pages: DataFrame) -> DataFrame:
    """Rows (host, path, votes): the winning path of each host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for host, html in rows_of(batches):
                for path, score in Page(html).votes().items():
                    yield host, path, round(score * 1_000_000)

        yield from batched(rows(), pa.schema([("host", pa.string()), ("path", pa.string()), ("score", pa.int64())]), 20_000)

    votes = _with_host(pages).filter("host is not null").select("host", "html").mapInArrow(run, "host string, path string, score long")
    sums = votes.groupBy("host", "path").agg(F.sum("score").alias("votes"))
    depth = F.size(F.split("path", "/"))
    best = F.max(F.struct("votes", -depth, "path"))
    return sums.groupBy("host").agg(best.alias("best")).select("host", "best.path", "best.votes")


def main_text(pages: DataFrame) -> DataFrame:
    """Per page row: page_id, url, host, path and text."""
    winners = written(host_paths(pages), "host_paths").select(F.col("host").alias("of"), F.col("path").alias("host_path"))
    rows = _with_host(pages)
    joined = rows.join(winners, F.col("host") == F.col("of"), "left").select("page_id", "url", "host", "html", "host_path")
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                pairs = zip(part.column(3).to_pylist(), part.column(4).to_pylist())
                found = [Page(html).text(path) for html, path in pairs]
                texts = [pa.array([x[k] for x in found], pa.string()) for k in (1, 0)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *texts], ["page_id", "url", "host", "path", "text"])

    return joined.mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, host string, path string, text string")
