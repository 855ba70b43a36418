"""Operator 4: main text of web pages by consensus host paths.

Pages of one host share a template. Every page's containers are scored by the text they hold; each page votes, with the shares of its
score, for generalised paths (tags and classes from body down, digits struck out); votes are summed by (host, path) in Spark, and
pages are read again with the path that won on their host. A page without that path, or with nothing in it, takes its own best container. From
there the article is followed outwards, over the containers that it is spread over (Page._whole).

Tags of what isn't text (scripts, menus, footers) are left out. Names (class, id) are only a hint, as anyone may name an article "no-comments" or "share-of-market" (a name counts if its last telling word does):
what is inside a container named like a comment list, an advert or a form counts for MARKED of its score, once for each such container around it.
Where the host's path lies inside such a container or is one, the name says nothing; marked parts further in are left out of the text.

Votes are sums, added up within a task before they meet, so a host of a third of all pages sends as much as any other. For the second
reading the winners (one row a host) are broadcast if there are BROADCAST_HOSTS at most; beyond that, pages and winners are joined by host
and one of SALTS salts, so a hot host is dealt out.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.llm.checkpoints import cut
from quillmatch.llm.workers import sparing

#: A comment, a declaration, or the beginning of a tag up to its name.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)", re.DOTALL)
GAP, NAME, EQUALS, PLAIN = (re.compile(p) for p in (r"[\s/]*", r"=?[^\s/>=]*", r"\s*=\s*", r"[^\s>]*"))
NAME_PART = re.compile(r"[A-Za-z]+")
DIGITS = re.compile(r"\d+")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"

BROADCAST_HOSTS = 1 << 18
#: Share of the score that text in a container with such a name counts.
MARKED = 0.1
#: A container beside the article's, both at the top of the body, belongs to it if it has more than this share of its letters.
SIBLING = 0.25
BODY = "/body"
#: Levels of a path that are spelled out; a digest stands for those above.
LEVELS = 32
SALTS = 32
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Text up to the end tag, whatever it looks like.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article main section div td body blockquote center".split())
#: Start tags that end an open element: tag -> (ended tags, where the search stops).
_CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
CLOSES = {tag: tuple(tuple(x.split()) for x in pair) for tag, pair in _CLOSES.items()}
ANY_BLOCK = "<block>"
NOT_TEXT = frozenset("aside button canvas datalist dialog footer frame frameset head iframe input label link menu meta nav noframes noscript object script search select style svg template textarea title audio video map".split())
#: Words of class and id names, and roles, of what surrounds an article or follows it.
NOT_TEXT_NAMES = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disqus footer form gdpr hidden login masthead menu menus modal nav navbar navigation newsletter "
    "notice notices overlay pagination pager paywall popup promo promoted promotion recommended related reply replies respond search share sharing shares sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar widget widgets".split()
)
#: Words that may follow one of these in a name and say nothing: in "comment-list" the name is the comment's, in "share-of-market" it isn't the share's.
NEUTRAL = frozenset(
    "area articles bar block body bottom box btn button buttons container content count cta feed group icon icons image img inner item items label left link links list listing main message module outer panel posts right row "
    "section slot slots space stories text thread title top unit units wrap wrapper zone".split()
)
#: A name with one of these words says what is not there, or where.
NOT_NAMES = frozenset("disabled enabled free has less no non not off print with without".split())
NOT_TEXT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())


def left_out(tag: str, attributes: dict[str, str], inside_article: bool) -> bool:
    """Whether nothing in the element is text of the page."""
    if tag in NOT_TEXT or tag == "header" and not inside_article:
        return True
    if not attributes:
        return False
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or attributes.get("role", "").lower() in NOT_TEXT_ROLES or "display:none" in attributes.get("style", "").replace(" ", "").lower()


def marked(tag: str, attributes: dict[str, str], inside_article: bool) -> bool:
    """Whether the element is a form, or named like something around or behind an article."""
    if tag == "form":
        return True
    if not attributes or tag in ("body", "html", "main"):
        return False
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        parts = [p.lower() for p in NAME_PART.findall(name)]
        if NOT_NAMES.isdisjoint(parts):
            while len(parts) > 1 and parts[-1] in NEUTRAL:
                parts.pop()
            if parts and (parts[-1] in NOT_TEXT_NAMES or parts[-1] == "header" and not inside_article):
                return True
    return False


def attributes_at(source: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes behind a tag's name (of several with one name the first), and where the tag ends. In one pass: each letter is
    looked at a fixed number of times, whatever is left open. A quote that is never closed is part of a plain value."""
    found: dict[str, str] = {}
    while True:
        at = GAP.match(source, at).end()
        if at >= len(source):
            return found, at
        if source[at] == ">":
            return found, at + 1
        name = NAME.match(source, at)
        at, value = name.end(), ""
        if equals := EQUALS.match(source, at):
            at = equals.end()
            quote = source[at : at + 1]
            end = source.find(quote, at + 1) if quote in ("'", '"') else -1
            if end >= 0:
                value, at = source[at + 1 : end], end + 1
            else:
                plain = PLAIN.match(source, at)
                value, at = plain[0], plain.end()
        found.setdefault(name[0].lower(), html.unescape(value) if "&" in value else value)


class Level(NamedTuple):
    """An open element."""

    tag: str
    container: int  # the innermost container, itself included
    out: bool  # left out, or inside what is
    path: str
    article: bool  # inside an article or main element
    marks: int  # marked elements around it, itself included
    mark: int  # the container around the innermost marked element; -1: none, or at the top


OUTSIDE = Level("", -1, False, "", False, 0, -1)


def deeper(path: str, name: str) -> str:
    path = f"{path}/{name}"
    if path.count("/") > LEVELS:
        levels = path.split("/")
        path = "/".join([hashlib.blake2b("/".join(levels[: LEVELS // 2]).encode("utf-8", "replace"), digest_size=8).hexdigest(), *levels[LEVELS // 2 :]])
    return path


class Page:
    """One reading of a page: blocks of text with the containers around them."""

    def __init__(self, source: str) -> None:
        #: containers: path, number of the container around it (-1: none)
        self.paths: list[str] = []
        self.parents: list[int] = []
        #: the container around the innermost marked element that it is or is in; -1: none, or at the top
        self.marks: list[int] = []
        #: containers around an h1
        self.titled: set[int] = set()
        #: blocks: innermost container, text, letters inside links, marks around it, the innermost mark's container
        self.blocks: list[tuple[int, str, int, int, int]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        stack = [OUTSIDE]
        places: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements of a tag on the stack, and of all blocks
        text: list[str] = []
        linked = 0

        def flush() -> None:
            nonlocal linked
            if text:
                line = " ".join(html.unescape("".join(text)).split())
                if line:
                    top = stack[-1]
                    self.blocks.append((top.container, line, linked, top.marks, top.mark))
                    if places["h1"] and not top.marks:
                        self.titled.add(top.container)
                text.clear()
            linked = 0

        def close(depth: int) -> None:
            while len(stack) > depth:
                tag = stack[-1].tag
                if tag in BLOCKS:
                    flush()
                    places[ANY_BLOCK].pop()
                places[tag].pop()
                stack.pop()

        def close_last(ended: tuple[str, ...], border: tuple[str, ...]) -> bool:
            """Close the last open element of ended, unless one of border is open inside it."""
            last, limit = (max((places[t][-1] for t in tags if places[t]), default=0) for tags in (ended, border))
            if last and last >= limit:
                close(last)
            return last > 0 and last >= limit

        at = 0
        while at < len(source):
            m = TOKEN.search(source, at)
            begin = m.start() if m else len(source)
            if begin > at and not stack[-1].out:
                piece = source[at:begin]
                text.append(piece)
                if places["a"]:
                    linked += len(piece)
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            attributes, at = ({}, at + 1) if source[at : at + 1] == ">" else attributes_at(source, at)
            tag = m[2].lower()
            if m[1]:
                close_last((tag,), () if tag in BLOCKS else (ANY_BLOCK,))  # a stray inline end tag ends no block
                if tag in BLOCKS:
                    flush()
                continue
            if tag in BLOCKS and places["p"]:  # a block ends an open paragraph with what is open in it
                close_last(("p",), (ANY_BLOCK,))
            if tag in CLOSES:
                while close_last(*CLOSES[tag]) and tag == "tr":
                    pass
            if tag in VOID:
                if tag == "hr":
                    flush()
                elif tag in ("br", "wbr") and not stack[-1].out:
                    text.append(" " if tag == "br" else "")
                continue
            top = stack[-1]
            out = top.out or left_out(tag, attributes, top.article)
            if tag in BLOCKS:
                flush()
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.IGNORECASE).search(source, at)
                at = end.end() if end else len(source)
                continue
            container, path, marks, mark = top.container, top.path, top.marks, top.mark
            if not out and tag != "html":
                if marked(tag, attributes, top.article):
                    marks, mark = marks + 1, container
                if tag in BLOCKS:
                    names = sorted(DIGITS.sub("#", attributes.get("class", "").lower()).split())
                    path = deeper(path, ".".join([tag, *(n[:40].replace("/", "_") for n in names[:3])]))
                if tag in CONTAINERS:
                    self.paths.append(path)
                    self.parents.append(container)
                    self.marks.append(mark)
                    container = len(self.paths) - 1
            stack.append(Level(tag, container, out, path, top.article or tag in ("article", "main"), marks, mark))
            places[tag].append(len(stack) - 1)
            if tag in BLOCKS:
                places[ANY_BLOCK].append(len(stack) - 1)
        close(1)
        flush()

    def scores(self) -> list[float]:
        """Per container: the text of its own blocks, and half as much of the blocks one container further in."""
        out = [0.0] * len(self.paths)
        for c, line, linked, marks, _ in self.blocks:
            share = (1 + line.count(",") + min(len(line) / 100, 30)) * (1 - min(1.0, linked / len(line))) * MARKED ** min(marks, 4)
            if c >= 0:
                out[c] += share
                if self.parents[c] >= 0:
                    out[self.parents[c]] += share / 2
        return out

    def votes(self) -> dict[str, float]:
        """Shares of this page's score by path."""
        scores = self.scores()
        total = sum(scores)
        out: dict[str, float] = {}
        for p, s in zip(self.paths, scores, strict=True):
            if s > 0:
                out[p] = out.get(p, 0.0) + s / total
        return out

    def text(self, path: str | None) -> str:
        """Blocks inside the containers with this path and what belongs to them, see _whole(); if there are none, the best container's; without
        containers, all."""
        lines = self._inside(self._whole({i for i, p in enumerate(self.paths) if p == path}))
        if not lines and self.paths:
            scores = self.scores()
            lines = self._inside(self._whole({max(range(len(scores)), key=lambda i: (scores[i], -i))}))
        if not lines and not self.paths:
            lines = [t for _, t, *_ in self.blocks]
        return "\n".join(lines)

    def _whole(self, chosen: set[int]) -> set[int]:
        """The chosen containers, each widened to the container around it as long as what that adds isn't marked and isn't mostly links: an article
        may be spread over several containers, of which the vote names the largest. The body isn't climbed to, as all the page is in it; of its
        containers those belong to the article that are unmarked, not mostly links and have a heading of the first level, or aren't small beside what is
        there (SIBLING of it)."""
        if not chosen:
            return chosen
        n = len(self.paths)
        titled = [i in self.titled for i in range(n)]
        letters, linked = [0] * n, [0] * n  # of the blocks that a container gives if it is chosen
        gone = [[0, 0] for _ in range(n)]  # of those below it that it leaves out, as they are marked inside it
        for c, line, links, marks, mark in self.blocks:
            if c >= 0:
                letters[c] += len(line)
                linked[c] += min(links, len(line))
                if marks and mark >= 0:
                    gone[mark][0] += len(line)
                    gone[mark][1] += min(links, len(line))
        for i in range(n - 1, -1, -1):  # a parent comes first
            letters[i] -= gone[i][0]
            linked[i] -= gone[i][1]
            if self.parents[i] >= 0:
                titled[self.parents[i]] |= titled[i] and self.paths[i] != BODY
                letters[self.parents[i]] += letters[i]
                linked[self.parents[i]] += linked[i]
        out, seen = set(), set()
        for i in chosen:
            while (up := self.parents[i]) >= 0 and self.paths[up] != BODY and self.marks[i] != up and i not in seen:
                if 2 * (linked[up] - linked[i]) > letters[up] - letters[i]:
                    break
                seen.add(i)
                i = up
            if i not in seen:
                out.add(i)
        least = SIBLING * sum(letters[i] for i in out)
        tops = [i for i in range(n) if i not in out and self.parents[i] >= 0 and self.paths[self.parents[i]] == BODY and self.marks[i] != self.parents[i]]
        if any(self.parents[i] >= 0 and self.paths[self.parents[i]] == BODY for i in out):
            out |= {i for i in tops if (titled[i] or letters[i] > least) and 2 * linked[i] <= letters[i]}
        return out

    def _inside(self, chosen: set[int]) -> list[str]:
        if not chosen:
            return []
        inside = [False] * len(self.paths)
        for i, parent in enumerate(self.parents):  # a parent comes first
            inside[i] = i in chosen or parent >= 0 and inside[parent]
        return [t for c, t, _, marks, mark in self.blocks if c >= 0 and inside[c] and not (marks and mark >= 0 and inside[mark])]


def host_paths(pages: DataFrame) -> DataFrame:
    """pages(url, html, ...) -> host, path (the winner), share (of all votes on the host)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, str], float] = {}
        for pdf in frames:
            for host, source in zip(pdf["host"], pdf["html"], strict=True):
                for path, share in Page(source).votes().items():
                    held[host, path] = held.get((host, path), 0.0) + share
            if len(held) > 100_000:
                yield pd.DataFrame([(*k, round(v * 1e9)) for k, v in held.items()], columns=["host", "path", "votes"])
                held = {}
        yield pd.DataFrame([(*k, round(v * 1e9)) for k, v in held.items()], columns=["host", "path", "votes"])

    votes = with_host(pages).select("host", "html").mapInPandas(sparing(run), "host string, path string, votes long")
    votes = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    # ties: the shorter path, then by name
    best = F.max_by("path", F.struct("votes", -F.length("path"), "path"))
    return votes.groupBy("host").agg(best.alias("path"), (F.max("votes") / F.sum("votes")).alias("share"))


def with_host(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)).alias("host"), F.coalesce("html", F.lit("")).alias("html"))


def main_text(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html, ...) -> page_id, url, host, path (the host's winner, or null), text.

    Blocks are joined by one newline; white space inside a block becomes one space. Null or empty html: empty text. Null url, or one
    without a host: the pages without a host vote together. Repeated rows: a row each. Null page_id: kept. Empty table: no rows.
    Unclosed or cut-off markup ends with the page; a page of any length is read in one pass. Other columns are ignored.
    """
    winners = cut(host_paths(pages).select("host", "path"))
    rows = with_host(pages)
    if winners.count() <= BROADCAST_HOSTS:
        joined = rows.join(F.broadcast(winners), "host", "left")
    else:
        spread = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)).cast("int")).join(spread, ["host", "salt"], "left")

    @F.pandas_udf("string")
    def run(source: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([Page(s).text(p) if s else "" for s, p in zip(source, path, strict=True)], dtype=object)

    return joined.select("page_id", "url", "host", "path", run("html", "path").alias("text"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_html_extraction": op4_html_extraction}
