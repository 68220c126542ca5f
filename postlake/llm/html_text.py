"""Main text of web pages by consensus host paths.

Pages of a host share templates. Each page's containers are scored by the running text they hold, and the
page votes for the path of its best container: tags with their classes, digits generalised. Votes are
counted per host in Spark, and every page is extracted again from the containers on its host's winning
path. What a page's own best container holds stays beside that: only furniture is dropped, no text for its share.
A page is read once, in time and memory in proportion to its length, however deep its elements nest.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from postlake.llm._shared import stored, table, text_batches

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
      | <(?P<raw>script|style|noscript|template|textarea|title|iframe|xmp)\b(?:[^>"']|"[^"]*"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)
      | <(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>
      | </?[a-zA-Z][^>]*(?:>|\Z)
      | <[!?][^>]*(?:>|\Z)""",
    re.X | re.S | re.I,
)
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPACE = re.compile(r"\s+")
#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var object svg g defs path text tspan desc "
    "math mi mn mo ms mtext mrow mspace mstyle msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mpadded mphantom menclose semantics annotation".split()
)
#: Elements that can hold an article.
CONTAINERS = frozenset("article main section div td body".split())
#: Elements that never belong to one.
DROPPED = frozenset("nav footer aside form button select option head menu dialog audio video canvas map".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())
#: Words that mark furniture of a page, if a class or id is made of nothing but these and words that say where or how it lies.
FURNITURE = frozenset(
    "nav navbar navigation menu menubar header masthead footer foot sidebar side aside rail ad ads adv advert adverts advertisement adsense advertising sponsor sponsored sponsors promo promotion promoted "
    "banner cookie cookies consent gdpr notice notices notification alert popup modal overlay comment comments commentlist respond replies reply discussion responses feedback disqus share sharing social related "
    "recommended recommendations breadcrumb breadcrumbs newsletter subscribe subscription signup login search widget widgets toolbar pagination pager skip copyright form".split()
)
PLACING = frozenset(
    "area bar block bottom box btn button col column container content down global icon icons inner item items left link links list main outer page panel post primary reader readers right row secondary section site slot "
    "small large sticky fixed top unit up user wrap wrapper the and of for our my".split()
)
#: Blocks that end where the next of their kind begins.
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6".split())
LIST_ITEMS = frozenset("li dt dd".split())
#: A block of running text has so many characters at least.
RUNNING = 80
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _marks(name: str) -> set[str]:
    """The furniture words of one class or id; none if it also says something else, as "search-engines" does."""
    words = {x.lower() for x in _PARTS.findall(name)}
    return words & FURNITURE if words <= FURNITURE | PLACING else set()


def path_key(parts: list[str]) -> str:
    """The key of a path of generalised tags and classes from the page's root, of 32 digits however long the path is."""
    key = b""
    for part in parts:
        key = hashlib.blake2b(key + part.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return key.hex()


def _names(attrs: str) -> tuple[str, set[str], bool]:
    """The generalised class, the furniture words of class and id, and whether the element is hidden or of a dropped role."""
    css, words, gone = "", set(), False
    if attrs.strip():
        for name, *values in _ATTR.findall(attrs):
            value, name = "".join(values), name.lower()
            if name in ("class", "id"):
                words |= set().union(*map(_marks, value.split()))
                if name == "class":
                    css = ".".join(sorted(re.sub(r"\d+", "#", x).replace("/", "|") for x in value.split()))
            elif name == "role":
                gone |= value.lower() in DROPPED_ROLES
            elif name == "style":
                gone |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                gone = True
    return css, words, gone


class Page:
    """The blocks of text of a page, each with the elements it stands in. Furniture leaves no blocks."""

    def __init__(self, source: str):
        # of each node its parent, tag, path's key, and nearest container at or above it
        self.parents, self.tags, self.keys, self.homes = [-1], [""], [b""], [0]
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters in links
        self._heads: set[int] = set()  # blocks that are headings
        self._head = False
        self._text: list[str] = []
        self._linked = self._in_link = 0
        stack: list[tuple[int, str, bool, bool]] = [(0, "", False, False)]  # node, tag, dropped, inside an article
        open_: Counter[str] = Counter()
        at = 0

        def close() -> None:
            open_[stack.pop()[1]] -= 1

        for m in _TOKEN.finditer(source):
            if m.start() > at and not stack[-1][2]:
                self._add(source[at : m.start()])
            at = m.end()
            tag = (m["tag"] or "").lower()
            if not tag or tag == "br" or m["raw"]:
                if tag == "br":
                    self._text.append(" ")
                continue
            if tag in INLINE or (tag in VOID and tag != "hr"):
                if tag == "a":
                    self._in_link = 0 if m["close"] else 1
                continue
            if not stack[-1][2]:
                self._flush(stack[-1][0])
            self._head = not m["close"] and tag in PARAGRAPHS and tag != "p"
            if tag in VOID:
                continue
            if m["close"]:
                if open_[tag]:
                    while stack[-1][1] != tag:
                        close()
                    close()
                continue
            if tag in PARAGRAPHS or tag in LIST_ITEMS:
                while stack[-1][1] in PARAGRAPHS or stack[-1][1] == tag:
                    close()
                if not m["attrs"].strip():
                    continue
            if tag == "html":
                continue
            css, words, gone = _names(m["attrs"])
            parent, _, dropped, inside = stack[-1]
            marks = set() if tag in ("body", "article", "main") else words - ({"header"} if inside else set())
            gone |= tag in DROPPED or (tag == "header" and not inside) or bool(marks)
            part = f"{tag}.{css}" if css else tag
            self.parents.append(parent)
            self.tags.append(tag)
            self.keys.append(hashlib.blake2b(self.keys[parent] + part.encode("utf-8", "surrogatepass"), digest_size=16).digest())
            self.homes.append(len(self.tags) - 1 if tag in CONTAINERS else self.homes[parent])
            stack.append((len(self.tags) - 1, tag, dropped or gone, inside or tag in ("article", "main")))
            open_[tag] += 1
        if at < len(source) and not stack[-1][2]:
            self._add(source[at:])
        self._flush(stack[-1][0])

    def _add(self, text: str) -> None:
        self._text.append(text)
        self._linked += len(text) * self._in_link

    def _flush(self, node: int) -> None:
        if self._text:
            text = _SPACE.sub(" ", entities.unescape("".join(self._text))).strip()
            if text:
                if self._head:
                    self._heads.add(len(self.blocks))
                self.blocks.append((node, text, self._linked))
        self._text, self._linked = [], 0

    def best(self) -> int:
        """The container with most running text: a block counts for its container, and half for the next one out.

        An article round it takes its place, and else the outermost ancestor that adds text to it, see :meth:`_widened`.
        """
        scores: dict[int, float] = {}
        for node, text, linked in self.blocks:
            plain = max(0, len(text) - 2 * linked)
            worth = plain * (1.0 if len(text) >= RUNNING else 0.3)
            home = self.homes[node]
            scores[home] = scores.get(home, 0) + worth
            if home:
                out = self.homes[self.parents[home]]
                scores[out] = scores.get(out, 0) + worth / 2
        for node in scores:
            scores[node] *= 1.5 if self.tags[node] in ("article", "main") else 1.0
        return self._widened(max(scores, key=lambda n: (scores[n], n))) if scores else 0

    def vote(self) -> tuple[str, int]:
        """Key of the best container's path and the characters it holds; 0 for a page without text."""
        best = self.best()
        return self.keys[best].hex(), sum(len(text) for _, text in self._within(lambda n: n == best))

    def _widened(self, node: int) -> int:
        """The outermost container round ``node`` that adds to it: any text that isn't all links, of the whole body a block of running text.

        So introductions, headings and notes that stand beside an article's body stay with it, however short they are.
        """
        out = node
        while out and self.tags[out] != "article":
            out = self.parents[out]
        if out:
            return out
        some, running = [0] * len(self.tags), [0] * len(self.tags)  # blocks at and below a node
        for home, text, linked in self.blocks:
            plain = len(text) - 2 * linked
            some[home] += plain > 0
            running[home] += plain > 0 and len(text) >= RUNNING
        for i in range(len(self.tags) - 1, 0, -1):
            some[self.parents[i]] += some[i]
            running[self.parents[i]] += running[i]
        out = node
        while out:
            out = self.homes[self.parents[out]]
            counted = some if out and self.tags[out] != "body" else running
            if counted[out] > counted[node]:
                node = out
        return node

    def _within(self, chosen) -> list[tuple[int, str]]:
        """The blocks at or below nodes that are ``chosen``."""
        held = [False] * len(self.tags)
        for i, parent in enumerate(self.parents):  # parents come first
            held[i] = chosen(i) or (i > 0 and held[parent])
        return [(node, text) for node, text, _ in self.blocks if held[node]]

    def text(self, path: str | None) -> str:
        """The blocks of the containers whose path has the key ``path`` and of the page's best container, in page order."""
        best = self.best()
        wanted = bytes.fromhex(path) if path else None
        return "\n".join(x for _, x in self._within(lambda n: n == best or self.keys[n] == wanted))


def extract(source: str, path: str | None) -> str:
    return Page(source).text(path)


def _vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [Page(x).vote() for x in pdf["html"]]
        out = pd.DataFrame({"host": pdf["host"], "path": [x[0] for x in found], "score": [x[1] for x in found]})
        yield out[out["score"] > 0].groupby(["host", "path"], as_index=False).agg(votes=("score", "size"), score=("score", "sum"))


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.drop(columns=["html", "path"]).assign(text=[extract(x, p) for x, p in zip(pdf["html"], pdf["path"].where(pdf["path"].notna(), None))])


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path): the key of the path with most votes per host; ties go to the higher score, then to the greater key."""
    rows = pages.select(F.lower(F.try_parse_url(F.col(url), F.lit("HOST"))).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html")).where("host IS NOT NULL")
    votes = rows.mapInPandas(_vote, "host string, path string, votes long, score long")
    totals = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score"))
    return totals.groupBy("host").agg(F.max(F.struct("votes", "score", "path")).path.alias("path"))


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text) per row of ``pages``: the main text, one line per block.

    Null or empty html gives an empty text. A page whose url is null or has no host, or that lacks its host's
    path, is extracted from its own best container. Repeated rows stay repeated,
    other columns are not read. The table of winning paths is broadcast only if it is below Spark's
    threshold; beyond it, pages are joined by sort-merge and hot hosts are split.
    """
    text_batches(pages.sparkSession)
    paths = stored(host_paths(pages, url, html), "host-paths")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"), F.lower(F.try_parse_url(F.col(url), F.lit("HOST"))).alias("host"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.join(paths, "host", "left").select("page_id", "url", "html", "path").mapInPandas(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def op6_main_text(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long"))
