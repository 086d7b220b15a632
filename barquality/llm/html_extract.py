"""HTML extraction: text-to-tag ratios over parser events.

The standard-library parser streams a page as events.  Block elements cut the
text into lines; each line knows its characters, its tags and the containers it
lies in.  The ratio of characters to tags is smoothed over neighbouring lines
with a Gaussian kernel, and lines above the standard deviation of the page form
the content clusters.  The clusters select the regions:

* each line of a cluster speaks for the article or main element around it; where
  these hold half of the clustered text, the regions are the elements spoken
  for; those marked as other stories (related, promoted) are left out where
  the others hold at least half of their text;
* elsewhere the region is the least container around all lines of clusters, less
  lines outside the clusters that are links and nothing else.

A page without a cluster has no region and an empty text.  Of a region all lines
are returned, in page order; elements that are boilerplate by tag or by class, id
or role only trim it.  Where every clustered line lies in such elements, the
ratios are smoothed once more without them.

A null or empty page has an empty text, and so has a page without text.  Broken
markup is read as far as it goes: unknown end tags are ignored, an unclosed
element ends with its parent, an article ends what was left open before it.
Declarations that are none are skipped to their end, what stands after the last
end of a tag is text, and a start tag that never ends is text as well; after
``RETRIES`` of these, tags are read without their attributes, so that a page
of unclosed quotes costs no more than its length.
Very long and very deep pages are taken whole, one at a time, with constant work
per tag; repeated rows give repeated results; an empty table an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces, slim, texts_of

#: Elements whose text is never content.
UNSEEN = frozenset("script style noscript template iframe object svg math head title select option textarea button canvas audio video".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog".split())
#: Words in class, id or role that mark boilerplate.
MARKERS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored promo promotion banner "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer sidebar aside "
    "notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended widget toolbar pagination pager search complementary contentinfo".split()
)
#: Those of them that mark another story.
RELATED = frozenset("sponsor sponsored promo promotion advert adverts advertisement advertising advertorial related recommended widget".split())
COMMENTS = frozenset("comment comments commentlist respond replies disqus discussion".split())
CONTENT = frozenset(("article", "main"))
CONTAINERS = frozenset(
    "html body div section article main nav header footer aside form menu dialog ul ol dl table thead tbody tfoot tr figure fieldset details blockquote center address hgroup".split()
) | UNSEEN
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre hr caption figcaption summary legend".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_WORDS = re.compile(r"[a-z]+")
#: Start tags without an end that are searched for one through the rest of a page.
RETRIES = 16
_BARE_TAG = re.compile(r"<([a-zA-Z][^\s/<>]*)[^<>]*>")


class Lines(HTMLParser):
    """Collects (text, tags, container, all links) of every line, and the tree of containers."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # container: tag, parent, whether it is boilerplate itself, whether it is a reader's comment
        self.tags, self.parents, self.marked, self.comment = ["#page"], [-1], [False], [False]
        #: content elements that are marked as another story, or stand where one was announced
        self.related: set[int] = set()
        self.other = [False]
        self.open = [0]
        #: where in ``open`` the containers of each tag are
        self.places: dict[str, list[int]] = {}
        self.text: list[str] = []
        self.plain = False
        self.n_tags, self.n_links = 0, 0
        self.lines: list[tuple[str, int, int, bool]] = []
        self.n_failed, self.unclosed = 0, set()

    def read(self, html: str) -> None:
        """All events of a page."""
        end = html.rfind(">") + 1
        self.feed(html[:end])
        self.close()
        if html[end:]:
            self.handle_data(unescape(html[end:]))
        self.cut()

    def parse_starttag(self, i: int) -> int:
        if self.n_failed < RETRIES:
            end = super().parse_starttag(i)
            self.n_failed += end < 0
            return end
        bare = _BARE_TAG.match(self.rawdata, i)
        if not bare:
            return -1
        self.handle_starttag(bare[1].lower(), [])
        return bare.end()

    def parse_html_declaration(self, i: int) -> int:
        """Past a comment, a CDATA section or anything else that begins like a declaration."""
        for opened, closed in (("<!--", "-->"), ("<![CDATA[", "]]>")):
            if self.rawdata.startswith(opened, i) and closed not in self.unclosed:
                end = self.rawdata.find(closed, i + len(opened))
                if end >= 0:
                    return end + len(closed)
                # nor does any that begins later
                self.unclosed.add(closed)
        return self.rawdata.find(">", i) + 1 or -1

    def cut(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.n_tags, self.open[-1], not self.plain))
            self.n_tags = 0
        self.text, self.plain = [], False

    def _pop(self) -> None:
        self.places[self.tags[self.open.pop()]].pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.cut()
        self.n_tags += 1
        if tag == "br":
            self.text.append(" ")
        elif tag == "a":
            self.n_links += 1
        if tag not in CONTAINERS:
            return
        words = {w for k, v in attrs if k in ("class", "id", "role") and v for w in _WORDS.findall(v.lower())}
        comment = bool(words & COMMENTS)
        other = bool(words & RELATED)
        if tag in CONTENT and not comment:
            # what is still open and no content ends here, unless it is a thread of comments
            while self.open[-1] and self._ends(self.open[-1]):
                other = other or self.other[self.open[-1]]
                self._pop()
            if other:
                self.related.add(len(self.tags))
        inside = any(self.places.get(c) for c in CONTENT)
        marked = tag in UNSEEN or tag in BOILERPLATE or bool(words & MARKERS) or (tag == "header" and not inside)
        if tag in ("html", "body") or (tag in CONTENT and not comment):
            marked = False
        self.tags.append(tag)
        self.parents.append(self.open[-1])
        self.marked.append(marked)
        self.other.append(other)
        self.comment.append(comment)
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(len(self.tags) - 1)

    def _ends(self, container: int) -> bool:
        tag = self.tags[container]
        return tag in UNSEEN or ((tag in BOILERPLATE or tag == "header" or self.marked[container]) and not self.comment[container]) or tag in ("ul", "ol")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in CONTAINERS and tag not in VOID:
            self.handle_starttag(tag, attrs)
        else:
            if tag in BLOCKS:
                self.cut()
            elif tag == "br":
                self.text.append(" ")
            self.n_tags += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.cut()
        self.n_tags += 1
        if tag == "a":
            self.n_links = max(0, self.n_links - 1)
        elif self.places.get(tag):
            depth = self.places[tag][-1]
            while len(self.open) > depth:
                self._pop()

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        self.plain = self.plain or (not self.n_links and not data.isspace())


def smooth(values: np.ndarray, sigma: float, radius: int) -> np.ndarray:
    """Gaussian smoothing; at the ends over what is there."""
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    n = len(values)
    full = np.convolve(values, kernel)[radius : radius + n]
    return full / np.convolve(np.ones(n), kernel)[radius : radius + n]


def clustered(lines: list[tuple[str, int]], sigma: float, radius: int) -> np.ndarray:
    """Which of the lines (text, tags) are in a content cluster: smoothed ratio at or above the standard deviation."""
    if not lines:
        return np.zeros(0, bool)
    smoothed = smooth(np.array([len(t) / max(n, 1) for t, n in lines]), sigma, radius)
    return smoothed >= smoothed.std()


def _summed(parents: list[int], held: np.ndarray) -> np.ndarray:
    """What each container holds, with all containers in it; parents come before their children."""
    total = held.tolist()
    for i in range(len(total) - 1, 0, -1):
        total[parents[i]] += total[i]
    return np.array(total)


def regions(page: Lines, lines: list, clusters: np.ndarray, hidden: list[bool], aside: list[bool]) -> tuple[set[int], bool]:
    """The containers that the clustered lines select, and whether they are content elements.

    Those ``aside`` are left where the others hold at least half of the text.
    """
    size = len(page.tags)
    held = np.zeros(size)
    for (text, _, container, _), in_cluster in zip(lines, clusters):
        held[container] += len(text) * in_cluster
    if not held.any():
        return set(), False
    content = [0] * size
    for i in range(1, size):
        content[i] = i if page.tags[i] in CONTENT and not hidden[i] else content[page.parents[i]]
    spoken = np.bincount(content, held, size)
    spoken[0] = 0
    if 2 * spoken.sum() >= held.sum():
        found = np.flatnonzero(spoken)
        own = found[[not aside[i] for i in found]]
        return set((own if 2 * spoken[own].sum() >= spoken.sum() else found).tolist()), True
    count = np.zeros(size)
    for (_, _, container, _), in_cluster in zip(lines, clusters):
        count[container] += in_cluster
    around = _summed(page.parents, count)
    return {int(np.flatnonzero(around == around[0])[-1])}, False


def main_text(html: str, sigma: float = 1.0, radius: int = 2, cluster=clustered) -> tuple[str, int, int]:
    """The content of a page, its number of lines, and how many of all lines were in a content cluster."""
    page = Lines()
    page.read(html)
    # a container is out when it or one around it is marked; content elements shed marks around them
    out, hidden, aside = [False], [False], [False]
    for i in range(1, len(page.tags)):
        parent = page.parents[i]
        hidden.append(hidden[parent] or page.comment[i])
        aside.append(aside[parent] or i in page.related)
        out.append(page.marked[i] or (out[parent] and page.tags[i] not in CONTENT))
    lines = [x for x in page.lines if page.tags[x[2]] not in UNSEEN]
    kept = np.array([not out[c] and not hidden[c] for _, _, c, _ in lines], bool)
    dense = cluster([x[:2] for x in lines], sigma, radius)
    chosen = dense & kept
    if dense.any() and not chosen.any():
        chosen[kept] = cluster([x[:2] for x, k in zip(lines, kept) if k], sigma, radius)
    selected, content = regions(page, lines, chosen, hidden, aside)
    inside = [0 in selected]
    for i in range(1, len(page.tags)):
        inside.append(i in selected or inside[page.parents[i]])
    text = [t for (t, _, c, links), k, d in zip(lines, kept, chosen) if k and inside[c] and (content or d or not links)]
    return "\n\n".join(text), len(text), int(dense.sum())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_dense of every row of ``pages(page_id, url, html)``."""
    pages = slim(pages, "page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "html"):
                rows = [main_text(h) for h in texts_of(batch.column("html"))]
                text = [r[0] for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())],
                    ["page_id", "url", "text", "n_chars", "n_blocks", "n_dense"],
                )

    return pages.mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars bigint, n_blocks bigint, n_dense bigint")
