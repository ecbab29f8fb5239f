"""Main text of web pages by consensus of their host.

Pass 1 scores each page's containers by the text that stands in them outside links and boilerplate, and the page votes
for the generalised tag-class path of its best one. Spark sums votes per host and path. Pass 2 takes from each page
the blocks under its host's winning paths, and where a page has none of them, under its own best container.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import saved, small_batches, table

#: Elements that end a block of text. A fixed value of HTML.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
#: Blocks that hold text themselves and are no containers.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 hr li dt dd pre option legend summary caption title tr td th thead tbody tfoot".split())
#: Elements whose content is not text of the page, and elements that are never main text.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "canvas", "object")
ASIDE = frozenset("head nav header footer aside form menu dialog button select search option fieldset".split())
#: Words in a class, id or role that mark what is not main text, and such as mark main text.
NOT_MAIN = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay sidebar aside menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer foot share sharing social related recommended comment comments commentlist disqus reply replies respond newsletter subscribe signup login search pagination pager widget complementary contentinfo hidden".split())
#: Of these, such as mark what is left out inside an article too, with whatever word of the page before them: post-comments, entry-footer.
ALWAYS = frozenset("comment comments commentlist replies respond footer sidebar".split())
#: Names of which a header that holds the title is made: these never mark by `header` alone.
TITLED = frozenset("content entry main article post page title section story header head inner wrapper".split())
#: Words that say nothing of their own beside such a word, as in site-header or related-posts.
NEUTRAL = frozenset("site page main global top bottom left right primary secondary inner outer wrapper wrap container box bar area block section region list item items links link button buttons icons form field posts articles stories content contents row column col unit slot group panel module text title label view nav js u c l o is has the my".split())
MAIN = frozenset("article content entry main post story body text".split())
#: Least share of a host's votes with which a path wins beside the first.
SHARE = 0.2
#: Least part of the characters of the page's best container that a winning path must hold.
PART = 0.3

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*)(?P<attrs2>[^>]*)>|<[!?/][^>]*>",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


class Page:
    """Blocks of a page in order, each with its container; containers with parent, path and score."""

    def __init__(self, html: str):
        self.parents, self.paths, self.scores = [-1], [""], [0.0]
        self.blocks: list[tuple[int, str]] = []
        self._walk(html)

    def _walk(self, html: str) -> None:
        # tag, container, left out: 0 no, 1 but for headings, 2 yes
        stack: list[tuple[str, int, int]] = [("", 0, 0)]
        text: list[str] = []
        linked, link = 0, 0

        def flush():
            nonlocal linked
            if text:
                tag, container, out = stack[-1]
                if not out and (block := " ".join(entities.unescape("".join(text)).split())):
                    self.blocks.append((container, block))
                    self.scores[container] += max(0, len(block) - 2 * linked)
                text.clear()
            linked = 0

        def close(tag: str) -> None:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    return

        at = 0
        for m in _TOKEN.finditer(html):
            if m.start() > at:
                piece = html[at : m.start()]
                text.append(piece)
                linked += len(piece) if link else 0
            at = m.end()
            tag = m["tag"] or m["tag2"]
            if not tag:
                if m["raw"]:
                    text.append(" ")
                continue
            tag = tag.lower()
            ends = m["end"] or m["end2"]
            if tag == "a":
                link = 0 if ends else 1
            if tag == "br":
                text.append(" ")
            if tag not in BLOCKS:
                # an inline element can be boilerplate too, but it is not tracked unless it says so
                if not ends and "=" in (a := m["attrs"] or m["attrs2"] or "") and tag in ("span", "ins", "label") and self._marks(a)[1] and not a.endswith("/"):
                    flush()
                    stack.append((tag, stack[-1][1], 2))
                elif ends and tag in ("span", "ins", "label") and any(s[0] == tag for s in stack):
                    flush()
                    close(tag)
                continue
            flush()
            link = 0
            if ends:
                close(tag)
                continue
            if tag == "hr":
                continue
            if stack[-1][0] == "p" or stack[-1][0] in HEADINGS:
                stack.pop()
            if tag in ("li", "dt", "dd", "option", "tr", "td", "th") and stack[-1][0] == tag:
                stack.pop()
            if stack[-1][0] == "head" and tag != "title":
                close("head")
            if tag in ("article", "main") and stack[-1][2] and not any("comment" in s[0] for s in stack):
                # the main element inside boilerplate: an end tag was left out
                while stack[-1][2]:
                    stack.pop()
            first, marked = self._marks(m["attrs"] or m["attrs2"] or "")
            parent, out = stack[-1][1], stack[-1][2]
            if tag == "header" and not out and not marked and any(t in ("article", "main") for t, _, _ in stack):
                leaves = 1  # an article's own header: its headings are the article's
            elif out == 1 and tag in HEADINGS and not marked:
                leaves = 0
            else:
                leaves = 2 if out == 2 or marked or tag in ASIDE or tag == "title" else out
            if tag in LEAVES:
                stack.append((tag, parent, leaves))
            else:
                self.parents.append(parent)
                self.paths.append(f"{self.paths[parent]}>{tag}{first}")
                self.scores.append(0.0)
                stack.append((tag + ("#comment" if marked and "comment" in first else ""), len(self.parents) - 1, leaves))
        text.append(html[at:])
        flush()

    @staticmethod
    def _marks(attrs: str) -> tuple[str, bool]:
        """The first class with numbers generalised, and whether class, id or role mark boilerplate."""
        if "=" not in attrs and "hidden" not in attrs:
            return "", False
        first, marked = "", False
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), (a or b or c).lower()
            if name == "hidden" or name == "aria-hidden" and value == "true":
                marked = True
            elif name in ("class", "id", "role"):
                if name == "class" and value.split():
                    first = "." + re.sub(r"\d+", "#", value.split()[0])
                for name in value.split():
                    # a name marks if it is such a word, or joins such words with neutral ones; share-price and notice-of-sale don't
                    words = [w for w in re.split(r"[^a-z]+", name) if w]
                    marked |= (words == ["hidden"] or any(w in NOT_MAIN and w != "hidden" for w in words)) and all(w in NOT_MAIN or w in NEUTRAL or (w in MAIN and words[-1] in ALWAYS) for w in words)
                    if len(words) > 1 and "header" in words and set(words) <= TITLED and set(words) & MAIN:
                        marked = False  # content-header, entry-header: the title's own place
        return first, marked

    def best(self) -> str:
        """The path of the best container; a parent counts half of what its containers hold, and main elements count more."""
        score = list(self.scores)
        for i in range(len(score) - 1, 0, -1):
            score[self.parents[i]] += score[i] * 0.5
        most, path = 0.0, ""
        for i, s in enumerate(score):
            last = self.paths[i].rpartition(">")[2]
            tag, _, rest = last.partition(".")
            if tag in ("article", "main"):
                s *= 3.0
            elif set(re.split(r"[^a-z]+", rest)) & MAIN:
                s *= 2.0
            if s > most:
                most, path = s, self.paths[i]
        return path

    def under(self, path: str) -> list[str]:
        """Blocks in containers of this path, and in those within."""
        inside = [False] * len(self.paths)
        for i, p in enumerate(self.paths):
            inside[i] = p == path or (i > 0 and inside[self.parents[i]])
        return [text for container, text in self.blocks if inside[container]]


def extract(html: str, paths: list[str]) -> str:
    """The blocks under the first winning path that holds a fair part of what the page's own best container has; else those of that container."""
    page = Page(html)
    own = page.under(page.best())
    least = PART * sum(map(len, own))
    for path in paths:
        blocks = page.under(path)
        if blocks and sum(map(len, blocks)) >= least:
            return "\n\n".join(blocks)
    return "\n\n".join(own)


def consensus(pages: DataFrame) -> DataFrame:
    """(host, html) -> host, paths: the path of most votes (of equal ones the least), then others of at least SHARE of all votes.

    So a host has at most 1 / SHARE paths, whatever its pages. Pages without a host, and without text, don't vote.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes: dict[tuple[str, str], int] = defaultdict(int)
        for batch in batches:
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                votes[host, Page(html).best()] += 1
            if len(votes) > 100_000:
                yield pa.RecordBatch.from_pylist([{"host": h, "path": p, "n": n} for (h, p), n in votes.items()])
                votes.clear()
        if votes:
            yield pa.RecordBatch.from_pylist([{"host": h, "path": p, "n": n} for (h, p), n in votes.items()])

    votes = pages.select("host", "html").filter("host <> ''").mapInArrow(work, "host string, path string, n long").groupBy("host", "path").agg(F.sum("n").alias("n")).filter("path <> ''")
    rank = F.struct((-F.col("n")).alias("n"), "path")
    totals = votes.groupBy("host").agg(F.sum("n").alias("total"), F.min(rank).alias("first"))
    winners = votes.join(totals, "host").filter((F.col("n") >= SHARE * F.col("total")) | (rank == F.col("first")))
    return winners.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(rank)), lambda x: x["path"]).alias("paths"))


#: Hosts up to which the winning paths are sent to all executors; beyond, pages are joined by host.
SENT_HOSTS = 100_000


def main_text(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars.

    Null or empty html: empty text; without a host, a page has its own best container. Repeated pages each vote and have a row;
    of paths with equal votes the least is first. A very long page is read whole by one task. An empty table gives no rows.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1))
    rows = small_batches(pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host")), 1000)
    paths = saved(consensus(rows), "hostpaths")
    if paths.count() <= SENT_HOSTS:
        paths = F.broadcast(paths)
    rows = rows.join(paths, "host", "left").select("page_id", "url", "html", "paths")
    kind = dict(pages.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h, p or []) for h, p in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(work, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")


def op8_htmltext(spark, sf_dir) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
