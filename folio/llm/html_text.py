"""Main text of web pages: site templates removed by counting element subtrees per host.

Every element but article and main is hashed with its tags and text. Spark counts beside
how many different contents of a host each hash occurs: what tells contents apart is the longest block of
the page's article (or of the whole page without one) outside the element, so that copies of a
page, and copies with some block changed, count once; subtrees with at least ``SHARE`` of a host's
contents, and ``LEAST_PAGES`` at least, or with ``MANY_PAGES`` whatever their share, are
the site's template and go from each page. What HTML itself names as beside the text goes too: nav,
header, footer, aside, menus, forms, scripts, styles, and elements whose class, id or role has a
name like ad, cookie-banner, sidebar or comments. A name with other words in it (no-sidebar,
ad-free, comments-open) is none of these, and no name counts on an article or main, on what holds one, or
on a page's text as a whole. If the page has an article (or main) element,
its content is the text; words that may also mark a part of the text, like related or
notice, don't count on a paragraph or heading of it, and neither they nor the template empty it.
"""

from __future__ import annotations

import html
import re

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import materialize

SHARE, LEAST_PAGES, MANY_PAGES = 0.5, 5, 100
#: Hosts' templates are broadcast up to so many subtrees in all, and joined by host beyond.
TEMPLATE_ROWS = 200_000

# Element names of the HTML standard, and words that sites use for what is beside the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - {"body", "html", "caption", "dd", "dt", "legend", "li", "optgroup", "option", "summary", "tbody", "td", "tfoot", "th", "thead", "tr", "figcaption"}
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BESIDE = frozenset("nav header footer aside form script style template iframe menu head title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
BESIDE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising comment comments cookie cookies consent disqus gdpr nav navbar navigation newsletter promo sidebar sponsor sponsored subscribe subscription".split())
#: Words that may stand beside those in a hyphenated name without changing what it means.
SHAPES = frozenset("area bar block body bottom box button buttons container content form group inner item items left link links list main mobile outer panel primary right row section site slot small text thread top unit widget widgets wrap wrapper".split())
MAYBE_BESIDE = frozenset("banner breadcrumb breadcrumbs footer header masthead menu notice notices popup modal promoted promotion related recommended share sharing social side toolbar widget reply replies respond".split())
NAMED = BESIDE_WORDS | MAYBE_BESIDE | SHAPES
#: Elements that hold a text's own words.
OF_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption b i em strong a span code q cite".split())
#: A comment or declaration, or a tag with its name and attributes; a quote matters only right after an equals sign.
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s\"'>][^\s>]*)?|[^>=])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s/=]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s]*)))?")
RAW_TEXT = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "iframe")}
NOTHING: frozenset = frozenset()


class Page:
    """Elements in order of their start tags, and the page's events: texts, and starts and ends of blocks.

    Unclosed elements end as HTML lets them; an unclosed comment, tag, script or style
    takes the rest of the page.
    """

    def __init__(self, source: str):
        self.tag, self.beside, self.named, self.maybe, self.parent = ["html"], [False], [False], [False], [-1]
        self.events: list[tuple[int, str | None]] = []  # element and its text, or None at a block's edge
        self.open = [0]
        at = 0
        while True:
            m = TOKEN.search(source, at)
            if m is None:
                self._text(source[at:])
                return
            self._text(source[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag not in VOID:
                    self._end((tag,), NOTHING)
                continue
            self._start(tag, m[3])
            if tag in RAW_TEXT:
                end = RAW_TEXT[tag].search(source, at)
                at = end.end() if end else len(source)
                self._end((tag,), NOTHING)

    def _text(self, text: str):
        if text:
            self.events.append((self.open[-1], html.unescape(text) if "&" in text else text))

    def _start(self, tag: str, attributes: str):
        if tag == "html":
            return
        if tag == "body":
            del self.open[1:]
            return
        if tag in CLOSES_P:
            self._end(("p",), BLOCKS - {"p"})
        if tag in SELF_CLOSING:
            self._end(SELF_CLOSING[tag], CONTAINERS)
        node = len(self.tag)
        self.tag.append(tag)
        self.parent.append(self.open[-1])
        named, maybe = self._named_beside(attributes) if attributes else (False, False)
        self.beside.append(tag in BESIDE)
        self.named.append(named)
        self.maybe.append(maybe)
        if tag in BLOCKS:
            self.events.append((node, None))
        if tag not in VOID:
            self.open.append(node)
        elif tag in ("br", "hr"):
            self.events.append((node, " "))

    def _named_beside(self, attributes: str) -> tuple[bool, bool]:
        """Whether class, id and role say so, and whether they may."""
        beside = maybe = False
        for m in ATTRIBUTE.finditer(attributes):
            if (name := m[1].lower()) in ("class", "id", "role"):
                for own in (m[2] or m[3] or m[4] or "").lower().split():
                    if name == "role":
                        beside |= own in ROLES
                        continue
                    words = {w for w in re.split(r"[_-]+", own) if w and not w.isdigit()}
                    if words <= NAMED:
                        beside |= not BESIDE_WORDS.isdisjoint(words)
                        maybe |= not MAYBE_BESIDE.isdisjoint(words)
        return beside, maybe

    def _end(self, tags, stop):
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.open[k]]
            if tag in tags:
                self.events.extend((n, None) for n in self.open[k:] if self.tag[n] in BLOCKS)
                del self.open[k:]
                return
            if tag in stop:
                return

    def hashes(self) -> list[int]:
        """A hash of each element's tags and text, 0 if it has no text."""
        parts: list[list] = [[] for _ in self.tag]
        for node, text in self.events:
            if text is not None and (words := text.split()):
                parts[node].append(" ".join(words))
        out = [0] * len(self.tag)
        for n in range(len(self.tag) - 1, -1, -1):  # elements come after the one they are in
            if parts[n]:
                out[n] = xxhash.xxh64_intdigest("\0".join([self.tag[n], *parts[n]]), 0) - (1 << 63) or 1
                if n:
                    parts[self.parent[n]].append(str(out[n]))
        return out

    def inside(self) -> list[bool]:
        """Whether each element is an article or main, or in one."""
        out = [t in ("article", "main") for t in self.tag]
        for n in range(1, len(out)):
            out[n] |= out[self.parent[n]]
        return out

    def whole(self) -> list[bool]:
        """Whether each element is or holds an article or main; on a page without any, whether it has most of the words beside scripts, styles, menus and the like."""
        out = [t in ("article", "main") for t in self.tag]
        if not any(out):
            words, beside = [0] * len(self.tag), self.beside[:]
            for n in range(1, len(self.tag)):
                beside[n] |= beside[self.parent[n]]
            for node, text in self.events:
                if text is not None and not beside[node]:
                    words[node] += len(text.split())
            for n in range(len(self.tag) - 1, 0, -1):
                words[self.parent[n]] += words[n]
            return [2 * w > words[0] for w in words]
        for n in range(len(self.tag) - 1, 0, -1):
            out[self.parent[n]] |= out[n]
        return out

    def contents(self, hashes: list[int]) -> tuple[int, list[int]]:
        """The longest block of the page's articles, or of the whole page if none has text; and for each element the longest one outside it."""
        inside = self.inside()
        words: list[tuple[int, int]] = [(0, 0)] * len(self.tag)  # of each element's own text
        for node, text in self.events:
            if text is not None and (n := len(text.split())):
                words[node] = (words[node][0] + n, hashes[node])
        if any(i and w[0] for i, w in zip(inside, words, strict=True)):
            words = [w if i else (0, 0) for i, w in zip(inside, words, strict=True)]
        size = len(self.tag)
        last = list(range(size))  # an element's subtree are the elements up to its last one
        before, after = [(0, 0)] * (size + 1), [(0, 0)] * (size + 1)
        for n in range(size - 1, 0, -1):
            last[self.parent[n]] = max(last[self.parent[n]], last[n])
        for n in range(size):
            before[n + 1] = max(before[n], words[n])
        for n in range(size - 1, -1, -1):
            after[n] = max(after[n + 1], words[n])
        return after[0][1], [max(before[n], after[last[n] + 1])[1] for n in range(size)]

    def text(self, template) -> str:
        """Blocks of the page's article, or of the whole page, without what is beside the text and the template's subtrees."""
        inside, whole = self.inside(), self.whole()
        hashes = self.hashes() if template else ()

        def blocks(maybe: bool, template) -> str:
            gone = [False] * len(self.tag)
            for n in range(1, len(self.tag)):
                title = self.tag[n] == "header" and inside[n]
                own = self.beside[n] and not title or self.named[n] and not whole[n]
                own |= maybe and self.maybe[n] and not whole[n] and not title and not (inside[n] and self.tag[n] in OF_TEXT)
                gone[n] = gone[self.parent[n]] or own or bool(template) and self.tag[n] not in KEPT and hashes[n] in template
            article = any(inside[n] and not gone[n] for n, t in self.events if t is not None and not t.isspace())
            if any(inside) and not article and (maybe or template):
                return ""
            out: list[list[str]] = [[]]
            for node, text in self.events:
                if gone[node] or article and not inside[node]:
                    continue
                if text is None:
                    if out[-1]:
                        out.append([])
                else:
                    out[-1].append(text)
            return "\n".join(x for b in out if (x := " ".join("".join(b).split())))

        return blocks(True, template) or (blocks(True, None) or blocks(False, None) if any(inside) else "")


#: Elements that hold a page's text as a whole are never template; ends of these don't reach past a list or table.
KEPT = frozenset(("html", "main", "article"))
CONTAINERS = frozenset(("ul", "ol", "dl", "table", "select"))


def _counted(batches):
    """(host, hash, content) once over each batch; hash 0 stands for the page itself."""
    for pdf in batches:
        rows = set()
        for host, source in zip(pdf["host"], pdf["html"], strict=True):
            page = Page(source or "")
            hashes = page.hashes()
            own, outside = page.contents(hashes)
            rows.update((host, h, c) for h, c in zip(hashes, outside, strict=True))
            rows.add((host, 0, own))
        yield pd.DataFrame(list(rows), columns=["host", "hash", "content"])


def templates(pages: DataFrame) -> DataFrame:
    """(host, hash) of the subtrees that recur over a host's contents, from columns host and html."""
    rows = pages.where("host <> ''").mapInPandas(_counted, "host string, hash long, content long").distinct()
    counts = materialize(rows.groupBy("host", "hash").agg(F.count("*").alias("pages")).where(F.col("pages") >= LEAST_PAGES))
    total = counts.where("hash = 0").select("host", F.col("pages").alias("total"))
    return counts.where("hash <> 0").join(total, "host").where((F.col("pages") >= F.col("total") * SHARE) | (F.col("pages") >= MANY_PAGES)).select("host", "hash")


def _extracted(batches):
    for pdf in batches:
        texts = [Page(source or "").text(frozenset() if template is None else frozenset(template.tolist())) for source, template in zip(pdf["html"], pdf["template"], strict=True)]
        yield pdf[["id", "url"]].assign(text=texts)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of each row.

    Null and empty pages have an empty text; pages without a host in their url have no
    template. Pages of any length are read whole. A subtree on exactly half of a host's contents, or on exactly
    ``LEAST_PAGES`` or ``MANY_PAGES``, is template. Ids may be null; rows that repeat an id or a page come back as
    often and count once as content. An empty table gives no rows. Other columns, whatever their names, are ignored.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))
    pages = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))
    found = materialize(templates(pages.select("host", "html")))
    by_host = found.groupBy("host").agg(F.collect_set("hash").alias("template"))
    if found.limit(TEMPLATE_ROWS + 1).count() <= TEMPLATE_ROWS:
        by_host = F.broadcast(by_host)
    texts = pages.join(by_host, "host", "left").select("id", "url", "html", "template").mapInPandas(_extracted, "id long, url string, text string")
    return texts.select(F.col("id").alias(id_col), "url", "text", F.length("text").cast("long").alias("n_chars"))
